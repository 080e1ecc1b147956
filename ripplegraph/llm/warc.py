"""A content-addressed web archive: payloads once by digest, exact record headers beside them."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm.common import broadcast_if_small, joined_by_key, read, slices, written
from ripplegraph.model import shared_folder

CRLF, END = "\r\n", b"\r\n\r\n"
#: Fixed values of the format: its first line, and what a revisit of an identical payload names.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
#: A date for pages that have none; payloads shorter than this are never revisited.
DATE, LEAST = "2000-01-01T00:00:00Z", 1000
#: Records that share one copy of a payload when originals are put together again.
SHARE = 256


@dataclass(frozen=True)
class Archive:
    """headers: page_id, record_type, refers_to, head (binary, all before the payload), key, n (records with the key).
    payloads: key (SHA-256), payload (binary): each distinct payload once."""

    headers: DataFrame
    payloads: DataFrame

    def save(self, path: str) -> None:
        self.headers.write.parquet(f"{path}/headers.parquet")
        self.payloads.write.parquet(f"{path}/payloads.parquet")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Archive:
        return Archive(read(spark, path, "headers"), read(spark, path, "payloads"))


def payload_of(name: str = "html") -> Column:
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def key_of(payload: Column) -> Column:
    """The payload's address: its SHA-256."""
    return F.unhex(F.sha2(payload, 256))


def _record_id(page_id: Column, sha1: Column) -> Column:
    """A name-based UUID (version 5) of the page's id and payload."""
    h = F.sha1(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit("/"), sha1).cast("binary"))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _head(url: Column, date: str) -> Column:
    """All bytes of a record before its payload: the record's fields, and the lines of the HTTP answer."""
    revisit = F.col("record_type") == "revisit"
    plain = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    fields = F.concat_ws(
        CRLF,
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("sha1"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), plain),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"), F.col("sha1")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit(f"Content-Type: {HTTP_TYPE}"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
    )
    return F.concat(fields, F.lit(CRLF * 2), http).cast("binary")


def archived(pages: DataFrame, least: int = LEAST, date: str = DATE) -> Archive:
    """The archive of a table of pages (page_id, url, html).

    Null pages have empty payloads, null urls no target field; line breaks in urls are written as
    %0D and %0A. Of equal payloads of at least ``least`` bytes the record with the largest page_id
    is the response and the others are revisits that refer to it; shorter ones are all responses.
    A null id is smaller than any other, and a group of null ids alone has responses only. Rows
    repeated with the largest id are all responses. Other columns are unread, whatever their
    names; no rows give an empty archive. Long payloads move once, from the scan to the store:
    which rows hold a payload that is stored already is settled by digests.
    """
    payload = payload_of()
    light = written(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("sha1"), key_of(payload).alias("key")
        )
    )
    groups = written(light.groupBy(F.col("key").alias("_key")).agg(F.max("page_id").alias("_last"), F.count("*").alias("n")))
    counted = groups.withColumn("_n", F.col("n"))
    rows = joined_by_key(light, counted, F.col("key") == F.col("_key"), "_n", light.count()).drop("_key")
    other = (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("_last"))
    typed = rows.withColumn("record_type", F.when(other, "revisit").otherwise("response")).withColumn("refers_to", F.when(other, F.col("_last")))
    headers = typed.select("page_id", "record_type", "refers_to", _head(F.col("url"), date).alias("head"), "key", "n")
    return Archive(headers, _stored(pages, rows))


def _stored(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """key, payload: each payload once, from the row with the largest id that holds it."""
    holds = F.col("page_id").eqNullSafe(F.col("_last"))
    known = [F.col("page_id").alias("_id"), F.col("key").alias("_of")]
    skipped = written(rows.where(~holds).select(*known).distinct())
    twice = written(rows.where(holds & (F.col("n") > 1)).groupBy(*known).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    bodies = pages.select(F.col("page_id").cast("long").alias("page_id"), key_of(payload_of()).alias("key"), payload_of().alias("payload"))
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_of"))
    left = bodies.join(broadcast_if_small(skipped, skipped.count(), 64), same, "left_anti")
    if n_twice := twice.count():
        again = broadcast_if_small(twice, n_twice, 64)
        once = left.join(again, same, "left_semi").groupBy("key").agg(F.first("payload").alias("payload"))
        left = left.join(again, same, "left_anti").select("key", "payload").unionByName(once)
    return left.select("key", "payload")


def originals(archive: Archive) -> DataFrame:
    """page_id, record_type, refers_to, head, payload: every record with its payload, joined by digest.

    A payload that very many records share is copied for each SHARE of them, so that no task
    gathers them all. A payload that doesn't have the digest it is stored under is an error, as is
    a record whose payload is not there.
    """
    verified = F.when(key_of(F.col("payload")) == F.col("key"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.hex("key"))))
    copies = F.greatest(F.lit(1), F.ceil(F.col("n") / SHARE)).cast("int")
    uses = archive.headers.groupBy("key").agg(F.max("n").alias("n")).where(F.col("n") > SHARE).select(F.col("key").alias("_key"), copies.alias("_copies"))
    uses = written(uses)
    shared = archive.payloads.join(broadcast_if_small(uses, uses.count(), 48), F.col("key") == F.col("_key"), "left")
    shared = shared.select(F.col("key").alias("_key"), verified.alias("payload"), F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)) - 1)).alias("_copy"))
    headers = archive.headers.withColumn("_share", F.pmod(F.xxhash64("head"), F.greatest(F.lit(1), F.ceil(F.col("n") / SHARE))).cast("int"))
    joined = headers.join(shared, (F.col("key") == F.col("_key")) & (F.col("_share") == F.col("_copy")), "left")
    found = F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("no payload of digest "), F.hex("key"))))
    return joined.select("page_id", "record_type", "refers_to", "head", found.alias("payload"))


def record_of() -> Column:
    """A record without its last two line ends: what stands before the payload, and the payload but in revisits."""
    return F.concat(F.col("head"), F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload")))


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields, by lower-case name, and the payload of its HTTP answer."""
    at = record.index(END)
    lines = record[:at].decode().split(CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]}")
    fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    block = record[at + 4 : at + 4 + length]
    if len(block) != length or record[at + 4 + length :] != END:
        raise ValueError(f"a record of another length than it says: {fields.get('warc-record-id')}")
    return fields, block[block.index(END) + 4 :]


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_back(archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from each record's own bytes.

    Responses are parsed whole. A revisit's bytes have no payload: its own is the one stored under
    its digest. A payload that differs from the digest in its record's fields is an error.
    """

    def run(batches):
        for b in slices(batches):
            out = []
            for record, payload, page_id, refers_to in zip(b.column("record"), b.column("payload"), b.column("page_id").to_pylist(), b.column("refers_to").to_pylist(), strict=True):
                fields, body = parsed(record.as_py())
                kind = fields["warc-type"]
                body = payload.as_py() if kind == "revisit" else body
                digest = hashlib.sha1(body).hexdigest()
                if fields["warc-payload-digest"] != f"sha1:{digest}":
                    raise ValueError(f"payload differs from the digest of {fields['warc-record-id']}")
                out.append((page_id, len(body), digest, kind, refers_to))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    revisit = F.when(F.col("record_type") == "revisit", F.col("payload"))
    return originals(archive).select("page_id", "refers_to", F.concat(record_of(), F.lit(END)).alias("record"), revisit.alias("payload")).mapInArrow(run, _READ)


def write_files(archive: Archive, path: str, records_a_file: int = 10_000) -> None:
    """Writes the records, revisits without payloads, as files that programs for web archives read."""
    originals(archive).select(record_of().cast("string").alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_a_file).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """record (binary): the records of uncompressed files, each cut off where its length says."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                data, at, found = content.as_buffer(), 0, []
                whole = memoryview(data)
                while at < len(whole):
                    head = bytes(whole[at : at + 65536])
                    end = head.index(END)
                    length = next(int(x.partition(b":")[2]) for x in head[:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    stop = at + end + 4 + length + 4
                    found.append(bytes(whole[at:stop]))
                    at = stop
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record binary")


def rebuilt(pages: DataFrame) -> DataFrame:
    """Archives the pages in the shared folder, reads the archive back, and returns what ``read_back`` does."""
    path = f"{shared_folder(pages)}/archives/{uuid.uuid4().hex}"
    archived(pages).save(path)
    return read_back(Archive.load(pages.sparkSession, path))
