"""Repeated lines or paragraphs: of each, the earliest in rank stays and the rest is cut."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import LOWER, UPPER, joined_by_key, slices, text_of, written

#: Units of fewer words are headings and the like, which repeat by chance.
LEAST_WORDS = 5
_SPLIT = {"line": re.compile("\n"), "sentence": re.compile("\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*")}
#: Where a sentence ends inside a line, with the space that follows.
_SENTENCE = re.compile(r"[.!?\u2026]+[\"')\]\u201d\u2019\u00bb]*[ \t\r]+|[\u3002\uff01\uff1f]+[ \t\r]*")
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def units(text: str, kind: str, least_words: int) -> list[tuple[int, int, bytes]]:
    """start, length (with the break that follows) and digest of each unit that counts.

    A digest is of the words alone, with A-Z lower-cased and ASCII punctuation left out. Of
    kind sentence, units are whole lines and the sentences inside them.
    """
    found, at, size = [], 0, len(text)

    def add(start: int, end: int, after: int) -> None:
        words = text[start:end].encode().translate(_LOWERED, _PUNCTUATION).split()
        if len(words) >= least_words:
            found.append((start, after - start, hashlib.md5(b" ".join(words)).digest()))

    while at < size:
        broken = _SPLIT[kind].search(text, at)
        end, after = (broken.start(), broken.end()) if broken else (size, size)
        add(at, end, after)
        cuts = [m.end() for m in _SENTENCE.finditer(text, at, end) if m.end() < end] if kind == "sentence" else []
        if cuts:
            for a, b in zip([at, *cuts], [*cuts, end], strict=True):
                add(a, b, after if b == end else b)
        at = after
    return found


def joined_spans(spans: list[dict]) -> list[dict]:
    """Spans in order of their starts, without those inside others."""
    kept: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], -s["length"])):
        if not kept or s["start"] >= kept[-1]["start"] + kept[-1]["length"]:
            kept.append(s)
    return kept


def _row_key():
    """Of a row: its id and text, so that rows that only share an id aren't mixed up."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_of())))


def repeated_spans(docs: DataFrame, kind: str = "line", least_words: int = LEAST_WORDS) -> DataFrame:
    """key, spans: what each row must lose, as (start, length) in characters, in order.

    The rank of an occurrence is its doc_id (null last) and place. A digest's first
    occurrence is a minimum, summed before the shuffle; only digests that occur again are
    joined back. Very common ones, a bounded number, are sent to the rows instead, so that no
    line's occurrences meet in one task.
    """

    def run(batches):
        for b in slices(batches):
            rows = [(i, *u) for i, t in enumerate(b.column(2).to_pylist()) for u in units(t, kind, least_words)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(at),
                    b.column(1).take(at),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.binary()),
                ],
                names=["key", "doc_id", "start", "length", "digest"],
            )

    texts = docs.select(_row_key().alias("key"), F.col("doc_id").cast("long"), text_of().alias("t"))
    found = written(texts.mapInArrow(run, "key binary, doc_id long, start long, length long, digest binary"))
    total = found.count()
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "key", "start")
    again = written(found.groupBy("digest").agg(F.min(rank).alias("_first"), F.count("*").alias("_n")).where("_n > 1").withColumnRenamed("digest", "_d"))
    # rows of no single key, as a copy of a row has the same rank as the row itself
    lost = joined_by_key(found, again, F.col("digest") == F.col("_d"), "_n", total).where(~rank.eqNullSafe(F.col("_first")))
    spans = lost.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"))
    if kind != "sentence":
        return spans

    def join(batches):
        for b in slices(batches):
            found = pa.array([joined_spans(x) for x in b.column(1).to_pylist()], b.schema.field(1).type)
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=["key", "spans"])

    return spans.mapInArrow(join, spans.schema)


def without_repeats(docs: DataFrame, kind: str = "line", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text, kept_spans, removed_spans, n_chars, n_chars_before, n_removed: one row per row of ``docs``.

    Spans are (start, length) in characters of the original text, which has ``n_chars_before``;
    ``text`` is the kept spans one after another, ``n_chars`` in all, so that every kept
    character can be traced. Null texts count as
    empty and keep nothing. Rows with the same id and the same text count as one and keep
    the same lines. Units under ``least_words`` words stay. Other columns are ignored, no rows give none.
    """
    lost = repeated_spans(docs, kind, least_words).withColumnRenamed("key", "_lost")
    rows = docs.select(F.col("doc_id"), text_of().alias("_t"), _row_key().alias("_key")).join(lost, F.col("_key") == F.col("_lost"), "left")
    none = F.array().cast("array<struct<start: bigint, length: bigint>>")
    size = F.length("_t").cast("long")
    rows = rows.withColumn("removed_spans", F.coalesce("spans", none)).withColumn("_size", size)
    gaps = F.expr(
        """filter(transform(sequence(0, size(removed_spans)), i -> struct(
            if(i = 0, 0L, removed_spans[i - 1].start + removed_spans[i - 1].length) AS start,
            if(i = size(removed_spans), _size, removed_spans[i].start) - if(i = 0, 0L, removed_spans[i - 1].start + removed_spans[i - 1].length) AS length)),
            x -> x.length > 0)"""
    )
    rows = rows.withColumn("kept_spans", gaps)
    cut = F.array_join(F.transform("kept_spans", lambda x: F.col("_t").substr((x["start"] + 1).cast("int"), x["length"].cast("int"))), "")
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    return rows.select("doc_id", F.when(F.size("removed_spans") > 0, cut).otherwise(F.col("_t")).alias("text"), "kept_spans", "removed_spans", (F.col("_size") - removed).alias("n_chars"), F.col("_size").alias("n_chars_before"), removed.alias("n_removed"))
