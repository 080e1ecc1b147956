import hashlib

import pytest
from pyspark.sql import functions as F

from ripplegraph.llm import warc
from ripplegraph.llm.warc import Archive, archived, originals, parsed, read_back, read_files, rebuilt, record_of, write_files

SCHEMA = "page_id long, url string, html string, key string, n int, payload string, _last long"


@pytest.fixture(scope="module")
def odd_pages(spark):
    big, bigger = "<p>" + "x" * 1200, "<p>ünï" + "日本\r\n\r\n" * 400
    rows = [(1, "http://a.org/", big), (2, "http://b.org/", big), (3, "http://c.org/\r\nX: y", big.upper()), (4, None, bigger), (5, "http://e.org/", bigger), (5, "http://e2.org/", bigger)]
    rows += [(6, "u", "short"), (7, "u", "short"), (8, "u", None), (9, "u", ""), (None, "u", big), (None, None, "<b>" + "n" * 2000), (None, None, "<b>" + "n" * 2000), (12, "u", "y" * 3_000_000)]
    rows += [(100 + i, f"http://h.org/{i}", "many" * 300) for i in range(700)]
    return spark.createDataFrame([(*r, "k", 1, "p", 3) for r in rows], SCHEMA).repartition(5)


def slow(rows):
    last = {}
    for i, html in rows:
        last[html] = max((x for x in (last.get(html), i) if x is not None), default=None)
    for i, html in rows:
        body = (html or "").encode()
        revisit = len(body) >= 1000 and i != last[html]
        yield i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last[html] if revisit else None


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_equals_brute_force(spark, odd_pages):
    for pages in (odd_pages, spark.read.parquet("/root/testdata/sf0.001/pages.parquet")):
        same(rebuilt(pages).collect(), slow([(r.page_id, r.html) for r in pages.collect()]))


def test_each_payload_is_stored_once_and_originals_come_back(odd_pages):
    archive = archived(odd_pages)
    stored = [bytes(r.payload) for r in archive.payloads.collect()]
    rows = odd_pages.collect()
    assert sorted(stored) == sorted({(r.html or "").encode() for r in rows})
    back = originals(archive).select("page_id", "payload").collect()
    assert sorted(((r.page_id, bytes(r.payload)) for r in back), key=str) == sorted(((r.page_id, (r.html or "").encode()) for r in rows), key=str)


def test_records_have_exact_fields(odd_pages):
    rows = originals(archived(odd_pages)).select("*", F.concat(record_of(), F.lit(warc.END)).alias("record")).collect()
    ids = {}
    for r in rows:
        fields, body = parsed(bytes(r.record))
        assert body == (b"" if r.record_type == "revisit" else bytes(r.payload))
        ids.setdefault(fields["warc-record-id"], set()).add((r.page_id, bytes(r.payload)))
        assert fields["warc-type"] == r.record_type and "x" not in fields
    assert all(len(x) == 1 for x in ids.values())
    names = {(next(iter(v))): k for k, v in ids.items()}
    for r in rows:
        refers = parsed(bytes(r.record))[0].get("warc-refers-to")
        assert refers == (names[r.refers_to, bytes(r.payload)] if r.record_type == "revisit" else None)


def test_files_hold_the_same_records(spark, odd_pages, tmp_path):
    archive = archived(odd_pages)
    write_files(archive, str(tmp_path / "w"), records_a_file=50)
    want = originals(archive).select(F.concat(record_of(), F.lit(warc.END)).alias("record"))
    assert sorted(bytes(r[0]) for r in read_files(spark, str(tmp_path / "w")).collect()) == sorted(bytes(r[0]) for r in want.collect())


def test_damage_is_an_error(odd_pages):
    archive = archived(odd_pages)
    with pytest.raises(Exception, match="differs from its digest"):
        read_back(Archive(archive.headers, archive.payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))))).collect()
    with pytest.raises(Exception, match="no payload of digest"):
        read_back(Archive(archive.headers, archive.payloads.limit(1))).collect()


def test_no_rows(spark, odd_pages):
    assert rebuilt(odd_pages.limit(0)).collect() == []
