import zlib
from collections import Counter

import numpy as np
import pytest

from ripplegraph.llm import quality_model as q


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = q.classified(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95
    assert [r.score for r in sorted(q.classified(docs, labels).collect())] == [r.score for r in sorted(rows)]


def test_labels_of_held_out_rows_are_not_learned(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    from pyspark.sql import functions as F

    from ripplegraph.llm.common import id_remainder

    flipped = labels.withColumn("quality", F.when(id_remainder("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in q.classified(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (7, 1, 0), (None, 1, 0), (8, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    rows = q.classified(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert q.accepted(odd_docs, labels).columns == odd_docs.columns
    assert q.classified(no_docs, labels).collect() == []
    none = labels.limit(0)
    assert {r.score for r in q.classified(odd_docs, none).collect()} == {0.5}


def slow_buckets(text):
    """Features of one text, gram by gram, with whole numbers of any size."""
    m, out = (1 << 64) - 1, []

    def bucket(value, kind):
        h = ((value + q._KINDS[kind] * 0x9E3779B97F4A7C15) * 0xFF51AFD7ED558CCD) & m
        h = ((h ^ (h >> 32)) * 0xC4CEB9FE1A85EC53) & m
        return h >> (64 - 17)

    words = text.split()
    hashes = [sum((c + 1) * pow(q._BASE, k, 1 << 64) for k, c in enumerate(w)) & m for w in words]
    out += [bucket(h, "word") for h in hashes] + [bucket((a * q._FIRST + b) & m, "pair") for a, b in zip(hashes, hashes[1:])]
    for w in words:
        w = b" " + w + b" "
        out += [bucket(int.from_bytes(w[i : i + n], "little"), n) for n in (3, 4) for i in range(len(w) - n + 1)]
    return out


TEXTS = [b"ab ab cd", b"", b" \t\n", b"a", "Ünï cödé  日本語\n\nx\x85y".encode(), b"word " * 3000, b"z" * 5000]


def test_features_equal_a_slow_version():
    for t in TEXTS:
        b, c = q.features(t)
        assert dict(zip(b.tolist(), c.tolist(), strict=True)) == dict(Counter(slow_buckets(t)))
    assert not set(q.features(b"ab ab")[0]) & set(q.features(b"xyz xyz")[0]), "repeated words share nothing"
    assert set(q.features(b"ab cd")[0]) != set(q.features(b"cd ab")[0]), "the order of a pair counts"


def test_scores_equal_a_slow_version(monkeypatch):
    rng = np.random.default_rng(3)
    model = q.Model(rng.normal(size=q.BUCKETS), 0.2)
    for chunk in (q.CHUNK, 1, 4000):
        monkeypatch.setattr(q, "CHUNK", chunk)
        for t, score in zip(TEXTS, model.scores(TEXTS), strict=True):
            b = slow_buckets(t)
            assert score == pytest.approx(1 / (1 + np.exp(-np.clip(0.2 + (model.weights[b].mean() if b else 0), -30, 30))), rel=1e-9)


def test_repeated_ids_are_collected_once(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k} of some words", "x") for k in range(400)], "doc_id long, text string, t string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert len(q.training_rows(docs, labels, modulus=1 << 30)) == 3


def test_training_learns_a_simple_split():
    rows = [(*q.features(f"{w} {k}".encode()), y, 1.0) for k in range(60) for w, y in (("good fine", 1), ("bad junk", 0))]
    model = q.train(rows)
    good, bad, none = model.scores([b"good fine 99", b"bad junk 99", b""])
    assert good > 0.8 and bad < 0.2
    assert none == pytest.approx(1 / (1 + np.exp(-model.bias)))


def test_training_rows_are_packed(spark):
    texts = ["", "one", " ".join(f"word{k}" for k in range(500)), "again " * 70_000]
    for t in texts:
        (f, c), (g, d) = q.features(t.encode()), q.unpacked(q.packed(*q.features(t.encode())))
        assert f.dtype == g.dtype and c.dtype == d.dtype and f.tolist() == g.tolist() and c.tolist() == d.tolist()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(texts))], "doc_id long, quality int")
    rows = q.training_rows(docs, labels, modulus=1 << 30)
    want = [(*q.features(t.encode()), k % 2, 1.0) for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % (1 << 30)]
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() and a[2:] == b[2:]
    assert len(rows.rows[2][0]) <= 4 * len(want[2][0]) + 2  # eight bytes a feature before
    (x, y) = (q.train(r) for r in (rows, want))
    assert x.bias == y.bias and (x.weights == y.weights).all()
