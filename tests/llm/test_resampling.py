import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ripplegraph.llm import resampling
from ripplegraph.llm.resampling import BUCKETS, _Hashes, features, ranked, resampled

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["", " ", "one", "One two", "a--b c_d e9 Z\x00z", "Ünïcödé 日本語 text mit ÄÖ   x", "tab\tand\nline\x0bbreaks\x1c", "same same same", "x" * 90 + " y" * 70]


def slow_features(text, most=2):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % BUCKETS for r in runs]


@pytest.mark.parametrize("most", [1, 2, 3])
@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_features_equal_a_slow_version(most, size):
    for text in TEXTS:
        lists = list(features(text.encode(), _Hashes(), most, size))
        n, want = slow_features(text, most)
        assert sum(map(len, lists[::most])) == n
        assert Counter(b for x in lists for b in x) == Counter(want)


def test_few_remembered_words_change_nothing(monkeypatch):
    monkeypatch.setattr(resampling, "REMEMBERED", 2)
    known = _Hashes()
    for text in TEXTS * 2:
        assert Counter(b for x in features(text.encode(), known) for b in x) == Counter(slow_features(text)[1])
    assert len(known) <= 2


def slow(docs, target, percent=25, least=20):
    s = Counter(b for _, t in docs for b in slow_features(t)[1])
    t_ = Counter(b for t in target for b in slow_features(t)[1])
    s_all, t_all = sum(s.values()) + BUCKETS, sum(t_.values()) + BUCKETS
    gain = [math.floor(1000 * math.log((t_[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(BUCKETS)]
    rows = []
    for i, t in docs:
        n_words, found = slow_features(t)
        weight = math.floor(sum(gain[b] for b in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    wanted = len(able) * percent // 100
    for place, r in enumerate(able, 1):
        yield r[0], r[2], r[3], r[4], place if place <= wanted else None
    yield from ((r[0], r[2], r[3], r[4], None) for r in rows if r[1] < least)


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_equals_brute_force(spark):
    docs, target = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [r.text for r in target.collect()]
    same(resampled(docs, target).collect(), slow([(r.doc_id, r.text) for r in docs.collect()], texts))
    mixed = resampled(docs.repartition(7), target, percent=60, least_words=1).collect()
    same(mixed, slow([(r.doc_id, r.text) for r in docs.collect()], texts, 60, 1))


def test_odd_rows(spark, odd_docs, no_docs):
    target = odd_docs.limit(2).select(F.col("doc_id").alias("item_id"), "text", "lang")
    rows, texts = [(r.doc_id, r.text) for r in odd_docs.collect()], [r.text for r in target.collect()]
    same(resampled(odd_docs, target, percent=100, least_words=1).collect(), slow(rows, texts, 100, 1))
    same(resampled(odd_docs, target.limit(0), percent=50, least_words=2).collect(), slow(rows, [], 50, 2))
    assert resampled(no_docs, target).collect() == []


def test_places_are_global_and_ties_go_by_id(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("score"), F.col("id").alias("doc_id"))
    got = {r.doc_id: r["rank"] for r in ranked(rows.repartition(9), [F.desc("score"), F.asc("doc_id")], 2500).collect()}
    want = sorted(range(3000), key=lambda i: (-(i % 3), i))
    assert got == {i: p if p <= 2500 else None for p, i in enumerate(want, 1)}
