import hashlib
from collections import defaultdict

import numpy as np
import pytest

from ripplegraph.llm import binary_fuse
from ripplegraph.llm.exact_dedup import exact_duplicates, kept_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_filter_has_every_key_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    built = binary_fuse.build(np.concatenate([keys, keys[: n // 2]]))
    assert binary_fuse.contains(built, keys).all()
    others = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert binary_fuse.contains(built, others).mean() < 0.01
    assert len(built["table"]) <= 1.4 * n + 64


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    for i, t in rows:
        ids = groups[(t or "").translate(LOWER)]
        known = [x for x in ids if x is not None]
        keep = max(known) if known else None
        yield i, keep, len(ids), i == keep, hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()


def test_equals_brute_force(spark, odd_docs):
    for docs, shard in ((odd_docs, 1 << 17), (odd_docs, 2), (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 16)):
        want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=str)
        assert sorted(map(tuple, exact_duplicates(docs, shard).collect()), key=str) == want


def test_kept_rows_have_each_text_once(odd_docs):
    kept = kept_rows(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [(r.text or "").translate(LOWER) for r in kept.collect()]
    every = {(r.text or "").translate(LOWER) for r in odd_docs.collect()}
    assert len(texts) == len(set(texts)) and set(texts) == every


def test_no_rows(no_docs):
    assert exact_duplicates(no_docs).collect() == [] and kept_rows(no_docs).collect() == []
