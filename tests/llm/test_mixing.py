from collections import defaultdict

import pytest

from ripplegraph.llm.mixing import mix_documents, mix_sizes, source_targets


def filled(sizes):
    """Targets by resharing until none is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        level = (total - sum(stopped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return stopped | {s: level * weight[s] for s in free}
        stopped |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 500, "c": 2, None: 40, "": 3}, {"x": 7}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = filled(sizes)
    assert {r.source: pytest.approx(r.target) for r in got} == want


def check(docs, rows):
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    want, taken = filled(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    block = max(1, -(-sum(sizes.values()) // 65536))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3 * block, 0.02 * want[s])


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = mix_sizes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check(odd_docs, rows)
    assert sorted(map(str, rows)) == sorted(map(str, mix_sizes(odd_docs).collect()))
    assert mix_sizes(no_docs).collect() == []


def test_mix_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix_sizes(docs).collect()
    assert len(rows) == docs.count()
    check(docs, rows)


def test_documents_of_the_mix(spark, odd_docs):
    for docs in (odd_docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        made = mix_documents(docs)
        assert made.columns == docs.columns
        words = defaultdict(int)
        texts = {r.text for r in docs.collect() if r.text}
        for r in made.collect():
            words[r.doc_id] += len(r.text.encode().split())
            assert any(r.text in t for t in texts)
        want = defaultdict(int)
        for r in mix_sizes(docs).collect():
            want[r.doc_id] += r.taken
        assert dict(words) == {k: v for k, v in want.items() if v}
