import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ripplegraph.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark, tmp_path):
    """Each stage on its own input, against the operators' plain rules."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        rows.append(docs.collect())
    ids = [{r.doc_id for r in x} for x in rows]
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = ids[0] - ids[1]
    assert all(truth.get(i, 0) == 0 for i in gone) and {i for i, q in truth.items() if q == 0 and i in ids[0]} <= gone | {i for i in ids[1]}
    kept = {}
    for r in rows[1]:
        t = "".join(c.lower() if c.isascii() else c for c in r.text)
        kept[t] = max(kept.get(t, -1), r.doc_id)
    assert ids[2] == set(kept.values())
    shingles = {r.doc_id: {tuple(w[i : i + 5]) for w in [r.text.lower().split()] for i in range(max(1, len(w) - 4))} for r in rows[2]}
    for i in ids[2] - ids[3]:  # each has a likeness, be it a dropped one
        assert max(len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]) for j in ids[2] if j != i) >= 0.8
    for i in ids[3]:
        assert all(len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]) < 0.8 for j in ids[3] if j < i)
    assert ids[4] <= ids[3]
    words = lambda x, s: sum(len(r.text.encode().split()) for r in x if r.source == s)
    sources = sorted({r.source for r in rows[3]})
    total = sum(words(rows[3], s) for s in sources)
    weights = {s: k % 3 + 1 for k, s in enumerate(sources)}
    for s in sources:
        share = total * weights[s] / sum(weights.values())
        if share < 2 * words(rows[3], s):
            assert words(rows[4], s) > 0.9 * share
    assert {r.doc_id for r in rows[5]} == ids[4]
    seen = {}
    for r in rows[5]:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_registered_queries(spark):
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("k", range(5))
def test_stages_bear_odd_rows(spark, odd_docs, no_docs, k):
    stage = corpus_pipeline.STAGES[k][1]
    for docs in (odd_docs, no_docs):
        made = stage(spark, docs, SF)
        made.collect()
        assert k == 4 or made.columns == docs.columns


#: Names that operators use inside, or once did, and those of results.
CLASHES = "_id _y _a _d _s _b _root _text _words _row _piece _fp _hash _more _key _n _r _shard _draw _passes _spans _bucket taken target source_size size keep_id kept score predicted held_out word gram digest spans verdict component_id".split()


@pytest.mark.parametrize("k", range(5))
def test_stages_bear_any_names(spark, odd_docs, k):
    stage, clashing = corpus_pipeline.STAGES[k][1], odd_docs.select("*", *[F.lit(j).alias(c) for j, c in enumerate(CLASHES) if c not in odd_docs.columns])
    made, plain = stage(spark, clashing, SF), stage(spark, odd_docs, SF)
    assert k == 4 or made.columns == clashing.columns
    assert sorted(map(str, made.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("k", range(1, 11))
def test_queries_bear_any_names(spark, odd_docs, tmp_path, k):
    rows = odd_docs.limit(6).where("doc_id is not null")
    tables = {
        "documents": rows,
        "pages": rows.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example.net/es/1").alias("url"), F.col("text").alias("html")),
        "labels": rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")),
    }
    made = []
    for name, more in (("plain", []), ("clashing", CLASHES)):
        for t, df in tables.items():
            df.select("*", *[F.lit(j).alias(c) for j, c in enumerate(more) if c not in df.columns]).write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        query = list(queries.queries().values())[k - 1]
        made.append(sorted(map(str, query(spark, f"{tmp_path}/{name}").collect())))
    assert made[0] == made[1] and made[0]
