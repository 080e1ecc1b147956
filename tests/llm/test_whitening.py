import numpy as np
import pytest

from ripplegraph.llm.rank_one import Spectrum, secular_roots
from ripplegraph.llm.whitening import components, usable, whitened

SCHEMA = "vec_id long, embedding array<double>, x string, n int, part string"


def scatter(x):
    y = x - x.mean(axis=0)
    return y.T @ y


def close(s, want, tol=1e-11):
    size = max(np.abs(want).max(), 1e-300)
    assert np.abs(s.vectors.T @ s.vectors - np.eye(len(want))).max() < 1e-12
    assert np.abs(s.vectors * s.values @ s.vectors.T - want).max() < tol * size


@pytest.mark.parametrize("k", [1, 2, 3, 17, 64])
def test_roots_of_the_secular_equation(k):
    rng = np.random.default_rng(k)
    for wide in (1.0, 1e-6, 1e-12):
        d = np.cumsum(rng.random(k) * rng.choice([1.0, wide], k) + 1e-13)
        z = rng.normal(size=k) * rng.choice([1.0, 1e-7], k)
        roots, apart = secular_roots(d, z)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.abs(roots - want).max() < 1e-13 * max(1, want.max()) * k
        assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()
        assert np.abs(apart - (d[:, None] - roots)).max() < 1e-13 * max(1, want.max())


@pytest.mark.parametrize("kind", ["plain", "copies", "axes", "flat", "tiny", "wide", "constant"])
def test_updates_equal_one_decomposition(kind):
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(300, 12)) * np.geomspace(1, 1e-3, 12)
    if kind == "copies":
        x = x[rng.integers(0, 5, 300)]
    if kind == "axes":
        x = np.eye(12)[rng.integers(0, 12, 300)]
    if kind == "flat":
        x[:, 6:] = x[:, :6]
    if kind == "tiny":
        x[:, 1:] *= 1e-14
    if kind == "wide":
        x = np.round(x * 64) + 1_000_000
    if kind == "constant":
        x[:] = 3
    one = Spectrum(12)
    for row in x:
        one.add(row)
    close(one, scatter(x) if kind != "constant" else np.zeros((12, 12)))
    assert one.n == 300 and np.allclose(one.mean, x.mean(axis=0))
    parts = [Spectrum(12) for _ in range(4)]
    for i, row in enumerate(x):
        parts[i % 3].add(row)  # the fourth stays empty
    for p in parts[1:]:
        parts[0].merge(p)
    close(parts[0], scatter(x) if kind != "constant" else np.zeros((12, 12)))
    assert parts[0].n == 300


def slow(rows, most=16):
    """The result by one decomposition on one machine, from whole numbers."""
    lengths = {}
    kept = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for _, x in kept:
        lengths[len(x)] = lengths.get(len(x), 0) + 1
    most_common = max(lengths, key=lambda k: (lengths[k], k))
    kept = [(i, x) for i, x in kept if len(x) == most_common]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[(n * a - b) / n for a, b in zip(x, s, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(most, int((values > 1e-12 * values[0]).sum()))
    for i, x in kept:
        e = [n * a - b for a, b in zip(x, s, strict=True)]
        for c in range(rank):
            yield i, c + 1, n, sum(v * v for v in e), float(np.array(e) / n @ vectors[:, c] / np.sqrt(values[c])), float(values[c] / values.sum())


def same(got, want):
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[3], r[1])
    got, want = sorted(got, key=key), sorted(want, key=key)
    signs = {}
    for g, w in zip(got, want, strict=True):
        assert tuple(g[:4]) == tuple(w[:4])
        sign = signs.setdefault(g[1], np.sign(g[4] * w[4]) if abs(w[4]) > 1e-6 else 1)
        assert abs(g[4] * sign - w[4]) < 1e-7
        assert abs(g[5] - w[5]) < 1e-9
        assert g[6] < 1e-9


def test_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    same([tuple(r) for r in whitened(df).collect()], list(slow([(r.vec_id, r.embedding) for r in df.collect()])))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(40)]
    rows = base + [(0, base[1][1]), (None, base[2][1]), (None, base[2][1]), (50, None), (51, [1.0, None, 1.0, 1.0, 1.0]), (52, [float("nan")] * 5), (53, [1.0, float("inf"), 0.0, 0.0, 0.0]), (54, [1.0, 2.0]), (55, [])]
    df = spark.createDataFrame([(i, v, "x", 1, "p") for i, v in rows], SCHEMA).repartition(3)
    same([tuple(r) for r in whitened(df).collect()], list(slow(rows)))
    assert {r[1] for r in whitened(df, most=2).collect()} == {1, 2}


def test_little_rank_huge_entries_and_no_rows(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    df = lambda rows: spark.createDataFrame([(i, v, "x", 1, "p") for i, v in rows], SCHEMA)
    same([tuple(r) for r in whitened(df(line)).collect()], list(slow(line)))
    assert {r.component for r in whitened(df(line)).collect()} == {1}
    assert whitened(df([(1, [1.0, 2.0])] * 3)).collect() == []
    assert whitened(df([(1, []), (2, [])])).collect() == []
    assert whitened(df([(1, None)])).collect() == []
    assert whitened(df([])).collect() == []
    huge = whitened(df([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(r.deviation is None for r in huge if r.vec_id < 3)


def test_any_number_of_partitions_gives_the_same(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(700)]
    fit = usable(spark.createDataFrame([(i, v, "x", 1, "p") for i, v in rows], SCHEMA)).select("x").distinct()
    one, many = components(fit.repartition(1)), components(fit.repartition(37, "x"))
    assert one[:2] == many[:2]
    assert np.allclose(one[2], many[2], rtol=1e-12) and np.allclose(one[3], many[3], atol=1e-10)
