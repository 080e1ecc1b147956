import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplegraph.llm import simhash
from ripplegraph.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_print(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(rows, words, radius):
    prints = [slow_print(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                up[top(a)] = top(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(k) and rows[j][0] is not None]
        out.append((i, f"{prints[k]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB é\n\t,", max_size=60), st.integers(1, 5))
def test_fingerprint_equals_slow_one(text, words):
    assert int(simhash.fingerprint(text.encode(), words)[0]) == slow_print(text, words)


def test_equals_brute_force(spark, odd_docs):
    for docs in (odd_docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        for radius in (4, 12):
            got = simhash.near_duplicates(docs, words=4, radius=radius)
            assert sorted(map(tuple, got.collect()), key=str) == slow_classes(rows, 4, radius)


def test_tiles_lose_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 900)] ^ (np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[:i] if int(a ^ b).bit_count() <= 4}
    got = simhash.tile_links(fps[:, None], fps[:, None], 4)
    assert {frozenset(x) for x in got} <= {frozenset(x) for x in want}

    def classes(pairs):
        up = {int(f): int(f) for f in fps}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[top(a)] = top(b)
        groups = {}
        for f in up:
            groups.setdefault(top(f), set()).add(f)
        return {frozenset(g) for g in groups.values()}

    assert classes(got) == classes(want)


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(-5, 1299), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got[k] == 0 for k in range(201)) and all(got[k] == -5 for k in [-5, *range(1000, 1300)])
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    from ripplegraph.llm import components

    taken = []
    monkeypatch.setattr(components, "checkpointed", lambda df: taken.append(1) or df.localCheckpoint())
    for edges, tables in (([(2 * k, 2 * k + 1) for k in range(50)] + [(-7, k) for k in range(-6, 0)] + [(5, 4), (3, 3)], 1), ([(1, 2), (2, 3)], 2), ([], 1)):
        taken.clear()
        got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
        assert len(taken) == tables
        assert got == ({**{2 * k: 2 * k for k in range(50)}, **{2 * k + 1: 2 * k for k in range(50)}, **dict.fromkeys(range(-7, 0), -7)} if len(edges) > 9 else dict.fromkeys((1, 2, 3), 1) if edges else {})


def test_representatives(spark, odd_docs, no_docs):
    words = [f"w{k}" for k in range(200)]
    copy = [*words[:100], "changed", *words[101:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(f"x{k}" for k in range(200)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == [1, 3]
    assert simhash.representatives(odd_docs).columns == odd_docs.columns
    assert simhash.representatives(no_docs).collect() == []


def test_representatives_share_four_fifths(spark):
    """Fingerprints alone linked these: half-alike texts, and texts that one repeated run outweighs."""
    words = [f"w{k}" for k in range(400)]
    rows = [(0, words)]
    for i, step in ((1, 64), (2, 46), (3, 29)):  # a changed word alters five shingles: 0.85, 0.8 and 0.7 are shared at most
        rows.append((i, [f"new{i}" if k % step == 7 else w for k, w in enumerate(words)]))
    run = "the same five words again".split() * 60
    rows += [(10 + i, [*run, *[f"v{i}x{k}" for k in range(100)]]) for i in range(3)]
    rows += [(20 + i, [f"z{k}" for k in range(300)] + [f"tail{i}"]) for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    sets = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in rows}
    up = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = {x: min(a, b) if y in (a, b) else y for x, y in up.items()}
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == sorted(set(up.values()))


def test_groups_lose_no_similar_pair(spark, monkeypatch):
    """Components of more texts than a group holds are compared across groups."""
    monkeypatch.setattr(simhash, "TEXTS", 4)
    base = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([(i, " ".join([*base, f"end{i}"])) for i in range(40)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.representatives(docs).collect()] == [0]


def test_shared_counts_equal_sets():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 0, 5, 50, 50, 200, 200, 300)]
    sets += [np.delete(sets[-1], slice(0, k)) for k in (1, 6, 12, 20)]
    counts = simhash.SharedCounts(sets)
    for x in sets:
        want = [5 * len(set(x) & set(y)) >= 4 * len(set(x) | set(y)) for y in sets]
        assert counts.similar(x).tolist() == want
    assert simhash.SharedCounts([]).similar(sets[2]).tolist() == []


def test_representatives_equal_all_pairs(spark):
    """Recall and precision of one at a similarity of four fifths, against every pair that shares a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"]).select("doc_id", "text")
    sets = {r.doc_id: frozenset(simhash.shingle_set((r.text or "").encode(), 5).tolist()) for r in docs.collect()}
    found, up = {}, {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sorted(sets.items()):
        for h in s:
            found.setdefault(h, []).append(i)
    for i, j in {(i, j) for x in found.values() for i in x for j in x if i < j}:
        shared = len(sets[i] & sets[j])
        if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared) and (p := top(i)) != (q := top(j)):
            up[max(p, q)] = min(p, q)
    empty = [i for i in sorted(sets) if not sets[i]]
    want = {i for i in sets if top(i) == i} - set(empty[1:])
    assert {r.doc_id for r in simhash.representatives(docs).collect()} == want and len(want) < len(sets)
