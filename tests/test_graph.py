import hashlib
import random

import pyarrow as pa
import pytest

from ripplegraph.model import Graph, GraphError, Scratch, Snapshot, checkpointed
from ripplegraph.operators import closure as reach
from ripplegraph.operators import delta, graph, hashing

#: Services of a shop: what they hold, and what they import. ``audit`` is only mentioned.
EDGES = [
    ("shop", "cart", "contains"), ("shop", "stock", "contains"), ("shop", "mail", "contains"), ("cart", "prices", "imports"), ("stock", "prices", "imports"),
    ("stock", "depot", "imports"), ("depot", "maps", "imports"), ("mail", "templates", "imports"), ("audit", "mail", "mentions"), ("cart", "audit", "mentions"),
]
IDS = ("shop", "cart", "stock", "mail", "prices", "depot", "maps", "templates", "audit")
TOKENS = {"prices": "p1", "maps": "m1", "mail": "x1", "audit": "a1"}


def world(spark, tokens=TOKENS, edges=EDGES, ids=IDS):
    e = spark.createDataFrame([(i, "test") for i in ids], "id string, kind string")
    r = spark.createDataFrame(list(edges), "src string, dst string, kind string")
    t = spark.createDataFrame(list(tokens.items()), "id string, token string")
    return Snapshot(Graph(e, r), t, ("contains", "imports"))


def walk(edges, start):
    """All that an entity reaches, itself left out."""
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen - {start}


def slow_diff(old, new):
    """Compares every entity's sum; each side is (ids, edges, tokens)."""
    sums = [{i: slow_sum(i, walk(edges, i), tokens) for i in ids} for ids, edges, tokens in (old, new)]
    return {i: "removed" if i not in sums[1] else "added" if i not in sums[0] else "modified" for i in sums[0] | sums[1] if sums[0].get(i) != sums[1].get(i)}


def followed(edges):
    return [(a, b) for a, b, k in edges if k in ("contains", "imports")]


EDITS = {
    "none": {},
    "a token": {"tokens": TOKENS | {"maps": "m2"}},
    "a token that nothing follows": {"tokens": TOKENS | {"audit": "a2"}},
    "an edge more to what was reached": {"edges": [*EDGES, ("shop", "prices", "imports")]},
    "an edge more": {"edges": [*EDGES, ("mail", "maps", "imports")]},
    "an edge less": {"edges": [e for e in EDGES if e[:2] != ("stock", "depot")]},
    "an entity less": {"ids": [i for i in IDS if i != "depot"], "edges": [e for e in EDGES if "depot" not in e[:2]]},
    "another name": {"ids": [i.replace("maps", "atlas") for i in IDS], "edges": [tuple(x.replace("maps", "atlas") for x in e) for e in EDGES], "tokens": {k.replace("maps", "atlas"): v for k, v in TOKENS.items()}},
    "a ring": {"edges": [*EDGES, ("prices", "cart", "imports")]},
}


@pytest.mark.parametrize("edit", EDITS)
def test_edits_equal_slow_sums(spark, edit):
    head = {"tokens": TOKENS, "edges": EDGES, "ids": IDS} | EDITS[edit]
    got = {r.id: r.status for r in delta.diff(world(spark), world(spark, **head)).collect()}
    assert got == slow_diff((IDS, followed(EDGES), TOKENS), (head["ids"], followed(head["edges"]), head["tokens"]))


def test_random_edits_equal_slow_sums(spark):
    rng = random.Random(11)
    sides = [([], [], {}), ([], [], {})]
    for g in range(80):  # all graphs in one, as they have no nodes in common
        own = [f"g{g:02}n{k:02}" for k in range(rng.randint(2, 9))]
        edges = {(rng.choice(own), rng.choice(own), "imports") for _ in range(rng.randint(1, 2 * len(own)))}
        tokens = {i: f"t{rng.randint(0, 2)}" for i in own}
        for side, edit in zip(sides, (False, True), strict=True):
            ids = list(own)
            if edit:
                if rng.random() < 0.3:
                    ids.remove(rng.choice(ids))
                if rng.random() < 0.3:
                    ids.append(f"g{g:02}new")
                if rng.random() < 0.3:
                    tokens = tokens | {rng.choice(own): "edited"}
                drop = {e for e in edges if rng.random() < 0.15}
                edges = (edges - drop) | {(rng.choice(ids), rng.choice(ids), "imports") for _ in range(rng.randint(0, 2))}
            side[0].extend(ids)
            side[1].extend(e for e in sorted(edges) if e[0] in ids and e[1] in ids)
            side[2].update({i: t for i, t in tokens.items() if i in ids})
    old, new = (world(spark, t, e, i) for i, e, t in sides)
    got = {r.id: r.status for r in delta.diff(old, new).collect()}
    small = lambda s, g: ([i for i in s[0] if i.startswith(g)], [e[:2] for e in s[1] if e[0].startswith(g)], {i: t for i, t in s[2].items() if i.startswith(g)})
    wanted = {}
    for g in range(80):
        wanted |= slow_diff(small(sides[0], f"g{g:02}"), small(sides[1], f"g{g:02}"))
    assert got == wanted and {"added", "removed", "modified"} <= set(got.values())


def slow_layers(changed, added, deps):
    """Layers of the changed ids, by components and their nearest start, one by one."""
    inside = [(a, b) for a, b in deps if a in changed and b in changed]
    reached = {i: walk(inside, i) for i in changed}
    group = {i: frozenset([i, *(x for x in reached[i] if i in reached[x])]) for i in changed}
    below = {g: {group[b] for a, b in inside if group[a] == g and group[b] != g} for g in set(group.values())}
    level = {g: 0 for g in below if not below[g] or g & set(added)}
    while len(level) < len(below):
        nearest = min(level[x] for g in below if g not in level for x in below[g] if x in level)
        level |= {g: nearest + 1 for g in below if g not in level and any(level.get(x) == nearest for x in below[g])}
    return {i: level[group[i]] for i in changed}


def test_layers_equal_a_slow_version(spark):
    rng = random.Random(5)
    ids = [f"n{k:02}" for k in range(40)]
    deps = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(45)} | {("n01", "n02"), ("n02", "n01")})
    frame = lambda x: spark.createDataFrame([(i,) for i in x], "id string")
    for changed, added in ((ids, []), (ids[::2], ids[:3:2]), (ids[5:], ["n07", "n30"]), ([], [])):
        rows = delta.frontiers(frame(changed), frame(added), spark.createDataFrame(deps, "src string, dst string")).collect()
        assert {r.id: r.layer for r in rows} == slow_layers(changed, added, deps)


def test_induced_edges(spark):
    ids = ("shop", "cart", "prices", "audit")
    kept = graph.induced(world(spark).graph, spark.createDataFrame([(i,) for i in ids], "id string"))
    assert sorted(map(tuple, kept.edges.collect())) == sorted(e for e in EDGES if e[0] in ids and e[1] in ids)
    assert sorted(r.id for r in kept.entities.collect()) == sorted(ids)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n % 128 + 128]), n // 128
    return out + bytes([n])


def slow_sum(i, reached, tokens):
    entry = lambda x: varint(len(x.encode())) + x.encode() + varint(len(tokens.get(x, "").encode())) + tokens.get(x, "").encode()
    return hashlib.sha256(hashing.PREFIX + entry(i) + varint(len(reached)) + b"".join(entry(x) for x in sorted(reached, key=str.encode))).hexdigest()


def test_random_graphs_equal_a_slow_walk(spark, monkeypatch):
    rng = random.Random(7)
    ids, edges, tokens = [], [], {}
    for g in range(60):  # all graphs in one, as they have no nodes in common
        own = [f"g{g:02}n{k:02}é" for k in range(rng.randint(2, 15))]
        ids += own
        edges += [(rng.choice(own), rng.choice(own), rng.choice(["dep", "dep", "dep", "other"])) for _ in range(rng.randint(0, 3 * len(own)))]
        tokens |= {i: f"t{rng.randint(0, 2)}" * rng.choice([1, 60, 400]) for i in own if rng.random() < 0.5}
    below = {i: {b for a, b, k in edges if a == i and k == "dep"} for i in ids}

    reached = {i: walk([(a, b) for a in below if a[:3] == i[:3] for b in below[a]], i) for i in ids}
    s = world(spark, tokens, edges, ids)
    s = Snapshot(s.graph, s.tokens, ("dep",))
    deps = graph.dependencies(s.graph.edges, ("dep",))
    whole = reach.reach(deps)
    found = reach.to_ids(whole.expanded(), whole.names, "src", "dst")
    assert {tuple(r) for r in found.collect()} == {(i, x) for i in ids for x in reached[i]}
    wanted = {i: (len(reached[i]), slow_sum(i, reached[i], tokens)) for i in ids}
    for most in (hashing.AT_ONCE, 5000, 0):  # hashed as one value, some so, or all as they stream by
        monkeypatch.setattr(hashing, "AT_ONCE", most)
        assert {r.id: (r.n, r["sum"]) for r in hashing.content_sums(s.graph.entities, whole, s.tokens).collect()} == wanted
    some = s.graph.entities.where("id like '%n03%' or id like 'g05%'")
    assert {r.id: (r.n, r["sum"]) for r in delta.sums_of(s, some).collect()} == {i: wanted[i] for i in ids if "n03" in i or i.startswith("g05")}
    assert {r.id: (r.n, r.least, r.most) for r in reach.sizes(deps).collect()} == {i: (len(x), min(x, key=str.encode), max(x, key=str.encode)) for i, x in reached.items() if x}
    scc = {r.id: r.scc for r in reach.components(s.graph.entities, deps).collect()}
    assert scc == {i: min([i, *(x for x in reached[i] if i in reached[x])], key=str.encode) for i in ids}
    seeds = spark.createDataFrame([(i,) for i in ids[::9]], "id string")
    assert {r.id for r in reach.dependents(deps, seeds).collect()} == {i for i in ids if i in ids[::9] or reached[i] & set(ids[::9])}


@pytest.fixture
def rounds(monkeypatch):
    """Counts the rounds of spreading and of pairs, and the tables that are left of them."""
    seen = {"joins": 0}
    plain = reach._joined
    monkeypatch.setattr(reach, "_joined", lambda *a: seen.update(joins=seen["joins"] + 1) or plain(*a))
    return seen


def _frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_a_long_chain_takes_few_rounds(spark, rounds):
    n = 10_000
    ids = [f"{(k * 7919) % n:05}" for k in range(n)]
    deps = _frame(spark, list(zip(ids, ids[1:])))
    ends = spark.createDataFrame([(ids[-1],)], "id string")
    assert reach.dependents(deps, ends).count() == n and rounds["joins"] < 20
    found = {r.id: r.layer for r in delta.frontiers(spark.createDataFrame([(i,) for i in ids], "id string"), ends.limit(0), deps).collect()}
    assert found == {i: n - 1 - k for k, i in enumerate(ids)} and rounds["joins"] < 80


def test_a_long_ring_and_nested_rings_are_components(spark, rounds):
    n = 5_000
    ids = [f"r{(k * 4093) % n:04}" for k in range(n)]
    ring = list(zip(ids, [*ids[1:], ids[0]]))
    nested = [("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("a2", "b1"), ("b1", "b2"), ("b2", "a2"), ("b1", "c1"), ("c1", "c2"), ("c2", "c1"), ("c2", "d"), (ids[9], "a1")]
    every = sorted({x for e in ring + nested for x in e})
    found = {r.id: r.scc for r in reach.components(spark.createDataFrame([(i,) for i in every], "id string"), _frame(spark, ring + nested)).collect()}
    assert found == {i: "r0000" if i[0] == "r" else "c1" if i[0] == "c" else "d" if i == "d" else "a1" for i in every}
    assert rounds["joins"] < 60
    whole = reach.reach(_frame(spark, ring + nested))
    assert whole.pairs.count() == 6 and whole.members.count() == n + 7  # of four components, whatever their size


def test_layers_of_a_ladder_and_a_tail(spark):
    """Steps that would be too many when doubled are not: hubs in a row."""
    pairs = [(f"h{k:02}", f"x{k:02}-{j}") for k in range(14) for j in range(30)] + [(f"x{k:02}-{j}", f"h{k + 1:02}") for k in range(13) for j in range(30)]
    ids = sorted({x for p in pairs for x in p})
    deps = _frame(spark, pairs)
    found = {r.id: r.layer for r in delta.frontiers(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([], "id string"), deps).collect()}
    assert found == {i: 2 * (13 - int(i[1:3])) + (i[0] == "h") for i in ids}
    assert reach.dependents(deps, spark.createDataFrame([("x13-0",)], "id string")).count() == 1 + 14 + 13 * 30


def test_scratch_deletes_what_is_not_kept(spark):
    import os

    table = lambda: checkpointed(spark.range(3))
    there = lambda df: os.path.exists(df._table.removeprefix("file:"))
    with Scratch(spark.range(1)) as outer:
        with Scratch(spark.range(1)) as inner:
            a, b, c = table(), table(), table()
            inner.keep(b)
            inner.drop(c)
            assert there(a) and not there(c)
        assert not there(a) and there(b) and b.count() == 3
        assert b._table in outer.paths
    assert not there(b)


def test_shuffle_files_go_with_the_table_they_were_written_for(spark):
    import time

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x and x.endswith(".data")}
    before = files()
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    checkpointed(spark.range(5000).groupBy("id").count())
    end = time.time() + 20
    while (left := files() - before) and time.time() < end:
        time.sleep(0.5)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_results_leave_no_tables_of_rounds(spark):
    """A diff, layers, sizes, marks and sums leave one table each; closures the half-named pairs and the ids."""
    with Scratch(spark.range(1)) as scratch:
        base, head = world(spark), world(spark, **({"tokens": TOKENS, "edges": EDGES, "ids": IDS} | next(iter(EDITS.values()))))
        deps = graph.dependencies(base.graph.edges, base.followed)
        of = spark.createDataFrame([(IDS[0],)], "id string")
        left = []
        for f in (lambda: delta.diff(base, head), lambda: reach.sizes(deps), lambda: reach.dependents(deps, of), lambda: delta.sums_of(base), lambda: delta.frontiers(of, of, deps), lambda: reach.closure(deps)):
            before = set(scratch.paths)
            f()
            left.append(len(scratch.paths - before))
        assert left == [1, 1, 1, 1, 1, 2]


def test_sums_do_not_depend_on_how_rows_fall_into_batches():
    rows = [("a", 2, b"A"), (None, None, b"x"), (None, None, b""), ("b", 0, b"B"), ("c", 3, b""), (None, None, b"y"), (None, None, b"zz"), (None, None, b"w")]
    table = pa.table({"id": pa.array([r[0] for r in rows], pa.string()), "n": pa.array([r[1] for r in rows], pa.int64()), "entry": pa.array([r[2] for r in rows], pa.binary())})
    wanted = [(i, n, hashlib.sha256(b"p" + data).hexdigest()) for i, n, data in (("a", 2, b"Ax"), ("b", 0, b"B"), ("c", 3, b"yzzw"))]
    for size in range(1, 9):
        got = [tuple(r.values()) for b in hashing._streamed(table.to_batches(size), b"p") for r in b.to_pylist()]
        assert got == wanted


def test_rules_of_graphs(spark):
    s = world(spark)
    assert graph.validated(s.graph) is s.graph
    with pytest.raises(GraphError, match="unknown target"):
        graph.validated(world(spark, edges=[*EDGES, ("cart", "nowhere", "imports")]).graph)
    with pytest.raises(GraphError, match="repeated id"):
        graph.validated(world(spark, ids=(*IDS, "cart")).graph)
    with pytest.raises(GraphError, match="blank relation"):
        graph.validated(world(spark, edges=[*EDGES, ("cart", "maps", " ")]).graph)
    one = graph.absorbed(s.graph, s.graph)
    assert one.entities.count() == len(IDS) and one.edges.count() == len(EDGES)
    other = Graph(spark.createDataFrame([("cart", "else")], "id string, kind string"), s.graph.edges.limit(0))
    with pytest.raises(GraphError, match="both"):
        graph.absorbed(s.graph, other)
    with pytest.raises(GraphError, match="tokens"):
        delta.diff(Snapshot(s.graph), s)
