import pytest

from ripplegraph.model import Graph, GraphError, Snapshot
from ripplegraph.operators import graph as graphs
from ripplegraph.operators import delta, targets
from ripplegraph.plans import tree
from ripplegraph.sources import git, modules

FILES = {
    "go.mod": "module farm.test/hq\n\ngo 1.21\n\nrequire seeds.test/corn v1.4.0\n",
    "barn/barn.go": 'package barn\n\nimport (\n\t"os"\n\t"farm.test/hq/barn/stall"\n\t"seeds.test/corn/kernel"\n)\n',
    "barn/barn_test.go": 'package barn\n\nimport "testing"\n',
    "barn/stall/stall.go": "package stall\n",
    "barn/make.cfg": "",
    "yard.txt": "grass",
    "make.cfg": "",
}
DECLARED = [("barn/make.cfg", "barn", "feed", "hay", 0), ("make.cfg", "", "feed", "", 0), ("make.cfg", "", "wash", "all", 0)]
NEEDS = [("target:wash:make.cfg:all", "target:feed:barn/make.cfg:hay"), ("target:wash:make.cfg:all", "git:yard.txt"), ("target:wash:make.cfg:all", "git:barn"), ("target:feed:barn/make.cfg:hay", "BARN")]


def snapshot(spark, files):
    table = spark.createDataFrame(list(files.items()), "path string, text string")
    objects = git.with_trees(table.selectExpr("path", "'blob' AS kind", "sha1(text) AS oid", "'git' AS source"))
    packages = modules.package_graph(table, attached=True)
    declared = spark.createDataFrame(DECLARED, "file string, path string, kind string, name string, index int")
    declared = declared.select("*", targets.target_id(*(declared[c] for c in ("kind", "file", "name", "index"))).alias("id"))
    barn = next(r.id for r in packages.entities.where("kind = 'go:package'").select("id", modules.id_parts(packages.entities.id).alias("p")).collect() if r.p.name.endswith("/barn"))
    needs = spark.createDataFrame([(a, b.replace("BARN", barn), "depends-on") for a, b in NEEDS], "src string, dst string, kind string")
    g = graphs.absorbed(git.object_graph(objects), packages, targets.projected(declared), Graph(packages.entities.limit(0), needs))
    return delta.materialised(Snapshot(g, git.object_tokens(objects).union(modules.package_tokens(table, packages)), ("contains", "depends-on", "imports", "source-file", "tests", "go-version")))


def printed(df):
    return "\n".join(r.line for r in df.orderBy("place").collect())


PLAIN = """.
├── barn/
│   ├── barn.go
│   ├── barn_test.go
│   ├── make.cfg
│   ├── stall/
│   │   ├── stall.go
│   │   └── go package farm.test/hq/barn/stall
│   ├── go package-test farm.test/hq/barn
│   ├── go package farm.test/hq/barn
│   │   └── import farm.test/hq/barn/stall
│   └── feed target:feed:barn/make.cfg:hay
│       └── go package farm.test/hq/barn
│           └── import farm.test/hq/barn/stall
├── go.mod
├── make.cfg
├── yard.txt
├── feed target:feed:make.cfg:0
└── wash target:wash:make.cfg:all
    ├── git:barn
    ├── yard.txt
    └── feed hay"""
FULL = """    ├── stall/ *
    │   ├── stall.go *
    │   └── go package farm.test/hq/barn/stall *
    │       ├── go version go=1.21 *
    │       └── file stall.go
    ├── go package-test farm.test/hq/barn *
    │   ├── go version go=1.21 *
    │   ├── file barn_test.go
    │   └── std import testing
    ├── go package farm.test/hq/barn *
    │   ├── go version go=1.21 *
    │   ├── file barn.go
    │   ├── import farm.test/hq/barn/stall
    │   ├── std import os
    │   └── external import seeds.test/corn/kernel (seeds.test/corn@v1.4.0)"""


def test_every_kind_of_node(spark):
    s = snapshot(spark, FILES)
    assert printed(tree.tree_lines(s.graph, "git:")) == PLAIN
    assert printed(tree.tree_lines(s.graph, "git:barn/stall")) == ".\n├── stall.go\n└── go package farm.test/hq/barn/stall"
    marks = s.graph.entities.selectExpr("id", "'*' AS label")
    full = printed(tree.tree_lines(s.graph, "git:", tokens=s.tokens, labels=marks, files=True, external=True, versions=True))
    indented = FULL.replace("\n    ", "\n│   ").removeprefix("    ")
    assert "│   " + indented in full
    assert "(seeds" not in printed(tree.tree_lines(s.graph, "git:", tokens=s.tokens, external=True))
    with pytest.raises(Exception, match="no label of"):
        tree.tree_lines(s.graph, "git:", labels=marks.where("id <> 'git:yard.txt'")).collect()
    with pytest.raises(GraphError, match="no entity"):
        tree.tree_lines(s.graph, "git:none")
    assert tree.tree_lines(s.graph, "git:none", complete=s.graph).collect() == []


def test_selectors_name_targets_and_end_other_entities(spark):
    s = snapshot(spark, FILES)
    known = s.graph.entities.where("kind like 'target:%' or kind = 'go:package-test' or id = 'git:barn/stall'").selectExpr("id", "concat('//', left(id, 8)) AS selector")
    text = printed(tree.tree_lines(s.graph, "git:", selectors=known))
    assert "│   ├── //git:barn\n│   ├── //go:packa\n│   ├── go package farm.test/hq/barn\n" in text
    assert text.endswith("└── //target:w\n    ├── git:barn\n    ├── yard.txt\n    └── feed hay")


def test_a_node_with_two_parents_is_laid_out_below_each(spark):
    rows = [("git:", "git:a"), ("git:", "git:b"), ("git:a", "git:c"), ("git:b", "git:c"), ("git:c", "git:d"), ("git:d", "git:c")]
    kinds = [("git:", "git:tree"), ("git:a", "git:tree"), ("git:b", "git:tree"), ("git:c", "git:tree"), ("git:d", "git:tree"), ("git:e", "other")]
    g = Graph(spark.createDataFrame(kinds, "id string, kind string"), spark.createDataFrame([(*r, "contains") for r in [*rows, ("git:", "git:e")]], "src string, dst string, kind string"))
    assert printed(tree.tree_lines(g, "git:")) == ".\n├── a/\n│   └── c/\n│       └── d/\n└── b/\n    └── c/\n        └── d/"


EDIT = """.
├── barn/
│   ├── make.cfg
│   ├── stall/
│   │   ├── stall.go
│   │   └── go package farm.test/hq/barn/stall
│   ├── go package-test farm.test/hq/barn
│   ├── go package farm.test/hq/barn
│   │   └── import farm.test/hq/barn/stall
│   └── feed target:feed:barn/make.cfg:hay
│       └── go package farm.test/hq/barn
│           └── import farm.test/hq/barn/stall
├── make.cfg
├── new.txt
└── wash target:wash:make.cfg:all
    ├── git:barn
    └── feed hay"""


def test_cone_of_an_edit(spark):
    base = snapshot(spark, FILES)
    edited = snapshot(spark, FILES | {"barn/stall/stall.go": "package stall // wider\n", "new.txt": "new"})
    assert printed(tree.cone_lines(base, edited, "git:")) == EDIT
    lines = printed(tree.cone_lines(base, edited, "git:", labels=True)).splitlines()
    assert [x for x in lines if x.endswith(" new")] == ["├── new.txt new"]
    assert all(".." in x for x in lines[1:] if "import" not in x and "new.txt" not in x and "git:barn" not in x and "feed hay" not in x)
    assert tree.cone_lines(base, base, "git:").collect() == []
    gone = snapshot(spark, {k: v for k, v in FILES.items() if k != "yard.txt"} | {"make.cfg": ""})
    assert "yard.txt" not in printed(tree.cone_lines(base, gone, "git:barn"))


def test_local_imports_are_judged_by_the_complete_graph(spark):
    s = snapshot(spark, FILES)
    ids = s.graph.entities.where("kind in ('git:tree', 'go:package')")
    part = graphs.induced(s.graph, ids)
    none = Graph(s.graph.entities, s.graph.edges.where("kind not in ('contains', 'source-file')"))
    lines = lambda complete: {r.line for r in tree.package_lines(part, complete=complete).collect()}
    assert lines(s.graph) == {"import farm.test/hq/barn/stall"} and lines(none) == set()


def test_config_rows_and_places(spark):
    rows = [("d/f", "lint", "", 0, "a", 1), ("d/f", "lint", "", 1, "b", 2), ("d/f", "lint", "x", 2, "c", 3), ("e/f", "test", "x", 0, "d", 1)]
    t = spark.createDataFrame(rows, "file string, kind string, name string, index int, id string, line int")
    settings = spark.createDataFrame([("d/f", "shell"), ("d/f", "shell")], "file string, name string")
    assert {tuple(r) for r in targets.config_rows(t, settings).collect()} == {("//d/f#lint.0", "a"), ("//d/f#lint.1", "b"), ("//d/f#lint.x", "c"), ("//e/f#test.x", "d"), ("//d/f#shell", None)}
    assert targets.config_rows(t, settings).count() == 5
    assert sorted(map(tuple, targets.by_kind(t).collect())) == [("lint", 0, "a"), ("lint", 1, "b"), ("lint", 2, "c"), ("test", 0, "d")]
    assert sorted(map(tuple, targets.in_file(t).collect())) == [("a", 0, True), ("b", 1, True), ("c", 2, False), ("d", 0, False)]
    assert targets.reserved_keys(spark.createDataFrame([("a", "kind"), ("a", "shell"), ("b", "id")], "id string, key string")).count() == 2
