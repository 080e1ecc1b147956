import json

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import dependencies as deps


def value(df):
    return df.withColumn("value", F.parse_json("value"))


def texts(x, place=()):
    """All that isn't a list inside a value, with its place."""
    if not isinstance(x, list):
        return [(place, x)]
    return [row for k, y in enumerate(x) for row in texts(y, (*place, k))]


def test_unfolded_equals_a_slow_version(spark):
    values = {1: "a", 2: [], 3: ["a", ["b", [[["c"]], "d", []]]], 4: [None, 1, 1.5, True, {"k": ["x"]}, ["ü"]], 5: None, 6: [[[[]]]], 7: [""] * 50}
    df = value(spark.createDataFrame([(k, json.dumps(v)) for k, v in values.items()] + [(8, None)], "id int, value string"))
    got = {(r.id, tuple(r.place)): (r.text, r.problem) for r in deps.unfolded(df).collect()}
    judge = lambda x: (x, None) if isinstance(x, str) else (None, "null" if x is None else "neither a text nor a list")
    assert got == {(k, p): judge(x) for k, v in (values | {8: None}).items() for p, x in texts(v)}
    assert deps.unfolded(df.limit(0)).count() == 0


def test_dependencies(spark):
    targets = spark.createDataFrame([("t1", "a/build.cfg", "lint", "x"), ("t2", "b/build.cfg", "lint", "x"), ("t3", "a/build.cfg", "test", "y"), ("t4", "a/build.cfg", "test", "y")], "id string, file string, kind string, name string")
    entities = spark.createDataFrame([("go:package:m:cA", "go:package"), ("doc:1", "doc")], "id string, kind string")
    objects = spark.createDataFrame([("a", "tree"), ("a/build.cfg", "blob"), ("b", "tree"), ("b/build.cfg", "blob"), ("b/id:", "blob")], "path string, kind string")
    listed = ["target-name:lint.x", ["target-ref://b/build.cfg#lint.x", "target-ref:b/build.cfg#lint.x"], "target-name:test.y", "target-name:lint.z", "id:doc:1", "id:doc:2", "go:package:m:cA",
              "build.cfg", "path:../b", ".", "//", "..", "nope", "target-name:1.2", "../..", 3]
    df = value(spark.createDataFrame([("t", "a/build.cfg", json.dumps(listed))], "id string, file string, value string"))
    found = deps.dependencies(df, targets, entities, objects)
    got = {".".join(map(str, r.place)): (r.dst, r.problem) for r in found.collect()}
    assert got == {
        "0": ("t1", None), "1.0": ("t2", None), "1.1": ("t2", None), "2": (None, "declared twice"), "3": (None, "not declared"), "4": ("doc:1", None), "5": (None, "no such entity"), "6": ("go:package:m:cA", None),
        "7": ("git:a/build.cfg", None), "8": ("git:b", None), "9": ("git:a", None), "10": ("git:", None), "11": ("git:", None), "12": (None, "not found"), "13": (None, "not found"), "14": (None, "not found"), "15": (None, "neither a text nor a list"),
    }
    graph = deps.dependency_graph(found.where("problem is null"))
    assert graph.entities.count() == 8 and {r.kind for r in graph.edges.collect()} == {"depends-on"}
    with pytest.raises(Exception, match="something bad"):
        deps.dependency_graph(found).edges.collect()
