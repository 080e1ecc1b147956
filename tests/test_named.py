from pyspark.sql import functions as F

from ripplegraph.functions import paths
from ripplegraph.operators import dependencies
from ripplegraph.sources import git, modules


def packages(spark, texts, asked):
    files = spark.createDataFrame([(p, t) for p, t in texts.items()], "path string, text string")
    objects = git.with_trees(files.select("path", F.lit("blob").alias("kind"), F.lit("1" * 40).alias("oid"), F.lit("stored").alias("source")))
    wanted = spark.createDataFrame([(k, *row) for k, row in enumerate(asked)], "id long, file string, value string, kind string").withColumn("dst", F.lit(0))
    rows = modules.named_packages(wanted, objects, modules.modules(files)).withColumn("x", modules.id_parts(F.col("dst"))).orderBy("id").collect()
    return [(r.x.mod_path, r.x.name) if r.dst else r.problem for r in rows]


def test_packages_by_tree_place_and_import_path(spark):
    texts = {
        "go.mod": "module r.test\n", "top.go": "", "tools/go.mod": "module r.test/tools\n", "tools/gen/a.go": "", "tools/gen/b_test.go": "", "only/c_test.go": "", "docs/x.md": "",
        "tools/only/d.go": "", "back\\slash/e.go": "",
    }
    gen, top = ("tools/go.mod", "r.test/tools/gen"), ("go.mod", "r.test")
    cases = [
        ("cfg", "tools/gen", "package", gen), ("tools/cfg", "gen", "package-test", gen), ("docs/cfg", "../tools/./gen", "package", gen), ("docs/cfg", "r.test/tools/gen", "package", gen),
        ("cfg", "", "package", top), ("docs/cfg", "..", "package", "not found"), ("docs/cfg", "r.test", "package", top), ("docs/cfg", "r.test/", "package", top), ("cfg", "docs", "package", "no sources"),
        ("cfg", "only", "package", ("go.mod", "r.test/only")), ("tools/cfg", "only", "package-test", ("go.mod", "r.test/only")), ("tools/cfg", "tools/only", "package-test", "no test sources"),
        ("cfg", "a.go", "package", "a source, not a package"), ("cfg", "r.tests/x", "package", "not found"), ("cfg", "r.test/none", "package", "not found"), ("cfg", "../x", "package", "not found"),
        ("cfg", "/tools", "package", "not found"), ("docs/cfg", "/../tools/gen", "package", gen), ("cfg", "tools\\gen", "package", "not found"), ("cfg", None, "package", "not found"), (None, "tools", "package", "not found"),
        ("cfg", "docs", "module", "not a kind of package"), ("cfg", "docs", None, "not a kind of package"), ("cfg", "x" * 100_000, "package", "not found"),
    ]
    assert packages(spark, texts, [c[:3] for c in cases]) == [c[3] for c in cases]
    assert packages(spark, {"a/b.go": ""}, [("a/cfg", "a", "package")]) == ["not found"] and packages(spark, texts, []) == []


def test_two_modules_of_one_name(spark):
    texts = {"b/go.mod": "module m.test\n", "b/x/p.go": "", "c/go.mod": "module m.test\n", "c/x/p.go": "", "a/go.mod": "module m.test/x\n", "a/p.go": "", "d/go.mod": "module m.test/y\n", "d/p.go": ""}
    asked = [("cfg", "m.test/z", "package"), ("cfg", "m.test/x", "package"), ("cfg", "m.test/y", "package"), ("cfg", "c/x", "package")]
    assert packages(spark, texts, asked) == ["in two modules", ("a/go.mod", "m.test/x"), "in two modules", ("c/go.mod", "m.test/x")]


def test_target_values(spark):
    targets = spark.createDataFrame([("a/b/t.cfg", "lint", "x"), ("a/b/t.cfg", "lint", "x"), ("root.cfg", "lint", "é-1")], "file string, kind string, name string")
    cases = [
        ("", "lint.x", "target-ref:a/b/t.cfg#lint.x"), (".", "lint.x", "target-ref:a/b/t.cfg#lint.x"), ("//", "lint.é-1", "target-ref:root.cfg#lint.é-1"), ("../..", "lint.é-1", "target-ref:root.cfg#lint.é-1"),
        ("//a/b", "lint.x", "target-ref:a/b/t.cfg#lint.x"), ("../../..", "lint.x", "not a path"), ("/a", "lint.x", "not a path"), ("", "lint", "not a kind and a name"), ("", "lint.x.y", "not a kind and a name"),
        ("", "lint.1", "not a kind and a name"), ("..", "lint.x", "not declared"), (None, "lint.x", "not a path"), ("", None, "not a kind and a name"),
    ]
    wanted = spark.createDataFrame([(k, "a/b/t.cfg", c[0], c[1]) for k, c in enumerate(cases)], "id long, file string, path string, name string")
    assert [r.value or r.problem for r in dependencies.target_values(wanted, targets, "t.cfg", "root.cfg").orderBy("id").collect()] == [c[2] for c in cases]
    told = spark.createDataFrame([("target-ref:a/b/t.cfg#lint.x",)], "v string").select(dependencies.told_apart(F.col("v")).alias("x")).first().x
    assert (told.what, told.file, told.kind, told.name) == ("target", "a/b/t.cfg", "lint", "x")


def test_bound(spark):
    row = spark.createDataFrame([(2, None)], "a int, b string").select(paths.bound(F.col("a") + 1, lambda x: x * x).alias("x"), paths.bound(F.col("b"), lambda x: x.isNull()).alias("y")).first()
    assert (row.x, row.y) == (9, True)
