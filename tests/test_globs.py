import random
import re

import pytest
from pyspark.sql import functions as F

from ripplegraph.functions import paths
from ripplegraph.operators import globs

NAMES = ["a", "b", "ab", "a.go", "b.go", "x.tar.gz", ".go", "a[1]", "é*", "-"]
PIECES = ["a", "b", "*", "?", "*.go", "a*", "**", "[ab]", "[!a]", "{a,b}", "{a,b/c}", "a.go", "x.*.gz", r"a\[1\]", r"é\*", "[+-9]", "*.{go,gz}"]


def made(rng, parts, most):
    return "/".join(rng.choice(parts) for _ in range(rng.randint(1, most)))


def brute(files, patterns):
    expr = {g: re.compile(paths.glob_regex(g)[1:-1], re.DOTALL) for g in patterns}
    return {(f, g) for f in files for g in patterns if expr[g].fullmatch(f)}


@pytest.mark.parametrize("sent", [globs.SENT, 0])
def test_many_patterns_equal_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(globs, "SENT", sent)
    rng = random.Random(5)
    files = sorted({made(rng, NAMES, 4) for _ in range(300)}) + ["a\n", "a/b\nc.go"]
    patterns = sorted({made(rng, PIECES, 4) for _ in range(250)}) + ["**", "*", "a/**", "**/b.go"]
    rows = lambda x, name: spark.createDataFrame([(v, 0) for v in [*x, x[0], None]], f"{name} string, regex int")
    found = globs.matches(rows(files, "path"), rows(patterns, "pattern"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(files, patterns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert globs.matches(rows(files, "path").limit(0), rows(patterns, "pattern")).count() == 0 == globs.matches(rows(files, "path"), rows(patterns, "pattern").limit(0)).count()


def test_literals_hold_of_whatever_matches():
    rng = random.Random(9)
    for _ in range(4000):
        g, f = made(rng, PIECES, 4), made(rng, NAMES, 4)
        if re.fullmatch(paths.glob_regex(g)[1:-1], f, re.DOTALL):
            depth, heads, head, by, tail = paths.glob_literals(g)
            parts = f.split("/")
            assert depth in (-1, len(parts)) and head == "/".join(parts[:heads]) and heads <= len(parts), (g, f)
            assert by == "any" or tail == (parts[-1] if by == "name" else parts[-1].rpartition(".")[2]), (g, f)


def test_fileset_and_references(spark):
    objects = spark.createDataFrame([(p, "tree" if p in ("src", "src/[x]", "src/sub") else "blob") for p in ("src", "src/[x]", "src/sub", "src/a.go", "src/[x]/b.go", "src/x/c.go", "src/sub/d.txt", "top.go")], "path string, kind string")
    wanted = spark.createDataFrame([(1, "src", "*.go"), (2, "src/[x]", "*"), (3, "", "**/*.go"), (4, "src", "**"), (5, "src", "sub"), (6, None, "*"), (1, "src", "*.go")], "id int, dir string, pattern string")
    found = {}
    for r in globs.fileset(objects, wanted).collect():
        found.setdefault(r.id, []).append(r.name)
    assert {k: sorted(v) for k, v in found.items()} == {1: ["a.go"], 2: ["b.go"], 3: ["src/[x]/b.go", "src/a.go", "src/x/c.go", "top.go"], 4: ["[x]/b.go", "a.go", "sub/d.txt", "x/c.go"]}
    asked = spark.createDataFrame([(1, "src/x", "../*.go"), (2, "src", "//*.go"), (3, "src", "../../*"), (4, "src", "/x")], "id int, dir string, value string")
    assert sorted(map(tuple, globs.matches_from(objects.where("kind = 'blob'"), asked).collect())) == [(1, "src/a.go"), (2, "top.go")]
    with pytest.raises(Exception, match="bad pattern"):
        globs.matches(objects, spark.createDataFrame([("a[",)], "pattern string")).collect()


def test_files_read(spark):
    contents = spark.createDataFrame([("d/a.txt", bytearray("é\n".encode())), ("raw", bytearray(b"\xff\x00")), ("none", bytearray())], "path string, bytes binary")
    wanted = spark.createDataFrame([(1, "d/build.cfg", "a.txt"), (2, "d/build.cfg", "//raw"), (3, "d/build.cfg", "../none"), (4, "d/build.cfg", "b"), (5, "d/build.cfg", "../../x"), (6, "top.cfg", None)], "id int, file string, value string")
    got = {r.id: tuple(r)[1:] for r in globs.files_read(wanted, contents).collect()}
    assert got == {
        1: ("d/a.txt", True, "é\n", "w6kK", None), 2: ("raw", True, None, "/wA=", "not UTF-8"), 3: ("none", True, "", "", None),
        4: ("d/b", False, None, None, "not found"), 5: (None, False, None, None, "not a path"), 6: (None, False, None, None, "not a path"),
    }


def test_classes_never_match_a_slash(spark):
    row = spark.createDataFrame([("a/b", "a]b", "adb")], "s string, c string, d string")
    assert row.select(paths.glob_matches(F.col("s"), "a[!x]b"), paths.glob_matches(F.col("s"), "a[+-9]b"), paths.glob_matches(F.col("c"), r"a[x\]]b"), paths.glob_matches(F.col("d"), r"a\db")).first()[:] == (False, False, True, True)
