import re
import subprocess

import pytest
from pyspark.sql import functions as F

from ripplegraph.functions import config, paths, selectors
from ripplegraph.model import GraphError
from ripplegraph.operators.hashing import uvarint
from ripplegraph.plans import tree
from ripplegraph.plans.registry import Builder, Sensor
from ripplegraph.sources import git, modules


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_paths(spark):
    cases = {"a/b": "a/b", "a/./b/../c": "a/c", "a\\b": "a/b", "a//b/": "a/b", "": None, ".": None, "/a": None, "..": None, "../a": None, "a/..": None, "a/../../b": None}
    assert values(spark, paths.cleaned(F.col("p")), [(c,) for c in cases], "p string") == list(cases.values())
    cases = {"": "", ".": "", "a": "a", "..": None}
    assert values(spark, paths.tree(F.col("p")), [(c,) for c in cases], "p string") == list(cases.values())
    cases = [("a/b", "c", "a/b/c"), ("a/b", "../c", "a/c"), ("a", "//x/y", "x/y"), ("a", "/x", None), ("a", "", None), ("a", "../../x", None), ("", "x", "x")]
    assert values(spark, paths.resolved(F.col("b"), F.col("v")), cases, "b string, v string, w string") == [c[2] for c in cases]
    cases = [("a", "", "a"), ("a", ".", "a"), ("a", "//", ""), ("a", "..", ""), ("a/b", "../c", "a/c"), ("", "..", None)]
    assert values(spark, paths.resolved_tree(F.col("b"), F.col("v")), cases, "b string, v string, w string")[:5] == [c[2] for c in cases][:5]
    assert values(spark, paths.within(F.col("p"), F.col("d")), [("a/b", "a"), ("ab", "a"), ("a", "a"), ("x", "")], "p string, d string") == [True, False, True, True]
    assert values(spark, paths.relative(F.col("p"), F.col("d")), [("a/b", "a"), ("ab", "a"), ("a", "a"), ("x", "")], "p string, d string") == ["b", None, "", "x"]
    assert values(spark, paths.ancestors(F.col("p")), [("a/b/c",), ("a",)], "p string") == [["", "a", "a/b"], [""]]


def test_globs(spark):
    cases = [
        ("*.go", "a.go", True), ("*.go", "d/a.go", False), ("**/*.go", "d/e/a.go", True), ("**/*.go", "a.go", True), ("d/**", "d/e/f", True), ("d/**", "d", True), ("d/**", "de", False),
        ("a?c", "abc", True), ("a?c", "a/c", False), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("{a,b}/*", "b/z", True), ("a.b", "axb", False), ("a\\*", "a*", True), ("**", "x/y", True),
    ]
    for pattern, path, hit in cases:
        assert bool(re.fullmatch(paths.glob_regex(pattern)[1:-1], path)) is hit, (pattern, path)
        assert values(spark, paths.glob_matches(F.col("p"), pattern), [(path,)], "p string") == [hit]
    for bad in ("[a", "{a", "a\\"):
        with pytest.raises(ValueError, match="bad pattern"):
            paths.glob_regex(bad)


TARGETS = [
    ("1", "", "test", "go", 0, "", []), ("2", "detector", "test", "go", 0, "unit", []), ("3", "detector/sub", "lint", "", 1, "", ["go_lint"]), ("4", "cmd", "test", "py", 1, "slow", []),
    ("5", "cmd", "lint", "", 0, "", []),
]


def test_selectors(spark):
    t = spark.createDataFrame(TARGETS, "id string, path string, kind string, name string, index int, label string, more array<string>")
    for text, cwd, want in [
        ("//#test.go", "", "1"), ("//detector#test.go", "cmd", "2"), ("detector#test.0", "", "2"), ("..#test.go", "detector", "1"), ("test.py", "", "4"), ("test.1", "", "4"), ("go_lint", "", "3"),
        ("test", "cmd", "4"), ("lint", "detector", "3"), ("slow", "", "4"), ("sub#lint", "detector", "3"), ("test.go", "detector", "2"), ("../detector#test", "cmd", "2"),
    ]:
        assert selectors.resolve_one(t, text, cwd) == want, (text, cwd)
    for text, cwd in [("nothing", ""), ("//cmd#test.go", ""), ("../../x#test", "cmd"), ("cmd#slow", ""), ("#", "")]:
        with pytest.raises(selectors.NoMatch):
            selectors.resolve_one(t, text, cwd)
    with pytest.raises(selectors.Ambiguous, match="//cmd#lint, //detector/sub#lint"):
        selectors.resolve_one(t, "lint", "")
    assert {r.text for r in selectors.completions(t, "te", "cmd").collect()} == {"test.py"}
    assert {r.text for r in selectors.completions(t, "//det").collect()} == {"//detector#test.go", "//detector/sub#lint"}
    with pytest.raises(GraphError):
        selectors.completions(t, "../x")


def test_config_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()[0]
    s = lambda *x: F.array(*map(F.lit, x))
    assert get(config.chunklist(s(1, 2, 3, 4, 5), 2)) == [[1, 2], [3, 4], [5]]
    assert get(config.chomp(F.lit("a\n\r\n"))) == "a" and get(config.title(F.lit("hELLO wORLD"))) == "HELLO WORLD"
    assert get(config.element(s("a", "b", "c"), F.lit(4))) == "b" and get(config.compact(s("", "a"))) == ["a"]
    assert get(config.range_(F.lit(3))) == [0, 1, 2] and get(config.range_(F.lit(0))) == []
    assert get(config.parseint(F.lit("ff"), 16)) == 255 and get(config.substr(F.lit("hello"), 1, 2)) == "el" and get(config.substr(F.lit("hello"), -3, -1)) == "llo"
    assert get(config.trim(F.lit("??a?"), "?")) == "a" and get(config.trimprefix(F.lit("ab"), "a")) == "b" and get(config.trimsuffix(F.lit("ab"), "b")) == "a"
    assert get(config.cidrhost(F.lit("10.0.0.0/24"), 5)) == "10.0.0.5" and get(config.cidrnetmask(F.lit("10.0.0.0/20"))) == "255.255.240.0"
    assert get(config.cidrsubnet(F.lit("10.0.0.0/16"), 8, 2)) == "10.0.2.0/24"
    assert get(config.base64encode(F.lit("x" * 90))).count("\n") == 0 and get(config.indent(2, F.lit("a\nb"))) == "a\n  b"
    assert get(config.dirname(F.lit("a/b/c"))) == "a/b" and get(config.dirname(F.lit("a"))) == "." and get(config.split(".", F.lit("a.b"))) == ["a", "b"]
    m = F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))
    assert get(config.keys(m)) == ["a", "b"] and get(config.values(m)) == [2, 1] and get(config.merge(m, F.create_map(F.lit("a"), F.lit(9)))) == {"b": 1, "a": 9}
    assert [r[0] for r in spark.createDataFrame([(n,) for n in (0, 127, 128, 300, 16384, 2097152)], "n long").select(F.hex(uvarint(F.col("n")))).collect()] == ["00", "7F", "8001", "AC02", "808001", "80808001"]


def test_git_objects(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.go").write_text("package pkg\n")
    (tmp_path / "README ü.md").write_text("read me\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    objects = git.revision(spark, str(tmp_path), "HEAD").cache()
    assert {(r.path, r.kind) for r in objects.collect()} == {("pkg", "tree"), ("pkg/a.go", "blob"), ("README ü.md", "blob")}
    read = git.contents(spark, str(tmp_path), "HEAD", ["pkg/a.go"])
    assert read.select(git.blob_id(F.col("bytes"))).first()[0] == run("hash-object", "pkg/a.go")
    assert not git.is_dirty(str(tmp_path))
    edits = spark.createDataFrame([("new/x/y.txt", bytearray(b"hi"))], "path string, bytes binary")
    after = {r.path: r for r in git.overlaid(objects, edits, spark.createDataFrame([("pkg",)], "path string")).collect()}
    assert set(after) == {"README ü.md", "new", "new/x", "new/x/y.txt"} and after["new"].source == "worktree" and after["new"].oid == "0" * 40
    graph = git.object_graph(objects)
    assert ("git:pkg", "git:pkg/a.go", "contains") in {tuple(r) for r in graph.edges.collect()}
    assert git.object_tokens(objects).where("id = 'git:pkg'").first().token.startswith("git-tree:")
    assert [r.line for r in tree.tree_lines(graph, "git:").orderBy("place").collect()] == [".", "├── README ü.md", "└── pkg/", "    └── a.go"]
    with pytest.raises(Exception, match="bad listing line"):
        git.parsed_listing(spark.createDataFrame([("160000 commit " + "a" * 40 + "\tsub",)], "value string")).collect()


WEATHER = {
    "station/go.mod": "module weather.test/station\n\ngo 1.22 // since spring\ntoolchain local\nrequire probe.test/io v0.4.1\nrequire (\n\tprobe.test/io/serial/v3 v3.0.2\n)\nreplace probe.test/io v0.4.1 => mirror.test/io v0.4.9\n",
    "station/gauge/rain.go": 'package gauge\n\nimport "sync"\nimport wire "probe.test/io/serial/v3/port"\n',
    "station/gauge/wind.go": "package gauge\n",
    "station/gauge/wind_test.go": 'package gauge\n\nimport ("testing"; "weather.test/station/report")\n',
    "station/report/report.go": '// Package report prints.\npackage report\n\nimport (\n\t"C"\n\t. "weather.test/station/gauge"\n\t"probe.test/io"\n)\n',
    "loose/alone.go": "package alone\n",
}


def test_packages(spark):
    files = spark.createDataFrame(list(WEATHER.items()), "path string, text string")
    mod = modules.modules(files).first()
    assert (mod.dir, mod.module, mod.go, mod.toolchain) == ("station", "weather.test/station", "1.22", None)
    assert [tuple(r) for r in mod.requires] == [("probe.test/io", "v0.4.1"), ("probe.test/io/serial/v3", "v3.0.2")] and tuple(mod.replaces[0]) == ("probe.test/io", "v0.4.1", "mirror.test/io", "v0.4.9")
    found = {}
    for r in modules.imports(files).collect():
        found.setdefault(r.path.rpartition("/")[2], set()).add(r.target)
    assert found == {
        "rain.go": {"sync", "probe.test/io/serial/v3/port"}, "wind.go": {None}, "wind_test.go": {"testing", "weather.test/station/report"},
        "report.go": {"weather.test/station/gauge", "probe.test/io"}, "alone.go": {None},
    }
    g = modules.package_graph(files)
    count = lambda rows: {k: sum(r.kind == k for r in rows) for k in {r.kind for r in rows}}
    assert count(g.entities.collect()) == {"go:package": 2, "go:package-test": 1, "go:package-stdlib": 2, "go:package-external": 2, "go:go-version": 1}
    assert count(g.edges.collect()) == {"imports": 6, "source-file": 4, "tests": 1, "go-version": 7}
    assert count(modules.package_graph(files, attached=True).edges.collect())["contains"] == 3
    assert {r.token for r in modules.package_tokens(files, g).collect()} == {"go-version:go=1.22", "go-module:mirror.test/io@v0.4.9", "go-module:probe.test/io/serial/v3@v3.0.2"}


def local_imports(spark, files):
    """For each import of each source: the package's directory and module directory, if it is a local one."""
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    mods, found = modules.modules(df), modules.imports(df)
    owned = modules.owners(found, mods)
    packages = found.join(owned, "dir").select("dir", "module_dir").distinct()
    wanted = found.where("target is not null").join(owned, "dir").select("mod_path", "target")
    return {(r.mod_path, r.target): (r.to_dir, r.to_module_dir) for r in modules.resolved_imports(wanted, mods, packages).collect()}


def test_imports_are_resolved_in_order(spark):
    files = {
        "go.mod": "module m\n\nreplace (\n\tq => ./lost\n\tq/z => ./own\n\tr v1.0.0 => ../up\n)\n", "own/own.go": "package own\n", "in/deep/d.go": "package d\n",
        "main.go": 'package main\nimport (\n\t"m/own"\n\t"m/in/deep"\n\t"q/z"\n\t"q/own"\n\t"r/x"\n\t"n/sub/p"\n\t"n/sub"\n\t"m"\n\t"mm/own"\n)\n',
        "in/go.mod": "module m\nreplace w => ../../outside\n", "in/own/o.go": 'package own\nimport "m/own"\nimport "m/main"\nimport "w/x"\n', "n1/go.mod": "module n", "n1/sub/p/p.go": "package p\n", "n1/sub/s.go": "package sub\n",
        "n22/go.mod": "module n/sub\n", "n22/p/p.go": "package p\n",
    }
    assert local_imports(spark, files) == {
        ("go.mod", "m/own"): ("own", ""),  # the own module, though a deeper one has its name
        ("go.mod", "m"): ("", ""),
        ("go.mod", "q/z"): ("own", ""),  # the first replacement leads nowhere, the second does
        ("go.mod", "n/sub/p"): ("n22/p", "n22"),  # the longest name
        ("in/go.mod", "m/own"): ("in/own", "in"),
    }


def test_replaced_and_missing_versions_are_problems(spark):
    files = spark.createDataFrame([("a/go.mod", "module a\nrequire b.org/x v1.0.0\nreplace b.org/x/y => ../none\nreplace b.org/x => c.org/x v2.0.0\nreplace b.org/x => d.org/x v3.0.0\n")], "path string, text string")
    mods, wanted = modules.modules(files), spark.createDataFrame([("a/go.mod", t) for t in ("b.org/x/z", "b.org/x/y/k", "b.org/xx")], "mod_path string, target string")
    found = {r.target: (r.token, r.problem) for r in modules.version_tokens(mods, wanted).collect()}
    assert found == {"b.org/x/z": ("go-module:d.org/x@v3.0.0", None), "b.org/x/y/k": (None, "replaced by a path without a package"), "b.org/xx": (None, "not required")}
    with pytest.raises(Exception, match="not required"):
        modules.version_tokens(mods, wanted.where("target = 'b.org/xx'"), strict=True).collect()


def test_numbers_dates_and_formats(spark):
    number = lambda x, base: values(spark, config.parseint(F.col("x"), base), [(x,)], "x string")[0]
    assert (number("-5", 10), number("ff", 16), number("-Zz", 36), number("0", 2), number(None, 10)) == (-5, 255, -1295, 0, None)
    for bad, base in (("zz", 10), ("", 10), ("12", 2), ("1.5", 10)):
        with pytest.raises(Exception, match="not a number"):
            number(bad, base)
    at = lambda i: values(spark, config.index(F.col("a"), F.lit(i)), [(["x", "y"],)], "a array<string>")[0]
    assert (at(0), at(1)) == ("x", "y")
    for bad in (-1, 2):
        with pytest.raises(Exception, match="negative index|INVALID_ARRAY_INDEX"):
            at(bad)
    text = lambda c: values(spark, c, [(7, 2.0, "a\"b", True)], "n int, d double, s string, t boolean")[0]
    assert text(config.format_("%v %v %v %q %t %%", *map(F.col, ("n", "d", "s", "s", "t")))) == '7 2 a"b "a\\"b" true %'
    assert text(config.format_("[%4d|%-4d|%03d|%x|%b|%.1f|%5s]", *map(F.col, ("n", "n", "n", "n", "n", "d", "t")))) == "[   7|7   |007|7|111|2.0| true]"
    for bad in ("%d %d", "%y", "x"):
        with pytest.raises(ValueError, match="verb"):
            config.format_(bad, F.col("n"))
    day = lambda layout: values(spark, config.formatdate(layout, F.col("x")), [("2024-03-05T14:07:09Z",)], "x string")[0]
    assert day("DD MMM YYYY") == "05 Mar 2024" and day("EEEE, D MMMM YY 'at' h:mm aa ZZZ") == "Tuesday, 5 March 24 at 2:07 pm UTC" and day("YYYY-MM-DD'T'HH:mm:ssZ") == "2024-03-05T14:07:09Z"
    with pytest.raises(ValueError, match="date token"):
        day("DDD")
    later = lambda d: values(spark, F.date_format(config.timeadd(F.col("x"), d), "HH:mm:ss.SSS"), [("2024-03-05T14:07:09Z",)], "x string")[0]
    assert (later("1h30m"), later("-10s"), later("1.5ms"), later("0")) == ("15:37:09.000", "14:06:59.000", "14:07:09.001", "14:07:09.000")
    with pytest.raises(ValueError, match="duration"):
        later("10")
    df = spark.createDataFrame([([[["a"], ["b"]], [["c"]]],)], "x array<array<array<string>>>")
    assert df.select(config.flatten(F.col("x"), config.nesting(df.schema["x"].dataType))).first()[0] == ["a", "b", "c"]


def test_scanner(spark):
    files = spark.createDataFrame(list(WEATHER.items()), "path string, text string")
    objects = files.select("path", F.lit("blob").alias("kind"), git.blob_id(F.col("text").cast("binary")).alias("oid"), F.lit("git").alias("source"))
    tree = Sensor("git", lambda _: git.object_graph(git.with_trees(objects)), lambda _: git.object_tokens(objects), ("contains",))
    go = Sensor("go", lambda _: modules.package_graph(files), lambda _: files.limit(0).select(F.col("path").alias("id"), F.col("text").alias("token")), ("imports", "source-file", "tests", "go-version"), decode=lambda i: ":".join(i.split(":")[:2]))
    scanner = Builder().attach(go).attach(tree).compile()
    assert [s.namespace for s in scanner.sensors] == ["git", "go"] and scanner.decode("go:package:go.mod:eA") == "go:package"
    snapshot = scanner.capture(None)
    assert snapshot.tokens.count() == 6 and "tests" in snapshot.followed
    for bad in (Sensor("go", decode=str), Sensor("", decode=str), Sensor("x"), Sensor("x", followed=("a",))):
        with pytest.raises(GraphError):
            Builder().attach(go).attach(bad)
    for name in ("locals", "1x", "kind"):
        with pytest.raises(GraphError):
            Builder().attach_setting("kind", dict).attach_kind(name, dict)
    wrong = Sensor("z", tokens=lambda _: spark.createDataFrame([("git:x", "t")], "id string, token string"), followed=("a",))
    with pytest.raises(Exception, match="z gave a token"):
        Builder().attach(wrong).compile().tokens(None).collect()
