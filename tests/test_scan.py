import random

import pytest
from pyspark.sql import functions as F

from ripplegraph.sources import modules, scan

GO = {
    'package p\n// globs like a/* are fine\nimport "x.org/y"\n/* tail */': ["x.org/y"],
    'package p; import "b.org/z"; import "b.org/w"': ["b.org/z", "b.org/w"],
    'package p\nimport ("c.org/a"; "c.org/b")': ["c.org/a", "c.org/b"],
    "package p\nimport `raw.org/x`\nimport . \"dot.org/y\"\nimport _ \"blank.org/z\"": ["raw.org/x", "dot.org/y", "blank.org/z"],
    'package p\nimport (\n)\nimport ()\nimport "a"': ["a"],
    'package p // x\n/* many\nlines */ import /* here */ name /* too */ "a" // end\nvar s = `import "no"`': ["a"],
    'package p\nimport "a"\nfunc f() {}\nimport "late"': ["a"],
    "// Copyright\n\n/*\npackage not\n*/\npackage p": [],
    '﻿package p\r\nimport "a"\r\n': ["a"],
    'package p\nimport "C"\nimport "a"\nimport "a"': ["C", "a"],
    'package p\nimport "a\\x62\\u0063\\144\\"e"': ['abcd"e'],
    'package p\nimport "http://x"': ["http://x"],
    'package p\nconst c = "import"\n': [],
    'package p\nimport (\n\tä "ü.org/x" // why\n\n\t/* and */ "b"\n)': ["ü.org/x", "b"],
}
BAD_GO = ["", "import \"a\"", "package p\nimport \"unterminated\n", "package p\nimport `open", "package p\nimport (\"a\" \"b\")", "package p\nimport (\"a\"", "package p\n/* open\nimport \"a\"", "package p import \"a\"", "package p\nimport \"\"", "package p\nimport x\ny \"a\""]


@pytest.mark.parametrize("text", GO)
def test_imports(text):
    assert scan.go_imports(text) == GO[text]


@pytest.mark.parametrize("text", BAD_GO)
def test_sources_that_break_the_rules(text):
    with pytest.raises(scan.Wrong):
        scan.go_imports(text)


def slow_imports(text):
    """Character by character: comments and literals are told apart, then the grammar is followed."""
    tokens, i, n = [], 0, len(text)
    while i < n:
        if text.startswith("//", i):
            while i < n and text[i] != "\n":
                i += 1
        elif text.startswith("/*", i):
            j = text.index("*/", i + 2)
            tokens += [";"] * ("\n" in text[i:j])
            i = j + 2
        elif text[i] in '"`':
            j = text.index(text[i], i + 1)
            tokens.append(("s", text[i + 1 : j]))
            i = j + 1
        elif text[i] in "\n;":
            tokens.append(";")
            i += 1
        elif text[i] in " \t":
            i += 1
        elif text[i] in "().{}=":
            tokens.append(text[i])
            i += 1
        else:
            j = i
            while j < n and text[j] not in ' \t\n;().{}="`/':
                j += 1
            tokens.append(text[i:j])
            i = j
    out, inside, k = [], False, tokens.index("package") + 2
    while k < len(tokens):
        t = tokens[k]
        if t == ";" or (inside and (t in (".", "_", "n"))):
            pass
        elif isinstance(t, tuple) and inside:
            out.append(t[1])
        elif t == "import":
            if tokens[k + 1] == "(":
                inside, k = True, k + 1
            else:
                k += 1 if isinstance(tokens[k + 1], tuple) else 2
                out.append(tokens[k][1])
        elif t == ")" and inside:
            inside = False
        else:
            break
        k += 1
    return list(dict.fromkeys(out))


def test_random_sources_equal_a_slow_reader():
    rng = random.Random(4)
    junk = ["", " ", "\t", "/* c */", '/* "q" */', "/* // */"]
    ends = ["\n", ";", " // x\n", "/*\n*/", " /* */ ;", "\n// a/* b\n", '\n// "q"\n', "\n\n"]
    path = lambda: rng.choice(['"a.org/%d"', "`b.org/%d`", '"c/*%d"', '"d//%d"']) % rng.randrange(6)
    name = lambda: rng.choice(["", "", "n ", "_ ", ". ", "n/**/"])
    for _ in range(2000):
        text = rng.choice(["", "// x\n", "/* package q */"]) + "package p" + rng.choice(ends)
        for _ in range(rng.randrange(4)):
            if rng.random() < 0.5:
                text += rng.choice(junk) + "import " + rng.choice(junk) + name() + path() + rng.choice(ends)
            else:
                text += "import" + rng.choice(junk) + "(" + rng.choice(["", "\n"])
                text += "".join(rng.choice(junk) + name() + path() + rng.choice(ends) for _ in range(rng.randrange(3))) + ")" + rng.choice(ends)
        text += rng.choice(["", "func f() { import }", 'var x = "import"', "type T struct{}"])
        assert scan.go_imports(text) == slow_imports(text), text


def test_time_in_proportion_to_the_text():
    for part in ("/*", "/* */", '"', "`", "import (\n", '"a"\n', "x ", "\n", "//"):
        for head in ("package p\n", "package p\nimport (\n"):
            try:
                scan.go_imports(head + part * 100_000)
            except scan.Wrong:
                pass
        try:
            scan.module_file("module m\n" + part * 100_000)
        except scan.Wrong:
            pass


MODULE = """// a module
module "quoted.org/m" // and why
go 1.21
toolchain go1.22.1

require `raw.org/a` v1.2.3 // indirect
require (
\tb.org/b v0.0.0-2020 // indirect

\t"c.org/c" v2.0.0+incompatible
)
replace b.org/b => ../b
replace (
\tc.org/c v2.0.0+incompatible => d.org/d v1.0.0
\t`raw.org/a` => e.org//comment
)
exclude x.org/x v1.0.0
retract [v1.0.0, v1.1.0] // bad
require ()
"""


def test_module_files():
    with pytest.raises(scan.Wrong):
        scan.module_file(MODULE)
    got = scan.module_file(MODULE.replace("e.org//comment", "e.org v1.0.0//comment"))
    assert (got["module"], got["go"], got["toolchain"]) == ("quoted.org/m", "1.21", "go1.22.1")
    assert got["requires"] == [{"path": p, "version": v} for p, v in (("raw.org/a", "v1.2.3"), ("b.org/b", "v0.0.0-2020"), ("c.org/c", "v2.0.0+incompatible"))]
    assert [tuple(r.values()) for r in got["replaces"]] == [("b.org/b", None, "../b", None), ("c.org/c", "v2.0.0+incompatible", "d.org/d", "v1.0.0"), ("raw.org/a", None, "e.org", "v1.0.0")]


BAD_MODULE = ["", "go 1.20", "module a\nmodule b", "module a b", "module m /* no */", "module m\nrequire a.org/b", "module m\nrequire ( a.org/b v1.0.0 )", "module m\nrequire (\na.org/b v1.0.0", "module m\nwhat x", "module m\ngo (\n1.2\n)", "module m\nreplace a => b", "module m\nreplace a => ../b v1.0.0", "module m\nreplace a -> ../b", "module m\nrequire a.org/b 1.0.0", 'module "m']


@pytest.mark.parametrize("text", BAD_MODULE)
def test_module_files_that_break_the_rules(text):
    with pytest.raises(scan.Wrong):
        scan.module_file(text)


def test_tables(spark):
    files = spark.createDataFrame([(f"d{k}/x.go", t) for k, t in enumerate(GO)] + [("d/go.mod", "module (\n\tm.org/m\n)\n"), ("e/go.mod", "nothing"), ("f/y.go", None), ("g.txt", "package p")], "path string, text string")
    good = files.where("path not in ('e/go.mod', 'f/y.go')")
    got = {r.path: r.targets for r in modules.imports(good).where("target is not null").groupBy("path").agg(F.array_sort(F.collect_list("target")).alias("targets")).collect()}
    assert got == {f"d{k}/x.go": sorted(x for x in v if x != "C") for k, v in enumerate(GO.values()) if v}
    assert [(r.dir, r.module, r.go) for r in modules.modules(good).collect()] == [("d", "m.org/m", "1.16")]
    assert {r.path for r in modules.problems(files).collect()} == {"e/go.mod", "f/y.go"}
    assert modules.modules(files, strict=False).count() == 1
    for read in (modules.imports, modules.modules):
        with pytest.raises(Exception, match=r"f/y.go: no package clause|e/go.mod: an unknown word"):
            read(files).collect()
