"""Modules and packages of Go sources: who imports whom, by joins on prefixes.

``files`` has path and text. Texts are read token by token in Arrow batches (``sources.scan``): of
sources the imports alone, which end at the first declaration. A text that breaks the rules is an
error unless ``strict`` is off; then it has no imports, or no module, and a problem.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ripplegraph.functions.config import base64encode
from ripplegraph.functions.paths import ancestors, folded, parent
from ripplegraph.model import Graph, checkpointed
from ripplegraph.sources import scan

DEFAULT_VERSION = "1.16"


_REQUIRE = "struct<path:string,version:string>"
_REPLACE = "struct<path:string,version:string,to_path:string,to_version:string>"


def _read(files: DataFrame, of, schema: str) -> DataFrame:
    """path and what ``of`` makes of each text, or the problem with it; null texts are empty ones."""

    def run(batches):
        for b in batches:
            out = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    out.append({"path": path, **of(text.as_py() or ""), "problem": None})
                except scan.Wrong as e:
                    out.append({"path": path, "problem": str(e)})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    kinds = to_arrow_schema(StructType.fromDDL(f"path string, {schema}, problem string"))
    return files.select("path", "text").mapInArrow(run, f"path string, {schema}, problem string")


def _sound(rows: DataFrame, strict: bool, name: str) -> DataFrame:
    if not strict:
        return rows
    raised = F.raise_error(F.concat("path", F.lit(": "), "problem"))
    return rows.withColumn(name, F.when(F.col("problem").isNull(), F.col(name)).otherwise(raised))


def modules(files: DataFrame, name: str = "go.mod", strict: bool = True) -> DataFrame:
    """dir, path (of go.mod), module, go, toolchain, requires, replaces of each module."""
    found = files.where(F.substring_index("path", "/", -1) == name)
    rows = _read(found, scan.module_file, f"module string, go string, toolchain string, requires array<{_REQUIRE}>, replaces array<{_REPLACE}>")
    rows = _sound(rows, strict, "module").where("module is not null")
    toolchain = F.when(~F.col("toolchain").isin("default", "local"), F.col("toolchain"))
    return rows.select(parent(F.col("path")).alias("dir"), "path", "module", F.coalesce("go", F.lit(DEFAULT_VERSION)).alias("go"), toolchain.alias("toolchain"), "requires", "replaces")


def imports(files: DataFrame, strict: bool = True) -> DataFrame:
    """path, dir, is_test, target: imports of each source, none for one without; those of C code are left out."""
    rows = _read(files.where(F.col("path").endswith(".go")), lambda text: {"targets": [x for x in scan.go_imports(text) if x != "C"]}, "targets array<string>")
    rows = _sound(rows, strict, "targets")
    return rows.select("path", parent(F.col("path")).alias("dir"), F.col("path").endswith("_test.go").alias("is_test"), F.explode_outer("targets").alias("target"))


def problems(files: DataFrame, name: str = "go.mod") -> DataFrame:
    """path, problem: the sources and module files that can't be read."""
    sources = _read(files.where(F.col("path").endswith(".go")), lambda text: {"n": len(scan.go_imports(text))}, "n int")
    mods = _read(files.where(F.substring_index("path", "/", -1) == name), lambda text: {"n": len(scan.module_file(text))}, "n int")
    return sources.union(mods).where("problem is not null").select("path", "problem")


def owners(dirs: DataFrame, mods: DataFrame) -> DataFrame:
    """dir, module_dir, module, mod_path: the deepest module above each directory; none: left out."""
    above = dirs.select("dir").distinct().withColumn("_up", F.explode(F.array_distinct(F.concat(ancestors(F.col("dir")), F.array("dir")))))
    m = mods.select(F.col("dir").alias("_up"), F.struct(F.length("dir").alias("_n"), F.col("dir").alias("module_dir"), "module", F.col("path").alias("mod_path")).alias("_m"))
    return above.join(m, "_up").groupBy("dir").agg(F.max("_m").alias("_m")).select("dir", "_m.module_dir", "_m.module", "_m.mod_path")


def coded(name: Column) -> Column:
    """Unpadded url-safe base64, so that any name can be a part of an id."""
    return F.rtrim(F.translate(base64encode(name), "+/", "-_"), F.lit("="))


def decoded(part: Column) -> Column:
    """The name that ``coded`` gave this part."""
    padding = F.repeat(F.lit("="), F.pmod(-F.length(part), F.lit(4)))
    return F.decode(F.unbase64(F.concat(F.translate(part, "-_", "+/"), padding)), "UTF-8")


def _id(kind: str, mod_path: Column, name: Column, space: str) -> Column:
    return F.concat_ws(":", F.lit(f"{space}:{kind}"), mod_path, coded(name))


def id_parts(id_: Column) -> Column:
    """kind, mod_path and name of an id of packages or versions."""
    parts = F.split(id_, ":", 4)
    return F.struct(parts[1].alias("kind"), parts[2].alias("mod_path"), decoded(parts[3]).alias("name"))


def _import_path(module: Column, module_dir: Column, directory: Column) -> Column:
    below = F.when(module_dir == "", directory).otherwise(directory.substr(F.length(module_dir) + 2, F.length(directory)))
    return F.when(below == "", module).otherwise(F.concat(module, F.lit("/"), below))


def _above(name: Column) -> Column:
    """A slash-separated name and all its prefixes."""
    return F.concat(F.filter(ancestors(name), lambda x: x != ""), F.array(name))


def resolved_imports(wanted: DataFrame, mods: DataFrame, packages: DataFrame) -> DataFrame:
    """mod_path, target, to_dir, to_module_dir: the package in the repository that each import names, if any.

    In order: what a replacement by a path leads to, the first in the file that leads to a
    package; the package of the importing module with that path; that of the module with the
    longest name above the path, of several with one name the deepest. Each rule is an equi-join
    on the import's prefixes. ``packages`` has dir and module_dir.
    """
    asked = wanted.select("mod_path", "target").distinct()
    above = asked.withColumn("_old", F.explode(_above(F.col("target"))))
    rest = F.when(F.col("target") == F.col("_old"), "").otherwise(F.col("target").substr(F.length("_old") + 1, F.length("target")))
    below = lambda start: folded(F.concat_ws("/", F.when(start != "", start), F.when(rest != "", F.substring(rest, 2, 1 << 30))))
    is_path = lambda r: r["to_path"].isNotNull() & r["to_version"].isNull()
    replaced = mods.select(F.col("path").alias("mod_path"), F.col("dir").alias("_base"), F.posexplode(F.filter("replaces", is_path)).alias("_k", "_r")).withColumn("_old", F.col("_r.path"))
    root = folded(F.concat_ws("/", F.when(F.col("_base") != "", F.col("_base")), F.col("_r.to_path")))
    places = packages.groupBy(F.col("dir").alias("_dir")).agg(F.min("module_dir").alias("_module_dir"))
    found = lambda df, k: df.select("mod_path", "target", F.struct(k.alias("k"), "_dir", "_module_dir").alias("_to"))
    one = found(above.join(replaced, ["mod_path", "_old"]).withColumn("_dir", below(root)).join(places, "_dir"), F.struct(F.lit(0).alias("rule"), F.col("_k").alias("n")))
    own = mods.select(F.col("path").alias("mod_path"), F.col("dir").alias("_module_dir"), F.col("module").alias("_old"))
    there = packages.select(F.col("dir").alias("_dir"), F.col("module_dir").alias("_module_dir")).distinct()
    two = found(above.join(own, ["mod_path", "_old"]).withColumn("_dir", below(F.col("_module_dir"))).join(there, ["_dir", "_module_dir"]), F.struct(F.lit(1).alias("rule"), F.lit(0).alias("n")))
    first = mods.groupBy(F.col("module").alias("_old")).agg(F.min(F.struct((-F.length("dir")).alias("n"), F.col("dir").alias("d")))["d"].alias("_module_dir"))
    longest = above.join(first, "_old").groupBy("mod_path", "target").agg(F.max_by(F.struct("_old", "_module_dir"), F.length("_old")).alias("_m")).select("mod_path", "target", "_m.*")
    three = found(longest.withColumn("_dir", below(F.col("_module_dir"))).join(there, ["_dir", "_module_dir"]), F.struct(F.lit(2).alias("rule"), F.lit(0).alias("n")))
    best = one.union(two).union(three).groupBy("mod_path", "target").agg(F.min("_to").alias("_to"))
    return best.select("mod_path", "target", F.col("_to._dir").alias("to_dir"), F.col("_to._module_dir").alias("to_module_dir"))


def _joined(base: Column, below: Column) -> Column:
    """A path below a tree in shortest form; null past the root, for an absolute one, and with backslashes, which are no separators here."""
    odd = F.contains(below, F.lit("\\")) | ((base == "") & below.startswith("/"))
    return F.when(~odd, folded(F.concat_ws("/", F.when(base != "", base), F.when(below != "", below))))


def _by_import_path(values: DataFrame, mods: DataFrame) -> DataFrame:
    """value, ambiguous, dir, module_dir, module, mod_path: where the module with the longest name above each import path has it.

    Module files are met in the order of their paths: a second one of a name is ambiguous, unless
    one with a longer name came before it.
    """
    first = mods.groupBy("module").agg(F.min(F.struct("path", "dir")).alias("_m")).select("module", F.col("_m.path").alias("mod_path"), F.col("_m.dir").alias("module_dir"))
    again = mods.select("module", "path").join(first, "module").where("path > mod_path").groupBy("module").agg(F.min("path").alias("again"))
    above = values.withColumn("module", F.explode(_above(F.col("value"))))
    met = above.join(first.join(again, "module", "left"), "module").withColumn("n", F.length("module"))
    by_value = met.groupBy("value").agg(F.collect_list(F.struct("n", "mod_path", "module_dir", "module", "again")).alias("_met"))  # one for each segment at most
    earlier = lambda x: F.exists("_met", lambda y: (y["n"] > x["n"]) & (y["mod_path"] < x["again"]))
    ambiguous = F.exists("_met", lambda x: x["again"].isNotNull() & ~earlier(x))
    rows = by_value.select("value", ambiguous.alias("ambiguous"), F.array_max("_met").alias("_best")).select("value", "ambiguous", "_best.*")
    rest = F.col("value").substr(F.col("n") + 1, F.length("value"))
    below = F.when(rest.startswith("/"), F.substring(rest, 2, 1 << 30)).otherwise(rest)
    return rows.select("value", "ambiguous", _joined(F.col("module_dir"), below).alias("dir"), "module_dir", "module", "mod_path")


def named_packages(wanted: DataFrame, objects: DataFrame, mods: DataFrame, space: str = "go") -> DataFrame:
    """id, dst, problem: the package that each value (id, file, value, kind) in a declaring file names; kind is package or package-test.

    A value is tried as a tree of the snapshot, then as one seen from the file's tree, then as an
    import path; a tree counts if a module is above it. ``objects`` has path and kind, ``mods`` is of
    ``modules``. What names a source, lies nowhere, in two modules of one name, or has no sources of
    its kind has a problem and no dst; null values lie nowhere. Each distinct value is looked for
    once, by joins on paths and their prefixes; empty tables give none.
    """
    rows = wanted.select("id", parent(F.col("file")).alias("base"), "value", "kind")
    asked = checkpointed(rows.select("base", "value").where("base is not null and value is not null").distinct())
    root = objects.sparkSession.range(1).select(F.lit("").alias("dir"))
    trees = objects.where("kind = 'tree'").select(F.col("path").alias("dir")).union(root).distinct()
    seen = _joined(F.col("base"), F.col("value"))
    tries = F.array(F.struct(F.lit(0).alias("rule"), F.col("value").alias("dir")), F.struct(F.lit(1).alias("rule"), F.when(seen != "", seen).alias("dir")))
    tried = asked.select("base", "value", F.explode(tries).alias("_x")).select("base", "value", "_x.*")
    held = tried.select("dir").distinct().join(trees, "dir", "left_semi")
    place = F.struct("rule", "dir", "module_dir", "module", "mod_path").alias("_to")
    by_tree = tried.join(owners(held, mods), "dir").groupBy("base", "value").agg(F.min(place).alias("_tree"))
    imported = _by_import_path(asked.select("value").distinct(), mods).join(trees.withColumn("_held", F.lit(True)), "dir", "left").withColumn("rule", F.lit(2))
    imported = imported.select("value", "ambiguous", F.when(F.col("_held") & ~F.col("ambiguous"), place).alias("_import"))
    sources = objects.where("kind = 'blob' and endswith(path, '.go')").groupBy(parent(F.col("path")).alias("dir")).agg(F.max(F.endswith("path", F.lit("_test.go"))).alias("_tested"))
    found = asked.join(by_tree, ["base", "value"], "left").join(imported, "value", "left").withColumn("_to", F.coalesce("_tree", "_import"))
    found = found.select("base", "value", "ambiguous", F.col("_to.dir").alias("dir"), "_to.module_dir", "_to.module", "_to.mod_path").join(sources, "dir", "left")
    out = rows.join(found, ["base", "value"], "left")
    problem = (
        F.when(~F.coalesce(F.col("kind").isin("package", "package-test"), F.lit(False)), "not a kind of package").when(F.endswith("value", F.lit(".go")), "a source, not a package")
        .when(F.col("dir").isNull(), F.when(F.col("ambiguous"), "in two modules").otherwise("not found"))
        .when((F.col("kind") == "package-test") & ~F.coalesce("_tested", F.lit(False)), "no test sources").when(F.col("_tested").isNull(), "no sources")
    )
    name = _import_path(F.col("module"), F.col("module_dir"), F.col("dir"))
    id_ = F.when(F.col("kind") == "package", _id("package", F.col("mod_path"), name, space)).otherwise(_id("package-test", F.col("mod_path"), name, space))
    return out.select("id", F.when(problem.isNull(), id_).alias("dst"), problem.alias("problem"))


def package_graph(files: DataFrame, space: str = "go", files_space: str = "git", attached: bool = False) -> Graph:
    """Packages, their tests, and what they import: a local package, a built-in or an external one.

    If ``attached``, the tree of its sources contains each. Local packages are found by ``resolved_imports``; without one, paths whose first segment has
    no dot are built in.
    """
    mods, found = checkpointed(modules(files)), checkpointed(imports(files))
    placed = found.join(owners(found, mods), "dir").withColumn("name", _import_path(F.col("module"), F.col("module_dir"), F.col("dir")))
    src = F.when(F.col("is_test"), _id("package-test", F.col("mod_path"), F.col("name"), space)).otherwise(_id("package", F.col("mod_path"), F.col("name"), space))
    own = placed.select("dir", "path", "is_test", "target", "module_dir", "mod_path", "name", src.alias("src"))
    packages = own.select("dir", "module_dir", "name", "mod_path").distinct()
    wanted = own.where("target is not null")
    local = resolved_imports(wanted, mods, packages)
    ids = packages.select(F.col("dir").alias("to_dir"), F.col("module_dir").alias("to_module_dir"), _id("package", F.col("mod_path"), F.col("name"), space).alias("_local"))
    wanted = wanted.join(local, ["mod_path", "target"], "left").join(ids, ["to_dir", "to_module_dir"], "left")
    std = ~F.contains(F.substring_index("target", "/", 1), F.lit("."))
    dst = F.coalesce("_local", F.when(std, _id("package-stdlib", F.col("mod_path"), F.col("target"), space)).otherwise(_id("package-external", F.col("mod_path"), F.col("target"), space)))
    used = wanted.select("src", dst.alias("dst"), F.when(F.col("_local").isNotNull(), "package").when(std, "package-stdlib").otherwise("package-external").alias("_kind"), "mod_path")
    plain = packages.select(_id("package", F.col("mod_path"), F.col("name"), space).alias("id"), F.lit(f"{space}:package").alias("kind"), "mod_path")
    tests = own.where("is_test").select(F.col("src").alias("id"), F.lit(f"{space}:package-test").alias("kind"), "mod_path", "name").distinct()
    others = used.where("_kind <> 'package'").select(F.col("dst").alias("id"), F.concat(F.lit(f"{space}:"), F.col("_kind")).alias("kind"), "mod_path").distinct()
    every = plain.union(tests.select("id", "kind", "mod_path")).union(others)
    version = lambda m: _id("go-version", m, F.lit(""), space)
    entities = every.select("id", "kind").union(every.select(version(F.col("mod_path")), F.lit(f"{space}:go-version"))).distinct()
    edge = lambda df, src, dst, k: df.select(src.alias("src"), dst.alias("dst"), F.lit(k).alias("kind"))
    edges = (
        edge(used, F.col("src"), F.col("dst"), "imports")
        .union(edge(own, F.col("src"), F.concat(F.lit(f"{files_space}:"), F.col("path")), "source-file"))
        .union(edge(tests, F.col("id"), _id("package", F.col("mod_path"), F.col("name"), space), "tests"))
        .union(edge(every, F.col("id"), version(F.col("mod_path")), "go-version"))
    )
    if attached:
        edges = edges.union(edge(own.select("dir", "src").union(packages.select("dir", _id("package", F.col("mod_path"), F.col("name"), space))), F.concat(F.lit(f"{files_space}:"), F.col("dir")), F.col("src"), "contains"))
    return Graph(entities, edges.distinct())


def go_version_tokens(mods: DataFrame, space: str = "go") -> DataFrame:
    """id, token: the language version of each module, as its go.mod gives it."""
    toolchain = F.when(F.col("toolchain").isNotNull(), F.concat(F.lit(",toolchain="), F.col("toolchain"))).otherwise("")
    return mods.select(_id("go-version", F.col("path"), F.lit(""), space).alias("id"), F.concat(F.lit("go-version:go="), "go", toolchain).alias("token"))


def version_tokens(mods: DataFrame, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """mod_path, target, token, problem: the version that a module gives each external import.

    The longest required prefix counts; a replacement of just its version wins over one of all.
    An import that a path replaces, or that no requirement covers, has no token but a
    problem, which is an error if ``strict``.
    """
    asked = wanted.select("mod_path", "target").distinct()
    above = asked.withColumn("path", F.explode(_above(F.col("target"))))
    need = mods.select(F.col("path").alias("mod_path"), F.explode("requires").alias("r"), "replaces").select("mod_path", "r.path", "r.version", "replaces")
    top = above.join(need, ["mod_path", "path"]).groupBy("mod_path", "target").agg(F.max_by(F.struct("path", "version", "replaces"), F.length("path")).alias("_t"))
    top = top.select("mod_path", "target", "_t.*")
    versioned = F.filter("replaces", lambda x: x["to_version"].isNotNull() & (x["path"] == F.col("path")))
    fits = F.filter(versioned, lambda x: x["version"] == F.col("version"))
    to = F.coalesce(F.try_element_at(fits, F.lit(1)), F.try_element_at(F.filter(versioned, lambda x: x["version"].isNull()), F.lit(-1)))
    token = F.concat(F.lit("go-module:"), F.coalesce(to["to_path"], F.col("path")), F.lit("@"), F.coalesce(F.when(to.isNotNull(), to["to_version"]).otherwise(F.col("version")), F.lit("")))
    paths_ = mods.select(F.col("path").alias("mod_path"), F.explode(F.filter("replaces", lambda r: r["to_path"].isNotNull() & r["to_version"].isNull())).alias("r")).select("mod_path", F.col("r.path").alias("path"))
    led = above.join(paths_.distinct(), ["mod_path", "path"]).select("mod_path", "target", F.lit(True).alias("_led")).distinct()
    found = asked.join(top.select("mod_path", "target", token.alias("token")), ["mod_path", "target"], "left").join(led, ["mod_path", "target"], "left")
    problem = F.when(F.col("_led"), "replaced by a path without a package").when(F.col("token").isNull(), "not required")
    out = found.select("mod_path", "target", F.when(problem.isNull(), F.col("token")).alias("token"), problem.alias("problem"))
    if not strict:
        return out
    raised = F.raise_error(F.concat("mod_path", F.lit(": "), "target", F.lit(" is "), "problem"))
    return out.select("mod_path", "target", F.when(F.col("problem").isNull(), F.col("token")).otherwise(raised).alias("token"), "problem")


def package_tokens(files: DataFrame, graph: Graph, space: str = "go", strict: bool = True) -> DataFrame:
    """id, token: the language versions of modules, and the versions of external packages."""
    mods = checkpointed(modules(files))
    external = graph.entities.where(F.col("kind") == f"{space}:package-external").select("id", id_parts(F.col("id")).alias("p"))
    wanted = external.select("p.mod_path", F.col("p.name").alias("target"))
    found = version_tokens(mods, wanted, strict).where("token is not null").select(_id("package-external", F.col("mod_path"), F.col("target"), space).alias("id"), "token")
    return go_version_tokens(mods, space).union(found)


def package_test_directories(graph: Graph, space: str = "go", files_space: str = "git") -> DataFrame:
    """id, dir, module: the directory of each test package: that of its source files; none in the root."""
    tests = graph.entities.where(F.col("kind") == f"{space}:package-test").select("id")
    files = graph.edges.where("kind = 'source-file'").select(F.col("src").alias("id"), parent(F.col("dst").substr(F.lit(len(files_space) + 2), F.length("dst"))).alias("dir")).distinct()
    return tests.join(files, "id").where("dir <> ''").select("id", "dir", id_parts(F.col("id"))["mod_path"].alias("mod_path"))
