"""Selectors name targets: ``//path#kind.name``, with shorter aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.functions.paths import folded, parent, within
from ripplegraph.model import GraphError


class NoMatch(GraphError):
    """No target answers to the input."""


class Ambiguous(GraphError):
    """More than one target does; the message lists them in order."""


def parsed(text: Column) -> Column:
    """path, identifier, rooted; the first ``#`` divides, and an empty identifier is invalid (null)."""
    rooted = text.startswith("//")
    rest = F.when(rooted, text.substr(F.lit(3), F.length(text))).otherwise(text)
    at = F.instr(rest, "#")
    identifier = F.when(at > 0, rest.substr(at + 1, F.length(rest))).otherwise(rest)
    path = F.when(at > 0, rest.substr(F.lit(1), at - 1)).otherwise("")
    return F.when(identifier != "", F.struct(path.alias("path"), identifier.alias("identifier"), rooted.alias("rooted")))


def canonical(path: Column, kind: Column, name: Column) -> Column:
    return F.concat(F.lit("//"), path, F.lit("#"), kind, F.when(name == "", "").otherwise(F.concat(F.lit("."), name)))


def aliases(kind: Column, name: Column, index: Column, more: Column) -> Column:
    """Identifiers that a target answers to, in order, each once: kind.name, name, kind, kind.index, others."""
    named = F.when(name != "", F.array(F.concat(kind, F.lit("."), name), name, kind)).otherwise(F.array(kind))
    return F.array_distinct(F.concat(named, F.array(F.concat(kind, F.lit("."), index.cast("string"))), more))


def asked_tree(selector: Column, cwd: Column) -> Column:
    """The tree that a parsed selector asks for, seen from cwd if it isn't rooted; null if it leaves the root."""
    path = selector["path"]
    return folded(F.when(selector["rooted"] | (cwd == ""), path).otherwise(F.concat(cwd, F.lit("/"), path)))


def names_config(path: Column, filenames: tuple[str, ...]) -> Column:
    """Whether a selector's path is that of a configuration file."""
    return F.substring_index(path, "/", -1).isin(*filenames)


def tree_of(path: Column, filenames: tuple[str, ...] = ()) -> Column:
    """The tree that a selector's path names: for a configuration file the one it lies in."""
    return F.when(names_config(path, filenames), parent(path)).otherwise(path) if filenames else path


def path_matches(asked: Column, cwd: Column, path: Column, directory: Column) -> Column:
    """Whether a path asked for, seen from cwd, names a target's file or tree; empty and ``.`` name any."""
    seen = folded(F.when(asked.startswith("//"), asked.substr(F.lit(3), F.length(asked))).when(cwd == "", asked).otherwise(F.concat(cwd, F.lit("/"), asked)))
    bad = asked.startswith("/") & ~asked.startswith("//")
    return asked.isin("", ".") | (asked == path) | (asked == directory) | F.coalesce(~bad & ((seen == path) | (seen == directory)), F.lit(False))


def declared(file: Column, kind: Column, name: Column, index: Column) -> Column:
    """path, dir, kind, name, index of a target that a configuration file declares."""
    return F.struct(file.alias("path"), parent(file).alias("dir"), kind.alias("kind"), name.alias("name"), index.alias("index"))


def package_test(directory: Column, kind: str = "package_test") -> Column:
    """The target that runs a package's tests; it lies in the package's own tree."""
    return declared(F.concat(directory, F.lit("/")), F.lit(kind), F.lit(""), F.lit(0)).withField("path", directory)


def resolved(targets: DataFrame, inputs: DataFrame) -> DataFrame:
    """input, cwd, id: the one target for each input, by the first rule that any target fits.

    ``targets`` has id, path, kind, name, label, index and more (aliases); ``inputs`` has
    input and cwd. Rules, in order: the canonical selector itself; an alias, and the path where the
    input has one, with targets in cwd and then below it preferred for inputs without; the
    label, for inputs without a path. Aliases are joined by value, never each with each.
    """
    t = targets.withColumn("_canonical", canonical(F.col("path"), F.col("kind"), F.col("name")))
    named = t.select("*", F.explode(aliases(F.col("kind"), F.col("name"), F.col("index"), F.col("more"))).alias("_alias"))
    asked = inputs.select("input", "cwd", parsed(F.col("input")).alias("_s"), F.contains(F.col("input"), F.lit("#")).alias("_pathed")).where("_s is not null")
    exact = asked.join(t, F.col("input") == F.col("_canonical")).withColumn("_rank", F.lit(0))
    alias = (
        asked.join(named, F.col("_s.identifier") == F.col("_alias"))
        .where(~F.col("_pathed") | (asked_tree(F.col("_s"), F.col("cwd")) == F.col("path")))
        .withColumn("_rank", F.when(F.col("_pathed") | (F.col("path") == F.col("cwd")), 1).when(within(F.col("path"), F.col("cwd")), 2).otherwise(3))
    )
    label = asked.where("not _pathed").join(t.where("label <> ''"), F.col("input") == F.col("label")).withColumn("_rank", F.lit(4))
    columns = ["input", "cwd", "id", "_canonical", "_rank"]
    found = exact.select(columns).union(alias.select(columns)).union(label.select(columns)).distinct()
    best = Window.partitionBy("input", "cwd")
    return found.withColumn("_best", F.min("_rank").over(best)).where("_rank = _best").groupBy("input", "cwd").agg(F.array_sort(F.collect_set(F.struct("_canonical", "id"))).alias("found"))


def resolve_one(targets: DataFrame, text: str, cwd: str = "") -> str:
    """The id of the one target that the text names."""
    inputs = targets.sparkSession.createDataFrame([(text, cwd)], "input string, cwd string")
    row = resolved(targets, inputs).first()
    if row is None:
        raise NoMatch(f"no target matches {text!r}")
    if len(row["found"]) > 1:
        raise Ambiguous(f"{text!r} is ambiguous: " + ", ".join(x["_canonical"] for x in row["found"]))
    return row["found"][0]["id"]


def completions(targets: DataFrame, text: str, cwd: str = "") -> DataFrame:
    """text, place: canonical selectors with the prefix, or the short names that fit from cwd."""
    c = canonical(F.col("path"), F.col("kind"), F.col("name"))
    if text.startswith("//"):
        return targets.select(c.alias("text"), F.lit(0).alias("place")).where(F.col("text").startswith(text)).distinct()
    if text.startswith("."):
        raise GraphError("relative selectors can't be completed")
    short = F.concat(F.col("kind"), F.when(F.col("name") == "", "").otherwise(F.concat(F.lit("."), F.col("name"))))
    here = targets.where(F.col("path") == cwd).select(short.alias("text"), F.lit(0).alias("place"))
    lead = f"{cwd}/" if cwd else ""
    below = targets.where(F.col("path").startswith(lead)).select(F.concat(F.col("path").substr(F.lit(len(lead) + 1), F.length("path")), F.lit("#"), short).alias("text"), F.lit(1).alias("place"))
    return here.union(below).where(F.col("text").startswith(text)).distinct()
