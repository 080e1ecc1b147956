"""A graph as a printed tree: trees and files, and in them packages and targets with what they use.

Every line has a place: the keys of the nodes from the root down to it, so that lines ordered by
place are the printed tree. An entity with several parents is laid out once below each. Which child is
the last of its parent is settled once for each edge, not for each place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.model import Graph, GraphError, Snapshot, checkpointed
from ripplegraph.operators import delta, graph
from ripplegraph.plans.render import DIGITS, range_labels
from ripplegraph.sources.modules import id_parts

#: What a line begins with: below a node that isn't, or is, its parent's last; and the node itself.
RUNS, ENDED, MID, LAST = "│   ", "    ", "├── ", "└── "
#: Kinds of lines below a package, in their order.
VERSION, FILE, LOCAL, BUILT_IN, EXTERNAL = "1", "2", "3", "4", "5"


def kind_of(kind: Column) -> Column:
    """The kind without its namespace."""
    return F.substring_index(kind, ":", -1)


def is_target(kind: Column) -> Column:
    return kind.startswith("target:")


def is_package(kind: Column) -> Column:
    return kind_of(kind).isin("package", "package-test") & ~is_target(kind)


def target_parts(id_: Column) -> Column:
    """kind, file and name of a target's id (``target:kind:file:name``); null for any other."""
    parts = F.split(id_, ":", 4)
    return F.when((F.size(parts) == 4) & (parts[0] == "target"), F.struct(parts[1].alias("kind"), parts[2].alias("file"), parts[3].alias("name")))


def _path(id_: Column) -> Column:
    return F.regexp_replace(id_, "^[^:]*:", "")


def package_label(id_: Column, kind: Column) -> Column:
    return F.concat(F.when(kind_of(kind) == "package-test", "go package-test ").otherwise("go package "), id_parts(id_)["name"])


def dependency_label(id_: Column, kind: Column) -> Column:
    """What a dependency is called: packages and targets by kind and name, files by path, all else by id."""
    target = target_parts(id_)
    return (
        F.when(is_target(kind) & target.isNotNull(), F.concat_ws(" ", target["kind"], target["name"]))
        .when(is_package(kind), package_label(id_, kind)).when(kind_of(kind) == "blob", _path(id_)).otherwise(id_)
    )


def _entity_label(id_: Column, kind: Column) -> Column:
    base = F.substring_index(_path(id_), "/", -1)
    return F.when(is_target(kind), F.concat(kind_of(kind), F.lit(" "), id_)).when(is_package(kind), package_label(id_, kind)).when(kind_of(kind) == "tree", F.concat(base, F.lit("/"))).otherwise(base)


def package_lines(g: Graph, tokens: DataFrame | None = None, labels: DataFrame | None = None, complete: Graph | None = None, files: bool = True, external: bool = True, versions: bool = True) -> DataFrame:
    """id, key, line: what a package shows, in the order of the keys: language version, files, imports by kind.

    ``tokens`` (id, token) has the language versions and those of external packages; the latter
    are shown if there are ``labels`` (id, label), which follow a version's line too. A local import
    counts if the complete graph, by default the graph itself, has contents or source files for it.
    """
    e = g.entities
    own = g.edges.join(e.where(is_package(F.col("kind"))).select(F.col("id").alias("src")), "src", "left_semi")
    ends = own.join(e.select(F.col("id").alias("dst"), F.col("kind").alias("_kind")), "dst").select("src", "dst", "kind", "_kind")
    line = lambda df, key, text: df.select(F.col("src").alias("id"), F.concat(F.lit(key), text).alias("key"), text.alias("line"))
    name = id_parts(F.col("dst"))["name"]
    full = complete or g
    held = full.edges.where("kind in ('contains', 'source-file')").select(F.col("src").alias("dst")).distinct()
    used = ends.where("kind = 'imports'")
    rows = [line(used.where(kind_of(F.col("_kind")) == "package").join(held, "dst", "left_semi"), LOCAL, F.concat(F.lit("import "), name))]
    if files:
        # files of one name in two trees are two lines
        found = ends.where((F.col("kind") == "source-file") & (kind_of(F.col("_kind")) == "blob"))
        base = F.substring_index(_path(F.col("dst")), "/", -1)
        rows.append(found.select(F.col("src").alias("id"), F.concat(F.lit(FILE), base, F.lit(" "), F.col("dst")).alias("key"), F.concat(F.lit("file "), base).alias("line")))
    if external:
        rows.append(line(used.where(kind_of(F.col("_kind")) == "package-stdlib"), BUILT_IN, F.concat(F.lit("std import "), name)))
        far = used.where(kind_of(F.col("_kind")) == "package-external").withColumn("_line", F.concat(F.lit("external import "), name)).withColumn("_key", F.col("_line"))
        if labels is not None and tokens is not None:
            module = tokens.where(F.col("token").startswith("go-module:")).select(F.col("id").alias("dst"), F.expr("substring(token, 11)").alias("_module"))
            far = far.join(module, "dst", "left").withColumn("_line", F.when(F.col("_module").isNull(), F.col("_line")).otherwise(F.concat("_line", F.lit(" ("), "_module", F.lit(")"))))
        rows.append(far.select(F.col("src").alias("id"), F.concat(F.lit(EXTERNAL), "_key").alias("key"), F.col("_line").alias("line")))
    if versions and tokens is not None:
        known = tokens.where(F.col("token").startswith("go-version:")).select(F.col("id").alias("dst"), F.concat(F.lit("go version "), F.expr("substring(token, 12)")).alias("_line"))
        found = _suffixed(ends.where("kind = 'go-version'").join(known, "dst"), "dst", "_line", labels)
        rows.append(found.groupBy(F.col("src").alias("id")).agg(F.lit(VERSION).alias("key"), F.min_by("_line", "dst").alias("line")))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.groupBy("id", "key").agg(F.min("line").alias("line"))


def _suffixed(rows: DataFrame, id_: str, text: str, labels: DataFrame | None) -> DataFrame:
    """The rows with a text that its entity's label follows; an entity without one is an error."""
    if labels is None:
        return rows
    known = labels.select(F.col("id").alias("_of"), F.col("label").alias("_label"))
    missing = F.raise_error(F.concat(F.lit("no label of "), id_))
    return rows.join(known, F.col(id_) == F.col("_of"), "left").withColumn(text, F.concat(text, F.lit(" "), F.coalesce("_label", missing))).drop("_of", "_label")


def _with_last(edges: DataFrame, key: str) -> DataFrame:
    """Edges (src and a key) with whether each is its src's last; a src of any number of edges is summed up in parts."""
    lasts = edges.groupBy("src").agg(F.max(key).alias(key)).withColumn("last", F.lit(True))
    return edges.join(lasts, ["src", key], "left").withColumn("last", F.coalesce("last", F.lit(False)))


def _placed(parents: DataFrame, children: DataFrame) -> DataFrame:
    """A row for each child of each place: its place, and what the lines of its own children begin with."""
    at = parents.select(F.col("id").alias("src"), F.col("place").alias("_up"), F.col("lead").alias("_lead"))
    found = at.join(children, "src").where((F.col("goes") != "tree") | ~F.array_contains("_up", F.col("key")))
    return found.select(
        F.concat("_up", F.array("key")).alias("place"),
        F.concat("_lead", F.when(F.col("last"), LAST).otherwise(MID), "text").alias("line"),
        F.concat("_lead", F.when(F.col("last"), ENDED).otherwise(RUNS)).alias("lead"),
        F.col("dst").alias("id"), "goes",
    )


def tree_lines(
    g: Graph, root: str, *, tokens: DataFrame | None = None, labels: DataFrame | None = None, selectors: DataFrame | None = None, complete: Graph | None = None, files: bool = False, external: bool = False, versions: bool = False
) -> DataFrame:
    """place, line: the printed tree below ``root``, whose own line is a dot. To be ordered by place.

    Trees show what they contain: trees, files, packages, tests and targets, in the order of ids.
    Targets show what they depend on, and packages, also as dependencies, what ``package_lines``
    gives. ``selectors`` (id, selector) name targets and tests, whose own lines they replace; other
    entities that have one are lines without more below. ``labels`` (id, label) follow the names. A
    root that is missing is an error, but in a part of a ``complete`` graph, which then has no lines.
    """
    e = g.entities.select(F.col("id").alias("dst"), F.col("kind").alias("_kind"))
    first = checkpointed(g.entities.where(F.col("id") == root).select(F.array().cast("array<string>").alias("place"), F.lit(".").alias("line"), F.lit("").alias("lead"), "id", F.lit("tree").alias("goes")))
    if first.isEmpty():
        if complete is None:
            raise GraphError(f"no entity {root!r}")
        return first.select("place", "line")
    kind = F.col("_kind")
    asked = F.lit(None).cast("string").alias("_selector") if selectors is None else F.col("_selector")
    below = g.edges.where("kind = 'contains'").select("src", "dst").distinct().join(e, "dst")
    if selectors is not None:
        below = below.join(selectors.select(F.col("id").alias("dst"), F.col("selector").alias("_selector")), "dst", "left")
    below = below.select("src", "dst", "_kind", asked).where(kind_of(kind).isin("tree", "blob") | is_package(kind) | is_target(kind) | F.col("_selector").isNotNull())
    goes = F.when(is_target(kind), "target").when(F.col("_selector").isNotNull(), "none").when(is_package(kind), "package").when(kind_of(kind) == "tree", "tree").otherwise("none")
    below = below.select("src", "dst", F.concat(F.lit("0"), "dst").alias("key"), F.coalesce("_selector", _entity_label(F.col("dst"), kind)).alias("text"), goes.alias("goes"))
    below = checkpointed(_with_last(_suffixed(below, "dst", "text", labels), "key"))
    needs = g.edges.where("kind = 'depends-on'").select("src", "dst").distinct().join(e, "dst")
    needs = needs.join(g.entities.where(is_target(F.col("kind"))).select(F.col("id").alias("src")), "src", "left_semi")
    needs = needs.select("src", "dst", F.concat(F.lit("0"), "dst").alias("key"), dependency_label(F.col("dst"), kind).alias("text"), F.when(is_package(kind), "package").otherwise("none").alias("goes"))
    packages = needs.where("goes = 'package'")
    needs = checkpointed(_with_last(_suffixed(packages, "dst", "text", labels).unionByName(needs.where("goes <> 'package'")), "key"))
    shown = package_lines(g, tokens, labels, complete, files, external, versions).select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), "key", F.col("line").alias("text"), F.lit("none").alias("goes"))
    shown = checkpointed(_with_last(shown, "key"))
    levels, level = [first], first
    while not level.isEmpty():
        level = checkpointed(_placed(level.where("goes = 'tree'"), below))
        levels.append(level)
    rows = levels[0]
    for r in levels[1:]:
        rows = rows.union(r)
    rows = rows.union(checkpointed(_placed(rows.where("goes = 'target'"), needs)))
    return rows.union(_placed(rows.where("goes = 'package'"), shown)).select("place", "line")


def cone_lines(base: Snapshot, head: Snapshot, root: str, labels: bool = False, **options) -> DataFrame:
    """place, line: the printed tree of what the later snapshot's entities differ in from the earlier one's.

    The entities that were added or modified, and the edges among them; nothing below the root
    changed: no lines. With ``labels``, each has the first digits of its sums as old..new, or new.
    """
    changed = checkpointed(delta.diff(base, head).where("status <> 'removed'").select("id"))
    part = graph.induced(head.graph, changed)
    part = Graph(checkpointed(part.entities), checkpointed(part.edges))
    known = None
    if labels:
        known = checkpointed(range_labels(delta.sums_of(base, base.graph.entities.select("id").join(changed, "id", "left_semi")), delta.sums_of(head, changed)))
    return tree_lines(part, root, tokens=head.tokens, labels=known, complete=head.graph, **options)


def sum_labels(s: Snapshot) -> DataFrame:
    """id, label: the first digits of each entity's sum."""
    return delta.sums_of(s).select("id", F.left("sum", F.lit(DIGITS)).alias("label"))
