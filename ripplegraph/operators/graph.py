"""Validation, union and lookups of entity graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.model import FOLLOWED, Graph, GraphError


def namespace(id_: Column) -> Column:
    """What stands before the first colon; all of it without one."""
    return F.substring_index(id_, ":", 1)


def violations(graph: Graph) -> DataFrame:
    """id, problem: blank and repeated ids, blank kinds of edges, and edges to nowhere."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    e, r = graph.entities, graph.edges
    ends = r.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit("unknown source").alias("problem")), F.struct(F.col("dst").alias("id"), F.lit("unknown target").alias("problem")))).alias("x")).select("x.*")
    return (
        e.where(blank(F.col("id"))).select(F.lit("").alias("id"), F.lit("blank id").alias("problem"))
        .union(e.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id")))
        .union(r.where(blank(F.col("kind"))).select("src", F.lit("blank relation")))
        .union(ends.distinct().join(e, "id", "left_anti"))
    )


def validated(graph: Graph) -> Graph:
    """The graph itself; the first violation, in order, is an error."""
    if first := violations(graph).orderBy("problem", "id").first():
        raise GraphError(f"{first['problem']}: {first['id']!r}")
    return graph


def conflicts(*graphs: Graph) -> DataFrame:
    """id, kinds: entities that graphs give different kinds."""
    found = _union(*(g.entities for g in graphs)).groupBy("id").agg(F.min("kind").alias("_a"), F.max("kind").alias("_b"))
    return found.where("_a <> _b").select("id", F.array("_a", "_b").alias("kinds"))


def absorbed(*graphs: Graph) -> Graph:
    """The union, with equal rows once; an id with two kinds is an error."""
    if first := conflicts(*graphs).orderBy("id").first():
        raise GraphError(f"{first['id']!r} is both {first['kinds'][0]!r} and {first['kinds'][1]!r}")
    return Graph(_union(*(g.entities for g in graphs)).distinct(), _union(*(g.edges for g in graphs)).distinct())


def _union(first: DataFrame, *rest: DataFrame) -> DataFrame:
    for df in rest:
        first = first.unionByName(df)
    return first


def out_edges(graph: Graph, ids: DataFrame) -> DataFrame:
    """Edges from the given ids."""
    return graph.edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")


def dependencies(edges: DataFrame, followed=FOLLOWED) -> DataFrame:
    """src, dst: distinct followed edges but for those of an entity to itself."""
    return edges.where(F.col("kind").isin(*followed) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()


def induced(graph: Graph, ids: DataFrame) -> Graph:
    """The entities of ``ids``, and every edge, of any kind, with both ends among them."""
    kept = ids.select("id").distinct()
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(kept.withColumnRenamed("id", end), end, "left_semi")
    return Graph(graph.entities.join(kept, "id", "left_semi"), edges.select("src", "dst", "kind"))


def contained(graph: Graph, root: str) -> DataFrame:
    """id, depth, path: what stands below ``root`` by containment, level by level.

    A path is the ids from the root on, so that ordering by it prints the tree.
    """
    from ripplegraph.model import checkpointed

    below = graph.edges.where("kind = 'contains'").select(F.col("src").alias("_up"), F.col("dst").alias("_id"))
    level = checkpointed(graph.entities.where(F.col("id") == root).select("id", F.lit(0).alias("depth"), F.array("id").alias("path")))
    levels = [level]
    while not level.isEmpty():
        level = checkpointed(
            level.join(below, F.col("id") == F.col("_up"))
            .where(~F.array_contains("path", F.col("_id")))
            .select(F.col("_id").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("_id")).alias("path"))
        )
        levels.append(level)
    return _union(*levels)
