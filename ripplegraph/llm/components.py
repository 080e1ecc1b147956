"""Connected components of a large edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import checkpointed


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (u, v: long); root is the smallest node it reaches.

    Large and small stars take turns: each node hands its larger neighbours to its smallest
    one, then its smaller neighbours. Every round is checkpointed, and the last is known by three
    counts: each node is either a root or has one edge, to a root. Rounds grow with the
    logarithm of a component's length; neither a hub nor a component meets in one task, as
    minima are summed before the shuffle and Spark splits skewed joins.
    """
    now = checkpointed(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = now.select("u").union(now.select("v")).distinct().count()
    for done in range(most_rounds + 1):
        n, us, vs = now.agg(F.count("*"), F.count_distinct("u"), F.count_distinct("v")).first()
        if n == us and us + vs == nodes:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        if done == most_rounds:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = checkpointed(small.where("u <> v").distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
