"""Targets that files declare: what they refer to, and how they are shown. Rules are joins on tables.

A target has id, file, path (its tree), kind, name, index (its place in the file) and label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.model import Graph, checkpointed

#: Keys that every target's configuration has, so that no target may set them.
RESERVED = ("id", "kind", "file", "name", "label", "index", "script", "inline")


def references(wanted: DataFrame, targets: DataFrame) -> DataFrame:
    """id, dst, problem: the target of the same file that each reference (id, file, kind, name) names."""
    declared = targets.groupBy("file", "kind", "name").agg(F.min("id").alias("dst"), F.count("*").alias("_n"))
    found = wanted.join(declared, ["file", "kind", "name"], "left")
    return found.select("id", F.when(F.col("_n") == 1, F.col("dst")).alias("dst"), F.when(F.col("_n").isNull(), "not declared").when(F.col("_n") > 1, "declared twice").alias("problem"))


def path_dependencies(wanted: DataFrame, objects: DataFrame, space: str = "git") -> DataFrame:
    """id, dst, kind: the blob that each path (id, path) names, or else the tree; the root always is one.

    Paths that the snapshot lacks have no dst.
    """
    found = objects.groupBy("path").agg(F.max((F.col("kind") == "blob")).alias("_blob"))
    rows = wanted.join(found, "path", "left").withColumn("_known", F.col("_blob").isNotNull() | (F.col("path") == ""))
    kind = F.when(F.coalesce("_blob", F.lit(False)), "blob").otherwise("tree")
    return rows.select("id", F.when(F.col("_known"), F.concat(F.lit(f"{space}:"), "path")).alias("dst"), F.when(F.col("_known"), kind).alias("kind"))


def nearest_settings(wanted: DataFrame, settings: DataFrame, default: str) -> DataFrame:
    """id, value: the setting (dir, value) of a package's directory, or its module's, or the default.

    ``wanted`` has id, dir and module_dir.
    """
    of = lambda end: settings.select(F.col("dir").alias(end), F.col("value").alias(f"_{end}"))
    return wanted.join(of("dir"), "dir", "left").join(of("module_dir"), "module_dir", "left").select("id", F.coalesce("_dir", "_module_dir", F.lit(default)).alias("value"))


def projected(targets: DataFrame, space: str = "git") -> Graph:
    """Each target as an entity that its file and its tree contain."""
    up = F.explode(F.array(F.concat(F.lit(f"{space}:"), "file"), F.concat(F.lit(f"{space}:"), "path")))
    return Graph(targets.select("id", F.concat(F.lit("target:"), "kind").alias("kind")), targets.select(up.alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind")).distinct())


def display_name(name: Column, index: Column) -> Column:
    """What a target is called: its name, or its place among those of its kind in its file."""
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(index.cast("string"))


def target_id(kind: Column, file: Column, name: Column, index: Column) -> Column:
    return F.concat_ws(":", F.lit("target"), kind, file, display_name(name, index))


def config_rows(targets: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """key, id: every target by ``//file#kind.name``, and every setting (file, name) by ``//file#name``, without an id."""
    key = lambda part: F.concat(F.lit("//"), "file", F.lit("#"), part)
    rows = targets.select(key(F.concat("kind", F.lit("."), display_name(F.col("name"), F.col("index")))).alias("key"), "id")
    return rows if settings is None else rows.union(settings.select(key(F.col("name")), F.lit(None).cast("string")).distinct())


def reserved_keys(settings: DataFrame) -> DataFrame:
    """id, key: what targets (id, key) set though it is reserved."""
    return settings.where(F.col("key").isin(*RESERVED)).select("id", "key").distinct()


def by_kind(targets: DataFrame) -> DataFrame:
    """kind, place, id: the targets of each kind in the order of their files and places, numbered from 0.

    The order is one of all targets, over ranges that Spark deals out; a kind's numbers begin where
    the kind does, so that no task holds a kind and no row a list.
    """
    parts = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["kind", "file", "index", "id"]
    rows = checkpointed(targets.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    placed = rows.join(F.broadcast(offsets), part == F.col("_part")).withColumn("_n", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
    first = placed.groupBy("kind").agg(F.min("_n").alias("_first"))
    return placed.join(first, "kind").select("kind", (F.col("_n") - F.col("_first")).alias("place"), "id")


def in_file(targets: DataFrame) -> DataFrame:
    """id, index, repeats: each target's place among those of its kind in its file, by ``line``, and whether its name repeats there."""
    from pyspark.sql import Window

    own = Window.partitionBy("file", "kind")
    return targets.select("id", (F.row_number().over(own.orderBy("line", "id")) - 1).alias("index"), (F.count("*").over(Window.partitionBy("file", "kind", "name")) > 1).alias("repeats"))
