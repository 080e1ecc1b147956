"""Revisions of a Git repository as objects (path, kind, oid, source), and their entity graph."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions.paths import ancestors, parent
from ripplegraph.model import Graph, GraphError

OBJECTS = "path string, kind string, oid string, source string"


def parsed_listing(lines: DataFrame) -> DataFrame:
    """Objects from the lines (value) of a recursive tree listing.

    A line is mode, type and id, a tab, and the path. Types other than blob and tree, and ids
    other than 40 hex digits that aren't all zero, are errors.
    """
    head, path = F.substring_index("value", "\t", 1), F.regexp_replace("value", "^[^\t]*\t", "")
    part = F.split(head, " ")
    good = F.contains(F.col("value"), F.lit("\t")) & (F.size(part) == 3) & part[1].isin("blob", "tree") & part[2].rlike("^[0-9a-f]{40}$") & ~part[2].rlike("^0+$")
    checked = F.when(good, path).otherwise(F.raise_error(F.concat(F.lit("bad listing line: "), F.col("value"))))
    return lines.select(checked.alias("path"), part[1].alias("kind"), part[2].alias("oid"), F.lit("git").alias("source"))


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def revision(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    """The objects of a revision, listed by git on the driver; for listings in files use ``parsed_listing``."""
    if not repo or not ref:
        raise GraphError("a repository and a revision are needed")
    out = _git(repo, "-c", "core.quotePath=false", "ls-tree", "-r", "-t", "--full-tree", ref).decode()
    return parsed_listing(spark.createDataFrame([(x,) for x in out.splitlines()], "value string"))


def contents(spark: SparkSession, repo: str, ref: str, paths: list[str]) -> DataFrame:
    """path, bytes of some blobs of a revision, one after another; of a checkout use Spark's binaryFile."""
    rows = [(p, bytearray(_git(repo, "cat-file", "blob", f"{ref}:{p}"))) for p in paths]
    return spark.createDataFrame(rows, "path string, bytes binary")


def is_dirty(repo: str) -> bool:
    return bool(_git(repo, "status", "--porcelain", "-z", "--untracked-files=normal"))


def blob_id(content: Column) -> Column:
    """The id that Git gives a blob with these bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content))


def overlaid(objects: DataFrame, edits: DataFrame, deleted: DataFrame) -> DataFrame:
    """Objects after edits (path, bytes) and deletions (path) of files or whole trees.

    Trees that hold no blob any more go too, and trees that edits need are added.
    """
    gone = deleted.select(F.col("path").alias("_gone"))
    above = lambda df: df.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("_gone"))
    lost = above(objects).join(gone, "_gone", "left_semi").select("path").distinct()
    new = edits.select("path", F.lit("blob").alias("kind"), blob_id(F.col("bytes")).alias("oid"), F.lit("worktree").alias("source"))
    left = objects.join(lost, "path", "left_anti").join(new, "path", "left_anti").unionByName(new)
    return with_trees(left)


def with_trees(objects: DataFrame) -> DataFrame:
    """The blobs, and each tree above one: as listed, or made up with an id of zeros."""
    blobs = objects.where("kind = 'blob'")
    needed = blobs.select(F.explode(ancestors(F.col("path"))).alias("path"), F.col("source").alias("_source")).where("path <> ''").groupBy("path").agg(F.max("_source").alias("_source"))
    listed = objects.where("kind = 'tree'")
    trees = needed.join(listed, "path", "left").select("path", F.lit("tree").alias("kind"), F.coalesce("oid", F.lit("0" * 40)).alias("oid"), F.coalesce("source", "_source").alias("source"))
    return blobs.unionByName(trees)


def blobs_named(objects: DataFrame, name: str) -> DataFrame:
    return objects.where((F.col("kind") == "blob") & (F.substring_index("path", "/", -1) == name)).select("path").orderBy("path")


def object_graph(objects: DataFrame, space: str = "git") -> Graph:
    """An entity for the root and each object, held by the tree above it."""
    id_ = lambda c: F.concat(F.lit(f"{space}:"), c)
    root = objects.sparkSession.range(1).select(F.lit(f"{space}:").alias("id"), F.lit(f"{space}:tree").alias("kind"))
    entities = root.union(objects.select(id_(F.col("path")), F.concat(F.lit(f"{space}:"), F.col("kind"))))
    edges = objects.select(id_(parent(F.col("path"))).alias("src"), id_(F.col("path")).alias("dst"), F.lit("contains").alias("kind"))
    return Graph(entities, edges)


def object_tokens(objects: DataFrame, space: str = "git") -> DataFrame:
    """id, token: what an object is and its Git id; none for made-up trees."""
    known = objects.where(F.col("oid") != "0" * 40)
    return known.select(F.concat(F.lit(f"{space}:"), F.col("path")).alias("id"), F.concat_ws(":", F.concat(F.lit("git-"), F.col("kind")), "oid").alias("token"))
