"""Tables of globs against tables of paths, and what the configuration language reads of a snapshot's files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import paths
from ripplegraph.model import counted

#: Tables up to this many patterns go to all tasks; patterns past it are joined, in as many shares.
SENT, SHARES = 100_000, 16

_KEY = ["depth", "heads", "head", "by", "tail"]


def _compiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(p, paths.whole_regex(p), *paths.glob_literals(p)) for p in batch["pattern"]], columns=["pattern", "regex", *_KEY])


def indexed(patterns: DataFrame) -> DataFrame:
    """pattern, regex, and what it states literally, of each distinct pattern; a bad one is an error."""
    shape = "pattern string, regex string, depth int, heads int, head string, by string, tail string"
    return patterns.select("pattern").where("pattern is not null").distinct().mapInPandas(_compiled, shape)


def _candidates(files: DataFrame, shapes: DataFrame) -> DataFrame:
    """Each path once for every shape (depth, heads, by) that some pattern has and that the path could meet."""
    parts = F.split("path", "/")
    own = files.select("path").where("path is not null").distinct().withColumn("_parts", parts).withColumn("_n", F.size("_parts"))
    rows = own.withColumn("depth", F.explode(F.array(F.lit(-1), F.col("_n")))).withColumn("heads", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    rows = rows.withColumn("by", F.explode(F.array(F.lit("any"), F.lit("name"), F.lit("ext")))).join(shapes, ["depth", "heads", "by"], "left_semi")
    name = F.element_at("_parts", -1)
    tail = F.when(F.col("by") == "any", "").when(F.col("by") == "name", name).when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))
    return rows.select("path", "depth", "heads", F.array_join(F.slice("_parts", F.lit(1), F.col("heads")), "/").alias("head"), "by", tail.alias("tail")).where("tail is not null")


def matches(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """path, pattern: which paths (path) each pattern (pattern) matches, each pair once.

    A pattern has one key: its literal head, the last name or its extension, and its depth. A path
    gives the keys of the shapes that some pattern has, so that both meet by an equality, and the
    expression is tried on these pairs only. Past ``SENT`` patterns each is dealt to ``SHARES``
    shares of the paths, as one head may hold a third of all paths. Nulls match nothing, empty
    tables give none, a bad pattern is an error; other columns are left out.
    """
    index, n = counted(indexed(patterns))
    if n <= SENT:
        index, shapes = F.broadcast(index), F.broadcast(index.select("depth", "heads", "by").distinct())
        rows = _candidates(files, shapes).join(index, _KEY)
    else:
        shapes, m = counted(index.select("depth", "heads", "by").distinct())
        share = F.pmod(F.xxhash64("path"), F.lit(SHARES)).cast("int")
        rows = _candidates(files, F.broadcast(shapes) if m <= SENT else shapes).withColumn("_share", share)
        rows = rows.join(index.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), [*_KEY, "_share"])
    return rows.where(F.rlike("path", F.col("regex"))).select("path", "pattern")


def matches_from(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, path: the blobs that each reference (id, dir, value) names, seen from its directory.

    ``//x`` is seen from the root; one that leads to or past the root names nothing.
    """
    asked = wanted.select("id", paths.resolved(F.col("dir"), F.col("value")).alias("pattern")).where("pattern is not null").distinct()
    return _named(files, asked).select("id", "path")


def _named(files: DataFrame, asked: DataFrame) -> DataFrame:
    asked, n = counted(asked)
    return matches(files, asked).join(F.broadcast(asked) if n <= SENT else asked, "pattern")


def escaped(path: Column) -> Column:
    """A path as the pattern that matches nothing else."""
    return F.regexp_replace(path, r"([*?\[\]{}\\])", r"\\$1")


def fileset(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, name: the files below a directory that a pattern matches (id, dir, pattern), seen from there.

    The directory is no pattern, whatever its name holds. Trees are never among the files.
    """
    joined = F.when(F.col("dir") == "", F.col("pattern")).otherwise(F.concat(escaped(F.col("dir")), F.lit("/"), "pattern"))
    asked = wanted.select("id", "dir", joined.alias("pattern")).where("pattern is not null").distinct()
    name = paths.relative(F.col("path"), F.col("dir"))
    return _named(objects.where("kind = 'blob'"), asked).select("id", name.alias("name")).where("name <> ''")


def files_read(wanted: DataFrame, contents: DataFrame) -> DataFrame:
    """id, path, exists, text, base64, problem: what each value (id, file, value) in a declaring file reads.

    Paths are seen from the declaring file's directory. ``contents`` has path and bytes, a path
    once. What leads out of the snapshot, isn't there, or as a text isn't UTF-8 has a problem.
    """
    asked = wanted.select("id", paths.resolved(paths.parent(F.col("file")), F.col("value")).alias("path"))
    held = contents.select("path", "bytes", F.lit(True).alias("_held"))
    rows = asked.join(held, "path", "left").withColumn("_text", F.col("bytes").cast("string"))
    exists, sound = F.col("_held").isNotNull(), F.is_valid_utf8("_text")
    problem = F.when(F.col("path").isNull(), "not a path").when(~exists, "not found").when(~sound, "not UTF-8")
    encoded = F.regexp_replace(F.base64("bytes"), "[\r\n]", "")
    return rows.select("id", "path", exists.alias("exists"), F.when(sound, F.col("_text")).alias("text"), encoded.alias("base64"), problem.alias("problem"))
