"""Small helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.model import shared_folder

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def id_remainder(name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder, for tables of small rows."""
    shared_folder(df)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table in the shared folder, for what is worked out in a scan.

    Tasks without rows leave no file. Whoever owns the folder clears it, as with checkpoints.
    """
    path = f"{shared_folder(df)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """A name for each purpose that no column of the table has, in any case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = 8 << 20) -> DataFrame:
    """Marks a counted table for broadcast where it is surely small; otherwise Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


#: A key is very common if it has one in so many of all rows; there can't be more such keys than that.
COMMON = 256


def joined_by_key(rows: DataFrame, table: DataFrame, same: Column, n: str, total: int) -> DataFrame:
    """Joins rows with a table that has each key once and, in ``n``, how many of the rows have it.

    Very common keys, a bounded number, are sent to the rows, so that the rows of none meet in
    one task; the others are joined as Spark sees fit.
    """
    common = F.broadcast(table.where(F.col(n) * COMMON > total).drop(n))
    others = table.where(F.col(n) * COMMON <= total).drop(n)
    return rows.join(common, same).union(rows.join(common, same, "left_anti").join(others, same))


def slices(batches, rows: int = 500):
    """Arrow batches in slices of few rows, so that a task holds the objects of few texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
