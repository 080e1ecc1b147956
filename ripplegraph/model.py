"""Graphs and snapshots as DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Relations that a change travels along, from what depends to what it depends on.
FOLLOWED = ("contains", "depends-on", "imports", "source-file", "tests", "go-version")
#: Spark's setting by which the shuffle files of a query go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class GraphError(ValueError):
    """A graph, a snapshot or a selector that breaks a rule."""


@dataclass(frozen=True)
class Graph:
    """entities (id, kind) and edges (src, dst, kind); parallel edges of other kinds are distinct."""

    entities: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Snapshot:
    """A graph at one time, with a content token (id, token) for the entities that have one."""

    graph: Graph
    tokens: DataFrame | None = None
    followed: tuple[str, ...] = FOLLOWED


def shared_folder(df: DataFrame) -> str:
    """The folder that the cluster shares: the session's ``spark.checkpoint.dir``.

    Only a session on this machine alone may do without; it gets a temporary folder.
    """
    session = df.sparkSession
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir") or session.conf.get("spark.checkpoint.dir", None)
        if not shared and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


class Scratch:
    """Deletes at its end the tables that were written within it, but for those that are kept.

    Kept tables pass to the scope around it, if there is one; outside of all scopes they belong to
    whoever owns the folder.
    """

    _open: list[Scratch] = []

    def __init__(self, df: DataFrame):
        self.session, self.paths, self.kept = df.sparkSession, set(), set()

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch._open.remove(self)
        self._delete(self.paths - self.kept)
        if Scratch._open:
            Scratch._open[-1].paths |= self.kept & self.paths

    def keep(self, *tables: DataFrame) -> None:
        """Marks tables as needed later."""
        self.kept |= {p for t in tables if (p := getattr(t, "_table", None))}

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of this scope that nothing reads any more."""
        gone = {p for t in tables if (p := getattr(t, "_table", None))} & self.paths
        self._delete(gone)
        self.paths -= gone

    def _delete(self, paths) -> None:
        jvm, conf = self.session.sparkContext._jvm, self.session.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def summed(df: DataFrame, *sums: Column) -> tuple[DataFrame, tuple]:
    """``checkpointed``, and sums over the rows that are taken as they are written."""
    seen = Observation()
    table = checkpointed(df.observe(seen, *[c.alias(f"s{k}") for k, c in enumerate(sums)]))
    return table, tuple(seen.get[f"s{k}"] for k in range(len(sums)))


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``checkpointed``, and how many rows it has."""
    table, (n,) = summed(df, F.count(F.lit(1)))
    return table, n


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table in the folder that the cluster shares.

    Unlike a checkpoint of rows, its columns can be read alone and Spark knows its size. Within a
    ``Scratch`` it goes at the end of that, else whoever owns the folder clears it, as with
    checkpoints. What was shuffled to write it goes at once, not when the driver collects garbage.
    """
    path, conf = f"{shared_folder(df)}/tables/{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(SHUFFLES_GO)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(SHUFFLES_GO, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._table = path
    if Scratch._open:
        Scratch._open[-1].paths.add(path)
    return table
