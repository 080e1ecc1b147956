"""Exact duplicates: an immutable snapshot's binary-fuse filters screen a new batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm import binary_fuse
from ripplegraph.llm.common import broadcast_if_small, checkpointed, free_names, joined_by_key, lower_ascii, text_of, written

_FILTER = "_shard int, seed int, segment int, count int, table binary"
_HIT = "_digest binary, _inc_id long, _inc_n long"


def _keys(digests) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d[:8]) for d in digests), dtype=">u8").astype(np.uint64)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    made = binary_fuse.build(_keys(pdf["_digest"]))
    return pd.DataFrame([{"_shard": pdf["_shard"].iloc[0], **made}])


def _screen(filters: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    columns = ["_digest", "_inc_id", "_inc_n"]
    if not len(filters) or not len(batch):
        return batch[columns].iloc[:0]
    return batch.loc[binary_fuse.contains(filters.iloc[0].to_dict(), _keys(batch["_digest"])), columns]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, SHA-256 of the text with A-Z lower-cased (null: empty), and the side it is on.

    Half of the ids, by hash, are the immutable snapshot and the other half the new batch.
    """
    return docs.select(
        F.col("doc_id"),
        F.unhex(F.sha2(lower_ascii(text_of()), 256)).alias("_digest"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).alias("_new"),
    )


def duplicate_groups(docs: DataFrame, shard_keys: int = 1 << 17) -> tuple[DataFrame, DataFrame]:
    """The digests of all rows, and one row per digest and side (``_d``, ``_s``): keep_id, group_size, the side's rows ``_n``.

    Rows of one digest are summed before any shuffle, so that a group of any size is one
    row afterwards. Distinct digests are spread evenly over shards of about ``shard_keys``;
    each shard of the snapshot gets one static filter, which its own shard of the batch
    meets. Digests that the filter rules out are new for sure and go no further; the others
    join the snapshot's bucket by whole digest, and the bytes of the two texts are compared.
    """
    rows = written(digests(docs))
    sums = checkpointed(rows.groupBy("_digest", "_new").agg(F.max("doc_id").alias("_id"), F.count("*").alias("_n")))
    shards = max(1, -(-sums.count() // shard_keys))
    shard = F.pmod(F.xxhash64("_digest"), F.lit(shards)).cast("int").alias("_shard")
    old = sums.where(~F.col("_new")).select("_digest", F.col("_id").alias("_old_id"), F.col("_n").alias("_old_n"))
    new = sums.where("_new").select("_digest", F.col("_id").alias("_inc_id"), F.col("_n").alias("_inc_n"))

    filters = old.select("_digest", shard).groupBy("_shard").applyInPandas(_build, _FILTER)
    positives = filters.groupBy("_shard").cogroup(new.select("*", shard).groupBy("_shard")).applyInPandas(_screen, _HIT)
    same = checkpointed(positives.join(old, "_digest"))

    n_same = same.count()
    wanted = same.select("_digest", F.explode(F.array("_old_id", "_inc_id")).alias("_rep")).distinct()
    d = docs.select(F.col("doc_id").alias("_doc"), lower_ascii(text_of()).alias("_text"))
    texts = (
        d.join(broadcast_if_small(wanted, 2 * n_same, 64), F.col("_doc").eqNullSafe(F.col("_rep")))
        .where(F.unhex(F.sha2("_text", 256)) == F.col("_digest"))
        .groupBy("_digest")
        .agg(F.min("_text").alias("_low"), F.max("_text").alias("_high"))
        .where(F.col("_low") == F.col("_high"))
        .select("_digest")
    )
    merged = same.join(texts, "_digest", "left_semi").select(
        "_digest",
        F.greatest("_old_id", "_inc_id").alias("_both_id"),
        (F.col("_old_n") + F.col("_inc_n")).alias("_both_n"),
    )
    groups = sums.join(merged, "_digest", "left").select(
        F.col("_digest").alias("_d"), F.col("_new").alias("_s"), F.coalesce("_both_id", "_id").alias("keep_id"), F.coalesce("_both_n", "_n").alias("group_size"), "_n"
    )
    return rows, groups


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows with what is known of their group; rows of a very common text don't meet in one task."""
    same = (F.col("_digest") == F.col("_d")) & (F.col("_new") == F.col("_s"))
    return joined_by_key(rows, written(groups), same, "_n", rows.count())


def exact_duplicates(docs: DataFrame, shard_keys: int = 1 << 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty.
    The row with the largest doc_id stays. Rows repeated with that very id all say kept,
    as nothing tells them apart. A null id is smaller than any other; a group of null ids
    alone has a null keep_id and is kept. Other columns are ignored; no rows give none.
    """
    rows, groups = duplicate_groups(docs, shard_keys)
    return _with_groups(rows, groups).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with their columns.

    The dropped rows, known by id and digest, are taken out; the texts of the others only
    move where that list is too long to be sent to every task. Where rows with one id and
    one text are repeated, one of them stays. Null texts count as empty, null ids as the
    smallest; other columns may have any names, and no rows give none.
    """
    rows, groups = duplicate_groups(docs)
    seen = _with_groups(rows, groups)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    id_, d_ = free_names(docs, "id", "d")
    named = [F.col("doc_id").alias(id_), F.col("_d").alias(d_)]
    out = checkpointed(seen.where(~stays).select(*named).distinct())
    twice = checkpointed(seen.where(stays).groupBy(*named).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    n_out, n_twice = out.count(), twice.count()
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.unhex(F.sha2(lower_ascii(text_of()), 256)) == F.col(d_))
    left = docs.join(broadcast_if_small(out, n_out, 64), same, "left_anti")
    if not n_twice:
        return left
    marked = broadcast_if_small(twice, n_twice, 64)
    return left.join(marked, same, "left_anti").union(left.join(marked, same, "left_semi").dropDuplicates(["doc_id", "text"]))
