"""Mixing sources to target weights: highest quotients give whole blocks to sources and shards.

DataFrame functions only. Tables of the plan hold a row for each source and shard, at most
``SHARDS`` plus one for each source; documents are shuffled once, to their shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.llm.common import WORD, broadcast_if_small, checkpointed, text_of, written

#: Shards over all sources at most, dealt to each by its size; words that a shard has at
#: least, by expectation; and blocks over the whole mix, or so many for each shard.
SHARDS, SHARD_WORDS, BLOCKS, SHARD_BLOCKS = 1 << 16, 1 << 16, 1 << 16, 64
#: A source's share stops at so many times its own size.
MOST = 3


def word_count() -> Column:
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long")


def _seeded(*parts: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _bucket(seed: int) -> Column:
    return (F.conv(F.substring(_seeded(F.col("doc_id"), seed=seed), 1, 8), 16, 10).cast("long") % SHARDS).cast("int")


def source_targets(sizes: DataFrame, weights: Column | None = None) -> DataFrame:
    """source, source_size, target: shares by weight, stopped at three times a source's size.

    ``sizes`` has source and source_size. Sources in order (null last) weigh 1, 2, 3 and
    again, unless ``weights`` gives a column. What a stopped source leaves is shared again by
    weight: sorted by size over weight, a source stops if the level that the rest would
    reach lies above its own, and all those before it have stopped too.
    """
    every, before = Window.partitionBy(), Window.partitionBy().orderBy("_fill", F.col("source").asc_nulls_last())
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last()))
    rows = (
        sizes.withColumn("_w", weights if weights is not None else ((rank - 1) % 3 + 1).cast("long"))
        .withColumn("_cap", MOST * F.col("source_size"))
        .withColumn("_fill", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_all_w", F.sum("_w").over(every))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_w_before", F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_stops", F.col("_fill") < (F.col("_all") - F.col("_cap_before")) / (F.col("_all_w") - F.col("_w_before")))
    )
    left = F.col("_all") - F.sum(F.when(F.col("_stops"), F.col("_cap")).otherwise(0)).over(every)
    left_w = F.sum(F.when(F.col("_stops"), 0).otherwise(F.col("_w"))).over(every)
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(F.col("_w") * (left / left_w))
    return rows.withColumn("target", target).select("source", "source_size", "target", "_all")


def _seats(rows: DataFrame, keys: list[str], votes: str, whole: Column, seats: Column, parties: Column, group: list[str], order: list) -> DataFrame:
    """``_won``: seats by the highest quotients votes / (2k + 1), within each group.

    Rounding moves the winning divisor by half a seat a party at most. So a party surely wins
    its first k up to a bound, and none past another; only the quotients between the two,
    about four for each party, have to be ranked.
    """
    share = lambda n: F.col(votes) * n / whole
    window = Window.partitionBy(*group)
    open_ = (
        rows.where((F.col(votes) > 0) & (seats > 0))
        .withColumn("_sure", F.greatest(F.lit(0), F.floor(share(seats - parties / 2) - 0.5)).cast("long"))
        .withColumn("_open", seats - F.sum("_sure").over(window))
        .withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.greatest(F.col("_sure"), F.floor(share(seats + parties / 2)) + 1))))
        .withColumn("_quotient", F.col(votes) / (2 * F.col("_k") + 1))
        .withColumn("_place", F.row_number().over(window.orderBy(F.desc("_quotient"), *order)))
    )
    return open_.groupBy(*keys).agg((F.max("_sure") + F.sum((F.col("_place") <= F.col("_open")).cast("long"))).alias("_won"))


def shard_quotas(rows: DataFrame, size: str, seed: int) -> DataFrame:
    """One row per (source, shard): its size, whole passes, and the run of blocks of one more pass.

    ``rows`` has doc_id, source and ``size``. The sources' blocks are shared by highest
    quotients of their targets, then each source's by those of its shards' sizes. A shard is
    cut into equal blocks; it takes its quota as whole passes and as a run of blocks from a
    seeded one on, past the end from the start again, so that few documents are cut.
    """
    cells = checkpointed(rows.groupBy("source", _bucket(seed).alias("_bucket")).agg(F.sum(size).alias("_cell")))
    targets = checkpointed(source_targets(cells.groupBy("source").agg(F.sum("_cell").alias("source_size"))))
    every = Window.partitionBy()
    counted = (
        targets.withColumn("_parts", F.least(F.lit(SHARDS), F.greatest(F.lit(1), F.ceil(F.col("_all") / SHARD_WORDS))))
        .withColumn("_block", F.greatest(F.lit(1), F.ceil(F.col("_all") / F.greatest(F.lit(BLOCKS), SHARD_BLOCKS * F.col("_parts")))))
        .withColumn("_parties", F.count("*").over(every))
        .withColumn("_seats", F.round(F.col("_all") / F.col("_block")).cast("long"))
    )
    won = _seats(counted, ["source"], "target", F.col("_all"), F.col("_seats"), F.col("_parties"), [], [F.col("source").asc_nulls_last()])
    sources = counted.join(won.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_s"),
        "source_size",
        "target",
        "_block",
        F.coalesce("_won", F.lit(0)).cast("long").alias("_source_seats"),
        F.coalesce(F.greatest(F.lit(1), F.ceil(F.col("_parts") * F.col("source_size") / F.col("_all"))), F.lit(1)).alias("_shards"),
    )
    of_source = ["source", "source_size", "target", "_block", "_source_seats", "_shards"]
    shards = checkpointed(
        cells.join(broadcast_if_small(sources, targets.count(), 256), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_shard", F.floor(F.col("_bucket") * F.col("_shards") / SHARDS).cast("int"))
        .groupBy(*of_source, "_shard")
        .agg(F.sum("_cell").alias("_size"))
    )
    seats = _seats(shards, ["source", "_shard"], "_size", F.col("source_size"), F.col("_source_seats"), F.col("_shards"), ["source"], ["_shard"])
    seats = seats.select(F.col("source").alias("_s"), F.col("_shard").alias("_h"), "_won")
    some = lambda c: F.when(F.col("_blocks") > 0, F.expr(c)).otherwise(F.lit(0)).cast("long")
    edge = lambda j: f"(({j}) * _size + _blocks - 1) div _blocks"
    return checkpointed(
        shards.join(seats, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")), "left")
        .withColumn("_blocks", F.when(F.col("_size") > 0, F.greatest(F.lit(1), F.round(F.col("_size") / F.col("_block")))).otherwise(0).cast("long"))
        .withColumn("_quota", F.least(F.coalesce("_won", F.lit(0)), MOST * F.col("_blocks")).cast("long"))
        .withColumn("_draw", F.conv(F.substring(_seeded(F.col("source"), F.col("_shard"), seed=seed), 1, 12), 16, 10).cast("long"))
        .withColumn("_passes", some("_quota div _blocks"))
        .withColumn("_from", some("_draw % _blocks"))
        .withColumn("_to", some("_draw % _blocks + _quota % _blocks"))
        .withColumn("_run_from", some(edge("_from")))
        .withColumn("_run_to", some(f"if(_to > _blocks, _size, {edge('_to')})"))
        .withColumn("_wrap_to", some(f"if(_to > _blocks, {edge('_to - _blocks')}, 0)"))
        .select("source", "source_size", "target", "_shards", "_shard", "_passes", "_run_from", "_run_to", "_wrap_to")
    )


def mixed(rows: DataFrame, size: str, seed: int = 17) -> DataFrame:
    """``rows`` with source_size, target, taken, ``_passes`` and ``_spans`` (start, length in words).

    A shard's documents lie one after another in seeded order. A document is taken whole
    ``_passes`` times, and once more where the shard's run of blocks covers it. Documents
    without words take nothing. The same rows give the same mix.
    """
    quotas = shard_quotas(rows, size, seed)
    n = quotas.count()
    per_source = quotas.select(F.col("source").alias("_s"), F.col("_shards").alias("_own_shards")).distinct()
    q = quotas.drop("_shards").withColumnsRenamed({"source": "_qs", "_shard": "_qh"})
    line = Window.partitionBy("source", "_shard").orderBy("_draw", "doc_id", size).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.join(broadcast_if_small(per_source, n, 64), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_shard", F.floor(_bucket(seed) * F.col("_own_shards") / SHARDS).cast("int"))
        .withColumn("_draw", _seeded(F.col("doc_id"), seed=seed))
        .withColumn("_b", F.sum(size).over(line))
        .withColumn("_a", F.col("_b") - F.col(size))
    )
    joined = placed.join(broadcast_if_small(q, n, 120), F.col("source").eqNullSafe(F.col("_qs")) & (F.col("_shard") == F.col("_qh")))
    spans = F.expr(
        """filter(array(
            struct(greatest(_a, _run_from) - _a AS start, least(_b, _run_to) - greatest(_a, _run_from) AS length),
            struct(0L AS start, least(_b, _wrap_to) - _a AS length)), x -> x.length > 0)"""
    )
    extra = F.aggregate("_spans", F.lit(0).cast("long"), lambda total, s: total + s["length"])
    return (
        joined.withColumn("_spans", spans)
        .withColumn("taken", F.col(size) * F.col("_passes") + extra)
        .drop("_s", "_own_shards", "_shard", "_draw", "_a", "_b", "_qs", "_qh", "_run_from", "_run_to", "_wrap_to")
    )


def mix_sizes(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source, source_size, target, taken: one row per document.

    A null text has size 0 and a null source is a source of its own, the last. Empty tables
    give none, other columns are ignored, and rows that are repeated are mixed one by one.
    """
    sized = written(docs.select("doc_id", "source", word_count().alias("size")))
    return mixed(sized, "size", seed).select("doc_id", "size", "source", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``.

    A document appears once for each whole pass, and once for each span of it that a run of
    blocks covers, cut between words; white space within a span stays as it is. Null and empty texts
    have nothing to take, repeated rows are mixed one by one, other columns may have any names,
    and no rows give none.
    """
    row = docs.select("doc_id", "source", word_count().alias("_words"), F.struct("*").alias("_row"))
    rows, text = mixed(row, "_words", seed), F.col("_row")["text"]
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\x20\x09-\x0D]*" + WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("start"), F.col("_words").alias("length")), F.col("_passes").cast("int"))
    copies = rows.where(F.col("taken") > 0).select("_row", "_words", F.explode(F.concat(whole, "_spans")).alias("_piece"))
    cut = F.when(F.col("_piece.length") == F.col("_words"), text).otherwise(
        F.array_join(F.slice(units, (F.col("_piece.start") + 1).cast("int"), F.col("_piece.length").cast("int")), "")
    )
    made = copies.select("_row", cut.alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return made.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
