"""A cascade of Bloom filters: exact membership over a known universe of keys, without joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplegraph.llm.common import checkpointed, free_names

#: Bits for each key of a level, hashes of each key, and keys of a shard by expectation.
BITS, HASHES, SHARD_KEYS = 10, 5, 1 << 17
#: Bytes of filters that are sent to every executor; beyond them a shard's rows go to so many tasks.
BROADCAST, SALTS = 32 << 20, 64

_SHARD = "_shard int, levels array<binary>"


def _places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Slots of each 64-bit key in a level, by double hashing with a salt for the level."""
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (keys ^ salt) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(29)
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(bits) for k in range(HASHES)])


def _has(level: bytes, keys: np.ndarray, depth: int) -> np.ndarray:
    table = np.frombuffer(level, dtype=np.uint8)
    at = _places(keys, depth, 8 * len(table))
    return ((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def build(listed: np.ndarray, others: np.ndarray) -> list[bytes]:
    """Levels in turn for the listed keys and for those that pass the level before in error.

    The last level lets no key of the universe pass in error, so that every key of the
    universe gets its true answer. The two sets must be disjoint.
    """
    levels, inside, outside = [], np.unique(listed), np.unique(others)
    while len(inside):
        size = max(1, -(-len(inside) * BITS // 8))
        table = np.zeros(8 * size, dtype=np.uint8)
        table[_places(inside, len(levels), 8 * size).ravel()] = 1
        levels.append(np.packbits(table, bitorder="little").tobytes())
        passed = outside[_has(levels[-1], outside, len(levels) - 1)]
        inside, outside = passed, inside
    return levels


def contains(levels: list[bytes], keys: np.ndarray) -> np.ndarray:
    """A key is listed if the first level that lacks it is an odd one (or, of none, by parity)."""
    answer, open_ = np.zeros(len(keys), dtype=bool), np.ones(len(keys), dtype=bool)
    for depth, level in enumerate(levels):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        hit = _has(level, keys[at], depth)
        answer[at[~hit]] = depth % 2 == 1
        open_[at[~hit]] = False
        answer[at[hit]] = depth % 2 == 0
    return answer


def key_hash(keys) -> np.ndarray:
    """64 bits of each key; a null is a key that no text equals."""
    return np.array([xxhash.xxh64_intdigest(b"\xff" if k is None else k) for k in keys], dtype=np.uint64)


def _shard_of(c: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")


def cascade(universe: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The cascade of every shard of the universe, and the number of shards.

    ``universe`` has distinct keys (``key``, ``listed``). A shard's keys are about
    ``shard_keys`` however many there are, and its levels depend on no other shard's.
    Keys whose 64-bit hashes agree, one of them listed, can't be told apart: an error.
    """
    shards = max(1, -(-universe.count() // shard_keys))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, listed = key_hash(pdf["key"]), pdf["listed"].to_numpy(dtype=bool)
        if np.intersect1d(h[listed], h[~listed]).size:
            raise ValueError("a listed key and another share their hash")
        return pd.DataFrame({"_shard": [pdf["_shard"].iloc[0]], "levels": [build(h[listed], h[~listed])]})

    return universe.select("key", "listed", _shard_of("key", shards).alias("_shard")).groupBy("_shard").applyInPandas(run, _SHARD), shards


def _asked(filters: dict, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
    answer = np.zeros(len(keys), dtype=bool)
    for s in np.unique(shard):
        at = np.flatnonzero(shard == s)
        answer[at] = contains(filters.get(int(s), []), keys[at])
    return answer


def with_membership(rows: DataFrame, key: str, out: str, universe: DataFrame, shard_keys: int = SHARD_KEYS, limit: int = BROADCAST) -> DataFrame:
    """``rows`` with the boolean ``out``: whether the key is listed; exact for keys of the universe.

    The filters, some ten bits for a listed key, are sent to the executors while they stay
    under ``limit`` bytes. Past that rows are dealt out by shard, each shard over SALTS tasks
    that its filter goes to as well, so that no key's rows meet in one task and rows are read once.
    """
    made, shards = cascade(universe, shard_keys)
    made = checkpointed(made)
    size = made.select(F.sum(F.aggregate("levels", F.lit(0), lambda n, x: n + F.octet_length(x)))).first()[0] or 0
    (shard,) = free_names(rows, "shard")
    numbered = rows.withColumn(shard, _shard_of(key, shards))
    if size > limit:
        return _routed(numbered, key, out, made, shard).select(*rows.columns, out)
    sent = rows.sparkSession.sparkContext.broadcast({r["_shard"]: r["levels"] for r in made.collect()})

    @F.pandas_udf("boolean")
    def member(keys: pd.Series, of: pd.Series) -> pd.Series:
        return pd.Series(_asked(sent.value, key_hash(keys), of.to_numpy()))

    return numbered.withColumn(out, member(F.col(key), F.col(shard))).drop(shard)


def _routed(rows: DataFrame, key: str, out: str, made: DataFrame, shard: str) -> DataFrame:
    """Each task sees a shard's filter and then, batch by batch, the rows dealt out to it."""
    salt, place, levels = free_names(rows, "salt", "place", "levels")
    columns = rows.columns
    salted = rows.select("*", F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int").alias(salt), F.lit(1).alias(place), F.lit(None).cast("array<binary>").alias(levels))
    filters = made.select(
        *[F.col("_shard").alias(c) if c == shard else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns],
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt), F.lit(0).alias(place), F.col("levels").alias(levels),
    )
    dealt = filters.union(salted).repartition(shard, salt).sortWithinPartitions(shard, salt, place)
    at = [dealt.columns.index(c) for c in (key, shard, place, levels)]

    def run(batches):
        now, known = None, []
        for b in batches:
            keys, of, kind, sent = (b.column(k) for k in at)
            shards, rows_at, answer = of.to_numpy(), kind.to_numpy() == 1, np.zeros(b.num_rows, dtype=bool)
            cuts = np.flatnonzero(~rows_at).tolist()
            for k, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, b.num_rows], strict=True)):
                if k:
                    now, known, lo = shards[lo], sent[lo].as_py(), lo + 1
                if hi > lo:
                    answer[lo:hi] = contains(known, key_hash(keys.slice(lo, hi - lo).to_pylist())) & (shards[lo:hi] == now)
            left = pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(answer)], names=[*columns, out])
            yield left.filter(pa.array(rows_at))

    return dealt.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.BooleanType())]))
