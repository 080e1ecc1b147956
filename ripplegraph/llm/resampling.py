"""Importance resampling: documents that look like a target set, by hashed words and word pairs."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from itertools import repeat
from operator import mod
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import broadcast_if_small, slices, text_of, written

BUCKETS = 10_000
#: Digits, letters and all bytes of other characters stay, A-Z as a-z; every other byte is a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at once, and words whose hashes a task remembers.
CHUNK, REMEMBERED = 1 << 20, 200_000


class _Hashes(dict):
    """The crc32 of each word, and of the word with a blank behind it: the seed of its pairs."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        h = crc32(word)
        self[word] = found = (h, crc32(b" ", h))
        return found


def chunks(text: bytes, size: int = CHUNK):
    """The words of a text, by lists of those in about ``size`` bytes each."""
    text = text.translate(TABLE)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        if words := text[at:end].split():
            yield words
        at = end


def features(text: bytes, known: _Hashes, most: int = 2, size: int = CHUNK):
    """The buckets of all runs of 1 to ``most`` words, by lists; the first list of each chunk is of its single words.

    A run's hash goes on from the hash of its first words: the crc32 so far is the seed of the next.
    """
    tails: list[list[int]] = [[] for _ in range(most - 1)]
    for words in chunks(text, size):
        hashes = [known[w] for w in words]
        yield list(map(mod, (h for h, _ in hashes), repeat(BUCKETS)))
        seeds = [s for _, s in hashes]
        for n in range(most - 1):  # runs of n + 2 words: each begins with a run of n + 1, the last of which the chunk before may hold
            before = tails[n] + seeds
            longer = list(map(crc32, words[len(words) + 1 - len(before) :], before)) if len(before) > 1 else []
            yield list(map(mod, longer, repeat(BUCKETS)))
            tails[n] = before[-1:]
            if n + 2 < most:
                seeds = [crc32(b" ", h) for h in longer]


def bucket_counts(df: DataFrame, most: int = 2) -> Counter:
    """How often each bucket occurs in all texts of ``df``: at most BUCKETS numbers, summed by task and then by Spark."""

    def run(batches):
        counts, known = Counter(), _Hashes()
        for b in slices(batches):
            for text in b.column(0):
                for found in features(text.as_py(), known, most):
                    counts.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["bucket", "n"])

    tasks = df.select(text_of().cast("binary").alias("t")).mapInArrow(run, "bucket int, n long")
    return Counter({r["bucket"]: r["n"] for r in tasks.groupBy("bucket").agg(F.sum("n").alias("n")).collect()})


def gains(raw: Counter, target: Counter) -> list[int]:
    """Per bucket: how much likelier it is in the target than in the raw texts, in thousandths of nats."""
    s_all, t_all = sum(raw.values()) + BUCKETS, sum(target.values()) + BUCKETS
    return [math.floor(1000 * math.log((target[b] + 1) * s_all / ((raw[b] + 1) * t_all))) for b in range(BUCKETS)]


def noise(doc_id, seed: int) -> int:
    """A Gumbel variate of the seed and the id, in thousandths; a null id counts as an empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, of_bucket: list[int], seed: int = 7, most: int = 2) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for every row of ``docs``."""
    table = np.array(of_bucket, dtype=np.int64)

    def run(batches):
        known = _Hashes()
        for b in slices(batches):
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n_words = n = total = 0
                for k, found in enumerate(features(text.as_py(), known, most)):
                    n_words += len(found) if k % most == 0 else 0
                    n += len(found)
                    total += int(table[found].sum()) if found else 0
                weight = total // n if n else 0
                out.append((i, n_words, n, weight, weight + noise(i, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, order: list, wanted: int, name: str = "rank") -> DataFrame:
    """``rows`` with their place, from 1, in a global order; null past the first ``wanted``.

    Rows are dealt out by ranges of the order and sorted there; a row's place is what the ranges
    before hold, plus its place in its own. No task sees more than its range.
    """
    row_ = f"_{name}_at"
    dealt = written(rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn(row_, F.monotonically_increasing_id()))
    part, place = F.shiftright(row_, 33), F.col(row_).bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["n"] for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    starts = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    at = F.col("_before") + place + 1
    return dealt.join(broadcast_if_small(starts, len(offsets), 16), part == F.col("_part")).select(*rows.columns, F.when(at <= wanted, at).alias(name))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, most: int = 2) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of ``docs``.

    Counts cover all texts of both tables, and every document is weighed whole. Of the N
    documents with ``least_words`` words, the floor(percent * N / 100) with the highest scores
    are drawn: those have a rank. Ties go to the smaller doc_id, a null id after all others,
    then to the row with fewer features and the smaller weight; rows alike in all of that stand
    in any order. Null and empty texts have no features, weight 0, and are not drawn. Long texts
    are split by parts of a megabyte, up to the next word's end. Other columns of either table
    are unread, whatever their names. No rows give none; an empty
    target table favours what is rare in ``docs``.
    """
    table = gains(bucket_counts(docs, most), bucket_counts(target, most))
    rows = written(weighed(docs, table, seed, most))
    able = F.col("n_words") >= least_words
    wanted = rows.where(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    drawn = ranked(rows.where(able), order, wanted)
    rest = rows.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return drawn.union(rest).select("doc_id", "n_features", "weight", "score", "rank")
