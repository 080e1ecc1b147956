"""Packing tokens into windows that all hold the sources in target proportions."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import islice
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.llm.common import broadcast_if_small, checkpointed, slices, text_of, written

WINDOW, END = 4096, 2
#: Words whose ids a worker remembers as they stand, and a fifth more without what they end
#: with: some 200 bytes each.
REMEMBERED = 500_000
#: Longer words, in bytes, are not remembered, so that texts without white space don't fill a worker.
LONGEST = 64


@dataclass
class Phase:
    """Windows from ``first`` on that share one set of rates; ``ends`` sums them over sources.

    ``taken`` is what each source has given before. By the end of window w of the phase the
    first j sources together have given floor((w + 1) * ends[j]): each source's deficit, the
    part of its quantum that it couldn't spend, stays under a token and is carried on.
    """

    first: int
    windows: int
    ends: list[float]
    taken: list[int]


@dataclass
class Schedule:
    """Deficit round-robin over source queues, in closed form, for queues of known lengths."""

    sources: list
    lengths: list[int]
    weights: list[float] | None = None
    window: int = WINDOW
    phases: list[Phase] = field(default_factory=list)

    def __post_init__(self) -> None:
        wants = np.array(self.weights if self.weights is not None else self.lengths, dtype=float)
        wants = np.where(wants > 0, wants, 1e-9)
        queues = self._pooled(self.window * wants / wants.sum() if len(wants) else wants)
        self._place = {s: (q, sum(self.lengths[x] for x in queue[:k])) for q, queue in enumerate(queues) for k, s in enumerate(queue)}
        left = np.array([sum(self.lengths[s] for s in queue) for queue in queues], dtype=np.int64)
        wants = np.array([sum(wants[s] for s in queue) for queue in queues])
        taken, first = np.zeros(len(left), dtype=np.int64), 0
        while left.sum() > 0:
            live = left > 0
            wants_now = np.where(live, wants, 0)
            rates = self.window * wants_now / wants_now.sum()
            ends = np.concatenate([[0.0], np.cumsum(rates)])
            ends[np.flatnonzero(live)[-1] + 1 :] = self.window
            rates = np.diff(ends)
            n = int(np.floor((left[live] - 1) / rates[live]).min())
            if n < 1:  # a queue runs dry in this window: the others fill its place by weight
                n, ends = 1, np.concatenate([[0], np.cumsum(self._last(left, wants_now))]).astype(float)
            self.phases.append(Phase(first, n, ends.tolist(), taken.tolist()))
            given = np.diff(np.floor(n * ends)).astype(np.int64)
            taken, left, first = taken + given, left - given, first + n
        self._starts = [[p.taken[q] for p in self.phases] for q in range(len(left))]

    @staticmethod
    def _pooled(rates: np.ndarray) -> list[list[int]]:
        """Sources with under a token a window share a queue, one after another; others have their own.

        A queue with a token a window or more never has to give one back.
        """
        queues, pool, least = [[int(s)] for s in np.flatnonzero(rates > 1 + 1e-6)], [], 1 + 1e-6
        for s in np.flatnonzero(rates <= least).tolist():
            pool.append(s)
            if rates[pool].sum() > least:
                queues.append(pool)
                pool = []
        if pool and queues:
            queues[-1].extend(pool)
        elif pool:
            queues.append(pool)
        return queues

    def _last(self, left: np.ndarray, wants: np.ndarray) -> np.ndarray:
        quota, room = np.zeros(len(left), dtype=np.int64), min(self.window, int(left.sum()))
        while room > 0:
            open_ = np.flatnonzero(quota < left)
            share = wants[open_] / wants[open_].sum() * room
            give = np.minimum(np.maximum(np.floor(share), 0).astype(np.int64), (left - quota)[open_])
            short = (left - quota)[open_] <= share + 1
            give[short] = np.minimum((left - quota)[open_][short], room)
            if give.sum() > room:
                give = np.minimum(give, np.maximum(0, room - np.concatenate([[0], np.cumsum(give)[:-1]])))
            if not give.sum():
                give[: min(room, len(give))] = 1
            quota[open_] += give
            room -= int(give.sum())
        return quota

    def pieces(self, source: int, at: int, until: int):
        """(position in the queue, length, window, offset) of the queue's tokens from at to until."""
        q, base = self._place[source]
        starts = self._starts[q]
        while at < until:
            p = self.phases[bisect_right(starts, at + base) - 1]
            lo, hi, y = p.ends[q], p.ends[q + 1], at + base - p.taken[q]
            given = lambda w: floor(w * hi) - floor(w * lo)  # noqa: E731, B023
            w = min(p.windows - 1, max(0, int(y / (hi - lo))))
            while w and given(w) > y:
                w -= 1
            while given(w + 1) <= y:
                w += 1
            n = min(until - at, given(w + 1) - y)
            offset = floor((w + 1) * lo) - floor(w * lo) + y - given(w)
            yield at, n, p.first + w, offset
            at += n


class WordIds(dict):
    """Ids of a word as bytes, from a tokenizer that never joins text across white space.

    Most new words are known ones in another case or before other punctuation. Where the
    tokenizer always cuts between a letter and such marks, and lower-cases, a word's ids are
    those of its lower-cased core and of its end, one after the other.
    """

    ENDS = b",.!?*#$%&;:)|"

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.most, self.most_cores = remembered, remembered * 6 // 5
        self.tokenizer, self.cores = Tokenizer.from_file(path), {}
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.letters, self.code = "", "H" if self.kind == "<u2" else "I"
        self.lowers = self._ids(b"AbC") == self._ids(b"abc")
        cut, normal = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        if cut is not None:
            # letters that stay in the word they stand in, and what the model gets for each
            pieces = lambda x: [y for y, _ in cut.pre_tokenize_str(normal.normalize_str(x) if normal is not None else x)]
            latin = [c for c in map(chr, range(0x61, 0x250)) if c.isalpha() and (c.islower() or not self.lowers) and len(pieces(c)) == 1]
            good = [c for c in latin if pieces(f"a{c}b{c}") == [pieces("a")[0] + pieces(c)[0] + pieces("b")[0] + pieces(c)[0]]]
            self.letters, self.table = "".join(good), {ord(c): pieces(c)[0] for c in good}
        self.cuts = cut is not None and all([x for x, _ in cut.pre_tokenize_str(f"a{e}")] == ["a", e] for e in self.ENDS.decode())

    def _ids(self, word: bytes) -> bytes:
        text = word.decode()
        if self.letters and not text.strip(self.letters):  # nothing to cut
            return array(self.code, [t.id for t in self.tokenizer.model.tokenize(text.translate(self.table))]).tobytes()
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _core(self, word: bytes) -> bytes:
        got = self.cores.get(word)
        if got is None:
            self.new = True
            if len(word) > LONGEST:
                return self._ids(word)
            if len(self.cores) >= self.most_cores:
                for k in list(islice(self.cores, self.most_cores // 2)):
                    del self.cores[k]
            self.cores[word] = got = self._ids(word)
        return got

    def __missing__(self, word: bytes) -> bytes:
        self.new = False
        whole = word.lower() if self.lowers else word
        core = whole.rstrip(self.ENDS) if self.cuts else whole
        if core[-1:].isalpha():
            got = self._core(core) + (self._core(whole[len(core) :]) if len(core) < len(whole) else b"")
        else:
            got = self._core(whole)
        if not self.new and len(word) <= LONGEST:  # most words that are seen for the first time are never seen again
            if len(self) >= self.most:
                self.clear()
            self[word] = got
        return got

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_WORKER: dict[tuple, WordIds] = {}


def word_ids(path: str, remembered: int = REMEMBERED) -> WordIds:
    """The tokenizer with what this worker process remembers of earlier tasks."""
    if (path, remembered) not in _WORKER:
        _WORKER[path, remembered] = WordIds(path, remembered)
    return _WORKER[path, remembered]


def tokenized(docs: DataFrame, tokenizer: str, end: int = END, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, source, part, at, n, ids: ``at`` is the row's place in its source's tokens of that part.

    A text's ids are those of its white-space separated words, one after another, which is
    what the tokenizer gives for the whole text; ``end`` closes each document.
    """

    def run(batches):
        from pyspark import TaskContext

        words, part, sums = word_ids(tokenizer, remembered), TaskContext.get().partitionId(), {}
        stop = np.array([end], dtype=words.kind).tobytes()
        width = len(stop)
        for b in slices(batches):
            texts, sources, ids, at, n = b.column(2).to_pylist(), b.column(1).to_pylist(), [], [], []
            for text, source in zip(texts, sources, strict=True):
                got = words.encode(text) + stop
                ids.append(got)
                n.append(len(got) // width)
                at.append(sums.get(source, 0))
                sums[source] = at[-1] + n[-1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "source", "part", "at", "n", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text_of().cast("binary").alias("t")).mapInArrow(
        run, "doc_id long, source string, part int, at long, n long, ids binary"
    )


def packed(docs: DataFrame, tokenizer: str, weights: dict | None = None, window: int = WINDOW, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    Each window gives every source its quantum, window times its share of the weights (by
    default of the tokens, which empties all queues together); what is left over is carried to
    later windows, whichever partition fills them. Where a queue is dry the others take its
    place by weight. Only the last window is shorter than ``window``.

    A source's queue is its documents in the order of their partitions. Partitions are
    tokenized once, into a table; the queue's totals by partition are then summed, and
    each row's pieces follow from its own place alone, so that no queue is walked and no
    tokens are shuffled. The schedule holds a few numbers for each source. Null texts give the
    end mark alone, null sources are one source, repeated rows are packed one by one, and
    no rows give none.
    """
    rows = written(tokenized(docs, tokenizer, remembered=remembered))
    sums = checkpointed(rows.groupBy("source", "part").agg(F.sum("n").alias("_n")))
    totals = sums.groupBy("source").agg(F.sum("_n").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    sources = [r["source"] for r in totals]
    plan = Schedule(sources, [r["n"] for r in totals], None if weights is None else [weights.get(s, 0) for s in sources], window)
    index = {s: i for i, s in enumerate(sources)}
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("_s"), F.col("part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))

    def run(batches):
        for b in slices(batches):
            out = []
            for doc_id, source, start, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                whole = memoryview(np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes())
                for at, length, sequence, offset in plan.pieces(index[source], start, start + n):
                    k = at - start
                    out.append((doc_id, k, length, zlib.crc32(whole[4 * k : 4 * (k + length)]), n, sequence, offset, source))
            columns = [pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    placed = rows.join(broadcast_if_small(bases, sums.count(), 96), F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
    return placed.select("doc_id", "source", (F.col("_base") + F.col("at")).alias("_start"), "n", "ids").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    )
