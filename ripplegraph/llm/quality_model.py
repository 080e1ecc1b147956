"""Quality classifier: averaged vectors of hashed words, word pairs and character n-grams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import free_names, id_remainder, slices, text_of

#: Buckets of features (one more, which is never trained, takes what is no feature), and training.
BUCKETS, DIM, EPOCHS, RATE, SEED = 1 << 17, 8, 12, 0.5, 7
#: Labelled documents of each class that training takes at most, lowest id hash first.
PER_CLASS = 2000
#: Bytes of text whose features are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 18

_U = np.uint64
_BASE, _BACK = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)
#: What the hash of a pair's first word is multiplied by.
_FIRST = 0x9E3779B97F4A7C15
_KINDS = {"word": 1, "pair": 2, 3: 3, 4: 4}


def _bucket(values: np.ndarray, kind) -> np.ndarray:
    """The bucket of each 64-bit value of a kind of feature."""
    h = (values + _U((_KINDS[kind] * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(32)
    h *= _U(0xC4CEB9FE1A85EC53)
    return (h >> _U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a number, modulo 2 ** 64."""
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def hashed(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: buckets in the order of the texts, and where each text's begin.

    Words are divided by white space. The features are each word, each pair of neighbouring
    words, and a word's runs of three and four bytes with a space before and after it. A word's
    hash is a polynomial of its bytes; a pair's is its first word's, times a constant, plus its
    second's, so that order counts. All of a chunk is hashed at once.
    """
    lines = [b" ".join(t.split()) for t in texts]
    data = np.frombuffer(b" " + b" ".join(lines) + b" ", dtype=np.uint8)
    ends = np.cumsum([0] + [len(x) + 1 for x in lines])  # where each text's leading space is
    wide, space = data.astype(_U), data == 32
    out = []
    at = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))  # first bytes of words
    after = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))  # the spaces behind them
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((wide + _U(1)) * _powers(_BASE, len(data)), dtype=_U, out=sums[1:])
    words = (sums[after] - sums[at]) * _powers(_BACK, len(data))[at]
    first = np.searchsorted(at, ends)
    out.append((_bucket(words, "word"), first))
    pair = np.ones(max(0, len(words) - 1), dtype=bool)
    inner = first[(first > 0) & (first < len(words))]
    pair[inner - 1] = False  # across two texts
    places = np.flatnonzero(pair)
    out.append((_bucket(words[places] * _U(_FIRST) + words[places + 1], "pair"), np.searchsorted(places, first)))
    two = wide[:-1] | (wide[1:] << _U(8))
    for n in (3, 4):
        values = two[: len(data) - n + 1] | (two[2:] << _U(16)) if n == 4 else two[: len(data) - 2] | (wide[2:] << _U(16))
        inside = ~space[1 : len(data) - n + 2]
        if n == 4:
            inside = inside & ~space[2 : len(data) - 1]
        places = np.flatnonzero(inside)
        out.append((_bucket(values[places], n), np.searchsorted(places, ends)))
    return out


def chunks(texts: list[bytes]):
    """Slices of the list with about CHUNK bytes each."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield slice(at, i)
            at = i
            size = 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, in order, and how often each occurs."""
    found, times = np.unique(np.concatenate([b for b, _ in hashed([text])]), return_counts=True)
    return found.astype(np.int32), times.astype(np.float32)


def packed(found: np.ndarray, times: np.ndarray) -> bytes:
    """What ``features`` gives: gaps between buckets and counts, each in as few bytes as the largest needs."""
    parts = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (np.diff(found, prepend=np.int32(0)), times)]
    return bytes(x.itemsize for x in parts) + b"".join(x.tobytes() for x in parts)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` was given."""
    gap, time = data[:2]
    n = (len(data) - 2) // (gap + time)
    gaps, times = np.frombuffer(data, f"u{gap}", n, 2), np.frombuffer(data, f"u{time}", n, 2 + n * gap)
    return np.cumsum(gaps, dtype=np.int32), times.astype(np.float32)


class PackedRows(Sequence):
    """Training rows (buckets, counts, label, weight) whose features stay packed until they are asked for."""

    def __init__(self, rows: list[tuple[bytes, int, float]]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int, float]:
        data, y, weight = self.rows[i]
        return (*unpacked(data), y, weight)


@dataclass
class Model:
    """A document's log odds: the mean of its features' weights, plus a bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The softmax output of each text: the probability of label 1."""
        out = []
        for part in chunks(texts):
            total, count = np.zeros(part.stop - part.start), np.zeros(part.stop - part.start)
            for buckets, starts in hashed(texts[part]):
                n = np.diff(starts)
                some = np.flatnonzero(n)
                if len(some):
                    total[some] += np.add.reduceat(self.weights[buckets], starts[some])
                count += n
            z = self.bias + total / np.maximum(count, 1)
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def train(rows: Sequence[tuple[np.ndarray, np.ndarray, int, float]]) -> Model:
    """Softmax over averaged vectors, by stochastic gradient descent; rows: buckets, counts, label, weight.

    The two output rows only matter by their difference, so that afterwards one number per
    bucket scores texts. Features that training never met count as zero. Without rows, or with
    one class, every text gets the smoothed share.
    """
    rng = np.random.default_rng(SEED)
    vectors, met = rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros(BUCKETS, dtype=bool)
    out, bias = np.zeros((2, DIM)), np.zeros(2)
    ones, everything = (sum(w for *_, y, w in rows if y == 1), sum(w for *_, w in rows))
    prior = (ones + 1) / (everything + 2)
    if not rows or ones in (0, everything):
        return Model(np.zeros(BUCKETS), float(np.log(prior / (1 - prior))))
    for b, *_ in rows:
        met[b] = True
    out[1] = rng.normal(0, 0.1, DIM)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            b, c, y, w = rows[i]
            c = c / c.sum() if len(c) else c
            rate = RATE * w * (1 - step / steps)
            step += 1
            mean = c @ vectors[b] if len(b) else np.zeros(DIM)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= 0.1 * rate * p
            if len(b):
                vectors[b] -= (rate * 40) * c[:, None] * back
    return Model(np.where(met, vectors @ (out[1] - out[0]), 0.0), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, modulus: int = 5, per_class: int = PER_CLASS) -> PackedRows:
    """Features of a bounded sample of the labelled rows whose id remainder isn't 0.

    Up to ``per_class`` ids of each label, lowest hash first; a row's weight makes up for the
    share of its class that was taken. Ids with two labels count by the smaller; of rows that
    share an id, the one whose text has the smallest hash counts. So the driver gets the features
    of 2 * ``per_class`` texts at most, each no more than BUCKETS numbers and counts, and keeps
    them packed.
    """
    id_, y_ = free_names(docs, "id", "y")
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (id_remainder("doc_id", modulus) != 0))
        .groupBy(F.col("doc_id").alias(id_))
        .agg(F.min("quality").alias(y_))
    )
    sizes = {r[y_]: r["n"] for r in known.groupBy(y_).agg(F.count("*").alias("n")).collect()}
    pick = [known.where(F.col(y_) == y).orderBy(F.xxhash64(id_), id_).limit(per_class) for y in (0, 1)]
    taken = F.broadcast(pick[0].union(pick[1]))  # 2 * per_class rows of two numbers

    def run(batches):
        for b in slices(batches):
            made = [packed(*features(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["doc_id", "y", "f"])

    texts = docs.join(taken, F.col("doc_id") == F.col(id_)).select(F.col("doc_id").cast("long").alias("d"), F.col(y_).cast("int").alias("y"), text_of().cast("binary").alias("t"))
    texts = texts.groupBy("d", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    got = texts.mapInArrow(run, "doc_id long, y int, f binary").toArrow()
    every = sum(sizes.values())
    share = {y: (sizes[y] / every) / (min(sizes[y], per_class) / (min(sizes.get(0, 0), per_class) + min(sizes.get(1, 0), per_class))) for y in sizes}
    rows = {i: (f, y, share[y]) for i, y, f in zip(*(got.column(k).to_pylist() for k in range(3)), strict=True)}
    return PackedRows([rows[k] for k in sorted(rows)])


def quality_scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (doc_id and text) as doc_id, score, predicted."""

    def run(batches):
        for b in slices(batches):
            scores = model.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("t")).mapInArrow(run, "doc_id long, score double, predicted int")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts have no features and get the bias alone. A null id is held out, as
    crc32 of the empty text is 0. Repeated rows are scored alike; other columns are unread,
    whatever their names. No rows give none. Without usable labels every score is one half.
    """
    model = train(training_rows(docs, labels))
    return quality_scores(docs, model).select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their columns.

    Null and empty texts are judged by the bias alone, repeated rows alike; other columns may have
    any names, very long texts are hashed whole, and no rows give none.
    """
    model, at = train(training_rows(docs, labels)), docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            scores = model.scores([(t or "").encode() for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(scores >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
