"""Context-tree weighting over bytes: every byte is eight binary choices, each with a tree of its own."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import checkpointed, id_remainder, lower_ascii, slices, text_of, written

#: Bytes of context, and those by which the trees are dealt out: a group's nodes lie below one pair of bytes.
DEPTH, DEALT = 5, 2
#: Bytes that UTF-8 never has: before a text, and after it.
BEFORE, AFTER = b"\xfe", b"\xff"
#: Bytes of text whose contexts are sorted at once, and distinct contexts that a task holds back.
CHUNK, HELD = 4 << 20, 3 << 20
#: A score's unit is so small a part of ln: sums of whole numbers are the same in any order.
UNIT = 1 << 22
#: Bytes of text in a group that asks for its grams' scores at once, by expectation.
ASKED = 32 << 20
#: Grams (12 bytes each) and frequent words that are sent to all executors; beyond them, joins.
SENT_GRAMS, SENT_WORDS, SENT_WORD_BYTES = 5_000_000, 1 << 17, 64
#: Grams that are weighted together, by expectation.
GROUP_GRAMS = 200_000
#: What the word model adds to each count.
ADDED = 0.1

_LN2, _LN10 = float(np.log(2)), float(np.log(10))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x of a half or more: recurrence up to 8, then Stirling's series."""
    x, down = np.array(x, dtype=float), np.zeros(np.shape(x))
    while (low := x < 8).any():
        down[low] += np.log(x[low])
        x[low] += 1
    r = 1 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - down


def kt_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones, in any order."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1.0)


def weighted(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability of nodes, and the posterior weight of stopping at each."""
    own = kt_block(a, b)
    both = np.logaddexp(own, below) - _LN2
    return both, np.exp(own - _LN2 - both)


def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte of each text and its end, and where each text's numbers begin.

    From the top: the byte before, the one before that, and so on, and the byte itself last,
    so that contexts with the same nearest bytes are neighbours in order.
    """
    line = np.frombuffer(b"".join(x for t in texts for x in (BEFORE * DEPTH, t, AFTER)), dtype=np.uint8)
    wide, n = line.astype(np.uint64), len(line) - DEPTH
    keys = wide[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        keys |= wide[DEPTH - k : DEPTH - k + n] << np.uint64(8 * (DEPTH + 1 - k))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return keys[line[DEPTH:] != BEFORE[0]], starts


def chunks(texts: list[bytes]):
    """Slices of the list with about CHUNK bytes each; a longer text is a slice of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def _runs(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs (or the sums of counts)."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=int)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def corpus_counts(docs: DataFrame, modulus: int) -> DataFrame:
    """word, gram, n: how often each word and each gram occurs in the training texts.

    Grams of the held-out texts are listed too, if only with a count of 0. A row has a word or
    a gram. Each task adds up what it reads before anything is shuffled.
    """

    def run(batches):
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            if words:
                w, n = list(words), list(words.values())
                yield [pa.array(w, pa.binary()), pa.nulls(len(w), pa.int64()), pa.array(n, pa.int64())]
            words.clear()
            if held:
                k, n = _runs(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                yield [pa.nulls(len(k), pa.binary()), pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))]
            held.clear()

        names = ["word", "gram", "n"]
        for b in slices(batches):
            texts, learn = b.column(1).to_pylist(), np.array(b.column(0).to_pylist(), dtype=bool)
            for part, counted in (([t for t, x in zip(texts, learn, strict=True) if x], True), ([t for t, x in zip(texts, learn, strict=True) if not x], False)):
                for s in chunks(part):
                    keys, n = _runs(gram_keys(part[s])[0])
                    held.append((keys, n if counted else np.zeros_like(n)))
                    if counted:
                        for t in part[s]:
                            words.update(t.split())
                    if len(held) > 1 and sum(len(k) for k, _ in held) > HELD:
                        k, n = _runs(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                        held[:] = [(k, n)]
                    if len(held[0][0]) > HELD // 2 or len(words) > 500_000:
                        for columns in flush():
                            yield pa.RecordBatch.from_arrays(columns, names=names)
        for columns in flush():
            yield pa.RecordBatch.from_arrays(columns, names=names)

    learn = id_remainder("doc_id", modulus) != 0
    rows = docs.select(learn.alias("l"), lower_ascii(text_of()).cast("binary").alias("t"))
    return rows.mapInArrow(run, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """The words with counts from a bound up, that at most ``most`` words reach.

    The bound comes from a histogram with eight steps in each doubling, so that no task and
    no driver ever sorts the vocabulary.
    """
    short, step = words.where(F.octet_length("word") <= SENT_WORD_BYTES), F.floor(8 * F.log2(F.greatest("n", F.lit(1)))).cast("int")
    bound, taken = 1 << 30, 0
    for r in short.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        taken += r["words"]
        if taken > most:
            break
        bound = r["step"]
    return short.where(step >= bound).select("word", "n")


def _bit(byte: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a byte's j-th choice: which of the 255 trees it is in, and the bit."""
    return (np.uint64(1 << j) | (byte >> np.uint64(8 - j))), ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)


def _levels(keys: np.ndarray, counts: np.ndarray, j: int) -> list[tuple]:
    """Nodes of the j-th choice's trees, from the longest context up to DEALT bytes.

    Each level: node numbers in order, zeros, ones, ln of the weighted probability, stop weight.
    """
    byte = keys & np.uint64(0xFF)
    tree, bit = _bit(byte, j)
    node, out = ((keys >> np.uint64(8)) << np.uint64(8)) | tree, []
    node, back = np.unique(node, return_inverse=True)
    a, b = (np.bincount(back, weights=counts * (bit == x), minlength=len(node)) for x in (0, 1))
    log_w, stop = kt_block(a, b), np.ones(len(node))
    out.append((node, a, b, log_w, stop))
    for _ in range(DEPTH - DEALT):
        node, back = np.unique(((node >> np.uint64(16)) << np.uint64(8)) | (node & np.uint64(0xFF)), return_inverse=True)
        a, b, below = (np.bincount(back, weights=x, minlength=len(node)) for x in (a, b, log_w))
        log_w, stop = weighted(a, b, below)
        out.append((node, a, b, log_w, stop))
    return out


def _dealt(groups: int):
    """Whole subtrees, each below a pair of bytes, dealt out to groups of about equal size."""
    return F.pmod(F.xxhash64(F.shiftrightunsigned("gram", 8 * (DEPTH + 1 - DEALT))), F.lit(groups)).alias("_c")


def tops(grams: DataFrame, groups: int) -> DataFrame:
    """Per last byte and tree: zeros, ones and the sum of ln of the weighted probabilities below."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["n"] > 0]
        keys, n, parts = pdf["gram"].to_numpy().astype(np.uint64), pdf["n"].to_numpy(), []
        for j in range(8):
            node, a, b, log_w, _ = _levels(keys, n, j)[-1]
            parts.append(pd.DataFrame({"last": (node >> np.uint64(16)).astype(np.int64), "tree": (node & np.uint64(0xFF)).astype(np.int64), "a": a, "b": b, "w": log_w}))
        return pd.concat(parts)

    below = grams.select("gram", "n", _dealt(groups)).groupBy("_c").applyInPandas(run, "last long, tree long, a double, b double, w double")
    return below.groupBy("last", "tree").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("w").alias("w"))


class Top:
    """The nodes with one byte of context and with none: at most 256 * 255 and 255 of them."""

    def __init__(self, rows: list):
        last, tree = (np.array([r[k] for r in rows], dtype=int) for k in ("last", "tree"))
        a, b, w = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        for into, k in ((a, "a"), (b, "b"), (w, "w")):
            into[last, tree] = [r[k] for r in rows]
        one_w, self.stop1 = weighted(a, b, w)
        one_w[(a + b) == 0] = 0
        _, self.stop0 = weighted(a.sum(axis=0), b.sum(axis=0), one_w.sum(axis=0))
        self.n1, self.n0 = np.stack([a, b]), np.stack([a.sum(axis=0), b.sum(axis=0)])

    def mix(self, last: np.ndarray, tree: np.ndarray, bit: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The probability of the bit, from q with more context, which is nan where none was seen."""
        for stop, n in ((self.stop1[last, tree], self.n1[:, last, tree]), (self.stop0[tree], self.n0[:, tree])):
            q = _step(n[0], n[1], bit, stop, q)
        return np.where(np.isnan(q), 0.5, q)


def _step(a, b, bit, stop, q):
    """One node up: its own estimate and what comes from below, by weight; below unseen, its own."""
    own = np.where(bit == 1, b, a) + 0.5
    own = np.where(a + b > 0, own / (a + b + 1), np.nan)
    return np.where(np.isnan(q), own, stop * own + (1 - stop) * q)


def gram_scores(grams: DataFrame, top: Top, groups: int) -> DataFrame:
    """gram, logp: ln of each gram's last byte after the bytes before it, eight choices in a row.

    In whole units of 1 / UNIT. A context that no training text has predicts as its longest part that one has.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = pdf["gram"].to_numpy().astype(np.uint64), pdf["n"].to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        seen, logp = n > 0, np.zeros(len(keys))
        byte, last = keys & np.uint64(0xFF), (keys >> np.uint64(8 * DEPTH)).astype(np.int64)
        for j in range(8):
            tree, bit = _bit(byte, j)
            q = np.full(len(keys), np.nan)
            if seen.any():
                for up, (node, a, b, _, stop) in enumerate(_levels(keys[seen], n[seen], j)):
                    own = ((keys >> np.uint64(8 * (up + 1))) << np.uint64(8)) | tree
                    at = np.minimum(np.searchsorted(node, own), len(node) - 1)
                    known = node[at] == own
                    q[known] = _step(a[at], b[at], bit, stop[at], q)[known]
            logp += np.log(top.mix(last, tree.astype(np.int64), bit, q))
        return pd.DataFrame({"gram": keys.astype(np.int64), "logp": np.rint(logp * UNIT).astype(np.int32)})

    return grams.select("gram", "n", _dealt(groups)).groupBy("_c").applyInPandas(run, "gram long, logp int")


_ROWS = {
    "row": pa.int64(),
    "doc_id": pa.int64(),
    "held_out": pa.bool_(),
    "n_tokens": pa.int64(),
    "n_known": pa.int64(),
    "base": pa.float64(),
    "score": pa.int64(),
    "rare": pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])),
}
_ROWS_DDL = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score long, rare array<struct<word: binary, n: long>>"


def gram_sums(texts: list[bytes], keys: np.ndarray, logp: np.ndarray) -> list[int]:
    """Each text's score in units, from the grams in order and their scores."""
    sums = []
    for s in chunks(texts):
        own, starts = gram_keys(texts[s])
        distinct, back = np.unique(own, return_inverse=True)
        sums += np.add.reduceat(logp[np.searchsorted(keys, distinct)].astype(np.int64)[back], starts).tolist()
    return sums


def word_sums(text: bytes, known: dict, end: float, trained: bool) -> tuple[int, int, float, list[dict]]:
    """n_tokens, n_known and base score by the frequent words and the end alone, and the other words' counts."""
    found = text.split()
    got = [known.get(w) for w in found]
    rare = Counter(w for w, x in zip(found, got, strict=True) if x is None)
    return len(found) + 1, len(found) - rare.total() + trained, end + sum(x for x in got if x is not None), [{"word": w, "n": c} for w, c in rare.items()]


def asked_grams(texts: DataFrame) -> DataFrame:
    """c, gram: the distinct grams of each group of texts (c, t)."""

    def run(table: pa.Table) -> pa.Table:
        held: list[np.ndarray] = []
        for s in chunks(texts := table.column("t").to_pylist()):
            held.append(_runs(gram_keys(texts[s])[0])[0])
            if len(held) > 1 and sum(map(len, held)) > HELD:
                held = [np.unique(np.concatenate(held))]
        grams = np.unique(np.concatenate(held)).astype(np.int64)
        return pa.table({"c": pa.array(np.full(len(grams), table.column("c")[0].as_py(), dtype=np.int32)), "gram": pa.array(grams)})

    return texts.select("c", "t").groupBy("c").applyInArrow(run, "c int, gram long")


def scored(docs: DataFrame, modulus: int = 10, sent_grams: int = SENT_GRAMS, sent_words: int = SENT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose id's crc32 isn't 0 by the modulus, and scores every row: ``score``
    is the log10 probability of the lower-cased text and its end, byte by byte: the negative of
    its code length in decimal digits. ``base_score`` comes from smoothed counts of words.

    Counts cover the whole corpus. Frequent words, a fixed number of them, go to every task;
    the others are joined, which has no hot keys left. Every gram of the corpus gets its
    score by Spark, grouped by the two last bytes of its context; the table goes to the tasks
    while it has at most ``sent_grams`` rows. Past that, texts are dealt out to groups of about
    ASKED bytes, each of which asks for the scores of its distinct grams by a join. Scores are
    sums of whole units, so that both ways give the very same.

    Null texts count as empty: one end token, one byte. A null id counts as the empty text,
    whose remainder is 0: held out. Repeated rows are counted and scored one by one. Without
    training rows every bit has one half, and every token has probability one. Other columns are ignored; no rows give none.
    """
    spark = docs.sparkSession
    counts = checkpointed(corpus_counts(docs, modulus))
    n_train = docs.where(id_remainder("doc_id", modulus) != 0).count()
    words, grams = counts.where(F.col("word").isNotNull()).select("word", "n"), counts.where(F.col("gram").isNotNull()).select("gram", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = total[0] + n_train, total[1] + (n_train > 0)
    floor = tokens + ADDED * (kinds + 1)
    log_of = lambda c: np.log10((c + ADDED) / floor)
    head = {bytes(r[0]): r[1] for r in most_frequent(words, sent_words).collect()}
    frequent = spark.sparkContext.broadcast({w: log_of(n) for w, n in head.items()})
    end = log_of(n_train)

    groups = max(24, -(-grams.count() // GROUP_GRAMS))
    top = Top(tops(grams, groups).collect())
    table = checkpointed(gram_scores(grams, top, groups))
    texts = docs.select(F.col("doc_id").cast("long"), (id_remainder("doc_id", modulus) == 0).alias("held_out"), lower_ascii(text_of()).cast("binary").alias("t"))

    def columns(ids, held, texts, row, keys, logp) -> list:
        known, n = frequent.value, len(texts)
        of_words = list(zip(*(word_sums(t, known, end, n_train > 0) for t in texts), strict=True)) or [()] * 4
        made = [range(row, row + n), ids, held, *of_words[:3], gram_sums(texts, keys, logp), of_words[3]]
        return [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, kind) for x, kind in zip(made, _ROWS.values(), strict=True)]

    if table.count() <= sent_grams:
        got = table.toArrow()
        order = np.argsort(keys := got.column("gram").to_numpy())
        sent = spark.sparkContext.broadcast((keys[order].astype(np.uint64), got.column("logp").to_numpy()[order]))

        def run(batches):
            from pyspark import TaskContext

            row = TaskContext.get().partitionId() << 36
            for b in slices(batches):
                yield pa.RecordBatch.from_arrays(columns(b.column(0), b.column(1), b.column(2).to_pylist(), row, *sent.value), names=list(_ROWS))
                row += b.num_rows

        made = texts.mapInArrow(run, _ROWS_DDL)
    else:
        size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        dealt = texts.withColumn("c", F.pmod(F.xxhash64("doc_id", "t"), F.lit(max(1, -(-size // ASKED)))).cast("int"))
        scores = asked_grams(dealt).join(table, "gram").select("c", "gram", "logp")

        def answer(own: pa.Table, of: pa.Table) -> pa.Table:
            keys = of.column("gram").to_numpy().astype(np.uint64)
            order = np.argsort(keys)
            row = own.column("c")[0].as_py() << 36
            return pa.table(dict(zip(_ROWS, columns(own.column("doc_id"), own.column("held_out"), own.column("t").to_pylist(), row, keys[order], of.column("logp").to_numpy()[order]), strict=True)))

        made = dealt.groupBy("c").cogroup(scores.groupBy("c")).applyInArrow(answer, _ROWS_DDL)
    rows = written(made)  # rows are numbered here, once and for all
    rare = rows.select(F.col("row").alias("_r"), F.explode("rare").alias("x")).select("_r", "x.word", "x.n")
    of_word, c = words.select(F.col("word").alias("_w"), F.col("n").alias("_c")), F.coalesce("_c", F.lit(0))
    rest = (
        rare.join(of_word, F.col("word") == F.col("_w"), "left")
        .groupBy("_r")
        .agg(F.sum(F.col("n") * F.log10((c + F.lit(ADDED)) / F.lit(floor))).alias("_base"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("_known"))
    )
    out = rows.join(rest, F.col("row") == F.col("_r"), "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") / F.lit(_LN10 * UNIT)).alias("score"),
    )
