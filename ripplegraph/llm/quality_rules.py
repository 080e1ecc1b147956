"""Quality rules whose thresholds come from quantile sketches for each language and source."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.llm.common import checkpointed, slices, text_of

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Fixed rules that every text must pass, whatever its language and source.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Steps of a sketch in each doubling.
STEPS = 128
#: A spread is at least such a share of the median, where most of a group are copies of one text.
LEAST_SPREAD = 32
#: A group's quantiles take in its language's texts as if these were so many, and a language's those of all.
BORROWED = 200
#: The outer tenths of a figure, and how many times their distance from the median a text may lie beyond them.
OUTER, FAR = 0.1, 1.5
#: Figures that every text has: whether too little is bad, whether too much is.
VARIED = {"word_length": (True, True), "unique_rate": (True, False)}
#: Figures that most texts have nothing of; the outer tenth of the texts that have some is bad.
RARE = ("symbol_rate", "dup_line_rate", "repeat_rate")

_FIGURES_OF_TEXT = (
    "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_unique long"
)
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1 for k in range(1, WINDOW + 1)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words in a window of eight that occurs twice or more in the text, first occurrence included.

    Windows are hashed all at once; only a text in which two hashes agree compares the
    windows themselves.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    ids ^= ids >> np.uint64(32)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        rolled += ids[k : k + n] * _MULTIPLIERS[k]
    ordered = np.sort(rolled)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    number: dict[bytes, int] = {}
    exact = [number.setdefault(w, len(number)) for w in words]
    windows = list(zip(*[exact[k : k + n] for k in range(WINDOW)], strict=True))
    seen = Counter(windows)
    many = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=n)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += many
    edge[WINDOW:] -= many
    return int((np.cumsum(edge) > 0).sum())


def figures_of(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_unique of one text."""
    words = text.split()
    chars = len(b"".join(words).decode())
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), len(set(words))


def text_figures(docs: DataFrame) -> DataFrame:
    """The figures of every whole text, with its doc_id, language and source."""

    def run(batches):
        for b in slices(batches):
            got = list(map(figures_of, b.column(3).to_pylist()))
            columns = [pa.array([x[k] for x in got], pa.int64()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], names=[x.split()[0] for x in _FIGURES_OF_TEXT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), text_of().cast("binary").alias("t")).mapInArrow(
        run, _FIGURES_OF_TEXT
    )


def _rates() -> list[Column]:
    """The figures as whole numbers: per mille, and hundredths of a character."""
    per = lambda c, of, times=1000: F.when(F.col(of) > 0, F.expr(f"{c} * {times} div {of}")).otherwise(0)
    return [
        per("word_chars", "n_words", 100).alias("word_length"),
        per("n_unique", "n_words").alias("unique_rate"),
        per("n_symbols", "n_words").alias("symbol_rate"),
        per("n_dup_lines", "n_lines").alias("dup_line_rate"),
        per("n_repeat_words", "n_words").alias("repeat_rate"),
    ]


def step_of(value: Column) -> Column:
    """The sketch's step that holds a whole number: exact up to 256, then 128 steps a doubling.

    Integer arithmetic, so that a step never depends on a machine's logarithm.
    """
    shift = F.greatest(F.length(F.bin(value)) - STEPS.bit_length(), F.lit(0))
    width = F.pow(F.lit(2), shift).cast("long")
    return F.floor(value / width).cast("long") * width


def sketches(rates: DataFrame, *keys: str) -> DataFrame:
    """A quantile sketch for each group and figure: how many texts fall on each step.

    Steps have a relative width of one in 128, so that a group's sketch has some hundred rows
    at most, whatever the group's size. Sketches merge by adding counts, in any order: Spark
    adds within partitions first, and a language's sketch is the sum of its sources'. Of the
    rare figures only texts that have some count.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("figure"), step_of(F.col(f)).alias("step")) for f in (*VARIED, *RARE)]))
    counted = rates.select(*keys, pairs.alias("p")).where(F.col("p.figure").isin(*VARIED) | (F.col("p.step") > 0))
    return counted.groupBy(*keys, F.col("p.figure").alias("figure"), F.col("p.step").alias("step")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "figure", "step").agg(F.sum("n").alias("n"))


def borrowed(own: DataFrame, keys: list[str], wider: DataFrame, wider_keys: list[str]) -> DataFrame:
    """A group's sketch with that of the wider group it is in, weighed as BORROWED texts of each figure.

    A small group is so judged like its wider group, a large one by itself, with no step between.
    """
    size = wider.groupBy(*wider_keys, "figure").agg(F.sum("n").alias("_size"))
    named = lambda df: df.withColumnsRenamed({k: f"_w{k}" for k in (*wider_keys, "figure")})
    same = lambda left: [left[k].eqNullSafe(F.col(f"_w{k}")) for k in (*wider_keys, "figure")]
    scaled = wider.join(named(size), same(wider)).select(*wider_keys, "figure", "step", (F.col("n") * BORROWED / F.col("_size")).alias("n"))
    groups = own.select(*keys).distinct()
    if wider_keys:
        lent = groups.join(named(scaled.select(*wider_keys, "figure", "step", "n")), [groups[k].eqNullSafe(F.col(f"_w{k}")) for k in wider_keys])
    else:
        lent = groups.join(F.broadcast(named(scaled)), F.lit(True))  # one sketch, of a few hundred rows a figure
    rows = own.select(*keys, "figure", "step", F.col("n").cast("double")).union(lent.select(*keys, F.col("_wfigure").alias("figure"), "step", "n"))
    return rows.groupBy(*keys, "figure", "step").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame, *keys: str) -> DataFrame:
    """Per group: the least and most that each figure may be; null where no text of the wider group has any.

    A varied figure may lie FAR times as far beyond the outer tenth as that lies from the median. A rare one may be as much as nine tenths of the texts that have some have at most.
    """
    whole = Window.partitionBy(*keys, "figure").orderBy("step")
    ranked = sketch.withColumn("_up", F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("_n", F.max("_up").over(Window.partitionBy(*keys, "figure")))
    at = lambda share: F.min(F.when(F.col("_up") >= F.col("_n") * F.lit(share) - F.lit(1e-6), F.col("step")))
    found = ranked.groupBy(*keys, "figure").agg(at(OUTER).alias("_t1"), at(0.5).alias("_mid"), at(1 - OUTER).alias("_t9"))
    step = F.col("_mid") / LEAST_SPREAD
    low = F.col("_mid") - (1 + FAR) * F.greatest(F.col("_mid") - F.col("_t1"), step)
    high = F.when(F.col("figure").isin(*RARE), F.col("_t9")).otherwise(F.col("_mid") + (1 + FAR) * F.greatest(F.col("_t9") - F.col("_mid"), step))
    bounds = found.select(*keys, "figure", low.cast("double").alias("_low"), high.cast("double").alias("_high"))
    pick = lambda c, f: F.max(F.when(F.col("figure") == f, F.col(c)))
    lows, highs = [f for f, (few, _) in VARIED.items() if few], [*(f for f, (_, many) in VARIED.items() if many), *RARE]
    return bounds.groupBy(*keys).agg(*[pick("_high", f).alias(f"{f}_high") for f in highs], *[pick("_low", f).alias(f"{f}_low") for f in lows])


def group_thresholds(rated: DataFrame) -> DataFrame:
    """lang, source and the thresholds of each such group of texts."""
    fine = checkpointed(sketches(rated, "lang", "source"))
    by_lang = merged(fine, "lang")
    lang = borrowed(by_lang, ["lang"], merged(by_lang), [])
    return thresholds(borrowed(fine, ["lang", "source"], lang, ["lang"]), "lang", "source")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_by.

    Texts that pass the fixed rules are sketched by language and source; each is kept if all
    its figures lie within the thresholds of its group, and failed_by lists those that don't.
    Null texts count as empty and fail the fixed rules; a null language or source is a group
    like any other. Groups that no text passes have no thresholds. Repeated rows are judged
    alike, other columns are ignored, and no rows give none.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rated = text_figures(docs).select("*", *_rates(), failed.alias("base_failed"))
    groups = group_thresholds(rated.where("not base_failed")).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = rated.join(groups, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    step = lambda bound: step_of(F.col(bound.rpartition("_")[0]))
    outside = [F.when(step(c) > F.col(c) if c.endswith("_high") else step(c) < F.col(c), F.lit(c)) for c in groups.columns if c.endswith(("_high", "_low"))]
    by = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*outside)))
    return joined.withColumn("failed_by", by).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_by") == 0)).alias("kept"), "failed_by"
    )
