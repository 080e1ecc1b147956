import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripplegraph.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= set(range(i, i + 8))
    lines, dup, before = (text or "").split("\n"), 0, set()
    for x in lines:
        if WORD.search(x):
            dup += x in before
            before.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len([x for x in lines if WORD.search(x)]), len(set(words))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n#é", max_size=120))
def test_figures_equal_slow_ones(text):
    assert q.figures_of(text.encode()) == slow(text)


def test_judged_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = q.judged(docs).collect()
        assert len(rows) == docs.count()
        want = Counter((r.doc_id, *slow(r.text)[:5]) for r in docs.collect())
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        for r in rows:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.kept and r.base_failed)
    assert q.judged(no_docs).collect() == []


def test_steps_are_close_and_in_order(spark):
    values = [*range(0, 70), 100, 1000, 12345, 10**9, 10**15]
    got = {r.v: r.s for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", q.step_of(F.col("v")).alias("s")).collect()}
    assert all(got[v] == v for v in range(70))
    assert all(got[v] <= v < got[v] * (1 + 1 / 127) + 1 for v in values)
    assert sorted(got.values()) == [got[v] for v in values]


def slow_judgement(rows):
    """kept and failed_by of each row by sorted lists of weighed figures, group by group."""
    figures, passing = [], []
    for _, text, lang, source in rows:
        n, chars, symbols, dup, repeat, lines, unique = slow(text)
        f = {"word_length": chars * 100 // n, "unique_rate": unique * 1000 // n, "symbol_rate": symbols * 1000 // n, "dup_line_rate": dup * 1000 // max(lines, 1), "repeat_rate": repeat * 1000 // n} if n else {}
        figures.append({k: v >> max(0, v.bit_length() - 8) << max(0, v.bit_length() - 8) for k, v in f.items()})
        passing.append(n >= 20 and 100 * repeat <= 30 * n)
    values = lambda name, fits: [f[name] for f, ok, r in zip(figures, passing, rows, strict=True) if ok and fits(r) and (name in q.VARIED or f[name] > 0)]
    out = []
    for f, ok, (_, _, lang, source) in zip(figures, passing, rows, strict=True):
        by = []
        for name in (*q.VARIED, *q.RARE) if ok else ():
            own, mid, every = values(name, lambda r: r[2:] == (lang, source)), values(name, lambda r: r[2] == lang), values(name, lambda r: True)
            if not every:
                continue
            wide = [(v, 1 + 0 * len(mid)) for v in mid] + [(v, 200 / len(every)) for v in every]
            size = sum(w for _, w in wide)
            weighed = sorted([(v, 1) for v in own] + [(v, w * 200 / size) for v, w in wide])
            total, up, at = sum(w for _, w in weighed), 0, {}
            for v, w in weighed:
                up += w
                for share in (0.1, 0.5, 0.9):
                    if up >= total * share - 1e-6:
                        at.setdefault(share, v)
            if name in q.RARE:
                by += [f"{name}_high"] if f[name] > at[0.9] else []
                continue
            few, many = q.VARIED[name]
            by += [f"{name}_high"] if many and f[name] > at[0.5] + 2.5 * max(at[0.9] - at[0.5], at[0.5] / 32) else []
            by += [f"{name}_low"] if few and f[name] < at[0.5] - 2.5 * max(at[0.5] - at[0.1], at[0.5] / 32) else []
        out.append((ok and not by, sorted(by)))
    return out


def test_judgement_equals_a_slow_one(spark, odd_docs):
    for docs in (odd_docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        want = Counter((r[0], kept, *by) for r, (kept, by) in zip(rows, slow_judgement(rows), strict=True))
        assert Counter((r.doc_id, r.kept, *sorted(r.failed_by)) for r in q.judged(docs).collect()) == want


def test_bounds_adapt_and_every_figure_acts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rated = q.text_figures(docs).select("*", *q._rates())
    bounds = q.group_thresholds(rated.where("n_words >= 20 and 10 * n_repeat_words <= 3 * n_words")).collect()
    by_lang = {}
    for r in bounds:
        by_lang.setdefault(r.lang, []).append(r.word_length_high)
    medians = {k: np.median(v) for k, v in by_lang.items()}
    assert len(set(medians.values())) == len(medians) and len({r.unique_rate_low for r in bounds}) > 10
    rows = q.judged(docs).where("not base_failed").collect()
    alone = Counter(r.failed_by[0] for r in rows if len(r.failed_by) == 1)
    assert set(alone) >= {"word_length_high", "word_length_low", "unique_rate_low", "dup_line_rate_high", "repeat_rate_high"}
    good = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1").collect()}
    assert np.mean([r.kept for r in rows if r.doc_id in good]) > 0.95


def test_sketches_merge_to_the_whole_and_give_quantiles(spark):
    rng = np.random.default_rng(3)
    data = [(lang, src, int(x)) for lang in "ab" for src in "xy" for x in rng.lognormal(5, 1, 500)]
    docs = spark.createDataFrame(data, "lang string, source string, v long")
    rates = docs.select("lang", "source", *[F.col("v").alias(f) for f in (*q.VARIED, *q.RARE)])
    fine = q.sketches(rates, "lang", "source")
    assert sorted(q.merged(fine, "lang").collect()) == sorted(q.sketches(rates, "lang").select("lang", "figure", "step", "n").collect())
    for r in q.thresholds(fine, "lang", "source").collect():
        own = np.array([v for a, b, v in data if (a, b) == (r.lang, r.source)])
        mid, top = np.quantile(own, [0.5, 0.9])
        assert abs(r.word_length_high - (mid + 2.5 * (top - mid))) < 0.1 * r.word_length_high
        assert abs(r.symbol_rate_high - top) < 0.1 * top


def test_an_odd_source_is_judged_by_its_own_quantiles(spark):
    rng = np.random.default_rng(1)
    words = lambda: [f"w{rng.integers(10**6)}" for _ in range(60)]
    plain = [(k, " ".join(words() + ["#"] * (k % 9 == 0)), "en", "plain") for k in range(900)]
    marked = [(1000 + k, " ".join(f"{w}#" for w in words()), "en", "marked") for k in range(900)]
    stray = [(5000, " ".join(f"{w}#" for w in words()), "en", "plain")]
    rows = q.judged(spark.createDataFrame([*plain, *marked, *stray], "doc_id long, text string, lang string, source string")).collect()
    gone = {r.doc_id for r in rows if not r.kept}
    assert 5000 in gone and len(gone) < 30
