import math
import zlib
from collections import Counter

import numpy as np
import pytest

from ripplegraph.llm import context_tree as ct

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def learns(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0


class SlowTree:
    """The trees by definition: a count of zeros and ones at every node, weighted from the leaves up."""

    def __init__(self, texts):
        self.n = {}
        for t in texts:
            for ctx, byte in steps(t):
                for m, bit in choices(byte):
                    for d in range(ct.DEPTH + 1):
                        self.n.setdefault((m, ctx[:d]), [0, 0])[bit] += 1
        below = {}
        for m, c in self.n:
            if c:
                below.setdefault((m, c[:-1]), []).append((m, c))
        self.stop = {}
        weighted = {}
        for node in sorted(self.n, key=lambda x: -len(x[1])):
            a, b = self.n[node]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
            if len(node[1]) == ct.DEPTH:
                weighted[node], self.stop[node] = own, 1.0
            else:
                rest = sum(weighted[x] for x in below[node])
                weighted[node] = np.logaddexp(own, rest) - math.log(2)
                self.stop[node] = math.exp(own - math.log(2) - weighted[node])

    def bit(self, m, ctx, bit):
        q = None
        for d in range(ct.DEPTH, -1, -1):
            node = (m, ctx[:d])
            if node in self.n:
                a, b = self.n[node]
                own = ((b if bit else a) + 0.5) / (a + b + 1)
                q = own if q is None else self.stop[node] * own + (1 - self.stop[node]) * q
        return 0.5 if q is None else q

    def score(self, text):
        return sum(math.log10(self.bit(m, ctx, bit)) for ctx, byte in steps(text) for m, bit in choices(byte))


def steps(text):
    line = ct.BEFORE * ct.DEPTH + text + ct.AFTER
    for i in range(ct.DEPTH, len(line)):
        yield bytes(reversed(line[i - ct.DEPTH : i])), line[i]


def choices(byte):
    return [((1 << j) | (byte >> (8 - j)), byte >> (7 - j) & 1) for j in range(8)]


def slow_rows(rows):
    texts = [(i, (t or "").translate(LOWER).encode()) for i, t in rows]
    tree = SlowTree([t for i, t in texts if learns(i)])
    c, ends = Counter(w for i, t in texts if learns(i) for w in t.split()), sum(learns(i) for i, _ in texts)
    total, kinds = sum(c.values()) + ends, len(c) + (ends > 0)
    for i, t in texts:
        words = t.split()
        base = sum(math.log10((n + 0.1) / (total + 0.1 * (kinds + 1))) for n in [*(c[w] for w in words), ends])
        yield i, not learns(i), len(words) + 1, sum(w in c for w in words) + (ends > 0), total, base, tree.score(t)


def compare(got, rows):
    want = sorted(slow_rows(rows), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str)
    assert len(got) == len(want)
    key = lambda r: (str(r[:5]), round(r[5], 3), round(r[6], 2))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-6) and g[6] == pytest.approx(w[6], rel=1e-4)


def test_equals_brute_force(spark, odd_docs, no_docs):
    short = [(r.doc_id, r.text) for r in odd_docs.collect() if len(r.text or "") < 2000]
    more = [(100 + k, f"the {'abcdefghij'[k % 10]} cat sat on mat {k}\nand the dog") for k in range(40)]
    rows = [*short, *more]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for grams, words in ((ct.SENT_GRAMS, ct.SENT_WORDS), (10, 3)):  # sent to all tasks, and joined
        compare(ct.scored(docs, sent_grams=grams, sent_words=words).collect(), rows)
    assert ct.scored(no_docs).collect() == []
    assert len(ct.scored(odd_docs).collect()) == odd_docs.count()


def test_without_training_rows(spark):
    held = next(k for k in range(1000) if not learns(k))
    rows = ct.scored(spark.createDataFrame([(held, "ab c")], "doc_id long, text string")).collect()
    assert rows[0].n_known == 0 and rows[0].train_tokens == 0
    assert rows[0].score == pytest.approx(-8 * 5 * math.log10(2))


def test_predictions_after_a_context_sum_to_one():
    tree = SlowTree([b"abracadabra", b"abba"])
    ctx = next(steps(b"abra"))[0]
    total = sum(math.prod(tree.bit(m, ctx, bit) for m, bit in choices(byte)) for byte in range(256))
    assert total == pytest.approx(1)


def test_log_gamma():
    x = np.concatenate([np.arange(0.5, 40, 0.5), [1e3, 1e6, 1e12]])
    assert ct.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)


def test_beats_the_word_counts(spark):
    rows = ct.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_scores_are_the_same_whatever_the_size(spark, odd_docs, monkeypatch):
    """The table of grams sent to all tasks, or joined by groups of any number of texts: not a bit differs."""
    docs = odd_docs.select("doc_id", "text").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    sent = sorted(map(tuple, ct.scored(docs).select("doc_id", "held_out", "n_tokens", "n_known", "score").collect()), key=str)
    for asked in (ct.ASKED, 20_000):
        monkeypatch.setattr(ct, "ASKED", asked)
        joined = ct.scored(docs, sent_grams=0).select("doc_id", "held_out", "n_tokens", "n_known", "score").collect()
        assert sorted(map(tuple, joined), key=str) == sent
