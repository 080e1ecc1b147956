import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ripplegraph.llm.packing import Schedule, WordIds, packed

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
WORDS = WordIds(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB'sé,.!?*—’ \n\t́İß9٣#<|>日x", max_size=40))
def test_ids_of_words_are_ids_of_the_text(text):
    assert np.frombuffer(WORDS.encode(text.encode()), WORDS.kind).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=6), st.booleans(), st.integers(1, 64))
def test_windows_are_full_and_hold_each_token_once(lengths, weighted, window):
    weights = [1.0 + k for k in range(len(lengths))] if weighted else None
    plan = Schedule(list(range(len(lengths))), lengths, weights, window)
    held = defaultdict(list)
    for s, n in enumerate(lengths):
        at = 0
        for start, length, w, offset in plan.pieces(s, 0, n):
            assert start == at and length > 0
            at += length
            held[w].append((offset, length))
        assert at == n
    total = sum(lengths)
    assert sorted(held) == list(range(-(-total // window)))
    for w, parts in held.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == min(window, total - w * window)


def test_windows_hold_the_target_proportions():
    plan = Schedule(["a", "b", "c"], [40_000, 10_000, 30_000], [2, 1, 1], 400)
    shares = defaultdict(lambda: [0, 0, 0])
    for s, n in enumerate(plan.lengths):
        for _, length, w, _ in plan.pieces(s, 0, n):
            shares[w][s] += length
    for w in range(90):  # none is empty before
        assert np.abs(np.array(shares[w]) - [200, 100, 100]).max() <= 1


def check(docs, rows, window=4096, end=2):
    texts = docs.collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    ids = defaultdict(list)
    for t in texts:
        whole = [*TOKENIZER.encode(t.text or "", add_special_tokens=False).ids, end]
        ids[t.doc_id, len(whole)].append(whole)
    assert set(ids) == set(pieces)
    for key, wholes in ids.items():
        sums = sorted((r.start, r.length) for r in pieces[key])
        assert sum(n for _, n in sums) == sum(map(len, wholes))
        for r in pieces[key]:
            crcs = {zlib.crc32(np.array(w[r.start : r.start + r.length], "<u4").tobytes()) for w in wholes}
            assert r.ids_crc32 in crcs
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert sum(sum(n for _, n in p) < window for p in windows.values()) <= 1


def test_round_trip(spark, odd_docs, no_docs):
    check(odd_docs, packed(odd_docs, PATH).collect())
    check(odd_docs, packed(odd_docs.repartition(3, "text"), PATH, weights={"a": 3, "b": 1}).collect())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)
    check(docs, packed(docs, PATH).collect())
    assert packed(no_docs, PATH).collect() == []


@pytest.mark.parametrize("lengths", [[], [0], [0, 0]])
def test_nothing_to_pack(lengths):
    assert Schedule(list(range(len(lengths))), lengths).phases == []


def test_words_alone_give_the_ids_of_the_text():
    texts = ["Élève naïve ÉLÈVE straße Straße ªº ĳ ŀ ǆ İstanbul ŉ", "e\u0301le\u0300ve cafe\u0301s a\u0308", "it's they'll don't l'été x1y2 日本語 3é é3 é. «é» ÿ\x85z", "".join(map(chr, range(0x61, 0x250))), " ".join(map(chr, range(0x61, 0x250)))]
    for t in texts:
        assert np.frombuffer(WORDS.encode(t.encode()), dtype=WORDS.kind).tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


def test_long_words_are_not_remembered():
    words = WordIds(PATH)
    texts = [f"{'x' * 50_000}{k} short" for k in range(20)] * 2 + [f"{'日本語' * 5_000}{k}, short" for k in range(20)] * 2
    for t in texts:
        assert np.frombuffer(words.encode(t.encode()), words.kind).tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids
    assert sum(len(k) + len(v) for held in (words, words.cores) for k, v in held.items()) < 10_000


def test_large_ids_stay_exact_beside_a_null_one(spark):
    ids = [None, *range(2**53 + 1, 2**53 + 9, 2)]
    docs = spark.createDataFrame([(i, "some words", "a") for i in ids], "doc_id long, text string, source string").coalesce(1)
    assert sorted((r.doc_id for r in packed(docs, PATH).collect()), key=str) == sorted(ids, key=str)
