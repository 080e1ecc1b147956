import hashlib
import re
import string

from ripplegraph.llm.line_dedup import without_repeats

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", string.punctuation)


def brute(rows, least=5):
    """Cut spans of each distinct row, line by line, over all rows in order of rank."""
    first, keyed = {}, {}
    key = lambda i, t: hashlib.md5(f"{'' if i is None else i}|{t or ''}".encode()).digest()
    for i, t in rows:
        keyed[key(i, t)] = (i, t or "")
    units = []
    for k, (i, t) in keyed.items():
        at = 0
        for line in re.findall(r"[^\n]*\n|[^\n]+$", t):
            words = re.findall(r"[^\x20\x09-\x0D]+", line.translate(LOWER))
            if len(words) >= least:
                units.append((i is None, i or 0, k, at, len(line), " ".join(words)))
            at += len(line)
    cut = {}
    for _, _, k, at, n, words in sorted(units):
        if words in first:
            cut.setdefault(k, []).append((at, n))
        first.setdefault(words, (k, at))
    out = []
    for i, t in rows:
        spans = cut.get(key(i, t), [])
        text, at, kept = "", 0, []
        for s, n in [*spans, (len(t or ""), 0)]:
            if s > at:
                kept.append((at, s - at))
                text += (t or "")[at:s]
            at = s + n
        out.append((i, text, kept, spans, len(text), len(t or ""), sum(n for _, n in spans)))
    return sorted(out, key=str)


def test_equals_brute_force(spark, odd_docs, no_docs):
    for docs in (odd_docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        got = [(r.doc_id, r.text, [tuple(s) for s in r.kept_spans], [tuple(s) for s in r.removed_spans], r.n_chars, r.n_chars_before, r.n_removed) for r in without_repeats(docs).collect()]
        assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert without_repeats(no_docs).collect() == []


def test_paragraphs(spark):
    p = "a paragraph of more than five words\nover two lines of text"
    docs = spark.createDataFrame([(1, f"intro\n\n{p}\n\nend"), (2, f"{p.upper()}\n \nanother end here")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in without_repeats(docs, "paragraph").collect()}
    assert got == {1: f"intro\n\n{p}\n\nend", 2: "another end here"}


def test_sentences_of_edited_lines(spark):
    s = [" ".join(f"w{k}x{j}" for j in range(12)) + "." for k in range(6)]
    lines = {1: " ".join(s), 2: " ".join(["Quite new words stand here now.", *s[1:5], "No."]) + "\nend", 3: s[0].upper() + "  " + " ".join(s[1:]) + "\nother"}
    docs = spark.createDataFrame(list(lines.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in without_repeats(docs, "sentence").collect()}
    assert {i: r.text for i, r in rows.items()} == {1: lines[1], 2: "Quite new words stand here now. No.\nend", 3: "other"}
    for i, r in rows.items():
        spans = sorted([*r.kept_spans, *r.removed_spans])
        assert "".join(lines[i][a : a + n] for a, n in spans) == lines[i] and r.n_removed == len(lines[i]) - len(r.text)


def test_registered_query_cuts_sentences(spark, tmp_path):
    from ripplegraph.llm import queries

    shared = "a sentence of more than five words that two long lines share."
    docs = spark.createDataFrame([(1, f"First start of it all. {shared} An end."), (2, f"Other start of it all. {shared} Another end.")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in queries.op4_repeated_lines(spark, str(tmp_path)).collect()}
    assert got[2] == "Other start of it all. Another end."
