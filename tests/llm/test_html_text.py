import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplegraph.llm.html_text import extracted, visible_text

CASES = {
    "<p>One<p>Two": "One\n\nTwo",
    "plain <b>bold</b>text": "plain boldtext",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<div>a</div><div>b</div>": "a\nb",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=3><li>x<li>y</ol>": "3. x\n4. y",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n    d\nu\n    e",
    "<table><tr><th>a<th>bbb<tr><td>cccc<td>d</table>": "a     bbb\ncccc  d",
    "<table><td>a<td>b<tr><td colspan=2>wide as both<tr><td>c<td>d</table>": "a  b\nwide as both\nc  d",
    "<pre>  x\n    y\n</pre>z": "  x\n    y\n\nz",
    "<head><title>t</title><style>.h{display:none}</style></head><body><p class=h>no</p><p hidden>no</p><p style='display: none'>no</p>yes": "yes",
    "<script>if (a < b) { x('</p>') }</script>seen<!-- not > seen -->": "seen",
    "<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>": "s\ns\nyes",
    "1 &lt; 2 &amp;&nbsp;x &#233;": "1 < 2 &\xa0x é",
    "a < b and c > d": "a < b and c > d",
    "<p>unclosed <b>x <i>y</p>z": "unclosed x y\n\nz",
    "<blockquote>q</blockquote>after": "  q\n\nafter",
    "": "",
    "</p></div></td>": "",
    "<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>": "a     b\nx  y",
    "<textarea>kept\ntext</textarea>": "kept text",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert visible_text(html) == CASES[html]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<b>", "</b>", "<div>", "</div>", "<br>", "word", " ", "<", "&amp;", "<pre>", "</pre>", "<!--", "-->", "<body>", "</head>", "<head>", "<dl>", "<dd>"]), max_size=40))
def test_any_soup_is_read(parts):
    text = visible_text("".join(parts))
    assert not text.startswith("\n") and "\n\n\n\n" not in text
    if not any(p in ("<!--", "<", "<head>") for p in parts):
        assert text.count("word") == parts.count("word")


def test_deep_and_long_pages():
    assert visible_text("<div>" * 30_000 + "deep" + "</div>" * 30_000) == "deep"
    assert visible_text("<table><tr><td>" * 300 + "deep") == "deep"
    assert visible_text("<ul>" + "<li>x" * 5000).count("- x") == 5000


def test_pages(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a", "t"), (1, "u", "<p>a", "t"), (2, None, None, None), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extracted(rows).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0), (None, "v", "", 0)], key=str)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert extracted(pages).where("n_chars > 0").count() == pages.count()
    assert extracted(rows.limit(0)).collect() == []


STRAYS = {
    "<table><tr><form><td>text<td>b</form></tr></table>": "text  b",
    "<table><tbody><form><tr><td>x<td>y</tr></form></tbody></table>z": "x  y\n\nz",
    "<table><tr>stray<td>a<td>b</table>": "stray\na  b",
    "<table><tbody><div>one</div><tr><td>a</td></tr>two<tr><td>b</td></tr></table>": "one\ntwo\na\nb",
    "<table><tr><div>open<td>a<td>b</table>": "open\na  b",
    "<table><tr hidden>no<td>no<tr><td>yes</table>": "yes",
    "<form><table><tr><td>a</form>b</table>c</form>": "ab\n\nc",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>": "a  b\n   c\nd  e",
    "<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c</tbody><tbody><tr><td>d<td>e</table>": "a  b\n   c\nd  e",
    "<p>see <svg><title>t</title><desc>d</desc><text>label</text><text>two</text></svg> and <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>": "see label two and x=1",
}


@pytest.mark.parametrize("html", STRAYS)
def test_nothing_visible_is_lost_in_tables(html):
    assert visible_text(html) == STRAYS[html]


MORE = {
    "<ol start='--1'><li>a</ol><ol start=-2><li>b</ol>": "1. a\n\n-2. b",
    "<ol start=" + "9" * 5000 + "><li>a</ol>": "1. a",
    "<table><tr><td colspan=" + "9" * 5000 + ">a<td rowspan=x>b<tr><td colspan=0>c</table>": "a  b\nc",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>end": "yes\nend",
    "<style>.v{visibility:visible}.h{visibility:hidden}</style><p class=h>no <i class=v>yes</i> no": "yes",
    "<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>": "yes",
    "<table><tr><td>a<td style='visibility:hidden'>b<td>c<tr><td>d<td>ee<td>f</table>": "a      c\nd  ee  f",
    "word<p><br><p>word": "word\n\n\nword",
    "word<br><br><br><br><br>word": "word\n\n\nword",
    "seen <b title='never closed>yes</b>": "seen yes",
    "<!-->a<!--->b<!-- c -->d</>e</ x>f<!x>g<?y>h": "abdefgh",
    "<p title=\"a>b\" x='c>d' y=e/f>in</p>": "in",
    "<input value='x'><input type=hidden value=y><button>z</button>": "x z",
}


@pytest.mark.parametrize("html", MORE)
def test_odd_attributes_and_visibility(html):
    assert visible_text(html) == MORE[html]


SLOW = ["<a ", "<div>", "</x>", "<p></div>", "<li>", "<!", "<a x='", '<a x="', "<p title", "<td>", "<tr><td>", "<table>", "<b><p>", "<style>{", "<style>}", "<i class=x>", "<td rowspan=9 colspan=900>", "</", "&", "<style>", "<a" + " " * 100, "<p><button>", "<ol><li>"]


@pytest.mark.parametrize("part", SLOW)
def test_time_is_in_proportion(part):
    began = time.process_time()
    visible_text(part * (200_000 // len(part)) + "end")
    assert time.process_time() - began < 8


def slow_layout(node):
    """Texts and breaks of a tree in order, then joined: n line breaks ask for n - 1 empty lines."""
    out = []

    def walk(x, shown):
        if isinstance(x, str):
            out.extend([x] if shown else [])
            return
        tag, style, children = x
        if style == "display:none":
            return
        shown = {"visibility:hidden": False, "visibility:visible": True}.get(style, shown)
        breaks = {"p": 2, "h1": 2, "div": 1, "section": 1}.get(tag, 0)
        out.append(breaks)
        for c in children:
            walk(c, shown)
        out.append(breaks)

    walk(node, True)
    text, wanted = "", 0
    for x in out:
        if isinstance(x, int):
            wanted = max(wanted, x)
        else:
            text += ("\n" * wanted if text else "") + x
            wanted = 0
    return text


def as_html(x):
    return x if isinstance(x, str) else f"<{x[0]} style='{x[1]}'>{''.join(map(as_html, x[2]))}</{x[0]}>"


LEAF = st.sampled_from(["one", "two", "three"])
STYLES = st.sampled_from(["", "", "", "display:none", "visibility:hidden", "visibility:visible"])
INLINE = st.recursive(LEAF, lambda c: st.tuples(st.sampled_from(["b", "span"]), STYLES, st.lists(c, max_size=3)), max_leaves=4)
PARA = st.tuples(st.sampled_from(["p", "h1"]), STYLES, st.lists(INLINE, max_size=3))
TREE = st.recursive(st.one_of(INLINE, PARA), lambda c: st.tuples(st.sampled_from(["div", "section"]), STYLES, st.lists(c, max_size=4)), max_leaves=12)


@settings(max_examples=400, deadline=None)
@given(st.lists(TREE, max_size=4))
def test_random_trees_equal_a_slow_layout(trees):
    tree = ("section", "", trees)
    assert visible_text(as_html(tree)) == slow_layout(tree)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4).flatmap(lambda n: st.lists(st.lists(st.text("abc", min_size=1, max_size=9), min_size=n, max_size=n), min_size=1, max_size=6)))
def test_cells_are_aligned(rows):
    html = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>"
    widths = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    assert visible_text(html) == "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows)
