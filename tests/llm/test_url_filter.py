import re
from collections import Counter

import numpy as np
import pytest

from ripplegraph.llm import bloom_cascade as bloom
from ripplegraph.llm.url_filter import RULES, judged


@pytest.mark.parametrize("n,m", [(0, 100), (1, 0), (1, 1), (500, 20_000), (20_000, 500), (3000, 3000)])
def test_cascade_is_exact_over_its_universe(n, m):
    rng = np.random.default_rng(n + m)
    keys = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
    rng.shuffle(keys)
    listed, others = keys[:n], keys[n:]
    levels = bloom.build(listed, others)
    assert bloom.contains(levels, listed).all() and not bloom.contains(levels, others).any()
    assert sum(map(len, levels)) < 3 * (n + 8)


def test_blocks_of_shards_answer_alike(spark):
    keys = [(f"host{k}.example.org", k % 7 == 0) for k in range(900)]
    universe = spark.createDataFrame(keys, "key string, listed boolean")
    rows = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(keys * 2)], "n long, h string")
    for shard, limit in ((1 << 17, 1 << 20), (50, 100), (50, 1)):
        got = bloom.with_membership(rows, "h", "hit", universe, shard, limit).collect()
        assert len(got) == 1800 and all(r.hit == (int(r.h[4:].split(".")[0]) % 7 == 0) for r in got)


def test_routed_rows_are_the_same_whatever_their_columns(spark):
    names = ["_shard", "_salt", "_place", "_levels", "h"]
    rows = spark.createDataFrame([(k, "x", None, float(k), None if k == 3 else f"h{k % 9}") for k in range(60)], "_shard int, _salt string, _place string, _levels double, h string")
    universe = spark.createDataFrame([("h1", True), ("h2", False), ("h4", True)], "key string, listed boolean")
    one, two = (bloom.with_membership(rows, "h", "hit", universe, 1, limit) for limit in (1 << 20, 0))
    assert one.columns == two.columns == [*names, "hit"]
    known = [r for r in two.collect() if r.h in ("h1", "h2", "h4")]
    assert two.count() == 60 and all(r.hit == (r.h != "h2") for r in known)
    assert sorted(one.where("h in ('h1', 'h2', 'h4')").collect(), key=str) == sorted(known, key=str)


def parts(url):
    """Host, path and the longest rule that fits."""
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = (r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1]))
    return host, path, max(fits, key=lambda r: (len(r[0]), len(r[1])), default=None)


def slow(rows, listed=None):
    """The answers for (page_id, url), with hosts listed by the share of their pages that rules block."""
    judged = [(i, *parts(u)) for i, u in rows]
    every, blocked = Counter(h for _, h, _, _ in judged), Counter(h for _, h, _, r in judged if r and r[2] == "block")
    found = {h for h in blocked if h and 4 * blocked[h] >= every[h]} if listed is None else listed
    return [(i, h, p, r and r[0] + r[1], r[2] if r else "block" if h in found else "allow", h in found) for i, h, p, r in judged]


URLS = [
    "http://Example.COM/en/1?x", "https://www.example.com/en/", "https://a.www.example.com/en/z#q", "http://m.example.net/es/5", "http://m.example.net/es", "net/es/", "http://net/es/",
    "http://example.com", "http://example.com?q=/en/", "http://notexample.com/en/", None, "", "no scheme", "ftp://spam.example.org/a://b/c", "http://x.org#y/z", "http://ÄB.com/en/",
    "http://cheap-pills.org/", "://", "http://user@spam.net/fr/1", "http://x.net/fr/1\n2",
]


def test_equals_brute_force(spark):
    rows = spark.createDataFrame([(i, u, "html", "h", None) for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, html string, host string, key string")
    for pages in (rows, spark.read.parquet("/root/testdata/sf0.01/pages.parquet")):
        want = sorted(slow([(r.page_id, r.url) for r in pages.collect()]), key=str)
        got = sorted(map(tuple, judged(pages).collect()), key=str)
        assert got == want and len({r[5] for r in want}) == 2
    assert judged(rows.limit(0)).collect() == []


def test_a_given_list_decides(spark):
    rows = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    listed = spark.createDataFrame([("x.org",), ("nowhere.example",), (None,)], "key string")
    want = sorted(slow(list(enumerate(URLS)), {"x.org"}), key=str)
    assert sorted(map(tuple, judged(rows, listed).collect()), key=str) == want
