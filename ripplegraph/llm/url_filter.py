"""URL filters: rules for hosts and paths, then a cascade of Bloom filters over the hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.bloom_cascade import with_membership
from ripplegraph.llm.common import checkpointed, lower_ascii

#: (host, path, verdict); a rule holds for its host and all hosts below it.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A host is listed by default if the rules block at least one in so many of its pages.
LISTED_SHARE = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://`` or for a null url."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, as a struct of its name and verdict; null if none fits.

    Longest is by host first and by path then, as a rule reads host/path from the left.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0]), -len(r[1])))
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in reversed(ordered):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def listed_hosts(pages: DataFrame, rules=RULES, share: int = LISTED_SHARE) -> DataFrame:
    """key: hosts of which the rules block at least one page in ``share``. A page without a host counts for none."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(host.alias("key"), (matching_rule(host, path, rules)["verdict"] == "block").alias("_blocked"))
    counts = rows.where("key <> ''").groupBy("key").agg(F.count("*").alias("_n"), F.sum(F.coalesce(F.col("_blocked").cast("long"), F.lit(0))).alias("_b"))
    return counts.where((F.col("_b") > 0) & (F.col("_b") * share >= F.col("_n"))).select("key")


def universe_of(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """key, listed: every distinct host of the pages, and every listed one."""
    hosts = pages.select(host_and_path(F.col("url"))[0].alias("key"), F.lit(False).alias("_in"))
    return hosts.union(listed.select("key", F.lit(True))).where("key is not null").groupBy("key").agg(F.max("_in").alias("listed"))


def judged(pages: DataFrame, listed: DataFrame | None = None, universe: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed: one row per page.

    The longest rule that fits decides; ties can't be, as a rule's host and path are one key.
    A url that no rule fits is blocked if its host is listed. ``listed`` (key) is the list, by
    default ``listed_hosts``; ``universe`` (key, listed) has all keys that are asked for, by default
    the hosts of the pages with the list. The cascade answers exactly for every key of it.
    Null urls and those without ``://`` have an empty host, which isn't listed by default, and
    so pass. Repeated rows get the same answer, other columns are ignored, no rows give none.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if universe is None:
        universe = universe_of(pages, listed_hosts(pages, rules) if listed is None else listed)
    asked = with_membership(rows, "host", "listed", checkpointed(universe))
    found = asked.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "listed")
