"""Paths inside a snapshot, as column expressions. The root is the empty string; null stands for an invalid path."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(x: Column, give: Callable[[Column], Column]) -> Column:
    """``give`` of a column that is worked out once, however often ``give`` names it."""
    return F.transform(F.array(x), give)[0]


def _folded(path: Column) -> Column:
    """The segments that are left after ``.`` and ``..``; a leading ``..`` stays."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, s: F.when((s == "") | (s == "."), done)
        .when((s == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )


def cleaned(path: Column) -> Column:
    """A non-root path in shortest form; null if it is empty, absolute, or leads to or past the root."""

    def judged(segments: Column) -> Column:
        return F.when((F.size(segments) > 0) & (segments[0] != ".."), F.array_join(segments, "/"))

    outside = lambda p: (p == "") | p.startswith("/") | p.startswith("\\")
    return bound(path, lambda p: F.when(~outside(p), bound(_folded(p), judged)))


def tree(path: Column) -> Column:
    """As ``cleaned``, but the empty path and ``.`` are the root."""
    return bound(path, lambda p: F.when(p.isin("", "."), "").otherwise(cleaned(p)))


def folded(path: Column) -> Column:
    """Any relative path in shortest form, the root included; null if it leads past the root."""
    return bound(_folded(path), lambda segments: F.when(F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit("")) != "..", F.array_join(segments, "/")))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """All trees above a path, the root first."""
    parts = F.split(path, "/")
    above = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.concat(F.array(F.lit("")), above)


def _joined(base: Column, value: Column) -> Column:
    return F.when(base == "", value).otherwise(F.concat(base, F.lit("/"), value))


def resolved(base: Column, value: Column) -> Column:
    """``value`` seen from the tree ``base``; ``//x`` is seen from the root and ``/x`` is invalid."""

    def give(x: Column) -> Column:
        v, rooted = x["value"], x["value"].startswith("//")
        place = F.when(rooted, F.substring(v, 3, 1 << 30)).otherwise(_joined(x["base"], v))
        return F.when((v != "") & (rooted | ~v.startswith("/")), cleaned(place))

    return bound(F.struct(base.alias("base"), value.alias("value")), give)


def resolved_tree(base: Column, value: Column) -> Column:
    """As ``resolved`` for trees: empty and ``.`` are the base, ``//`` is the root."""

    def give(x: Column) -> Column:
        b, v = x["base"], x["value"]
        up = F.size(_folded(_joined(b, v))) == 0
        return F.when(v.isin("", "."), b).when(v == "//", "").when(~v.startswith("/") & up, "").otherwise(resolved(b, v))

    return bound(F.struct(base.alias("base"), value.alias("value")), give)


def within(path: Column, directory: Column) -> Column:
    return (path == directory) | (directory == "") | path.startswith(F.concat(directory, F.lit("/")))


def relative(path: Column, directory: Column) -> Column:
    """What is left of the path below the directory; null if it isn't below."""
    return (
        F.when(path == directory, "").when(directory == "", path)
        .when(path.startswith(F.concat(directory, F.lit("/"))), path.substr(F.length(directory) + 2, F.length(path)))
    )


def _plain(c: str) -> str:
    """A character as itself in a regular expression."""
    return c if c.isalnum() or c in "/_" or ord(c) > 127 else "\\" + c


def _glob_class(pattern: str, start: int) -> tuple[str, int]:
    """The expression of the class that begins at ``start``, and where it ends; no class matches a slash."""
    at, parts = start + 1, []
    negated = pattern[at : at + 1] in ("!", "^")
    at += negated
    while at < len(pattern) and (pattern[at] != "]" or not parts):
        c = pattern[at]
        if c == "\\":
            at, c = at + 1, pattern[at + 1 : at + 2]
            parts.append(_plain(c) if c else "")
        else:
            parts.append("-" if c == "-" and parts and pattern[at + 1 : at + 2] not in ("]", "") else _plain(c))
        at += 1
    if at >= len(pattern):
        raise ValueError(f"bad pattern {pattern!r}")
    return f"(?!/)[{'^' * negated}{''.join(parts)}]", at


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob: ``*``, ``?``, ``[…]``, ``{a,b}``, and ``**`` for any depth."""
    out, i, braces = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i) and (i == 0 or pattern[i - 1] == "/") and i + 2 == len(pattern):
            out, i = (out[:-1] + "(?:/.*)?" if out.endswith("/") else out + ".*"), i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            inside, end = _glob_class(pattern, i)
            out, i = out + inside, end
        elif c == "{":
            out, braces = out + "(?:", braces + 1
        elif c == "}" and braces:
            out, braces = out + ")", braces - 1
        elif c == "," and braces:
            out += "|"
        elif c == "\\":
            if i + 1 == len(pattern):
                raise ValueError(f"bad pattern {pattern!r}")
            out, i = out + _plain(pattern[i + 1]), i + 1
        else:
            out += _plain(c)
        i += 1
    if braces:
        raise ValueError(f"bad pattern {pattern!r}")
    return f"^{out}$"


def glob_matches(path: Column, pattern: str) -> Column:
    return path.rlike(whole_regex(pattern))


def whole_regex(pattern: str) -> str:
    """As ``glob_regex``, for Spark: of whole paths, line breaks in names included."""
    return f"(?s){glob_regex(pattern)[:-1]}\\z"


def glob_literals(pattern: str) -> tuple[int, int, str, str, str]:
    """What a glob states without wildcards: depth, heads, head, by, tail.

    ``depth`` is the number of segments of all that it matches, -1 where that varies; ``head`` the
    first ``heads`` segments; ``tail`` the last name (``by`` is ``name``) or what follows its last
    dot (``ext``), or nothing (``any``).
    """
    parts = pattern.split("/")
    literal = re.compile(r"(?:[^*?\[\]{}\\]|\\[^/])*").fullmatch
    bare = lambda part: re.sub(r"\\(.)", r"\1", part)
    heads = next((k for k, part in enumerate(parts[:-1]) if not literal(part)), len(parts) - 1)
    grouped = re.search(r"[\[{].*/.*[\]}]", pattern, re.DOTALL)
    depth = -1 if "**" in pattern or grouped else len(parts)
    by, tail, last = "any", "", parts[-1]
    ending = re.fullmatch(r"[^\[\]{}\\]*[*?][^\[\]{}\\]*\.([^*?.\[\]{}\\]+)", last, re.DOTALL)
    if literal(last) and not grouped:
        by, tail = "name", bare(last)
    elif ending and not grouped and not last.startswith("**."):
        by, tail = "ext", ending[1]
    return depth, heads, "/".join(map(bare, parts[:heads])), by, tail
