"""The configuration language's functions, as column expressions over data.

Each takes and gives Columns. What needs a host (files, the working directory) is a join on the
snapshot's objects and contents instead; see sources.git. ``can`` and ``try`` are ``try_*``
functions of Spark with a fallback.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplegraph.functions.addresses import cidrhost, cidrnetmask, cidrsubnet, cidrsubnets, uuidv5
from ripplegraph.functions.records import csvdecode


def base64encode(x: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(x, "UTF-8")), "[\r\n]", "")


def chomp(x: Column) -> Column:
    return F.regexp_replace(x, r"(?:\r\n?|\n)+\z", "")


def chunklist(a: Column, n: int) -> Column:
    starts = F.filter(F.sequence(F.lit(0), F.size(a)), lambda i: (i % n == 0) & (i < F.size(a)))
    return F.transform(starts, lambda i: F.slice(a, i + 1, F.lit(n)))


def coalescelist(*lists: Column) -> Column:
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in lists])


def compact(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def element(a: Column, i: Column) -> Column:
    return F.element_at(a, (F.pmod(i, F.size(a)) + 1).cast("int"))


def flatten(a: Column, levels: int = 1) -> Column:
    """Of lists in lists, ``levels`` deep (see ``nesting``), the innermost values in one list."""
    for _ in range(levels):
        a = F.flatten(a)
    return a


def nesting(kind: T.DataType) -> int:
    """How many times a column of this type has to be flattened."""
    depth = 0
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        depth, kind = depth + 1, kind.elementType
    return depth


_VERB = re.compile(r"%(?:%|([-+ 0]*)(\d*)(\.\d+)?([a-zA-Z]))")


def format_(fmt: str, *args: Column) -> Column:
    """Text with verbs: %v and %s as text, %q quoted, %t, %d %x %X %o %b of whole numbers, %f %e %g of any."""
    parts, at, left = [], 0, list(args)
    for m in _VERB.finditer(fmt):
        parts.append(F.lit(fmt[at : m.start()]))
        at = m.end()
        if m[0] == "%%":
            parts.append(F.lit("%"))
            continue
        flags, width, precision, verb = m[1], m[2], m[3] or "", m[4]
        if not left or verb not in "vsqtdxXobfeg":
            raise ValueError(f"bad or unmatched verb {m[0]!r}")
        x = left.pop(0)
        if verb in "dxXo":
            parts.append(F.format_string(f"%{flags}{width}{verb}", x.cast("bigint")))
        elif verb in "feg":
            parts.append(F.format_string(f"%{flags}{width}{precision}{verb}", x.cast("double")))
        else:
            text = F.bin(x.cast("bigint")) if verb == "b" else x.cast("string")
            if verb == "v":  # whole numbers have no fraction
                text = F.when(F.typeof(x).isin("double", "float"), F.regexp_replace(text, r"\.0$", "")).otherwise(text)
            if verb == "q":
                text = F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))
            parts.append(F.format_string(f"%{'-' * ('-' in flags)}{width}{precision}s", text) if width or precision else text)
    if left:
        raise ValueError("more arguments than verbs")
    return F.concat(*parts, F.lit(fmt[at:]))


def formatlist(fmt: str, a: Column) -> Column:
    return F.transform(a, lambda x: format_(fmt, x))


#: A date layout's tokens, and Spark's patterns for them.
_DATE = {
    "YYYY": "yyyy", "YY": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "DD": "dd", "D": "d", "EEEE": "EEEE", "EEE": "E", "HH": "HH", "H": "H", "hh": "hh", "h": "h",
    "AA": "a", "aa": "a", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "ZZZZZ": "xxx", "ZZZZ": "xx", "ZZZ": "xx", "Z": "XXX",
}
_DATE_PART = re.compile(r"'((?:[^']|'')*)'|([A-Za-z])\2*|[^A-Za-z']+")


def formatdate(layout: str, t: Column) -> Column:
    """A time by a layout like ``DD MMM YYYY hh:mm``; text in single quotes stays. In the session's zone."""
    t, parts = F.to_timestamp(t), []
    for m in _DATE_PART.finditer(layout):
        if m[1] is not None or m[2] is None:
            parts.append(F.lit(m[0] if m[1] is None else m[1].replace("''", "'")))
            continue
        if m[0] not in _DATE:
            raise ValueError(f"unknown date token {m[0]!r}")
        x = F.date_format(t, _DATE[m[0]])
        parts.append(F.lower(x) if m[0] == "aa" else F.when(x == "+0000", "UTC").otherwise(x) if m[0] == "ZZZ" else x)
    return F.concat(*parts) if parts else F.lit("")


def index(a: Column, i: Column) -> Column:
    """The element at a place, from 0; a place that the list lacks is an error."""
    return F.element_at(a, F.when(i >= 0, i + 1).otherwise(F.raise_error(F.lit("a negative index"))).cast("int"))


def indent(n: int, x: Column) -> Column:
    return F.replace(x, F.lit("\n"), F.lit("\n" + " " * n))


def keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def values(m: Column) -> Column:
    return F.transform(keys(m), lambda k: F.element_at(m, k))


def lookup(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def log(x: Column, base: float) -> Column:
    return F.log(x) / F.log(F.lit(float(base)))


def merge(*maps: Column) -> Column:
    """Later maps win."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(_without(out, m), m)
    return out


def _without(a: Column, b: Column) -> Column:
    return F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))


def parseint(x: Column, base: int) -> Column:
    """The whole number that a text gives in a base up to 36; anything else is an error."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    number = F.conv(F.regexp_replace(x, "^[-+]", ""), base, 10).cast("bigint")
    good = x.rlike(f"(?i)^[-+]?[{digits}]+$")
    return F.when(x.isNull(), None).when(good, F.when(x.startswith("-"), -number).otherwise(number)).otherwise(F.raise_error(F.concat(F.lit("not a number: "), x)).cast("bigint"))


def range_(end: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.greatest(end, F.lit(0))), lambda i: i < end)


def setproduct(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("a"), y.alias("b")))))


def slice_(a: Column, start: int, end: int) -> Column:
    return F.slice(a, start + 1, end - start)


def split(sep: str, x: Column) -> Column:
    return F.split(x, r"\Q" + sep + r"\E")


def substr(x: Column, offset: int, length: int) -> Column:
    start = F.lit(offset + 1) if offset >= 0 else F.length(x) + offset + 1
    return x.substr(start, F.lit(length) if length >= 0 else F.length(x))


_UNITS = {"ns": 0.001, "us": 1, "µs": 1, "ms": 1e3, "s": 1e6, "m": 60e6, "h": 3600e6}
_DURATION = re.compile(r"([-+]?)((?:\d+(?:\.\d*)?|\.\d+)(?:ns|us|µs|ms|s|m|h))+")


def timeadd(t: Column, duration: str) -> Column:
    """The time after a duration like ``1h30m`` or ``-10s``."""
    if duration != "0" and not _DURATION.fullmatch(duration):
        raise ValueError(f"bad duration {duration!r}")
    micros = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", duration))
    return F.timestamp_micros(F.unix_micros(F.to_timestamp(t)) + F.lit(round(-micros if duration.startswith("-") else micros)).cast("bigint"))


def title(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def trim(x: Column, chars: str) -> Column:
    return F.btrim(x, F.lit(chars))


def trimprefix(x: Column, p: str) -> Column:
    return F.when(x.startswith(p), x.substr(F.lit(len(p) + 1), F.length(x))).otherwise(x)


def trimsuffix(x: Column, s: str) -> Column:
    return F.when(x.endswith(s), x.substr(F.lit(1), F.length(x) - len(s))).otherwise(x)


def trimspace(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def urlencode(x: Column) -> Column:
    return F.url_encode(x)


def basename(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def dirname(p: Column) -> Column:
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(".")


#: Names of the language's functions, and what gives them over Columns.
FUNCTIONS = {
    "abs": F.abs, "base64decode": lambda x: F.unbase64(x).cast("string"), "base64encode": base64encode, "ceil": F.ceil, "chomp": chomp, "chunklist": chunklist,
    "cidrhost": cidrhost, "cidrnetmask": cidrnetmask, "cidrsubnet": cidrsubnet, "cidrsubnets": cidrsubnets, "coalesce": F.coalesce, "coalescelist": coalescelist, "compact": compact,
    "concat": F.concat, "contains": F.array_contains, "csvdecode": csvdecode, "convert": lambda x, t: x.try_cast(t), "distinct": F.array_distinct, "element": element, "flatten": flatten,
    "floor": F.floor, "format": format_, "formatdate": formatdate, "formatlist": formatlist, "indent": indent, "index": index,
    "join": lambda sep, a: F.array_join(a, sep), "jsondecode": F.parse_json, "jsonencode": F.to_json, "keys": keys, "length": F.size, "log": log, "lookup": lookup,
    "lower": F.lower, "max": F.greatest, "merge": merge, "min": F.least, "parseint": parseint, "pow": F.pow, "range": range_, "reverse": F.reverse,
    "replace": F.replace, "regex_replace": F.regexp_replace, "setintersection": F.array_intersect, "setproduct": setproduct, "setunion": F.array_union,
    "sha256": lambda x: F.sha2(x, 256), "sha512": lambda x: F.sha2(x, 512), "signum": F.signum, "slice": slice_, "sort": F.array_sort, "split": split,
    "strlen": F.char_length, "strrev": F.reverse, "substr": substr, "timeadd": timeadd, "title": title, "trim": trim, "trimprefix": trimprefix,
    "trimspace": trimspace, "trimsuffix": trimsuffix, "upper": F.upper, "urlencode": urlencode, "uuidv4": F.uuid, "uuidv5": uuidv5, "values": values,
    "zipmap": F.map_from_arrays, "basename": basename, "dirname": dirname, "md5": F.md5, "sha1": F.sha1,
}
