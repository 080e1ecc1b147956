"""Comma-separated records in a text column, as column expressions.

Fields are plain or in double quotes; a quote inside quotes is doubled, and quoted fields may hold
commas and line breaks. Line breaks are LF or CRLF (also inside quotes, where CRLF becomes LF).
Empty lines are no records. A quote in a plain field, text after a closing quote and an open quote at
the end are errors. Every step is a linear scan of the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplegraph.functions.paths import bound

#: One record with its line break; one field with the comma or line break after it. Each begins where the one
#: before ends, so that text after a problem isn't searched again from every place in it.
_RECORD = r'\G(?:[^"\n]++|"[^"]*+")*+\n'
_FIELD = r'\G(?:"[^"]*+(?:""[^"]*+)*+"|[^,"\n]*+)[,\n]'


def _lines(text: Column) -> Column:
    """The text with LF only, closed by one."""
    plain = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\r\z", "")
    return bound(plain, lambda p: F.when((p == "") | p.endswith("\n"), p).otherwise(F.concat(p, F.lit("\n"))))


def _length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))


def _fields(record: Column) -> Column:
    bare = lambda t: F.substring(t, F.lit(1), F.length(t) - 1)
    opened = lambda t: F.replace(F.substring(t, F.lit(2), F.length(t) - 3), F.lit('""'), F.lit('"'))
    value = lambda t: F.when(t.startswith('"'), opened(t)).otherwise(bare(t))
    return bound(F.regexp_extract_all(record, F.lit(_FIELD), F.lit(0)), lambda tokens: F.when(_length(tokens) == F.length(record), F.transform(tokens, value)))


def parsed(text: Column) -> Column:
    """header, rows, problem of a text: the first record, the others, and why it can't be read.

    Of a text with a problem header and rows may be anything. Null gives null.
    """
    split = lambda lines: bound(
        F.regexp_extract_all(lines, F.lit(_RECORD), F.lit(0)),
        lambda records: F.struct((_length(records) == F.length(lines)).alias("whole"), F.transform(F.filter(records, lambda r: r != "\n"), _fields).alias("all")),
    )
    return bound(text, lambda t: F.when(t.isNotNull(), bound(bound(_lines(t), split), _judged)))


def _judged(x: Column) -> Column:
    return bound(F.struct(F.try_element_at(x["all"], F.lit(1)).alias("header"), F.slice(x["all"], F.lit(2), F.greatest(F.size(x["all"]), F.lit(1))).alias("rows")), lambda y: _with_problem(x, y))


def _with_problem(x: Column, y: Column) -> Column:
    header, rows = y["header"], y["rows"]
    broken = ~x["whole"] | F.exists(x["all"], lambda r: r.isNull())
    problem = (
        F.when(broken, "bad quotes").when(F.size(x["all"]) == 0, "missing header")
        .when(F.size(F.array_distinct(header)) < F.size(header), "repeated column name")
        .when(F.exists(rows, lambda r: F.size(r) != F.size(header)), "wrong number of fields")
    )
    return F.struct(header.alias("header"), rows.alias("rows"), problem.alias("problem"))


def csvdecode(text: Column) -> Column:
    """A map for each record after the header, by the header's names; a text with a problem is an error."""
    decode = lambda x: F.when(x["problem"].isNotNull(), F.raise_error(F.concat(F.lit("bad records: "), x["problem"]))).otherwise(
        F.transform(x["rows"], lambda r: F.map_from_arrays(x["header"], r))
    )
    return bound(parsed(text), lambda x: F.when(x.isNotNull(), decode(x)))
