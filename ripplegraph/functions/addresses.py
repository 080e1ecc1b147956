"""Address ranges and name-based ids, as column expressions over whole numbers.

An address of either family is four words of 32 bits, the first the highest; an IPv4 address has
only the last. Nothing leaves the JVM. What a formula needs more than once is bound to a name, as the
expression would otherwise hold it, and all that it is made of, once for each place.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplegraph.functions.paths import bound

_ALL = (1 << 32) - 1
_OCTET = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _left(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n.cast("int"))


def _right(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n.cast("int"))


def _error(message: str, x: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{message}: "), x))


def _ipv4(x: Column) -> Column:
    return F.aggregate(F.split(x, r"\."), F.lit(0).cast("bigint"), lambda n, o: n * 256 + o.cast("bigint"))


def _plain(x: Column) -> Column:
    """An IPv6 address with an IPv4 ending written as two groups."""

    def with_ending(ending: Column) -> Column:
        in_hex = bound(_ipv4(ending), lambda n: F.concat(F.lower(F.hex(_right(n, F.lit(16)))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(65535)))))
        return F.when(ending == "", x).otherwise(F.concat(F.substring(x, F.lit(1), F.length(x) - F.length(ending)), in_hex))

    return bound(F.regexp_extract(x, rf"(?<=:){_IPV4}\z", 0), with_ending)


def _groups(x: Column) -> Column:
    """The eight groups of an IPv6 address as numbers, or null: ``::`` filled, an IPv4 ending as two groups."""
    listed = lambda s: F.filter(F.split(s, ":"), lambda g: s != "")

    def filled(y: Column) -> Column:
        n = 8 - F.size(y["left"]) - F.size(y["right"])
        return F.when(~y["open"], y["left"]).when(n > 0, F.concat(y["left"], F.array_repeat(F.lit("0"), n), y["right"]))

    def sides(plain: Column) -> Column:
        left, right = F.substring_index(plain, "::", 1), F.regexp_extract(plain, r"(?s)::(.*)\z", 1)
        return F.struct(F.contains(plain, F.lit("::")).alias("open"), bound(left, listed).alias("left"), bound(right, listed).alias("right"))

    def numbers(groups: Column) -> Column:
        sound = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike(r"\A[0-9A-Fa-f]{1,4}\z"))
        return F.when(sound, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("bigint")))

    return bound(bound(bound(_plain(x), sides), filled), numbers)


def _paired(groups: Column) -> Column:
    return F.when(groups.isNotNull(), _words(lambda k: F.get(groups, 2 * k) * 65536 + F.get(groups, 2 * k + 1)))


def parsed(cidr: Column) -> Column:
    """v4, length (of 128 bits: 96 more for IPv4) and words of a range such as ``10.1.2.3/16``; bad ones are errors."""
    zero = F.lit(0).cast("bigint")

    def split(c: Column) -> Column:
        address, length = F.regexp_extract(c, r"\A([^/]*)/(?:0|[1-9]\d{0,2})\z", 1), F.regexp_extract(c, r"/(0|[1-9]\d{0,2})\z", 1).try_cast("int")
        return F.struct(c.alias("text"), address.alias("address"), address.rlike(rf"\A{_IPV4}\z").alias("v4"), length.alias("length"))

    def read(x: Column) -> Column:
        words = F.when(x["v4"], F.array(zero, zero, zero, _ipv4(x["address"]))).otherwise(bound(_groups(x["address"]), _paired))
        return F.struct(x["v4"].alias("v4"), F.when(x["v4"], x["length"] + 96).otherwise(x["length"]).alias("length"), words.alias("words"))

    def judged(x: Column) -> Column:
        good = lambda r: (x["address"] != "") & r["words"].isNotNull() & (r["length"] <= 128)
        return bound(read(x), lambda r: F.when(F.coalesce(good(r), F.lit(False)), r).otherwise(_error("bad address range", x["text"])))

    return F.when(cidr.isNotNull(), bound(bound(cidr, split), judged))


def _mask(length: Column, k: Column) -> Column:
    """Word k of the mask with so many leading ones."""
    return F.lit(1 << 32).cast("bigint") - _left(F.lit(1).cast("bigint"), 32 - F.least(F.greatest(length - 32 * k, F.lit(0)), F.lit(32)))


def _shifted(n: Column, by: Column, k: Column) -> Column:
    """Word k of the number n, sign and all, moved up by so many bits."""
    d = by - 32 * (3 - k)
    up = F.when(d < 32, _left(n, d)).otherwise(F.lit(0).cast("bigint"))
    return F.when(d >= 0, up).otherwise(_right(n, F.least(-d, F.lit(63)))).bitwiseAND(_ALL)


def _words(give) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(3)), give)


def _text(v4: Column, words: Column) -> Column:
    """An address as written: IPv6 in lower case, its first longest run of two zeros or more as ``::``."""
    octets = bound(F.get(words, F.lit(3)), lambda w: F.concat_ws(".", *[_right(w, F.lit(s)).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]))
    pairs = F.flatten(F.transform(words, lambda x: F.array(_right(x, F.lit(16)), x.bitwiseAND(65535))))
    joined = F.concat(F.lit(":"), F.array_join(F.transform(pairs, lambda g: F.lower(F.hex(g))), ":"), F.lit(":"))

    def shortened(s: Column) -> Column:
        out = None
        for n in range(8, 1, -1):
            run = F.lit(":0" * n + ":")
            at = F.locate(":0" * n + ":", s)
            short = F.concat(F.substring(s, F.lit(2), F.greatest(at - 2, F.lit(0))), F.lit("::"), F.rtrim(F.substring(s, at + F.length(run), F.length(s)), F.lit(":")))
            out = F.when(at > 0, short) if out is None else out.when(at > 0, short)
        return out.otherwise(F.btrim(s, F.lit(":")))

    return F.when(v4, octets).otherwise(bound(joined, shortened))


def _of(cidr: Column, n: Column, give) -> Column:
    """``give`` of the range, read once and without what lies below its mask, of the number and of the range's text."""
    clear = lambda r: F.struct(r["v4"].alias("v4"), r["length"].alias("length"), _words(lambda k: F.get(r["words"], k).bitwiseAND(_mask(r["length"], k))).alias("words"))
    row = lambda c: F.struct(c.alias("text"), n.alias("n"), bound(parsed(c), clear).alias("range"))
    return F.when(cidr.isNotNull(), bound(bound(cidr, row), lambda x: give(x["range"], x["n"], x["text"])))


def _number(n: Column | int) -> Column:
    return (F.lit(n) if isinstance(n, int) else n).cast("bigint")


def _fits(n: Column, bits: Column) -> Column:
    """Whether a number that is not negative has at most so many bits."""
    return (bits >= 63) | (_right(n, F.least(bits, F.lit(63))) == 0)


def cidrhost(cidr: Column, n: Column | int) -> Column:
    """The address with this number in a range; numbers below zero count from its end. Past the range is an error."""

    def give(r: Column, n: Column, text: Column) -> Column:
        inside = _words(lambda k: F.get(r["words"], k).bitwiseOR(_shifted(n, F.lit(0), k).bitwiseAND(F.lit(_ALL) - _mask(r["length"], k))))
        fits = _fits(F.when(n < 0, F.bitwise_not(n)).otherwise(n), 128 - r["length"])
        shown = bound(inside, lambda w: _text(r["v4"], w))
        return F.when(n.isNull(), None).when(fits, shown).otherwise(_error("no such host in", text))

    return _of(cidr, _number(n), give)


def cidrnetmask(cidr: Column) -> Column:
    return _of(cidr, _number(0), lambda r, n, text: bound(_words(lambda k: _mask(r["length"], k)), lambda w: _text(r["v4"], w)))


def cidrsubnet(cidr: Column, bits: int, n: Column | int) -> Column:
    """Part n of a range that is cut by so many more bits; too many bits or no such part is an error."""

    def give(r: Column, n: Column, text: Column) -> Column:
        length = r["length"] + bits
        words = _words(lambda k: F.get(r["words"], k).bitwiseOR(_shifted(n, 128 - length, k)))
        shown = F.concat(bound(words, lambda w: _text(r["v4"], w)), F.lit("/"), (length - F.when(r["v4"], 96).otherwise(0)).cast("string"))
        return F.when(n.isNull(), None).when((length <= 128) & (n >= 0) & _fits(n, F.lit(bits)), shown).otherwise(_error("no such part of", text))

    return _of(cidr, _number(n), give)


def cidrsubnets(cidr: Column, *bits: int) -> Column:
    """Parts with so many more bits each, one after another, each at the next multiple of its size.

    Places depend on the sizes alone, so that they are worked out once and not for each row. Parts
    past the range's end, and bits under 1 or over 62, are errors.
    """
    at, parts = Fraction(0), []
    for b in bits:
        if not 1 <= b <= 62:
            raise ValueError(f"cannot cut a range by {b} bits")
        place = -(-at * (1 << b) // 1)
        if place >= 1 << b:
            raise ValueError("the range has no room left")
        at = Fraction(place + 1, 1 << b)
        parts.append(cidrsubnet(cidr, b, int(place)))
    return F.array(*parts)


#: Spaces of names that have a name themselves.
SPACES = {"dns": uuid.NAMESPACE_DNS, "url": uuid.NAMESPACE_URL, "oid": uuid.NAMESPACE_OID, "x500": uuid.NAMESPACE_X500}


def uuidv5(space: uuid.UUID | str, name: Column) -> Column:
    """The id of a name in a space: one of ``SPACES``, or an id."""
    space = space if isinstance(space, uuid.UUID) else SPACES.get(space) or uuid.UUID(space)
    h = F.sha1(F.concat(F.unhex(F.lit(space.hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
