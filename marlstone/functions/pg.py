"""PostgreSQL's scalar semantics as Column expressions, where Spark's function of the same name differs or is absent."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*parts: Column) -> Column:
    """Nulls are skipped; Spark's concat is null if one part is."""
    return F.concat_ws("", *parts)


def substring(s: Column, start: int, length: int) -> Column:
    """Positions before 1 count towards the length."""
    first, end = max(start, 1), start + length
    return F.substring(s, first, max(end - first, 0))


def left(s: Column, n: int) -> Column:
    """A negative n leaves off the last characters."""
    return F.left(s, F.lit(n)) if n >= 0 else F.left(s, F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n)) if n >= 0 else F.right(s, F.greatest(F.length(s) + n, F.lit(0)))


def regexp_replace(s: Column, pattern: str, to: str, flags: str = "") -> Column:
    """Only the first match, unless flags has g; i ignores case. In `to`, \\1 to \\9 are groups, \\& is the match and \\\\ a backslash."""
    all_of = "g" in flags
    shift = 0 if all_of else 2  # the first match stands in a group of its own, after the text before it

    def part(m: re.Match) -> str:
        if m[0] == "$":
            return "\\$"
        c = m[1]
        return f"${int(c) + shift}" if c.isdigit() and c != "0" else f"${shift}" if c == "&" else "\\\\" if c == "\\" else re.escape(c)

    to = re.sub(r"\\(.)|\$", part, to, flags=re.S)
    if not all_of:
        inner = re.sub(r"\\(.)", lambda m: f"\\{int(m[1]) + shift}" if m[1] in "123456789" else m[0], pattern, flags=re.S)
        pattern, to = rf"\A((?s:.*?))({inner})", "$1" + to
    return F.regexp_replace(s, f"(?i){pattern}" if "i" in flags else pattern, to)


def similar_to(s: Column, pattern: str) -> Column:
    """SQL's regular expressions: % and _ as in LIKE; | * + ? {} () [] as usual; all else is plain. The whole text must match."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "[":
            end = pattern.index("]", k + 2)
            out, k = out + pattern[k : end + 1], end
        elif c == "\\" and k + 1 < len(pattern):
            out, k = out + re.escape(pattern[k + 1]), k + 1
        else:
            out += {"%": ".*", "_": "."}.get(c) or (c if c in "|*+?{}(),0123456789" else re.escape(c))
        k += 1
    return s.rlike(f"(?s)^(?:{out})$")


def int_div(a: str, b: str) -> Column:
    """Integer division, truncated towards zero; operands as SQL text."""
    return F.expr(f"({a}) div ({b})")


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor of longs, by Euclid's steps: at most 92 for 64 bits. An error if it is 2 ^ 63."""
    wide = "decimal(20,0)"  # the least long has no opposite among longs
    start = F.struct(F.abs(a.cast(wide)).alias("a"), F.abs(b.cast(wide)).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).cast(wide).alias("b")))
    small = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    fast = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    least = F.lit(-(1 << 63)).cast("long")
    steps = F.sequence(F.lit(1), F.lit(92))
    out = F.when((a.cast("long") == least) | (b.cast("long") == least), F.aggregate(steps, start, step)["a"].cast("long")).otherwise(F.aggregate(steps, small, fast)["a"])
    return F.when(a.isNotNull() & b.isNotNull(), out)


def lcm(a: Column, b: Column) -> Column:
    """The least common multiple of longs, exact; an error where it is none."""
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", F.abs(a.cast("long")), g) * F.abs(b.cast("long")))


def trunc(x: Column, scale: int = 0) -> Column:
    """Digits beyond the scale are cut off, towards zero, in decimal: 0.29 at scale 2 stays 0.29. Doubles from 10 ^ 15 on have no digits that a scale up to 1 cuts."""
    cut = F.floor(F.abs(x).cast("decimal(38,18)"), F.lit(scale)).cast("double")
    return F.when(F.abs(x) >= 1e15, x).otherwise(F.signum(x) * cut)



def dow(ts: Column) -> Column:
    """Day of the week, Sunday 0; Spark's is 1."""
    return F.dayofweek(ts) - 1


def date_bin(seconds: int, ts: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """Start of the interval that holds ts, intervals being counted from the origin. The session zone must be UTC."""
    step, base = seconds * 1_000_000, F.unix_micros(F.lit(origin).cast("timestamp"))
    at = F.unix_micros(ts.cast("timestamp")) - base
    return F.timestamp_micros(base + at - F.pmod(at, F.lit(step))).cast("timestamp_ntz")


def at_time_zone(ts: Column, zone: str) -> Column:
    """The local time in a zone of a UTC timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def any_equal(x: Column, array: Column) -> Column:
    """x = ANY(array): true, false, or null if only a null could have matched."""
    return F.exists(array, lambda e: e == x)


def all_greater(x: Column, array: Column) -> Column:
    """x > ALL(array), true for an empty array."""
    return F.forall(array, lambda e: x > e)


def _compared(x: Column, op: str, e: Column) -> Column:
    return {"=": x == e, "<>": x != e, "<": x < e, "<=": x <= e, ">": x > e, ">=": x >= e}[op]


def any_of(x: Column, op: str, array: Column) -> Column:
    """x op ANY(array) for = <> < <= > >=: null if only a null could have met the condition, false for an empty array."""
    return F.exists(array, lambda e: _compared(x, op, e))


def all_of(x: Column, op: str, array: Column) -> Column:
    """x op ALL(array): null if only a null could have failed the condition, true for an empty array."""
    return F.forall(array, lambda e: _compared(x, op, e))


def contains(array: Column, other: Column) -> Column:
    """array @> other: null elements meet nothing, so another array with one is never contained; null if an array is. other <@ array is the same."""
    return F.when(array.isNotNull() & other.isNotNull(), F.forall(other, lambda e: F.coalesce(F.array_contains(array, e), F.lit(False))))


def overlaps(array: Column, other: Column) -> Column:
    """array && other: null elements meet nothing; null if an array is."""
    return F.when(array.isNotNull() & other.isNotNull(), F.exists(other, lambda e: F.coalesce(F.array_contains(array, e), F.lit(False))))


def _first(value: Column, at: Column, descending: bool, nulls_first: bool | None) -> tuple[Column, Column]:
    """Whether a value comes before `at`, and whether it is a peer of it. Nulls come last in ascending and first in descending order, unless said otherwise."""
    nulls = descending if nulls_first is None else nulls_first
    before = F.when(at.isNull(), value.isNotNull() & F.lit(not nulls)).when(value.isNull(), F.lit(nulls)).otherwise(value > at if descending else value < at)
    return before, value.eqNullSafe(at)


def hypothetical_rank(at: Column, value: Column, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """rank(at) WITHIN GROUP (ORDER BY value): the place that `at` would have."""
    return F.count_if(_first(value, at, descending, nulls_first)[0]) + 1


def hypothetical_percent_rank(at: Column, value: Column, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """0 without rows."""
    return F.coalesce(F.count_if(_first(value, at, descending, nulls_first)[0]) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))


def hypothetical_cume_dist(at: Column, value: Column, descending: bool = False, nulls_first: bool | None = None) -> Column:
    before, peer = _first(value, at, descending, nulls_first)
    return (F.count_if(before | peer) + 1) / (F.count("*") + 1)


def json_agg(value: Column, *by: Column) -> Column:
    """json_agg(value ORDER BY by), without white space; value is a struct, map or array. Null keys come last, equal ones in the order of their values' text. Null without rows."""
    text = F.coalesce(F.to_json(value, {"ignoreNullFields": "false"}), F.lit("null"))
    rows = F.sort_array(F.collect_list(F.struct(*(x for i, b in enumerate(by) for x in (b.isNull().alias(f"n{i}"), b.alias(f"k{i}"))), text.alias("t"))))
    return F.when(F.size(rows) > 0, F.concat(F.lit("["), F.array_join(F.transform(rows, lambda s: s["t"]), ","), F.lit("]")))


def json_object_agg(key: Column, value: Column) -> Column:
    """json_object_agg(key, value ORDER BY key), without white space; a null key is an error, and so is a repeated one, as in json_object_agg_unique."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))))), {"ignoreNullFields": "false"})


def array_positions(array: Column, x: Column) -> Column:
    hits = F.transform(array, lambda e, i: F.when(e.eqNullSafe(x), i + 1))
    return F.array_compact(hits)


def trim_array(array: Column, n: int) -> Column:
    return F.slice(array, 1, F.greatest(F.size(array) - n, F.lit(0)))


def ordered_array_agg(value: Column, *by: Column) -> Column:
    """array_agg(value ORDER BY by): nulls are kept."""
    keyed = F.struct(*(b.alias(f"k{i}") for i, b in enumerate(by)), value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(keyed)), lambda s: s["v"])


def array_text(array: Column) -> Column:
    """PostgreSQL's text form of a one-dimensional array: {a,"b c",NULL}."""
    text = array.cast("array<string>")
    plain = lambda e: e.rlike(r'^[^\s{}",\\]+$') & (F.lower(e) != "null")
    quoted = lambda e: F.concat(F.lit('"'), F.regexp_replace(e, r'(["\\])', r"\\$1"), F.lit('"'))
    item = lambda e: F.when(e.isNull(), "NULL").when(plain(e), e).otherwise(quoted(e))
    return F.concat(F.lit("{"), F.array_join(F.transform(text, item), ","), F.lit("}"))


def array_of(text: Column) -> Column:
    """Reads the text form back to strings. A backslash makes the next character plain, with or without quotes; NULL in any case is null unless quoted."""
    items = F.regexp_extract_all(text, F.lit(r'("(?:[^"\\]|\\.)*"|(?:[^{},"\\]|\\.)+)'), F.lit(1))
    bare = lambda e: F.regexp_replace(F.regexp_replace(e, r"^\s+|(?<!\\)\s+$", ""), r"\\(.)", "$1")
    plain = lambda e: F.when(F.lower(F.trim(e)) == "null", F.lit(None)).otherwise(bare(e))
    unquoted = lambda e: F.regexp_replace(F.substring(e, 2, 2**31 - 3), r"\\(.)", "$1")
    cut = lambda e: F.when(e.startswith('"'), unquoted(F.regexp_replace(e, '"$', ""))).otherwise(plain(e))
    return F.transform(F.filter(items, lambda e: e.rlike(r"\S")), cut)
