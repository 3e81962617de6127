"""Seeded rows that keep a table's rules: keys, references, uniqueness, patterns, ranges and checks.

Each value follows from the row's number, the seed and the column's place alone, so the same seed gives the same rows however they are
partitioned, and a child table finds its parents' keys from their row numbers, without collecting or joining either table. Unique
values are a permutation of as many numbers as there are values.
"""

from __future__ import annotations

import math
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.tables import ColumnSpec, TableSpec

#: One row in so many has a null where a column allows it.
NULLS = 20
#: Times that a row is made again if it breaks a check, at once at first and for those that are left then.
ATTEMPTS = (8, 56)
#: Whole numbers below it are longs.
LONG = 1 << 63
INTEGERS = {"tinyint": 7, "smallint": 15, "int": 31, "integer": 31, "bigint": 63, "long": 63}
TEXTS = ("string", "varchar", "char")
ATOM = re.compile(r"(\\[dw]|\\.|\[[^\]]+\]|[^\\\[\]{}?])(?:\{(\d+)(?:,(\d+))?\}|(\?))?")


def atoms(pattern: str) -> list[tuple[str, int, int]]:
    """(characters, least, most) of each part of a pattern of plain characters, \\d, \\w and [a-z0-9_] classes, each with {n}, {m,n} or ?."""
    out, at = [], 0
    while at < len(pattern):
        m = ATOM.match(pattern, at)
        if not m:
            raise ValueError(f"bad pattern at {pattern[at:]!r}")
        one = m[1]
        if one in ("\\d", "\\w"):
            one = "0123456789" if one == "\\d" else "abcdefghijklmnopqrstuvwxyz0123456789_"
        elif one[0] == "\\":
            one = one[1]
        elif one[0] == "[":
            one = re.sub(r"(.)-(.)", lambda r: "".join(map(chr, range(ord(r[1]), ord(r[2]) + 1))), one[1:-1])
        least = 0 if m[4] else int(m[2] or 1)
        out.append(("".join(dict.fromkeys(one)), least, 1 if m[4] else int(m[3] or least)))
        at = m.end()
    return out


def capacity(pattern: str) -> int:
    """Texts that a pattern with each part at its least length stands for."""
    return math.prod(len(chars) ** least for chars, least, _ in atoms(pattern))


def spelled(number: Column, pattern: str, h: Column | None = None) -> Column:
    """The text of a pattern with this number, below its capacity: different ones for different numbers. h, a hash, chooses what is optional."""
    parts: list[Column] = []
    small = capacity(pattern) < LONG
    rest = number.cast("bigint" if small else "decimal(38,0)")
    for k, (chars, least, most) in enumerate(atoms(pattern)):
        letter = lambda n, chars=chars: F.substring(F.lit(chars), (n + 1).cast("int"), F.lit(1))
        for _ in range(least):
            if len(chars) > 1:
                parts.append(letter(rest % len(chars)))
                rest = F.call_function("div", rest, F.lit(len(chars)).cast("bigint")) if small else F.floor(rest / len(chars)).cast("decimal(38,0)")
            else:
                parts.append(F.lit(chars))
        for j in range(most - least):
            if h is not None:
                own = F.pmod(F.xxhash64(h, F.lit(k), F.lit(j)), F.lit(2 * len(chars)))
                parts.append(F.when(own < len(chars), letter(own)).otherwise(""))
    return F.concat(*parts) if parts else F.lit("")


def permuted(i: Column, n: int, seed: int, below: int | None = None) -> Column:
    """A permutation of 0 … n - 1 by the seed: a step that has no divisor in common with n, about the golden ratio of it, and a start. below: i is less, n if not given."""
    step = max(int(n * 0.6180339887498949) + seed % 101, 1)
    while math.gcd(step, n) != 1:
        step += 1
    if (n if below is None else below) * n + n < LONG:
        return F.pmod(i.cast("bigint") * F.lit(step % n or 1).cast("bigint") + F.lit(seed * 7919 % n).cast("bigint"), F.lit(n).cast("bigint"))
    return F.pmod(i.cast("decimal(19,0)") * F.lit(step % n or 1).cast("decimal(19,0)") + F.lit(seed * 7919 % n).cast("decimal(19,0)"), F.lit(n).cast("decimal(38,0)")).cast("bigint")


def _bounds(c: ColumnSpec) -> tuple[int, int]:
    """Least and greatest whole number of a column of integers."""
    low = int(math.ceil(c.low)) if c.low is not None else 0
    return low, int(math.floor(c.high)) if c.high is not None else max(low, 0) + (1 << min(INTEGERS[c.type], 40)) - 1


def unique_value(c: ColumnSpec, i: Column, n: int, seed: int) -> Column:
    """A value for each row number below n, different for different ones."""
    if c.allowed:
        room, made = len(c.allowed), lambda j: F.element_at(F.array(*map(F.lit, c.allowed)), (j + 1).cast("int"))
    elif c.pattern:
        room, made = capacity(c.pattern), lambda j: spelled(j, c.pattern)
    elif c.type in INTEGERS:
        low, high = _bounds(c)
        room, made = (high - low + 1, lambda j: j + low) if c.low is not None or c.high is not None else (n, lambda j: j + 1)
    elif c.type.startswith(TEXTS):
        digits = len(str(max(n - 1, 1)))
        if c.max_length is not None and c.max_length < digits:
            raise ValueError(f"{c.name} has room for {10**c.max_length} different texts, {n} are asked for")
        room, made = n, lambda j: F.lpad(j.cast("string"), digits, "0")
    elif c.type in ("date", "timestamp", "timestamp_ntz"):
        low, high = _seconds(c)
        step = 86400 if c.type == "date" else 1
        room, made = (high - low) // step + 1, lambda j: _timed(c, F.lit(low) + j * step)
    elif c.type in ("double", "float") or c.type.startswith("decimal"):
        low, high = c.low if c.low is not None else 0, c.high
        whole = c.high is None or c.high - low >= n - 1
        room, made = n, lambda j: (j + low) if whole else low + j * ((c.high - low) / max(n - 1, 1))
        if high is not None and c.type.startswith("decimal") and not whole:
            raise ValueError(f"{c.name}: unique decimals need whole steps between low and high")
    else:
        raise ValueError(f"{c.name}: no unique values of type {c.type}")
    if room < n:
        raise ValueError(f"{c.name} has room for {room} different values, {n} are asked for")
    return made(permuted(i, room, seed, n) if room >= 1 else i)


def _seconds(c: ColumnSpec) -> tuple[int, int]:
    import datetime as dt

    def of(x, default: str) -> int:
        at = dt.datetime.fromisoformat(str(x if x is not None else default))
        return int(at.replace(tzinfo=at.tzinfo or dt.UTC).timestamp())

    return of(c.low, "2000-01-01"), of(c.high, "2031-12-31")


def _timed(c: ColumnSpec, seconds: Column) -> Column:
    days = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    return days if c.type == "date" else F.timestamp_seconds(seconds.cast("bigint"))


def _below(h: Column, n: int) -> Column:
    """A hash's remainder by n."""
    kind = "bigint" if n < LONG else "decimal(38,0)"
    return F.pmod(h.cast(kind), F.lit(str(n)).cast(kind))


def any_value(c: ColumnSpec, i: Column, seed: int, place: int, attempt: Column) -> Column:
    """A value by the rules of one column."""
    h = F.xxhash64(i, F.lit(seed), F.lit(place), attempt)
    part = F.pmod(h, F.lit(1 << 40))
    if c.allowed:
        return F.element_at(F.array(*map(F.lit, c.allowed)), (part % len(c.allowed)).cast("int") + 1)
    if c.pattern:
        return spelled(_below(h, capacity(c.pattern)), c.pattern, h)
    if c.type in INTEGERS:
        low, high = _bounds(c) if c.low is not None or c.high is not None else (0, 1000)
        return F.lit(low) + _below(h, high - low + 1).cast("bigint")
    if c.type == "boolean":
        return part % 2 == 0
    if c.type in ("date", "timestamp", "timestamp_ntz"):
        low, high = _seconds(c)
        return _timed(c, F.lit(low) + part % (high - low + 1))
    if c.type.startswith(TEXTS):
        return F.left(F.sha2(h.cast("string"), 256), F.lit(min(c.max_length if c.max_length is not None else 12, 64)))
    if c.type == "binary":
        return F.unhex(F.left(F.sha2(h.cast("string"), 256), F.lit(16)))
    low, high = c.low if c.low is not None else 0, c.high if c.high is not None else 1000
    return F.lit(low) + part / (1 << 40) * (high - low)


def key_value(spec: TableSpec, column: str, i: Column, n: int, seed: int) -> Column:
    """The key column's value of row i of n: of several key columns, the last one numbers the rows and the others are free."""
    c = next(c for c in spec.columns if c.name == column)
    place = [c.name for c in spec.columns].index(column)
    unique = column in (*spec.unique, *spec.key[-1:])
    return (unique_value(c, i, n, seed + place) if unique else any_value(c, i, seed, place, F.lit(0))).cast(c.type)


def generated(spark: SparkSession, spec: TableSpec, n: int, seed: int, parents: dict[str, tuple[TableSpec, int, int]] | None = None) -> DataFrame:
    """n rows of the spec. parents: of each table that it references, its spec, number of rows and seed, as that is generated with.

    A row that breaks a check is made again with other values, keys and unique columns aside: its first good turn is looked for, from the columns
    that the checks name alone, and the whole row is made once from it. Nothing is shuffled, as rows are in the order of their numbers; an error
    if all of ATTEMPTS break a check. A reference to a table of no rows is null, or an error where it must not be.
    """
    known = dict(parents or {})
    references = {column: (table, target) for column, table, target in spec.references if table in known}
    own = uuid.uuid4().hex
    number, turn, made = f"i_{own}", f"a_{own}", f"r_{own}"

    def value(c: ColumnSpec, place: int, attempt: Column) -> Column:
        i = F.col(number)
        if c.name in references:
            table, target = references[c.name]
            parent, rows, parent_seed = known[table]
            if not rows and not c.nullable:
                raise ValueError(f"{c.name} references {table}, which has no rows")
            x = key_value(parent, target, F.pmod(F.xxhash64(i, F.lit(seed), F.lit(place), attempt), F.lit(rows)), rows, parent_seed) if rows else F.lit(None)
        elif c.name in (*spec.key, *spec.unique):
            return key_value(spec, c.name, i, n, seed)
        else:
            x = any_value(c, i, seed, place, attempt)
        x = x.cast(c.type)
        null = F.pmod(F.xxhash64(i, F.lit(seed), F.lit(-place - 1), attempt), F.lit(NULLS)) == 0
        return F.when(~null, x) if c.nullable and c.name not in spec.key else x

    ids = spark.range(n).withColumnRenamed("id", number)
    if n == 0 or not spec.checks:
        return ids.select(*(value(c, k, F.lit(0)).alias(c.name) for k, c in enumerate(spec.columns)))
    good = F.lit(True)
    for condition in spec.checks.values():
        good = good & F.coalesce(F.expr(condition), F.lit(True))
    checked = [(k, c) for k, c in enumerate(spec.columns) if "`" in c.name or any(re.search(rf"(?i)(?<!\w){re.escape(c.name)}(?!\w)", x) for x in spec.checks.values())]

    def keeps(ids: DataFrame) -> DataFrame:
        """number and turn, and whether the row of that turn keeps the checks: only the columns that a check names are made."""
        return ids.select(*ids.columns, *(value(c, k, F.col(turn)).alias(c.name) for k, c in checked)).select(*ids.columns, good.alias(made))

    left, turns, done = keeps(ids.withColumn(turn, F.lit(0))).select(number, F.when(F.col(made), F.col(turn)).alias(turn)), [], 0
    for more in ATTEMPTS:
        turns.append(left.where(F.col(turn).isNotNull()))
        tried = keeps(left.where(F.col(turn).isNull()).select(number, F.explode(F.sequence(F.lit(done + 1), F.lit(done + more))).alias(turn)))
        left, done = tried.groupBy(number).agg(F.min(F.when(F.col(made), F.col(turn))).alias(turn)), done + more
    failed = F.raise_error(F.lit(f"no row keeps the checks of {spec.name}"))
    turns.append(left.select(number, F.coalesce(F.col(turn), failed.cast("int")).alias(turn)))
    return reduce(DataFrame.unionByName, turns).select(*(value(c, k, F.col(turn)).alias(c.name) for k, c in enumerate(spec.columns)))
