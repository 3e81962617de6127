"""Operators on tables of ranges, in which no group is one task's and no pairs are made before they are known to share a place."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import ranges

#: Places that one key's ranges are first dealt to.
DEALT = 16


def _islands(df: DataFrame, keys: list[str], r: str) -> DataFrame:
    """The ranges of each key, those that overlap or meet joined: a sorted stream, in which a range begins an island where all before it have ended."""
    own = uuid.uuid4().hex
    unbounded, upper, new, island = f"u_{own}", f"h_{own}", f"n_{own}", f"i_{own}"
    by = Window.partitionBy(*keys).orderBy(F.col(f"{r}.lower").asc_nulls_first(), F.desc(f"{r}.lower_inc"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.struct(F.col(f"{r}.upper").alias("x"), F.col(f"{r}.upper_inc").alias("inc"))
    df = df.withColumns({unbounded: F.coalesce(F.max(F.col(f"{r}.upper").isNull()).over(before), F.lit(False)), upper: F.max(F.when(F.col(f"{r}.upper").isNotNull(), ends)).over(before)})
    x, lower = F.col(upper), F.col(f"{r}.lower")
    apart = x.isNull() | (lower > x["x"]) | ((lower == x["x"]) & ~(x["inc"] | F.col(f"{r}.lower_inc")))
    df = df.withColumn(new, F.when(F.col(unbounded) | (lower.isNull() & x.isNotNull()), 0).otherwise(F.coalesce(apart, F.lit(False)).cast("int")))
    df = df.withColumn(island, F.sum(new).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.min(F.struct(F.col(f"{r}.lower").isNotNull().alias("some"), F.col(f"{r}.lower").alias("x"), (~F.col(f"{r}.lower_inc")).alias("out")))
    high = F.max(F.struct(F.col(f"{r}.upper").isNull().alias("none"), F.col(f"{r}.upper").alias("x"), F.col(f"{r}.upper_inc").alias("inc")))
    found = df.groupBy(*keys, island).agg(low.alias("low"), high.alias("high"))
    joined = F.struct(F.col("low.x").alias("lower"), F.col("high.x").alias("upper"), (~F.col("low.out")).alias("lower_inc"), F.col("high.inc").alias("upper_inc"), F.lit(False).alias("empty"))
    return found.select(*keys, joined.alias(r))


def merged_ranges(df: DataFrame, keys: list[str], r: str) -> DataFrame:
    """keys and r: the ranges of each key's range_agg(r), a row each; a key with empty or null ranges alone has none.

    A key's ranges are dealt to several tasks and joined there first, so what meets in one task is what a key has of islands.
    """
    own = f"d_{uuid.uuid4().hex}"
    real = df.where(F.col(r).isNotNull() & ~F.col(f"{r}.empty")).select(*keys, r)
    dealt = _islands(real.withColumn(own, F.pmod(F.xxhash64(r), F.lit(DEALT))), [*keys, own], r)
    return _islands(dealt.drop(own), keys, r)


def range_agg(df: DataFrame, keys: list[str], r: str) -> DataFrame:
    """keys and r, the multirange of each key's ranges; null where a key has null ranges alone, as in PostgreSQL."""
    order = F.struct(F.col(f"{r}.lower").isNotNull(), F.col(f"{r}.lower"), ~F.col(f"{r}.lower_inc"))
    each = merged_ranges(df, keys, r).select(*keys, F.struct(order.alias("o"), F.col(r).alias("r")).alias("s"))
    lists = each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["r"]).alias(r))
    return lists.unionByName(_without(df, keys, r, lists))


def _without(df: DataFrame, keys: list[str], r: str, lists: DataFrame) -> DataFrame:
    """Keys without any range that holds something: an empty multirange, or null."""
    real = F.count_if(F.col(r).isNotNull() & ~F.col(f"{r}.empty"))
    rest = df.groupBy(*keys).agg(real.alias("real"), F.count(r).alias("some")).where("real = 0")
    return rest.select(*keys, F.when(F.col("some") > 0, F.array().cast(lists.schema[r].dataType)).alias(r))


def _number(df: DataFrame, r: str) -> Column:
    """Turns a bound into a long or double that does not fall as the bound rises."""
    return _number_of(df.schema[r].dataType["lower"].dataType.typeName())


def _number_of(kind: str) -> Callable[[Column], Column]:
    if kind.startswith("timestamp"):
        return lambda c: F.unix_micros(c.cast("timestamp")) if kind == "timestamp" else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    return (lambda c: F.unix_date(c)) if kind == "date" else (lambda c: c.cast("double"))


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_range: str, right_range: str) -> DataFrame:
    """The pairs of rows of left and right with equal `on` whose ranges overlap: columns of left, and those of right without `on`. Nulls meet nothing.

    Each range has a level, by the power of two that its length fits in, and lies in two bins of that width at most. Rows of both sides meet at the
    coarser level of the two, in the bin where what they share begins, by an equi-join. A range is so copied twice at most for its own level and
    for each coarser one that the other side has, of LEVELS at all, however long it is; levels are found in one scan of both sides.
    """
    own = uuid.uuid4().hex
    level, bin_, first = f"level_{own}", f"bin_{own}", f"first_{own}"
    sides = {}
    for side, df, r in (("l", left, left_range), ("r", right, right_range)):
        number = _number(df, r)
        rows = df.where(F.col(r).isNotNull() & ~F.col(f"{r}.empty"))
        sides[side] = (rows, F.when(F.col(f"{r}.lower").isNotNull(), number(F.col(f"{r}.lower"))).cast("double"), F.when(F.col(f"{r}.upper").isNotNull(), number(F.col(f"{r}.upper"))).cast("double"))
    ends = [rows.select(low.alias("low"), high.alias("high")) for rows, low, high in sides.values()]
    span = ends[0].union(ends[1]).agg(F.min(F.least("low", "high")).alias("low"), F.max(F.greatest("low", "high")).alias("high")).first()
    low, high = (span["low"], span["high"]) if span["low"] is not None else (0.0, 0.0)
    unit = max(high - low, 1e-300) / (1 << LEVELS)

    def placed(rows: DataFrame, a: Column, b: Column) -> tuple[DataFrame, Column, Column]:
        """Bounds as parts of the whole span, and the level: LEVELS or less, the last one of which takes the span in two bins."""
        a, b = (F.coalesce(x, F.lit(y)) - low for x, y in ((a, low), (b, high)))
        steps = F.greatest((b - a) / unit, F.lit(1.0))
        return rows.withColumn(level, F.least(F.ceil(F.log2(steps)).cast("int"), F.lit(LEVELS))), a, b

    found = {side: placed(*x) for side, x in sides.items()}
    levels = {side: sorted(r[0] for r in df.select(level).distinct().collect()) for side, (df, _, _) in found.items()}

    def dealt(side: str, other: str) -> DataFrame:
        df, a, b = found[side]
        at = F.array(F.col(level), *(F.when(F.lit(k) > F.col(level), F.lit(k)) for k in levels[other]))
        df = df.withColumn("at_" + own, F.explode(F.array_distinct(F.array_compact(at))))
        width = F.lit(unit) * F.pow(F.lit(2.0), F.col("at_" + own))
        bin_of = lambda x: F.floor(x / width).cast("long")
        df = df.withColumn(first + side, bin_of(a)).withColumn(bin_, F.explode(F.sequence(bin_of(a), bin_of(b))))
        return df.withColumnRenamed(level, level + side)

    a, b = dealt("l", "r"), dealt("r", "l").select(*(F.col(f"`{c}`").alias(f"r_{own}_{c}") for c in found["r"][0].columns if c != level), F.col(level + "r"), F.col("at_" + own), F.col(first + "r"), F.col(bin_))
    equal = (a["at_" + own] == b["at_" + own]) & (a[bin_] == b[bin_])
    for c in on:
        equal = equal & (a[c] == b[f"r_{own}_{c}"])
    here = (F.greatest(level + "l", level + "r") == a["at_" + own]) & (F.greatest(first + "l", first + "r") == a[bin_])
    met = a.join(b, equal & here & ranges.overlaps(F.col(left_range), F.col(f"r_{own}_{right_range}")))
    return met.select(*(a[f"`{c}`"] for c in left.columns), *(F.col(f"`r_{own}_{c}`").alias(c) for c in right.columns if c not in on))


def overlap_totals(left: DataFrame, right: DataFrame, on: list[str], left_range: str, right_range: str, count: str, sums: dict[str, str] | None = None) -> DataFrame:
    """The rows of right that rows of left with equal `on` overlap, with their number as `count` and sums of whole-number columns of left by name, null where all are null.

    No pair is made. Of two ranges that are not empty, at most one ends before the other begins: what overlaps a range is all of left, less what ends before
    it and less what begins after it. Left's bounds are totalled by their values first, then run through in order; so are right's. Stretches of bounds,
    cut at about equal parts, are run through apart and begin with the totals of those before them, so no task has all bounds of a key; cuts decide nothing else.
    """
    own = uuid.uuid4().hex
    side, at, turn, asked, stretch, key = (f"{x}_{own}" for x in ("side", "at", "turn", "asked", "stretch", "key"))
    held = [f"n_{own}", *(f"{x}{k}_{own}" for k in range(len(sums or {})) for x in "ks")]
    ons = [f"on{k}_{own}" for k in range(len(on))]
    first = [F.count(F.lit(1)), *(f for c in (sums or {}).values() for f in (F.count(F.col(f"`{c}`")), F.sum(F.col(f"`{c}`").cast("decimal(38,0)"))))]
    rows = left.where(F.col(left_range).isNotNull() & ~F.col(f"{left_range}.empty"))
    for c in on:
        rows = rows.where(F.col(f"`{c}`").isNotNull())
    # equal ranges first, in one scan
    rows = rows.groupBy(*(F.col(f"`{c}`").alias(o) for c, o in zip(on, ons, strict=True)), F.col(left_range).alias(at)).agg(*(f.alias(c) for c, f in zip(held, first, strict=True))).withColumnRenamed(at, left_range)

    def totals(df: DataFrame, *by: Column) -> DataFrame:
        return df.groupBy(*ons, *by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in held))

    # a bound is passed before what stands at it where its turn is less: ends that are not in the range come first, then ends that are, then what begins there
    bound = lambda r, b, s, order: (F.lit(s).alias(side), F.col(f"{r}.{b}").alias(at), order.alias(turn))
    upper_in, lower_in = (lambda r: F.col(f"{r}.upper_inc")), (lambda r: F.col(f"{r}.lower_inc"))
    ends = totals(rows.where(F.col(f"{left_range}.upper").isNotNull()), *bound(left_range, "upper", "end", F.when(upper_in(left_range), 2).otherwise(0)))
    begins = totals(rows.where(F.col(f"{left_range}.lower").isNotNull()), *bound(left_range, "lower", "begin", F.when(lower_in(left_range), 1).otherwise(3)))
    real = right.where(F.col(right_range).isNotNull() & ~F.col(f"{right_range}.empty"))
    of_right = [F.col(f"`{c}`").alias(o) for c, o in zip(on, ons, strict=True)]
    # an end is before a range that begins at it unless both hold it, and a range begins after one that ends at it unless both hold it
    lows = real.where(F.col(f"{right_range}.lower").isNotNull()).select(*of_right, *bound(right_range, "lower", "end", F.when(lower_in(right_range), 1).otherwise(3))).distinct()
    highs = real.where(F.col(f"{right_range}.upper").isNotNull()).select(*of_right, *bound(right_range, "upper", "begin", F.when(upper_in(right_range), 2).otherwise(0))).distinct()
    nothing = [F.lit(None).cast(t).alias(c) for c, t in ((c, "bigint" if c[0] in "nk" else "decimal(38,0)") for c in held)]
    steps = ends.unionByName(begins).withColumn(asked, F.lit(False)).unionByName(lows.union(highs).select("*", *nothing, F.lit(True).alias(asked)))
    number = _number_of(steps.schema[at].dataType.typeName())
    cuts = steps.select(number(F.col(at)).cast("double").alias("x")).approxQuantile("x", [k / STRETCHES for k in range(1, STRETCHES)], 0.25 / STRETCHES)
    cuts = sorted(set(cuts))
    place = F.lit(0)
    if cuts:
        place = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, x: n + (x < F.col(key)).cast("int"))
    steps = steps.withColumn(key, number(F.col(at)).cast("double")).withColumn(stretch, place)
    before = steps.groupBy(*ons, side, stretch).agg(*(F.sum(c).alias(c) for c in held))
    passed = Window.partitionBy(*ons, side).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*ons, side, stretch, *(F.coalesce(F.sum(c).over(passed), F.lit(0)).alias(f"b{c}") for c in held))
    along = Window.partitionBy(*ons, side, stretch).orderBy(at, turn).rowsBetween(Window.unboundedPreceding, 0)
    run = steps.withColumns({c: F.coalesce(F.sum(c).over(along), F.lit(0)) for c in held}).where(F.col(asked))
    same = [run[c].eqNullSafe(before[c]) for c in (*ons, side, stretch)]
    joined = run.join(before, reduce(lambda a, b: a & b, same))
    reached = joined.select(*(run[c] for c in (*ons, side, at, turn)), *((F.col(c) + F.col(f"b{c}")).alias(c) for c in held))
    all_of = totals(rows)

    def looked_up(df: DataFrame, found: DataFrame, prefix: str, match: list[Column], how: str) -> DataFrame:
        found = found.select(*(F.col(c).alias(prefix + c) for c in found.columns))
        match = [F.col(f"`{c}`") == F.col(prefix + o) for c, o in zip(on, ons, strict=True)] + match
        df = df.join(found, reduce(lambda a, b: a & b, match), how) if match else df.crossJoin(found)
        return df.drop(*(prefix + c for c in (*ons, side, at, turn)))

    low_turn, high_turn = F.when(lower_in(right_range), 1).otherwise(3), F.when(upper_in(right_range), 2).otherwise(0)
    out = looked_up(real, all_of, "a", [], "inner")
    out = looked_up(out, reached.where(F.col(side) == "end"), "e", [F.col(f"{right_range}.lower") == F.col("e" + at), low_turn == F.col("e" + turn)], "left")
    # what begins after a range is all that has a beginning, less what has begun by its end
    begun = totals(rows.where(F.col(f"{left_range}.lower").isNotNull()))
    out = looked_up(out, reached.where(F.col(side) == "begin"), "h", [F.col(f"{right_range}.upper") == F.col("h" + at), high_turn == F.col("h" + turn)], "left")
    out = looked_up(out, begun, "g", [], "left") if on else out.crossJoin(begun.select(*(F.col(c).alias("g" + c) for c in begun.columns)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    after = lambda c: F.when(F.col(f"{right_range}.upper").isNotNull(), zero("g" + c) - zero("h" + c)).otherwise(0)
    totalled = {c: zero("a" + c) - zero("e" + c) - after(c) for c in held}
    out = out.withColumns({"t" + c: x for c, x in totalled.items()}).where(F.col(f"tn_{own}") > 0)
    found = [F.when(F.col(f"tk{k}_{own}") > 0, F.col(f"ts{k}_{own}")).cast("bigint").alias(name) for k, name in enumerate(sums or {})]
    return out.select(*(F.col(f"`{c}`") for c in right.columns), F.col(f"tn_{own}").cast("bigint").alias(count), *found)


#: Stretches of bounds that are run through apart.
STRETCHES = 64
#: Levels of widths between the whole span and the finest.
LEVELS = 40
