"""Window frames that Spark has no clause for: GROUPS, and EXCLUDE with any aggregate.

An aggregate is a partial state that can be merged. A frame with a hole is the state of the rows before the hole, that of those after it and, for
EXCLUDE TIES, that of the row itself; nothing is subtracted, so doubles, infinities, min, max and arrays are right. Where the hole's
edge is no fixed distance away, the frame's rows are gathered as an array, as many as the frame holds, and filtered.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

UNBOUNDED = Window.unboundedFollowing
FIRST = Window.unboundedPreceding
#: Rows of a task, about: it sorts them several times in a row of frames.
ROWS = 100_000
#: Distance that a stretch of a dealt partition covers at least.
STRETCH = 1000


@dataclass(frozen=True)
class Aggregate:
    """state: an aggregate of a column over a window, as a struct or value, null or neutral without rows; fold: the same of an array; merge: of two states; result: what a state stands for."""

    state: Callable[[Column, WindowSpec], Column]
    fold: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]
    result: Callable[[Column], Column] = lambda s: s


def _either(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.coalesce(f(a, b), a, b)


COUNT = Aggregate(lambda c, w: F.count(c).over(w), lambda a: F.size(F.array_compact(a)).cast("long"), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), lambda s: F.coalesce(s, F.lit(0).cast("long")))
MIN = Aggregate(lambda c, w: F.min(c).over(w), F.array_min, F.least)
MAX = Aggregate(lambda c, w: F.max(c).over(w), F.array_max, F.greatest)
#: Arrays keep nulls; null without rows. Elements stand in the order of the frame.
ARRAY_AGG = Aggregate(lambda c, w: F.transform(F.collect_list(F.struct(c.alias("v"))).over(w), lambda s: s["v"]), lambda a: a, _either(F.concat), lambda s: F.when(F.size(s) > 0, s))
BOOL_AND, BOOL_OR = MIN, MAX


def sum_of(kind: str) -> Aggregate:
    """Sum as a type of Spark: bigint, double or a decimal."""
    fold = lambda a: F.when(F.size(F.array_compact(a)) > 0, F.reduce(F.array_compact(a), F.lit(0).cast(kind), lambda x, y: (x + y).cast(kind)))
    return Aggregate(lambda c, w: F.sum(c).over(w).cast(kind), fold, _either(lambda a, b: (a + b).cast(kind)))


def avg_of(kind: str) -> Aggregate:
    """Mean from a sum of this type and a count."""
    total = sum_of(kind)
    pair = lambda s, n: F.struct(s.alias("s"), n.alias("n"))
    return Aggregate(
        lambda c, w: pair(total.state(c, w), COUNT.state(c, w)),
        lambda a: pair(total.fold(a), COUNT.fold(a)),
        lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(pair(total.merge(a["s"], b["s"]), COUNT.merge(a["n"], b["n"]))),
        lambda s: F.when(s["n"] > 0, s["s"].cast("double") / s["n"]),
    )


def tasks_for(df: DataFrame) -> int | None:
    """Tasks that have about ROWS rows of df each, or None where Spark's own number of them suffices. Counts df."""
    tasks = -(-df.count() // ROWS)
    return tasks if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def with_frame(
    df: DataFrame,
    name: str,
    aggregate: Aggregate,
    value: Column,
    partition: list[str],
    order: list[Column],
    kind: str = "groups",
    start: int = FIRST,
    end: int = 0,
    exclude: str = "no others",
    along: str | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Adds `name`: aggregate(value) OVER (PARTITION BY partition ORDER BY order kind BETWEEN start AND end EXCLUDE …).

    start and end count rows, peer groups or, for range, units of the one order column, negative ones before the current row; FIRST and UNBOUNDED are the partition's ends.
    exclude is `no others`, `current row`, `group` or `ties`. along: for a range of bounded distance, the order column's name, where it is of whole numbers in ascending order;
    a partition is then dealt out in stretches of it, each with copies of the rows that frames of its own reach, so that no partition is one task's. tasks: that partitions are dealt to, by tasks_for; Spark's number if not given. Without an order all rows are peers. Of rows that the order does not tell apart, the order in a ROWS frame is any.
    """
    tag = uuid.uuid4().hex
    g, r, v = f"g_{tag}", f"r_{tag}", f"v_{tag}"
    if along is not None:
        if kind != "range" or FIRST in (start, end) or UNBOUNDED in (start, end):
            raise ValueError("only a range of bounded distance can be dealt out along its order")
        stretch, copied = f"d_{tag}", f"c_{tag}"
        width, x = max(STRETCH, end - start), F.col(f"`{along}`").cast("decimal(38,0)")
        of = lambda x: F.floor(x / width).cast("bigint")
        # a row is in frames of rows from x - end to x - start, of two stretches at most beside its own; nulls are a stretch
        reach = F.array_distinct(F.array(of(x), of(x - end), of(x - start)))
        df = df.withColumn(stretch, F.explode(reach)).withColumn(copied, ~F.col(stretch).eqNullSafe(of(x)))
        return with_frame(df, name, aggregate, value, [*partition, stretch], order, kind, start, end, exclude, tasks=tasks).where(~F.col(copied)).drop(stretch, copied)
    if tasks and partition:
        df = df.repartition(tasks, *partition)
    by = Window.partitionBy(*partition)
    ordered = by.orderBy(*(order or [F.lit(1)]))
    df = df.withColumns({v: value}).withColumns({g: F.dense_rank().over(ordered), r: F.row_number().over(ordered)})
    if kind == "range" and start in (FIRST, 0) and end in (0, UNBOUNDED):
        kind = "groups"  # bounded by peers alone

    def window(kind: str, a: int, b: int):
        if kind == "rows":
            return by.orderBy(r).rowsBetween(a, b)
        return by.orderBy(g).rangeBetween(a, b) if kind == "groups" else by.orderBy(*order).rangeBetween(a, b)

    def part(kind: str, a: int, b: int) -> list[Column]:
        return [aggregate.state(F.col(v), window(kind, a, b))] if a <= b else []

    def gathered(a: int, b: int, keep: Callable[[Column], Column]) -> list[Column]:
        if a > b:
            return []
        rows = F.sort_array(F.collect_list(F.struct(F.col(r).alias("r"), F.col(g).alias("g"), F.struct(F.col(v).alias("v")).alias("v"))).over(window(kind, a, b)))
        rows = F.filter(rows, keep)
        return [F.when(F.size(rows) > 0, aggregate.fold(F.transform(rows, lambda s: s["v"]["v"])))]

    holds = start <= 0 <= end
    own = Window.partitionBy(*partition, g).orderBy(r)
    itself = [aggregate.state(F.col(v), own.rowsBetween(0, 0))] if holds else []
    before, after = (start, min(end, -1)), (max(start, 1), end)
    if exclude == "no others":
        states = part(kind, start, end)
    elif exclude == "current row" and kind == "rows":
        states = part(kind, *before) + part(kind, *after)
    elif kind == "groups":
        peers = [aggregate.state(F.col(v), own.rowsBetween(a, b)) for a, b in ((FIRST, -1), (1, UNBOUNDED))] if holds else []
        middle = peers if exclude == "current row" else itself if exclude == "ties" else []
        states = part(kind, *before) + middle + part(kind, *after)
    else:
        # rows of whole groups on a side without an end, else the frame's rows on that side without those left out
        left_out = (lambda s: s["r"] == F.col(r)) if exclude == "current row" else (lambda s: s["g"] == F.col(g))
        open_left, open_right = start == FIRST and end >= 0 and exclude != "current row", end == UNBOUNDED and start <= 0 and exclude != "current row"
        left = part("groups", FIRST, -1) if open_left else gathered(start, min(end, 0), lambda s: (s["r"] < F.col(r)) & ~left_out(s))
        right = part("groups", 1, UNBOUNDED) if open_right else gathered(max(start, 0), end, lambda s: (s["r"] > F.col(r)) & ~left_out(s))
        if kind == "range" and exclude == "current row" and holds:  # peers on either side are in the frame
            left, right = gathered(start, end, lambda s: (s["r"] < F.col(r))), gathered(start, end, lambda s: (s["r"] > F.col(r)))
        states = left + (itself if exclude == "ties" else []) + right
    named = {f"s{k}_{tag}": s for k, s in enumerate(states)}
    df = df.withColumns(named)
    merged = None
    for c in named:
        merged = F.col(c) if merged is None else aggregate.merge(merged, F.col(c))
    if merged is None:  # no row can be in such a frame
        merged = F.when(F.lit(False), aggregate.state(F.col(v), own.rowsBetween(0, 0)))
    return df.withColumn(name, aggregate.result(merged)).drop(g, r, v, *named)
