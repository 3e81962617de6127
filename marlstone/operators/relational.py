"""Relational operators that Spark has no clause for, as compositions of DataFrame operators."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by the order: SELECT DISTINCT ON."""
    n = f"_{uuid.uuid4().hex}"
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def top_of_each(left: DataFrame, right: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """Each row of left with its first n rows of right by the order, or once with nulls: LEFT JOIN LATERAL (… LIMIT n).

    Spark ranks within each task before the shuffle, so a hot key sends n rows a task.
    """
    k = f"_{uuid.uuid4().hex}"
    top = right.withColumn(k, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(k) <= n).drop(k)
    return left.join(top, keys, "left")


def latest_before(left: DataFrame, right: DataFrame, key: str, at: str, since: str, values: list[str], runs: int = 16) -> DataFrame:
    """As-of join: each row of left with the values of right's last row of the same key that is not later. A null key or time meets nothing.

    Both sides are one stream per key, cut into runs of time at quantiles of right's times. A run is one task's work, so a key with many rows is
    several tasks'; what a run's first rows carry on is the last value of the key's runs before, of which there is one row each. No range join.
    """
    own = uuid.uuid4().hex
    flag, time, carried, run = f"flag_{own}", f"time_{own}", f"carried_{own}", f"run_{own}"
    row = F.struct(*(F.col(f"`{v}`").alias(v) for v in values))
    known = right.where(F.col(key).isNotNull() & F.col(since).isNotNull())
    kinds = {left.schema[at].dataType.typeName(), right.schema[since].dataType.typeName()}

    def place(c: str) -> Column:
        """A number that does not fall as time goes on."""
        if "timestamp" in kinds:
            return F.unix_micros(F.col(c).cast("timestamp"))
        wall = F.col(c).cast("timestamp_ntz")
        return F.unix_date(wall.cast("date")) * 24 + F.hour(wall) if kinds & {"timestamp_ntz", "date"} else F.col(c)

    found = known.agg(F.percentile_approx(place(since), [k / runs for k in range(1, runs)], 100 * runs).alias("q")).first()["q"] or []
    bounds = F.array(*(F.lit(x) for x in sorted(set(found)))) if found else F.array().cast("array<bigint>")
    run_of = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(F.filter(bounds, lambda x: x <= place(c))))
    whole = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    meets = F.col(key).isNotNull() & F.col(at).isNotNull()
    kind = right.select(row.alias("r")).schema["r"].dataType
    a = left.select(F.when(meets, F.col(key)).alias("k"), F.when(meets, F.col(at)).alias(time), run_of(at).alias(run), F.lit(1).alias(flag), whole.alias("l"), F.lit(None).cast(kind).alias("r"))
    b = known.select(F.col(key).alias("k"), F.col(since).alias(time), run_of(since).alias(run), F.lit(0).alias(flag), F.lit(None).cast(left.select(whole.alias("l")).schema["l"].dataType).alias("l"), row.alias("r"))
    last_of_run = b.groupBy("k", run).agg(F.max(F.struct(F.col(time), F.col("r"))).alias("last"))
    before = Window.partitionBy("k").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    starts = a.where(F.col("k").isNotNull()).select("k", run).distinct().withColumn("last", F.lit(None).cast(last_of_run.schema["last"].dataType))
    carry = last_of_run.unionByName(starts).groupBy("k", run).agg(F.max("last").alias("last"))
    carry = carry.select("k", run, F.last("last", ignorenulls=True).over(before)["r"].alias(carried))
    w = Window.partitionBy("k", run).orderBy(time, flag, "r").rowsBetween(Window.unboundedPreceding, 0)
    stream = a.where(F.col("k").isNotNull()).unionByName(b).withColumn("r", F.last("r", ignorenulls=True).over(w)).where(F.col(flag) == 1)
    met = stream.join(carry, ["k", run], "left").select("l", F.coalesce("r", carried).alias("r"))
    return met.unionByName(a.where(F.col("k").isNull()).select("l", "r")).select("l.*", "r.*")


def reachable(seed: DataFrame, edges: DataFrame, start: str, end: str) -> DataFrame:
    """WITH RECURSIVE … UNION: all values of column `node` that the edges lead to from the seed's, each once. A null is a value like others, and leads nowhere.

    New nodes of each round are checkpointed in the shared folder, so plans do not grow with the rounds. Parts made of equally many rounds are
    written together, so there are few parts, and a node is written as often as the number of rounds can be halved.
    """
    new = seed.select("node").distinct().checkpoint()
    parts = [(new, 1)]
    while not new.isEmpty():
        step = new.join(edges, new["node"] == edges[start]).select(edges[end].alias("node")).distinct()
        for found, _ in parts:
            step = step.join(found.select(F.col("node").alias("old")), F.col("node").eqNullSafe(F.col("old")), "left_anti")
        new = step.checkpoint()
        parts.append((new, 1))
        while len(parts) > 1 and parts[-1][1] == parts[-2][1]:
            (b, n), (a, _) = parts.pop(), parts.pop()
            parts.append((a.unionByName(b).checkpoint(), 2 * n))
    return reduce(DataFrame.unionByName, [found for found, _ in parts])
