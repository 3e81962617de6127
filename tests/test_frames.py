"""Frames with GROUPS and EXCLUDE against DuckDB, for each aggregate, kind of frame and hole."""

import itertools

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import frames

ROWS = [(k, g, o, i, None if i % 4 == 0 else float(i * i % 11)) for i, (k, g, o) in enumerate(itertools.product(("a", None), (1, 1, 2, None, 4, 4, 4, 7), (0, 1)))]
BOUNDS = {frames.FIRST: "UNBOUNDED PRECEDING", frames.UNBOUNDED: "UNBOUNDED FOLLOWING", 0: "CURRENT ROW"}
AGGREGATES = {"sum": frames.sum_of("double"), "count": frames.COUNT, "min": frames.MIN, "max": frames.MAX, "avg": frames.avg_of("double")}


def bound(x):
    return BOUNDS.get(x) or f"{abs(x)} {'PRECEDING' if x < 0 else 'FOLLOWING'}"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k string, g int, o int, i int, v double").cache()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    frame = pd.DataFrame(ROWS, columns=["k", "g", "o", "i", "v"]).astype({"g": "Int32", "v": "Float64"})
    con.register("f", frame)
    con.sql("CREATE TABLE rows AS SELECT * FROM f")
    return con


@pytest.mark.parametrize("exclude", ["no others", "current row", "group", "ties"])
@pytest.mark.parametrize(
    ("kind", "start", "end"),
    [
        ("groups", -1, 1), ("groups", frames.FIRST, 0), ("groups", 1, 2), ("groups", 0, frames.UNBOUNDED), ("rows", -2, 2), ("rows", frames.FIRST, -1), ("rows", frames.FIRST, 1),
        ("rows", -1, frames.UNBOUNDED), ("rows", 0, 0), ("range", -2, 3), ("range", frames.FIRST, frames.UNBOUNDED), ("range", frames.FIRST, 0), ("range", 0, 2),
    ],
)
def test_frames(rows, duck, kind, start, end, exclude):
    order = [F.col("g").asc_nulls_last()] if kind != "rows" else [F.col("g").asc_nulls_last(), F.col("i").asc()]
    df = rows
    for name, aggregate in AGGREGATES.items():
        df = frames.with_frame(df, name, aggregate, F.col("v"), ["k"], order, kind, start, end, exclude)
    over = f"OVER (PARTITION BY k ORDER BY g NULLS LAST{', i' if kind == 'rows' else ''} {kind.upper()} BETWEEN {bound(start)} AND {bound(end)} EXCLUDE {exclude.upper()})"
    if kind == "rows" and exclude in ("group", "ties"):  # all rows are apart by this order
        assert exclude == "group" or df.count() == len(ROWS)
    want = duck.execute(f"SELECT i, {', '.join(f'{a}(v) {over}' for a in AGGREGATES)} FROM rows ORDER BY i").fetchall()
    got = [tuple(r) for r in df.select("i", *AGGREGATES).orderBy("i").collect()]
    assert [tuple(None if x is None else pytest.approx(x) for x in r) for r in want] == got


def test_nothing_is_subtracted(spark):
    df = spark.createDataFrame([(1, 1e16), (2, 1.0), (3, float("inf"))], "i int, v double")
    got = frames.with_frame(df, "s", frames.sum_of("double"), F.col("v"), [], [F.col("i")], "rows", frames.FIRST, frames.UNBOUNDED, "current row")
    assert {r["i"]: r["s"] for r in got.collect()} == {1: float("inf"), 2: float("inf"), 3: 1e16 + 1}
    got = frames.with_frame(df.where("i < 3"), "s", frames.sum_of("double"), F.col("v"), [], [F.col("i")], "rows", frames.FIRST, frames.UNBOUNDED, "current row")
    assert {r["i"]: r["s"] for r in got.collect()} == {1: 1.0, 2: 1e16}


def test_arrays_keep_nulls_and_columns_of_any_name(spark):
    df = spark.createDataFrame([("a", 1, 1, 5), ("a", 1, 2, None), ("a", 2, 3, 7)], "k string, _group int, s int, v int")
    got = frames.with_frame(df, "a", frames.ARRAY_AGG, F.col("v"), ["k"], [F.col("_group")], "groups", -1, 0, "current row")
    assert got.columns == ["k", "_group", "s", "v", "a"]
    found = {r["s"]: r["a"] for r in got.collect()}
    assert (found[1], found[2], sorted(found[3], key=str)) == ([None], [5], [5, None])
    got = frames.with_frame(df.limit(0), "a", frames.MIN, F.col("v"), ["k"], [F.col("_group")], "groups", -1, 0, "ties")
    assert got.collect() == []


def test_frames_that_no_row_is_in(rows):
    got = frames.with_frame(rows, "s", frames.COUNT, F.col("v"), ["k"], [F.col("g")], "groups", 0, 0, "group")
    assert {r["s"] for r in got.collect()} == {0}


@pytest.mark.parametrize(("start", "end"), [(-4, 4), (0, 3), (-7, -2), (2, 2500), (3, 1)])
@pytest.mark.parametrize("exclude", ["no others", "current row", "group", "ties"])
def test_a_partition_is_dealt_out_along_its_order(spark, start, end, exclude):
    df = spark.range(600).selectExpr("id % 2 AS k", "CASE WHEN id % 50 > 0 THEN id * 7919 % 4001 - 1500 - id % 3 END AS o", "id")
    frame = lambda along: frames.with_frame(df, "a", frames.avg_of("bigint"), F.col("id"), ["k"], [F.col("o")], "range", start, end, exclude, along=along)
    got = frame("o")
    assert got.columns == ["k", "o", "id", "a"]
    assert sorted(map(str, got.collect())) == sorted(map(str, frame(None).collect()))


def test_no_task_has_a_whole_partition(spark):
    df = spark.range(20_000).selectExpr("1 AS k", "id AS o")
    got = frames.with_frame(df, "a", frames.MAX, F.col("o"), ["k"], [F.col("o")], "range", -4, 4, "group", along="o")
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 15_000 and got.count() == 20_000
    assert frames.tasks_for(df) is None and frames.tasks_for(spark.range(1_000_000)) == 10
    got = frames.with_frame(df, "a", frames.MAX, F.col("o"), ["o"], [F.col("k")], tasks=30)
    assert got.groupBy(F.spark_partition_id()).count().count() == 30
    with pytest.raises(ValueError, match="bounded"):
        frames.with_frame(df, "a", frames.MAX, F.col("o"), ["k"], [F.col("o")], "range", frames.FIRST, 0, along="o")
