"""User-defined aggregates and table functions on skew, nulls and empty tables."""

from collections import defaultdict

import pytest

from marlstone.operators import aggregates as A


@pytest.mark.parametrize("held", [2, 1 << 16])
def test_states_of_a_hot_key_and_of_many(spark, monkeypatch, held):
    monkeypatch.setattr(A, "HELD_KEYS", held)
    rows = [("hot" if i % 3 else f"k{i % 50}", i * 7919 % 1000, None if i % 10 == 0 else float(i % 13)) for i in range(2000)] + [(None, 5, 1.0), (None, 6, None)]
    df = spark.createDataFrame(rows, "state string, k int, v double").repartition(7)
    got = {r["state"]: r for r in A.aggregated(df, ["state"], top=(A.top_k(3, "struct<a:int,b:double>"), ["k", "v"]), mean=(A.weighted_mean(), ["v", "k"])).collect()}
    by = defaultdict(list)
    for s, k, v in rows:
        if v is not None:
            by[s].append((k, v))
    assert got.keys() == {r[0] for r in rows}
    for s, some in by.items():
        assert [tuple(x) for x in got[s]["top"]] == sorted(some, reverse=True)[:3]
        weight = sum(k for k, _ in some)
        assert got[s]["mean"] == (pytest.approx(sum(k * v for k, v in some) / weight, rel=1e-15) if weight else None)


def test_a_hot_key_sends_one_state_a_task(spark):
    """Partial states are folded before they are dealt."""
    df = spark.range(0, 10_000, 1, 4).selectExpr("'x' AS k", "CAST(id AS STRING) AS t")
    out = A.aggregated(df, ["k"], p=(A.common_prefix(), ["t"]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Exchange") == 1 and plan.index("MapInArrow") < plan.index("Exchange") < plan.rindex("MapInArrow")
    assert out.collect() == [("x", "")]


def test_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([("abc",), ("abd",), (None,)], "t string")
    prefix = (A.common_prefix(), ["t"])
    assert A.aggregated(df, [], p=prefix).collect() == [("ab",)]
    assert A.aggregated(df.limit(0), [], p=prefix, top=(A.top_k(1, "struct<t:string>"), ["t"])).collect() == [(None, [])]
    assert A.aggregated(df.limit(0), ["t"], p=prefix).collect() == []
    assert sorted(A.aggregated(df, ["t"], p=prefix).collect(), key=str) == sorted([("abc", "abc"), ("abd", "abd"), (None, None)], key=str)


def test_nulls_reach_aggregates_that_are_not_strict(spark):
    count = A.Aggregate("struct<n:bigint,nulls:bigint>", lambda: (0, 0), lambda s, rows: (s[0] + len(rows), s[1] + sum(r[0] is None for r in rows)), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: {"n": s[0], "nulls": s[1]}, strict=False)
    df = spark.createDataFrame([(1, "a"), (1, None), (2, None)], "k int, t string")
    assert {r["k"]: tuple(r["c"]) for r in A.aggregated(df, ["k"], c=(count, ["t"])).collect()} == {1: (2, 1), 2: (1, 1)}


def test_lateral(spark):
    def parts(text, n):
        for i in range(0, len(text), n):
            yield text[i : i + n], i

    df = spark.createDataFrame([("abcde", 2), ("", 2), (None, 2)], "t string, n int")
    rows = A.lateral(df, "part string, at int", parts, ["t", "n"], ordinality="pos")
    assert rows.columns == ["t", "n", "part", "at", "pos"]
    assert [tuple(r)[2:] for r in rows.collect()] == [("ab", 0, 1), ("cd", 2, 2), ("e", 4, 3)]
    assert sorted(map(tuple, A.lateral(df, "part string, at int", parts, ["t", "n"], outer=True).where("part IS NULL").collect()), key=str) == sorted([("", 2, None, None), (None, 2, None, None)], key=str)
    assert A.lateral(df.limit(0), "part string, at int", parts, ["t", "n"]).collect() == []
    A.table_function(spark, "parts", "part string, at int", parts)
    assert [tuple(r) for r in spark.sql("SELECT part FROM parts('xyz', 2)").collect()] == [("xy",), ("z",)]
    assert spark.sql("SELECT part FROM parts(CAST(NULL AS STRING), 2)").collect() == []
