"""Components against union-find, in one task and in many."""

import random

import pytest

from marlstone.llm import components as c
from marlstone.llm.common import spread_join, stored


@pytest.mark.parametrize("edges_a_task", [1 << 20, 40])
def test_components(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr(c, "EDGES", edges_a_task)
    rng = random.Random(1)
    edges = [(f"{k:03}", f"{k + 1:03}") for k in range(0, 60)] + [(f"{rng.randrange(100, 200)}", f"{rng.randrange(100, 200)}") for _ in range(60)] + [("900", "900")]
    rng.shuffle(edges)
    roots = c.Roots()
    for a, b in edges:
        roots.merge(a, b)
    want = {x: roots.root(x) for a, b in edges for x in (a, b) if a != b}
    df = stored(spark.createDataFrame(edges, "a string, b string").repartition(4), "edges")
    got = c.components(df, stored).collect()
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
    assert c.components(df.limit(0), stored).collect() == []


def test_spread_join_is_a_left_join(spark):
    rows = [("hot", i) for i in range(200)] + [("k", 1), ("none", 2), (None, 3)]
    df = spark.createDataFrame(rows, "key string, doc_id int").selectExpr("*", "1 AS spread")
    few = spark.createDataFrame([("hot", "h"), ("k", "x"), ("other", "y")], "key string, v string")
    want = sorted(map(str, df.join(few, "key", "left").collect()))
    assert sorted(map(str, spread_join(df, few, "key", "doc_id").collect())) == want
    assert spread_join(df.limit(0), few, "key", "doc_id").collect() == [] and spread_join(df, few.limit(0), "key", "doc_id").count() == len(rows)
