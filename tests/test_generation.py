"""Generated rows: unique keys, references without orphans, patterns, checks, and the same rows in any partitioning."""

import re

import pytest
from pyspark.sql import functions as F

from marlstone.operators import generation as G
from marlstone.operators import tables as T
from marlstone.plans.queries import SALES, SHOPS


@pytest.mark.parametrize("n", [1, 2, 7, 10, 999, 1000])
@pytest.mark.parametrize("seed", [0, 5])
def test_permutations(spark, n, seed):
    got = [r[0] for r in spark.range(n).select(G.permuted(F.col("id"), n, seed)).collect()]
    assert sorted(got) == list(range(n)) and (n < 10 or got != sorted(got))
    big = 10**15
    some = [r[0] for r in spark.range(1000).select(G.permuted(F.col("id") * 10**11, big, seed)).collect()]
    assert len(set(some)) == 1000 and all(0 <= x < big for x in some)


@pytest.mark.parametrize("pattern", [r"[A-C]\d{2}", r"x{3}-[ab]?\w", r"\.\d[0-9a-f]{1,3}", "plain", r"\\[xy]"])
def test_patterns(spark, pattern):
    n = G.capacity(pattern)
    got = [r[0] for r in spark.range(min(n, 500)).select(G.spelled(F.col("id"), pattern)).collect()]
    assert len(set(got)) == min(n, 500)
    free = [r[0] for r in spark.range(500).select(G.spelled(F.pmod(F.xxhash64("id"), F.lit(n)), pattern, F.xxhash64("id"))).collect()]
    assert all(re.fullmatch(pattern, t) for t in [*got, *free])
    assert pattern not in (r"x{3}-[ab]?\w", r"\.\d[0-9a-f]{1,3}") or len({len(t) for t in free}) > 1
    for bad in ("[", "a{", "}"):
        with pytest.raises(ValueError, match="bad pattern"):
            G.atoms(bad)


def test_children_find_their_parents(spark):
    shops = G.generated(spark, SHOPS, 300, seed=3)
    sales = G.generated(spark, SALES, 4000, seed=4, parents={"shops": (SHOPS, 300, 3)})
    assert T.repeated_keys(shops, SHOPS).count() == T.repeated_keys(sales, SALES).count() == T.orphans(sales, SALES, {"shops": shops}).count() == 0
    assert T.violations(shops, SHOPS).count() == T.violations(sales, SALES).count() == 0
    row = sales.agg(F.count("*"), F.count_distinct("ticket"), F.count_distinct("shop"), F.count_if(F.expr("shop IS NULL"))).first()
    assert row[:2] == (4000, 4000) and row[2] > 250 and 100 < row[3] < 320
    assert "Join" not in sales._jdf.queryExecution().executedPlan().toString()
    free = G.generated(spark, T.TableSpec("sales", SALES.columns, SALES.key, SALES.references, unique=SALES.unique), 4000, seed=4, parents={"shops": (SHOPS, 300, 3)})
    assert "Exchange" not in free._jdf.queryExecution().executedPlan().toString()
    again = G.generated(spark, SALES, 4000, seed=4, parents={"shops": (SHOPS, 300, 3)}).repartition(7)
    assert sorted(map(str, again.collect())) == sorted(map(str, sales.collect()))
    other = G.generated(spark, SALES, 4000, seed=5, parents={"shops": (SHOPS, 300, 3)})
    assert other.join(sales, sales.columns).count() < 40


KINDS = ["int", "bigint", "smallint", "string", "double", "float", "decimal(10,2)", "date", "timestamp", "timestamp_ntz"]


@pytest.mark.parametrize("kind", KINDS)
def test_unique_values_of_each_type(spark, kind):
    spec = T.TableSpec("t", (T.ColumnSpec("k", kind, nullable=False), T.ColumnSpec("u", kind)), ("k",), unique=("u",))
    row = G.generated(spark, spec, 1000, 1).agg(F.count("*"), F.count_distinct("k"), F.count_distinct("u")).first()
    assert row == (1000, 1000, 1000)


def test_values_keep_to_their_bounds(spark):
    spec = T.TableSpec("t", (T.ColumnSpec("id", "int", low=-3, high=3), T.ColumnSpec("b", "timestamp", low="2020-01-01T00:00:05", high="2020-01-01T00:00:07"), T.ColumnSpec("c", "boolean"), T.ColumnSpec("d", "binary"), T.ColumnSpec("e", "string", max_length=2), T.ColumnSpec("f", "double", low=2.5, high=2.6)))
    rows = G.generated(spark, spec, 2000, 9)
    assert T.violations(rows, spec).count() == 0
    got = rows.agg(F.count_distinct("id"), F.count_distinct("b"), F.count_distinct("c"), F.min("id"), F.max("id"), F.count_if(F.expr("c IS NULL"))).first()
    assert got[:5] == (7, 3, 2, -3, 3) and 50 < got[5] < 200


def test_room_and_checks_that_cannot_be_kept(spark):
    few = T.TableSpec("t", (T.ColumnSpec("k", "string", pattern=r"\d"),), ("k",))
    assert G.generated(spark, few, 10, 1).distinct().count() == 10 and G.generated(spark, few, 0, 1).count() == 0
    for spec in (few, T.TableSpec("t", (T.ColumnSpec("k", "int", low=1, high=10),), ("k",)), T.TableSpec("t", (T.ColumnSpec("k", "string", allowed=("a", "b")),), ("k",)), T.TableSpec("t", (T.ColumnSpec("k", "string", max_length=1),), ("k",))):
        with pytest.raises(ValueError, match="room"):
            G.generated(spark, spec, 11, 1)
    never = T.TableSpec("t", (T.ColumnSpec("a", "int", low=0, high=5, nullable=False),), checks={"no": "a > 9"})
    with pytest.raises(Exception, match="no row keeps the checks"):
        G.generated(spark, never, 3, 1).collect()
    child = T.TableSpec("c", (T.ColumnSpec("p", "string", nullable=False),), references=(("p", "t", "k"),))
    with pytest.raises(ValueError, match="no rows"):
        G.generated(spark, child, 3, 1, {"t": (few, 0, 1)})


def test_turns_are_numbers_and_rows_are_as_before(spark):
    sales = G.generated(spark, SALES, 100_000, seed=4, parents={"shops": (SHOPS, 20_000, 3)})
    plan = sales._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Exchange" not in plan and "decimal(38" not in plan
    total = sales.agg(F.sum(F.xxhash64(*sales.columns).cast("decimal(38,0)"))).first()[0]
    assert int(total) == -632769606703164786197  # as each attempt's whole rows gave it
    long = T.TableSpec("t", (T.ColumnSpec("id", "int"), T.ColumnSpec("p", "string", pattern=r"[a-z]{14}")), ("id",))
    assert G.generated(spark, long, 50, 1).agg(F.count_if(F.col("p").rlike("^[a-z]{14}$"))).first()[0] > 30
