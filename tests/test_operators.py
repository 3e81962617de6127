"""Operators and functions on small cases with nulls, ties and empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.functions import pg
from marlstone.operators import frames, generation, relational, tables, writes
from marlstone.plans.queries import ORDERS


def one(spark, column, values="1 AS x"):
    return spark.sql(f"SELECT {values}").select(column.alias("out")).first()["out"]


def test_regexp_replace_takes_the_first_match_only(spark):
    x = F.lit("aXbX")
    assert one(spark, pg.regexp_replace(x, "X", "-")) == "a-bX"
    assert one(spark, pg.regexp_replace(x, "x", "-", "gi")) == "a-b-"
    assert one(spark, pg.regexp_replace(F.lit("abc"), "z", "-")) == "abc"


def test_regexp_replace_in_context_and_with_groups(spark):
    assert one(spark, pg.regexp_replace(F.lit("abab"), "a(?=b)", "X")) == "Xbab"
    assert one(spark, pg.regexp_replace(F.lit("bbb"), "a*", "X")) == "Xbbb"
    assert one(spark, pg.regexp_replace(F.lit("ab ab"), "(a)(b)", r"\2\1$\\\&")) == r"ba$\ab ab"
    assert one(spark, pg.regexp_replace(F.lit("ab ab"), "(a)(b)", r"\2\1", "g")) == "ba ba"
    assert one(spark, pg.regexp_replace(F.lit("xaabb"), r"(a)\1", "-")) == "x-bb"


def test_lcm_and_trunc_are_exact(spark):
    assert one(spark, pg.lcm(F.lit(2147483647), F.lit(4294967291))) == 2147483647 * 4294967291
    assert one(spark, pg.lcm(F.lit(0), F.lit(5))) == 0 and one(spark, pg.lcm(F.lit(-4), F.lit(6))) == 12
    assert [one(spark, pg.trunc(F.lit(x), 2)) for x in (0.29, -0.299, 1e20)] == [0.29, -0.29, 1e20]
    assert one(spark, pg.trunc(F.lit(-1.9))) == -1.0


def test_upsert_with_repeated_keys_and_clashing_names(spark):
    old = spark.createDataFrame([(1, "a", 1), (None, "n", 2)], "k long, _new string, new_k long")
    new = spark.createDataFrame([(1, "x", 3), (2, "z", 4), (2, "y", 5), (None, "m", 6), (None, "l", 7)], "k long, _new string, new_k long")
    got = sorted(map(tuple, writes.upserted(old, new, ["k"], None).collect()), key=str)
    assert got == sorted([(1, "a", 1), (None, "n", 2), (2, "y", 5), (None, "m", 6), (None, "l", 7)], key=str)
    got = sorted(map(tuple, writes.upserted(old, new.where("k = 1"), ["k"], ["_new"]).collect()), key=str)
    assert got == sorted([(1, "x", 1), (None, "n", 2)], key=str)


def test_similar_to_matches_whole_texts(spark):
    assert one(spark, pg.similar_to(F.lit("abc"), "a%"))
    assert one(spark, pg.similar_to(F.lit("abc"), "(a|x)_c"))
    assert not one(spark, pg.similar_to(F.lit("a.c"), "abc"))
    assert one(spark, pg.similar_to(F.lit("a.c"), "a.c"))


def test_strings_and_numbers(spark):
    assert one(spark, pg.substring(F.lit("abc"), 0, 2)) == "a"
    assert one(spark, pg.left(F.lit("abc"), -5)) == ""
    assert one(spark, pg.gcd(F.lit(0), F.lit(0))) == 0
    assert one(spark, pg.gcd(F.lit(-12), F.lit(18))) == 6
    assert one(spark, pg.lcm(F.lit(4), F.lit(6))) == 12
    assert one(spark, pg.trunc(F.lit(-2.79), 1)) == -2.7


def test_any_keeps_three_values(spark):
    array = F.array(F.lit(1), F.lit(None).cast("int"))
    assert one(spark, pg.any_equal(F.lit(1), array)) is True
    assert one(spark, pg.any_equal(F.lit(2), array)) is None
    assert one(spark, pg.all_greater(F.lit(2), F.array().cast("array<int>"))) is True


def test_array_text_round_trip(spark):
    values = ["a", "b c", 'q"u', "back\\slash", "NULL", None, "{x}"]
    df = spark.createDataFrame([(values,)], "a array<string>").select(pg.array_text(F.col("a")).alias("t"))
    row = df.select("t", pg.array_of(F.col("t")).alias("back")).first()
    assert row["t"] == '{a,"b c","q\\"u","back\\\\slash","NULL",NULL,"{x}"}'
    assert row["back"] == values


def test_distinct_on_empty_and_ties(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (None, 2)], "k int, v int")
    assert sorted(relational.distinct_on(df, ["k"], F.desc("v")).collect(), key=str) == sorted([(1, 5), (None, 2)], key=str)
    assert relational.distinct_on(df.limit(0), ["k"], F.desc("v")).collect() == []


def test_upsert_nothing_keeps_old_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert sorted(writes.upserted(old, new, ["k"], None).collect()) == [(1, "a"), (2, "b"), (3, "y")]
    assert sorted(writes.upserted(old, new, ["k"], ["v"]).collect()) == [(1, "a"), (2, "x"), (3, "y")]


def test_generated_rows_keep_their_rules(spark):
    spec = tables.TableSpec("orders", ORDERS.columns, ORDERS.key)
    rows = generation.generated(spark, spec, 500, seed=3)
    assert rows.count() == 500
    assert tables.violations(rows, spec).count() == 0
    assert tables.repeated_keys(rows, spec).count() == 0
    assert sorted(rows.collect(), key=str) == sorted(generation.generated(spark, spec, 500, seed=3).repartition(7).collect(), key=str)


def test_violations_name_each_rule(spark):
    rows = spark.createDataFrame([(1, "Z", 5.0, "123456789", 3), (2, None, None, None, 4)], "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string, o_custkey long")
    found = {(r["column"], r["rule"]) for r in tables.violations(rows, ORDERS).collect()}
    assert found == {("o_orderstatus", "enum"), ("o_totalprice", "min"), ("o_orderpriority", "max_length")}


def test_entry_module_without_llm(spark, monkeypatch):
    import importlib.util

    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("marlstone.llm", "corpus_pipeline")) else real(name, *a))
    names = __spark_entry__.queries()
    assert "pricing_summary" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names


def test_entry_module_where_the_llm_subpackage_cannot_be_imported(monkeypatch):
    import sys

    import __spark_entry__

    for name in ("marlstone.llm.queries", "corpus_pipeline"):
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "marlstone.llm.queries", None)
    names = __spark_entry__.queries()
    assert "pricing_summary" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_any_and_all_with_nulls(spark):
    df = spark.sql("SELECT * FROM VALUES (1, array(1, NULL)), (2, array(1, NULL)), (3, array()), (NULL, array(1)) AS t(x, a)")
    x, a = F.col("x"), F.col("a")
    got = df.select(pg.any_of(x, "=", a), pg.all_of(x, "<>", a), pg.any_of(x, ">=", a)).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (None, None, True), (False, True, False), (None, None, None)]


def test_containment_with_nulls(spark):
    df = spark.sql("SELECT * FROM VALUES (array(1, 2, NULL), array(2)), (array(1, NULL), array(NULL)), (array(1), array()) AS t(a, b)").select(F.col("a").cast("array<int>"), F.col("b").cast("array<int>"))
    assert [tuple(r) for r in df.select(pg.contains(F.col("a"), F.col("b")), pg.overlaps(F.col("a"), F.col("b"))).collect()] == [(True, True), (False, False), (True, False)]


def test_exclude_forms_with_ties_and_nulls(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1, 10), ('a', 1, NULL), ('a', 2, 5), ('b', 1, NULL) AS t(k, o, v)")
    for name, exclude in (("g", "group"), ("t", "ties")):
        df = frames.with_frame(df, name, frames.sum_of("bigint"), F.col("v"), ["k"], [F.col("o")], "range", frames.FIRST, 0, exclude)
    assert {tuple(r) for r in df.collect()} == {("a", 1, 10, None, 10), ("a", 1, None, None, None), ("a", 2, 5, 10, 15), ("b", 1, None, None, None)}


def test_update_returning_and_truncate(spark):
    target, source = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int"), spark.createDataFrame([(1, 3), (1, 3), (9, 1)], "k int, n int")
    got = writes.returning_update(target, source, ["k"], {"v": F.col("v") + F.col("n")})
    assert [r.asDict() for r in got.collect()] == [{"k": 1, "old_v": 5, "new_v": 8}]
    assert writes.truncated(target).count() == 0 and writes.truncated(target).schema == target.schema


@pytest.mark.parametrize("runs", [1, 2, 16])
@pytest.mark.parametrize("kind", ["long", "timestamp", "timestamp_ntz", "date", "double"])
def test_latest_before_meets_no_nulls(spark, kind, runs):
    def at(n):
        return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n) if kind.startswith("timestamp") else dt.date(2024, 1, 1) + dt.timedelta(days=n) if kind == "date" else float(n) if kind == "double" else n

    left = [(i, k, at(n)) for i, (k, n) in enumerate([("a", 5), ("a", None), (None, 5), ("b", 5), ("a", 0), ("c", 9), ("a", 30), ("a", 3)])]
    right = [(k, at(n), v) for k, n, v in [("a", 5, "x"), ("a", 3, None), (None, 1, "n"), ("a", None, "m"), ("c", 1, "z"), ("b", 6, "late"), *(("d", n, "d") for n in range(40))]]
    got = relational.latest_before(spark.createDataFrame(left, f"i int, k string, at {kind}"), spark.createDataFrame(right, f"k string, since {kind}, v string"), "k", "at", "since", ["v", "since"], runs)
    assert got.columns == ["i", "k", "at", "v", "since"]
    want = {}
    for i, k, t in left:
        met = [(s, v) for rk, s, v in right if k is not None and rk == k and t is not None and s is not None and s <= t]
        want[i] = max(met, key=lambda m: m[0]) if met else (None, None)
    assert {r["i"]: (r["since"], r["v"]) for r in got.collect()} == want


def test_latest_before_of_empty_tables(spark):
    left, right = spark.createDataFrame([(1, "a", 5)], "i int, k string, at long"), spark.createDataFrame([("a", 4, 1)], "k string, since long, v int")
    assert [tuple(r) for r in relational.latest_before(left, right.limit(0), "k", "at", "since", ["v"]).collect()] == [(1, "a", 5, None)]
    assert relational.latest_before(left.limit(0), right, "k", "at", "since", ["v"]).collect() == []


def test_reachable_over_many_rounds(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([(i, i + 1) for i in range(11)] + [(11, 3), (50, 51), (4, None)], "a long, b long")
    got = relational.reachable(spark.createDataFrame([(0,), (0,)], "node long"), edges, "a", "b")
    assert sorted((r["node"] for r in got.collect()), key=str) == sorted([*range(12), None], key=str)
    assert relational.reachable(spark.createDataFrame([], "node long"), edges, "a", "b").collect() == []


def test_containment_of_null_arrays(spark):
    null, one_of, none = F.lit(None).cast("array<int>"), F.array(F.lit(1)), F.array().cast("array<int>")
    assert [one(spark, f(a, b)) for f in (pg.contains, pg.overlaps) for a, b in ((null, one_of), (null, none), (one_of, null), (one_of, none))] == [None, None, None, True, None, None, None, False]


def test_update_from_a_source_with_the_same_names(spark):
    target = spark.createDataFrame([(1, 5, "t"), (2, 6, "t"), (None, 7, "t")], "k int, v int, old string")
    source = spark.createDataFrame([(1, 3, 2), (1, 3, 2), (None, 1, 1)], "k int, v int, n int")
    got = writes.updated(target, source, ["k"], {"v": F.col("old.v") + F.col("src.v") * F.col("n")})
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 11, "t"), (2, 6, "t"), (None, 7, "t")], key=str)
    got = writes.returning_update(target, source, ["k"], {"v": F.col("src.v")})
    assert [r.asDict() for r in got.collect()] == [{"k": 1, "old_v": 5, "new_v": 3}]


def test_upsert_where_and_returning(spark):
    old = spark.createDataFrame([(1, 5), (2, 50), (None, 9)], "k int, v int")
    new = spark.createDataFrame([(1, 6), (2, 60), (3, 70), (None, 8)], "k int, v int")
    where = F.col("o.v") < F.col("n.v") - 5
    assert sorted(map(tuple, writes.upserted(old, new, ["k"], ["v"], where).collect()), key=str) == sorted([(1, 5), (2, 60), (3, 70), (None, 9), (None, 8)], key=str)
    assert sorted(map(tuple, writes.returning_upsert(old, new, ["k"], ["v"], where).collect()), key=str) == sorted([(2, 60, False), (3, 70, True), (None, 8, True)], key=str)
    assert sorted(map(tuple, writes.returning_upsert(old, new, ["k"], None).collect()), key=str) == sorted([(3, 70, True), (None, 8, True)], key=str)
    assert [tuple(r) for r in writes.returning_insert(old, new.where("k = 3").drop("v"), {"v": F.lit(1)}).collect()] == [(3, 1)]


def test_json_agg_of_maps_and_of_nothing(spark):
    df = spark.sql("SELECT * FROM VALUES (2, map('a', 1)), (1, map('b', NULL)), (NULL, map('c', 3)) AS t(k, m)")
    assert df.agg(pg.json_agg(F.col("m"), F.col("k"))).first()[0] == '[{"b":null},{"a":1},{"c":3}]'
    assert df.agg(pg.json_agg(F.struct("k"), F.col("k"))).first()[0] == '[{"k":1},{"k":2},{"k":null}]'
    assert df.where("false").agg(pg.json_agg(F.col("m"), F.col("k"))).first()[0] is None


def test_array_text_forms(spark):
    cases = {r'{a\"b,null}': ['a"b', None], r'{"null",NuLL, x y ,"a,b",\,c}': ["null", None, "x y", "a,b", ",c"], "{}": [], '{""}': [""]}
    for text, want in cases.items():
        assert one(spark, pg.array_of(F.lit(text))) == want


def test_hypothetical_ranks_of_nothing_and_descending(spark):
    df = spark.sql("SELECT * FROM VALUES (1), (2), (2), (NULL) AS t(v)")
    at, v = F.lit(2), F.col("v")
    assert df.agg(pg.hypothetical_rank(at, v), pg.hypothetical_rank(at, v, descending=True), pg.hypothetical_rank(F.lit(None).cast("int"), v)).first() == (2, 2, 4)
    assert df.agg(pg.hypothetical_percent_rank(at, v), pg.hypothetical_cume_dist(at, v), pg.hypothetical_cume_dist(at, v, True)).first() == (0.25, 0.8, 0.8)
    assert df.where("false").agg(pg.hypothetical_percent_rank(at, v), pg.hypothetical_cume_dist(at, v), pg.hypothetical_rank(at, v)).first() == (0.0, 1.0, 1)


def test_gcd_of_the_least_long(spark):
    least = F.lit(-(1 << 63)).cast("long")
    assert one(spark, pg.gcd(least, F.lit(96))) == 32 and one(spark, pg.gcd(F.lit(7), least)) == 1
    assert one(spark, pg.gcd(F.lit((1 << 62) + 1), F.lit(1 << 61))) == 1
    with pytest.raises(Exception, match="(?i)overflow|out of range"):
        one(spark, pg.gcd(least, F.lit(0)))


def test_violations_keep_null_keys_and_orphans_of_nothing(spark):
    spec = tables.TableSpec("t", (tables.ColumnSpec("a", "int", nullable=False), tables.ColumnSpec("b", "int")), ("a", "b"))
    rows = spark.createDataFrame([(None, 1)], "a int, b int")
    assert [tuple(r) for r in tables.violations(rows, spec).collect()] == [('{"a":null,"b":1}', "a", "not_null", None)]
    assert tables.orphans(rows, spec, {}).collect() == []
