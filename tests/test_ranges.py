"""Ranges and multiranges against a plain model of them, and operators on tables of ranges against all pairs."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import ranges as R
from marlstone.operators import intervals

KIND = "struct<lower:{0},upper:{0},lower_inc:boolean,upper_inc:boolean,empty:boolean>"


def made(low, high, bounds="[)"):
    """A range of numbers as a row; [] and () are other ranges than [)."""
    if low is not None and high is not None and (low > high or low == high and bounds != "[]"):
        return (None, None, False, False, True)
    return (low, high, bounds[0] == "[" and low is not None, bounds[1] == "]" and high is not None, False)


EMPTY = (None, None, False, False, True)
#: Half steps stand for what is between whole numbers, so a range of numbers is the set of its points.
POINTS = [x / 2 for x in range(-3, 16)]


def points(r):
    low, high, low_inc, high_inc, empty = r
    return frozenset() if empty else frozenset(x for x in POINTS if (low is None or x > low or x == low and low_inc) and (high is None or x < high or x == high and high_inc))


SOME = sorted({made(a, b, s) for a in (None, 0, 2, 4) for b in (None, 0, 2, 4, 6) for s in ("[)", "[]", "(]", "()") if a is None or b is None or a <= b}, key=str)


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(itertools.product(SOME, SOME))], f"i int, a {KIND.format('int')}, b {KIND.format('int')}").repartition(4)


def test_operators_on_all_pairs(pairs):
    a, b = F.col("a"), F.col("b")
    got = pairs.select("a", "b", R.contains(a, b), R.overlaps(a, b), R.left_of(a, b), R.not_right_of(a, b), R.not_left_of(a, b), R.adjacent(a, b), R.intersection(a, b), R.pieces(a, b), R.merged(a, b)).collect()
    for x, y, holds, meets, before, not_right, not_left, adjacent, common, rest, hull in (tuple(r) for r in got):
        p, q, real = points(x), points(y), not x[4] and not y[4]
        assert holds == (p >= q) and meets == bool(p & q) and points(common) == p & q
        assert before == (real and max(p) < min(q))
        assert frozenset().union(*map(points, rest)) == p - q and all(not r[4] for r in rest)
        assert points(hull) == (frozenset(u for u in POINTS if min(p | q) <= u <= max(p | q)) if p | q else frozenset())
        assert adjacent == (real and not p & q and (max(p) + 0.5 == min(q) or max(q) + 0.5 == min(p)))
        assert not_right == (real and (y[1] is None or x[1] is not None and max(p) <= max(q))) and not_left == (real and (y[0] is None or x[0] is not None and min(p) >= min(q)))


def test_values_nulls_and_errors(spark):
    df = spark.createDataFrame([(made(1, 4), 1, None), (made(1, 4), 4, None), (made(None, 4), -9, None), (EMPTY, 1, None), (made(1, 4, "(]"), 4, None)], f"r {KIND.format('int')}, x int, n {KIND.format('int')}")
    assert [tuple(r) for r in df.select(R.contains_value(F.col("r"), F.col("x")), R.lower_inf(F.col("r")), R.upper_inf(F.col("r"))).collect()] == [(True, False, False), (False, False, False), (True, True, False), (False, False, False), (True, False, False)]
    r, n = F.col("r"), F.col("n")
    for f in (R.contains, R.overlaps, R.left_of, R.adjacent, R.intersection, R.union, R.difference, R.merged, R.not_right_of, R.not_left_of, R.pieces):
        assert {tuple(x) for x in df.select(f(r, n), f(n, r)).collect()} == {(None, None)}
    assert {x[0] for x in df.select(R.contains_value(n, F.col("x"))).collect()} == {None}
    for bad in (R.make_range(F.lit(3), F.lit(1)), R.make_range(F.lit(3), F.lit(1), "[]", True), R.union(R.make_range(F.lit(1), F.lit(2)), R.make_range(F.lit(3), F.lit(4))), R.difference(R.make_range(F.lit(1), F.lit(9)), R.make_range(F.lit(3), F.lit(4)))):
        with pytest.raises(Exception, match="range"):
            spark.range(1).select(bad).collect()


def test_made_ranges_and_their_text(spark):
    null = F.lit(None).cast("int")
    day = lambda d: F.lit(dt.date(2024, 2, d))
    cases = [
        (R.make_range(F.lit(1), F.lit(5), "[]", True), "[1,6)"), (R.make_range(F.lit(1), F.lit(5), "()", True), "[2,5)"), (R.make_range(F.lit(1), F.lit(2), "()", True), "empty"), (R.make_range(F.lit(1), F.lit(1), "()", True), "empty"),
        (R.make_range(null, F.lit(5), "[]", True), "(,6)"), (R.make_range(F.lit(1), null, "(]", True), "[2,)"), (R.make_range(null, null), "(,)"), (R.make_range(F.lit(1.5), F.lit(2.5), "(]"), "(1.5,2.5]"),
        (R.make_range(F.lit(3), F.lit(3)), "empty"), (R.make_range(F.lit(3.5), F.lit(3.5), "[]"), "[3.5,3.5]"), (R.make_range(day(27), day(29), "[]", True), "[2024-02-27,2024-03-01)"),
        (R.union(R.make_range(F.lit(1), F.lit(3)), R.make_range(F.lit(3), F.lit(4))), "[1,4)"), (R.difference(R.make_range(F.lit(1), F.lit(9)), R.make_range(F.lit(5), null)), "[1,5)"), (R.difference(R.make_range(F.lit(1), F.lit(2)), R.make_range(F.lit(0), null)), "empty"),
    ]
    assert spark.range(1).select(*(R.text(c).alias(f"c{i}") for i, (c, _) in enumerate(cases))).first() == tuple(t for _, t in cases)


def ranges_of(rng, n):
    return [EMPTY if rng.random() < 0.1 else rng.choice(SOME) for _ in range(n)]


def test_multiranges(spark):
    rng = random.Random(5)
    rows = [(i, ranges_of(rng, rng.randint(0, 5)), ranges_of(rng, rng.randint(0, 4)), rng.randint(0, 6)) for i in range(150)]
    df = spark.createDataFrame(rows, f"i int, a array<{KIND.format('int')}>, b array<{KIND.format('int')}>, x int").select("i", "x", R.multirange(F.col("a")).alias("m"), R.multirange(F.col("b")).alias("n"))
    m, n = F.col("m"), F.col("n")
    got = {r["i"]: r for r in df.select("*", R.multirange_union(m, n).alias("u"), R.multirange_intersection(m, n).alias("c"), R.multirange_difference(m, n).alias("d"), R.multirange_contains(m, n).alias("holds"), R.multirange_overlaps(m, n).alias("meets"), R.multirange_contains_value(m, F.col("x")).alias("has")).collect()}
    whole = lambda rs: frozenset().union(*map(points, rs))
    for i, a, b, x in rows:
        p, q, r = whole(a), whole(b), got[i]
        assert (whole(r["m"]), whole(r["u"]), whole(r["c"]), whole(r["d"])) == (p, p | q, p & q, p - q)
        assert (r["holds"], r["meets"], r["has"]) == (p >= q, bool(p & q), x in p)
        for part in (r["m"], r["u"], r["c"], r["d"]):
            ends = [(min(points(s)), max(points(s))) for s in part]
            assert all(u[1] + 0.5 < v[0] for u, v in itertools.pairwise(ends))  # in order, with a gap between any two
    assert spark.range(1).select(R.multirange_text(R.multirange(F.array(R.make_range(F.lit(5), F.lit(6)), R.make_range(F.lit(1), F.lit(2)), R.make_range(F.lit(2), F.lit(3)))))).first()[0] == "{[1,3),[5,6)}"


def test_range_agg_and_intersect_agg(spark):
    rng = random.Random(7)
    rows = [(k, r) for k in range(40) for r in ranges_of(rng, rng.randint(1, 12))] + [(100, None), (101, EMPTY), (101, None), (102, made(1, 2)), (102, None), (None, made(3, 4)), (None, made(4, 5))]
    rows += [(200, made(i, i + 2)) for i in range(0, 3000)] + [(200, made(9000, 9001))]
    df = spark.createDataFrame(rows, f"k int, r {KIND.format('int')}").selectExpr("k", "r", "1 AS island", "2 AS d")
    by = {}
    for k, r in rows:
        by.setdefault(k, []).append(r)
    got = {r["k"]: r["r"] for r in intervals.range_agg(df, ["k"], "r").collect()}
    assert got.keys() == by.keys() and got[100] is None and got[101] == []
    assert [tuple(r) for r in got[200]] == [made(0, 3001), made(9000, 9001)]
    for k in range(40):
        assert frozenset().union(*map(points, got[k])) == frozenset().union(*map(points, by[k]))
        assert all(max(points(u)) + 0.5 < min(points(v)) for u, v in itertools.pairwise(got[k]))
    common = {r["k"]: r["c"] for r in df.groupBy("k").agg(R.range_intersect_agg(F.col("r")).alias("c")).collect()}
    assert common[100] is None and common[101][4]
    assert all(points(common[k]) == frozenset(POINTS).intersection(*map(points, by[k])) for k in range(40))
    assert intervals.range_agg(df.limit(0), ["k"], "r").collect() == []


def random_ranges(rng, n, kind):
    out = []
    for i in range(n):
        low, length = rng.randint(-1000, 1000), rng.choice([0, 1, 3, 40, 900, 10_000])
        r = made(None if rng.random() < 0.05 else low, None if rng.random() < 0.05 else low + length, rng.choice(["[)", "[]", "(]", "()"]) if kind == "double" else "[)")
        turn = {"int": lambda x: x, "double": lambda x: x / 8, "date": lambda x: dt.date(2020, 1, 1) + dt.timedelta(days=x), "timestamp": lambda x: dt.datetime(2020, 1, 1) + dt.timedelta(microseconds=x)}[kind]
        out.append((i, rng.choice("ab") if rng.random() > 0.05 else None, None if rng.random() < 0.03 else tuple(turn(x) if x is not None else None for x in r[:2]) + r[2:]))
    return out


def overlap(a, b):
    if a is None or b is None or a[4] or b[4]:
        return False
    after = lambda x, y: x[0] is not None and y[1] is not None and (x[0] > y[1] or x[0] == y[1] and not (x[2] and y[3]))
    return not after(a, b) and not after(b, a)


@pytest.mark.parametrize("kind", ["int", "double", "date", "timestamp"])
def test_overlapping_against_all_pairs(spark, kind):
    rng = random.Random(kind)
    left, right = random_ranges(rng, 150, kind), random_ranges(rng, 120, kind)
    schema = f"i int, k string, r {KIND.format(kind)}"
    a, b = spark.createDataFrame(left, schema).withColumnRenamed("r", "s"), spark.createDataFrame(right, schema).withColumnsRenamed({"i": "j", "r": "level"})
    for on in (["k"], []):
        joined = intervals.overlapping(a, b, on, "s", "level")
        assert joined.columns == ["i", "k", "s", "j", *([] if on else ["k"]), "level"]
        got = sorted((r[0], r[3]) for r in joined.collect())
        assert got == sorted((i, j) for i, k, r in left for j, m, s in right if overlap(r, s) and (not on or k is not None and k == m))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_long_range_is_copied_a_few_times(spark):
    short = spark.createDataFrame([(i, made(i, i + 1)) for i in range(5000)], f"i int, r {KIND.format('int')}")
    long = spark.createDataFrame([(0, made(0, 5000)), (1, made(None, None))], f"j int, r {KIND.format('int')}")
    joined = intervals.overlapping(short, long, [], "r", "r")
    assert joined.count() == 10_000
    assert intervals.overlapping(short.limit(0), long, [], "r", "r").count() == 0 and intervals.overlapping(short.limit(0), long.limit(0), [], "r", "r").count() == 0
    same = spark.createDataFrame([(0, (3.0, 3.0, True, True, False))], f"i int, r {KIND.format('double')}")
    assert intervals.overlapping(same, same.withColumnRenamed("i", "j"), [], "r", "r").count() == 1


@pytest.mark.parametrize("kind", ["int", "double", "date", "timestamp"])
def test_overlap_totals_against_all_pairs(spark, kind):
    rng = random.Random(kind + "totals")
    left, right = random_ranges(rng, 300, kind), random_ranges(rng, 200, kind)
    schema = f"i int, k string, r {KIND.format(kind)}"
    a, b = spark.createDataFrame(left, schema).withColumn("v", F.when(F.col("i") % 3 > 0, F.col("i"))), spark.createDataFrame(right, schema).withColumnsRenamed({"i": "j", "r": "s"})
    for on in (["k"], []):
        got = intervals.overlap_totals(a, b, on, "r", "s", "n", {"total": "v"})
        assert got.columns == ["j", "k", "s", "n", "total"]
        want = {}
        for j, m, s in right:
            met = [i for i, k, r in left if overlap(r, s) and (not on or k is not None and k == m)]
            if met:
                values = [i for i in met if i % 3]
                want[j] = (len(met), sum(values) if values else None)
        assert {r["j"]: (r["n"], r["total"]) for r in got.collect()} == want
    assert intervals.overlap_totals(a.limit(0), b, [], "r", "s", "n").count() == intervals.overlap_totals(a, b.limit(0), [], "r", "s", "n").count() == 0


def test_totals_of_overlaps_make_no_pairs(spark):
    df = spark.range(20_000).select(F.col("id").cast("int").alias("i"), R.make_range(F.lit(0), F.lit(10), discrete=True).alias("r"))
    got = intervals.overlap_totals(df, df.withColumnsRenamed({"i": "j", "r": "s"}), [], "r", "s", "n", {"t": "i"})  # 400 million pairs
    assert tuple(got.agg(F.count("*"), F.min("n"), F.max("n"), F.max("t")).first()) == (20_000, 20_000, 20_000, 199_990_000)
