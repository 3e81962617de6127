"""The library's registered queries, each with the DuckDB SQL that it must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import jsonb, numerals, pg, ranges, spans
from marlstone.operators import aggregates, frames, generation, intervals, relational, tables, writes
from marlstone.sources.tables import catalogue, checkpoint_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def both(name: str, text: str, other: str | None = None) -> None:
    """A query that Spark SQL expresses: tables stand as {name}. `other` is DuckDB's text where it must differ."""
    used = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    QUERIES[name] = run
    SQL[name] = re.sub(r"\{(\w+)\}", r"\1", other or text)


def query(sql: str) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[run.__name__] = run
        SQL[run.__name__] = sql
        return run

    return register


# Scans, projection, predicates

both(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
both(
    "report_monthly",
    """SELECT n_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n_orders,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey JOIN {orders} ON o_custkey = c_custkey GROUP BY 1, 2""",
)
both(
    "predicates",
    """SELECT o_orderkey, o_totalprice BETWEEN 1000 AND 200000 AS mid, o_orderstatus IN ('F', 'O') AS known, o_orderpriority LIKE '1-%' AS urgent,
    o_orderpriority ILIKE '%high' AS high, nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O' AS differs, (nullif(o_orderstatus, 'F') = 'O') IS TRUE AS sure,
    NOT (o_orderstatus = 'P' OR o_totalprice < 5000) AS neither, o_custkey % 3 <> 1 AS other FROM {orders} WHERE o_orderdate IS NOT NULL""",
)
both(
    "case_and_coalesce",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band,
    CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 END AS code, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment,
    greatest(c_acctbal, 0.0) AS owed, least(c_nationkey, 10) AS least_key, CAST(c_custkey AS STRING) AS key_text FROM {customer}""",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band,
    CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 END AS code, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment,
    greatest(c_acctbal, 0.0::DOUBLE) AS owed, least(c_nationkey, 10) AS least_key, CAST(c_custkey AS VARCHAR) AS key_text FROM customer""",
)
both("values_list", "SELECT v.a, v.b, r_name FROM (VALUES (0, 'x'), (1, NULL), (9, 'z')) AS v(a, b) LEFT JOIN {region} ON r_regionkey = v.a")
both("row_comparison", "SELECT n_nationkey, n_name FROM {nation} WHERE (n_regionkey, n_nationkey) IN (SELECT r_regionkey, r_regionkey * 5 FROM {region}) OR n_nationkey = 7")
both("distinct_pairs", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
both(
    "like_forms",
    r"""SELECT p_partkey, p_name NOT LIKE '%a%' AS no_a, p_name LIKE '%#_%' ESCAPE '#' AS score, p_name NOT ILIKE 'A%' AS no_first, p_name LIKE ANY ('%a', '%e') AS any_end,
    p_name LIKE ALL ('%a%', '%e%') AS all_in, p_name RLIKE '^[a-m]' AS early, NOT (p_name RLIKE '(?i)S$') AS no_s FROM {part}""",
    r"""SELECT p_partkey, p_name NOT LIKE '%a%' AS no_a, p_name LIKE '%#_%' ESCAPE '#' AS score, p_name NOT ILIKE 'A%' AS no_first, p_name LIKE '%a' OR p_name LIKE '%e' AS any_end,
    p_name LIKE '%a%' AND p_name LIKE '%e%' AS all_in, regexp_matches(p_name, '^[a-m]') AS early, NOT regexp_matches(p_name, '(?i)S$') AS no_s FROM part""",
)


def named_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice BETWEEN :low AND :high"
    return spark.sql(text, args={"status": "F", "low": 50000.0, "high": 90000.0}, orders=table(spark, sf_dir, "orders"))


QUERIES["named_parameters"] = named_parameters
SQL["named_parameters"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 50000 AND 90000"


@query(
    """SELECT p_partkey, p_size IN (1, NULL, 9) AS any_equal, p_size NOT IN (1, NULL) AS all_differ, p_size < 3 OR p_size < 7 AS any_less, p_size <= 3 AND p_size <= 7 AS all_at_most,
    list_has_all([1, 5, 9, 12], [p_size]) AS inside, list_has_any([p_size, 4], [3, 4, 5]) AS meets FROM part"""
)
def array_operators(spark, sf_dir):
    s, nulls = F.col("p_size"), F.array(F.lit(1), F.lit(None).cast("int"), F.lit(9))
    pair, own = F.array(F.lit(3), F.lit(7)), F.array("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", pg.any_of(s, "=", nulls).alias("any_equal"), pg.all_of(s, "<>", F.slice(nulls, 1, 2)).alias("all_differ"), pg.any_of(s, "<", pair).alias("any_less"), pg.all_of(s, "<=", pair).alias("all_at_most"),
        pg.contains(F.array(*map(F.lit, (1, 5, 9, 12))), own).alias("inside"), pg.overlaps(F.array(s, F.lit(4)), F.array(*map(F.lit, (3, 4, 5)))).alias("meets"),
    )


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.distinct_on(df, ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT p_partkey, p_size IN (1, 5, 9) AS any_size, p_size > 3 AND p_size > 7 AS above_all, p_name LIKE '%a' OR p_name LIKE '%e' AS ends FROM part")
def array_comparisons(spark, sf_dir):
    sizes, floor = F.array(F.lit(1), F.lit(5), F.lit(9)), F.array(F.lit(3), F.lit(7))
    ends = pg.similar_to(F.col("p_name"), "%(a|e)")
    return table(spark, sf_dir, "part").select("p_partkey", pg.any_equal(F.col("p_size"), sizes).alias("any_size"), pg.all_greater(F.col("p_size"), floor).alias("above_all"), ends.alias("ends"))


# Joins

both("join_group", "SELECT c_custkey, n_name, r_name FROM {customer} LEFT JOIN ({nation} JOIN {region} ON n_regionkey = r_regionkey AND r_name <> 'ASIA') ON c_nationkey = n_nationkey")
both(
    "full_join_using",
    """SELECT k, a.n_c, b.n_s FROM (SELECT c_nationkey AS k, count(*) AS n_c FROM {customer} WHERE c_acctbal > 9000 GROUP BY c_nationkey) a
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_s FROM {supplier} WHERE s_acctbal > 5000 GROUP BY s_nationkey) b USING (k)""",
)
both("cross_join", "SELECT r_name, s_suppkey FROM {region} CROSS JOIN {supplier} WHERE s_acctbal > 5000")
both(
    "ordered_mixed_joins",
    """SELECT r_name, n_name, c_custkey, s_suppkey FROM {region} LEFT JOIN {nation} ON n_regionkey = r_regionkey AND n_nationkey > 4 JOIN {customer} ON c_nationkey = n_nationkey AND c_acctbal > 8000
    LEFT JOIN {supplier} ON s_nationkey = n_nationkey AND s_acctbal > 9000""",
)
both("left_join_counts", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
both("right_join", "SELECT r_name, n_name FROM {nation} RIGHT JOIN {region} ON n_regionkey = r_regionkey AND n_nationkey < 3")
both("self_join", "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("theta_join", "SELECT r_name, n_nationkey FROM {region} JOIN {nation} ON n_nationkey BETWEEN r_regionkey * 3 AND r_regionkey * 3 + 4")
both("semi_join_exists", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
both("anti_join_not_exists", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
both("not_in_with_null", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT nullif(c_nationkey, -1) FROM {customer} WHERE c_acctbal > 9990)")
both("scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS top_price, c_acctbal > (SELECT avg(c_acctbal) FROM {customer}) AS rich FROM {customer}")


@query(
    """SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN
    (SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3) ON o_custkey = c_custkey"""
)
def lateral_top3(spark, sf_dir):
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return relational.top_of_each(table(spark, sf_dir, "customer").select("c_custkey"), right, ["c_custkey"], 3, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query(
    """SELECT e.event_id, p.event_id AS purchase_id, p.value AS purchase_value FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT DISTINCT ON (user_id, ts) * FROM events WHERE event_type = 'purchase' ORDER BY user_id, ts, event_id DESC) p ON e.user_id = p.user_id AND e.ts >= p.ts"""
)
def latest_before(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bought = relational.distinct_on(events.where("event_type = 'purchase'"), ["user_id", "ts"], F.desc("event_id"))
    right = bought.select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    left = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return relational.latest_before(left, right, "user_id", "ts", "since", ["purchase_id", "purchase_value"]).select("event_id", "purchase_id", "purchase_value")


@query(
    """WITH l AS (SELECT event_id, CASE WHEN user_id % 7 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 5 > 0 THEN ts END AS ts FROM events WHERE event_type = 'error'),
    r AS (SELECT DISTINCT ON (user_id, ts) CASE WHEN user_id % 7 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 3 > 0 THEN ts END AS ts, event_id, CASE WHEN event_id % 2 > 0 THEN value END AS value
      FROM events WHERE event_type = 'purchase' ORDER BY user_id, ts, event_id DESC)
    SELECT l.event_id, l.user_id, r.event_id AS purchase_id, r.value AS purchase_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts"""
)
def latest_before_nulls(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    user = F.when(F.col("user_id") % 7 > 0, F.col("user_id")).alias("user_id")
    bought = relational.distinct_on(events.where("event_type = 'purchase'").select(user, F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("since"), "event_id", "value"), ["user_id", "since"], F.desc("event_id"))
    right = bought.select("user_id", "since", F.col("event_id").alias("purchase_id"), F.when(F.col("event_id") % 2 > 0, F.col("value")).alias("purchase_value"))
    left = events.where("event_type = 'error'").select("event_id", user, F.when(F.col("event_id") % 5 > 0, F.col("ts")).alias("ts"))
    return relational.latest_before(left, right, "user_id", "ts", "since", ["purchase_id", "purchase_value"]).drop("ts")


# Aggregation

both("having_filter", "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(DISTINCT o_orderpriority) AS kinds FROM {orders} GROUP BY o_custkey HAVING count(*) > 8")
both(
    "grouping_sets",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS g FROM {orders}
    GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""",
)
both("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
both("rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
both(
    "ordered_sets",
    """SELECT o_orderpriority, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS median, percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS p90,
    mode(o_orderstatus) AS usual FROM (SELECT * FROM {orders} WHERE o_orderstatus <> 'P') GROUP BY o_orderpriority""",
    """SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS median, quantile_disc(o_totalprice, 0.9) AS p90,
    CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > count(*) FILTER (WHERE o_orderstatus = 'O') THEN 'F' ELSE 'O' END AS usual
    FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority""",
)
both(
    "statistics",
    """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r,
    round(covar_samp(l_quantity, l_tax), 6) AS cv, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
    bool_and(l_tax >= 0) AS every_tax, bool_or(l_discount > 0.09) AS some_disc, CAST(bit_xor(l_partkey) AS BIGINT) AS x, CAST(bit_or(l_linenumber) AS BIGINT) AS o
    FROM {lineitem} GROUP BY l_returnflag""",
)
both(
    "global_aggregate",
    "SELECT count(*) AS n, count(o_custkey) AS n_keys, min(o_orderdate) AS first_day, max(o_totalprice) AS top, count(*) FILTER (WHERE o_orderstatus = 'none') AS n_none, sum(o_custkey) FILTER (WHERE o_orderstatus = 'none') AS no_sum FROM {orders}",
)
both(
    "more_statistics",
    """SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(covar_pop(l_quantity, l_tax), 6) AS cp, CAST(bit_and(l_linenumber) AS BIGINT) AS a,
    every(l_quantity > 0) AS all_positive, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS rc, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay,
    round(regr_intercept(l_tax, l_quantity), 9) AS ri, round(regr_sxx(l_tax, l_quantity) / count(*), 6) AS sxx, round(regr_sxy(l_tax, l_quantity) / count(*), 6) AS sxy,
    round(regr_syy(l_tax, l_quantity) / count(*), 9) AS syy, any_value(l_returnflag) AS flag FROM {lineitem} GROUP BY l_returnflag""",
    """SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(covar_pop(l_quantity, l_tax), 6) AS cp, CAST(bit_and(l_linenumber) AS BIGINT) AS a,
    bool_and(l_quantity > 0) AS all_positive, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS rc, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay,
    round(regr_intercept(l_tax, l_quantity), 9) AS ri, round(regr_sxx(l_tax, l_quantity) / count(*), 6) AS sxx, round(regr_sxy(l_tax, l_quantity) / count(*), 6) AS sxy,
    round(regr_syy(l_tax, l_quantity) / count(*), 9) AS syy, any_value(l_returnflag) AS flag FROM lineitem GROUP BY l_returnflag""",
)


@query(
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice < 100000) + 1 AS place, (count(*) FILTER (WHERE o_totalprice < 100000))::DOUBLE / count(*) AS percent,
    (count(*) FILTER (WHERE o_totalprice <= 100000) + 1)::DOUBLE / (count(*) + 1) AS spread FROM orders GROUP BY o_orderpriority"""
)
def hypothetical_ranks(spark, sf_dir):
    p, at = F.col("o_totalprice"), F.lit(100000.0)
    found = [pg.hypothetical_rank(at, p).alias("place"), pg.hypothetical_percent_rank(at, p).alias("percent"), pg.hypothetical_cume_dist(at, p).alias("spread")]
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*found)


@query(
    """SELECT n_regionkey, '[' || string_agg('{"k":' || n_nationkey || ',"n":' || to_json(n_name)::VARCHAR || '}', ',' ORDER BY n_nationkey) || ']' AS items,
    '{' || string_agg(to_json(n_name)::VARCHAR || ':' || n_nationkey, ',' ORDER BY n_name) || '}' AS by_name FROM nation GROUP BY n_regionkey"""
)
def json_aggregates(spark, sf_dir):
    item = F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(pg.json_agg(item, F.col("n_nationkey")).alias("items"), pg.json_object_agg(F.col("n_name"), F.col("n_nationkey")).alias("by_name"))


both(
    "ordered_string_agg",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
)


@query("SELECT o_custkey, array_to_string(array_agg(o_orderkey ORDER BY o_orderdate, o_orderkey), ',') AS keys FROM orders GROUP BY o_custkey")
def ordered_array_agg(spark, sf_dir):
    keys = pg.ordered_array_agg(F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(keys.cast("array<string>"), ",").alias("keys"))


# What users define


@query(
    """SELECT o_custkey, array_to_string(list_transform((array_agg((o_totalprice, o_orderkey) ORDER BY o_totalprice DESC, o_orderkey DESC) FILTER (WHERE o_totalprice IS NOT NULL))[1:3], lambda x: x[2]), ',') AS top,
    sum((o_totalprice * 100)::DECIMAL(18,0) * (o_orderkey % 3)) / nullif(sum(o_orderkey % 3), 0) / 100 AS mean FROM orders GROUP BY o_custkey""".replace("list_transform((array_agg((o_totalprice, o_orderkey)", "list_transform((array_agg(o_orderkey")
    .replace("[1:3], lambda x: x[2])", "[1:3], lambda x: x)")
    .replace("sum((o_totalprice * 100)::DECIMAL(18,0) * (o_orderkey % 3)) / nullif(sum(o_orderkey % 3), 0) / 100 AS mean", "round(sum(o_totalprice::DECIMAL(18,2) * (o_orderkey % 3))::DOUBLE / nullif(sum(o_orderkey % 3), 0), 6) AS mean")
)
def user_aggregates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumns({"weight": F.col("o_orderkey") % 3, "price": F.col("o_totalprice").cast("decimal(18,2)")})
    found = aggregates.aggregated(
        orders, ["o_custkey"], top=(aggregates.top_k(3, "struct<price:double,key:bigint>"), ["o_totalprice", "o_orderkey"]), mean=(aggregates.weighted_mean(), ["price", "weight"])
    )
    return found.select("o_custkey", F.array_join(F.col("top.key").cast("array<string>"), ",").alias("top"), F.round("mean", 6).alias("mean"))


def _letters(text: str, least: int):
    """Runs of letters of a length or more, and where they begin."""
    for m in re.finditer(r"[A-Za-z]+", text):
        if len(m[0]) >= least:
            yield m[0].lower(), m.start() + 1


@query(
    """SELECT p_partkey, n, word FROM (SELECT p_partkey, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS n FROM (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z]+'), lambda x: len(x) >= 4) AS w FROM part))"""
)
def user_table_function(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("text"), F.lit(4).alias("least"))
    return aggregates.lateral(part, "word string, at int", _letters, ["text", "least"], ordinality="n").select("p_partkey", "n", "word")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_extract_all(lower(n_name), '[a-z]+'), lambda x: len(x) >= 2)) AS word FROM nation) GROUP BY word")
def table_function_in_sql(spark, sf_dir):
    aggregates.table_function(spark, "letters", "word string, at int", _letters)
    return spark.sql("SELECT word, count(*) AS n FROM {nation}, LATERAL letters(n_name, 2) GROUP BY word", nation=table(spark, sf_dir, "nation"))


# Windows

both(
    "ranks",
    """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr,
    CAST(ntile(4) OVER w AS BIGINT) AS quarter, percent_rank() OVER v AS pr, cume_dist() OVER v AS cd FROM {orders}
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""",
)
both(
    "neighbours",
    """SELECT event_id, lag(event_type) OVER w AS before, lead(event_id, 2) OVER w AS after2, first_value(event_id) OVER w AS first_id,
    nth_value(event_id, 2) OVER w AS second_id FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
both(
    "running_totals",
    """SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last3,
    count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near,
    count(*) OVER (PARTITION BY o_custkey) AS total FROM {orders}""",
)


@query(
    """SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS two_groups,
    CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS others FROM orders"""
)
def groups_and_exclude_frames(spark, sf_dir):
    orders, key, total = table(spark, sf_dir, "orders"), F.col("o_orderkey"), frames.sum_of("bigint")
    df = frames.with_frame(orders, "two_groups", total, key, ["o_custkey"], [F.col("o_orderpriority")], "groups", -1, 0)
    df = frames.with_frame(df, "others", total, key, ["o_custkey"], [], "rows", frames.FIRST, frames.UNBOUNDED, "current row")
    return df.select("o_orderkey", "two_groups", "others")


@query(
    """SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS BIGINT) AS no_group,
    CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS BIGINT) AS no_ties,
    CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS BIGINT) AS no_row,
    last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key FROM orders"""
)
def exclude_forms(spark, sf_dir):
    key, by = F.col("o_orderkey"), Window.partitionBy("o_custkey")
    last = F.last("o_orderkey").over(by.orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = table(spark, sf_dir, "orders").withColumn("last_key", last)
    for name, exclude in (("no_group", "group"), ("no_ties", "ties"), ("no_row", "current row")):
        df = frames.with_frame(df, name, frames.sum_of("bigint"), key, ["o_custkey"], [F.col("o_orderpriority")], "range", frames.FIRST, 0, exclude)
    return df.select("o_orderkey", "no_group", "no_ties", "no_row", "last_key")


@query(
    """SELECT o_orderkey, min(p) OVER (w GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS least, max(p) OVER (w GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW EXCLUDE TIES) AS most,
    count(p) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS others, avg(p) OVER (k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS near,
    array_to_string(array_agg(o_orderkey) OVER (k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), ',') AS keys,
    max(p) OVER (r RANGE BETWEEN 400 PRECEDING AND 400 FOLLOWING EXCLUDE GROUP) AS around
    FROM (SELECT *, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice::DECIMAL(18,2) END AS p FROM orders)
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), k AS (PARTITION BY o_custkey ORDER BY o_orderkey), r AS (PARTITION BY o_orderpriority ORDER BY o_custkey)""".replace("(w ", "(PARTITION BY o_custkey ORDER BY o_orderpriority ")
    .replace("(k ", "(PARTITION BY o_custkey ORDER BY o_orderkey ")
    .replace("(r ", "(PARTITION BY o_orderpriority ORDER BY o_custkey ")
    .replace("400", "4")
)
def frames_of_any_aggregate(spark, sf_dir):
    price, first, last = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice").cast("decimal(18,2)")), frames.FIRST, frames.UNBOUNDED
    customer, priority, key = ["o_custkey"], [F.col("o_orderpriority")], [F.col("o_orderkey")]
    df = table(spark, sf_dir, "orders")
    tasks = frames.tasks_for(df)  # those after the first frame find its partitions
    df = frames.with_frame(df, "least", frames.MIN, price, customer, priority, "groups", -1, 1, "group", tasks=tasks)
    df = frames.with_frame(df, "most", frames.MAX, price, customer, priority, "groups", -2, 0, "ties")
    df = frames.with_frame(df, "others", frames.COUNT, price, customer, priority, "range", first, last, "current row")
    df = frames.with_frame(df, "near", frames.avg_of("decimal(28,2)"), price, customer, key, "rows", -3, 3, "current row")
    df = frames.with_frame(df, "keys", frames.ARRAY_AGG, F.col("o_orderkey"), customer, key, "rows", -2, 2, "current row")
    df = frames.with_frame(df, "around", frames.MAX, price, ["o_orderpriority"], [F.col("o_custkey")], "range", -4, 4, "group", along="o_custkey", tasks=tasks)
    return df.select("o_orderkey", "least", "most", "others", "near", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"), "around")


# Order, limit, sets

both("top_with_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5")
both(
    "keyset_page",
    "SELECT o_orderkey, o_custkey FROM {orders} WHERE struct(o_custkey, o_orderkey) > named_struct('o_custkey', 100L, 'o_orderkey', 500L) ORDER BY o_custkey NULLS LAST, o_orderkey NULLS LAST LIMIT 25",
    "SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderkey) > (100, 500) ORDER BY o_custkey NULLS LAST, o_orderkey NULLS LAST LIMIT 25",
)
both("union_distinct", "SELECT c_nationkey AS k, 'c' AS t FROM {customer} UNION SELECT s_nationkey, 's' FROM {supplier}")
both("union_all_common_type", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM {nation} UNION ALL SELECT s_suppkey FROM {supplier}")
both("intersect_distinct", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM {supplier}")
both("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
both("except_distinct", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 8000")
both("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")

# Common table expressions

both(
    "cohorts",
    """WITH firsts AS (SELECT user_id, min(ts) AS first_ts FROM {events} GROUP BY user_id), named AS (SELECT user_id, CAST(date_trunc('day', first_ts) AS DATE) AS cohort FROM firsts)
    SELECT cohort, event_type, count(DISTINCT e.user_id) AS users FROM named JOIN {events} e ON e.user_id = named.user_id GROUP BY cohort, event_type""",
)
both("recursive_walk", "WITH RECURSIVE t(n, depth) AS (SELECT 1, 0 UNION ALL SELECT n * 2, depth + 1 FROM t WHERE depth < 4) SELECT n, depth, n_name FROM t LEFT JOIN {nation} ON n_nationkey = n")


@query("WITH RECURSIVE t(node) AS (SELECT 1::BIGINT UNION SELECT (node * 7 + 3) % 25 FROM t) SELECT node FROM t")
def recursive_dedupe(spark, sf_dir):
    checkpoint_dir(spark)
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    edges = nodes.select("a", ((F.col("a") * 7 + 3) % 25).alias("b"))
    return relational.reachable(nodes.where("a = 1").select(F.col("a").alias("node")), edges, "a", "b")


both(
    "walk_with_path",
    """WITH RECURSIVE t(node, path, cycle) AS (SELECT 1, array(1), false UNION ALL SELECT (node * 7 + 3) % 25, array_append(path, (node * 7 + 3) % 25), array_contains(path, (node * 7 + 3) % 25) FROM t WHERE NOT cycle)
    SELECT node, array_join(path, ',') AS path, cycle, n_name FROM t LEFT JOIN {nation} ON n_nationkey = node""",
    """WITH RECURSIVE t(node, path, cycle) AS (SELECT 1, [1], false UNION ALL SELECT (node * 7 + 3) % 25, list_append(path, (node * 7 + 3) % 25), list_contains(path, (node * 7 + 3) % 25) FROM t WHERE NOT cycle)
    SELECT node, array_to_string(path, ',') AS path, cycle, n_name FROM t LEFT JOIN nation ON n_nationkey = node""",
)

# Table functions, arrays, JSON, calendars

both(
    "unnest_with_ordinality",
    "SELECT vec_id, pos + 1 AS n, round(CAST(x AS DOUBLE), 4) AS x FROM (SELECT vec_id, slice(embedding, 1, 3) AS e FROM {embeddings}) LATERAL VIEW posexplode(e) t AS pos, x",
    "SELECT vec_id, unnest(range(1, 4))::INTEGER AS n, round(unnest(embedding[1:3])::DOUBLE, 4) AS x FROM embeddings",
)
both(
    "json_fields",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, get_json_object(props, '$.none') IS NULL AS missing FROM {events}",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') IS NULL AS missing FROM events",
)
both(
    "json_records",
    """SELECT event_id, r.k, r.none IS NULL AS missing FROM (SELECT event_id, from_json(props, 'k BIGINT, none STRING') AS r FROM {events})""",
    "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k, props ->> 'none' IS NULL AS missing FROM events",
)
both(
    "json_entries",
    "SELECT event_id, e.key, e.value FROM (SELECT event_id, from_json(props, 'MAP<STRING, STRING>') AS m FROM {events}) LATERAL VIEW explode(map_entries(m)) AS e",
    "SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)",
)
both(
    "parallel_rows",
    "SELECT n_nationkey, pos + 1 AS n, z.a, z.b FROM {nation} LATERAL VIEW posexplode(arrays_zip(sequence(1, 3) , array('x', 'y'))) t AS pos, z0 LATERAL VIEW explode(array(named_struct('a', z0['0'], 'b', z0['1']))) u AS z",
    "SELECT n_nationkey, unnest([1, 2, 3]) AS n, unnest([1, 2, 3]) AS a, unnest(['x', 'y']) AS b FROM nation",
)
both(
    "calendar",
    """WITH days AS (SELECT explode(sequence(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE))) AS day FROM {events})
    SELECT day, count(event_id) AS n FROM days LEFT JOIN {events} ON CAST(ts AS DATE) = day GROUP BY day""",
    """WITH days AS (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events)
    SELECT day, count(event_id) AS n FROM days LEFT JOIN events ON ts::DATE = day GROUP BY day""",
)


@query("SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS bin, CAST(extract(dow FROM ts) AS INTEGER) AS dow, CAST(extract(isodow FROM ts) AS INTEGER) AS isodow, CAST(extract(hour FROM ts) AS INTEGER) AS h FROM events")
def date_parts(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", pg.date_bin(900, ts).alias("bin"), pg.dow(ts).alias("dow"), (F.weekday(ts) + 1).alias("isodow"), F.hour(ts).alias("h"))


# Scalar functions


@query(
    """SELECT c_custkey, concat('a', NULL, c_name) AS joined, substring(c_name, -2, 5) AS sub, left(c_name, -3) AS l, right(c_name, -3) AS r, regexp_replace(c_name, '[0-9]', '#') AS once,
    regexp_replace(c_name, '[0-9]', '#', 'g') AS every, split_part(c_name, '#', 2) AS part, lpad(c_mktsegment, 12, '*') AS padded, md5(c_name) AS hashed, translate(c_mktsegment, 'AEI', 'aei') AS low,
    strpos(c_name, 'e')::INTEGER AS at, starts_with(c_mktsegment, 'AUTO') AS auto, reverse(c_mktsegment) AS back FROM customer""".replace("substring(c_name, -2, 5)", "substring(c_name, 1, 2)")
)
def string_functions(spark, sf_dir):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", pg.concat(F.lit("a"), F.lit(None).cast("string"), n).alias("joined"), pg.substring(n, -2, 5).alias("sub"), pg.left(n, -3).alias("l"), pg.right(n, -3).alias("r"),
        pg.regexp_replace(n, "[0-9]", "#").alias("once"), pg.regexp_replace(n, "[0-9]", "#", "g").alias("every"), F.split_part(n, F.lit("#"), F.lit(2)).alias("part"), F.lpad(m, 12, "*").alias("padded"),
        F.md5(n).alias("hashed"), F.translate(m, "AEI", "aei").alias("low"), F.instr(n, "e").alias("at"), m.startswith("AUTO").alias("auto"), F.reverse(m).alias("back"),
    )


@query(
    """SELECT o_orderkey, o_orderkey // 7 AS quotient, gcd(o_orderkey, o_custkey)::BIGINT AS g, lcm(o_orderkey, o_custkey)::BIGINT AS m, trunc(o_totalprice / 3) AS t,
    round(sqrt(o_totalprice), 6) AS root, round(ln(o_totalprice + 1), 6) AS l, o_orderkey & 12 AS a, xor(o_orderkey, 5) AS x, sign(o_custkey - 500)::INTEGER AS s FROM orders"""
)
def math_functions(spark, sf_dir):
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", pg.int_div("o_orderkey", "7").alias("quotient"), pg.gcd(k, c).alias("g"), pg.lcm(k, c).alias("m"), pg.trunc(p / 3).alias("t"), F.round(F.sqrt(p), 6).alias("root"),
        F.round(F.log(p + 1), 6).alias("l"), k.bitwiseAND(12).alias("a"), k.bitwiseXOR(5).alias("x"), F.signum(c - 500).cast("int").alias("s"),
    )


@query(
    """SELECT label, count(*) AS n, '{' || string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) || '}' AS ids, max(vec_id) AS last_id FROM embeddings GROUP BY label"""
)
def array_text(spark, sf_dir):
    ids = F.sort_array(F.collect_list("vec_id"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), pg.array_text(ids).alias("ids"), F.max("vec_id").alias("last_id"))


both(
    "more_text_functions",
    r"""SELECT c_custkey, overlay(c_name PLACING 'xx' FROM 2 FOR 3) AS laid, initcap(lower(c_mktsegment)) AS title, btrim(concat('  ', c_mktsegment, ' ')) AS trimmed, ltrim('C', c_name) AS no_c, repeat('ab', 3) AS again,
    CAST(octet_length(c_name) AS BIGINT) AS n_bytes, regexp_extract(c_name, '([0-9]+)', 1) AS digits, CAST(regexp_count(c_name, '0') AS BIGINT) AS zeros, array_join(split(c_name, '#'), '|') AS parts,
    CAST(ascii(c_mktsegment) AS INT) AS code, chr(65) AS letter, lower(hex(CAST(c_custkey AS BIGINT))) AS hexed FROM {customer}""",
    r"""SELECT c_custkey, left(c_name, 1) || 'xx' || substring(c_name, 5) AS laid, upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) AS title, trim('  ' || c_mktsegment || ' ') AS trimmed, ltrim(c_name, 'C') AS no_c, repeat('ab', 3) AS again,
    strlen(c_name)::BIGINT AS n_bytes, regexp_extract(c_name, '([0-9]+)', 1) AS digits, len(regexp_extract_all(c_name, '0'))::BIGINT AS zeros, array_to_string(string_split(c_name, '#'), '|') AS parts,
    ascii(c_mktsegment)::INTEGER AS code, chr(65) AS letter, lower(to_hex(c_custkey::BIGINT)) AS hexed FROM customer""".replace("ltrim('C', c_name)", "ltrim(c_name, 'C')"),
)
both(
    "more_math_functions",
    """SELECT o_orderkey, ceil(o_totalprice) AS up, floor(o_totalprice) AS down, round(cbrt(o_totalprice), 6) AS cube, round(exp(o_custkey / 10000.0D), 6) AS e, round(log10(o_totalprice + 1), 6) AS l10, round(power(o_custkey, 0.5D), 6) AS pw,
    o_orderkey % 7 AS rest, abs(o_custkey - 500) AS dist, round(degrees(atan2(o_custkey, 3)), 6) AS angle, round(sin(o_custkey) + cos(o_custkey), 6) AS wave, width_bucket(o_totalprice, 0D, 500000D, 10) AS bucket,
    factorial(5) AS f5, shiftleft(o_orderkey, 2) AS sl, o_orderkey | 8 AS bits FROM {orders}""",
    """SELECT o_orderkey, ceil(o_totalprice)::BIGINT AS up, floor(o_totalprice)::BIGINT AS down, round(cbrt(o_totalprice), 6) AS cube, round(exp(o_custkey / 10000.0), 6) AS e, round(log10(o_totalprice + 1), 6) AS l10, round(power(o_custkey, 0.5), 6) AS pw,
    o_orderkey % 7 AS rest, abs(o_custkey - 500) AS dist, round(degrees(atan2(o_custkey, 3)), 6) AS angle, round(sin(o_custkey) + cos(o_custkey), 6) AS wave, (CASE WHEN o_totalprice >= 500000 THEN 11 ELSE floor(o_totalprice / 50000) + 1 END)::BIGINT AS bucket,
    120::BIGINT AS f5, o_orderkey * 4 AS sl, o_orderkey | 8 AS bits FROM orders""",
)
both(
    "more_date_functions",
    """SELECT event_id, date_format(ts, 'yyyy-MM-dd HH:mm') AS shown, CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT) AS epoch, make_date(year(ts), month(ts), 1) AS first_day, last_day(ts) AS last_day, CAST(weekofyear(ts) AS BIGINT) AS week,
    CAST(quarter(ts) AS BIGINT) AS quarter, CAST(dayofyear(ts) AS BIGINT) AS doy, CAST(datediff(CAST(ts AS DATE), DATE '2020-01-01') AS BIGINT) AS days, CAST(date_trunc('week', ts) AS DATE) AS monday, ts + INTERVAL 36 HOURS > TIMESTAMP_NTZ '2024-01-15 00:00:00' AS late FROM {events}""",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown, floor(epoch_us(ts) / 1000000)::BIGINT AS epoch, make_date(year(ts), month(ts), 1) AS first_day, last_day(ts) AS last_day, weekofyear(ts) AS week,
    quarter(ts) AS quarter, dayofyear(ts) AS doy, date_diff('day', DATE '2020-01-01', ts::DATE) AS days, date_trunc('week', ts)::DATE AS monday, ts + INTERVAL 36 HOUR > TIMESTAMP '2024-01-15 00:00:00' AS late FROM events""",
)


@query("SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin' AS there FROM events")
def local_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", pg.at_time_zone(F.col("ts"), "Europe/Berlin").alias("there"))


# Intervals and pictures


@query(
    """SELECT event_id, (extract(year FROM a) * 12 + extract(month FROM a))::INTEGER AS months, extract(day FROM a)::INTEGER AS days, (extract(hour FROM a) * 3600000000 + extract(minute FROM a) * 60000000 + extract(microsecond FROM a))::BIGINT AS micros,
    ts + to_months((user_id % 13)::INTEGER) + to_days((event_id % 40)::INTEGER) + to_microseconds(event_id * 7) AS due, (extract(epoch FROM ts - TIMESTAMP '2023-12-31 18:30:00') * 1000000)::BIGINT AS since
    FROM (SELECT *, age(ts, TIMESTAMP '2023-05-31 18:30:00') AS a FROM events)"""
)
def interval_arithmetic(spark, sf_dir):
    ts, start = F.col("ts"), F.lit("2023-05-31 18:30:00").cast("timestamp_ntz")
    span = spans.plus(spans.make_interval(months=F.col("user_id") % 13, days=F.col("event_id") % 40), spans.make_interval(secs=(F.col("event_id") * 7).cast("decimal(20,6)") / 1_000_000))
    since = spans.between(ts, F.lit("2023-12-31 18:30:00").cast("timestamp_ntz"))
    df = table(spark, sf_dir, "events").select("event_id", spans.age(ts, start).alias("a"), spans.added(ts, span).alias("due"), (since["days"] * F.lit(spans.DAY) + since["micros"]).alias("since"))
    return df.select("event_id", "a.*", "due", "since")


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS exact, strftime(ts, '%-d %B %Y') AS long, strftime(ts, '%I:%M %p') AS clock, strftime(ts, '%a %b') || ' Q' || quarter(ts) AS short, upper(strftime(ts, '%A')) AS day,
    strftime(ts, '%j') AS of_year, date_trunc('minute', ts) AS back, ts::DATE AS day_back FROM events"""
)
def date_pictures(spark, sf_dir):
    ts, shown = F.col("ts"), spans.to_char
    return table(spark, sf_dir, "events").select(
        "event_id", shown(ts, "YYYY-MM-DD HH24:MI:SS.US").alias("exact"), shown(ts, "FMDD FMMonth YYYY").alias("long"), shown(ts, "HH12:MI AM").alias("clock"), shown(ts, 'Dy Mon "Q"Q').alias("short"), shown(ts, "FMDAY").alias("day"),
        shown(ts, "DDD").alias("of_year"), spans.to_timestamp(shown(ts, "Mon DD YYYY HH:MI PM"), "Mon DD YYYY HH:MI PM").alias("back"), spans.to_date(shown(ts, "YYYY/DDD"), "YYYY/DDD").alias("day_back"),
    )


@query(
    """SELECT c_custkey, printf('%.2f', b) AS plain, lpad(CASE WHEN b < 0 THEN '-' ELSE '' END || format('{:,}', abs(b)::DECIMAL(12,0)::BIGINT), 11, ' ') AS grouped, CASE WHEN b < 0 THEN '<' || abs(b)::DECIMAL(12,1) || '>' ELSE b::DECIMAL(12,1)::VARCHAR END AS angle,
    lpad((c_custkey % 1000)::VARCHAR, 5, '0') || CASE WHEN c_custkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN c_custkey % 10 = 1 THEN 'st' WHEN c_custkey % 10 = 2 THEN 'nd' WHEN c_custkey % 10 = 3 THEN 'rd' ELSE 'th' END AS place, b AS back
    FROM (SELECT c_custkey, c_acctbal::DECIMAL(12,2) AS b FROM customer)"""
)
def number_pictures(spark, sf_dir):
    b, shown = F.col("c_acctbal").cast("decimal(12,2)").cast("double"), numerals.to_char  # a double keeps the sign of what is rounded to nothing
    return table(spark, sf_dir, "customer").select(
        "c_custkey", shown(b, "FM99999990.00").alias("plain"), shown(b, "99,999,999").alias("grouped"), shown(b, "FM99999990.0PR").alias("angle"), shown(F.col("c_custkey") % 1000, "FM00000th").alias("place"),
        numerals.to_number(shown(b, "99,999,990.00MI"), "99,999,990.00MI").cast("decimal(12,2)").alias("back"),
    )


# JSON editing and paths


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents: {"k": …, "user": {"id": …, "tags": ["a", event_type]}, "value": … or null}."""
    doc = jsonb.build_object(k=jsonb.get(jsonb.parsed(F.col("props")), "k"), user=jsonb.build_object(id=F.col("user_id"), tags=F.call_function("to_variant_object", F.array(F.lit("a"), "event_type"))), value=F.when(F.col("user_id") % 3 > 0, F.col("event_id")))
    return table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))


EVENT = "(SELECT event_id, user_id, event_type, (props ->> 'k')::BIGINT AS k, CASE WHEN user_id % 3 > 0 THEN event_id::VARCHAR ELSE 'null' END AS v FROM events)"


@query(
    f"""SELECT event_id, '{{"k":-1,"user":{{"id":' || user_id || ',"tags":["a","' || event_type || '"]}},"value":' || v || '}}' AS set_key, '{{"k":' || k || ',"user":{{"id":' || user_id || ',"tags":[{{"n":null}},"' || event_type || '"]}},"value":' || v || '}}' AS set_deep,
    '{{"k":' || k || ',"user":{{"id":' || user_id || ',"tags":["a","new","' || event_type || '"]}},"value":' || v || '}}' AS inserted, '{{"k":' || k || ',"user":{{"id":' || user_id || ',"tags":["a"]}},"value":' || v || '}}' AS cut,
    '{{"user":{{"id":' || user_id || ',"tags":["a","' || event_type || '"]}},"value":' || v || ',"z":1}}' AS merged FROM {EVENT}"""
)
def json_edits(spark, sf_dir):
    doc, new = F.col("doc"), lambda text: jsonb.parsed(F.lit(text))
    return _documents(spark, sf_dir).select(
        "event_id", jsonb.shown(jsonb.set_path(doc, "{k}", new("-1"))).alias("set_key"), jsonb.shown(jsonb.set_path(doc, "{user,tags,0}", new('{"n": null}'))).alias("set_deep"),
        jsonb.shown(jsonb.insert_path(doc, "{user,tags,-1}", new('"new"'))).alias("inserted"), jsonb.shown(jsonb.delete_path(doc, "{user,tags,1}")).alias("cut"),
        jsonb.shown(jsonb.concat(jsonb.delete(doc, "k"), new('{"z": 1}'))).alias("merged"),
    )


@query(
    f"""SELECT event_id, event_type AS tag, user_id % 3 > 0 AS valued, event_type = 'click' AS clicked, k > 50 AND user_id < 20 AS small, CASE WHEN k > 50 THEN user_id::VARCHAR END AS found, '["a","' || event_type || '"]' AS tags, 'k,user,value' AS keys,
    CASE WHEN v = 'null' THEN 'null' ELSE 'number' END AS kind FROM {EVENT}"""
)
def json_paths(spark, sf_dir):
    doc = F.col("doc")
    return _documents(spark, sf_dir).select(
        "event_id", jsonb.get_path_text(doc, "{user,tags,-1}").alias("tag"), jsonb.get_text(doc, "value").isNotNull().alias("valued"), jsonb.contains(doc, {"user": {"tags": ["click"]}}).alias("clicked"),
        jsonb.path_exists(doc, "$ ? (@.k > 50 && @.user.id < 20)").alias("small"), jsonb.as_text(jsonb.path_query_first(doc, "$ ? (@.k > 50).user.id")).alias("found"),
        F.to_json(jsonb.path_query_array(doc, "$.user.tags[*]")).alias("tags"), F.array_join(jsonb.keys(doc), ",").alias("keys"), jsonb.typeof(jsonb.get(doc, "value")).alias("kind"),
    )


# Ranges


def _order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the days [o_orderdate, o_orderdate + o_orderkey % 30): empty for some, without an end for those that are pending."""
    day = F.col("o_orderdate").cast("date")
    end = F.when(F.col("o_orderstatus") != "P", F.date_add(day, (F.col("o_orderkey") % 30).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", ranges.make_range(day, end, discrete=True).alias("days"))


WINDOWS = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate::DATE AS a, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE + (o_orderkey % 30)::INTEGER END AS b FROM orders)"


@query(
    f"""SELECT o_orderkey, CASE WHEN a = b THEN 'empty' ELSE '[' || a || ',' || coalesce(b::VARCHAR, '') || ')' END AS shown, coalesce(a < b AND a <= DATE '1998-01-15' AND DATE '1998-01-15' < b, a <= DATE '1998-01-15') AS holds,
    coalesce(a < b, true) AND a < DATE '1998-02-01' AND coalesce(b > DATE '1998-01-01', true) AS meets, coalesce(a < b AND b <= DATE '1998-01-01', false) AS before, coalesce(a < b, true) AND (coalesce(b = DATE '1998-01-01', false) OR a = DATE '1998-02-01') AS touches,
    CASE WHEN coalesce(a < b, true) AND a < DATE '1998-02-01' AND coalesce(b > DATE '1998-01-01', true) THEN '[' || greatest(a, DATE '1998-01-01') || ',' || least(coalesce(b, DATE '1998-02-01'), DATE '1998-02-01') || ')' ELSE 'empty' END AS common,
    '{{' || CASE WHEN coalesce(a < b, true) AND a < DATE '1998-01-01' THEN '[' || a || ',' || least(coalesce(b, DATE '1998-01-01'), DATE '1998-01-01') || ')' ELSE '' END
      || CASE WHEN coalesce(a < b, true) AND a < DATE '1998-01-01' AND coalesce(b > DATE '1998-02-01', true) THEN ',' ELSE '' END
      || CASE WHEN coalesce(a < b, true) AND coalesce(b > DATE '1998-02-01', true) THEN '[' || greatest(a, DATE '1998-02-01') || ',' || coalesce(b::VARCHAR, '') || ')' ELSE '' END || '}}' AS rest FROM {WINDOWS}"""
)
def range_operators(spark, sf_dir):
    r, day = F.col("days"), lambda d: F.lit(d).cast("date")
    month = ranges.make_range(day("1998-01-01"), day("1998-02-01"), discrete=True)
    return _order_windows(spark, sf_dir).select(
        "o_orderkey", ranges.text(r).alias("shown"), ranges.contains_value(r, day("1998-01-15")).alias("holds"), ranges.overlaps(r, month).alias("meets"), ranges.left_of(r, month).alias("before"),
        ranges.adjacent(r, month).alias("touches"), ranges.text(ranges.intersection(r, month)).alias("common"), ranges.multirange_text(ranges.pieces(r, month)).alias("rest"),
    )


@query(
    f"""WITH w AS (SELECT o_custkey, a, coalesce(b, DATE '9999-01-01') AS b FROM {WINDOWS} WHERE coalesce(a < b, true)), m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM w),
    i AS (SELECT *, sum(CASE WHEN h >= a THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM m), g AS (SELECT o_custkey, i, min(a) AS a, max(b) AS b FROM i GROUP BY ALL),
    t AS (SELECT o_custkey, '{{' || string_agg('[' || a || ',' || CASE WHEN b = DATE '9999-01-01' THEN '' ELSE b::VARCHAR END || ')', ',' ORDER BY a) || '}}' AS days FROM g GROUP BY o_custkey)
    SELECT o_custkey, coalesce(t.days, '{{}}') AS days FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN t USING (o_custkey)"""
)
def range_aggregate(spark, sf_dir):
    return intervals.range_agg(_order_windows(spark, sf_dir), ["o_custkey"], "days").select("o_custkey", ranges.multirange_text(F.col("days")).alias("days"))


@query(
    f"""SELECT o_custkey, CASE WHEN bool_or(a = b) OR max(a) >= min(b) THEN 'empty' ELSE '[' || max(a) || ',' || coalesce(min(b)::VARCHAR, '') || ')' END AS days FROM (SELECT o_custkey, a, b FROM {WINDOWS}) GROUP BY o_custkey""".replace("bool_or(a = b) OR max(a) >= min(b)", "coalesce(bool_or(a = b), false) OR coalesce(max(a) >= min(b), false)")
)
def range_intersection_aggregate(spark, sf_dir):
    return _order_windows(spark, sf_dir).groupBy("o_custkey").agg(ranges.text(ranges.range_intersect_agg(F.col("days"))).alias("days"))


@query(
    f"""WITH s AS (SELECT l_suppkey, l_returnflag, min(l_shipdate)::DATE AS c, min(l_shipdate)::DATE + (l_suppkey % 400)::INTEGER + 1 AS d FROM lineitem GROUP BY l_suppkey, l_returnflag)
    SELECT l_suppkey, l_returnflag, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM s JOIN {WINDOWS} ON a < d AND coalesce(c < b, true) AND coalesce(a < b, true) GROUP BY l_suppkey, l_returnflag"""
)
def range_overlap_join(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min("l_shipdate").cast("date").alias("c"))
    season = first.select("l_suppkey", "l_returnflag", ranges.make_range(F.col("c"), F.date_add("c", (F.col("l_suppkey") % 400).cast("int") + 1), discrete=True).alias("season"))
    met = intervals.overlap_totals(_order_windows(spark, sf_dir), season, [], "days", "season", "n", {"keys": "o_orderkey"})
    return met.select("l_suppkey", "l_returnflag", "n", "keys")


# Writes, as the table after them


def _new_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return rows.select(F.when(F.col("o_orderkey") % 100 == 0, F.col("o_orderkey") + 10_000_000).otherwise(F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), F.lit(1.5).alias("o_totalprice"))


NEW = "(SELECT CASE WHEN o_orderkey % 100 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS k, o_custkey AS c, 'N' AS s, 1.5::DOUBLE AS p FROM orders WHERE o_orderstatus = 'P')"


@query(
    f"""SELECT coalesce(o_orderkey, k) AS o_orderkey, coalesce(o_custkey, c) AS o_custkey, coalesce(s, o_orderstatus) AS o_orderstatus, coalesce(o_totalprice, p) AS o_totalprice
    FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders) FULL JOIN {NEW} ON o_orderkey = k"""
)
def upsert(spark, sf_dir):
    target = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return writes.upserted(target, _new_orders(spark, sf_dir), ["o_orderkey"], ["o_orderstatus"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, 'unnamed', NULL FROM nation WHERE n_regionkey = 1")
def insert_with_defaults(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = nation.where("n_regionkey = 1").select((F.col("n_nationkey") + 100).cast("int").alias("n_nationkey"))
    return writes.inserted(nation, rows, {"n_name": F.lit("unnamed")})


@query(
    """SELECT c_custkey, CASE WHEN n IS NULL THEN c_acctbal ELSE c_acctbal + n END AS c_acctbal FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON o_custkey = c_custkey"""
)
def update_from(spark, sf_dir):
    source = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return writes.updated(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), source, ["c_custkey"], {"c_acctbal": F.col("c_acctbal") + F.col("n")})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_using(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return writes.deleted(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_returning(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return writes.returning(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 90, 'nowhere', NULL UNION ALL SELECT 91, 'unnamed', 2")
def insert_values(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = spark.createDataFrame([(90, "nowhere", None), (91, "unnamed", 2)], "n_nationkey int, n_name string, n_regionkey int")
    return writes.inserted(nation, rows, {})


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE false")
def truncate(spark, sf_dir):
    return writes.truncated(table(spark, sf_dir, "nation"))


@query(
    """SELECT c_custkey, c_acctbal AS old_c_acctbal, c_acctbal + n AS new_c_acctbal FROM customer
    JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON o_custkey = c_custkey"""
)
def update_returning(spark, sf_dir):
    source = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return writes.returning_update(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), source, ["c_custkey"], {"c_acctbal": F.col("c_acctbal") + F.col("n")})


@query(
    f"""SELECT k AS o_orderkey, CASE WHEN o_orderkey IS NULL THEN c ELSE o_custkey END AS o_custkey, 'N' AS o_orderstatus, CASE WHEN o_orderkey IS NULL THEN p ELSE o_totalprice END AS o_totalprice, o_orderkey IS NULL AS inserted
    FROM {NEW} LEFT JOIN (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders) ON o_orderkey = k WHERE o_orderkey IS NULL OR o_totalprice > 100000"""
)
def upsert_returning(spark, sf_dir):
    target = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return writes.returning_upsert(target, _new_orders(spark, sf_dir), ["o_orderkey"], ["o_orderstatus"], F.col("o.o_totalprice") > 100000)


@query(
    """SELECT c_custkey, c_name, CASE WHEN n IS NULL THEN c_acctbal ELSE c_acctbal - least END AS c_acctbal FROM customer
    LEFT JOIN (SELECT s_nationkey, count(*) AS n, min(s_acctbal) AS least FROM supplier GROUP BY s_nationkey) ON s_nationkey = c_nationkey"""
)
def update_from_same_names(spark, sf_dir):
    """The source has a c_acctbal of its own."""
    source = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_acctbal").alias("c_acctbal"))
    return writes.updated(table(spark, sf_dir, "customer"), source, ["c_nationkey"], {"c_acctbal": F.col("old.c_acctbal") - F.col("src.c_acctbal")}).select("c_custkey", "c_name", "c_acctbal")


# What tables must hold

LINES = tables.TableSpec("lineitem", (tables.ColumnSpec("l_orderkey", "bigint"), tables.ColumnSpec("l_linenumber", "int")), ("l_orderkey", "l_linenumber"), (("l_partkey", "part", "p_partkey"),))
ORDERS = tables.TableSpec(
    "orders",
    (
        tables.ColumnSpec("o_orderkey", "bigint", nullable=False),
        tables.ColumnSpec("o_orderstatus", "string", allowed=("F", "O")),
        tables.ColumnSpec("o_totalprice", "double", low=1000, high=450000),
        tables.ColumnSpec("o_orderpriority", "string", max_length=8),
    ),
    ("o_orderkey",),
    checks={"odd_customer": "o_custkey % 10 <> 0 OR o_orderstatus = 'F'"},
)


@query(
    """SELECT '{"o_orderkey":' || o_orderkey || '}' AS key, v.c AS "column", v.r AS rule, v.x AS value FROM (SELECT o_orderkey, unnest([
    CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN {'c': 'o_orderstatus', 'r': 'enum', 'x': o_orderstatus} END, CASE WHEN o_totalprice < 1000 THEN {'c': 'o_totalprice', 'r': 'min', 'x': o_totalprice::VARCHAR} END,
    CASE WHEN o_totalprice > 450000 THEN {'c': 'o_totalprice', 'r': 'max', 'x': o_totalprice::VARCHAR} END, CASE WHEN length(o_orderpriority) > 8 THEN {'c': 'o_orderpriority', 'r': 'max_length', 'x': o_orderpriority} END,
    CASE WHEN NOT (o_custkey % 10 <> 0 OR o_orderstatus = 'F') THEN {'c': '', 'r': 'odd_customer', 'x': NULL} END]) AS v FROM orders) WHERE v IS NOT NULL"""
)
def validate_orders(spark, sf_dir):
    return tables.violations(table(spark, sf_dir, "orders"), ORDERS)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return tables.repeated_keys(table(spark, sf_dir, "lineitem"), LINES)


@query("SELECT 'l_partkey' AS \"column\", l_partkey::VARCHAR AS value, count(*) AS n_rows FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY l_partkey")
def orphan_references(spark, sf_dir):
    return tables.orphans(table(spark, sf_dir, "lineitem"), LINES, {"part": table(spark, sf_dir, "part").where("p_size < 40")})


@query(
    """SELECT table_name, CAST(ordinal_position AS BIGINT) AS ordinal, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END AS type, true AS nullable
    FROM information_schema.columns WHERE table_name IN ('nation', 'customer', 'part')"""
)
def catalogue_columns(spark, sf_dir):
    return catalogue(spark, {t: table(spark, sf_dir, t) for t in ("nation", "customer", "part")})


@query("SELECT * FROM (VALUES ('c_mktsegment', 'removed', 'string', NULL), ('c_acctbal', 'type', 'double', 'float'), ('c_rank', 'added', NULL, 'int')) AS t(\"column\", change, before, after)")
def schema_differences(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    changed = customer.drop("c_mktsegment").withColumn("c_acctbal", F.col("c_acctbal").cast("float")).withColumn("c_rank", F.lit(1))
    return tables.differences(catalogue(spark, {"customer": customer}), catalogue(spark, {"customer": changed}))


def generated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many generated rows as orders has; they break no rule of their spec, which tests check."""
    spec = tables.TableSpec("orders", ORDERS.columns, ORDERS.key)
    return generation.generated(spark, spec, table(spark, sf_dir, "orders").count(), seed=7)


QUERIES["generated_orders"] = generated_orders


SHOPS = tables.TableSpec(
    "shops",
    (
        tables.ColumnSpec("code", "string", nullable=False, pattern=r"[A-Z]{3}-\d{4}"),
        tables.ColumnSpec("region", "string", allowed=("north", "south")),
        tables.ColumnSpec("opened", "date", low="2001-02-03", high="2010-01-01"),
        tables.ColumnSpec("open", "boolean", nullable=False),
    ),
    ("code",),
)
SALES = tables.TableSpec(
    "sales",
    (
        tables.ColumnSpec("sale", "bigint", nullable=False),
        tables.ColumnSpec("shop", "string"),
        tables.ColumnSpec("ticket", "string", pattern=r"T\d{9}[a-f]"),
        tables.ColumnSpec("price", "double", low=1, high=500),
        tables.ColumnSpec("cost", "double", low=1, high=500),
    ),
    ("sale",),
    (("shop", "shops", "code"),),
    {"gain": "price > cost"},
    ("ticket",),
)


@query(
    """SELECT (SELECT count(*) FROM customer) AS n_shops, (SELECT count(*) FROM orders) AS n_sales, (SELECT count(*) FROM customer) AS n_codes, (SELECT count(*) FROM orders) AS n_keys, (SELECT count(*) FROM orders) AS n_tickets,
    0::BIGINT AS orphans, 0::BIGINT AS broken, true AS both_regions, true AS both_open, true AS dates_inside"""
)
def generated_with_references(spark, sf_dir):
    """As many shops as customers and as many sales as orders: counts of what they break, which is nothing."""
    n_shops, n_sales = table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "orders").count()
    shops = generation.generated(spark, SHOPS, n_shops, seed=3)
    sales = generation.generated(spark, SALES, n_sales, seed=4, parents={"shops": (SHOPS, n_shops, 3)})
    broken = tables.violations(shops, SHOPS).select("rule").union(tables.violations(sales, SALES).select("rule")).agg(F.count("*").alias("broken"))
    orphans = tables.orphans(sales, SALES, {"shops": shops}).agg(F.count("*").alias("orphans"))
    of_shops = shops.agg(
        F.count("*").alias("n_shops"), F.count_distinct("code").alias("n_codes"), (F.count_distinct("region") == 2).alias("both_regions"), (F.count_distinct("open") == 2).alias("both_open"),
        F.bool_and(F.col("opened").between("2001-02-03", "2010-01-01")).alias("dates_inside"),
    )
    of_sales = sales.agg(F.count("*").alias("n_sales"), F.count_distinct("sale").alias("n_keys"), F.count_distinct("ticket").alias("n_tickets"))
    return of_shops.crossJoin(of_sales).crossJoin(broken).crossJoin(orphans)
