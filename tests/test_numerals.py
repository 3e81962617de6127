"""Number pictures: the examples of PostgreSQL's manual, and rules for signs, groups and room."""

import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.functions import numerals as N
from marlstone.plans.queries import QUERIES, SQL

D = decimal.Decimal

#: (number, picture): text, from the manual's table of to_char examples where it has the picture.
CASES = {
    ("-0.1", "99.99"): "  -.10", ("-0.1", "FM9.99"): "-.1", ("0.1", "0.9"): " 0.1", ("12", "9990999.9"): "    0012.0", ("12", "FM9990999.9"): "0012.", ("485", "999"): " 485", ("-485", "999"): "-485", ("1485", "9,999"): " 1,485",
    ("148.5", "999.999"): " 148.500", ("148.5", "FM999.999"): "148.5", ("148.5", "FM999.990"): "148.500", ("-485", "999S"): "485-", ("-485", "999MI"): "485-", ("485", "999MI"): "485 ", ("485", "FM999MI"): "485", ("485", "PL999"): "+485", ("485", "SG999"): "+485",
    ("-485", "SG999"): "-485", ("-485", "9SG99"): "4-85", ("-485", "999PR"): "<485>", ("485", "RN"): "        CDLXXXV", ("485", "FMRN"): "CDLXXXV", ("5.2", "FMRN"): "V", ("482", "999th"): " 482nd", ("485", '"Good number:"999'): " Good number:485", ("12", "99V999"): " 12000",
    ("12.4", "99V999"): " 12400", ("12.45", "99V9"): " 125", ("0.0004859", "9.99EEEE"): " 4.86e-04", ("1234", "999"): " ###", ("-1234.5", "999.9"): "-###.#", ("0", "999"): "   0", ("0", "FM999"): "0", ("1234567", "FM9,999,999"): "1,234,567", ("67", "FM9,999,999"): "67",
    ("67", "9,999"): "    67", ("0.5", "999"): "   1", ("2.5", "FM9"): "3", ("-2.5", "FM9"): "-3", ("12", "S999"): " +12", ("-12", "FMS999"): "-12", ("485", "999PR"): " 485 ", ("11", "FM99TH"): "11TH", ("3999", "FMrn"): "mmmcmxcix",
}


def test_pictures(spark):
    got = spark.range(1).select(*(N.to_char(F.lit(x).cast("decimal(20,8)"), p).alias(f"c{i}") for i, (x, p) in enumerate(CASES))).first()
    assert dict(zip(CASES, got, strict=True)) == CASES


def test_doubles_nulls_and_bad_pictures(spark):
    got = spark.range(1).select(N.to_char(F.lit(12.345), "FM99.00"), N.to_char(F.lit(None).cast("double"), "9"), N.to_char(F.lit(4000), "FMRN"), N.to_char(F.lit(7), "000"), N.to_char(F.lit(1.5e10), "9.9EEEE")).first()
    assert tuple(got) == ("12.35", None, "#" * 15, " 007", " 1.5e+10")
    for bad in ("9.9.9", "S9MI"):
        with pytest.raises(ValueError, match="bad picture"):
            N.picture(bad)


def test_a_double_that_is_rounded_to_nothing_keeps_its_sign(spark):
    pictures = ("99,999", "FM990.0PR", "999S")
    shown = lambda x: tuple(spark.range(1).select(*(N.to_char(x, p).alias(p) for p in pictures)).first())
    assert shown(F.lit(-0.04)) == ("     -0", "<0.0>", "  0-") and shown(F.lit(-0.0)) == shown(F.lit(-1e-20)) == ("     -0", "<0.0>", "  0-")
    assert shown(F.lit("-0.04").cast("decimal(12,2)")) == shown(F.lit(0.04)) == ("      0", "0.0", "  0+")


def test_small_negative_balances_agree_with_duckdb(spark, tmp_path):
    cents = [*range(-160, 160), 9_999_999_949, -9_999_999_949, None]
    rows = [(i, None if c is None else c / 100) for i, c in enumerate(cents)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    df = QUERIES["number_pictures"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(SQL["number_pictures"]).fetchall())


def test_numbers_by_pictures(spark):
    cases = {("12,454.8-", "99G999D9S"): D("-12454.8"), ("<485>", "999PR"): D(-485), (" 1,485", "9,999"): D(1485), ("+12", "S99"): D(12), ("-.1", "9.9"): D("-0.1"), ("$ 12.30", "L99.99"): D("12.30"), ("12000", "99V999"): D(12)}
    got = spark.range(1).select(*(N.to_number(F.lit(t), p).alias(f"c{i}") for i, (t, p) in enumerate(cases))).first()
    assert list(got) == list(cases.values())
    assert spark.range(1).select(N.to_number(F.lit(None).cast("string"), "9")).first()[0] is None
    with pytest.raises(Exception, match="no number"):
        spark.range(1).select(N.to_number(F.lit("x.y.z"), "9")).collect()


def test_round_trip(spark):
    df = spark.range(-3000, 3000, 7).select((F.col("id") * F.lit(37)).cast("decimal(12,2)").alias("x")).withColumn("x", (F.col("x") / 100).cast("decimal(12,2)"))
    for p in ("S99,999.99", "99,999.99MI", "FM99990.00", "99999.99PR"):
        assert df.where(N.to_number(N.to_char(F.col("x"), p), p) != F.col("x")).count() == 0
