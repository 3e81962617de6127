"""Intervals and date pictures, with what PostgreSQL's manual and its rules give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import spans as S


def ask(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def made(**parts):
    return S.make_interval(**parts)


def test_text_of_intervals(spark):
    cases = {
        "1 year 2 mons 3 days 04:05:06.7": made(months=14, days=3, hours=4, mins=5, secs=6.7), "00:00:00": made(), "-1 years -1 mons": made(months=-13), "1 mon -1 days": made(months=1, days=-1), "-1 mons +2 days -03:00:00": made(months=-1, days=2, hours=-3),
        "-2 days +01:00:00": made(days=-2, hours=1), "123:00:00": made(hours=123), "-00:00:00.000001": S.negated(made(secs=0.000001)), "14 days": made(weeks=2), "2 years 1 day": made(years=2, days=1),
    }
    assert ask(spark, *map(S.text, cases.values())) == list(cases)
    assert ask(spark, S.text(F.lit(None).cast("struct<months:int,days:int,micros:bigint>")), S.text(made(months=F.lit(None).cast("int")))) == [None, None]


def test_justify_and_compare(spark):
    got = ask(
        spark, S.text(S.justify_hours(made(hours=27))), S.text(S.justify_days(made(days=35))), S.text(S.justify_interval(made(months=1, hours=-1))), S.text(S.justify_hours(made(days=1, hours=-1))), S.text(S.justify_hours(made(days=-1, hours=49))),
        S.text(S.justify_days(made(months=1, days=-1))), S.text(S.justify_interval(made(months=-1, days=31, hours=25))), S.text(S.plus(made(months=1), made(days=2))), S.text(S.minus(made(days=1), made(hours=1))), S.text(S.times(made(months=5, days=1, secs=1.5), 3)),
    )
    assert got == ["1 day 03:00:00", "1 mon 5 days", "29 days 23:00:00", "23:00:00", "1 day 01:00:00", "29 days", "2 days 01:00:00", "1 mon 2 days", "1 day -01:00:00", "1 year 3 mons 3 days 00:00:04.5"]
    small, same, big = made(days=29, hours=25), made(days=30), made(months=1)
    assert ask(spark, S.comparable(small) > S.comparable(big), S.comparable(same) == S.comparable(big), S.comparable(made(months=2147483647)) > S.comparable(big), S.epoch(made(months=13, days=1, secs=1.5))) == [True, True, True, 31557600 + 2592000 + 86400 + 1.5]


def test_calendar_arithmetic(spark):
    got = ask(spark, S.added(at("2024-01-31"), made(months=1)), S.added(at("2023-03-31 10:00"), made(months=-1, days=1, hours=25)), S.added(at("2024-02-29"), made(years=1), -1), S.added(at("2024-01-31"), made(months=1, days=1)), S.added(F.lit(None).cast("timestamp_ntz"), made(days=1)))
    assert got == [dt.datetime(2024, 2, 29), dt.datetime(2023, 3, 2, 11), dt.datetime(2023, 2, 28), dt.datetime(2024, 3, 1), None]
    assert ask(spark, S.text(S.between(at("2024-03-01 01:00"), at("2024-02-28 02:00"))), S.text(S.between(at("2024-02-28 02:00"), at("2024-03-01 01:00")))) == ["1 day 23:00:00", "-1 days -23:00:00"]


def test_age(spark):
    cases = {
        ("2001-04-10", "1957-06-13"): "43 years 9 mons 27 days", ("1957-06-13", "2001-04-10"): "-43 years -9 mons -27 days", ("2024-03-01", "2024-01-31"): "1 mon 1 day", ("2023-03-01", "2023-01-31"): "1 mon 1 day", ("2024-03-31", "2024-02-29"): "1 mon 2 days",
        ("2024-02-29", "2023-02-28"): "1 year 1 day", ("2024-01-02 01:00", "2024-01-01 02:00"): "23:00:00", ("2024-03-01 00:00", "2024-02-29 00:00:01"): "23:59:59", ("2024-05-05", "2024-05-05"): "00:00:00", ("2024-01-01 10:00", "2024-03-01 09:00"): "-1 mons -30 days -23:00:00",
    }
    assert ask(spark, *(S.text(S.age(at(a), at(b))) for a, b in cases)) == list(cases.values())


def test_age_and_its_addition_agree(spark):
    """earlier + months, then + days and time, gives the later one wherever the month's last day does not cut it."""
    rng = random.Random(2)
    rows = [(dt.datetime(2000, 1, 1) + dt.timedelta(seconds=rng.randint(0, 10**9)), dt.datetime(2000, 1, 1) + dt.timedelta(seconds=rng.randint(0, 10**9))) for _ in range(500)]
    df = spark.createDataFrame([(min(r), max(r)) for r in rows], "a timestamp_ntz, b timestamp_ntz").withColumn("i", S.age(F.col("b"), F.col("a")))
    got = df.select("a", "b", "i.*", S.added(F.col("a"), F.col("i")).alias("back"), S.text(S.age(F.col("a"), F.col("b"))) == S.text(S.negated(F.col("i")))).collect()
    assert all(r[-1] and 0 <= r["days"] <= 31 and 0 <= r["micros"] < S.DAY for r in got)
    assert all(r["back"] == r["b"] for r in got if r["a"].day <= 28 and (r["days"] == 0 or r["a"].day + r["days"] <= 28))


PICTURES = {
    "YYYY-MM-DD HH24:MI:SS.US": "2024-02-05 15:04:09.070500", "FMMonth FMDDth, YYYY": "February 5th, 2024", "Month|MON|mon": "February |FEB|feb", "Day|FMDAY|dy": "Monday   |MONDAY|mon", "HH12:MI am": "03:04 pm", "HH:MI P.M.": "03:04 P.M.",
    "DDD D ID Q W": "036 2 1 1 1", 'YY "is the year" YY': "24 is the year 24", "IYYY-IW": "2024-06", "MS J SSSS CC": "070 2460346 54249 21", "WW FMMM": "06 2", "DDTH DDDth": "05TH 036th", "": "",
}


def test_pictures_of_dates(spark):
    assert ask(spark, *(S.to_char(at("2024-02-05 15:04:09.0705"), p) for p in PICTURES)) == list(PICTURES.values())
    ends = ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "22nd", "23rd", "31st"]
    assert ask(spark, *(S.to_char(at(f"2024-01-{int(e[:-2]):02}"), "FMDDth") for e in ends)) == ends
    assert ask(spark, S.to_char(F.lit(None).cast("timestamp_ntz"), "YYYY"), S.to_char(at("2024-01-01 00:30"), "HH12 AM"), S.to_char(F.lit(dt.date(2024, 12, 31)), "IYYY IW IDDD")) == [None, "12 AM", "2025 01 002"]


def test_dates_by_pictures(spark):
    cases = {
        ("2024-02-05 15:04:09.0705", "YYYY-MM-DD HH24:MI:SS.US"): dt.datetime(2024, 2, 5, 15, 4, 9, 70500), ("05 Feb 2000", "DD Mon YYYY"): dt.datetime(2000, 2, 5), ("5  february 2000", "DD Month YYYY"): dt.datetime(2000, 2, 5), ("2024/060", "YYYY-DDD"): dt.datetime(2024, 2, 29),
        ("12:30 am 3.4.2024", "HH12:MI AM DD.MM.YYYY"): dt.datetime(2024, 4, 3, 0, 30), ("03:00 p.m. 2024", "HH:MI P.M. YYYY"): dt.datetime(2024, 1, 1, 15), ("20240205", "YYYYMMDD"): dt.datetime(2024, 2, 5), ("2024-01-01 00:00:00.5", "YYYY-MM-DD HH24:MI:SS.MS"): dt.datetime(2024, 1, 1, 0, 0, 0, 500000),
    }
    assert ask(spark, *(S.to_timestamp(F.lit(t), p) for t, p in cases)) == list(cases.values())
    assert ask(spark, S.to_date(F.lit("05 Feb 2000"), "DD Mon YYYY"), S.to_date(F.lit(None).cast("string"), "YYYY")) == [dt.date(2000, 2, 5), None]
    for text in ("x", "2024-13-01", "2024-02-30"):
        with pytest.raises(Exception, match="(?i)date|month|invalid|field"):
            ask(spark, S.to_timestamp(F.lit(text), "YYYY-MM-DD"))
