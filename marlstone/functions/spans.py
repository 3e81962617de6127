"""PostgreSQL's intervals and date pictures as Column expressions.

An interval is a struct (months, days, micros): a month has no fixed number of days and a day no fixed length, so the parts are kept apart. For
comparisons alone a month counts 30 days and a day 24 hours. A null part or interval gives null. Timestamps are without a zone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000


def _let(x: Column, f) -> Column:
    """f(x), with the expression x once in the plan."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _made(months: Column, days: Column, micros: Column) -> Column:
    known = months.isNotNull() & days.isNotNull() & micros.isNotNull()
    return F.when(known, F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), micros.cast("bigint").alias("micros")))


def _int(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def make_interval(years=0, months=0, weeks=0, days=0, hours=0, mins=0, secs=0) -> Column:
    """make_interval(…): numbers or columns; seconds may have a fraction, rounded to microseconds."""
    y, m, w, d, h, i, s = map(_int, (years, months, weeks, days, hours, mins, secs))
    micros = h.cast("bigint") * HOUR + i.cast("bigint") * (60 * SECOND) + F.round(s.cast("decimal(20,7)") * SECOND, 0).cast("bigint")
    return _made(y * 12 + m, w * 7 + d, micros)


def negated(i: Column) -> Column:
    return _made(-i["months"], -i["days"], -i["micros"])


def plus(a: Column, b: Column) -> Column:
    return _made(a["months"] + b["months"], a["days"] + b["days"], a["micros"] + b["micros"])


def minus(a: Column, b: Column) -> Column:
    return plus(a, negated(b))


def times(i: Column, n: int) -> Column:
    """i * n for a whole number."""
    return _made(i["months"] * n, i["days"] * n, i["micros"] * n)


def _carried(part: Column, unit: int) -> tuple[Column, Column]:
    """Whole units in a part, towards zero, and the rest."""
    whole = F.when(part >= 0, F.floor(part / unit)).otherwise(-F.floor(-part / unit)) if unit < 1 << 31 else F.call_function("div", part, F.lit(unit))
    return whole, part - whole * unit


def _signed(high: Column, low: Column, unit: int) -> tuple[Column, Column]:
    """Both parts with one sign, where one can borrow from the other."""
    down, up = (high > 0) & (low < 0), (high < 0) & (low > 0)
    return F.when(down, high - 1).when(up, high + 1).otherwise(high), F.when(down, low + unit).when(up, low - unit).otherwise(low)


def justify_hours(i: Column) -> Column:
    """24 hours become a day."""

    def done(x: Column) -> Column:
        whole, rest = _carried(x["micros"], DAY)
        days, micros = _signed(x["days"] + whole, rest, DAY)
        return _made(x["months"], days, micros)

    return _let(i, done)


def justify_days(i: Column) -> Column:
    """30 days become a month."""

    def done(x: Column) -> Column:
        whole, rest = _carried(x["days"], 30)
        months, days = _signed(x["months"] + whole, rest, 30)
        return _made(months, days, x["micros"])

    return _let(i, done)


def justify_interval(i: Column) -> Column:
    """Both, with one sign throughout."""

    def done(x: Column) -> Column:
        total = (x["months"].cast("decimal(38,0)") * 30 + x["days"]) * DAY + x["micros"]
        sign = F.when(total < 0, -1).otherwise(1)
        size = F.abs(total)
        days = F.floor(size / DAY).cast("bigint")
        months = F.floor(days / 30)
        return _made(sign * months, sign * (days - months * 30), sign * (size - days.cast("decimal(38,0)") * DAY).cast("bigint"))

    return _let(i, done)


def comparable(i: Column) -> Column:
    """A number by which intervals are ordered, and are equal: 1 month and 30 days are."""
    return (i["months"].cast("decimal(20,0)") * 30 + i["days"]).cast("decimal(20,0)") * F.lit(DAY).cast("decimal(12,0)") + i["micros"]


def epoch(i: Column) -> Column:
    """extract(epoch FROM i) in seconds: 12 months count 365.25 days, further months 30."""
    years, months = _carried(i["months"], 12)
    return years * 31_557_600.0 + months * (30 * 86_400.0) + i["days"] * 86_400.0 + i["micros"] / SECOND


def added(ts: Column, i: Column, sign: int = 1) -> Column:
    """ts + i: months first, to the month's last day at most, then days, then the rest."""
    at = ts.cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), i["months"] * sign)
    at = at + F.make_dt_interval(i["days"] * sign, F.lit(0), F.lit(0), F.lit(0))
    return F.timestamp_add("MICROSECOND", i["micros"] * sign, at)


def between(later: Column, earlier: Column) -> Column:
    """later - earlier: days and a time, no months."""
    micros = F.timestamp_diff("MICROSECOND", earlier.cast("timestamp_ntz"), later.cast("timestamp_ntz"))
    return _let(micros, lambda m: _made(F.lit(0), *_carried(m, DAY)))


def age(a: Column, b: Column) -> Column:
    """age(a, b): years, months and days as a calendar counts them from the earlier to the later one; negative throughout if a is the earlier one."""

    def parts(x: Column) -> tuple[Column, Column, Column]:
        midnight = F.date_trunc("day", x).cast("timestamp_ntz")
        return F.year(x) * 12 + F.month(x), F.day(x), F.timestamp_diff("MICROSECOND", midnight, x)

    def done(s: Column) -> Column:
        early, late = F.least(s["a"], s["b"]), F.greatest(s["a"], s["b"])
        (m0, d0, t0), (m1, d1, t1) = parts(early), parts(late)
        micros, days, months = t1 - t0, d1 - d0, m1 - m0
        days, micros = F.when(micros < 0, days - 1).otherwise(days), F.when(micros < 0, micros + DAY).otherwise(micros)
        months, days = F.when(days < 0, months - 1).otherwise(months), F.when(days < 0, days + F.day(F.last_day(early))).otherwise(days)
        sign = F.when(s["a"] < s["b"], -1).otherwise(1)
        return F.when(s["a"].isNotNull() & s["b"].isNotNull(), _made(sign * months, sign * days, sign * micros))

    return _let(F.struct(a.cast("timestamp_ntz").alias("a"), b.cast("timestamp_ntz").alias("b")), done)


def text(i: Column) -> Column:
    """PostgreSQL's text form: 1 year 2 mons -3 days +04:05:06.7."""

    def done(x: Column) -> Column:
        years, months = _carried(x["months"], 12)
        size = F.abs(x["micros"])
        seconds, fraction = F.call_function("div", size, F.lit(SECOND)), size % SECOND
        two = lambda n: F.lpad(n.cast("string"), 2, "0")
        hours = F.call_function("div", seconds, F.lit(3600))
        clock = F.concat(F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.call_function("div", seconds % 3600, F.lit(60))), F.lit(":"), two(seconds % 60))
        clock = F.concat(clock, F.when(fraction > 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(fraction.cast("string"), 6, "0"), "0+$", ""))).otherwise(""))
        before = F.when(x["days"] != 0, x["days"] < 0).when(months != 0, months < 0).when(years != 0, years < 0).otherwise(False)
        after_months = F.when(months != 0, months < 0).when(years != 0, years < 0).otherwise(False)
        part = lambda n, one, more, signed: F.when(n != 0, F.concat(F.when(signed & (n > 0), "+").otherwise(""), n.cast("bigint").cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(more)))
        sign = F.when(x["micros"] < 0, "-").when(before, "+").otherwise("")
        nothing = (x["months"] == 0) & (x["days"] == 0)
        time = F.when((x["micros"] != 0) | nothing, F.concat(sign, clock))
        no = F.lit(False)
        return F.concat_ws(" ", part(years, "year", "years", no), part(months, "mon", "mons", (years < 0) & (years != 0)), part(x["days"], "day", "days", after_months), time)

    return _let(i, lambda x: F.when(x.isNotNull(), done(x)))


# Date pictures

MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()
PICTURE = re.compile(r'"((?:[^"\\]|\\.)*)"|(FM)?(YYYY|IYYY|YY|MONTH|Month|month|MON|Mon|mon|MM|DDD|DD|DAY|Day|day|DY|Dy|dy|IDDD|ID|IW|WW|D|HH24|HH12|HH|MI|MS|US|SSSS|SS|AM|PM|am|pm|A\.M\.|P\.M\.|Q|J|CC|W)(TH|th)?|(.)', re.S)


def _ordinal(n: Column, upper: bool) -> Column:
    last, teen = n % 10, (n % 100 >= 11) & (n % 100 <= 13)
    end = F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.upper(end) if upper else end


def _named(names: list[str], n: Column, like: str, width: int, padded: bool) -> Column:
    shape = str.upper if like.isupper() else str.lower if like.islower() else str
    texts = [shape(x[:width] if width else x) for x in names]
    longest = max(map(len, names))
    return F.element_at(F.array(*(F.lit(x.ljust(longest) if padded and not width else x) for x in texts)), n)


def to_char(ts: Column, picture: str) -> Column:
    """to_char(timestamp, picture): fields of a date and time, FM without padding, TH and th for ordinals, quoted text as it is."""
    ts = ts.cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", F.date_trunc("second", ts).cast("timestamp_ntz"), ts)
    hour, noon = F.hour(ts), F.hour(ts) >= 12
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    numbers = {
        "YYYY": (F.year(ts), 4), "IYYY": (F.extract(F.lit("YEAROFWEEK"), ts), 4), "YY": (F.year(ts) % 100, 2), "MM": (F.month(ts), 2), "DDD": (F.dayofyear(ts), 3), "DD": (F.day(ts), 2), "D": (F.dayofweek(ts), 1),
        "ID": (F.weekday(ts) + 1, 1), "IDDD": ((F.weekofyear(ts) - 1) * 7 + F.weekday(ts) + 1, 3), "IW": (F.weekofyear(ts), 2), "WW": (F.floor((F.dayofyear(ts) - 1) / 7) + 1, 2), "W": (F.floor((F.day(ts) - 1) / 7) + 1, 1), "HH24": (hour, 2),
        "HH12": (twelve, 2), "HH": (twelve, 2), "MI": (F.minute(ts), 2), "SS": (F.second(ts), 2), "MS": (F.floor(micros / 1000), 3), "US": (micros, 6), "SSSS": (hour * 3600 + F.minute(ts) * 60 + F.second(ts), 1),
        "Q": (F.quarter(ts), 1), "J": (F.unix_date(ts.cast("date")) + 2440588, 1), "CC": (F.floor((F.year(ts) - 1) / 100) + 1, 2),
    }
    out: list[Column] = []
    for m in PICTURE.finditer(picture):
        quoted, fill, field, ordinal, other = m.groups()
        if quoted is not None or other is not None:
            out.append(F.lit(re.sub(r"\\(.)", r"\1", quoted) if quoted is not None else other))
        elif field in numbers:
            n, width = numbers[field]
            shown = n.cast("bigint").cast("string")
            out.append(shown if fill or width == 1 else F.when(F.length(shown) < width, F.lpad(shown, width, "0")).otherwise(shown))
            out += [_ordinal(n.cast("bigint"), ordinal == "TH")] if ordinal else []
        elif field[:2].upper() in ("AM", "PM", "A.", "P."):
            dots, small = "." in field, field.islower()
            halves = [("a.m." if dots else "am"), ("p.m." if dots else "pm")]
            halves = halves if small else [x.upper() for x in halves]
            out.append(F.when(noon, halves[1]).otherwise(halves[0]))
        elif field.upper().startswith("MON"):
            out.append(_named(MONTHS, F.month(ts), field, 3 if len(field) == 3 else 0, not fill))
        else:
            out.append(_named(DAYS, F.dayofweek(ts), field, 3 if len(field) == 2 else 0, not fill))
    return F.when(ts.isNotNull(), F.concat(*out) if out else F.lit(""))


def to_timestamp(text: Column, picture: str) -> Column:
    """to_timestamp(text, picture) for numbers of YYYY, MM, DD, DDD, HH24, HH12, MI, SS, MS, US, month names and AM or PM; spaces and signs between fields may differ. Missing fields are the first ones."""
    pattern, fields = "", []
    for m in PICTURE.finditer(picture):
        quoted, _, field, _, other = m.groups()
        if field:
            name = field.upper()
            fields.append(name)
            digits = {"YYYY": r"(\d{1,4})", "DDD": r"(\d{1,3})", "MS": r"(\d{1,3})", "US": r"(\d{1,6})", "MONTH": f"({'|'.join(MONTHS)})", "MON": f"({'|'.join(x[:3] for x in MONTHS)})"}
            pattern += r"\s*" + (r"(AM|PM|A\.M\.|P\.M\.)" if name[0] in "AP" else digits.get(name, r"(\d{1,2})"))
        else:
            pattern += re.escape(quoted) if quoted is not None else r"[^\w]*" if not other.isalnum() else re.escape(other)
    pattern = rf"(?i)^\s*{pattern}"
    group = {f: F.regexp_extract(text, pattern, k + 1) for k, f in enumerate(fields)}
    number = lambda f, default: F.when(group[f] != "", group[f].cast("int")) if f in group else F.lit(default)
    fraction = lambda f, width: F.rpad(group[f], width, "0").cast("int")
    name = group.get("MONTH", group.get("MON"))
    month = F.array_position(F.array(*(F.lit(x[:3].upper()) for x in MONTHS)), F.upper(F.left(name, F.lit(3)))).cast("int") if name is not None else number("MM", 1)
    half = next((group[f] for f in fields if f[0] in "AP"), None)
    hour = number("HH24", 0) if "HH24" in group else number("HH12" if "HH12" in group else "HH", 12 if half is not None else 0)
    hour = hour % 12 + F.when(F.upper(half).startswith("P"), 12).otherwise(0) if half is not None else hour
    micros = fraction("US", 6) if "US" in group else fraction("MS", 3) * 1000 if "MS" in group else F.lit(0)
    day = F.date_add(F.make_date(number("YYYY", 1), F.lit(1), F.lit(1)), number("DDD", 1) - 1) if "DDD" in group else F.make_date(number("YYYY", 1), month, number("DD", 1))
    at = F.timestamp_add("SECOND", hour * 3600 + number("MI", 0) * 60 + number("SS", 0), day.cast("timestamp_ntz"))
    wrong = F.raise_error(F.concat(F.lit("no date by this picture: "), text))
    return F.when(text.isNotNull(), F.when(text.rlike(pattern), F.timestamp_add("MICROSECOND", micros, at)).otherwise(wrong))


def to_date(text: Column, picture: str) -> Column:
    return to_timestamp(text, picture).cast("date")
