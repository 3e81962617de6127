"""PostgreSQL's number pictures: to_char and to_number, compiled to Column expressions when a plan is made."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|FM|MI|PL|SG|PR|TH|th|EEEE|RN|rn|[09.,DGSLV]|.', re.S)
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


@dataclass(frozen=True)
class Picture:
    """What a picture says: its parts in order, digits before and after the point, and how signs are shown."""

    parts: tuple[str, ...]
    whole: int
    fraction: int
    first_zero: int  # digits from the first 0 on, before the point
    fill: bool  # FM

    @property
    def signed(self) -> str | None:
        return next((p for p in self.parts if p in ("MI", "PL", "SG", "PR", "S")), None)


def picture(text: str) -> Picture:
    """Reads a picture. Digits are 9 and 0; . or D is the point, , or G a group separator, V shifts by the digits after it."""
    parts = TOKEN.findall(text)
    fill = "FM" in parts
    parts = [p for p in parts if p != "FM"]
    point = next((k for k, p in enumerate(parts) if p in (".", "D", "V")), len(parts))
    digits = [p for p in parts[:point] if p in "09"]
    zero = next((len(digits) - k for k, p in enumerate(digits) if p == "0"), 0)
    if sum(p in (".", "D") for p in parts) > 1 or sum(p in ("S", "SG", "MI", "PL", "PR") for p in parts) > 1:
        raise ValueError(f"bad picture {text!r}")
    return Picture(tuple(parts), len(digits), sum(p in "09" for p in parts[point:]), zero, fill)


def _let(x: Column, f) -> Column:
    """f(x), with the expression x once in the plan."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _text(part: str) -> str:
    return re.sub(r"\\(.)", r"\1", part[1:-1]) if part[0] == '"' else part


def to_roman(n: Column, small: bool = False) -> Column:
    """Roman numerals of 1 to 3999, else 15 signs."""
    rest, out = n, []
    for value, letters in ROMAN:
        times = F.floor(rest / value)
        out.append(F.repeat(F.lit(letters), times.cast("int")))
        rest = rest % value
    shown = F.concat(*out)
    return F.when((n < 1) | (n > 3999), "#" * 15).otherwise(F.lower(shown) if small else shown)


def to_char(x: Column, text: str) -> Column:
    """to_char(number, text): rounded half away from zero to the digits after the point; # where a number has no room.

    9 is a digit, or a space before the number; 0 a digit in any case; . D , G as in the C locale, where G is a comma and L nothing but a space; S, SG, MI, PL and PR
    are signs, FM leaves spaces and closing zeros out, TH and th are ordinals, V shifts, RN and rn are Roman. EEEE is a single digit, its fraction and an exponent.
    A double that is rounded to nothing keeps its minus sign, a decimal or whole number does not, as in PostgreSQL.
    """
    p = picture(text)
    if any(q in ("RN", "rn") for q in p.parts):
        shown = to_roman(F.round(x, 0).cast("bigint"), "rn" in p.parts)
        return F.when(x.isNotNull(), shown if p.fill else F.lpad(shown, 15, " "))
    if "EEEE" in p.parts:
        return _scientific(x, p)
    shift = p.fraction if "V" in p.parts else 0
    decimals = 0 if shift else p.fraction
    places = p.whole + shift
    least = max(p.first_zero + shift if p.first_zero else 0, shift)

    def split(size: Column) -> Column:
        """Digits before the point and after it."""
        whole = F.floor(size).cast("decimal(38,0)")
        tail = F.lpad(F.round((size - whole) * 10**decimals, 0).cast("decimal(38,0)").cast("string"), decimals, "0") if decimals else F.lit("")
        return F.struct(F.when(whole == 0, F.lit("" if least or decimals or not places else "0")).otherwise(whole.cast("string")).alias("digits"), tail.alias("tail"), (whole % 100).cast("int").alias("last"))

    def filled(s: Column) -> Column:
        shown = F.when(F.length(s["digits"]) < least, F.lpad(s["digits"], least, "0")).otherwise(s["digits"])
        return F.struct(shown.alias("shown"), F.length(shown).alias("n"), s["tail"].alias("tail"), s["last"].alias("last"))

    def done(v: Column) -> Column:
        return _let(_let(_let(F.abs(v["value"]), split), filled), lambda s: _let(_body(s, v["negative"], p, places), lambda body: _with_sign(body, v["negative"], p)))

    value = F.round(x.cast("decimal(38,12)") * (10**shift), decimals)
    negative = F.when(F.typeof(x).isin("double", "float"), F.startswith(x.cast("string"), F.lit("-"))).otherwise(value < 0)
    return F.when(x.isNotNull(), _let(F.struct(value.alias("value"), negative.alias("negative")), done))


def _body(s: Column, negative: Column, p: Picture, places: int) -> Column:
    """Every place of the picture, from the left: a digit, nothing yet, or a separator that stands only after a digit; # where there is no room."""
    shown, n, tail = s["shown"], s["n"], s["tail"]
    out, place, after, seen_point = [], 0, 0, False
    for part in p.parts:
        if part in ("9", "0") and not seen_point:
            left = places - place
            place += 1
            digit = F.when(n >= left, F.substring(shown, n - left + 1, 1))
            out.append(digit.otherwise("" if p.fill else " "))
        elif part in ("9", "0"):
            after += 1
            digit = F.substring(tail, after, 1)
            if p.fill and part == "9" and "0" not in p.parts[p.parts.index("." if "." in p.parts else "D") + 1 :][after:]:
                digit = F.when(F.regexp_replace(F.substring(tail, after, 38), "0+$", "") == "", "").otherwise(digit)
            out.append(digit)
        elif part in (",", "G"):
            out.append(F.when(n > places - place, ",").otherwise("" if p.fill else " ") if not seen_point else F.lit(","))
        elif part in (".", "D"):
            seen_point = True
            out.append(F.lit("."))
        elif part == "V":
            continue
        elif part == "L":
            out.append(F.lit("" if p.fill else " "))
        elif part in ("TH", "th"):
            last, teen = s["last"] % 10, (s["last"] >= 11) & (s["last"] <= 13)
            end = F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
            out.append(F.when(negative, "").otherwise(F.upper(end) if part == "TH" else end))
        elif part == "MI":
            out.append(F.when(negative, "-").otherwise("" if p.fill else " "))
        elif part == "PL":
            out.append(F.when(negative, "" if p.fill else " ").otherwise("+"))
        elif part == "SG":
            out.append(F.when(negative, "-").otherwise("+"))
        elif part == "S":
            out.append(F.lit("\x00"))
        elif part != "PR":
            out.append(F.lit(_text(part)))
    body = F.concat(*out) if out else F.lit("")
    full = F.lit("".join("#" if q in ("9", "0") else "." if q in (".", "D") else "," if q in (",", "G") else "" for q in p.parts))
    return F.when(n <= places, body).otherwise(full)


def _with_sign(body: Column, negative: Column, p: Picture) -> Column:
    """The sign where the picture has it, or before the first digit."""
    if p.signed == "S":
        ahead = p.parts.index("S") < next((k for k, q in enumerate(p.parts) if q in ("9", "0", ".", "D")), len(p.parts))
        sign = F.when(negative, "-").otherwise("+")
        plain = F.replace(body, F.lit("\x00"), F.lit(""))
        return F.concat(F.regexp_extract(plain, r"^( *)", 1), sign, F.regexp_extract(plain, r"^ *(.*)$", 1)) if ahead else F.concat(plain, sign)
    if p.signed == "PR":
        spaces, rest = F.regexp_extract(body, r"^( *)", 1), F.regexp_extract(body, r"^ *(.*)$", 1)
        return F.when(negative, F.concat(spaces, F.lit("<"), rest, F.lit(">"))).otherwise(body if p.fill else F.concat(F.lit(" "), body, F.lit(" ")))
    if p.signed:
        return body
    spaces, rest = F.regexp_extract(body, r"^( *)", 1), F.regexp_extract(body, r"^ *(.*)$", 1)
    return F.when(negative, F.concat(spaces, F.lit("-"), rest)).otherwise(body if p.fill else F.concat(F.lit(" "), body))


def _scientific(x: Column, p: Picture) -> Column:
    shown = F.format_string(f"%.{p.fraction}e", x.cast("double"))
    return F.when(x.isNotNull(), F.when((x >= 0) & F.lit(not p.fill), F.concat(F.lit(" "), shown)).otherwise(shown))


def to_number(text: Column, shape: str) -> Column:
    """to_number(text, shape) as a decimal: digits, one point, and a sign anywhere that the shape allows; < > and a closing minus are negative, V shifts back."""
    p = picture(shape)
    plain = F.regexp_replace(text, r"[^0-9.<>+-]", "")
    negative = plain.rlike(r"[-<]")
    digits = F.regexp_replace(plain, r"[^0-9.]", "")
    wrong = F.raise_error(F.concat(F.lit("no number by this picture: "), text))
    scale = p.fraction if "V" not in p.parts else 0
    kind = f"decimal({min(38, max(p.whole, 1) + scale + (p.fraction if 'V' in p.parts else 0))},{scale})"
    number = F.when(digits.rlike(r"^(\d+(\.\d*)?|\.\d+)$"), digits.cast("decimal(38,12)")).otherwise(wrong)
    number = F.when(negative, -number).otherwise(number)
    number = number / 10**p.fraction if "V" in p.parts else number.cast(kind)
    return F.when(text.isNotNull(), number)
