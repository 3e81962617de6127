"""PostgreSQL's ranges and multiranges as Column expressions.

A range is a struct (lower, upper, lower_inc, upper_inc, empty): a null bound is unbounded and never inclusive. Ranges of integers, longs and dates are
canonical, [lower, upper), as their values are discrete. All empty ranges are the same value. A multirange is an array of ranges, none
empty, in ascending order, with a gap between any two. A null range gives null everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("lower", "upper", "lower_inc", "upper_inc", "empty")


def _bound(f):
    """Evaluates f on a value that stands for a long expression, so that the plan holds it once."""
    return lambda x: F.element_at(F.transform(F.array(x), f), 1)


def _bound2(f):
    return lambda a, b: F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda s: f(s["a"], s["b"])), 1)


def _made(lower: Column, upper: Column, lower_inc: Column, upper_inc: Column) -> Column:
    """The range of bounds that are canonical, empty if nothing is between them."""
    empty = F.coalesce((lower > upper) | ((lower == upper) & ~(lower_inc & upper_inc)), F.lit(False))
    none = F.lit(None)
    return F.struct(
        F.when(~empty, lower).otherwise(none).alias("lower"),
        F.when(~empty, upper).otherwise(none).alias("upper"),
        (~empty & lower.isNotNull() & lower_inc).alias("lower_inc"),
        (~empty & upper.isNotNull() & upper_inc).alias("upper_inc"),
        empty.alias("empty"),
    )


def make_range(lower: Column, upper: Column, bounds: str = "[)", discrete: bool = False) -> Column:
    """int4range(lower, upper, bounds) and the like. `discrete` for integers, longs and dates. A lower bound above the upper one is an error."""
    low_inc, high_inc, wrong = bounds[0] == "[", bounds[1] == "]", lower > upper
    if discrete:
        lower, upper = (lower if low_inc else lower + F.lit(1)), (upper + F.lit(1) if high_inc else upper)
        low_inc, high_inc = True, False
    made = _made(lower, upper, F.lit(low_inc), F.lit(high_inc))
    return F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound"))).otherwise(made)


def _nothing(x: Column) -> Column:
    """The empty range of values of x's type."""
    return F.struct(F.nullif(x, x).alias("lower"), F.nullif(x, x).alias("upper"), F.lit(False).alias("lower_inc"), F.lit(False).alias("upper_inc"), F.lit(True).alias("empty"))


def empty_like(r: Column) -> Column:
    return _nothing(r["lower"])


def lower_inf(r: Column) -> Column:
    return ~r["empty"] & r["lower"].isNull()


def upper_inf(r: Column) -> Column:
    return ~r["empty"] & r["upper"].isNull()


def _lower_after(a: Column, b: Column) -> Column:
    """a's lower bound is above b's."""
    return F.coalesce((a["lower"] > b["lower"]) | ((a["lower"] == b["lower"]) & b["lower_inc"] & ~a["lower_inc"]), a["lower"].isNotNull())


def _upper_before(a: Column, b: Column) -> Column:
    """a's upper bound is below b's."""
    return F.coalesce((a["upper"] < b["upper"]) | ((a["upper"] == b["upper"]) & b["upper_inc"] & ~a["upper_inc"]), a["upper"].isNotNull())


def _ends_before(a: Column, b: Column) -> Column:
    """a ends before b begins."""
    return F.coalesce((a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"])), F.lit(False))


def _meets(a: Column, b: Column) -> Column:
    """Nothing is between a's end and b's begin, and nothing in both."""
    return F.coalesce((a["upper"] == b["lower"]) & (a["upper_inc"] != b["lower_inc"]), F.lit(False))


def _known(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def contains_value(r: Column, x: Column) -> Column:
    """r @> x."""
    above = F.coalesce((x > r["lower"]) | ((x == r["lower"]) & r["lower_inc"]), F.lit(True))
    below = F.coalesce((x < r["upper"]) | ((x == r["upper"]) & r["upper_inc"]), F.lit(True))
    return _known(r, x, ~r["empty"] & above & below)


def contains(a: Column, b: Column) -> Column:
    """a @> b; an empty range is in every range. b <@ a is the same."""
    return _known(a, b, b["empty"] | (~a["empty"] & ~_lower_after(a, b) & ~_upper_before(a, b)))


def overlaps(a: Column, b: Column) -> Column:
    """a && b."""
    return _known(a, b, ~a["empty"] & ~b["empty"] & ~_ends_before(a, b) & ~_ends_before(b, a))


def left_of(a: Column, b: Column) -> Column:
    """a << b; b >> a is the same."""
    return _known(a, b, ~a["empty"] & ~b["empty"] & _ends_before(a, b))


def not_right_of(a: Column, b: Column) -> Column:
    """a &< b: a does not end after b."""
    return _known(a, b, ~a["empty"] & ~b["empty"] & ~_upper_before(b, a))


def not_left_of(a: Column, b: Column) -> Column:
    """a &> b: a does not begin before b."""
    return _known(a, b, ~a["empty"] & ~b["empty"] & ~_lower_after(b, a))


def adjacent(a: Column, b: Column) -> Column:
    """a -|- b."""
    return _known(a, b, ~a["empty"] & ~b["empty"] & (_meets(a, b) | _meets(b, a)))


def _hull(a: Column, b: Column) -> Column:
    low, high = _lower_after(a, b), _upper_before(a, b)
    pick = lambda condition, x, y, f: F.when(condition, y[f]).otherwise(x[f]).alias(f)
    return F.struct(pick(low, a, b, "lower"), pick(high, a, b, "upper"), pick(low, a, b, "lower_inc"), pick(high, a, b, "upper_inc"), F.lit(False).alias("empty"))


def merged(a: Column, b: Column) -> Column:
    """range_merge(a, b): the smallest range that holds both."""
    return _bound2(lambda a, b: _known(a, b, F.when(a["empty"], b).when(b["empty"], a).otherwise(_hull(a, b))))(a, b)


def union(a: Column, b: Column) -> Column:
    """a + b; an error if there is a gap."""
    apart = lambda a, b: ~a["empty"] & ~b["empty"] & ~overlaps(a, b) & ~adjacent(a, b)
    return _bound2(lambda a, b: _known(a, b, F.when(apart(a, b), F.raise_error(F.lit("result of range union would not be contiguous"))).when(a["empty"], b).when(b["empty"], a).otherwise(_hull(a, b))))(a, b)


def _cut(a: Column, b: Column) -> Column:
    """What is in both of two ranges that are not empty; empty where they do not overlap."""
    low, high = _lower_after(a, b), _upper_before(a, b)
    pick = lambda condition, f: F.when(condition, a[f]).otherwise(b[f])
    return _made(pick(low, "lower"), pick(high, "upper"), pick(low, "lower_inc"), pick(high, "upper_inc"))


def intersection(a: Column, b: Column) -> Column:
    """a * b."""
    return _bound2(lambda a, b: _known(a, b, F.when(a["empty"] | b["empty"], empty_like(a)).otherwise(_cut(a, b))))(a, b)


def pieces(a: Column, b: Column) -> Column:
    """What is in a and not in b, as a multirange of two ranges at most."""
    before = lambda a, b: F.struct(a["lower"].alias("lower"), b["lower"].alias("upper"), a["lower_inc"].alias("lower_inc"), (b["lower"].isNotNull() & ~b["lower_inc"]).alias("upper_inc"), F.lit(False).alias("empty"))
    after = lambda a, b: F.struct(b["upper"].alias("lower"), a["upper"].alias("upper"), (b["upper"].isNotNull() & ~b["upper_inc"]).alias("lower_inc"), a["upper_inc"].alias("upper_inc"), F.lit(False).alias("empty"))
    none = lambda a: F.filter(F.array(a), lambda x: F.lit(False))
    both = lambda a, b: F.array_compact(F.array(F.when(_lower_after(b, a), before(a, b)), F.when(_upper_before(b, a), after(a, b))))
    return _bound2(lambda a, b: _known(a, b, F.when(a["empty"], none(a)).when(b["empty"] | ~overlaps(a, b), F.array(a)).otherwise(both(a, b))))(a, b)


def difference(a: Column, b: Column) -> Column:
    """a - b; an error if two ranges are left."""
    split = F.raise_error(F.lit("result of range difference would not be contiguous"))
    return _bound(lambda s: F.when(F.size(s["p"]) > 1, split).when(F.size(s["p"]) == 1, F.element_at(s["p"], 1)).when(s["p"].isNotNull(), empty_like(s["a"])))(F.struct(pieces(a, b).alias("p"), a.alias("a")))


def text(r: Column) -> Column:
    """PostgreSQL's text form for numbers and dates: [1,5), (,3], empty."""
    side = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    shown = F.concat(F.when(r["lower_inc"], "[").otherwise("("), side(r["lower"]), F.lit(","), side(r["upper"]), F.when(r["upper_inc"], "]").otherwise(")"))
    return F.when(r["empty"], "empty").otherwise(shown)


def _order(a: Column, b: Column) -> Column:
    """By lower bound, then upper bound."""
    return F.when(_lower_after(b, a), -1).when(_lower_after(a, b), 1).when(_upper_before(a, b), -1).when(_upper_before(b, a), 1).otherwise(0)


def multirange(ranges: Column) -> Column:
    """The multirange of an array of ranges in any order: those that overlap or meet are joined, empty and null ones left out."""
    real = F.array_sort(F.filter(ranges, lambda r: r.isNotNull() & ~r["empty"]), _order)

    def step(held: Column, r: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        joined = F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(_hull(last, r)))
        return F.when(F.size(held) == 0, F.array(r)).when(overlaps(last, r) | adjacent(last, r), joined).otherwise(F.concat(held, F.array(r)))

    return F.reduce(real, F.filter(real, lambda r: F.lit(False)), step)


def multirange_text(m: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(m, text), ","), F.lit("}"))


def multirange_contains_value(m: Column, x: Column) -> Column:
    return _known(m, x, F.exists(m, lambda r: contains_value(r, x)))


def multirange_overlaps(m: Column, n: Column) -> Column:
    """m && n, for arrays of any ranges."""
    return _known(m, n, F.exists(m, lambda r: F.exists(n, lambda s: overlaps(r, s))))


def multirange_contains(m: Column, n: Column) -> Column:
    """m @> n for multiranges: as m has a gap between any two ranges, each range of n is in one of m's."""
    return _known(m, n, F.forall(n, lambda s: F.exists(m, lambda r: contains(r, s))))


def multirange_union(m: Column, n: Column) -> Column:
    """m + n."""
    return multirange(F.concat(m, n))


def multirange_intersection(m: Column, n: Column) -> Column:
    """m * n."""
    return multirange(F.flatten(F.transform(m, lambda r: F.transform(n, lambda s: intersection(r, s)))))


def multirange_difference(m: Column, n: Column) -> Column:
    """m - n."""
    return F.when(n.isNotNull(), F.reduce(n, m, lambda held, s: F.flatten(F.transform(held, lambda r: pieces(r, s)))))


def range_intersect_agg(r: Column) -> Column:
    """What all ranges of a group have in common, from greatest lower and least upper bounds; null without ranges."""
    low = F.max_by(F.struct(r["lower"].alias("x"), r["lower_inc"].alias("inc")), F.struct(r["lower"].alias("x"), (~r["lower_inc"]).alias("out")))
    high = F.min_by(F.struct(r["upper"].alias("x"), r["upper_inc"].alias("inc")), F.when(r["upper"].isNotNull(), F.struct(r["upper"].alias("x"), r["upper_inc"].alias("inc"))))
    return _bound(
        lambda s: F.when(
            s["n"] > 0,
            F.when(s["none"], _nothing(s["low"]["x"])).otherwise(_made(s["low"]["x"], s["high"]["x"], F.coalesce(s["low"]["inc"], F.lit(False)), F.coalesce(s["high"]["inc"], F.lit(False)))),
        )
    )(F.struct(low.alias("low"), high.alias("high"), F.count(r).alias("n"), F.coalesce(F.bool_or(r["empty"]), F.lit(False)).alias("none")))
