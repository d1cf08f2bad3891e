"""Column expressions for indicators: rates, ratios, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing_to_null(c: Column) -> Column:
    """NaN counts as missing."""
    return F.nanvl(c, F.lit(None).cast("double"))


def per_100k(n: Column, population: Column, floor: float = 1.0) -> Column:
    return F.round(n / F.greatest(population, F.lit(floor)), 3)


def rate_or_null(n: Column, population: Column, scale: float = 100_000.0) -> Column:
    """Null where the population is missing or not positive."""
    return F.when(population > 0, n * scale / F.nullif(population, F.lit(0.0)))


def percent(a: Column, b: Column, digits: int = 2) -> Column:
    return F.round(100.0 * a / F.nullif(b, F.lit(0)), digits)


def mean_of_two(a: Column, b: Column, digits: int = 2) -> Column:
    """The mean of both, or the first where the second is missing."""
    return F.when(b.isNull(), a).otherwise(F.round((a + b) / 2, digits))


def truncated_count(population: Column, per: float, least: int) -> Column:
    return F.greatest((population * per).cast("int"), F.lit(least))


def differs(a: Column, b: Column, absolute: float = 1.0, relative: float = 0.001) -> Column:
    return F.abs(a - b) > F.greatest(F.lit(absolute), relative * a)


def intensity(n: Column, density: Column) -> Column:
    return F.log1p(n) * (1.0 + F.log1p(density))


def urban_share(name: Column, population: Column, cities: list[str] = ()) -> Column:
    """A stated guess, its numbers fixed values: 85 where the name says urban or is a listed city, 12 where it says rural, else 25 and 0.8 for each unit of population, 18 at least."""
    n = F.lower(name)
    return F.round(F.when(n.contains("urban") | n.isin([c.lower() for c in cities]), 85.0).when(n.contains("rural"), 12.0).otherwise(F.greatest(25.0 + population * 0.8, F.lit(18.0))), 2)


def round_half_even(c: Column, digits: int) -> Column:
    """Rounding of the exact binary value, ties to even, for results that must agree with it to the last digit; Spark's own rounds the printed value half up.

    The product with the power of ten is taken together with what rounding took from it (both factors are split in halves, whose products are exact); that decides ties. 0 to 22 digits.
    """
    if not 0 <= digits <= 22:
        raise ValueError("0 to 22 digits")
    split = float((1 << 27) + 1)  # halves of a double's digits
    ten = float(10**digits)
    ten_high = split * ten - (split * ten - ten)
    ten_low = ten - ten_high

    def product(v: Column) -> Column:
        y, big = v * ten, v * split
        return F.struct(v.alias("v"), y.alias("y"), (big - (big - v)).alias("h"))

    def rest(s: Column) -> Column:
        low = s["v"] - s["h"]
        lost = ((s["h"] * ten_high - s["y"]) + s["h"] * ten_low + low * ten_high) + low * ten_low
        whole = F.rint(s["y"])
        return F.struct(whole.alias("r"), (s["y"] - whole).alias("a"), lost.alias("e"))

    def decided(s: Column) -> Column:
        # s.a is exact, and so is its distance to a half; what was lost is smaller than a unit of s.a's last place
        over, under = (s["a"] - 0.5) + s["e"], (s["a"] + 0.5) + s["e"]
        odd = s["r"] % 2.0 != 0.0
        up, down = (over > 0.0) | ((over == 0.0) & odd), (under < 0.0) | ((under == 0.0) & odd)
        return (s["r"] + F.when(up, 1.0).when(down, -1.0).otherwise(0.0)) / ten

    v = c.cast("double")
    exact = F.transform(F.transform(F.transform(F.array(v), product), rest), decided)[0]
    # beyond 2^53 units the digits end before the place that is rounded to, which also holds for what is not finite
    return F.when(F.abs(v * ten) < float(1 << 53), exact).otherwise(v)


def rate_with_loss(n: Column, population: Column, scale: float = 100_000.0) -> Column:
    """struct(rate, lost): null where the population is missing or not positive, and whether a count was lost by that."""
    rate = rate_or_null(n, population, scale)
    return F.struct(rate.alias("rate"), (n.isNotNull() & rate.isNull()).alias("lost"))


def rounded(c: Column, digits: int | None) -> Column:
    """c, or c rounded by ``round_half_even`` where digits are given."""
    return c if digits is None else round_half_even(c, digits)
