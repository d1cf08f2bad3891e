"""Special functions as column expressions, for the p-values of fits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the continued fraction. With a half as second argument it settles within 60, whatever the first one is.
TERMS = 100
#: Steps by which small arguments are moved up before Stirling's series is used.
SHIFT = 10


def _stirling_rest(x: Column) -> Column:
    """ln gamma(x) less (x - 1/2) ln x - x + ln(2 pi) / 2, for x of SHIFT and more."""
    # fixed values: B(2k) / (2k (2k - 1)), k = 1, 2, ..
    series = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
    out = F.lit(0.0)
    for c in reversed(series):
        out = out / (x * x) + F.lit(c)
    return out / x


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0."""
    up = x + float(SHIFT)
    product = x
    for k in range(1, SHIFT):
        product = product * (x + float(k))
    return (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + _stirling_rest(up) - F.ln(product)


def log_gamma_step(a: Column, b: Column) -> Column:
    """ln gamma(a + b) - ln gamma(a), which for large a has all its digits."""
    up = a + float(SHIFT)
    out = (up - 0.5) * F.log1p(b / up) + b * F.ln(up + b) - b + _stirling_rest(up + b) - _stirling_rest(up)
    for k in range(SHIFT):
        out = out - F.log1p(b / (a + float(k)))
    return out


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from the front (Lentz's way), a fixed number of terms."""
    away = lambda z: F.when(F.abs(z) < 1e-300, F.lit(1e-300)).otherwise(z)
    first = F.lit(1.0) / away(1.0 - (a + b) * x / (a + 1.0))
    # what a term needs is carried along, so that it is computed once
    start = F.struct(a.alias("a"), b.alias("b"), x.alias("x"), F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def half(s, m: Column, even: bool):
        a_, b_, x_ = s["a"], s["b"], s["x"]
        n = m * 2.0
        up = m * (b_ - m) * x_ / ((a_ + n - 1.0) * (a_ + n)) if even else -(a_ + m) * (a_ + b_ + m) * x_ / ((a_ + n) * (a_ + n + 1.0))
        d, c = 1.0 / away(1.0 + up * s["d"]), away(1.0 + up / s["c"])
        return F.struct(a_.alias("a"), b_.alias("b"), x_.alias("x"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    # even and odd terms in turn, so that a term's state is there when the next one reads it
    steps = F.sequence(F.lit(2), F.lit(2 * TERMS + 1))
    turn = lambda s, k: F.when(k % 2 == 0, half(s, F.floor(k / 2).cast("double"), True)).otherwise(half(s, F.floor(k / 2).cast("double"), False))
    return F.aggregate(steps, start, turn, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column, y: Column) -> Column:
    """The regularised incomplete beta function of x; y = 1 - x, given apart so that neither loses digits. a, b > 0. Null in, null out."""
    log = lambda p, q: F.when(q < 0.5, F.log1p(-q)).otherwise(F.ln(p))
    front = F.exp(a * log(x, y) + b * log(y, x) + log_gamma_step(a, b) - log_gamma(b))
    inside = F.when(x < (a + 1.0) / (a + b + 2.0), front * _fraction(a, b, x) / a).otherwise(1.0 - front * _fraction(b, a, y) / b)
    return F.when(x <= 0.0, 0.0).when(y <= 0.0, 1.0).when(x.isNotNull() & y.isNotNull() & a.isNotNull() & b.isNotNull(), inside)


def t_two_sided(t: Column, dof: Column) -> Column:
    """The chance of a Student t at least as far from zero; null without a degree of freedom."""
    v, t2 = dof.cast("double"), t * t
    return F.when(v > 0, incomplete_beta(v / 2.0, F.lit(0.5), v / (v + t2), t2 / (v + t2)))


def f_upper(f: Column, dof1: Column, dof2: Column) -> Column:
    """The chance of an F at least as large; null without degrees of freedom. The second argument of the beta function is then dof1 / 2: few regressors."""
    a, b = dof2.cast("double"), dof1.cast("double")
    return F.when((a > 0) & (b > 0), incomplete_beta(a / 2.0, b / 2.0, a / (a + b * f), b * f / (a + b * f)))
