"""Distribution functions of columns, by series and continued fractions in the JVM; parameters are numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a series, and steps of a continued fraction: enough for parameters up to some hundreds.
TERMS = 80
_TINY = 1e-300


def _held(x: Column) -> Column:
    """x, kept from being 0."""
    return F.when(F.abs(x) < _TINY, _TINY).otherwise(x)


def gamma_cdf(a: float, x: Column) -> Column:
    """Regularised lower incomplete gamma function; 0 for x <= 0, null for null."""
    z = F.greatest(x, F.lit(1e-300))
    head = F.exp(a * F.log(z) - z - math.lgamma(a))
    steps = F.sequence(F.lit(1), F.lit(TERMS))
    first = F.struct(F.lit(1 / a).alias("term"), F.lit(1 / a).alias("sum"))
    add = lambda s, n: F.struct((s["term"] * z / (a + n)).alias("term"), (s["sum"] + s["term"] * z / (a + n)).alias("sum"))
    series = F.aggregate(steps, first, add, lambda s: s["sum"])
    b = z + 1 - a
    start = F.struct(b.alias("b"), F.lit(1e300).alias("c"), (1 / _held(b)).alias("d"), (1 / _held(b)).alias("f"))

    def step(s, n):
        an = -n * (n - a)
        wide = s["b"] + 2
        d = 1 / _held(an * s["d"] + wide)
        c = _held(wide + an / s["c"])
        return F.struct(wide.alias("b"), c.alias("c"), d.alias("d"), (s["f"] * d * c).alias("f"))

    fraction = F.aggregate(steps, start, step, lambda s: s["f"])
    return F.when(x <= 0, 0.0).when(x < a + 1, series * head).when(x >= a + 1, 1 - fraction * head)


def chi2_cdf(freedom: float, x: Column) -> Column:
    return gamma_cdf(freedom / 2, x / 2)


def _beta_fraction(a: float, b: float, x: Column) -> Column:
    head = F.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * F.log(x) + b * F.log1p(-x)) / a
    first = 1 / _held(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("f"))

    def half(s, factor):
        d = 1 / _held(1 + factor * s["d"])
        c = _held(1 + factor / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["f"] * c * d).alias("f"))

    def step(s, m):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # each half is bound once, as the one element of an array
        once = F.transform(F.array(half(s, even)), lambda t: half(t, odd))
        return F.get(once, F.lit(0))

    return head * F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["f"])


def beta_cdf(a: float, b: float, x: Column) -> Column:
    """Regularised incomplete beta function; 0 below 0 and 1 above 1."""
    inside = F.least(F.greatest(x, F.lit(1e-300)), F.lit(1 - 1e-16))
    turn = (a + 1) / (a + b + 2)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x <= turn, _beta_fraction(a, b, inside)).otherwise(1 - _beta_fraction(b, a, 1 - inside))


def f_cdf(d1: float, d2: float, x: Column) -> Column:
    return F.when(x <= 0, 0.0).otherwise(beta_cdf(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)))


def t_cdf(freedom: float, x: Column) -> Column:
    tail = beta_cdf(freedom / 2, 0.5, freedom / (freedom + x * x)) / 2
    return F.when(x > 0, 1 - tail).otherwise(tail)
