"""Rows of state probabilities held as arrays: one-row functions and steps between rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def normalise(a: Column) -> Column:
    """On the simplex; null if nothing is positive."""
    positive = F.transform(a, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    return F.when(total(positive) > 0, F.transform(positive, lambda x: x / total(positive)))


def normalise_or_even(a: Column | str) -> Column:
    """On the simplex; even if nothing is positive, null only for a null or empty array. Values that are not finite count as 0."""
    a = F.col(a) if isinstance(a, str) else a
    positive = F.transform(a, lambda x: F.when(F.abs(x) < float("inf"), F.greatest(x.cast("double"), F.lit(0.0))).otherwise(0.0))
    # the total is taken once, as the one element of an array
    on = F.transform(F.array(total(positive)), lambda t: F.transform(positive, lambda x: F.when(t > 0, x / t).otherwise(F.lit(1.0) / F.size(positive))))
    return F.when(F.size(a) > 0, F.get(on, F.lit(0)))


def entropy(p: Column) -> Column:
    """In nats."""
    return total(F.transform(p, lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)))


def margin(p: Column) -> Column:
    """The largest less the second largest."""
    top = F.sort_array(p, asc=False)
    return F.get(top, F.lit(0)) - F.coalesce(F.get(top, F.lit(1)), F.lit(0.0))


def argmax(p: Column) -> Column:
    """Place of the first largest, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def expected(p: Column) -> Column:
    """Mean place, from 0."""
    return total(F.transform(p, lambda x, i: x * i))


def mass_below(p: Column, k: int) -> Column:
    return total(F.slice(p, 1, k))


def kl(p: Column, q: Column, eps: float = 1e-12) -> Column:
    """Of p from q, in nats; chances below eps count as eps."""
    floor = lambda x: F.greatest(x, F.lit(eps))
    return total(F.zip_with(p, q, lambda a, b: floor(a) * F.log(floor(a) / floor(b))))


def js(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in nats."""
    mid = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    return (kl(p, mid) + kl(q, mid)) / 2


def gated_label(p: Column, least: float, flat: int = -1) -> Column:
    """The likeliest state where its chance is high enough, else flat."""
    return F.when(F.array_max(p) >= least, argmax(p)).otherwise(flat)
