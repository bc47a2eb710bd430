"""Fitted transformations: parameters from one aggregate, the transformation as an expression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.frames import running


def standardise(df: DataFrame, x: str, out: str) -> DataFrame:
    """(x - mean) / sd over the whole column; null where the column does not vary."""
    fitted = df.agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))  # one row
    return df.crossJoin(F.broadcast(fitted)).withColumn(out, F.when(F.col("_s") > 1e-12, F.try_divide(F.col(x) - F.col("_m"), F.col("_s")))).drop("_m", "_s")


def box_cox(x: Column, power: float) -> Column:
    """For positive x; null otherwise."""
    return F.when(x > 0, F.log(x) if abs(power) < 1e-12 else (F.pow(x, F.lit(power)) - 1) / power)


def yeo_johnson(x: Column, power: float) -> Column:
    up = F.log1p(x) if abs(power) < 1e-12 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if abs(power - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def fit_power(df: DataFrame, x: str, transform, jacobian: Column, low: float = -2.0, high: float = 3.0, rounds: int = 4, grid: int = 16) -> float:
    """The power of greatest normal likelihood, by a narrowing grid: one aggregate over the data a round."""
    for _ in range(rounds):
        powers = [low + (high - low) * i / (grid - 1) for i in range(grid)]
        spread = [F.var_pop(transform(F.col(x), p)).alias(f"v{i}") for i, p in enumerate(powers)]
        row = df.agg(F.count(x).alias("n"), F.sum(jacobian).alias("j"), *spread).first()
        scores = [-0.5 * row["n"] * math.log(row[f"v{i}"]) + (p - 1) * row["j"] if row[f"v{i}"] else -math.inf for i, p in enumerate(powers)]
        best = max(range(grid), key=scores.__getitem__)
        low, high = powers[max(0, best - 1)], powers[min(grid - 1, best + 1)]
    return powers[best]


def fit_box_cox(df: DataFrame, x: str) -> float:
    return fit_power(df.where(F.col(x) > 0), x, box_cox, F.log(x))


def fit_yeo_johnson(df: DataFrame, x: str) -> float:
    return fit_power(df, x, yeo_johnson, F.signum(x) * F.log1p(F.abs(F.col(x))))


def equal_width(df: DataFrame, x: str, bins: int, out: str) -> DataFrame:
    """Bin 0 to bins - 1 of equal width between the column's extremes; a flat column is bin 0."""
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))  # one row
    place = F.floor(F.try_divide((F.col(x) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.when(F.col(x).isNotNull(), F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1))).cast("int")).drop("_lo", "_hi")


def tied_bins(df: DataFrame, x: str, bins: int, out: str) -> DataFrame:
    """Bins of about equal counts that never split equal values.

    Values are counted first; a value's bin is that of the middle of its rows in
    the order of all. The running sum is taken in two levels.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    middle = F.col("_n_before") + (F.col("_n") - 1) / 2
    placed = running(counts, "_v", {"_n": "_n"}).select("_v", F.floor(middle * bins / F.col("_n_all")).cast("int").alias(out))
    return df.join(placed, F.col(x) == F.col("_v"), "left").drop("_v")
