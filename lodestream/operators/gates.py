"""Health of a running model: its last rows against a baseline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import posterior
from lodestream.functions.frames import Keyed


@dataclass(frozen=True)
class Limits:
    """How far the last rows may be from the baseline."""

    entropy_z: float = 3.0
    occupancy: float = 0.2
    flip_rate: float = 0.1
    loglik_z: float = 3.0


def profile(log: DataFrame, probs: str, loglik: str, k: Keyed) -> DataFrame:
    """Per key: rows, mean and deviation of entropy and log likelihood, rate of changes of state, and share of each state.

    Shares are an array by state. Rows with a null are left out.
    """
    p = F.col(probs)
    rows = log.where(p.isNotNull() & F.col(loglik).isNotNull()).select(*k.keys, k.time, posterior.argmax(p).alias("s"), posterior.entropy(p).alias("e"), F.col(loglik).alias("l"), F.size(p).alias("n"))
    rows = rows.withColumn("f", F.coalesce((F.col("s") != k.lag("s")).cast("double"), F.lit(0.0)))
    on = list(k.keys)
    whole = rows.groupBy(*on).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("e").alias("entropy"),
        F.stddev_samp("e").alias("entropy_sd"),
        F.avg("l").alias("loglik"),
        F.stddev_samp("l").alias("loglik_sd"),
        F.avg("f").alias("flip_rate"),
        F.max("n").alias("_n"),
    )
    counts = rows.groupBy(*on, "s").agg(F.count(F.lit(1)).alias("c")).groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("s", "c"))).alias("_m"))  # a row for each state
    both = whole.join(counts, on)
    share = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)) / F.col("rows"))
    return both.withColumn("occupancy", share).drop("_n", "_m")


def last_rows(log: DataFrame, n: int, k: Keyed) -> DataFrame:
    """The last n rows of every key."""
    place = F.row_number().over(Window.partitionBy(*k.keys).orderBy(F.col(k.time).desc(), *[F.col(c).desc() for c in k.more]))
    return log.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def check(recent: DataFrame, baseline: DataFrame, keys: Sequence[str], limits: Limits | None = None) -> DataFrame:
    """(keys, rows, entropy_z, occupancy_drift, flip_drift, loglik_z, ok) of profiles of the last rows against those of a baseline.

    z is the distance of the means in standard errors of the baseline's rows,
    null where these do not vary, which is no fault; drift of occupancy is the sum
    of absolute differences of the shares. A key without a baseline is not ok.
    """
    limits = limits or Limits()
    old = baseline.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[F.col(c).alias(f"_{c}") for c in baseline.columns if c not in keys])
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    both = recent.join(old, same, "left")
    z = lambda c: F.when(F.col(f"_{c}_sd") > 1e-12, (F.col(c) - F.col(f"_{c}")) / (F.col(f"_{c}_sd") / F.sqrt(F.col("rows"))))
    apart = posterior.total(F.transform(F.arrays_zip("occupancy", "_occupancy"), lambda x: F.abs(F.coalesce(x["occupancy"], F.lit(0.0)) - F.coalesce(x["_occupancy"], F.lit(0.0)))))
    found = both.select(*keys, "rows", z("entropy").alias("entropy_z"), F.when(F.col("_rows").isNotNull(), apart).alias("occupancy_drift"), (F.col("flip_rate") - F.col("_flip_rate")).alias("flip_drift"), z("loglik").alias("loglik_z"), F.col("_rows").isNotNull().alias("_known"))
    sound: Column = F.col("_known")
    for c, most in (("entropy_z", limits.entropy_z), ("occupancy_drift", limits.occupancy), ("flip_drift", limits.flip_rate), ("loglik_z", limits.loglik_z)):
        sound = sound & F.coalesce(F.abs(F.round(c, 9)) <= most, F.lit(True))
    return found.withColumn("ok", sound).drop("_known")
