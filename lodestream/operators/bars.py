"""Bars: resampling, cleaning, trimming, merging and comparing keyed OHLCV tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def ticks_to_bars(ticks: DataFrame, unit: str = "hour", key: str = "event_type", time: str = "ts", price: str = "value", order: str = "event_id") -> DataFrame:
    """Bars (symbol, ts, open, high, low, close, volume) per calendar unit; volume counts ticks.

    First and last go by (time, order), of the ticks with a price. Every aggregate
    is combined before the shuffle, so a symbol with most of the ticks does not
    crowd one task.
    """
    at = F.when(F.col(price).isNotNull(), F.struct(time, order))
    return ticks.groupBy(F.col(key).alias("symbol"), F.date_trunc(unit, time).cast("timestamp_ntz").alias("ts")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.count(price).cast("double").alias("volume"),
    )


def resample(bars: DataFrame, seconds: int, key: str = "symbol", time: str = "ts") -> DataFrame:
    """Bars of a longer period, counted from the epoch; periods without bars are left out."""
    start = F.timestamp_seconds((F.floor(F.unix_seconds(F.to_timestamp(time)) / seconds) * seconds).cast("long")).cast("timestamp_ntz")
    return bars.groupBy(key, start.alias(time)).agg(
        F.min_by("open", time).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", time).alias("close"),
        F.sum("volume").alias("volume"),
    )


def fill_gaps(bars: DataFrame, seconds: int, key: str = "symbol", time: str = "ts") -> DataFrame:
    """One row for every period between a key's first and last bar; empty ones have null prices and volume 0.

    The calendar is exploded per key from its own bounds and equi-joined.
    """
    to_s = lambda c: F.unix_seconds(F.to_timestamp(c))
    ends = bars.groupBy(key).agg(F.min(to_s(time)).alias("a"), F.max(to_s(time)).alias("b"))
    spine = ends.select(key, F.explode(F.sequence("a", "b", F.lit(seconds).cast("long"))).alias("s"))
    spine = spine.select(key, F.timestamp_seconds("s").cast("timestamp_ntz").alias(time))
    return spine.join(bars, [key, time], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def clean(bars: DataFrame, key: str = "symbol", time: str = "ts", volume: str = "volume", keep: str = "first", order: str | None = None) -> DataFrame:
    """One bar per time, the first or last that arrived; of these the weekday bars with volume and without a null price or volume.

    `order` is a column that tells the order of arrival; without it the order in
    which rows are read counts, which only files keep. A bar that is kept and
    then found unsound is not replaced by a later one. Other columns may be null.
    """
    place = F.col(order) if order else F.monotonically_increasing_id()
    one = bars.withColumn("_at", place)
    one = one_per(one, [key, time], F.col("_at").asc() if keep == "first" else F.col("_at").desc()).drop("_at")
    needed = [c for c in (*PRICES, volume) if c in bars.columns]
    return one.where((F.col(volume) > 0) & (F.weekday(time) < 5)).dropna(subset=needed)


def one_per(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of every key by an order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(stored: DataFrame, fetched: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Stored and fetched rows, one per key; of equal keys the fetched row stays."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fetched.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("_v")).select(*keys, "_v.*")


def merge_report(stored: DataFrame, fetched: DataFrame, merged: DataFrame, key: str = "symbol", time: str = "ts") -> DataFrame:
    """Per key: rows of each table, repeated times of the merged one, and fault: why the merge is unsound, or null.

    A merged table has no repeated time and no fewer rows than either source.
    """
    tagged = [t.select(key, F.col(time).alias("_at"), F.lit(i).alias("_of")) for i, t in enumerate((stored, fetched, merged))]
    counted = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy(key, "_of", "_at").agg(F.count(F.lit(1)).alias("_n"))
    rows = lambda i: F.sum(F.when(F.col("_of") == i, F.col("_n")).otherwise(0))
    found = counted.groupBy(key).agg(rows(0).alias("stored"), rows(1).alias("fetched"), rows(2).alias("merged"), F.sum(F.when(F.col("_of") == 2, F.col("_n") - 1).otherwise(0)).alias("repeated"))
    fault = F.when(F.col("repeated") > 0, "repeated times").when(F.col("merged") < F.col("stored"), "stored rows lost").when(F.col("merged") < F.col("fetched"), "fetched rows lost")
    return found.withColumn("fault", fault)


def plausibility(bars: DataFrame, minutes: int, start: Column, end: Column, all_week: Column, least: float = 0.1, hours: float = 20.0, key: str = "symbol") -> DataFrame:
    """Per key: rows, expected rows of a period, their ratio and whether it is at least `least`.

    Markets trade five days of seven and `hours` of a day, or always where
    all_week holds (a condition on the key). Nothing expected is plausible.
    """
    span = (F.unix_micros(F.to_timestamp(end)) - F.unix_micros(F.to_timestamp(start))) / 60e6
    share = F.when(all_week, 1.0).otherwise(5 / 7 * hours / 24)
    found = bars.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).withColumn("expected", F.floor(span * share / minutes))
    found = found.withColumn("ratio", F.when(F.col("expected") > 0, F.col("rows") / F.col("expected")))
    return found.withColumn("plausible", F.coalesce(F.col("ratio") >= least, F.lit(True)))


def drop_sparse_columns(df: DataFrame, most: float = 0.2, keep: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Without the columns that are null in more than a share of the rows; then without rows with a null."""
    rate = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns if c not in keep]).first().asDict()
    return df.drop(*[c for c, r in rate.items() if r is not None and r > most]).dropna()


def drop_last(df: DataFrame, rows: int, key: str = "symbol", time: str = "ts") -> DataFrame:
    """Without the last rows of every key, whose labels look past the end."""
    ahead = F.lead(time, rows).over(Window.partitionBy(key).orderBy(time))
    return df.withColumn("_a", ahead).where("_a is not null").drop("_a")


def compare_feeds(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("symbol", "ts"), columns: Sequence[str] = PRICES, tolerance: float = 1e-9) -> DataFrame:
    """Full outer comparison: where a row is missing, and which columns differ by more than the tolerance."""
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    both = a.join(b, on, "full_outer")
    status = F.when(F.col(f"b.{keys[0]}").isNull(), "left_only").when(F.col(f"a.{keys[0]}").isNull(), "right_only").otherwise("both")
    apart = [F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > tolerance, F.lit(False)).cast("int").alias(f"{c}_differs") for c in columns]
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], status.alias("status"), *apart)


def lag_features(df: DataFrame, columns: Sequence[str], lags: Sequence[int], key: str = "symbol", time: str = "ts") -> DataFrame:
    w = Window.partitionBy(key).orderBy(time)
    return df.select("*", *[F.lag(c, n).over(w).alias(f"{c}_lag_{n}") for c in columns for n in lags])


def temporal_features(df: DataFrame, time: str = "ts") -> DataFrame:
    """Calendar parts of the time; weekday 0 is Monday; hour and weekday as points of a circle too."""
    hour, day = F.hour(time), F.weekday(time)
    turn = lambda x, n: 2 * 3.141592653589793 * x / n
    return df.select(
        "*",
        hour.alias("hour"),
        day.alias("weekday"),
        F.dayofmonth(time).alias("day"),
        F.month(time).alias("month"),
        F.quarter(time).alias("quarter"),
        F.sin(turn(hour, 24)).alias("hour_sin"),
        F.cos(turn(hour, 24)).alias("hour_cos"),
        F.sin(turn(day, 7)).alias("weekday_sin"),
        F.cos(turn(day, 7)).alias("weekday_cos"),
    )
