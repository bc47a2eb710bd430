"""As-of joins, range joins with first touch, purges: joins along time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str], forward: bool = False, max_age: str | None = None, last: str | None = None) -> DataFrame:
    """Each left row with the latest right row at or before its time (forward: the first at or after).

    Both sides are unioned and the values carried along the time order: one
    exchange and one sort on the keys, and no row is multiplied. Times are
    inclusive. With max_age (an interval such as '1 HOUR') older matches are
    null. Values are carried as one struct, so that a null value of the matched
    row stays null. `last` names a column for the latest right time of the key.
    Right rows with a null time never match; left rows with a
    null time keep null values. Right rows with equal times: the one with the
    greatest values wins.
    """
    names = list(left.columns)
    tag, time, held, mine = "_tag", "_time", "_held", "_mine"
    a = left.select(*on, F.col(left_time).alias(time), F.lit(0 if forward else 1).alias(tag), F.struct(*names).alias(mine), F.lit(None).alias("_t2"), *[F.lit(None).alias(f"_v_{v}") for v in values])
    b = right.where(F.col(right_time).isNotNull()).select(
        *on, F.col(right_time).alias(time), F.lit(1 if forward else 0).alias(tag), F.lit(None).alias(mine), F.col(right_time).alias("_t2"), *[F.col(v).alias(f"_v_{v}") for v in values]
    )
    both = a.unionByName(b).withColumn(held, F.when(F.col("_t2").isNotNull(), F.struct("_t2", *[f"_v_{v}" for v in values])))
    # Forward joins read the time order backwards: a frame that ends at the current row takes a step for each row, one that begins there is gone through anew.
    order = [c.desc() if forward else c for c in (F.col(time), F.col(tag))]
    w = Window.partitionBy(*on).orderBy(*order, *[F.col(f"_v_{v}") for v in values]).rowsBetween(Window.unboundedPreceding, 0)
    match = F.last(held, ignorenulls=True).over(w)
    ends = [F.max("_t2").over(Window.partitionBy(*on)).alias(last)] if last else []
    out = both.select("*", match.alias("_m"), *ends).where(F.col(mine).isNotNull())
    valid = F.col(time).isNotNull()
    if max_age:
        age = F.col(time) - F.col("_m._t2") if not forward else F.col("_m._t2") - F.col(time)
        valid = valid & (age <= F.expr(f"INTERVAL {max_age}"))
    return out.select(f"{mine}.*", *[F.when(valid, F.col(f"_m._v_{v}")).alias(v) for v in values], F.when(valid, F.col("_m._t2")).alias("matched_time"), *([last] if last else []))


def range_join(intervals: DataFrame, points: DataFrame, on: Sequence[str], start: str, end: str, time: str, bucket_seconds: int) -> DataFrame:
    """Pairs with start < time <= end, by an equi-join on time buckets.

    An interval is copied to each bucket that it meets, a point lies in one; the
    exact condition follows the equi-join. With buckets about as long as the
    intervals an interval is copied some two times.
    """
    bucket = lambda c: F.floor(F.unix_seconds(F.to_timestamp(c)) / bucket_seconds).cast("long")
    spread = intervals.withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end))))
    placed = points.withColumn("_b", bucket(time))
    return spread.join(placed, [*on, "_b"]).where((F.col(time) > F.col(start)) & (F.col(time) <= F.col(end))).drop("_b")


def vertical_barriers(events: DataFrame, bars: DataFrame, after: str, key: str = "symbol", t0: str = "t0", time: str = "ts") -> DataFrame:
    """Events with t1, the first bar at or after t0 plus an interval, or else the last bar of the key."""
    due = events.withColumn("_due", F.col(t0) + F.expr(f"INTERVAL {after}"))
    found = as_of(due, bars.select(key, F.col(time).alias("_bar")), [key], "_due", "_bar", [], forward=True, last="_last")
    return found.where("_last is not null").withColumn("t1", F.coalesce("matched_time", "_last")).drop("_due", "matched_time", "_last")


def triple_barrier(events: DataFrame, bars: DataFrame, pt: float, sl: float, tie: str = "stop", bucket_seconds: int = 86400, key: str = "symbol") -> DataFrame:
    """First touch of the upper, lower or time barrier in (t0, t1].

    events: key, t0, t1, price, vol. The upper barrier is price (1 + pt vol), the
    lower price (1 - sl vol); highs and lows touch them. A bar that touches both
    counts for the stop (tie='stop'), the profit ('profit') or neither ('none').
    A horizontal touch exits at its barrier, the time barrier at the last close
    with label 0. ret is the log return. Events with sl vol >= 1, a null or no
    bar in the interval give no row.
    """
    sound = events.where((F.col("vol") > 0) & (F.col("vol") * sl < 1) & F.col("t1").isNotNull())
    sound = sound.withColumn("upper", F.col("price") * (1 + pt * F.col("vol"))).withColumn("lower", F.col("price") * (1 - sl * F.col("vol")))
    walk = range_join(sound, bars.select(key, "ts", "high", "low", "close"), [key], "t0", "t1", "ts", bucket_seconds)
    up, down = F.col("high") >= F.col("upper"), F.col("low") <= F.col("lower")
    both = {"stop": F.lit(-1), "profit": F.lit(1), "none": F.lit(None)}[tie]
    touch = F.when(up & down, both).when(up, 1).when(down, -1)
    hit = F.when(touch.isNotNull(), F.struct("ts", touch.alias("label")))
    first = walk.groupBy(key, "t0", "t1", "price", "upper", "lower").agg(F.min(hit).alias("hit"), F.max(F.struct("ts", "close")).alias("end"))
    label = F.coalesce("hit.label", F.lit(0))
    exit_price = F.when(label > 0, F.col("upper")).when(label < 0, F.col("lower")).otherwise(F.col("end.close"))
    return first.select(
        key,
        "t0",
        F.coalesce("hit.ts", "end.ts").alias("exit_ts"),
        F.log(exit_price / F.col("price")).alias("ret"),
        label.cast("int").alias("label"),
        F.when(label > 0, "upper").when(label < 0, "lower").otherwise("vertical").alias("barrier"),
    )


def min_return(labels: DataFrame, least: float, ret: str = "ret", label: str = "label") -> DataFrame:
    """Labels of a smaller absolute return become 0; other columns, the barrier among them, stay. least <= 0 changes nothing."""
    if least <= 0:
        return labels
    return labels.withColumn(label, F.when(F.abs(ret) < least, 0).otherwise(F.col(label)))


def purge(train: DataFrame, test_start: Column, embargo_end: Column | None = None, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Train events that end before the test begins, or begin after the embargo."""
    before = F.col(t1) < test_start
    return train.where(before if embargo_end is None else before | (F.col(t0) > embargo_end))
