"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule: knots (t, w) over the training time
t in [0, 1], linear in between. Its integral is the source's weight; shares are
filled up to a cap of `max_epochs` times a source's size and the excess is dealt
again by weight. Documents of a source lie one after another on its token axis
in a seeded order, epoch after epoch. The position of a copy is the time at
which the source's cumulative demand reaches the copy's middle, found by
inverting the integrated schedule. Documents are then range-sorted by position.

Everything is DataFrame functions. Positions are found on rows without their
texts. Prefix sums over a source are taken in levels, so that a source with a
third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.frames import running
from lodestream.llm.scratch import masked, save, unmasked, without

#: Documents of one source that are ordered within one task, on average.
BUCKET_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"
#: Knots (t, w) of a weight over the training time, or one number for a weight that stays.
Schedule = float | Sequence[tuple[float, float]]


def knots(schedule: Schedule) -> list[tuple[float, float]]:
    """The knots from t = 0 to t = 1: before the first and after the last the weight stays."""
    if isinstance(schedule, int | float):
        schedule = [(0.0, float(schedule))]
    found = sorted(((float(t), float(w)) for t, w in schedule), key=lambda k: k[0])  # a step has two knots at one time
    if not found or found[0][0] < 0 or found[-1][0] > 1 or any(w < 0 for _, w in found) or not any(w for _, w in found):
        raise ValueError(f"a schedule has knots in [0, 1] with weights of 0 or more, not all 0: {schedule}")
    first, last = found[0], found[-1]
    return [(0.0, first[1])] * (first[0] > 0) + found + [(1.0, last[1])] * (last[0] < 1)


def pieces(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """(t, length, w at its start, change of w, integral before it) for each linear piece of a schedule."""
    out, before, points = [], 0.0, knots(schedule)
    for (t, w), (u, v) in zip(points, points[1:], strict=False):
        if u > t:
            out.append((t, u - t, w, v - w, before))
            before += (u - t) * (w + v) / 2
    return out


def weight_of(schedule: Schedule) -> float:
    """Its integral."""
    t, length, w, change, before = pieces(schedule)[-1]
    return before + length * (w + change / 2)


def word_count(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def pick(values: list[float], slot: Column) -> Column:
    """values[slot], as a column."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), slot + 1)


def source_targets(sizes: DataFrame, source: str, size: str, weights: list[float], max_epochs: float) -> DataFrame:
    """One row per source: its size, slot in the weights and target.

    Sources in code point order, null last, get the weights in turn. They share
    the sum of all sizes by weight; a target stops at max_epochs times the
    source's size and the excess goes to the others by weight. A source of size
    0 gets the target 0. The windows run over one row per source: the mixture's
    own table, not the corpus.
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last()))
    per = per.withColumn("slot", ((rank - 1) % len(weights)).cast("int")).withColumn("weight", pick(weights, F.col("slot")))
    # With sources by cap/weight, the capped ones are a prefix: source i is
    # capped if the level that is left for it and all later ones is above its own.
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col(source).asc_nulls_last())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("cap", cap)
    per = per.withColumn("left", F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("level", F.col("left") / F.sum("weight").over(after))
    per = per.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # Levels fall from the first source that is not full onwards: its own is the final one.
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    per = per.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level)))
    return per.select(source, "source_size", "source_rows", "slot", "target")


def time_of(share: Column, schedules: Sequence[Schedule], slot: Column) -> Column:
    """The time by which a schedule has had this share of its integral: the integral inverted, piece by piece."""
    tables = F.array(*[F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("t", "length", "w", "change", "before"), p, strict=True)]) for p in pieces(s)]) for s in schedules])
    demand = share * pick([weight_of(s) for s in schedules], slot)
    piece = F.element_at(F.filter(F.get(tables, slot), lambda p: p["before"] <= demand), -1)
    # w x + change x^2 / (2 length) = rest
    rest, w, slope = demand - piece["before"], piece["w"], piece["change"] / piece["length"]
    root = w + F.sqrt(F.greatest(w * w + 2 * slope * rest, F.lit(0.0)))
    step = F.when(root > 0, F.least(2 * rest / root, piece["length"])).otherwise(0.0)
    return F.when(share <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), piece["t"] + step))


def mix(
    docs: DataFrame,
    schedules: Sequence[Schedule],
    max_epochs: float = 3.0,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    carry: bool = True,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Adds size, source_size, target, taken and positions to every document.

    positions holds a training time in [0, 1] for each copy that the mix takes,
    none to ceil(max_epochs); taken is size times their number. Sources in code
    point order, null last, get the schedules in turn. A copy is taken if its
    middle lies under the target, so a source misses its target by at most half
    its longest document.

    Null text and text without words have size 0 and are never taken. Null
    sources are one source, the last. Rows with equal key, source and text are
    interchangeable copies, each with its own place. Input columns named like an
    output are replaced. Without rows the result is empty. carry=False returns
    the key and the new columns alone, range-sorted by first position.
    """
    docs = without(docs, "size", "source_size", "target", "taken", "positions")
    weights = [weight_of(s) for s in schedules]
    rows, names = masked(docs)
    key, text, source = names[key], names[text], names[source]
    h, b, s, size, row = "_hash", "_bucket", "_source", "_size", "_row"
    # The order within a source: a hash of key and text, so that reruns agree.
    base = rows.select(
        *(names.values() if carry else [key]),
        F.col(source).alias(s),
        word_count(F.col(text)).alias(size),
        F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(key), F.col(text)), 1).alias(h),
        F.monotonically_increasing_id().alias(row),
    )
    base = save(base, "mix-sizes")
    targets = source_targets(base.select(s, size), s, size, weights, max_epochs)
    targets = targets.withColumn("_sid", F.row_number().over(Window.orderBy(F.col(s).asc_nulls_last())))  # one row per source
    targets = save(targets, "mix-targets").withColumnRenamed(s, "_of")
    # First level: buckets of a source by hash range, summed before any shuffle of rows.
    spread = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / bucket_rows)).cast("long")
    bucket = F.floor((F.shiftright(F.col(h), 32) / F.lit(float(1 << 31))) * spread)
    placed = base.select(*([] if carry else [key]), s, size, h, row).join(targets, F.col(s).eqNullSafe(F.col("_of"))).withColumn(b, bucket).drop(s, "_of")
    buckets = placed.groupBy("_sid", b).agg(F.sum(size).alias("_in"))
    buckets = running(buckets, b, {"_start": "_in"}, ["_sid"]).select(F.col("_sid").alias("_bs"), F.col(b).alias("_bb"), F.col("_start_before").alias("_start"))
    # Second level: the order within a bucket.
    inside = Window.partitionBy("_sid", b).orderBy(h, size).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_before", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    placed = placed.join(buckets, (F.col("_sid") == F.col("_bs")) & (F.col(b) == F.col("_bb")))
    middle = F.col("_start") + F.col("_before") + F.col(size) / 2
    copies = F.when(F.col(size) > 0, F.greatest(F.lit(0.0), F.ceil((F.col("target") - F.col("_middle")) / F.col("source_size")))).otherwise(0)
    placed = placed.withColumn("_middle", middle).withColumn("_copies", F.least(copies, F.lit(float(max_epochs))).cast("int"))
    share = lambda k: (F.col("_middle") + k * F.col("source_size")) / F.col("target")
    epochs = F.when(F.col("_copies") > 0, F.sequence(F.lit(0), F.col("_copies") - 1)).otherwise(F.array().cast("array<int>"))
    placed = placed.withColumn("positions", F.transform(epochs, lambda k: time_of(share(k), schedules, F.col("slot"))))
    placed = placed.withColumn("taken", F.col(size) * F.col("_copies"))
    found = [F.col(size).alias("size"), "source_size", "target", "taken", "positions"]
    if not carry:
        own = F.col(key).alias(next(old for old, new in names.items() if new == key))
        return in_order(placed.select(own, *found), F.get("positions", F.lit(0)))
    # Rows meet their texts again; always by a sort-merge join, as both sides grow with the corpus.
    placed = placed.select(F.col(row).alias("_place"), *found)
    return base.drop(s, size, h).join(placed.hint("merge"), F.col(row) == F.col("_place")).select(*unmasked(names), "size", "source_size", "target", "taken", "positions")


def in_order(rows: DataFrame, position: Column) -> DataFrame:
    """Range-sorted by training position; rows that are not taken come last."""
    place = F.coalesce(position, F.lit(2.0))
    return rows.repartitionByRange(place, F.xxhash64(rows.columns[0])).sortWithinPartitions(place)


def emit(mixed: DataFrame) -> DataFrame:
    """The training stream: one row per taken copy with its position (an earlier position is replaced), sorted."""
    one = without(mixed, "position").withColumn("position", F.explode("positions")).drop("positions")
    return in_order(one, F.col("position"))
