"""Which columns a feature table has: prefixes, concatenation and pruning."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """df with a prefix on every column but the keys."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in keep else prefix + c) for c in df.columns])


def concat(base: DataFrame, parts: Iterable[DataFrame], keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """base with the further columns of each part, matched on the keys; rows that a part lacks have nulls.

    A column that is there already is not taken again. Parts have one row per key.
    """

    def add(left: DataFrame, part: DataFrame) -> DataFrame:
        new = [c for c in part.columns if c not in left.columns]
        return left.join(part.select(*keys, *new), list(keys), "left") if new else left

    return reduce(add, parts, base)


def prune_constant(df: DataFrame, columns: Sequence[str], least_variation: float = 1e-4, most_share: float = 0.95) -> tuple[list[str], dict[str, str]]:
    """(columns that vary, why each of the others does not): too few values, one value's share, or deviation over mean size.

    A column goes if it has fewer than two values, if one value makes up
    most_share of them, or if its sample deviation over its mean absolute value
    (the deviation itself where that is under 1e-12) is below least_variation.
    Two passes over the data for all columns, each one aggregate whose parts are
    combined before the shuffle: a value with more than half of the rows is the
    median, also the approximate one, so that only medians are counted.
    """
    if most_share <= 0.6:
        raise ValueError("most_share must be above 0.6: only then is the most frequent value sure to be the median")
    if not columns:
        return [], {}
    v = {c: F.col(f"`{c}`").cast("double") for c in columns}
    sound = {c: F.when(~F.isnan(x), x) for c, x in v.items()}
    first = df.agg(*[a for i, (c, x) in enumerate(sound.items()) for a in (F.count(x).alias(f"n{i}"), F.stddev_samp(x).alias(f"s{i}"), F.avg(F.abs(x)).alias(f"a{i}"), F.percentile_approx(x, 0.5, 10_000).alias(f"m{i}"))]).first()
    second = df.agg(*[F.count(F.when(x == F.lit(first[f"m{i}"]), 1)).alias(f"k{i}") for i, x in enumerate(sound.values())]).first()
    gone = {}
    for i, c in enumerate(columns):
        n, size = first[f"n{i}"], first[f"a{i}"]
        if n < 2:
            gone[c] = "few"
        elif second[f"k{i}"] / n >= most_share:
            gone[c] = "constant"
        elif first[f"s{i}"] / (1 if size < 1e-12 else size) < least_variation:
            gone[c] = "flat"
    return [c for c in columns if c not in gone], gone


def prune_prefix_duplicates(columns: Sequence[str], priority: Sequence[str] = ("tm_", "feat_")) -> tuple[list[str], list[str]]:
    """(columns that stay, columns that go): of names that differ in their prefix only, the first prefix's stays.

    Names without one of the prefixes always stay. The order is kept.
    """
    best: dict[str, int] = {}
    ranked = []
    for c in columns:
        rank = next((i for i, p in enumerate(priority) if c.startswith(p)), None)
        base = c if rank is None else c[len(priority[rank]) :]
        ranked.append((c, base, rank))
        if rank is not None:
            best[base] = min(best.get(base, rank), rank)
    gone = [c for c, base, rank in ranked if rank is not None and rank > best[base]]
    return [c for c in columns if c not in gone], gone
