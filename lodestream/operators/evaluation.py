"""Label and signal evaluation: runs, transitions, state statistics, rank correlation, back-tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.functions import posterior
from lodestream.functions.frames import PIECES, Keyed, div, ln, running
from lodestream.operators.rolling_kernels import beta_cdf, rolling, rolling_rank_correlation


def runs(df: DataFrame, label: str, key: str = "symbol", time: str = "ts") -> DataFrame:
    """Rows with the number of their run of equal labels (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(time)
    changed = F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(0))
    return df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def run_lengths(df: DataFrame, label: str, key: str = "symbol", time: str = "ts") -> DataFrame:
    return runs(df, label, key, time).groupBy(key, "run", label).agg(F.count(F.lit(1)).alias("length"), F.min(time).alias("start"), F.max(time).alias("end"))


def transition_matrix(df: DataFrame, label: str, key: str = "symbol", time: str = "ts") -> DataFrame:
    """Counts and row shares of successive labels."""
    w = Window.partitionBy(key).orderBy(time)
    moves = df.select(F.col(label).alias("state"), F.lead(label).over(w).alias("next_state")).where("next_state is not null")
    counted = moves.groupBy("state", "next_state").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def quantile(x: str, p, accuracy: int | None = None) -> Column:
    """Quantiles as an aggregate: exact, which holds every distinct value of a group, or within 1 / accuracy of the rank.

    Exact ones are for many small groups; exact_quantiles takes large ones.
    """
    return F.percentile(x, p) if accuracy is None else F.percentile_approx(x, p, accuracy)


def exact_quantiles(df: DataFrame, x: str, shares: Sequence[float], groups: Sequence[str] = (), out: str = "quantiles") -> DataFrame:
    """One row per group (one in all without groups) with the exact quantiles of x, interpolated between neighbours.

    Distinct values are counted and placed by running totals, so no task holds a
    group's values. Nulls are left out; a group without values gives no row.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*groups, F.col(x).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counts, "_v", {"_n": "_n"}, groups)
    at = [F.lit(float(p)) * (F.col("_n_all") - 1) for p in shares]
    here = lambda place: F.max(F.when((place >= F.col("_n_before")) & (place < F.col("_n_before") + F.col("_n")), F.col("_v")))
    found = placed.groupBy(*groups).agg(F.max("_n_all").alias("_n_all"), *[e for i, a in enumerate(at) for e in (here(F.floor(a)).alias(f"_lo{i}"), here(F.ceil(a)).alias(f"_hi{i}"))])
    between = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (a - F.floor(a)) for i, a in enumerate(at)]
    return found.where("_n_all is not null").select(*groups, F.array(*between).alias(out))


def state_statistics(df: DataFrame, label: str, value: str, accuracy: int | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of a value per state; see quantile for accuracy."""
    q = lambda p: quantile(value, p, accuracy)
    return df.groupBy(label).agg(
        F.count(value).alias("n"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        q(0.25).alias("q1"),
        q(0.5).alias("median"),
        q(0.75).alias("q3"),
    )


def average_rank(x: str, groups: Sequence[str] = ()) -> Column:
    """Rank of x within its groups, ties at their mean."""
    w = Window.partitionBy(*groups)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*groups, x)) - 1) / 2


def counted_ranks(df: DataFrame, x: str, groups: Sequence[str], out: str) -> DataFrame:
    """(groups, x, out): average rank of each distinct value, by counts and running totals, for groups of any size."""
    counts = df.groupBy(*groups, x).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, x, {"_n": "_n"}, groups)
    return ranked.select(*groups, x, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(out))


def spearman(df: DataFrame, x: str, y: str, groups: Sequence[str], least: int = 1, large: bool = False) -> DataFrame:
    """Rank correlation of x and y per group, ties at their mean rank; null for a flat side or fewer rows than `least`.

    Ranks are windows over a group, which meets in one task: right for many
    groups. For a few large ones ask for large, which ranks by running totals.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, F.col(x).cast("double").alias("_a"), F.col(y).cast("double").alias("_b"))
    if large:
        ranked = both.join(counted_ranks(both, "_a", groups, "_x"), [*groups, "_a"]).join(counted_ranks(both, "_b", groups, "_y"), [*groups, "_b"])
    else:
        ranked = both.select(*groups, average_rank("_a", groups).alias("_x"), average_rank("_b", groups).alias("_y"))
    sx, sy = F.stddev_pop("_x"), F.stddev_pop("_y")
    enough = (F.least(sx, sy) > 1e-12) & (F.count(F.lit(1)) >= least)
    return ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.when(enough, F.try_divide(F.covar_pop("_x", "_y"), sx * sy)).alias("ic"))


def conditional_ic(df: DataFrame, features: Sequence[str], target: str, condition: str, least: int = 1000) -> DataFrame:
    """(feature, condition, n, ic): rank correlation of each feature with the target in each condition.

    Rows without the feature, the target or the condition are left out of that
    pair only. ic is null below `least` rows and for a flat side. Groups may be
    as large as the table: ranks are running totals.
    """
    long = df.where(F.col(condition).isNotNull()).select(F.col(condition).alias("condition"), F.col(target).alias("_target"), F.explode(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])).alias("feature", "_value"))
    return spearman(long, "_value", "_target", ["feature", "condition"], least, large=True)


def p_value(ic: str, n: str) -> Column:
    """Two-sided chance of a rank correlation this far from 0, by Student's t; for tables of a few rows."""

    @F.pandas_udf("double")
    def chance(r: pd.Series, rows: pd.Series) -> pd.Series:
        def one(r: float, n: float) -> float | None:
            if r is None or not math.isfinite(r) or n < 3:
                return None
            if abs(r) >= 1:
                return 0.0
            return beta_cdf((n - 2) / 2, 0.5, 1 - r * r)  # of t = r sqrt((n - 2) / (1 - r^2))

        return pd.Series([one(a, b) for a, b in zip(r, rows, strict=True)], dtype="float64")

    return chance(F.col(ic), F.col(n).cast("double"))


def rolling_ic(df: DataFrame, x: str, y: str, n: int, key: str = "symbol", time: str = "ts") -> DataFrame:
    """Rank correlation over the trailing n rows of a key, from the n-th row on; 0 where a side is flat.

    Pairs with a null are left out of a window, of which half must be there.
    """
    return rolling(df, n, rolling_rank_correlation(n), "ic double", (x, y), (key,), time).where("ic is not null")


def quantile_bins(df: DataFrame, x: str, bins: int, out: str = "bin", accuracy: int | None = None) -> DataFrame:
    """Bin 0 to bins - 1 by edges at equal quantiles of the whole column; the edges are one row.

    They are exact unless an accuracy is given, as for quantile.
    """
    shares = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(df, x, shares, out="_edges") if accuracy is None else df.agg(quantile(x, shares, accuracy).alias("_edges"))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.size(F.filter("_edges", lambda e: e < F.col(x)))).drop("_edges")


def signal_backtest(df: DataFrame, signal: str, ret: str, cost_bps: float, key: str = "symbol", time: str = "ts") -> DataFrame:
    """Next-bar execution: position, cost, net return, equity and drawdown per bar.

    Null signals and returns count as 0; a position is the signal of the bar before.
    """
    w = Window.partitionBy(key).orderBy(time)
    path = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("position", F.coalesce(F.lag(F.coalesce(signal, F.lit(0.0))).over(w), F.lit(0.0)))
    df = df.withColumn("cost", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))) * cost_bps / 1e4)
    df = df.withColumn("net", F.col("position") * F.coalesce(ret, F.lit(0.0)) - F.col("cost"))
    df = df.withColumn("log_equity", F.sum(F.log1p(F.greatest("net", F.lit(-0.999999)))).over(path))
    return df.withColumn("drawdown", F.exp(F.col("log_equity") - F.greatest(F.max("log_equity").over(path), F.lit(0.0))) - 1)


def backtest_summary(tested: DataFrame, key: str = "symbol") -> DataFrame:
    sd = F.stddev_samp("net")
    return tested.groupBy(key).agg(
        F.count(F.lit(1)).alias("bars"),
        F.sum("net").alias("total"),
        F.when(sd > 1e-12, F.avg("net") / sd * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.sum((F.col("cost") > 0).cast("long")).alias("trades"),
    )


def backtest_by_regime(tested: DataFrame, regime: str, key: str = "symbol", time: str = "ts", year: float = 252.0) -> DataFrame:
    """What a tested path earned under each regime; a bar without one counts for the last that there was, and before the first as null."""
    k = Keyed((key,), time)
    rows = tested.withColumn("_g", k.fill(regime))
    sd, net = F.stddev_samp("net"), F.col("net")
    down = F.sqrt(F.avg(F.pow(F.least(net, F.lit(0.0)), 2)))
    return rows.groupBy(F.col("_g").alias("regime")).agg(
        F.count(F.lit(1)).alias("bars"),
        F.avg((F.col("position") != 0).cast("double")).alias("exposure"),
        F.sum("net").alias("total"),
        F.when(sd > 1e-12, F.avg("net") / sd * math.sqrt(year)).alias("sharpe"),
        F.when(down > 1e-12, F.avg("net") / down * math.sqrt(year)).alias("sortino"),
        F.try_divide(F.sum((net > 0).cast("double")), F.sum((net != 0).cast("double"))).alias("win_rate"),
        F.try_divide(F.sum(F.greatest(net, F.lit(0.0))), -F.sum(F.least(net, F.lit(0.0)))).alias("profit_factor"),
        F.min("net").alias("worst"),
    )


#: The first hour (UTC) of each session, and the first minute of each class of duration.
SESSIONS = ((0, "Asian"), (8, "London"), (13, "NY–London OL"), (16, "New York"), (21, "Off-hours"))
DURATIONS = ((0, "Scalp (<1h)"), (60, "Intraday (1–8h)"), (480, "Swing (8h–3d)"), (4320, "Position (>3d)"))


def _class_of(x: Column, classes: Sequence[tuple[int, str]]) -> Column:
    out = F.when(x.isNull() | (x < 0), "Unknown")
    for least, name in reversed(classes):
        out = out.when(x >= least, name)
    return out


def session(time: str) -> Column:
    """The market session of a UTC time; Unknown for null."""
    return _class_of(F.hour(time), SESSIONS)


def duration_class(start: str, end: str) -> Column:
    """Scalp, intraday, swing or position by the minutes between two times; Unknown for null and backwards."""
    return _class_of((F.unix_micros(F.to_timestamp(end)) - F.unix_micros(F.to_timestamp(start))) / 60e6, DURATIONS)


def trades(tested: DataFrame, key: str = "symbol", time: str = "ts") -> DataFrame:
    """One row per stretch of one position that is not 0: entry, exit (the bar after it, or its last), side, bars and pnl."""
    w = Window.partitionBy(key).orderBy(time)
    rows = runs(tested, "position", key, time).withColumn("_next", F.lead(time).over(w))
    held = rows.where("position <> 0").groupBy(key, "run")
    return held.agg(F.min(time).alias("entry"), F.coalesce(F.max_by("_next", time), F.max(time)).alias("exit"), F.first("position").alias("side"), F.count(F.lit(1)).alias("bars"), F.sum("net").alias("pnl")).drop("run")


def state_report(df: DataFrame, label: str, ret: str, key: str = "symbol", time: str = "ts") -> DataFrame:
    """Per state: return statistics, run lengths and the chance to stay, merged by left joins from the states that there are."""
    rows = df.where(F.col(label).isNotNull())
    lengths = run_lengths(rows, label, key, time).groupBy(label).agg(F.count(F.lit(1)).alias("runs"), F.avg("length").alias("mean_length"), F.max("length").alias("longest"))
    stay = transition_matrix(rows, label, key, time).where("state = next_state").select(F.col("state").alias("_s"), F.col("share").alias("stay"))
    base = state_statistics(rows, label, ret)
    return base.join(F.broadcast(lengths), label, "left").join(F.broadcast(stay), F.col(label) == F.col("_s"), "left").drop("_s")  # a row for each state


def filter_and_rank(results: DataFrame, criteria: dict[str, float | tuple[float, float]], by: str, top: int, higher: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """The best results of those that meet the criteria: a number is the least value, a pair the range, ends included.

    A null meets no criterion. Results without the ranked value come last; ties
    go by the columns `ties`.
    """
    kept = F.lit(True)
    for name, limit in criteria.items():
        if isinstance(limit, tuple):
            if limit[0] > limit[1]:
                raise ValueError(f"the range of {name} runs backwards: {limit}")
            kept &= F.col(name).between(*limit)
        else:
            kept &= F.col(name) >= limit
    order = F.col(by).desc_nulls_last() if higher else F.col(by).asc_nulls_last()
    return results.where(kept).orderBy(order, *ties).limit(top)


def threshold_null(df: DataFrame, x: str, ret: str, least: int, shuffles: int, key: str = "symbol", seed: int = 0, block: int = 50) -> DataFrame:
    """Per key: the best long and short profit factors over thresholds of x, and the share of shuffles of the returns that do as well.

    A share counts the data themselves as one shuffle, so it is never 0; best is
    for the better of the two. Shuffles are dealt out in blocks, a task each,
    which takes all rows of its key.
    """
    sound = df.where(F.col(x).isNotNull() & F.col(ret).isNotNull()).select(key, F.col(x).cast("double").alias("_x"), F.col(ret).cast("double").alias("_r"))
    dealt = sound.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(-(-shuffles // block)))))

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["_b"].iloc[0])
        rows = rows.sort_values(["_x", "_r"], ascending=[False, True])
        values, r = rows["_x"].to_numpy(), rows["_r"].to_numpy()
        long, short = best_factors(values, r, least)
        out = []
        if number == 0:
            out.append((rows[key].iloc[0], True, long, short))
        drawn = np.random.default_rng([seed, number])
        for _ in range(min(block, shuffles - (number - 1) * block) if number else 0):
            out.append((rows[key].iloc[0], False, *best_factors(values, drawn.permutation(r), least)))
        return pd.DataFrame(out, columns=[key, "own", "long", "short"])

    found = dealt.groupBy(key, "_b").applyInPandas(test, T.StructType([df.schema[key], *T._parse_datatype_string("own boolean, long double, short double").fields]))
    own = found.where("own").select(F.col(key).alias("_k"), F.col("long").alias("long_pf"), F.col("short").alias("short_pf"))
    both = found.where("not own").join(own, F.col(key).eqNullSafe(F.col("_k")), "right")
    share = lambda hit: (F.lit(1) + F.count(F.when(hit, 1))) / (F.lit(1) + F.lit(shuffles))
    best = F.greatest("long", "short") >= F.greatest("long_pf", "short_pf")
    return both.groupBy(F.col("_k").alias(key), "long_pf", "short_pf").agg(share(F.col("long") >= F.col("long_pf")).alias("p_long"), share(F.col("short") >= F.col("short_pf")).alias("p_short"), share(best).alias("p_best"))


def best_factors(x: np.ndarray, r: np.ndarray, least: int) -> tuple[float, float]:
    """The best long and short profit factor over the cuts of x, which falls: see best_thresholds."""
    gain, loss = np.concatenate(([0.0], np.cumsum(np.maximum(r, 0)))), np.concatenate(([0.0], np.cumsum(np.maximum(-r, 0))))
    cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    rest = len(x) - cut
    left = lambda v: np.maximum(np.round(v[-1] - v[cut], 12), 0)
    long = left(gain) / (left(loss) + 1e-30)
    short = loss[cut] / (gain[cut] + 1e-30)
    may_long, may_short = (cut == 0) | (rest >= least), (cut > 0) & (cut >= least)
    return float(long[may_long].max()), float(short[may_short].max()) if may_short.any() else -1.0


def walk_forward_folds(df: DataFrame, folds: int, key: str = "symbol", time: str = "ts") -> DataFrame:
    """The fold of each row: equal parts of a key's rows in time order, the first ones longer by one."""
    return df.withColumn("fold", F.ntile(folds).over(Window.partitionBy(key).orderBy(time)) - 1)


def profit_factor_sweep(df: DataFrame, x: str, ret: str, thresholds: Sequence[float]) -> DataFrame:
    """Profit factor of the returns above and not above each threshold of x."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    rows = df.where(F.col(x).isNotNull() & F.col(ret).isNotNull()).select(x, ret, grid)
    above = F.col(x) > F.col("threshold")
    gain = lambda side, sign: F.sum(F.when(side & (sign * F.col(ret) > 0), sign * F.col(ret)).otherwise(0.0))
    return rows.groupBy("threshold").agg(
        F.sum(above.cast("long")).alias("n_above"),
        F.try_divide(gain(above, 1), gain(above, -1)).alias("pf_above"),
        F.try_divide(gain(~above, 1), gain(~above, -1)).alias("pf_below"),
    )


def roc_table(df: DataFrame, x: str, ret: str, shares: Sequence[float]) -> DataFrame:
    """Profit factors above and below the cut of each share, from the highest x down.

    The cut of a share p of n rows is row int(p (n + 1)) - 1 in falling order of
    x, from 0, within the table; where it falls among equal values it moves to
    the first of them. Rows before it are above. Cuts at the first or last row
    give no row. A profit factor is gains over losses plus 1e-30; short ones are
    the other way round. Values are summed up before they are put in order, and
    the order is taken by running totals: no task sees all of them.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(ret).isNotNull()).select(F.col(x).cast("double").alias("_x"), F.col(ret).alias("_r"))
    gain, loss = F.sum(F.when(F.col("_r") > 0, F.col("_r")).otherwise(0.0)), F.sum(F.when(F.col("_r") < 0, -F.col("_r")).otherwise(0.0))
    counts = rows.groupBy("_x").agg(F.count(F.lit(1)).alias("n"), gain.alias("g"), loss.alias("l"))
    placed = running(counts, "_x", {"n": "n", "g": "g", "l": "l"}, descending=True)
    cuts = placed.withColumn("share", F.explode(F.array(*[F.lit(float(p)) for p in shares])))
    k = F.greatest(F.lit(0), F.least(F.floor(F.col("share") * (F.col("n_all") + 1)) - 1, F.col("n_all") - 1))
    cuts = cuts.where((k >= F.col("n_before")) & (k < F.col("n_before") + F.col("n")) & (F.col("n_before") > 0) & (F.col("n_before") < F.col("n_all") - 1))
    over = lambda a, b: a / (b + 1e-30)
    rest = lambda c: F.greatest(F.round(F.col(f"{c}_all") - F.col(f"{c}_before"), 12), F.lit(0.0))  # noqa: E731  (what rounding leaves of nothing is nothing)
    g, l = rest("g"), rest("l")
    return cuts.select(
        "share",
        F.col("_x").alias("threshold"),
        (F.col("n_before") / F.col("n_all")).alias("frac_above"),
        over(F.col("g_before"), F.col("l_before")).alias("pf_long_above"),
        over(F.col("l_before"), F.col("g_before")).alias("pf_short_above"),
        over(g, l).alias("pf_long_below"),
        over(l, g).alias("pf_short_below"),
    )


def best_thresholds(df: DataFrame, x: str, ret: str, least: int) -> DataFrame:
    """One row: the profit factor of all rows, and the thresholds of x with the best long and short ones.

    Long is every row with x at or below a cut in falling order, short every row
    before it, each with at least so many rows. Of equal factors the earlier cut
    counts. Without a better cut long is the whole table, from the highest x.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(ret).isNotNull()).select(F.col(x).cast("double").alias("_x"), F.col(ret).alias("_r"))
    gain, loss = F.sum(F.when(F.col("_r") > 0, F.col("_r")).otherwise(0.0)), F.sum(F.when(F.col("_r") < 0, -F.col("_r")).otherwise(0.0))
    counts = rows.groupBy("_x").agg(F.count(F.lit(1)).alias("n"), gain.alias("g"), loss.alias("l"))
    placed = running(counts, "_x", {"n": "n", "g": "g", "l": "l"}, descending=True)
    rest = F.col("n_all") - F.col("n_before")
    left = lambda c: F.greatest(F.round(F.col(f"{c}_all") - F.col(f"{c}_before"), 12), F.lit(0.0))
    long = F.when((F.col("n_before") == 0) | (rest >= least), left("g") / (left("l") + 1e-30))
    # The other side of a cut wins where it loses: its gains are the losses of the rows before the cut.
    short = F.when((F.col("n_before") > 0) & (F.col("n_before") >= least), F.col("l_before") / (F.col("g_before") + 1e-30))
    best = lambda pf, n: F.max(F.when(pf.isNotNull(), F.struct(pf.alias("pf"), F.col("_x").alias("x"), n.alias("n"))))
    found = placed.agg(F.max(F.col("g_all") / (F.col("l_all") + 1e-30)).alias("pf_all"), best(long, rest).alias("a"), best(short, F.col("n_before")).alias("b"))
    parts = [F.col("a.pf").alias("long_pf"), F.col("a.x").alias("long_threshold"), F.col("a.n").alias("n_long"), F.col("b.pf").alias("short_pf"), F.col("b.x").alias("short_threshold"), F.col("b.n").alias("n_short")]
    return found.select("pf_all", *parts)


def rounded_sums(df: DataFrame, key: str, value: str, order: Sequence[str], total: str, n: str) -> DataFrame:
    """Per key: the sum of value, rounded to a whole number, and the number of rows, as if doubles were added in this order.

    In another order a sum that ends near a half may be rounded to the other
    side. So sums are taken in parts first, and only those that are so near to a
    half that the order may tell are taken again, row after row.
    """
    first = df.groupBy(F.col(key).alias("_k")).agg(F.sum(value).alias("_s"), F.sum(F.abs(value)).alias("_a"), F.count(F.lit(1)).alias(n))
    # Sums of n doubles in two orders are less than n sum|x| / 2^51 apart; NaN and infinity are not judged.
    sure = (F.col("_a") < float("inf")) & (F.abs(F.pmod("_s", F.lit(1.0)) - 0.5) > F.col(n) * F.col("_a") * 2.0**-51)
    near = first.where(F.col("_s").isNotNull() & ~sure).select("_k")
    rows = df.join(near, F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    so_far = F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(F.col(key).alias("_n"), so_far.alias("_t"), F.struct(*order).alias("_at"))
    again = rows.groupBy("_n").agg(F.max_by("_t", "_at").alias("_t"))
    found = first.join(again, F.col("_k").eqNullSafe(F.col("_n")), "left")
    return found.select(F.col("_k").alias(key), F.round(F.coalesce("_t", "_s")).cast("long").alias(total), n)


def dominated(df: DataFrame, more: str, less: str) -> DataFrame:
    """Adds dominated: some row has strictly more of one and strictly less of the other.

    Values of `more` are taken once, with their least `less`; the least over all
    higher values is a running minimum in two levels, over pieces and within
    them, so that no task has the whole table.
    """
    best = df.where(F.col(more).isNotNull() & F.col(less).isNotNull()).groupBy(F.col(more).alias("_m")).agg(F.min(less).alias("_l"))
    edges = best.agg(F.percentile_approx(F.col("_m").cast("double"), [i / PIECES for i in range(1, PIECES)], 20 * PIECES).alias("_edges"))
    placed = best.crossJoin(F.broadcast(edges)).withColumn("_piece", F.size(F.filter("_edges", lambda e: e < F.col("_m")))).drop("_edges")
    higher = Window.orderBy(F.col("_piece").desc()).rowsBetween(Window.unboundedPreceding, -1)  # over PIECES rows
    pieces = placed.groupBy("_piece").agg(F.min("_l").alias("_pl")).select("_piece", F.min("_pl").over(higher).alias("_above"))
    inside = Window.partitionBy("_piece").orderBy(F.col("_m").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = placed.join(pieces, "_piece").select("_m", F.least("_above", F.min("_l").over(inside)).alias("_least"))
    found = df.join(least, F.col(more) == F.col("_m"), "left")
    return found.withColumn("dominated", F.coalesce(F.col("_least") < F.col(less), F.lit(False))).drop("_m", "_least")


def pareto_front(df: DataFrame, name: str, more: str, less: str) -> DataFrame:
    """Rows with dominated: some row has more of one and less of the other; see dominated."""
    return dominated(df, more, less)


def pareto_status(df: DataFrame, more: str, less: str, trap: float) -> DataFrame:
    """Adds status: 'trap' where `less` is above the limit, else 'dominated' by another row that is no trap, else 'candidate'."""
    sound = dominated(df.where(F.col(less) <= trap), more, less)
    status = F.when(F.col("dominated"), "dominated").otherwise("candidate")
    rest = df.where(~F.coalesce(F.col(less) <= trap, F.lit(False)))
    return sound.withColumn("status", status).drop("dominated").unionByName(rest.withColumn("status", F.lit("trap")))


def net_bar_returns(df: DataFrame, position: str, ret: str, half_spread: str | Column, key: str = "symbol", time: str = "ts") -> Column:
    """What the position of the bar before earns, less the half spread on each change of position at this bar.

    A null return earns nothing but a change is paid for; a null position is flat.
    """
    w = Window.partitionBy(key).orderBy(time)
    now = F.coalesce(F.col(position), F.lit(0.0))
    before = F.coalesce(F.lag(now).over(w), F.lit(0.0))
    cost = half_spread if isinstance(half_spread, Column) else F.col(half_spread)
    return before * F.coalesce(F.col(ret), F.lit(0.0)) - F.abs(now - before) * F.coalesce(cost, F.lit(0.0))


def regime_runs(df: DataFrame, label: str, confirm: int = 1, penalty: float = 0.0, key: str = "symbol", time: str = "ts") -> DataFrame:
    """Per run of a label that was traded: its return, rows, trades, purity and deepest drawdown.

    label is -1, 0 or 1 and is known at a bar's end: a bar is traded in the
    direction of the label before it, if the last `confirm` labels are equal and
    not 0, and earns direction * ln(close / open). Runs are of the shifted label;
    the first bar of a key, which has none, is a run of its own. Losses are
    multiplied by 1 + penalty. Bars without a label, open or close are left out.
    A run without a trade gives no row. purity is the share of trades that gain;
    the drawdown is that of the running return, which is 0 at bars not traded.
    """
    w = Window.partitionBy(key).orderBy(time)
    rows = df.where(F.col(label).isNotNull() & F.col("open").isNotNull() & F.col("close").isNotNull())
    rows = rows.withColumn("_side", F.lag(label).over(w))
    past = [F.lag(label, i + 1).over(w) for i in range(max(1, confirm))]
    sure = past[0] != 0
    for p in past[1:]:
        sure &= p == past[0]
    rows = rows.withColumn("_sure", F.coalesce(sure, F.lit(False)))
    raw = F.when(F.col("_sure"), F.col("_side") * ln(div("close", "open")))
    rows = rows.withColumn("_r", F.when(raw < 0, raw * (1 + penalty)).otherwise(raw))
    turn = ~F.col("_side").eqNullSafe(F.lag("_side").over(w)) | F.lag("_side").over(w).isNull()
    rows = rows.withColumn("_run", F.sum(turn.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    path = Window.partitionBy(key, "_run").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.when(F.col("_r").isNotNull(), F.sum("_r").over(path)).otherwise(0.0))
    rows = rows.withColumn("_fall", F.col("_sum") - F.max("_sum").over(path))
    found = rows.groupBy(key, F.col("_run").alias("run")).agg(
        F.first("_side", ignorenulls=True).alias("side"),
        F.min_by(label, time).alias("label"),
        F.count(F.lit(1)).alias("length"),
        F.count("_r").alias("trades"),
        F.sum("_r").alias("total"),
        F.sum((F.col("_r") > 0).cast("long")).alias("gains"),
        F.min("_fall").alias("max_drawdown"),
    )
    return found.where("trades > 0").withColumn("purity", F.col("gains") / F.col("trades")).drop("gains")


def regime_potential(runs: DataFrame, by: Sequence[str] = ("label",), whipsaw: float = 0.0) -> DataFrame:
    """Per label: runs, their returns, win rate, profit factor, dwell, purity and drawdown, and the total less whipsaw * (runs - 1)."""
    gains, losses = F.sum(F.when(F.col("total") > 0, F.col("total")).otherwise(0.0)), F.sum(F.when(F.col("total") < 0, -F.col("total")).otherwise(0.0))
    wins = F.sum((F.col("total") > 0).cast("long"))
    found = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("total").alias("total_return"),
        F.avg("total").alias("mean"),
        F.stddev_samp("total").alias("sd"),
        wins.alias("wins"),
        F.sum((F.col("total") < 0).cast("long")).alias("losses"),
        F.try_divide(gains, losses).alias("profit_factor"),
        F.avg("length").alias("avg_dwell"),
        F.avg("purity").alias("purity"),
        F.min("max_drawdown").alias("max_drawdown"),
    )
    found = found.withColumn("win_rate", F.col("wins") / F.col("runs")).withColumn("persistence", F.col("avg_dwell") * F.col("win_rate"))
    return found.withColumn("net_return", F.col("total_return") - whipsaw * F.greatest(F.col("runs") - 1, F.lit(0)))


#: What the forward axes are: trend, momentum, volatility, path and liquidity.
AXES = ("trend", "momentum", "volatility", "path", "liquidity")


def forward_axes(df: DataFrame, horizon: int, key: str = "symbol", time: str = "ts", volume: str = "volume") -> DataFrame:
    """Adds forward_* over (t, t + horizon] and baseline_*, the same over the horizon that ends at t, for every axis.

    Trend is the log return; momentum the log return in the direction of the one
    before it; volatility the root of the mean squared log return; path the net
    change over the sum of changes, null where that is 0; liquidity the volume.
    Null where a horizon is not there in full.
    """
    k, h = Keyed((key,), time), horizon
    c = F.col("close")
    df = df.withColumn("_l", ln("close")).withColumn("_d", F.abs(c - k.lag("close")))
    df = df.withColumn("_s", F.pow(F.col("_l") - k.lag("_l"), 2))
    ret = F.col("_l") - k.lag("_l", h)
    df = df.withColumn("_past", ret).withColumn("_next", k.lead("_l", h) - F.col("_l"))
    whole = lambda x, frame: F.when(F.count(x).over(frame) >= h, F.sum(x).over(frame))
    back, ahead = k.trailing(h), k.ahead(h)
    named = {
        "trend": (F.col("_next"), F.col("_past")),
        "momentum": (F.signum("_past") * F.col("_next"), F.signum(k.lag("_past", h)) * F.col("_past")),
        "volatility": (F.sqrt(whole("_s", ahead) / h), F.sqrt(whole("_s", back) / h)),
        "path": (div(F.abs(k.lead("close", h) - c), whole("_d", ahead)), div(F.abs(c - k.lag("close", h)), whole("_d", back))),
        "liquidity": (whole(volume, ahead), whole(volume, back)),
    }
    return df.select("*", *[e.alias(f"{side}_{axis}") for axis, pair in named.items() for side, e in zip(("forward", "baseline"), pair, strict=True)]).drop("_l", "_d", "_s", "_past", "_next")


def overlap(df: DataFrame, value: str, group: str, a, b, bins: int = 80) -> DataFrame:
    """One row: how much the histograms of a value in two groups overlap, 0 to 1; 1 where the values do not differ.

    Null if a group has fewer than two values.
    """
    rows = df.where(F.col(group).isin([a, b]) & F.col(value).isNotNull()).select(F.col(value).alias("_v"), (F.col(group) == a).alias("_a"))
    ends = rows.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.when(F.col("_a"), 1)).alias("_na"), F.count(F.when(~F.col("_a"), 1)).alias("_nb"))
    place = F.least(F.floor(F.try_divide((F.col("_v") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    counts = rows.crossJoin(F.broadcast(ends)).groupBy(F.coalesce(place, F.lit(0)).alias("_bin")).agg(F.count(F.when(F.col("_a"), 1)).alias("x"), F.count(F.when(~F.col("_a"), 1)).alias("y"))
    shared = counts.crossJoin(F.broadcast(ends)).agg(F.sum(F.least(F.try_divide("x", "_na"), F.try_divide("y", "_nb"))).alias("s"), F.min(F.least("_na", "_nb")).alias("n"))
    return shared.select(F.when(F.col("n") >= 2, F.col("s")).alias("overlap"))


def calibration_report(df: DataFrame, probs: str, state: str, bins: int = 10) -> DataFrame:
    """One row of chances against the true state (from 0): ECE of the top chance, Brier score, its parts, and cross-entropy.

    Rows with a null, or a state that has no chance, are left out.
    """
    p, y = F.col(probs), F.col(state).cast("int")
    rows = df.where(p.isNotNull() & y.between(0, F.size(p) - 1)).select(
        F.array_max(p).alias("top"),
        (posterior.argmax(p) == y).cast("double").alias("hit"),
        posterior.total(F.transform(p, lambda x, i: F.pow(x - (i == y).cast("double"), 2))).alias("square"),
        (-F.log(F.least(F.greatest(F.get(p, y), F.lit(1e-12)), F.lit(1.0)))).alias("nll"),
    )
    place = F.greatest(F.least(F.floor(F.col("top") * bins), F.lit(bins - 1)), F.lit(0))
    table = rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("top").alias("t"), F.sum("hit").alias("h"), F.sum("square").alias("q"), F.sum("nll").alias("l"))
    whole = table.agg(F.sum("n").alias("_n"), F.sum("h").alias("_h"))
    gap, apart = F.col("t") - F.col("h"), F.col("h") / F.col("n") - F.col("_h") / F.col("_n")
    return table.crossJoin(F.broadcast(whole)).agg(
        F.max("_n").alias("n"),
        (F.sum(F.abs(gap)) / F.max("_n")).alias("ece"),
        (F.sum("q") / F.max("_n")).alias("brier"),
        (F.sum(gap * gap / F.col("n")) / F.max("_n")).alias("reliability"),
        (F.sum(F.col("n") * apart * apart) / F.max("_n")).alias("resolution"),
        F.max(F.col("_h") / F.col("_n") * (1 - F.col("_h") / F.col("_n"))).alias("uncertainty"),
        (F.sum("l") / F.max("_n")).alias("nll"),
    )


def rank_bins(x: str, bins: int, key: str = "symbol", time: str = "ts") -> Column:
    """Bin 0 to bins - 1 by equal parts of a key's ranks of x, earlier rows first among equals."""
    w = Window.partitionBy(key)
    rank = F.row_number().over(w.orderBy(F.col(x), F.col(time)))
    return F.greatest(F.ceil((rank - 1) * bins / F.greatest(F.count(x).over(w) - 1, F.lit(1))) - 1, F.lit(0)).cast("int")
