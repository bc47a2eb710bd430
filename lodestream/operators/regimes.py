"""State probabilities and labels over time: smoothing, gates, filters of labels, decoding, fitting and health checks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import posterior
from lodestream.functions.frames import Keyed, running
from lodestream.operators.kernels import Machine

# native: arrays and windows


def flip_rate(k: Keyed, state: str, n: int) -> Column:
    """Share of changes of the state over the trailing n rows; state changes are given as 0 or 1."""
    return F.avg(state).over(k.trailing(n))


def posterior_dynamics(df: DataFrame, probs: str, k: Keyed, n: int) -> DataFrame:
    """Adds state, flip, flip_rate, entropy, entropy_sd, top_sd and dwell (rows in the current state so far)."""
    p = F.col(probs)
    df = df.withColumn("state", posterior.argmax(p)).withColumn("entropy", posterior.entropy(p)).withColumn("top", F.array_max(p))
    df = df.withColumn("flip", F.coalesce((F.col("state") != k.lag("state")).cast("int"), F.lit(0)))
    df = df.withColumn("run", F.sum("flip").over(k.so_far))
    dwell = F.row_number().over(Keyed([*k.keys, "run"], k.time, k.more).ordered)
    return df.select(
        "*", F.avg("flip").over(k.trailing(n)).alias("flip_rate"), F.stddev_pop("entropy").over(k.trailing(n)).alias("entropy_sd"), F.stddev_pop("top").over(k.trailing(n)).alias("top_sd"), dwell.alias("dwell")
    ).drop("run")


def gated(df: DataFrame, probs: str, k: Keyed, top: float, margin: float, entropy: float, hold: bool = True, flat: int = -1) -> DataFrame:
    """Adds gated_state: the likeliest state where chance, margin and entropy (over its greatest) pass; else the last one that did, or flat."""
    p = F.col(probs)
    states = F.size(p)
    open_ = (F.array_max(p) >= top) & (posterior.margin(p) >= margin) & (posterior.entropy(p) <= entropy * F.log(states.cast("double")))
    df = df.withColumn("_s", F.when(open_, posterior.argmax(p)))
    held = F.last("_s", ignorenulls=True).over(k.so_far) if hold else F.col("_s")
    return df.withColumn("gated_state", F.coalesce(held, F.lit(flat))).drop("_s")


def matured(df: DataFrame, probs: str, k: Keyed, lag: int, states: int) -> DataFrame:
    """Adds matured: the posterior that was available, `lag` rows old; uniform before there is one."""
    even = F.array(*[F.lit(1.0 / states)] * states)
    return df.withColumn("matured", F.coalesce(F.lag(probs, lag).over(k.ordered), even))


def tempered(probs: Column, temperature: float) -> Column:
    """Chances to the power 1 / temperature, on the simplex again."""
    return posterior.normalise(F.transform(probs, lambda x: F.pow(F.greatest(x, F.lit(1e-12)), 1 / temperature)))


def calibration(df: DataFrame, chance: str, hit: str, bins: int) -> DataFrame:
    """Per bin of the chance: rows, mean chance, hit rate and their gap; bins are equal in width."""
    place = F.least(F.floor(F.col(chance) * bins), F.lit(bins - 1)).cast("int")
    table = df.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(chance).alias("chance"), F.avg(hit).alias("rate"))
    return table.withColumn("gap", F.abs(F.col("chance") - F.col("rate")))


def kolmogorov_smirnov(df: DataFrame, value: str, group: str, a, b, keys: Sequence[str] = ()) -> DataFrame:
    """Largest distance between the distributions of a value in two groups, per key.

    Values are counted before the running sums, which are taken in two levels:
    ties and repeats cost nothing, and no task has all values of a key.
    """
    counts = df.where(F.col(group).isin([a, b]) & F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.when(F.col(group) == a, 1)).alias("na"), F.count(F.when(F.col(group) == b, 1)).alias("nb"))
    placed = running(counts, value, {"na": "na", "nb": "nb"}, keys)
    share = lambda n: F.try_divide(F.col(f"{n}_before") + F.col(n), F.col(f"{n}_all"))
    return placed.select(*keys, F.abs(share("na") - share("nb")).alias("gap")).groupBy(*keys).agg(F.max("gap").alias("ks"))


def hac_variance(df: DataFrame, x: str, k: Keyed, bandwidth: int) -> DataFrame:
    """Newey-West variance of the sum of x per key: products with lagged x under Bartlett weights."""
    centred = df.where(F.col(x).isNotNull()).withColumn("_x", F.col(x) - F.avg(x).over(k.all))
    own = F.col("_x") * F.col("_x")
    lagged = [2 * (1 - i / (bandwidth + 1)) * F.coalesce(F.col("_x") * F.lag("_x", i).over(k.ordered), F.lit(0.0)) for i in range(1, bandwidth + 1)]
    return centred.withColumn("_p", sum(lagged, own)).groupBy(*k.keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_p").alias("variance"))


def beta_timing(df: DataFrame, position: str, ret: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The gross return as that of the mean exposure and that of moving it."""
    p, r = F.col(position), F.col(ret)
    found = df.where(p.isNotNull() & r.isNotNull()).groupBy(*keys).agg(F.sum(p * r).alias("total"), F.avg(p).alias("mean_exposure"), F.sum(r).alias("_r"))
    return found.withColumn("beta", F.col("mean_exposure") * F.col("_r")).withColumn("timing", F.col("total") - F.col("beta")).drop("_r")


# machines


class SmoothedPosterior(Machine):
    """Exponential mean of posteriors, on the simplex; the chances are given as columns."""

    outputs = "smoothed array<double>"

    def __init__(self, columns: Sequence[str], alpha: float = 0.2) -> None:
        self.inputs, self.alpha, self.held = columns, alpha, None

    def step(self, *p: float) -> list[tuple]:
        self.held = list(p) if self.held is None else [h + self.alpha * (x - h) for h, x in zip(self.held, p, strict=True)]
        total = sum(self.held)
        return [([h / total for h in self.held],)]


class Hysteresis(Machine):
    """A state is left when its chance falls under `leave` and another has been over `enter` for so many rows."""

    outputs = "filtered int"

    def __init__(self, columns: Sequence[str], enter: float = 0.6, leave: float = 0.4, rows: int = 2) -> None:
        self.inputs, self.enter, self.leave, self.rows = columns, enter, leave, rows
        self.state, self.asked, self.count = None, None, 0

    def step(self, *p: float) -> list[tuple]:
        best = max(range(len(p)), key=p.__getitem__)
        if self.state is None:
            self.state = best
        elif best != self.state and p[best] >= self.enter:
            self.count = self.count + 1 if best == self.asked else 1
            self.asked = best
            if p[self.state] < self.leave and self.count >= self.rows:
                self.state, self.asked, self.count = best, None, 0
        else:
            self.asked, self.count = None, 0
        return [(self.state,)]


class LeastDuration(Machine):
    """A change of label counts once the new label has lasted so many rows, and not sooner after the last change."""

    outputs = "filtered int"

    def __init__(self, label: str, rows: int, rest: int = 0) -> None:
        self.inputs, self.rows, self.rest = (label,), rows, rest
        self.held, self.asked, self.count, self.since = None, None, 0, 0

    def step(self, label: float) -> list[tuple]:
        label = int(label)
        self.since += 1
        if self.held is None:
            self.held = label
        elif label == self.held:
            self.asked, self.count = None, 0
        else:
            self.count = self.count + 1 if label == self.asked else 1
            self.asked = label
            if self.count >= self.rows and self.since > self.rest:
                self.held, self.asked, self.count, self.since = label, None, 0, 0
        return [(self.held,)]


def viterbi(logs: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The likeliest state sequence from log emission chances (rows, states)."""
    n, k = logs.shape
    score, back = np.log(start) + logs[0], np.zeros((n, k), int)
    cost = np.log(moves)
    for t in range(1, n):
        step = score[:, None] + cost
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + logs[t]
    path = np.empty(n, int)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def fit_chain(x: np.ndarray, states: int, steps: int = 60, tol: float = 1e-7) -> dict[str, np.ndarray]:
    """Normal hidden Markov model by expectation maximisation; states by rising deviation.

    Starts from the values' quantiles of distance from the mean, so reruns agree.
    """
    order = np.argsort(np.abs(x - x.mean()), kind="stable")
    means, sds = np.empty(states), np.empty(states)
    for i, part in enumerate(np.array_split(x[order], states)):
        means[i], sds[i] = part.mean(), max(part.std(), 1e-6)
    moves = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    moves /= moves.sum(axis=1, keepdims=True)
    start, last = np.full(states, 1 / states), -np.inf
    for _ in range(steps):
        logs = -0.5 * ((x[:, None] - means) / sds) ** 2 - np.log(sds) - 0.5 * math.log(2 * math.pi)
        top = logs.max(axis=1, keepdims=True)
        like = np.exp(logs - top)
        n = len(x)
        fwd, scale = np.empty((n, states)), np.empty(n)
        p = start * like[0]
        for t in range(n):
            if t:
                p = (fwd[t - 1] @ moves) * like[t]
            scale[t] = p.sum()
            fwd[t] = p / scale[t]
        bwd = np.ones((n, states))
        for t in range(n - 2, -1, -1):
            bwd[t] = moves @ (like[t + 1] * bwd[t + 1]) / scale[t + 1]
        gamma = fwd * bwd
        gamma /= gamma.sum(axis=1, keepdims=True)
        pairs = moves * (fwd[:-1].T @ (like[1:] * bwd[1:] / scale[1:, None]))
        total = float(np.log(scale).sum() + top.sum())
        start, moves = gamma[0] + 1e-12, pairs + 1e-12
        start, moves = start / start.sum(), moves / moves.sum(axis=1, keepdims=True)
        weight = gamma.sum(axis=0) + 1e-12
        means = gamma.T @ x / weight
        sds = np.sqrt(np.maximum((gamma * (x[:, None] - means) ** 2).sum(axis=0) / weight, 1e-12))
        if total - last < tol * abs(total):
            break
        last = total
    rank = np.argsort(sds, kind="stable")
    return {"start": start[rank], "moves": moves[np.ix_(rank, rank)], "means": means[rank], "sds": sds[rank], "loglik": np.array(total)}


def fit_chains(df: DataFrame, x: str, states: int, key: str = "symbol", time: str = "ts", most: int | None = None) -> DataFrame:
    """A hidden Markov model per key: one row per state with its mean, deviation, row of moves, and the key's log likelihood.

    A fit takes all rows of a key, which meet in one task. With `most` it takes
    the last so many: a training window that the caller chooses.
    """
    window = df.where(F.col(x).isNotNull()).select(key, time, x)
    if most is not None:
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc()))
        window = window.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values(time)[x].to_numpy(float)
        columns = [key, "state", "mean", "sd", "moves", "loglik"]
        if len(values) < 10 * states:
            return pd.DataFrame(columns=columns)
        m = fit_chain(values, states)
        return pd.DataFrame([(rows[key].iloc[0], i, m["means"][i], m["sds"][i], m["moves"][i].tolist(), float(m["loglik"])) for i in range(states)], columns=columns)

    return window.groupBy(key).applyInPandas(fit, f"{key} string, state int, mean double, sd double, moves array<double>, loglik double")


def circular_shift_null(df: DataFrame, position: str, ret: str, shifts: int, key: str = "symbol", time: str = "ts", seed: int = 0) -> DataFrame:
    """Net return per key and the share of circular shifts of the positions that earn as much.

    The shifted products come from one Fourier transform per key, so every shift
    costs no more than a few; `shifts` of them are drawn.
    """

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time)
        p, r = rows[position].to_numpy(float), rows[ret].to_numpy(float)
        sums = np.fft.irfft(np.conj(np.fft.rfft(p)) * np.fft.rfft(r), len(p))
        drawn = np.random.default_rng(seed).integers(1, len(p), shifts) if len(p) > 1 else np.zeros(shifts, int)
        share = float((np.round(sums[drawn], 9) >= round(float(p @ r), 9)).mean())
        return pd.DataFrame({key: [rows[key].iloc[0]], "total": [float(p @ r)], "p_value": [share]})

    sound = df.where(F.col(position).isNotNull() & F.col(ret).isNotNull()).select(key, time, position, ret)
    return sound.groupBy(key).applyInPandas(test, f"{key} string, total double, p_value double")
