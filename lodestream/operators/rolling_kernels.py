"""Operators whose window has no closed form in SQL: functions of the last n values of a key, and of a panel's rows.

A kernel takes all windows of a batch at once, as an array (windows, n, inputs),
and gives one row of outputs for each; undefined values are NaN there and null
in the result. sliding() runs it over a table with the memory of one Arrow batch
and one window; Rolling is the same kernel as a machine, for streams.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.functions.frames import Keyed, with_warm_up
from lodestream.operators.kernels import Machine

Kernel = Callable[[np.ndarray], np.ndarray]
#: Windows that a kernel is given at a time, and rows of a key that a task takes.
BLOCK, CHUNK_ROWS = 1024, 10_000


class Rolling(Machine):
    """A kernel of the last n rows; null until there are n."""

    def __init__(self, n: int, kernel: Kernel, outputs: str, inputs: Sequence[str]) -> None:
        self.n, self.kernel, self.outputs, self.inputs = n, kernel, outputs, inputs
        self.rows: deque[tuple[float, ...]] = deque(maxlen=n)
        self.width = outputs.count(",") + 1

    def step(self, *values: float) -> list[tuple]:
        self.rows.append(values)
        if len(self.rows) < self.n:
            return [(None,) * self.width]
        return [tuple(None if not math.isfinite(v) else float(v) for v in self.kernel(np.array(self.rows)[None])[0])]


def rolling(df: DataFrame, n: int, kernel: Kernel, outputs: str, inputs: Sequence[str], keys: Sequence[str] = ("symbol",), time: str = "ts", rows: int = CHUNK_ROWS) -> DataFrame:
    """As sliding, but a task takes a chunk of so many rows of a key, led by the n - 1 rows before it."""
    there = [F.abs(F.col(c).cast("double")) < float("inf") for c in inputs]
    sound = df.where(reduce(or_, [F.coalesce(t, F.lit(False)) for t in there])).select(*keys, time, *inputs)
    chunked, inner = with_warm_up(sound, Keyed(tuple(keys), time, tuple(inputs)), rows, n - 1)
    found = sliding(chunked, n, kernel, outputs, inputs, tuple(inner.keys), time, ("warm_up",))
    return found.where("not warm_up").drop("warm_up", "chunk")


def sliding(df: DataFrame, n: int, kernel: Kernel, outputs: str, inputs: Sequence[str], keys: Sequence[str] = ("symbol",), time: str = "ts", carry: Sequence[str] = ()) -> DataFrame:
    """keys, time, carry and the kernel's outputs over the trailing n rows of a key, null for its first n - 1 rows.

    Rows whose inputs are all null or not finite are passed over; a null beside
    other inputs is NaN to the kernel. Ties in time are broken by the inputs.
    """
    columns = [*keys, time, *carry, *inputs]
    fields = T._parse_datatype_string(outputs).fields
    schema = T.StructType([*(df.schema[c] for c in (*keys, time, *carry)), *fields])
    width = len(keys)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, current = np.empty((0, len(inputs))), None
        for batch in batches:
            values = batch[list(inputs)].to_numpy(dtype=float, na_value=np.nan)
            values = np.where(np.isfinite(values), values, np.nan)
            sound = ~np.isnan(values).all(axis=1)
            batch, values = batch[sound], values[sound]
            if not len(batch):
                continue
            key_rows = list(batch.iloc[:, :width].itertuples(index=False, name=None))
            starts = [i for i in range(len(key_rows)) if not i or key_rows[i] != key_rows[i - 1]] + [len(key_rows)]
            found = np.full((len(batch), len(fields)), np.nan)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if key_rows[a] != current:
                    tail, current = values[:0], key_rows[a]
                joined = np.concatenate((tail, values[a:b]))
                if len(joined) >= n:
                    windows = np.lib.stride_tricks.sliding_window_view(joined, n, axis=0).transpose(0, 2, 1)
                    for at in range(0, len(windows), BLOCK):
                        part = windows[at : at + BLOCK]
                        found[b - len(windows) + at : b - len(windows) + at + len(part)] = kernel(part)
                tail = joined[max(0, len(joined) - n + 1) :]
            out = batch.iloc[:, : width + 1 + len(carry)].reset_index(drop=True)
            for i, f in enumerate(fields):
                column = np.where(np.isfinite(found[:, i]), found[:, i], np.nan)
                out[f.name] = pd.Series(column).astype(object).where(~np.isnan(column), None)
            yield out

    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, time, *inputs).mapInPandas(stream, schema)


def each(one: Callable[[np.ndarray], Sequence[float | None]]) -> Kernel:
    """A kernel from a function of one window."""

    def run(windows: np.ndarray) -> np.ndarray:
        return np.array([[np.nan if v is None else v for v in one(w)] for w in windows], dtype=float)

    return run


# one series


def hurst(windows: np.ndarray) -> np.ndarray:
    """Slope of log rescaled range on log length, over halved lengths of at least 8."""
    x = windows[:, :, 0]
    m, whole = x.shape
    logs, n = [], whole
    while n >= 8:
        parts = x[:, : whole // n * n].reshape(m, -1, n)
        sd = parts.std(axis=2)
        path = np.cumsum(parts - parts.mean(axis=2, keepdims=True), axis=2)
        scaled = np.where(sd > 0, (path.max(axis=2) - path.min(axis=2)) / np.where(sd > 0, sd, 1), 0.0)
        held = (sd > 0).sum(axis=1)
        mean = scaled.sum(axis=1) / np.maximum(held, 1)
        logs.append((math.log(n), np.where((held > 0) & (mean > 0), np.log(np.where(mean > 0, mean, 1)), np.nan)))
        n //= 2
    if len(logs) < 2:
        return np.full((m, 1), np.nan)
    a, b = np.array([v for v, _ in logs]), np.stack([v for _, v in logs], axis=1)
    there = ~np.isnan(b)
    k = there.sum(axis=1)
    mean_a = (there * a).sum(axis=1) / np.maximum(k, 1)
    mean_b = np.nansum(b, axis=1) / np.maximum(k, 1)
    da = there * (a - mean_a[:, None])
    spread = (da * da).sum(axis=1)
    slope = (da * np.where(there, b - mean_b[:, None], 0.0)).sum(axis=1) / np.where(spread > 0, spread, 1)
    return np.where((k >= 2) & (spread > 0), slope, np.nan)[:, None]


def autocorrelations(x: np.ndarray, lags: int) -> np.ndarray:
    """Of every row of x, lags 1 to `lags`; 0 for a flat row."""
    d = x - x.mean(axis=-1, keepdims=True)
    total = (d * d).sum(axis=-1)
    return np.stack([np.where(total > 0, (d[..., k:] * d[..., :-k]).sum(axis=-1) / np.where(total > 0, total, 1), 0.0) for k in range(1, lags + 1)], axis=-1)


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series or continued fraction."""
    if x <= 0:
        return 0.0
    head = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return total * head
    b = x + 1 - a
    c, d = 1e300, 1 / b
    f, i = d, 0
    while True:
        i += 1
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            return 1 - head * f


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    head = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    f = d
    for m in range(1, 500):
        for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + part * d or 1e-300)
            c = 1 + part / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return head * f


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_cdf(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 0.0


def ljung_box(lags: int) -> Kernel:
    """The Q statistic of a window's autocorrelations and its p value."""

    def run(windows: np.ndarray) -> np.ndarray:
        x = windows[:, :, 0]
        n, r = x.shape[1], autocorrelations(x, lags)
        q = n * (n + 2) * (r**2 / (n - np.arange(1, lags + 1))).sum(axis=1)
        return np.stack((q, [1 - gamma_cdf(lags / 2, v / 2) for v in q.tolist()]), axis=1)

    return run


def runs_test(windows: np.ndarray) -> np.ndarray:
    """z of the number of runs of signs; zeros are left out."""
    s = np.sign(windows[:, :, 0])
    up, down = (s > 0).sum(axis=1).astype(float), (s < 0).sum(axis=1).astype(float)
    n = up + down
    last = np.maximum.accumulate(np.where(s != 0, np.arange(s.shape[1]), -1), axis=1)
    before = np.concatenate((np.full((len(s), 1), -1), last[:, :-1]), axis=1)
    turned = (s != 0) & (before >= 0) & (np.take_along_axis(s, np.maximum(before, 0), axis=1) != s)
    sound = (up > 0) & (down > 0) & (n >= 3)
    k = np.where(sound, n, 3)
    spread = 2 * up * down * (2 * up * down - k) / (k * k * (k - 1))
    sound &= spread > 0
    return np.where(sound, (1 + turned.sum(axis=1) - 1 - 2 * up * down / k) / np.sqrt(np.where(sound, spread, 1)), np.nan)[:, None]


def word_entropy(length: int) -> Kernel:
    """Entropy of up/down words of so many steps, over its greatest, and the mutual information of a step and the word before it."""

    def run(windows: np.ndarray) -> np.ndarray:
        up = (np.diff(windows[:, :, 0], axis=1) > 0).astype(np.int64)
        words = sum(up[:, i : up.shape[1] - length + 1 + i] << i for i in range(length))
        share = (words[:, :, None] == np.arange(1 << length)).mean(axis=1)
        entropy = -np.where(share > 0, share * np.log2(np.where(share > 0, share, 1)), 0).sum(axis=1) / length
        pairs = up[:, length:] + 2 * words[:, :-1]
        joint = (pairs[:, :, None] == np.arange(2 << length)).mean(axis=1).reshape(len(up), -1, 2)
        alone = joint.sum(axis=1, keepdims=True) * joint.sum(axis=2, keepdims=True)
        shared = np.where(joint > 0, joint * np.log(np.where(joint > 0, joint / np.where(alone > 0, alone, 1), 1)), 0).sum(axis=(1, 2))
        return np.stack((entropy, shared), axis=1)

    return run


def zigzag_density(threshold: float) -> Kernel:
    """Turns of more than the threshold per row of the window."""

    def run(windows: np.ndarray) -> np.ndarray:
        x = windows[:, :, 0]
        side, extreme, turns = np.zeros(len(x)), x[:, 0].copy(), np.zeros(len(x))
        for p in x[:, 1:].T:  # one step of all windows at a time
            begun = (side == 0) & (np.abs(p / extreme - 1) > threshold)
            turned = (side != 0) & (side * (p - extreme) <= 0) & (side * (extreme - p) > threshold * extreme)
            further = begun | turned | ((side != 0) & (side * (p - extreme) > 0))
            side = np.where(begun, np.where(p > extreme, 1, -1), np.where(turned, -side, side))
            turns += turned
            extreme = np.where(further, p, extreme)
        return (turns / x.shape[1])[:, None]

    return run


def savitzky_golay(n: int, order: int) -> list[float]:
    """Weights of the last n values, oldest first: the last value of a polynomial fitted to them."""
    t = np.linspace(-1, 0, n)
    return np.linalg.pinv(np.vander(t, order + 1))[-1].tolist()


# two series


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks along the last axis; NaN is not ranked."""
    less = (x[..., None, :] < x[..., :, None]).sum(axis=-1)
    equal = (x[..., None, :] == x[..., :, None]).sum(axis=-1)
    return np.where(np.isnan(x), np.nan, less + (equal + 1) / 2)


def _pearson(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Along the last axis, over pairs without NaN; NaN where a side is flat."""
    n = np.maximum((~np.isnan(a)).sum(axis=-1), 1)
    a, b = (v - (np.nansum(v, axis=-1) / n)[..., None] for v in (a, b))
    a, b = np.nan_to_num(a), np.nan_to_num(b)
    spread = np.sqrt((a * a).sum(axis=-1) * (b * b).sum(axis=-1))
    return np.where(spread > 1e-12, (a * b).sum(axis=-1) / np.where(spread > 1e-12, spread, 1), np.nan)


def rank_correlation(windows: np.ndarray) -> np.ndarray:
    both = np.where(np.isnan(windows).any(axis=2, keepdims=True), np.nan, windows)
    out = np.empty((len(windows), 1))
    for at in range(0, len(windows), 64):  # comparisons of all pairs of a window
        part = both[at : at + 64]
        out[at : at + 64, 0] = _pearson(ranks(part[:, :, 0]), ranks(part[:, :, 1]))
    return out


def rolling_rank_correlation(n: int) -> Kernel:
    """0 where a side is flat, null where fewer than half of the pairs are there."""

    def run(windows: np.ndarray) -> np.ndarray:
        there = (~np.isnan(windows).any(axis=2)).sum(axis=1)
        found = rank_correlation(windows)[:, 0]
        return np.where(there >= n // 2, np.nan_to_num(found), np.nan)[:, None]

    return run


def spread_deviation(windows: np.ndarray) -> np.ndarray:
    """Last residual of the first series on the second, in standard errors."""
    y, x = windows[:, :, 0], windows[:, :, 1]
    dy, dx = y - y.mean(axis=1, keepdims=True), x - x.mean(axis=1, keepdims=True)
    spread = (dx * dx).sum(axis=1)
    flat = spread <= 1e-18
    rest = dy - ((dx * dy).sum(axis=1) / np.where(flat, 1, spread))[:, None] * dx
    s = np.sqrt((rest * rest).sum(axis=1) / max(1, y.shape[1] - 2))
    found = np.where(s > 1e-12, rest[:, -1] / np.where(s > 1e-12, s, 1), 0.0)
    return np.where(flat, np.nan, found)[:, None]


def purified(trend: int, accel: int, vol: int) -> Kernel:
    """Last residual of the first series on trend, acceleration and volatility of the second, over the window."""

    def run(window: np.ndarray) -> tuple[float | None]:
        y, x = window[:, 0], window[:, 1]
        first = max(trend, accel, vol)
        rows = []
        for i in range(first, len(x)):
            line, curve = x[i - trend : i + 1], x[i - accel : i + 1]
            mid = (curve[0] + curve[-1]) / 2 - curve[len(curve) // 2]
            rows.append((1.0, x[i], line[-1] - line[0], mid, x[i - vol : i + 1].std()))
        design, target = np.array(rows), y[first:]
        fit = np.linalg.lstsq(design, target, rcond=None)[0]
        rest = target - design @ fit
        s = rest.std()
        return (float(rest[-1] / s) if s > 1e-12 else 0.0,)

    return each(run)


# panels: one row per time, a column per market


def panel_risk(fraction: float) -> Kernel:
    """Of the window's log returns: the share of variance in the largest eigenvalues, their concentration
    (coherence) and the F chance of the last row's distance from the mean, as log odds."""

    def run(window: np.ndarray) -> tuple[float | None, ...]:
        r = np.diff(np.log(window), axis=0)
        n, m = r.shape
        past, last = r[:-1], r[-1]
        cov = np.cov(r, rowvar=False)
        values = np.sort(np.linalg.eigvalsh(cov))[::-1]
        total = values.sum()
        top = max(1, round(fraction * m))
        sd = np.sqrt(np.diag(cov))
        if total <= 0 or (sd <= 0).any():
            return None, None, None
        spectrum = np.sort(np.linalg.eigvalsh(cov / np.outer(sd, sd)))[::-1]
        weights = 1 - 2 * np.arange(m) / max(1, m - 1)
        gap = last - past.mean(axis=0)
        distance = float(gap @ np.linalg.lstsq(np.cov(past, rowvar=False), gap, rcond=None)[0])
        k = len(past)
        chance = f_cdf(distance * k * (k - m) / (m * (k - 1) * (k + 1)), m, k - m) if k > m else 0.5
        chance = min(max(chance, 1e-12), 1 - 1e-12)
        return float(values[:top].sum() / total), float((spectrum * weights).sum() / m), math.log(chance / (1 - chance))

    return each(run)


class RelativeStrength(Machine):
    """Panel relative strength: a market's summed excess over the cross-section's median return, over `lookback` rows,
    as fractiles; the index of median returns; and the equity of next row's return of the leader and the laggard."""

    def __init__(self, markets: Sequence[str], lookback: int) -> None:
        self.inputs, self.lookback = markets, lookback
        self.outputs = "market_index double, leader string, laggard string, leader_equity double, laggard_equity double, strength_spread double, fractiles array<double>"
        self.past: deque[np.ndarray] = deque(maxlen=lookback)
        self.before: np.ndarray | None = None
        self.index = self.lead = self.lag = 0.0
        self.picked: tuple[int, int] | None = None

    def step(self, *prices: float) -> list[tuple]:
        now = np.log(np.array(prices))
        if self.before is None:
            self.before = now
            return []
        r, self.before = now - self.before, now
        middle = float(np.median(r))
        self.index += middle
        if self.picked:
            self.lead += r[self.picked[0]]
            self.lag += r[self.picked[1]]
        self.past.append(r - middle)
        if len(self.past) < self.lookback:
            return []
        strength = np.sum(self.past, axis=0)
        order = np.argsort(strength, kind="stable")
        fractile = np.empty(len(r))
        fractile[order] = np.arange(len(r)) / max(1, len(r) - 1)
        self.picked = int(order[-1]), int(order[0])
        return [(self.index, self.inputs[order[-1]], self.inputs[order[0]], self.lead, self.lag, float(strength.max() - strength.min()), fractile.tolist())]
