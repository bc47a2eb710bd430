"""Sequential operators: machines that take a key's rows in time order, one at a time.

In a batch, rows are sorted within partitions and streamed through mapInPandas,
so a key of any length needs the memory of one Arrow batch and one machine. The
same machines run in Structured Streaming (lodestream.streaming), their state
kept between micro-batches.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Machine:
    """step takes the input columns of a row and returns the output rows, each a tuple."""

    inputs: Sequence[str] = ("close",)
    outputs: str = ""
    #: Whether it has a rule of its own for rows that come late or twice, and so sees them in a stream.
    own_time: bool = False

    def step(self, *values: float) -> list[tuple]:
        raise NotImplementedError


def run(df: DataFrame, make: Callable[[], Machine], keys: Sequence[str] = ("symbol",), time: str = "ts") -> DataFrame:
    """keys, time and the machine's outputs, for each output row at the time of its input row.

    Rows with a null or non-finite input are passed over. Ties in time are
    broken by the inputs, so that reruns agree.
    """
    probe = make()
    columns = [*keys, time, *probe.inputs]
    schema = T.StructType([*(df.schema[c] for c in (*keys, time)), *T._parse_datatype_string(probe.outputs).fields])
    width = len(keys)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, current = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                key, values = row[:width], row[width + 1 :]
                if machine is None or key != current:
                    machine, current = make(), key
                if all(v is not None and math.isfinite(v) for v in values):
                    out += [(*key, row[width], *made) for made in machine.step(*values)]
            yield pd.DataFrame(out, columns=schema.names)

    return df.select(*columns).repartition(*keys).sortWithinPartitions(*columns).mapInPandas(stream, schema)


class TrendFlip(Machine):
    """Continuous trend labels: 1 or -1 from the first move beyond omega on, 0 before; a retrace beyond omega flips."""

    outputs = "label int"

    def __init__(self, omega: float) -> None:
        self.omega, self.side, self.start, self.extreme = omega, 0, None, 0.0

    def step(self, price: float) -> list[tuple]:
        if self.start is None:
            self.start = price
        elif self.side == 0:
            if abs(price - self.start) > self.start * self.omega:
                self.side, self.extreme = (1 if price > self.start else -1), price
        elif (price - self.extreme) * self.side > 0:
            self.extreme = price
        elif (self.extreme - price) * self.side > self.extreme * self.omega:
            self.side, self.extreme = -self.side, price
        return [(self.side,)]


class DirectionalChange(Machine):
    """Completed trends: a row when a change of theta (alpha theta downwards) confirms the end of a trend."""

    outputs = "direction int, start_price double, start_pos long, end_price double, end_pos long, confirm_price double, confirm_pos long, tmv double, t long, r double"

    def __init__(self, theta: float, alpha: float = 1.0) -> None:
        self.theta, self.down, self.side, self.n = theta, alpha * theta, 0, 0
        self.high = self.low = self.extreme = self.start = (0.0, 0)

    def step(self, price: float) -> list[tuple]:
        here, self.n = (price, self.n), self.n + 1
        if here[1] == 0:
            self.high = self.low = self.start = here
            return []
        if self.side == 0:
            self.high, self.low = max(self.high, here, key=lambda x: x[0]), min(self.low, here, key=lambda x: x[0])
            if price <= self.high[0] * (1 - self.down):
                self.side, self.start, self.extreme = -1, self.high, here
            elif price >= self.low[0] * (1 + self.theta):
                self.side, self.start, self.extreme = 1, self.low, here
            return []
        if (price - self.extreme[0]) * self.side > 0:
            self.extreme = here
        turned = price <= self.extreme[0] * (1 - self.down) if self.side > 0 else price >= self.extreme[0] * (1 + self.theta)
        if not turned:
            return []
        tmv = self.side * (self.extreme[0] - self.start[0]) / self.start[0] / self.theta
        t = self.extreme[1] - self.start[1]
        done = (self.side, *self.start, *self.extreme, *here, tmv, t, tmv * self.theta / t if t else None)
        self.side, self.start, self.extreme = -self.side, self.extreme, here
        return [done]


class CusumEvents(Machine):
    """A row when either one-sided sum of the input reaches the threshold; both then start again."""

    inputs = ("ret",)
    outputs = "side int"

    def __init__(self, threshold: float) -> None:
        self.threshold, self.up, self.down = threshold, 0.0, 0.0

    def step(self, x: float) -> list[tuple]:
        self.up, self.down = max(0.0, self.up + x), min(0.0, self.down + x)
        side = 1 if self.up >= self.threshold else -1 if self.down <= -self.threshold else 0
        if side:
            self.up = self.down = 0.0
        return [(side,)] if side else []


class Reference(Protocol):
    """What a CUSUM takes for normal: a score for each direction, from which the sums rise."""

    def score(self, x: float) -> Sequence[float]:
        """Scores of x, one for each direction, from the values before it."""
        ...

    def update(self, x: float) -> None:
        """Learn from x, after it was scored."""
        ...


class NormalReference:
    """Two directions: standardised values less a slack, up and down."""

    def __init__(self, mean: float, sd: float, slack: float) -> None:
        self.mean, self.sd, self.slack = mean, sd, slack

    def score(self, x: float) -> Sequence[float]:
        z = (x - self.mean) / self.sd
        return z - self.slack, -z - self.slack

    def update(self, x: float) -> None:
        pass


class AdaptiveReference(NormalReference):
    """The same against an exponential mean and deviation of the values so far."""

    def __init__(self, mean: float, sd: float, slack: float, weight: float = 0.02) -> None:
        super().__init__(mean, sd, slack)
        self.weight, self.variance = weight, sd * sd

    def update(self, x: float) -> None:
        gap = x - self.mean
        self.mean += self.weight * gap
        self.variance = (1 - self.weight) * (self.variance + self.weight * gap * gap)
        self.sd = math.sqrt(max(self.variance, 1e-24))


class CusumStatistic(Machine):
    """One-sided sums of a reference's scores, which never fall below 0."""

    inputs = ("ret",)
    outputs = "s_up double, s_down double"

    def __init__(self, reference: Reference) -> None:
        self.reference, self.sums = reference, [0.0, 0.0]

    def step(self, x: float) -> list[tuple]:
        self.sums = [max(0.0, s + v) for s, v in zip(self.sums, self.reference.score(x), strict=True)]
        self.reference.update(x)
        return [tuple(self.sums)]


class Means(Machine):
    """Exponential means of several spans (first value as seed), the difference of the first two and its signal line."""

    outputs = "fast double, slow double, macd double, signal double"

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9) -> None:
        self.weights = [2 / (n + 1) for n in (fast, slow, signal)]
        self.values: list[float] | None = None

    def step(self, x: float) -> list[tuple]:
        if self.values is None:
            self.values = [x, x, 0.0]
        else:
            f, s, g = self.values
            f, s = f + self.weights[0] * (x - f), s + self.weights[1] * (x - s)
            self.values = [f, s, g + self.weights[2] * (f - s - g)]
        f, s, g = self.values
        return [(f, s, f - s, g)]


class Exponential(Machine):
    """Exponential means {name: (column, span)}, each starting from its column's first value."""

    def __init__(self, means: dict[str, tuple[str, int]]) -> None:
        self.inputs = list(dict.fromkeys(column for column, _ in means.values()))
        self.outputs = ", ".join(f"{name} double" for name in means)
        self.steps = [(self.inputs.index(column), 2 / (span + 1)) for column, span in means.values()]
        self.values: list[float] | None = None

    def step(self, *x: float) -> list[tuple]:
        if self.values is None:
            self.values = [x[i] for i, _ in self.steps]
        else:
            self.values = [v + a * (x[i] - v) for v, (i, a) in zip(self.values, self.steps, strict=True)]
        return [tuple(self.values)]


class Wilder(Machine):
    """Average true range, relative strength and directional index by Wilder's smoothing; null while they warm up."""

    inputs = ("high", "low", "close")
    outputs = "atr double, rsi double, plus_di double, minus_di double, adx double"

    def __init__(self, n: int = 14) -> None:
        self.n, self.k, self.last = n, 0, None
        self.sums = [0.0] * 5  # true range, gain, loss, up move, down move
        self.dx, self.dx_rows = 0.0, 0

    def step(self, high: float, low: float, close: float) -> list[tuple]:
        before, self.last = self.last, (high, low, close)
        if before is None:
            return [(None,) * 5]
        up, down, change = high - before[0], before[1] - low, close - before[2]
        now = (max(high, before[2]) - min(low, before[2]), max(change, 0.0), max(-change, 0.0), up if up > max(down, 0.0) else 0.0, down if down > max(up, 0.0) else 0.0)
        self.k += 1
        if self.k <= self.n:  # the first n rows seed the sums
            self.sums = [s + x for s, x in zip(self.sums, now, strict=True)]
            if self.k < self.n:
                return [(None,) * 5]
        else:
            self.sums = [s - s / self.n + x for s, x in zip(self.sums, now, strict=True)]
        tr, gain, loss, plus, minus = self.sums
        rsi = 100 * gain / (gain + loss) if gain + loss > 0 else 50.0
        p, m = (100 * plus / tr, 100 * minus / tr) if tr > 0 else (0.0, 0.0)
        dx = 100 * abs(p - m) / (p + m) if p + m > 0 else 0.0
        self.dx_rows += 1
        self.dx = self.dx + dx / self.n if self.dx_rows <= self.n else (self.dx * (self.n - 1) + dx) / self.n
        return [(tr / self.n, rsi, p, m, self.dx if self.dx_rows >= self.n else None)]


class SeededStrength(Machine):
    """Relative strength whose sums start from the mean of the first n - 1 changes; null for the first n rows."""

    outputs = "rsi double"

    def __init__(self, n: int = 14) -> None:
        self.n, self.rows, self.before, self.up, self.down = n, 0, 0.0, 0.0, 0.0

    def step(self, price: float) -> list[tuple]:
        change, self.before, self.rows = price - self.before if self.rows else 0.0, price, self.rows + 1
        up, down, n = max(change, 0.0), max(-change, 0.0), self.n
        if self.rows <= n:
            self.up, self.down = self.up + up, self.down + down
            if self.rows == n and n > 1:
                self.up, self.down = self.up / (n - 1), self.down / (n - 1)
            return [(None,)]
        self.up, self.down = self.up * (n - 1) / n + up / n, self.down * (n - 1) / n + down / n
        return [(100 * self.up / (self.up + self.down + 1e-60),)]


class EwmaVolatility(Machine):
    """Root of the exponential mean of squared log returns; starts at 0, null for the first half span."""

    outputs = "vol double"

    def __init__(self, span: int = 100) -> None:
        self.weight, self.skip = 2 / (span + 1), span // 2
        self.before, self.variance, self.n = None, 0.0, 0

    def step(self, price: float) -> list[tuple]:
        self.n += 1
        if self.before is not None:
            r = math.log(price / self.before)
            self.variance += self.weight * (r * r - self.variance)
        self.before = price
        return [(math.sqrt(self.variance) if self.n > self.skip and self.n > 1 else None,)]


class Kalman(Machine):
    """Local level filter."""

    outputs = "level double"

    def __init__(self, process: float = 0.1, noise: float = 1.0, error: float = 1.0) -> None:
        self.process, self.noise, self.error, self.level = process, noise, error, None

    def step(self, x: float) -> list[tuple]:
        if self.level is None:
            self.level = x
        else:
            spread = self.error + self.process
            gain = spread / (spread + self.noise)
            self.level, self.error = self.level + gain * (x - self.level), (1 - gain) * spread
        return [(self.level,)]


class Bricks(Machine):
    """Renko: a row for each brick of a fixed size that a bar's high or low fills, upward ones first.

    The first level is the first close, rounded to a brick (half to even). The
    volume since the last brick goes to the first brick of a bar.
    """

    inputs = ("high", "low", "close", "volume")
    outputs = "brick_num long, direction int, brick_open double, brick_close double, brick_volume double"

    def __init__(self, size: float) -> None:
        self.size, self.level, self.made, self.volume = size, None, 0, 0.0

    def step(self, high: float, low: float, close: float, volume: float) -> list[tuple]:
        if self.level is None:
            self.level = round(close / self.size)
        self.volume += volume
        top = max(self.level, math.floor(high / self.size))
        bottom = min(top, math.ceil(low / self.size))
        moves = [(1, i) for i in range(self.level, top)] + [(-1, i) for i in range(top, bottom, -1)]
        out = []
        for side, i in moves:
            out.append((self.made, side, i * self.size, (i + side) * self.size, self.volume))
            self.made, self.volume = self.made + 1, 0.0
        self.level = bottom
        return out


class GapBars(Machine):
    """Bars of a period from bars of a shorter one; given out when the next period opens.

    A repeated time is passed over. After a gap of more than `gap` seconds, or a
    time before the last one, what was gathered is dropped and a new bar begun.
    samples counts the short bars; partial tells that there were fewer than
    expected.
    """

    inputs = ("epoch", "open", "high", "low", "close", "volume")
    own_time = True
    outputs = "bar_start long, bar_open double, bar_high double, bar_low double, bar_close double, bar_volume double, samples int, partial boolean"

    def __init__(self, seconds: int, every: int, gap: int = 60) -> None:
        self.seconds, self.expected, self.gap = seconds, seconds // every, max(gap, 10)
        self.last: int | None = None
        self.held: list | None = None

    def step(self, epoch: float, open_: float, high: float, low: float, close: float, volume: float) -> list[tuple]:
        now, out = int(epoch), []
        if self.last is not None:
            if now == self.last:
                return []
            if now < self.last or now - self.last > self.gap:
                self.held = None
        self.last = now
        start = now // self.seconds * self.seconds
        if self.held and self.held[0] != start:
            out.append((*self.held, self.held[-1] < self.expected))
            self.held = None
        if self.held is None:
            self.held = [start, open_, high, low, close, volume, 1]
        else:
            _, first, top, bottom, _, traded, n = self.held
            self.held = [start, first, max(top, high), min(bottom, low), close, traded + volume, n + 1]
        return out


def window_volatility(prices: Sequence[float], theta: float) -> float:
    """Population deviation of the log returns of a window; 0 for fewer than two returns."""
    r = np.diff(np.log(np.asarray(prices, dtype=float)))
    return float(r.std()) if len(r) > 1 else 0.0


class AdaptiveChange(Machine):
    """Directional change whose threshold follows a metric of the last prices.

    Every `every` rows, once there are `lookback`, the threshold moves to
    theta * (1 + rate * (metric - baseline) / (abs(baseline) + 1e-10)), within
    its bounds; the baseline is the first metric that is not 0. metric(prices,
    theta) is the caller's. Gives the completed trends of DirectionalChange and
    the threshold that confirmed them.
    """

    outputs = DirectionalChange.outputs + ", theta double"

    def __init__(self, theta: float, lookback: int, every: int, rate: float, least: float, most: float, alpha: float = 1.0, metric: Callable[[Sequence[float], float], float] = window_volatility) -> None:
        self.change, self.alpha, self.metric = DirectionalChange(theta, alpha), alpha, metric
        self.prices: deque[float] = deque(maxlen=lookback)
        self.every, self.rate, self.bounds, self.n, self.baseline = every, rate, (least, most), 0, 0.0

    def step(self, price: float) -> list[tuple]:
        self.prices.append(price)
        self.n += 1
        theta = self.change.theta
        out = [(*row, theta) for row in self.change.step(price)]
        if len(self.prices) == self.prices.maxlen and self.n % self.every == 0:
            value = self.metric(list(self.prices), theta)
            self.baseline = self.baseline or value
            moved = theta * (1 + self.rate * (value - self.baseline) / (abs(self.baseline) + 1e-10))
            self.change.theta = min(max(moved, self.bounds[0]), self.bounds[1])
            self.change.down = self.alpha * self.change.theta
        return out


class Observations(Protocol):
    """Conjugate model of a run's values, for every run length at once."""

    def log_chances(self, x: float) -> np.ndarray:
        """Log chance of x for each run length, from the values of the run before it."""
        ...

    def update(self, x: float) -> None:
        """Take x into every run; run length 0 starts from the prior."""
        ...


class NormalGamma:
    """Normal data with unknown mean and variance. Run length i has seen i values, so only mean and beta change."""

    def __init__(self, most: int, mean: float = 0.0, kappa: float = 1.0, alpha: float = 1.0, beta: float = 1.0) -> None:
        n = np.arange(most)
        self.prior = mean, beta
        self.mean, self.beta = np.full(most, float(mean)), np.full(most, float(beta))
        self.kappa, freedom = kappa + n, 2 * alpha + n  # twice alpha
        lgamma = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) for v in freedom])
        self.scale = 2 * (self.kappa + 1) / self.kappa  # 2 alpha * spread / beta
        self.head = lgamma - 0.5 * np.log(math.pi * self.scale)
        self.power = -(freedom + 1) / 2
        self.shift = 0.5 * self.kappa / (self.kappa + 1)

    def log_chances(self, x: float) -> np.ndarray:
        gap = x - self.mean
        return self.head - 0.5 * np.log(self.beta) + self.power * np.log1p(gap * gap / (self.beta * self.scale))

    def update(self, x: float) -> None:
        gap = x - self.mean
        mean, beta = self.mean + gap / (self.kappa + 1), self.beta + self.shift * gap * gap
        self.mean[1:], self.beta[1:] = mean[:-1], beta[:-1]


class RunLength(Machine):
    """Bayesian online change points with a constant hazard.

    The state is a posterior over run lengths 0 to most - 1; the last one holds
    all longer runs. Gives the chance of a new run, the likeliest and the
    expected run length. The model of observations is normal with unknown mean
    and variance unless the caller gives another.
    """

    inputs = ("ret",)
    outputs = "change_prob double, map_run int, mean_run double"

    def __init__(self, hazard: float = 0.01, most: int = 500, model: Observations | None = None) -> None:
        self.hazard, self.model = hazard, model or NormalGamma(most)
        self.runs = np.arange(most)
        self.chance = np.zeros(most)
        self.chance[0] = 1.0

    def step(self, x: float) -> list[tuple]:
        logs = self.model.log_chances(x)
        joint = self.chance * np.exp(logs - logs[self.chance > 0].max())
        total = joint.sum()
        new = np.empty_like(joint)
        new[0] = self.hazard * total
        np.multiply(joint[:-1], 1 - self.hazard, out=new[1:])
        new[-1] += (1 - self.hazard) * joint[-1]
        new /= total
        self.chance = new
        self.model.update(x)
        return [(float(new[0]), int(new.argmax()), float(new @ self.runs))]


class ForwardFilter(Machine):
    """Filtered state chances of a hidden Markov chain with normal emissions."""

    inputs = ("ret",)
    outputs = "probs array<double>, state int"

    def __init__(self, start: Sequence[float], moves: Sequence[Sequence[float]], means: Sequence[float], sds: Sequence[float]) -> None:
        self.probs, self.moves, self.means, self.sds, self.begun = list(start), moves, means, sds, False

    def step(self, x: float) -> list[tuple]:
        k = len(self.means)
        prior = [sum(self.probs[i] * self.moves[i][j] for i in range(k)) for j in range(k)] if self.begun else self.probs
        self.begun = True
        logs = [math.log(max(p, 1e-300)) - 0.5 * ((x - m) / s) ** 2 - math.log(s) for p, m, s in zip(prior, self.means, self.sds, strict=True)]
        top = max(logs)
        weights = [math.exp(v - top) for v in logs]
        total = sum(weights)
        self.probs = [w / total for w in weights]
        return [(self.probs, max(range(k), key=self.probs.__getitem__))]
