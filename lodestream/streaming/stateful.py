"""Structured Streaming: bars from ticks, and sequential machines as stateful operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestream.functions.frames import Keyed
from lodestream.operators import gates
from lodestream.operators.kernels import Machine


def stream_bars(ticks: DataFrame, period: str, lateness: str, expected: int, key: str = "symbol", time: str = "ts", price: str = "price", volume: str = "volume") -> DataFrame:
    """Bars of a period, given out once the watermark has passed them.

    samples counts the rows of a bar; partial tells that there were fewer than
    expected. Rows later than the watermark are dropped.
    """
    at = F.struct(time, price)
    bars = ticks.withWatermark(time, lateness).groupBy(key, F.window(time, period).alias("w"))
    bars = bars.agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(volume).alias("volume"), F.count(F.lit(1)).alias("samples")
    )
    return bars.select(key, F.col("w.start").alias(time), "open", "high", "low", "close", "volume", "samples", (F.col("samples") < expected).alias("partial"))


def stream_machine(df: DataFrame, make: Callable[[], Machine], keys: Sequence[str] = ("symbol",), time: str = "ts") -> DataFrame:
    """A machine over a stream: rows of a micro-batch in time order, its state kept per key.

    Rows at or before the last time that a key has seen are passed over, as a
    late or repeated bar would bend the state; a machine with own_time, such as
    GapBars, is given them and has a rule for them. The batch twin is kernels.run.
    """
    probe = make()
    columns = [*keys, time, *probe.inputs]
    schema = T.StructType([*(df.schema[c] for c in (*keys, time)), *T._parse_datatype_string(probe.outputs).fields])

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine, seen = pickle.loads(state.get[0]) if state.exists else (make(), None)
        out: list[tuple[Any, ...]] = []
        rows = pd.concat(list(frames)).sort_values([time, *probe.inputs], kind="stable")
        for at, *values in rows[[time, *probe.inputs]].itertuples(index=False, name=None):
            if (seen is None or at > seen or machine.own_time) and not any(pd.isna(v) for v in values):
                out += [(*key, at, *made) for made in machine.step(*values)]
                seen = at
        state.update((pickle.dumps((machine, seen)),))
        yield pd.DataFrame(out, columns=schema.names)

    return df.select(*columns).groupBy(*keys).applyInPandasWithState(update, schema, "held binary", "append", GroupStateTimeout.NoTimeout)


def stream_keep_last(df: DataFrame, keys: Sequence[str], time: str, order: str, lateness: str) -> DataFrame:
    """One row per key and time: of repeated ones that with the greatest `order`, such as the time of arrival.

    Kept as a running aggregate until the watermark has passed, so a corrected
    row replaces the one before it: write in update mode to a sink that upserts,
    or in append mode to have each row once, when it is final.
    """
    rest = [c for c in df.columns if c not in (*keys, time)]
    last = df.withWatermark(time, lateness).groupBy(*keys, time).agg(F.max_by(F.struct(*rest), order).alias("_v"))
    return last.select(*keys, time, "_v.*")


class StreamGates:
    """For foreachBatch: checks the last rows of every key against a baseline after each micro-batch.

    The last rows are kept as a table under `folder`, one version per batch; a
    batch that is run again starts from the version before it, so its result is
    the same. sink(report, batch) takes the report of gates.check.
    """

    def __init__(self, folder: str, baseline: DataFrame, keyed: Keyed, rows: int, probs: str, loglik: str, sink: Callable[[DataFrame, int], None], limits: gates.Limits | None = None) -> None:
        self.folder, self.baseline, self.keyed, self.rows, self.probs, self.loglik, self.sink, self.limits = folder, baseline, keyed, rows, probs, loglik, sink, limits

    def _versions(self, spark: SparkSession) -> list[tuple[int, str]]:
        Path = spark._jvm.org.apache.hadoop.fs.Path
        place = Path(self.folder)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath() for s in system.listStatus(place)] if system.exists(place) else []
        return sorted((int(p.getName().removeprefix("batch-")), p.toString()) for p in found if system.exists(Path(f"{p.toString()}/_SUCCESS")))

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in self._versions(spark) if v[0] < number]
        log = spark.read.parquet(before[-1][1]).unionByName(batch) if before else batch
        path = f"{self.folder}/batch-{number}"
        gates.last_rows(log, self.rows, self.keyed).write.mode("overwrite").parquet(path)
        recent = gates.profile(spark.read.parquet(path), self.probs, self.loglik, self.keyed)
        self.sink(gates.check(recent, self.baseline, self.keyed.keys, self.limits), number)
        Path = spark._jvm.org.apache.hadoop.fs.Path
        for _, old in before[:-1]:  # the version before this one stays, for a batch that is run again
            Path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(Path(old), True)


class ViolationCounter(Machine):
    """Consecutive rows beyond a limit; an alert when there are so many."""

    inputs = ("value",)
    outputs = "streak int, alert boolean"

    def __init__(self, limit: float, rows: int) -> None:
        self.limit, self.rows, self.streak = limit, rows, 0

    def step(self, value: float) -> list[tuple]:
        self.streak = self.streak + 1 if abs(value) > self.limit else 0
        return [(self.streak, self.streak >= self.rows)]


class Health(Machine):
    """How a strategy runs: failures in a row and in all, share of runs that succeed, mean time, and whether it is still enabled.

    So many failures in a row disable it for good.
    """

    inputs = ("failed", "took")
    outputs = "runs long, errors long, streak int, success_rate double, mean_time double, enabled boolean"

    def __init__(self, most: int = 5) -> None:
        self.most, self.runs, self.errors, self.streak, self.time, self.enabled = most, 0, 0, 0, 0.0, True

    def step(self, failed: float, took: float) -> list[tuple]:
        self.runs, self.time = self.runs + 1, self.time + took
        self.errors += failed > 0
        self.streak = self.streak + 1 if failed > 0 else 0
        self.enabled = self.enabled and self.streak < self.most
        return [(self.runs, self.errors, self.streak, 100 * (self.runs - self.errors) / self.runs, self.time / self.runs, self.enabled)]
