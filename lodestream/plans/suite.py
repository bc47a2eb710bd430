"""Feature suites: staged columns over hourly bars, with the SQL of every column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.frames import Keyed, with_warm_up

from lodestream.operators.bars import ticks_to_bars
from lodestream.operators.evaluation import rounded_sums
from lodestream.plans.lazy import Lazy, real

#: Added before rounding on both sides, so that sums in another order do not fall on a tie.
NUDGE = 1.2345e-8

BARS_SQL = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(value) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, gain, trials): the rounded sum of a user's values, added in the order of the table's rows, and their number."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    return rounded_sums(events(spark, sf_dir).select("user_id", "value", *place), "user_id", "value", ["_file", "_row"], "gain", "trials")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(events(spark, sf_dir).select("event_type", "ts", "value", "event_id"))


def tidy(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero.

    In the steps of the SQL's round, scaled up and down again: values of more
    digits than a double has are told apart by them.
    """
    x = (F.col(x) if isinstance(x, str) else x) + NUDGE
    scaled = x * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**digits).otherwise(x) + F.lit(0.0)


def tidy_sql(x: str, digits: int = 6) -> str:
    return f"round({x} + {NUDGE}, {digits}) + 0.0"


def w(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


P = "OVER (PARTITION BY symbol ORDER BY ts)"
SO_FAR = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def s_full(value: str, x: str, n: int, least: int | None = None) -> str:
    return f"(CASE WHEN count({x}) {w(n)} >= {n if least is None else least} THEN {value} END)"


def s_agg(f: str, x: str, n: int, least: int | None = None) -> str:
    return s_full(f"{f}({x}) {w(n)}", x, n, least)


def s_ripe(value: str, x: str, n: int, least: int | None = None) -> str:
    return f"(CASE WHEN row_number() {P} >= {n} AND count({x}) {w(n)} >= {n // 2 if least is None else least} THEN {value} END)"


def s_lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {P}"


def s_div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def s_ln(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN ln({x}) END)"


def s_both(x: str, y: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END"


def s_corr(x: str, y: str, n: int) -> str:
    one = lambda c: f"stddev_pop(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {c} END) {w(n)}"
    return f"(CASE WHEN count({s_both(x, y)}) {w(n)} >= {n} AND least({one(x)}, {one(y)}) > 1e-12 THEN corr({x}, {y}) {w(n)} END)"


def s_slope(y: str, x: str, n: int) -> str:
    varies = f"var_pop(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} END) {w(n)} > 1e-12"
    return f"(CASE WHEN count({s_both(x, y)}) {w(n)} >= {n} AND {varies} THEN regr_slope({y}, {x}) {w(n)} END)"


def s_z(x: str, n: int) -> str:
    sd = s_agg("stddev_pop", x, n)
    return f"(CASE WHEN {sd} > 1e-12 THEN ({x} - {s_agg('avg', x, n)}) / {sd} WHEN {sd} IS NOT NULL THEN 0.0 END)"


def s_ripe_z(x: str, n: int) -> str:
    sd = f"stddev_pop({x}) {w(n)}"
    return s_ripe(f"CASE WHEN {x} IS NOT NULL THEN CASE WHEN {sd} > 1e-10 THEN ({x} - avg({x}) {w(n)}) / {sd} ELSE 0.0 END END", x, n)


def s_sample_z(x: str, n: int) -> str:
    return f"(({x} - {s_agg('avg', x, n)}) / ({s_agg('stddev_samp', x, n)} + 1e-10))"


def s_ripe_corr(x: str, y: str, n: int, least: int | None = None, first: int | None = None, flat: float | None = None) -> str:
    one = lambda c: f"stddev_pop(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {c} END) {w(n)}"
    inner = f"CASE WHEN least({one(x)}, {one(y)}) > 1e-10 THEN corr({x}, {y}) {w(n)} ELSE {'NULL' if flat is None else flat} END"
    return f"(CASE WHEN count({s_both(x, y)}) {w(n)} >= {n // 2 if least is None else least} AND row_number() {P} >= {first or n} THEN {inner} END)"


Stage = dict[str, tuple[Lazy, str]]


#: Rows of a key that are taken by one task.
CHUNK_ROWS = 10_000
_BACK = re.compile(r"(\d+) PRECEDING|lag\(.*?, (\d+)\) OVER")
_AHEAD = re.compile(r"(\d+) FOLLOWING|lead\(.*?, (\d+)\) OVER")


def _reach(stage: Stage, found: re.Pattern) -> int:
    return max((int(n) for _, sql in stage.values() for hit in found.findall(sql) for n in hit if n), default=0)


@dataclass
class Suite:
    """Stages of columns: each sees the columns of those before it. Names with a leading _ are not returned."""

    stages: list[Stage]
    digits: int = 6

    def outputs(self) -> list[str]:
        return [name for stage in self.stages for name in stage if not name.startswith("_")]

    def reach(self) -> tuple[int, int] | None:
        """Rows that the columns look back and ahead, stage by stage; None if a column looks back without bound.

        A window over a span of time counts by its rows: spans here are shorter
        than the longest window of rows beside them.
        """
        if any("UNBOUNDED" in sql for stage in self.stages for _, sql in stage.values()):
            return None
        return sum(_reach(s, _BACK) for s in self.stages), sum(_reach(s, _AHEAD) for s in self.stages)

    def over(self, bars: DataFrame, rows: int | None = CHUNK_ROWS) -> DataFrame:
        """The columns over bars, a task for each chunk of so many rows of a key; whole keys where a column has no bounded reach."""
        reach = self.reach() if rows else None
        if reach and any(reach):
            bars, _ = with_warm_up(bars, Keyed(), rows, *reach)
            bars = bars.withColumn("symbol", F.struct("symbol", "chunk"))  # what the windows are partitioned by
        for stage in self.stages:
            bars = bars.select("*", *[real(c).alias(name) for name, (c, _) in stage.items()])
        if reach and any(reach):
            bars = bars.where("not warm_up").withColumn("symbol", F.col("symbol.symbol")).drop("chunk", "warm_up")
        return bars

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.over(hourly(spark, sf_dir)).select("symbol", "ts", *[tidy(c, self.digits).alias(c) for c in self.outputs()])

    def sql(self) -> str:
        parts, last = [BARS_SQL], "bars"
        for i, stage in enumerate(self.stages):
            columns = ",\n    ".join(f"{sql} AS {name}" for name, (_, sql) in stage.items())
            parts.append(f"s{i} AS (SELECT *,\n    {columns}\n  FROM {last})")
            last = f"s{i}"
        columns = ", ".join(f"{tidy_sql(c, self.digits)} AS {c}" for c in self.outputs())
        return "WITH " + ",\n".join(parts) + f"\nSELECT symbol, ts, {columns} FROM {last}"
