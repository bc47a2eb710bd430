"""Sources and sinks of files: partitioned bars, logs, delimited text."""

from __future__ import annotations

import importlib.util
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.operators.bars import merge_report, upsert

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def read_bars(spark: SparkSession, root: str, symbols: Sequence[str] | None = None, partitions: dict[str, str] | None = None) -> DataFrame:
    """Bars of a folder partitioned by columns such as broker and timeframe; filters on those prune folders."""
    bars = spark.read.parquet(root)
    for name, value in (partitions or {}).items():
        bars = bars.where(F.col(name) == value)
    return bars if symbols is None else bars.where(F.col("symbol").isin(list(symbols)))


def write_bars(bars: DataFrame, root: str, by: Sequence[str] = ("symbol",), mode: str = "overwrite") -> None:
    """Partitioned Parquet; rows are dealt by partition and time, so that one symbol is written by many tasks."""
    bars.repartition(*by, F.to_date("ts")).sortWithinPartitions(*by, "ts").write.mode(mode).partitionBy(*by).parquet(root)


def swap_in(spark: SparkSession, written: str, final: str) -> None:
    """Put a folder that is written in full in the place of another, which stays until then.

    Renames are atomic on HDFS and local disks. If the second one fails the old
    folder is put back.
    """
    Path = spark._jvm.org.apache.hadoop.fs.Path
    new, place, old = Path(written), Path(final), Path(f"{final.rstrip('/')}.old")
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(new):
        raise OSError(f"there is no {written}")
    had = system.exists(place)
    if had:
        system.delete(old, True)
        if not system.rename(place, old):
            raise OSError(f"cannot move {final} aside")
    if not system.rename(new, place):
        if had:
            system.rename(old, place)
        raise OSError(f"cannot move {written} to {final}")
    if had:
        system.delete(old, True)


def save_merged(fetched: DataFrame, root: str, keys: Sequence[str] = ("symbol", "ts"), by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Merge fetched bars into the table at root, check the result and only then put it in place; gives merge_report.

    The merged table is written beside root, read back and checked, so a failed
    or unsound merge leaves root as it was: a fault raises ValueError.
    """
    spark = fetched.sparkSession
    Path = spark._jvm.org.apache.hadoop.fs.Path
    place = Path(root)
    stored = spark.read.parquet(root).select(fetched.columns) if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place) else fetched.limit(0)
    beside = f"{root.rstrip('/')}.new-{uuid.uuid4().hex[:8]}"
    write_bars(upsert(stored, fetched, keys), beside, by)
    report = merge_report(stored, fetched.dropDuplicates(list(keys)), spark.read.parquet(beside), keys[0], keys[1])
    rows = report.collect()  # one row for each symbol
    if faults := [r for r in rows if r["fault"]]:
        Path(beside).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(Path(beside), True)
        raise ValueError(f"merge into {root}: {faults[0]}, {len(faults)} keys in all")
    swap_in(spark, beside, root)
    return spark.createDataFrame(rows, report.schema)


def append_new(fetched: DataFrame, last: DataFrame, minutes: int, key: str = "symbol", time: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(rows to add, keys to load anew) of fetched bars against each key's last stored time (key, last).

    A key is loaded anew if nothing is stored or its first fetched bar is more
    than two periods after the last stored one; otherwise rows from the last
    stored time on are added, that bar included, as it may have been corrected.
    """
    first = fetched.groupBy(key).agg(F.min(time).alias("_first"))
    state = first.join(last.select(key, F.col("last").alias("_last")), key, "left")
    gap = (F.unix_micros(F.to_timestamp("_first")) - F.unix_micros(F.to_timestamp("_last"))) / 60e6
    state = state.withColumn("_anew", F.col("_last").isNull() | (gap > 2 * minutes))
    anew = state.where("_anew").select(key)
    added = fetched.join(state.where("not _anew").select(key, "_last"), key).where(F.col(time) >= F.col("_last")).drop("_last")
    return added, anew


def read_hdf5(spark: SparkSession, paths: Sequence[str], key: str, schema: str, rows: int = 100_000) -> DataFrame:
    """A table of HDF5 files that all executors can open, one task per file, so many rows at a time.

    Needs PyTables on the executors; the library has no HDF5 reader of its own.
    """

    def read(batches):
        import pandas as pd

        for batch in batches:
            for path in batch["path"]:
                yield from pd.read_hdf(path, key=key, mode="r", chunksize=rows, iterator=True)

    if importlib.util.find_spec("tables") is None:
        raise ImportError("HDF5 files need PyTables; convert them to Parquet")
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return listed.mapInPandas(read, schema)


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantined lines) of JSON lines; a line that does not fit the schema is quarantined whole."""
    full = T._parse_datatype_string(schema).add("_corrupt", T.StringType())
    # read once as text, so that both sides see the same lines
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    sound = F.col("r._corrupt").isNull() & F.col("r").isNotNull()
    return parsed.where(sound).select("r.*").drop("_corrupt"), parsed.where(~sound).select("value")


def write_log(records: DataFrame, path: str, by: Sequence[str]) -> None:
    records.write.mode("append").partitionBy(*by).json(path)


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", null: str = ".", header: bool = True) -> DataFrame:
    """Delimited text with a declared schema; the null mark of published series is a full stop."""
    return spark.read.schema(schema).option("sep", sep).option("nullValue", null).option("header", header).csv(path)


def write_signals(signals: DataFrame, path: str, sep: str = " ") -> None:
    signals.write.mode("overwrite").option("sep", sep).csv(path)


def read_series(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder, one series each, as one table (series, date, value, available_from_utc)."""
    return spark.read.parquet(f"{folder.rstrip('/')}/*.parquet").select("series", "date", F.col("value").cast("double").alias("value"), "available_from_utc")


def long_series(spark: SparkSession, path: str, lag_days: int) -> DataFrame:
    """A long table (date, series, value) with available_from_utc, so many business days after the date."""
    table = spark.read.parquet(path)
    return table.withColumn("available_from_utc", business_days_later("date", lag_days))


def business_days_later(date: str, days: int):
    """The date so many weekdays later; a weekend date counts from its Friday."""
    day = F.weekday(date)
    friday = F.date_sub(F.to_date(date), F.greatest(day - 4, F.lit(0)))
    total = F.least(day, F.lit(4)) + days
    weeks, rest = F.floor(total / 5), F.pmod(total, F.lit(5))
    return F.date_add(F.date_sub(friday, F.least(day, F.lit(4))), (weeks * 7 + rest).cast("int"))
