"""Written tables in the folder that the driver and all executors share.

Operators that need an intermediate result twice write it here instead of
computing it twice: a Parquet table survives lost executors, cuts lineage and
gives the optimizer sizes.
"""

from __future__ import annotations

import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The application's part of the session's spark.checkpoint.dir; in local mode the warehouse will do where that is unset.

    It is deleted when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/lodestream/{spark.sparkContext.applicationId}"
    if not getattr(spark.sparkContext, "_lodestream_scratch", False):
        path, system = hadoop(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        spark.sparkContext._lodestream_scratch = True
    return folder


def hadoop(spark: SparkSession, name: str):
    """The path of that name and the file system that it is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Paths that this thread of control has been handed, oldest first. Runs in other threads have lists of their own.
_paths: ContextVar[tuple[str, ...]] = ContextVar("lodestream_paths", default=())


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _paths.set((*_paths.get(), path))
    return path


def mark() -> int:
    """A point in the list of tables, for since()."""
    return len(_paths.get())


def since(point: int) -> list[str]:
    return list(_paths.get()[point:])


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that no result needs any more."""
    for name in paths:
        path, system = hadoop(spark, name)
        system.delete(path, True)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    saved._lodestream_path = path
    return saved


def spent(*saved: DataFrame) -> None:
    """Delete tables that save() returned and that nothing will read again."""
    for df in saved:
        delete(df.sparkSession, [df._lodestream_path])


def clear(spark: SparkSession) -> None:
    """Delete all that this application wrote so far; for a driver that goes on once its results are stored."""
    system_path, system = hadoop(spark, shared_folder(spark))
    system.delete(system_path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add."""
    drop = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in drop])


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns renamed to _c0, _c1, ..., which no operator uses, and the new name of each."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def unmasked(names: dict[str, str]) -> list[Column]:
    return [F.col(new).alias(old) for old, new in names.items()]
