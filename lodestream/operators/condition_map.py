"""Which features tell something under which conditions: a map from rank correlations, saved as a folder of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.evaluation import p_value


def statuses(ic: DataFrame, least_ic: float, most_p: float | None = None) -> DataFrame:
    """ic (feature, condition, n, ic) with p and status: active, negative, inactive, or insufficient where ic is null.

    A correlation counts if it is at least least_ic from 0 and, where most_p is
    given, its two-sided p value is no more than that.
    """
    told = ic.withColumn("p", p_value("ic", "n")) if most_p is not None else ic
    sure = F.abs("ic") >= least_ic
    sure = sure & (F.col("p") <= most_p) if most_p is not None else sure
    status = F.when(F.col("ic").isNull(), "insufficient").when(sure & (F.col("ic") > 0), "active").when(sure, "negative").otherwise("inactive")
    return told.withColumn("status", status)


@dataclass
class ConditionMap:
    """Tables: cells (feature, condition, n, ic, p, status) and whole (feature, ic) over all conditions; and the limits they were made with."""

    cells: DataFrame
    whole: DataFrame
    limits: dict[str, float]

    def of_status(self, condition: str, status: str = "active") -> DataFrame:
        return self.cells.where((F.col("condition").cast("string") == condition) & (F.col("status") == status)).select("feature")

    def sign_flipping(self) -> DataFrame:
        """Features that are active under one condition and negative under another."""
        return self.cells.groupBy("feature").agg(F.max((F.col("status") == "active").cast("int")).alias("a"), F.max((F.col("status") == "negative").cast("int")).alias("b")).where("a = 1 and b = 1").select("feature")

    def buckets(self) -> DataFrame:
        """(feature, bucket): stable if active (or negative) wherever there are enough rows, specific if under one condition, ensemble if under several, else unclassified."""
        sure = F.sum(F.col("status").isin("active", "negative").cast("int"))
        judged = F.sum((F.col("status") != "insufficient").cast("int"))
        signs = F.count_distinct(F.when(F.col("status").isin("active", "negative"), F.col("status")))
        counts = self.cells.groupBy("feature").agg(sure.alias("k"), judged.alias("n"), signs.alias("s"))
        bucket = F.when((F.col("k") > 0) & (F.col("k") == F.col("n")) & (F.col("s") == 1), "stable").when(F.col("k") == 1, "specific").when(F.col("k") > 1, "ensemble").otherwise("unclassified")
        return counts.select("feature", bucket.alias("bucket"))

    def save(self, folder: str) -> None:
        spark = self.cells.sparkSession
        self.cells.write.mode("overwrite").parquet(f"{folder}/cells")
        self.whole.write.mode("overwrite").parquet(f"{folder}/whole")
        spark.createDataFrame(sorted(self.limits.items()), "name string, value double").write.mode("overwrite").parquet(f"{folder}/limits")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> ConditionMap:
        limits = {r["name"]: r["value"] for r in spark.read.parquet(f"{folder}/limits").collect()}
        return cls(spark.read.parquet(f"{folder}/cells"), spark.read.parquet(f"{folder}/whole"), limits)
