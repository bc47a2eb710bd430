"""The registered queries of the library and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestream.plans import machines, relational, research, trading  # noqa: F401  (register their queries)
from lodestream.plans.compressed import compressed
from lodestream.plans.features import SUITES as FEATURES

SUITES = FEATURES | {"features_compressed": compressed}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return SUITES | relational.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: suite.sql() for name, suite in SUITES.items()} | relational.SQL
