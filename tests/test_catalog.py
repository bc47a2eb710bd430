"""Every registered query of the library against its SQL, and without looking ahead."""

from __future__ import annotations

import glob
import math
import os
import random
from collections import Counter

import duckdb
import pytest
import numpy as np
from lodestream.functions.frames import Keyed, running, with_warm_up
from lodestream.operators import evaluation as V
from lodestream.plans import catalog
from lodestream.plans.features import SUITES
from lodestream.plans.suite import hourly, tidy
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        base.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return base


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    want = Counter(tuple(map(plain, r)) for r in want.fetchall())
    got = catalog.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    got = Counter(tuple(map(plain, r)) for r in got.select([f"`{c}`" for c in columns]).collect())
    assert got == want


@pytest.fixture(scope="module")
def free(spark, tmp_path_factory):
    """Events of which some cost nothing, so that bars have lows of 0."""
    path = str(tmp_path_factory.mktemp("free"))
    spark.read.parquet(f"{DATA}/events.parquet").withColumn("value", F.when(F.col("event_id") % 61 == 5, 0.0).otherwise(F.col("value"))).coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["dataset_features", "features_compressed", "features_liquidity", "features_microstructure", "features_price_structure", "features_transforms", "features_volatility", "features_volume", "flagship_hourly_features"])
def test_lows_of_zero_match_sql(spark, free, name):
    base = duckdb.connect()
    base.execute(f"CREATE VIEW events AS SELECT * FROM '{free}/events.parquet/*.parquet'")
    want = base.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    want = {r[:2]: r[2:] for r in want.fetchall()}
    got = {r[:2]: r[2:] for r in catalog.queries()[name](spark, free).select([f"`{c}`" for c in columns]).collect()}
    assert columns[:2] == ["symbol", "ts"] and got.keys() == want.keys()
    near = lambda a, b: a == b or a is not None and b is not None and a == pytest.approx(b, rel=1e-12)
    assert not [(k, c, a, b) for k in want for c, a, b in zip(columns[2:], map(plain, got[k]), map(plain, want[k])) if not near(a, b)]


#: Columns of events that some ticks have otherwise.
ODD = {
    "no price": ("value", lambda: F.lit(None).cast("double")),
    "no time": ("ts", lambda: F.lit(None).cast("timestamp_ntz")),
    "no type": ("event_type", lambda: F.lit(None).cast("string")),
    "NaN": ("value", lambda: F.lit(float("nan"))),
    "below 0": ("value", lambda: -F.col("value")),
}


@pytest.mark.parametrize("name, kind", [("features_price_structure", "no price"), ("features_price_structure", "no time"), ("dataset_features", "no type"), ("dataset_features", "NaN"), ("features_microstructure", "below 0"), ("features_microstructure", "NaN")])
def test_odd_ticks_match_sql(spark, tmp_path, name, kind):
    """Equal to the SQL, NaN told from null."""
    column, value = ODD[kind]
    spark.read.parquet(f"{DATA}/events.parquet").withColumn(column, F.when(F.col("event_id") % 3 == 1, value()).otherwise(F.col(column))).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = base.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    text = lambda rows: Counter(tuple(map(str, r)) for r in rows)
    assert text(catalog.queries()[name](spark, str(tmp_path)).select([f"`{c}`" for c in columns]).collect()) == text(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() >= 0


@pytest.mark.parametrize("name", ["features_order_flow", "features_path_structure", "features_volume", "features_cumulative"])
def test_no_look_ahead(spark, name):
    """Cutting off the future changes nothing before the cut."""
    suite, bars = SUITES[name], hourly(spark, DATA).cache()
    cut = "2024-01-18"
    columns = ["symbol", "ts", *suite.outputs()]
    key = lambda r: Counter(str(x) for x in r)
    past = suite.over(bars.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz"))).select(columns).collect()
    whole = suite.over(bars).where(F.col("ts") < F.lit(cut).cast("timestamp_ntz")).select(columns).collect()
    assert key(past) == key(whole)


def test_warm_up_chunks_equal_whole_keys(spark):
    """Chunks led by the rows before them, and followed by those after, give the windows of whole keys."""
    bars = hourly(spark, "/root/testdata/sf0.01").where("symbol <> 'view'").unionByName(hourly(spark, DATA).where("symbol = 'view'").withColumn("symbol", F.lit(None).cast("string")))
    k = Keyed()
    ahead = lambda w: F.round(F.sum("volume").over(w.ahead(3)), 9).alias("next")
    whole = bars.select("symbol", "ts", F.round(F.avg("close").over(k.trailing(24)), 9).alias("m"), F.count("close").over(k.trailing(24)).alias("n"), ahead(k))
    for rows in (24, 100, 10_000):
        chunked, inner = with_warm_up(bars, k, rows, 23, 3)
        parts = chunked.select("symbol", "ts", "warm_up", F.round(F.avg("close").over(inner.trailing(24)), 9).alias("m"), F.count("close").over(inner.trailing(24)).alias("n"), ahead(inner))
        parts = parts.where("not warm_up").drop("warm_up")
        assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0


@pytest.mark.parametrize("name", ["features_order_flow", "features_liquidity", "features_transforms", "features_price_structure"])
def test_suites_in_chunks(spark, name):
    """A suite over short chunks gives what it gives over whole keys."""
    suite, bars = SUITES[name], hourly(spark, DATA).cache()
    back, _ = suite.reach()
    columns = ["symbol", "ts", *[tidy(c, 4).alias(c) for c in suite.outputs()]]
    key = lambda r: Counter(str(x) for x in r)
    assert key(suite.over(bars, back).select(columns).collect()) == key(suite.over(bars, None).select(columns).collect())


def test_running_totals(spark):
    """Sums over lesser values, per key and for the table, in pieces of any number."""
    rows = [(k, float(v), (v * 7) % 5) for k in ("a", "b") for v in range(60) if (v + len(k)) % 3]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    for keys in ([], ["k"]):
        for descending in (False, True):
            frame = df if keys else df.where("k = 'a'")
            got = running(frame, "v", {"n": "n"}, keys, descending, 7).collect()
            assert len(got) == frame.count()
            for r in got:
                mine = [n for k, v, n in rows if k == r.k]
                assert r.n_before == sum(n for k, v, n in rows if k == r.k and (v > r.v if descending else v < r.v)) and r.n_all == sum(mine)


def test_exact_quantiles(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([rng.gauss(0, 1), 1.0, None])) for k in ("a", "b", "c") for _ in range(200)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    shares = [0.0, 0.1, 0.5, 0.93, 1.0]
    got = {r.k: r.quantiles for r in V.exact_quantiles(df, "x", shares, ["k"]).collect()}
    assert got.keys() == {"a", "b", "c"}
    for k, found in got.items():
        assert found == pytest.approx(np.quantile([x for s, x in rows if s == k and x is not None], shares).tolist())
    assert V.exact_quantiles(df, "x", [0.5]).first()[0] == pytest.approx([np.median([x for _, x in rows if x is not None])])
    assert V.exact_quantiles(df.limit(0), "x", [0.5]).collect() == []


@pytest.mark.parametrize("name", ["pareto_front", "pareto_status"])
def test_gains_are_added_in_the_order_of_the_rows(spark, tmp_path, name):
    """Sums that another order of adding rounds to another number: 1e16 swallows each 1 after it, and tenths end beside a half."""
    rows = [(1, 1e16), (2, 0.5), (4, None)] + [(3, 0.1)] * 7, [(1, 1.0), (1, 1.0), (2, 0.25), (None, 2.5), (4, None)] + [(3, 0.7), (3, 0.1), (3, 0.0)] * 3
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "user_id long, value double").coalesce(1).write.mode("append" if i else "overwrite").parquet(f"{tmp_path}/{i}")
    base = duckdb.connect(config={"threads": 1})
    files = [glob.glob(f"{tmp_path}/{i}/*.parquet")[0] for i in range(2)]
    os.makedirs(f"{tmp_path}/events.parquet")
    for i, path in enumerate(files):
        os.rename(path, f"{tmp_path}/events.parquet/part-{i}.parquet")
    base.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = base.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, str(tmp_path)).select(columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
