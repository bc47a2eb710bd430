"""Operators on small frames: sequential machines, streams, joins along time, sources, functions."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from lodestream.functions import posterior, price
from lodestream.functions.frames import Keyed
from lodestream.operators import bars as B
from lodestream.operators import kernels as M
from lodestream.operators import temporal_joins as J
from lodestream.sources import files
from lodestream.streaming import stateful
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp_ntz, high double, low double, close double, ret double"


def walk(n=300, seed=1, symbols=("a", "b")):
    rng, rows = random.Random(seed), []
    for s in symbols:
        p = 100.0
        for i in range(n):
            r = rng.gauss(0, 0.03)
            p *= math.exp(r)
            rows.append((s, START + timedelta(hours=i), p * 1.01, p * 0.99, p, r))
    return rows


def per_symbol(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_trend_labels_against_two_passes(spark):
    rows, omega = walk(), 0.1
    got = {(r.symbol, r.ts): r.label for r in M.run(spark.createDataFrame(rows, SCHEMA), lambda: M.TrendFlip(omega)).collect()}
    for s, series in per_symbol(rows).items():
        x = [r[4] for r in series]
        begun = next(i for i, p in enumerate(x) if abs(p - x[0]) > x[0] * omega)
        side = 1 if x[begun] > x[0] else -1
        best = x[begun]
        for i, r in enumerate(series):
            if i < begun:
                assert got[s, r[1]] == 0
                continue
            best = max(best, x[i]) if side > 0 else min(best, x[i])
            if side * (best - x[i]) > best * omega:
                side, best = -side, x[i]
            assert got[s, r[1]] == side


def test_directional_change_covers_the_path(spark):
    """Trends follow each other end to start, change direction, and move by theta or more."""
    rows, theta = walk(), 0.05
    got = M.run(spark.createDataFrame(rows, SCHEMA), lambda: M.DirectionalChange(theta)).collect()
    for s, series in per_symbol(rows).items():
        x = [r[4] for r in series]
        trends = sorted((t for t in got if t.symbol == s), key=lambda t: t.confirm_pos)
        assert len(trends) > 3
        for a, b in zip(trends, trends[1:], strict=False):
            assert (a.end_pos, a.end_price) == (b.start_pos, b.start_price) and a.direction == -b.direction
        for t in trends:
            leg = x[t.start_pos : t.end_pos + 1]
            assert t.end_price == (max(leg) if t.direction > 0 else min(leg)) and abs(t.end_price / t.start_price - 1) >= theta * 0.99
            assert t.confirm_price == x[t.confirm_pos] and t.confirm_pos > t.end_pos


def test_cusum_events(spark):
    rows = walk()
    got = collected(M.run(spark.createDataFrame(rows, SCHEMA), lambda: M.CusumEvents(0.1)).select("symbol", "ts", "side"))
    want = []
    for s, series in per_symbol(rows).items():
        up = down = 0.0
        for r in series:
            up, down = max(0.0, up + r[5]), min(0.0, down + r[5])
            if up >= 0.1 or down <= -0.1:
                want.append((s, r[1], 1 if up >= 0.1 else -1))
                up = down = 0.0
    assert got == sorted(want)


def test_change_points_against_plain_recursion(spark):
    rng = random.Random(3)
    x = [rng.gauss(0, 1) for _ in range(60)] + [rng.gauss(6, 1) for _ in range(60)]
    rows = [("a", START + timedelta(hours=i), 1.0, 1.0, 1.0, v) for i, v in enumerate(x)]
    got = M.run(spark.createDataFrame(rows, SCHEMA), lambda: M.RunLength(0.02, 150)).orderBy("ts").collect()
    chance, params = {0: 1.0}, {0: (0.0, 1.0, 1.0, 1.0)}
    for v, r in zip(x, got, strict=True):
        new, after = {0: 0.0}, {0: (0.0, 1.0, 1.0, 1.0)}
        for run, p in chance.items():
            m, k, a, b = params[run]
            scale = b * (k + 1) / (a * k)
            like = math.exp(math.lgamma(a + 0.5) - math.lgamma(a)) / math.sqrt(2 * a * math.pi * scale) * (1 + (v - m) ** 2 / (2 * a * scale)) ** (-a - 0.5)
            new[0] += 0.02 * p * like
            new[run + 1] = 0.98 * p * like
            after[run + 1] = ((k * m + v) / (k + 1), k + 1, a + 0.5, b + k * (v - m) ** 2 / (2 * (k + 1)))
        total = sum(new.values())
        chance, params = {k: p / total for k, p in new.items()}, after
        assert r.mean_run == pytest.approx(sum(k * p for k, p in chance.items()), rel=1e-8)
    assert got[-1].map_run == pytest.approx(60, abs=3)


def test_bricks(spark):
    rows = [("a", START + timedelta(hours=i), p, p, p, 0.0) for i, p in enumerate([100.0, 104.0, 111.0, 131.0, 125.0, 109.0, 90.0])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("volume", F.lit(1.0))
    got = M.run(frame, lambda: M.Bricks(10.0)).orderBy("brick_num").collect()
    assert [(r.direction, r.brick_open, r.brick_close) for r in got] == [(1, 100, 110), (1, 110, 120), (1, 120, 130), (-1, 130, 120), (-1, 120, 110), (-1, 110, 100), (-1, 100, 90)]
    assert [r.brick_num for r in got] == list(range(7)) and [r.brick_volume for r in got] == [3, 1, 0, 2, 0, 1, 0]
    wide = spark.createDataFrame([("a", START, 100.0, 100.0, 100.0, 1.0), ("a", START + timedelta(hours=1), 125.0, 85.0, 90.0, 2.0)], "symbol string, ts timestamp_ntz, high double, low double, close double, volume double")
    got = M.run(wide, lambda: M.Bricks(10.0)).orderBy("brick_num").collect()
    assert [(r.direction, r.brick_close) for r in got] == [(1, 110), (1, 120), (-1, 110), (-1, 100), (-1, 90)] and got[0].brick_volume == 3


def test_wilder_warm_up(spark):
    got = M.run(spark.createDataFrame(walk(60, symbols=("a",)), SCHEMA), lambda: M.Wilder(14)).orderBy("ts").collect()
    assert all(r.atr is None for r in got[:14]) and all(r.atr > 0 and 0 <= r.rsi <= 100 for r in got[14:])
    assert got[26].adx is None and got[27].adx is not None


def test_stream_equals_batch(spark, tmp_path):
    """A machine over micro-batches gives what it gives over the whole table."""
    rows = walk(80)
    source, n = str(tmp_path / "in"), 0
    whole = spark.createDataFrame(rows, SCHEMA)
    for lo in range(0, 80, 20):
        part = whole.where((F.col("ts") >= F.lit(START + timedelta(hours=lo))) & (F.col("ts") < F.lit(START + timedelta(hours=lo + 20))))
        part.coalesce(1).write.mode("append").parquet(source)
        n += 1
    for name, make in {"trend": lambda: M.TrendFlip(0.05), "cusum": lambda: M.CusumEvents(0.1), "vol": lambda: M.EwmaVolatility(20)}.items():
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(source)
        running = stateful.stream_machine(stream, make).writeStream.format("memory").queryName(f"out_{name}").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        running.awaitTermination()
        assert collected(spark.table(f"out_{name}")) == collected(M.run(whole, make))


def test_stream_bars(spark, tmp_path):
    source = str(tmp_path / "ticks")
    rows = [("a", START + timedelta(seconds=5 * i), 100.0 + i % 7, 1.0) for i in range(60)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, volume double")
    ticks.coalesce(1).write.parquet(source)
    stream = stateful.stream_bars(spark.readStream.schema(ticks.schema).parquet(source), "1 minute", "0 seconds", 12)
    running = stream.writeStream.format("memory").queryName("out_bars").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    running.awaitTermination()
    got = spark.table("out_bars").orderBy("ts").collect()
    assert len(got) >= 4 and all(r.samples == 12 and not r.partial and r.high == 106 for r in got[:4])
    assert got[0].open == 100 and got[0].close == 100 + 11 % 7


def test_forward_as_of_takes_a_step_for_each_row(spark):
    """No frame that begins at the current row and has no end: it is gone through anew for each row."""
    rng = random.Random(3)
    left = [(i % 2, START + timedelta(minutes=rng.randrange(400)), i) for i in range(300)]
    right = [(i % 2, START + timedelta(minutes=rng.randrange(300)), float(rng.randrange(50))) for i in range(200)]
    found = J.as_of(spark.createDataFrame([*left, (0, None, 300)], "k int, ts timestamp_ntz, i int"), spark.createDataFrame([*right, (0, None, 99.0)], "k int, at timestamp_ntz, v double"), ["k"], "ts", "at", ["v"], forward=True)
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
    want = {300: (None, None)}
    for k, ts, i in left:
        at = min((t for key, t, _ in right if key == k and t >= ts), default=None)
        want[i] = (at, max((v for key, t, v in right if key == k and t == at), default=None))
    assert {r.i: (r.matched_time, r.v) for r in found.collect()} == want


def test_as_of_edges(spark):
    at = lambda h, m=0: START + timedelta(hours=h, minutes=m)
    left = spark.createDataFrame([("a", at(1), 1), ("a", at(2), 2), ("a", at(9), 3), ("b", at(1), 4), (None, at(1), 5), ("a", None, 6)], "k string, ts timestamp_ntz, i int")
    right = spark.createDataFrame([("a", at(1), 10.0), ("a", at(1, 30), None), ("a", None, 99.0), ("a", at(3), 30.0)], "k string, at timestamp_ntz, v double")
    got = {r.i: (r.v, r.matched_time) for r in J.as_of(left, right, ["k"], "ts", "at", ["v"], max_age="5 HOURS").collect()}
    # an exact time matches; a null value of the latest row is a match; too old is none
    assert got == {1: (10.0, at(1)), 2: (None, at(1, 30)), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}
    got = {r.i: r.matched_time for r in J.as_of(left, right, ["k"], "ts", "at", ["v"], forward=True).collect()}
    assert got == {1: at(1), 2: at(3), 3: None, 4: None, 5: None, 6: None}


def test_range_join_against_all_pairs(spark):
    rng = random.Random(7)
    spans = [("a", i, START + timedelta(minutes=rng.randrange(3000)), rng.randrange(400)) for i in range(60)]
    spans = [(k, i, s, s + timedelta(minutes=n)) for k, i, s, n in spans]
    points = [("a", START + timedelta(minutes=rng.randrange(3400))) for _ in range(200)]
    got = J.range_join(spark.createDataFrame(spans, "k string, i int, s timestamp_ntz, e timestamp_ntz"), spark.createDataFrame(points, "k string, t timestamp_ntz"), ["k"], "s", "e", "t", 3600)
    assert sorted((r.i, r.t) for r in got.collect()) == sorted((i, t) for _, i, s, e in spans for _, t in points if s < t <= e)


@pytest.mark.parametrize(("tie", "label"), [("stop", -1), ("profit", 1), ("none", 0)])
def test_same_bar_touch(spark, tie, label):
    bars = spark.createDataFrame([("a", START + timedelta(hours=i), 100.0 + 20 * (i == 1), 100.0 - 20 * (i == 1), 100.0) for i in range(4)], "symbol string, ts timestamp_ntz, high double, low double, close double")
    events = spark.createDataFrame([("a", START, START + timedelta(hours=3), 100.0, 0.1)], "symbol string, t0 timestamp_ntz, t1 timestamp_ntz, price double, vol double")
    (row,) = J.triple_barrier(events, bars, 1.0, 1.0, tie).collect()
    assert row.label == label and row.exit_ts == START + timedelta(hours=1 if label else 3)
    assert row.ret == pytest.approx(math.log({-1: 0.9, 1: 1.1, 0: 1.0}[label]))


def test_clean_upsert_and_columns(spark):
    rows = [("a", START, 1.0, 5.0), ("a", START, 2.0, 6.0), ("a", START + timedelta(days=5), 3.0, 7.0), ("a", START + timedelta(days=1), None, 8.0), ("a", START + timedelta(days=2), 4.0, 0.0)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, volume double")
    assert [r.close for r in B.clean(bars, keep="first").collect()] == [1.0]
    assert [r.close for r in B.clean(bars, keep="last").collect()] == [2.0]
    # the bar that is kept is judged, not the next one; other columns may be null
    late = spark.createDataFrame([("a", START, None, 5.0, 2, None), ("a", START, 2.0, 6.0, 3, "x"), ("b", START, 1.0, 9.0, 7, None), ("b", START, 2.0, 3.0, 1, None)], "symbol string, ts timestamp_ntz, close double, volume double, at int, note string")
    assert [(r.symbol, r.close) for r in B.clean(late, order="at").collect()] == [("b", 2.0)]
    assert sorted((r.symbol, r.close) for r in B.clean(late, keep="last", order="at").collect()) == [("a", 2.0), ("b", 1.0)]
    wide = bars.withColumn("sparse", F.when(F.col("close") == 1, 1.0))
    assert B.drop_sparse_columns(wide).columns == bars.columns


def test_functions(spark):
    xs = [-6.0, -3.2, -1.0, -0.1, 0.0, 0.5, 1.7, 2.9, 3.9, 5.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", price.erf(F.col("x")).alias("e"), price.normal_compress(F.col("x"), 1.0).alias("c")).collect()
    for r in got:
        assert r.e == pytest.approx(math.erf(r.x), abs=2e-8)
        assert r.c == pytest.approx(50 * math.erf(r.x / math.sqrt(2)), abs=1e-5)
    for n in (5, 20):
        basis = np.array([price.legendre(n, d) for d in (1, 2, 3)])
        assert np.allclose(basis @ basis.T, np.eye(3)) and np.allclose(basis.sum(axis=1), 0)
    assert price.fractional_weights(1.0, 4) == [0.0, 0.0, -1.0, 1.0]
    p = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))
    r = spark.range(1).select(posterior.entropy(p).alias("e"), posterior.margin(p).alias("m"), posterior.argmax(p).alias("a"), posterior.js(p, p).alias("j")).first()
    assert (round(r.e, 6), round(r.m, 6), r.a, round(r.j, 9)) == (1.029653, 0.2, 1, 0)


def test_windowed_functions(spark):
    k = Keyed()
    rng = random.Random(9)
    x = [rng.choice([1.0, 2.0, 3.0, 5.0]) for _ in range(40)]
    rows = [("a", START + timedelta(hours=i), v) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")
    got = df.select("ts", price.kendall_tau(k, "x", 8).alias("tau"), price.shannon_entropy(k, "x", 8, 4).alias("h"), price.percentile_rank(k, "x", 8).alias("p"), price.sign_persistence(k, "x", 8).alias("s")).orderBy("ts").collect()
    for i, r in enumerate(got):
        if i < 7:
            assert (r.tau, r.h, r.p, r.s) == (None,) * 4
            continue
        w = x[i - 7 : i + 1]
        assert r.tau == pytest.approx(sum(np.sign(w[b] - w[a]) for a in range(8) for b in range(a + 1, 8)) / 28)
        counts = np.histogram(w, 4)[0] / 8
        assert r.h == pytest.approx(-sum(c * math.log2(c) for c in counts if c)) and r.p == sum(v < w[-1] for v in w) / 8 and r.s == 1.0


def test_sources(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"a": 1, "b": "x"}\n\nnot json\n{"a": "no", "b": "y"}\n{"a": 2, "b": "z"}\n')
    sound, bad = files.read_log(spark, str(log), "a int, b string")
    assert sorted(r.a for r in sound.collect()) == [1, 2] and bad.count() == 2
    text = tmp_path / "series.csv"
    text.write_text("date,value\n2024-01-01,1.5\n2024-01-02,.\n")
    assert [r.value for r in files.read_delimited(spark, str(text), "date date, value double").orderBy("date").collect()] == [1.5, None]
    bars = spark.createDataFrame([("a", START, 1.0), ("b", START, 2.0)], "symbol string, ts timestamp_ntz, close double")
    files.write_bars(bars, str(tmp_path / "bars"))
    assert [r.close for r in files.read_bars(spark, str(tmp_path / "bars"), ["b"]).collect()] == [2.0]
    days = spark.createDataFrame([(d,) for d in ("2024-01-01", "2024-01-05", "2024-01-06", "2024-01-07")], "d string").select("d", files.business_days_later("d", 1).cast("string").alias("n"), files.business_days_later("d", 6).cast("string").alias("m"))
    assert [(r.n, r.m) for r in days.orderBy("d").collect()] == [("2024-01-02", "2024-01-09"), ("2024-01-08", "2024-01-15"), ("2024-01-08", "2024-01-15"), ("2024-01-08", "2024-01-15")]
