"""Feature tables, filters, merges, plug-ins, condition maps and monitoring, on small frames."""

from __future__ import annotations

import math
import os
import random
from collections import defaultdict
from datetime import datetime, time, timedelta

import numpy as np
import pytest
from lodestream import extension as X
from lodestream.functions import special
from lodestream.functions.frames import Keyed
from lodestream.operators import bars as B
from lodestream.operators import columns as S
from lodestream.operators import condition_map, filters, gates
from lodestream.operators import evaluation as V
from lodestream.operators import kernels as M
from lodestream.operators import rolling_kernels as W
from lodestream.operators import temporal_joins as J
from lodestream.sources import files
from lodestream.streaming import stateful
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)  # a Monday
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, closes, symbol="a", start=START, step=timedelta(hours=1)):
    return spark.createDataFrame([(symbol, start + i * step, c, c + 1, c - 1, c, 1.0) for i, c in enumerate(closes)], BARS)


# columns


def test_prune_constant(spark):
    rows = [(float(i % 7), 1.0 if i else 2.0, 1e9 + i % 2, float("nan"), None, 5.0 if i < 96 else float(i), 0.0, 1e-13 * (i % 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "varies double, one double, flat double, nan double, none double, most double, zero double, tiny double")
    kept, gone = S.prune_constant(df, df.columns)
    assert kept == ["varies"]
    assert gone == {"one": "constant", "flat": "flat", "nan": "few", "none": "few", "most": "constant", "zero": "constant", "tiny": "flat"}
    assert S.prune_constant(df, ["most"], most_share=0.97)[0] == ["most"]
    assert S.prune_constant(df.limit(0), ["varies"]) == ([], {"varies": "few"}) and S.prune_constant(df, []) == ([], {})
    with pytest.raises(ValueError):
        S.prune_constant(df, ["varies"], most_share=0.5)


def test_prefixes(spark):
    assert S.prune_prefix_duplicates(["feat_a", "tm_a", "a", "feat_b", "tm_c", "feat_c", "x_c"]) == (["tm_a", "a", "feat_b", "tm_c", "x_c"], ["feat_a", "feat_c"])
    base = bars(spark, [1.0, 2.0]).select("symbol", "ts", "close")
    part = base.limit(1).select("symbol", "ts", (F.col("close") * 2).alias("twice"))
    got = S.concat(base, [S.prefixed(part, "feat_"), base]).orderBy("ts").collect()
    assert [tuple(r)[2:] for r in got] == [(1.0, 2.0), (2.0, None)]


# filters


def test_filters(spark):
    rows = [(START + timedelta(hours=9), 1.0, 0), (START + timedelta(hours=11, minutes=30), 1.0, 1), (START + timedelta(hours=11, minutes=30, microseconds=1), 1.0, 1), (START + timedelta(days=5, hours=9), 1.0, 0), (None, 1.0, 0), (START + timedelta(hours=9), 2.0, None), (START + timedelta(hours=9), None, 0), (START + timedelta(hours=9), 1.0, 2)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, spread double, open int")
    when = filters.day_and_time("ts", range(5), [(time(8), time(11, 30)), (time(14), time(15))])
    tests = {"when": when, "any": filters.day_and_time("ts"), "spread": filters.spread_below("spread", 2.0), "open": filters.positions_below("open", 2), "all": filters.every(when, filters.spread_below("spread", 2.0), filters.positions_below("open", 2)), "none": filters.every()}
    got = df.select(*[c.alias(n) for n, c in tests.items()]).collect()
    want = {"when": [1, 1, 0, 0, 0, 1, 1, 1], "any": [1, 1, 1, 1, 0, 1, 1, 1], "spread": [1, 1, 1, 1, 1, 0, 0, 1], "open": [1, 1, 1, 1, 1, 1, 1, 0], "all": [1, 1, 0, 0, 0, 0, 0, 0], "none": [1] * 8}
    assert {n: [int(r[n]) for r in got] for n in tests} == want


def test_min_return(spark):
    labels = spark.createDataFrame([(0.05, 1, "upper"), (-0.2, -1, "lower"), (0.1, 1, "upper")], "ret double, label int, barrier string")
    assert [tuple(r)[1:] for r in J.min_return(labels, 0.1).collect()] == [(0, "upper"), (-1, "lower"), (1, "upper")]
    assert J.min_return(labels, 0.0) is labels


# merges


def test_save_merged(spark, tmp_path):
    root = str(tmp_path / "bars")
    report = files.save_merged(bars(spark, [1.0, 2.0, 3.0]), root).collect()
    assert [(r.symbol, r.stored, r.fetched, r.merged, r.fault) for r in report] == [("a", 0, 3, 3, None)]
    newer = bars(spark, [9.0, 10.0], start=START + timedelta(hours=2)).unionByName(bars(spark, [5.0], "b"))
    report = {r.symbol: r for r in files.save_merged(newer, root).collect()}
    assert (report["a"].stored, report["a"].fetched, report["a"].merged) == (3, 2, 4) and report["b"].merged == 1
    assert sorted((r.symbol, r.close) for r in spark.read.parquet(root).collect()) == [("a", 1.0), ("a", 2.0), ("a", 9.0), ("a", 10.0), ("b", 5.0)]
    assert sorted(os.listdir(tmp_path)) == ["bars"]


def test_faults_of_a_merge(spark):
    a, b = bars(spark, [1.0, 2.0, 3.0]), bars(spark, [1.0, 2.0])
    fault = lambda *t: [r.fault for r in B.merge_report(*t).collect()]
    assert fault(a, b, a) == [None] and fault(a, b, b) == ["stored rows lost"] and fault(b, a, b) == ["fetched rows lost"] and fault(a, b, a.unionByName(b)) == ["repeated times"]


def test_a_failed_swap_leaves_the_old_table(spark, tmp_path):
    root = str(tmp_path / "bars")
    files.save_merged(bars(spark, [1.0]), root)
    with pytest.raises(OSError):
        files.swap_in(spark, str(tmp_path / "missing"), root)
    assert spark.read.parquet(root).count() == 1


def test_append_new(spark):
    last = spark.createDataFrame([("a", START + timedelta(hours=1)), ("b", START)], "symbol string, last timestamp_ntz")
    fetched = bars(spark, [1.0, 2.0, 3.0]).unionByName(bars(spark, [4.0], "b", START + timedelta(hours=3))).unionByName(bars(spark, [5.0], "c"))
    added, anew = files.append_new(fetched, last, 60)
    assert sorted((r.symbol, r.close) for r in added.collect()) == [("a", 2.0), ("a", 3.0)] and sorted(r.symbol for r in anew.collect()) == ["b", "c"]


def test_series_folder_and_hdf5(spark, tmp_path):
    for name, value in (("A", 1.0), ("B", 2.0)):
        spark.createDataFrame([(START.date(), name, value, START)], "date date, series string, value double, available_from_utc timestamp").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert sorted((r.series, r.value) for r in files.read_series(spark, str(tmp_path)).collect()) == [("A", 1.0), ("B", 2.0)]
    with pytest.raises(ImportError):
        files.read_hdf5(spark, ["x.h5"], "bars", BARS)


# thresholds and information, against loops


def test_thresholds_against_loops(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0.0, 1.0, 1.0, rng.random()]), rng.gauss(0, 1)) for _ in range(300)] + [(None, 1.0), (0.5, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    sound = sorted([(x, y) for x, y in rows if x is not None and y is not None], key=lambda r: -r[0])
    n = len(sound)
    pf = lambda part: sum(y for _, y in part if y > 0) / (-sum(y for _, y in part if y < 0) + 1e-30)
    want = {}
    for share in (0.02, 0.2, 0.5, 0.7, 0.95):
        k = min(max(int(share * (n + 1)) - 1, 0), n - 1)
        while k and sound[k - 1][0] == sound[k][0]:
            k -= 1
        if k not in (0, n - 1):
            want[share] = (sound[k][0], k / n, pf(sound[:k]), pf(sound[k:]))
    got = {r.share: (r.threshold, r.frac_above, r.pf_long_above, r.pf_long_below) for r in V.roc_table(df, "x", "y", [0.02, 0.2, 0.5, 0.7, 0.95]).collect()}
    assert got == {s: pytest.approx(v) for s, v in want.items()} and want
    long, short = (pf(sound), sound[0][0], n), (-1.0, None, None)
    for k in range(1, n):
        if sound[k - 1][0] != sound[k][0]:
            if n - k >= 30 and pf(sound[k:]) > long[0]:
                long = (pf(sound[k:]), sound[k][0], n - k)
            against = 1 / pf(sound[:k]) if pf(sound[:k]) else 0
            if k >= 30 and against > short[0]:
                short = (against, sound[k][0], k)
    r = V.best_thresholds(df, "x", "y", 30).first()
    assert (r.long_pf, r.long_threshold, r.n_long) == pytest.approx(long) and (r.short_pf, r.short_threshold, r.n_short) == pytest.approx(short) and r.pf_all == pytest.approx(pf(sound))


def test_threshold_null_against_a_loop(spark):
    rng = random.Random(13)
    rows = [(k, rng.choice([0.0, rng.random(), rng.random()]), rng.gauss(0, 1) + (0.4 if k == "told" else 0)) for k in ("told", "blind") for _ in range(90)] + [("blind", None, 1.0)]
    got = {r.symbol: r for r in V.threshold_null(spark.createDataFrame(rows, "symbol string, x double, y double"), "x", "y", 10, 120, block=50).collect()}
    assert got.keys() == {"told", "blind"}
    for key, r in got.items():
        mine = sorted([(x, y) for k, x, y in rows if k == key and x is not None], key=lambda v: (-v[0], v[1]))
        x, y = np.array([v for v, _ in mine]), np.array([v for _, v in mine])

        def best(y, x=x):
            cuts = [0, *[i for i in range(1, len(x)) if x[i] != x[i - 1]]]
            pf = lambda part: part[part > 0].sum() / (-part[part < 0].sum() + 1e-30)
            return max(pf(y[c:]) for c in cuts if not c or len(x) - c >= 10), max(pf(-y[:c]) for c in cuts if c >= 10)

        own, hits = best(y), np.zeros(3)
        for block in range(1, 4):
            drawn = np.random.default_rng([0, block])
            for _ in range(min(50, 120 - (block - 1) * 50)):
                found = best(drawn.permutation(y))
                hits += [found[0] >= own[0], found[1] >= own[1], max(found) >= max(own)]
        assert (r.long_pf, r.short_pf) == pytest.approx(own) and (r.p_long, r.p_short, r.p_best) == pytest.approx(tuple((1 + hits) / 121))


def test_dominated_against_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(40), rng.randrange(20)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, more int, less int")
    got = {r.i: r.dominated for r in V.dominated(df, "more", "less").collect()}
    assert got == {i: any(m > a and k < b for _, m, k in rows) for i, a, b in rows}
    status = {r.i: r.status for r in V.pareto_status(df, "more", "less", 12).collect()}
    sound = [r for r in rows if r[2] <= 12]
    assert status == {i: "trap" if b > 12 else "dominated" if any(m > a and k < b for _, m, k in sound) else "candidate" for i, a, b in rows}


def test_spearman_by_running_totals(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([1.0, 2.0, rng.random()]), rng.gauss(0, 1), None if rng.random() < 0.1 else 1.0) for g in ("a", "b") for _ in range(200)] + [("flat", 1.0, float(i), 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").withColumn("y", F.when(F.col("z").isNotNull(), F.col("y")))
    plain, large = ({r.g: (r.n, r.ic) for r in V.spearman(df, "x", "y", ["g"], large=big).collect()} for big in (False, True))
    assert plain.keys() == large.keys() and plain["flat"] == large["flat"] == (5, None)
    for g in ("a", "b"):
        assert plain[g][0] == large[g][0] and plain[g][1] == pytest.approx(large[g][1])
    got = spark.createDataFrame([(0.5, 12), (0.0, 30), (1.0, 9), (None, 9)], "ic double, n long").select(V.p_value("ic", "n").alias("p")).collect()
    assert got[0].p == pytest.approx(0.0978, abs=1e-4) and got[1].p == pytest.approx(1.0) and got[2].p == 0 and got[3].p is None


def test_calibration_report(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([1, 2, 1], 400)
    y = rng.integers(0, 3, 400)
    df = spark.createDataFrame([(q.tolist(), int(s)) for q, s in zip(p, y, strict=True)] + [(None, 1), ([0.5, 0.5], 7)], "p array<double>, y int")
    r = V.calibration_report(df, "p", "y").first()
    top, hit = p.max(axis=1), (p.argmax(axis=1) == y).astype(float)
    bin_ = np.minimum((top * 10).astype(int), 9)
    gaps = [(bin_ == b).sum() * abs(top[bin_ == b].mean() - hit[bin_ == b].mean()) for b in np.unique(bin_)]
    assert r.n == 400 and r.ece == pytest.approx(sum(gaps) / 400) and r.brier == pytest.approx(((p - np.eye(3)[y]) ** 2).sum(axis=1).mean()) and r.nll == pytest.approx(-np.log(p[np.arange(400), y]).mean())
    assert r.uncertainty == pytest.approx(hit.mean() * (1 - hit.mean()))


def test_regime_runs_against_a_loop(spark):
    rng = random.Random(7)
    label, rows = 0, []
    for i in range(200):
        label = label if rng.random() < 0.8 else rng.choice([-1, 0, 1])
        o = 100 + rng.random()
        rows.append(("a", START + timedelta(hours=i), o, o * math.exp(rng.gauss(0, 0.01)), label))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, close double, label int")
    for confirm in (1, 3):
        want, run, before = defaultdict(list), 0, "none"
        for i, (_, _, o, c, _) in enumerate(rows):
            side = rows[i - 1][4] if i else None
            run += i < 2 or side != before
            before = side
            past = [rows[i - j - 1][4] if i > j else None for j in range(confirm)]
            r = side * math.log(c / o) if past[0] and all(x == past[0] for x in past) else None
            want[run].append((r * 1.5 if r is not None and r < 0 else r, side, rows[i][4]))
        got = {r.run: r for r in V.regime_runs(df, "label", confirm, 0.5).collect()}
        traded = {k: v for k, v in want.items() if any(r is not None for r, *_ in v)}
        assert got.keys() == traded.keys() and traded
        for k, v in traded.items():
            earned, path, top, fall = [r for r, *_ in v if r is not None], 0.0, -math.inf, 0.0
            for r, *_ in v:
                path = path + r if r is not None else path
                shown = path if r is not None else 0.0
                top = max(top, shown)
                fall = min(fall, shown - top)
            assert (got[k].total, got[k].length, got[k].trades, got[k].max_drawdown) == pytest.approx((sum(earned), len(v), len(earned), fall), abs=1e-12)
            assert got[k].purity == sum(r > 0 for r in earned) / len(earned) and got[k].label == v[0][2]


# plug-ins


def test_registry(spark):
    made = X.Registry([X.Recipe("a", ("close",), lambda k: F.col("close") * 2, "price"), X.Recipe("b", ("a",), lambda k: F.col("a") + 1, "price"), X.Recipe("c", ("b", "volume"), lambda k: k.lag("b"), "signal", 5)])
    assert made.stages(["c"]) == [["a"], ["b"], ["c"]] and made.sources("c") == {"close", "volume"}
    assert made.of_kind("price").names() == ["a", "b"] and made.from_only("close").of_kind("price").names() == ["a", "b"] and len(made.where(lambda r: r.horizon > 1)) == 1
    got = made.build(bars(spark, [1.0, 2.0]).select("symbol", "ts", "close", "volume"), ["c", "a"]).orderBy("ts")
    assert got.columns == ["symbol", "ts", "close", "volume", "c", "a"] and [(r.c, r.a) for r in got.collect()] == [(None, 2.0), (3.0, 4.0)]
    with pytest.raises(ValueError):
        made.add(X.Recipe("a", (), lambda k: F.lit(1)))
    with pytest.raises(ValueError):
        X.Registry([X.Recipe("x", ("y",), lambda k: F.lit(1)), X.Recipe("y", ("x",), lambda k: F.lit(1))]).stages(["x"])


def test_signals_and_positions(spark):
    flags = ["L", "", "xl", "S", "xl", "xs", "L", "S", "Lxs", ""]  # exits of the other side change nothing
    rows = [("a", START + timedelta(hours=i), "L" in f, "xl" in f, "S" in f, "xs" in f) for i, f in enumerate(flags)]
    signals = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, entry_long boolean, exit_long boolean, entry_short boolean, exit_short boolean")
    assert [r.position for r in X.with_positions(signals).orderBy("ts").collect()] == [1, 1, 0, -1, -1, 0, 1, -1, 1, 1]

    class Lacking:
        def generate(self, bars):
            return bars.withColumn("entry_long", F.lit(None))

    with pytest.raises(ValueError):
        X.generated(bars(spark, [1.0]), Lacking())
    with pytest.raises(ValueError):
        X.engineered(bars(spark, [1.0]), lambda b: b.drop("ts"))
    assert X.engineered(bars(spark, [1.0]), lambda b: b.select("symbol", "ts", "close")).count() == 1


def test_posterior_plug_ins(spark):
    class Sharper:
        def transform(self, df, probs):
            return df.withColumn(probs, F.transform(probs, lambda x: F.pow(x, 2)))

    class Most:
        def infer(self, df, probs):
            return df.select(F.array_max(probs).alias("top"))

        def metadata(self):
            return {}

    df = spark.createDataFrame([([0.5, 0.5],)], "p array<double>")
    assert X.infer(df, "p", [Sharper(), Sharper()], Most()).first().top == 0.0625


def test_condition_map(spark, tmp_path):
    cells = [("f", "calm", 100, 0.4), ("f", "wild", 100, -0.4), ("g", "calm", 100, 0.4), ("g", "wild", 100, 0.5), ("h", "calm", 100, 0.01), ("h", "wild", 9, None), ("i", "calm", 100, 0.3), ("i", "wild", 100, 0.0)]
    told = condition_map.statuses(spark.createDataFrame(cells, "feature string, condition string, n long, ic double"), 0.1, 0.05)
    made = condition_map.ConditionMap(told, spark.createDataFrame([("f", 0.0)], "feature string, ic double"), {"least_ic": 0.1})
    made.save(str(tmp_path / "map"))
    back = condition_map.ConditionMap.load(spark, str(tmp_path / "map"))
    assert back.limits == {"least_ic": 0.1} and sorted(map(str, back.cells.collect())) == sorted(map(str, told.collect())) and back.whole.count() == 1
    assert sorted(r.feature for r in back.of_status("calm").collect()) == ["f", "g", "i"] and [r.feature for r in back.of_status("wild", "negative").collect()] == ["f"]
    assert [r.feature for r in back.sign_flipping().collect()] == ["f"]
    assert {r.feature: r.bucket for r in back.buckets().collect()} == {"f": "ensemble", "g": "stable", "h": "unclassified", "i": "specific"}


def test_distributions(spark):
    """In the JVM as in plain Python, for parameters without a closed form."""
    xs = [-1.0, 0.0, 1e-6, 0.03, 0.4, 0.77, 0.999, 1.0, 1.7, 4.4, 9.0, 31.0, 80.0, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for a, b in ((0.3, 4.0), (2.5, 0.5), (40.0, 17.0)):
        got = df.select("x", special.gamma_cdf(a, F.col("x")).alias("g"), special.beta_cdf(a, b, F.col("x")).alias("b"), special.f_cdf(a, b, F.col("x")).alias("f"), special.t_cdf(a, F.col("x")).alias("t")).collect()
        for r in got:
            if r.x is None:
                assert (r.g, r.b, r.f, r.t) == (None,) * 4
                continue
            t = W.beta_cdf(a / 2, 0.5, a / (a + r.x**2)) / 2
            want = (W.gamma_cdf(a, r.x), W.beta_cdf(a, b, r.x) if 0 < r.x < 1 else float(r.x >= 1), W.f_cdf(r.x, a, b), 1 - t if r.x > 0 else t)
            assert (r.g, r.b, r.f, r.t) == pytest.approx(want, abs=1e-9), (a, b, r.x)


# models of the machines


def test_machines_take_models():
    class Counting:
        def __init__(self):
            self.seen = []

        def score(self, x):
            return x - len(self.seen), -x

        def update(self, x):
            self.seen.append(x)

    machine = M.CusumStatistic(Counting())
    assert [machine.step(x)[0] for x in (2.0, 0.0, 5.0)] == [(2.0, 0.0), (1.0, 0.0), (4.0, 0.0)]

    class Flat:
        def log_chances(self, x):
            return np.zeros(50)

        def update(self, x):
            pass

    runs = M.RunLength(0.25, 50, Flat())
    assert [runs.step(0.0)[0][0] for _ in range(3)] == pytest.approx([0.25] * 3)
    seen = []
    adaptive = M.AdaptiveChange(0.1, 3, 1, 1.0, 0.05, 0.4, metric=lambda prices, theta: seen.append(list(prices)) or len(seen))
    for p in (100.0, 101.0, 102.0, 103.0, 104.0):
        adaptive.step(p)
    assert seen == [[100, 101, 102], [101, 102, 103], [102, 103, 104]] and adaptive.change.theta == 0.4


def test_gap_bars():
    bars_ = M.GapBars(60, 5, 30)
    out = []
    for t, p in [(0, 1.0), (0, 9.0), (5, 2.0), (10, 0.5), (20, 3.0), (40, 1.5), (61, 4.0), (100, 5.0), (119, 6.0), (121, 7.0), (90, 8.0), (95, 8.5), (121, 9.0)]:
        out += bars_.step(t, p, p + 0.1, p - 0.1, p, 1.0)
    # the repeated second is passed over; the gap from 61 to 100 and the step back to 90 drop what was gathered
    assert out == [(0, 1.0, 3.1, 0.4, 1.5, 5.0, 5, True), (60, 5.0, 6.1, 4.9, 6.0, 2.0, 2, True), (60, 8.0, 8.6, 7.9, 8.5, 2.0, 2, True)]


# streams


def drained(frame, name, tmp_path, mode="append"):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_gap_bars_in_a_stream(spark, tmp_path):
    rng, t, rows = random.Random(8), 0, []
    for _ in range(120):
        step = rng.choice([5, 5, 5, 0, 45])
        t += step
        price = float(rng.random()) if step or not rows else rows[-1][3]  # a repeated time is the row sent again
        rows.append(("a", START + timedelta(seconds=t), float(t + 1_704_067_200), *[price] * 4, 1.0))
    schema = "symbol string, ts timestamp_ntz, epoch double, open double, high double, low double, close double, volume double"
    whole = spark.createDataFrame(rows, schema)
    for lo in range(0, 120, 40):  # files in order of arrival
        spark.createDataFrame(rows[lo : lo + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drained(stateful.stream_machine(stream, lambda: M.GapBars(60, 5, 30)), "gap_bars", tmp_path)
    want = M.run(whole, lambda: M.GapBars(60, 5, 30))
    assert sorted(map(str, spark.table("gap_bars").collect())) == sorted(map(str, want.collect())) and want.count() >= 4


def test_keep_last_in_a_stream(spark, tmp_path):
    schema = "symbol string, ts timestamp, close double, arrived int"
    first = [("a", START, 1.0, 1), ("a", START + timedelta(hours=1), 2.0, 2)]
    second = [("a", START, 9.0, 3), ("a", START + timedelta(hours=2), 3.0, 4), ("a", START + timedelta(hours=1), 0.0, 0)]
    third = [("a", START + timedelta(hours=9), 4.0, 5)]
    for part in (first, second, third):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drained(stateful.stream_keep_last(stream, ["symbol"], "ts", "arrived", "3 hours"), "kept_last", tmp_path)
    assert [(r.close, r.arrived) for r in spark.table("kept_last").orderBy("ts").collect()] == [(9.0, 3), (2.0, 2), (3.0, 4)]


def test_gates_in_a_stream(spark, tmp_path):
    rng = np.random.default_rng(9)
    k = Keyed(("m",), "ts")
    schema = "m string, ts timestamp_ntz, p array<double>, loglik double"
    calm = [("x", START + timedelta(hours=i), rng.dirichlet([5, 5]).tolist(), float(rng.normal())) for i in range(300)]
    baseline = gates.profile(spark.createDataFrame(calm, schema), "p", "loglik", k)
    later = START + timedelta(days=30)
    parts = [[("x", later + timedelta(hours=i), rng.dirichlet([5, 5]).tolist(), float(rng.normal())) for i in range(40)], [("x", later + timedelta(days=5, hours=i), [0.99, 0.01], -9.0) for i in range(40)], [("new", later, [0.5, 0.5], 0.0)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told: dict[int, dict] = {}
    check = stateful.StreamGates(str(tmp_path / "tail"), baseline, k, 40, "p", "loglik", lambda report, n: told.update({n: {r.m: r for r in report.collect()}}), gates.Limits(flip_rate=0.5, occupancy=0.5))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(check).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert told[0]["x"].ok and told[0]["x"].rows == 40
    assert not told[1]["x"].ok and told[1]["x"].rows == 40 and abs(told[1]["x"].loglik_z) > 3 and told[1]["x"].occupancy_drift > 0.5
    assert not told[2]["new"].ok and told[2]["new"].rows == 1 and not told[2]["x"].ok
    before = told[2]["x"]
    check(spark.createDataFrame(parts[2], schema), 2)  # a batch that is run again
    assert told[2]["x"] == before and sorted(os.listdir(tmp_path / "tail"))[-1] == "batch-2"
