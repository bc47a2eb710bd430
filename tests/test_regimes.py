"""Regimes, rolling kernels and fitted transformations against plain references."""

from __future__ import annotations

import itertools
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from lodestream.functions import scaling
from lodestream.operators import kernels as M
from lodestream.operators import regimes as R
from lodestream.operators import rolling_kernels as W
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


def rows_of(machine, rows):
    return [machine.step(*r) for r in rows]


def test_chances():
    assert W.gamma_cdf(0.5, 0.5 * 1.96**2) == pytest.approx(math.erf(1.96 / math.sqrt(2)))
    assert W.gamma_cdf(1.0, 3.0) == pytest.approx(1 - math.exp(-3))
    assert W.gamma_cdf(5.0, 4.0) == pytest.approx(1 - sum(math.exp(-4) * 4**k / math.factorial(k) for k in range(5)))
    assert W.beta_cdf(2, 3, 0.4) == pytest.approx(sum(math.comb(4, k) * 0.4**k * 0.6 ** (4 - k) for k in range(2, 5)))
    assert W.f_cdf(1.0, 7, 7) == pytest.approx(0.5) and W.f_cdf(0.0, 3, 4) == 0


def test_ranks_and_correlation():
    assert W.ranks(np.array([3.0, 1.0, 3.0, 2.0])).tolist() == [3.5, 1.0, 3.5, 2.0]
    x = np.array([[1.0, 9.0], [2.0, 7.0], [3.0, 7.0], [4.0, 1.0]])
    assert W.rank_correlation(x[None])[0, 0] == pytest.approx(-0.9486832980505138)
    assert np.isnan(W.rank_correlation(np.ones((1, 5, 2)))).all()


def test_hurst_tells_trend_from_noise():
    rng = np.random.default_rng(0)
    noise = rng.normal(size=(1024, 1))
    trend = np.cumsum(noise, axis=0)
    assert 0.4 < W.hurst(noise[None])[0, 0] < 0.7 < 0.85 < W.hurst(trend[None])[0, 0]


def test_series_tests():
    rng = np.random.default_rng(1)
    noise, wave = rng.normal(size=(200, 1)), np.sin(np.arange(200) / 3)[:, None]
    run = W.ljung_box(5)
    assert run(noise[None])[0, 1] > 0.01 and run(wave[None])[0, 1] < 1e-6
    assert abs(W.runs_test(noise[None])[0, 0]) < 3 and W.runs_test(wave[None])[0, 0] < -5 and np.isnan(W.runs_test(np.ones((1, 9, 1)))).all()
    steps = np.cumsum(np.tile([1.0, 1.0, -1.0], 40))[:, None]
    entropy, shared = W.word_entropy(2)(steps[None])[0]
    assert entropy < 0.8 and shared > 0.5
    assert W.zigzag_density(0.5)(np.array([[[1.0], [2.0], [0.9], [2.0], [0.9]]]))[0, 0] == 3 / 5
    assert np.arange(9.0) ** 2 @ W.savitzky_golay(9, 2) == pytest.approx(64)


def plain_runs(x):
    s = [v for v in np.sign(x) if v]
    up, down = sum(v > 0 for v in s), sum(v < 0 for v in s)
    n = up + down
    if not up or not down or n < 3:
        return math.nan
    spread = 2 * up * down * (2 * up * down - n) / (n * n * (n - 1))
    runs = 1 + sum(a != b for a, b in itertools.pairwise(s))
    return (runs - 1 - 2 * up * down / n) / math.sqrt(spread) if spread > 0 else math.nan


def test_kernels_take_many_windows(spark):
    """Windows together give what each gives alone, over keys, batches and chunks, with values to pass over."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(40, 9, 1)), 1)
    x[3], x[4, :5] = 1.0, 0.0
    for kernel in (W.hurst, W.ljung_box(2), W.runs_test, W.word_entropy(2), W.zigzag_density(0.5)):
        whole = kernel(np.abs(x) + 0.1 if kernel is not W.runs_test else x)
        alone = np.concatenate([kernel(np.abs(w[None]) + 0.1 if kernel is not W.runs_test else w[None]) for w in x])
        assert np.allclose(whole, alone, equal_nan=True)
    assert np.allclose(W.runs_test(x)[:, 0], [plain_runs(w[:, 0]) for w in x], equal_nan=True)
    series = [(k, START + timedelta(hours=i), None if i % 11 == 5 else float(rng.normal())) for k in ("a", "b") for i in range(120)] + [("short", START, 1.0)]
    frame = spark.createDataFrame(series, "symbol string, ts timestamp_ntz, ret double")
    for rows in (8, 50, 1000):
        got = {(r.symbol, r.ts): r.z for r in W.rolling(frame, 9, W.runs_test, "z double", ("ret",), rows=rows).collect()}
        for k in ("a", "b", "short"):
            there = [(t, v) for s, t, v in series if s == k and v is not None]
            for i, (t, _) in enumerate(there):
                want = plain_runs([v for _, v in there[i - 8 : i + 1]]) if i >= 8 else math.nan
                assert got[k, t] == (None if math.isnan(want) else pytest.approx(want)), (k, i, rows)
        assert len(got) == sum(v is not None for *_, v in series)


def test_panel_risk_and_strength():
    rng = np.random.default_rng(2)
    common = np.cumsum(rng.normal(size=(80, 1)) * 0.01, axis=0)
    tight = np.exp(common + np.cumsum(rng.normal(size=(80, 4)) * 0.0005, axis=0))
    loose = np.exp(np.cumsum(rng.normal(size=(80, 4)) * 0.01, axis=0))
    run = W.panel_risk(0.25)
    tight_, loose_ = run(tight[None])[0], run(loose[None])[0]
    assert tight_[0] > 0.95 > loose_[0] and tight_[1] > loose_[1]
    machine = W.RelativeStrength(["a", "b", "c"], 3)
    out = rows_of(machine, [(1.01**i, 1.0, 0.99**i) for i in range(8)])
    assert all(o[0][1:3] == ("a", "c") for o in out if o) and len([o for o in out if o]) == 5


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    logs = np.log(rng.dirichlet([1, 1, 1], 6))
    moves, start = rng.dirichlet([2, 1, 1], 3), rng.dirichlet([1, 1, 1])
    score = lambda p: math.log(start[p[0]]) + logs[0][p[0]] + sum(math.log(moves[a, b]) + logs[t + 1][b] for t, (a, b) in enumerate(zip(p, p[1:], strict=False)))
    best = max(itertools.product(range(3), repeat=6), key=score)
    assert tuple(R.viterbi(logs, moves, start)) == best


def test_chain_is_recovered(spark):
    rng = np.random.default_rng(4)
    state, x = 0, []
    for _ in range(3000):
        state = state if rng.random() < 0.97 else 1 - state
        x.append(rng.normal(0, [0.5, 2.0][state]))
    fit = R.fit_chain(np.array(x), 2)
    assert fit["sds"] == pytest.approx([0.5, 2.0], rel=0.1) and np.diag(fit["moves"]) == pytest.approx([0.97, 0.97], abs=0.02)
    rows = [("a", START + timedelta(hours=i), v) for i, v in enumerate(x)] + [("few", START, 1.0)]
    got = R.fit_chains(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double"), "ret", 2).collect()
    assert sorted((r.symbol, r.state) for r in got) == [("a", 0), ("a", 1)]


def test_chains_take_all_rows(spark, monkeypatch):
    """Of a long key too, unless the caller sets a window."""
    monkeypatch.setattr(R, "fit_chain", lambda x, states: {"moves": np.eye(states), "means": np.full(states, x.mean()), "sds": np.ones(states), "loglik": np.array(len(x))})
    frame = spark.range(100_500).selectExpr("'a' AS symbol", "timestamp_seconds(id) AS ts", "CAST(id AS DOUBLE) AS ret")
    assert {(r.mean, r.loglik) for r in R.fit_chains(frame, "ret", 2).collect()} == {(50_249.5, 100_500.0)}
    assert {(r.mean, r.loglik) for r in R.fit_chains(frame, "ret", 2, most=1_000).collect()} == {(99_999.5, 1_000.0)}


def test_label_filters():
    got = rows_of(R.LeastDuration("s", 2), [(0,), (1,), (0,), (1,), (1,), (1,), (0,), (0,)])
    assert [g[0][0] for g in got] == [0, 0, 0, 0, 1, 1, 1, 0]
    got = rows_of(R.Hysteresis(["a", "b"], 0.6, 0.4, 2), [(0.9, 0.1), (0.3, 0.7), (0.45, 0.55), (0.3, 0.7), (0.2, 0.8), (0.5, 0.5)])
    assert [g[0][0] for g in got] == [0, 0, 0, 0, 1, 1]
    got = rows_of(R.SmoothedPosterior(["a", "b"], 0.5), [(1.0, 0.0), (0.0, 1.0)])
    assert got[1][0][0] == pytest.approx([0.5, 0.5])


def test_forward_filter_against_all_paths():
    start, moves, means, sds = [0.3, 0.7], [[0.8, 0.2], [0.4, 0.6]], [0.0, 1.0], [1.0, 0.5]
    x = [0.2, 1.1, -0.4, 0.9]
    like = lambda s, v: math.exp(-0.5 * ((v - means[s]) / sds[s]) ** 2) / sds[s]
    weight = [0.0, 0.0]
    for p in itertools.product(range(2), repeat=4):
        w = start[p[0]] * like(p[0], x[0])
        for t in range(1, 4):
            w *= moves[p[t - 1]][p[t]] * like(p[t], x[t])
        weight[p[-1]] += w
    machine = M.ForwardFilter(start, moves, means, sds)
    got = [machine.step(v) for v in x][-1][0][0]
    assert got == pytest.approx([w / sum(weight) for w in weight])


def test_circular_shift_null(spark):
    rng = random.Random(6)
    r = [rng.gauss(0, 1) for _ in range(400)]
    rows = [("good", START + timedelta(hours=i), math.copysign(1, v), v) for i, v in enumerate(r)] + [("blind", START + timedelta(hours=i), 1.0, v) for i, v in enumerate(r)]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, position double, ret double")
    got = {x.symbol: x for x in R.circular_shift_null(frame, "position", "ret", 300).collect()}
    assert got["good"].p_value == 0 and got["blind"].p_value == 1 and got["good"].total == pytest.approx(sum(map(abs, r)))


def test_fitted_powers(spark):
    rng = np.random.default_rng(7)
    skewed = np.exp(rng.normal(0, 0.5, 2000))
    frame = spark.createDataFrame([(float(v),) for v in skewed], "x double")
    assert scaling.fit_box_cox(frame, "x") == pytest.approx(0, abs=0.1)
    power = scaling.fit_yeo_johnson(frame, "x")
    skew = frame.select(F.skewness(scaling.yeo_johnson(F.col("x"), power)).alias("s"), F.skewness("x").alias("t")).first()
    assert abs(skew.s) < 0.3 < abs(skew.t)


def test_bins_keep_ties_together(spark):
    values = [1.0] * 50 + [2.0] * 5 + [3.0] * 45 + [None]
    got = scaling.tied_bins(spark.createDataFrame([(v,) for v in values], "x double"), "x", 4, "bin").distinct().collect()
    bins = {r.x: r.bin for r in got}
    assert len(got) == 4 and bins[None] is None and bins[1.0] < bins[2.0] < bins[3.0]
    flat = scaling.equal_width(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 3, "bin").collect()
    assert {r.bin for r in flat} == {0}
