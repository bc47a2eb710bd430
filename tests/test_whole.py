"""Queries over all of their input, against brute force."""

from __future__ import annotations

import math
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from lodestream.operators import regimes as R
from lodestream.operators import rolling_kernels as W
from lodestream.plans import catalog
from lodestream.plans.research import GATES
from lodestream.plans.suite import hourly
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def run(spark, name):
    return catalog.queries()[name](spark, DATA).collect()


def test_every_bar_gets_a_label(spark):
    bars = defaultdict(list)
    for r in hourly(spark, DATA).orderBy("ts").collect():
        bars[r.symbol].append(r)
    ends, labels = {}, {}
    for symbol, rows in bars.items():
        for i, r in enumerate(rows):
            end = next((b.ts for b in rows if b.ts >= r.ts + timedelta(hours=12)), rows[-1].ts)
            ends[symbol, r.ts] = end
            vol = (r.high - r.low) / r.close + 0.05
            walk = [b for b in rows[i + 1 :] if b.ts <= end]
            if not walk or 0.8 * vol >= 1:
                continue
            upper, lower = r.close * (1 + 1.5 * vol), r.close * (1 - 0.8 * vol)
            hit = next(((b.ts, -1, lower) if b.low <= lower else (b.ts, 1, upper) for b in walk if b.low <= lower or b.high >= upper), (walk[-1].ts, 0, walk[-1].close))
            labels[symbol, r.ts] = (hit[0], hit[1], pytest.approx(math.log(hit[2] / r.close), abs=2e-6))
    got = run(spark, "label_vertical_barriers")
    assert {(r.symbol, r.t0): r.t1 for r in got} == ends and len(got) == len(ends)
    got = run(spark, "label_triple_barrier")
    assert {(r.symbol, r.t0): (r.exit_ts, r.label, r.ret) for r in got} == labels and len(got) == len(labels)
    left = {k: t1 for k, t1 in ends.items() if t1 < datetime(2024, 1, 15) or k[1] > datetime(2024, 1, 18)}
    assert {(r.symbol, r.t0): r.t1 for r in run(spark, "label_purged_train")} == left


def test_ratio_reads_every_order(spark):
    sums = defaultdict(lambda: [0.0, 0.0])
    for r in spark.read.parquet(f"{DATA}/orders.parquet").collect():
        sums[str(r.o_orderdate)[:10]][r.o_orderpriority not in ("1-URGENT", "2-HIGH")] += r.o_totalprice
    got = {r.date: r.ratio for r in run(spark, "macro_ratio")}
    assert got == {d: pytest.approx(a / b, abs=2e-6) if a and b else None for d, (a, b) in sums.items()}


def test_posteriors_of_all_components(spark, tmp_path):
    """A row for each vector, also where nothing is positive, and every component counts."""
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(60, 16))
    vectors[7], vectors[9, :8], vectors[11, 15] = -1.0, -1.0, 50.0
    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    p = np.maximum(vectors.astype("float32").astype(float), 0)
    p = np.where(p.sum(axis=1, keepdims=True) > 0, p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300), 1 / 16)
    entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(axis=1)
    run = lambda name: {r.vec_id: r for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    got = run("posterior_features")
    assert [got[i].entropy for i in range(60)] == pytest.approx(entropy, abs=2e-6) and [got[i].state for i in range(60)] == p.argmax(axis=1).tolist()
    got = run("posterior_smoothed")
    held = p[0]
    for i in range(60):
        held = held + 0.2 * (p[i] - held)
        assert (got[i]["first"], got[i].top) == pytest.approx((held[0] / held.sum(), held.max() / held.sum()), abs=2e-6)
    got = run("posterior_transforms")
    assert [got[i].matured_first for i in range(60)] == pytest.approx([1 / 16] * 3 + p[:-3, 0].tolist(), abs=2e-6)
    top = np.sort(p, axis=1)[:, ::-1]
    chance, margin, share = GATES
    want = [-1]
    for i in range(60):
        passes = top[i, 0] >= chance and top[i, 0] - top[i, 1] >= margin and entropy[i] <= share * math.log(16)
        want.append(int(p[i].argmax()) if passes else want[-1])
    got = run("posterior_gates")
    assert [got[i].gated_state for i in range(60)] == want[1:] and 15 in want
    got = run("posterior_dynamics")
    assert [got[i].state for i in range(60)] == p.argmax(axis=1).tolist()
    assert len(run("posterior_hysteresis")) == 60


def test_every_market_and_pair(spark):
    closes = defaultdict(dict)
    for r in hourly(spark, DATA).collect():
        closes[r.symbol][r.ts] = r.close
    got = run(spark, "panel_pivot")
    assert {(s, r.ts): r[f"close_{s}"] for r in got for s in closes if r[f"close_{s}"] is not None} == {(s, t): v for s, rows in closes.items() for t, v in rows.items()}
    pairs = {(a, b) for a in closes for b in closes if a < b}
    for name, n, column in (("pair_rank_correlation", 63, "rho"), ("pair_deviation", 20, "deviation"), ("pair_purified", 80, "purified")):
        got = run(spark, name)
        assert {(r.first_market, r.second_market, r.ts) for r in got} == {(a, b, t) for a, b in pairs for t in closes[a].keys() & closes[b].keys()}
        if column == "rho":
            for r in got[::50]:
                times = sorted(t for t in closes[r.first_market].keys() & closes[r.second_market].keys() if t <= r.ts)[-n:]
                x = np.array([(closes[r.first_market][t], closes[r.second_market][t]) for t in times])
                assert r.rho == (None if len(x) < n else pytest.approx(W.rank_correlation(x[None])[0, 0], abs=2e-6))


def test_pair_purified_against_least_squares(spark):
    sf = "/root/testdata/sf0.01"
    closes = defaultdict(dict)
    for r in hourly(spark, sf).collect():
        closes[r.symbol][r.ts] = r.close
    got = {(r.first_market, r.second_market, r.ts): r.purified for r in catalog.queries()["pair_purified"](spark, sf).collect()}
    checked = 0
    for a in closes:
        for b in closes:
            times = sorted(closes[a].keys() & closes[b].keys()) if a < b else []
            assert all(got[a, b, t] is None for t in times[:79])
            for end in range(79, len(times), 7):
                y, x = (np.array([closes[s][t] for t in times[end - 79 : end + 1]]) for s in (a, b))
                rows = [(1.0, x[i], x[i] - x[i - 20], (x[i - 20] + x[i]) / 2 - x[i - 10], x[i - 20 : i + 1].std()) for i in range(20, 80)]
                fit, *_ = np.linalg.lstsq(np.array(rows), y[20:], rcond=None)
                rest = y[20:] - np.array(rows) @ fit
                assert got[a, b, times[end]] == pytest.approx(rest[-1] / rest.std(), abs=2e-5)
                checked += 1
    assert checked > 500


def test_panel_risk_against_arrays(spark):
    sf = "/root/testdata/sf0.01"
    closes = defaultdict(dict)
    for r in hourly(spark, sf).collect():
        closes[r.ts][r.symbol] = r.close
    markets = sorted({s for rows in closes.values() for s in rows})
    times = sorted(t for t, rows in closes.items() if len(rows) == len(markets))
    got = {r.ts: r for r in catalog.queries()["panel_risk"](spark, sf).collect()}
    assert got.keys() == set(times) and len(times) > 100
    x = np.log([[closes[t][m] for m in markets] for t in times])
    for end in range(len(times)):
        r = got[times[end]]
        if end < 59:
            assert r.abs_ratio is None and r.mahalanobis is None
            continue
        d = np.diff(x[end - 59 : end + 1], axis=0)
        values = sorted(np.linalg.eigvalsh(np.cov(d.T)), reverse=True)
        assert r.abs_ratio == pytest.approx(sum(values[:2]) / sum(values), abs=2e-6)
        spectrum = np.array(sorted(np.linalg.eigvalsh(np.corrcoef(d.T)), reverse=True))
        assert r.coherence == pytest.approx((spectrum * np.linspace(1, -1, len(markets))).sum() / len(markets), abs=2e-6)
        gap = d[-1] - d[:-1].mean(axis=0)
        distance = gap @ np.linalg.solve(np.cov(d[:-1].T), gap)
        k, m = 58, len(markets)
        chance = W.f_cdf(distance * k * (k - m) / (m * (k - 1) * (k + 1)), m, k - m)
        assert r.mahalanobis == pytest.approx(math.log(chance / (1 - chance)), abs=2e-5)


def test_circular_shifts_against_rolls(spark):
    """Every drawn shift of the positions, earned by hand."""
    path = defaultdict(list)
    for r in catalog.queries()["backtest_path"](spark, DATA).orderBy("ts").collect():
        path[r.symbol].append(r)
    returns = defaultdict(dict)
    for symbol, rows in path.items():
        closes = [b.close for b in hourly(spark, DATA).where(F.col("symbol") == symbol).orderBy("ts").collect()]
        returns[symbol] = [b / a - 1 for a, b in zip(closes, closes[1:], strict=False)]
    for r in run(spark, "circular_shift_null"):
        p, x = np.array([q.position for q in path[r.symbol]][1:]), np.array(returns[r.symbol])
        drawn = np.random.default_rng(0).integers(1, len(p), 500)
        earned = [float(np.roll(p, s) @ x) for s in drawn]
        assert r.total == pytest.approx(float(p @ x))
        assert r.p_value == pytest.approx(np.mean([e >= r.total - 1e-9 for e in earned]), abs=0.005)


def test_adaptive_change_against_a_loop(spark):
    got = defaultdict(list)
    for r in run(spark, "machine_adaptive_change"):
        got[r.symbol].append((r.direction, r.start_pos, r.end_pos, r.confirm_pos, pytest.approx(r.theta)))
    closes = defaultdict(list)
    for r in hourly(spark, DATA).orderBy("ts").collect():
        closes[r.symbol].append(r.close)
    for symbol, x in closes.items():
        theta, base, side, want = 0.5, None, 0, []
        high = low = start = best = 0
        for i, p in enumerate(x):
            if i and not side:
                high, low = (i if p > x[high] else high), (i if p < x[low] else low)
                if p <= x[high] * (1 - theta):
                    side, start, best = -1, high, i
                elif p >= x[low] * (1 + theta):
                    side, start, best = 1, low, i
            elif side:
                best = i if (p - x[best]) * side > 0 else best
                if (p <= x[best] * (1 - theta)) if side > 0 else (p >= x[best] * (1 + theta)):
                    want.append((side, start, best, i, theta))
                    side, start, best = -side, best, i
            if i >= 47 and (i + 1) % 24 == 0:
                value = float(np.diff(np.log(x[i - 47 : i + 1])).std())
                base = base or value
                theta = min(max(theta * (1 + 0.5 * (value - base) / (abs(base) + 1e-10)), 0.1), 2.0)
        assert sorted(got[symbol], key=lambda t: t[3]) == want


def test_hidden_markov_query_fits_every_symbol(spark):
    """The query's parameters are those of a fit to each symbol's returns, and no other start of two states is better by much."""
    closes = defaultdict(list)
    for r in hourly(spark, DATA).orderBy("ts").collect():
        closes[r.symbol].append(r.close)
    got = defaultdict(dict)
    for r in run(spark, "hidden_markov_fit"):
        got[r.symbol][r.state] = r
    assert got.keys() == closes.keys()
    for symbol, c in closes.items():
        x = np.diff(np.log(c))
        fit = R.fit_chain(x, 2)
        for state, r in got[symbol].items():
            assert (r["mean"], r.sd, r.loglik) == pytest.approx((fit["means"][state], fit["sds"][state], float(fit["loglik"])))
            assert r.moves == pytest.approx(fit["moves"][state].tolist()) and sum(r.moves) == pytest.approx(1)
        # the likelihood by a plain forward pass
        p, total = fit["start"].copy(), 0.0
        for i, v in enumerate(x):
            p = (p @ fit["moves"] if i else p) * np.exp(-0.5 * ((v - fit["means"]) / fit["sds"]) ** 2) / fit["sds"] / math.sqrt(2 * math.pi)
            total += math.log(p.sum())
            p /= p.sum()
        assert total == pytest.approx(float(fit["loglik"]), rel=1e-3)
        alone = -0.5 * len(x) * (math.log(2 * math.pi * x.var()) + 1)
        assert total > alone
