"""Queries of regimes, rolling kernels, panels and statistical tests, with SQL where there is any."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions import posterior, price, scaling
from lodestream.functions.frames import Keyed, div, ln, running
from lodestream.operators import evaluation as V
from lodestream.operators import kernels as M
from lodestream.operators import regimes as R
from lodestream.operators import rolling_kernels as W
from lodestream.plans.machines import RETURNS, returns
from lodestream.plans.relational import BACKTEST, CHANCES_SQL, STATES_SQL, _tested, query, r, states, tidied
from lodestream.plans.suite import BARS_SQL, P, SO_FAR, events, hourly, tidy, w

K = Keyed()
KV = Keyed(("block",), "vec_id")
C = F.col


PROBS_SQL = f"""{CHANCES_SQL},
st AS (SELECT *, list_position(p, list_max(p)) - 1 AS state, list_max(p) AS top, list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0.0 END)) AS entropy, list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2] AS margin FROM pr)"""
BLOCK = "OVER (PARTITION BY block ORDER BY vec_id)"
W10 = "OVER (PARTITION BY block ORDER BY vec_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


def probs(spark, sf_dir) -> DataFrame:
    """Posteriors of all components, a row for each vector that has any."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", F.floor(C("vec_id") / 100).cast("long").alias("block"), posterior.normalise_or_even("embedding").alias("p"), "label").where("p is not null")


def _width(rows: DataFrame) -> int:
    """Components of a posterior, the most that a row has."""
    return rows.agg(F.max(F.size("p"))).first()[0] or 1


@query(f"""WITH {PROBS_SQL}, f AS (SELECT *, CASE WHEN state <> lag(state) {BLOCK} THEN 1 ELSE 0 END AS flip FROM st), g AS (SELECT *, sum(flip) OVER (PARTITION BY block ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT vec_id, CAST(state AS INTEGER) AS state, {r(f"avg(flip) {W10}", "flip_rate")}, {r(f"stddev_pop(entropy) {W10}", "entropy_sd")}, {r(f"stddev_pop(top) {W10}", "top_sd")}, CAST(row_number() OVER (PARTITION BY block, run ORDER BY vec_id) AS INTEGER) AS dwell FROM g""")
def posterior_dynamics(spark, sf_dir):
    found = R.posterior_dynamics(probs(spark, sf_dir), "p", KV, 10).select("vec_id", "state", "flip_rate", "entropy_sd", "top_sd", "dwell")
    return tidied(found, "flip_rate", "entropy_sd", "top_sd")


@query(f"""WITH {PROBS_SQL}, g AS (SELECT *, CASE WHEN round(top, 9) >= 0.08 AND round(margin, 9) >= 0.005 AND round(entropy, 9) <= round(0.83 * ln(len(p)), 9) THEN state END AS s FROM st)
SELECT vec_id, CAST(coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY block ORDER BY vec_id ROWS UNBOUNDED PRECEDING), -1) AS INTEGER) AS gated_state FROM g""")
def posterior_gates(spark, sf_dir):
    return R.gated(probs(spark, sf_dir), "p", KV, *GATES).select("vec_id", "gated_state")


#: Least chance, margin and most entropy (of its greatest) of a state that is taken.
GATES = (0.08, 0.005, 0.83)


@query(f"""WITH {PROBS_SQL} SELECT vec_id, {r(f"coalesce(lag(p[1], 3) {BLOCK}, 1.0 / len(p))", "matured_first")}, {r("pow(greatest(p[1], 1e-12), 0.5) / list_sum(list_transform(p, lambda x: pow(greatest(x, 1e-12), 0.5)))", "tempered_first")} FROM pr""")
def posterior_transforms(spark, sf_dir):
    rows = probs(spark, sf_dir)
    rows = R.matured(rows, "p", KV, 3, _width(rows))
    return rows.select("vec_id", tidy(F.get("matured", F.lit(0))).alias("matured_first"), tidy(F.get(R.tempered(C("p"), 2.0), F.lit(0))).alias("tempered_first"))


@query(f"""WITH c AS (SELECT value / 500 AS chance, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS hit FROM events)
SELECT CAST(least(floor(chance * 10), 9) AS INTEGER) AS bin, count(*) AS n, {r("avg(chance)", "chance")}, {r("avg(hit)", "rate")}, {r("abs(avg(chance) - avg(hit))", "gap")} FROM c GROUP BY 1""")
def calibration_bins(spark, sf_dir):
    rows = events(spark, sf_dir).select((C("value") / 500).alias("chance"), F.when(C("event_id") % 3 == 0, 1.0).otherwise(0.0).alias("hit"))
    return tidied(R.calibration(rows, "chance", "hit", 10), "chance", "rate", "gap")


@query(f"""WITH c AS (SELECT value, count(*) FILTER (WHERE event_type = 'click') AS na, count(*) FILTER (WHERE event_type = 'view') AS nb FROM events WHERE event_type IN ('click', 'view') GROUP BY value),
g AS (SELECT abs(sum(na) OVER o / sum(na) OVER () - sum(nb) OVER o / sum(nb) OVER ()) AS gap FROM c WINDOW o AS (ORDER BY value ROWS UNBOUNDED PRECEDING)) SELECT {r("max(gap)", "ks")} FROM g""")
def kolmogorov_smirnov(spark, sf_dir):
    return tidied(R.kolmogorov_smirnov(events(spark, sf_dir).select("event_type", "value"), "value", "event_type", "click", "view"), "ks")


HAC = " + ".join(f"2 * {1 - i / 6!r} * coalesce(x * lag(x, {i}) {P}, 0.0)" for i in range(1, 6))


@query(f"""WITH {STATES_SQL}, c AS (SELECT symbol, ts, ret - avg(ret) OVER (PARTITION BY symbol) AS x FROM states WHERE ret IS NOT NULL), p AS (SELECT symbol, x * x + {HAC} AS p FROM c)
SELECT symbol, count(*) AS n, {r("sum(p)", "variance", 4)} FROM p GROUP BY symbol""")
def hac_variance(spark, sf_dir):
    return tidied(R.hac_variance(states(spark, sf_dir), "ret", K, 5), "variance", digits=4)


@query(f"""WITH {BACKTEST}, s AS (SELECT symbol, sum(position * ret) AS total, avg(position) AS m, sum(ret) AS t FROM e WHERE ret IS NOT NULL GROUP BY symbol)
SELECT symbol, {r("total", digits=5)}, {r("m", "mean_exposure", 5)}, {r("m * t", "beta", 5)}, {r("total - m * t", "timing", 5)} FROM s""")
def beta_timing(spark, sf_dir):
    return tidied(R.beta_timing(_tested(spark, sf_dir), "position", "ret"), "total", "mean_exposure", "beta", "timing", digits=5)


@query(f"""WITH {BARS_SQL}, v AS (SELECT symbol, ts, stddev_samp(ln(close / open)) {w(20)} AS vol, count(*) {w(20)} AS n FROM bars), q AS (SELECT symbol, ts, CASE WHEN n >= 20 THEN vol END AS vol FROM v),
z AS (SELECT *, CASE WHEN count(vol) {w(20)} >= 20 THEN quantile_cont(vol, 0.3) {w(20)} END AS lo, CASE WHEN count(vol) {w(20)} >= 20 THEN quantile_cont(vol, 0.7) {w(20)} END AS hi FROM q)
SELECT symbol, ts, CAST(CASE WHEN round(vol, 9) > round(hi, 9) THEN 1 WHEN round(vol, 9) < round(lo, 9) THEN -1 ELSE 0 END AS INTEGER) AS label FROM z WHERE hi IS NOT NULL""")
def label_volatility_quantiles(spark, sf_dir):
    rows = hourly(spark, sf_dir).withColumn("vol", K.sd(ln(div("close", "open")), 20))
    q = lambda p: K.full(F.percentile("vol", p).over(K.trailing(20)), "vol", 20)
    rows = rows.withColumn("lo", F.round(q(0.3), 9)).withColumn("hi", F.round(q(0.7), 9)).where("hi is not null")
    vol = F.round("vol", 9)
    return rows.select("symbol", "ts", F.when(vol > C("hi"), 1).when(vol < C("lo"), -1).otherwise(0).alias("label"))


@query(f"""WITH {BARS_SQL}, p AS (SELECT symbol, ts, volume, hour(ts) AS phase FROM bars), x AS (SELECT symbol, ts, volume, avg(volume) OVER o AS m, stddev_samp(volume) OVER o AS s, count(volume) OVER o AS n FROM p WINDOW o AS (PARTITION BY symbol, phase ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT symbol, ts, {r("CASE WHEN n >= 5 THEN (volume - m) / (s + 1e-10) END", "phase_z")} FROM x""")
def volume_phase_zscore(spark, sf_dir):
    """Against all bars of the same hour of the day so far, of which there must be five."""
    past = Window.partitionBy("symbol", F.hour("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    z = F.when(F.count("volume").over(past) >= 5, (C("volume") - F.avg("volume").over(past)) / (F.stddev_samp("volume").over(past) + 1e-10))
    return hourly(spark, sf_dir).select("symbol", "ts", tidy(z).alias("phase_z"))


@query(f"""WITH {BARS_SQL}, e AS (SELECT min(volume) AS lo, max(volume) AS hi FROM bars), b AS (SELECT CAST(least(floor((volume - lo) * 4 / (hi - lo)), 3) AS INTEGER) AS bin FROM bars, e) SELECT bin, count(*) AS n FROM b GROUP BY bin""")
def volume_equal_width_bins(spark, sf_dir):
    return scaling.equal_width(hourly(spark, sf_dir), "volume", 4, "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT user_id % 50 AS x, count(*) AS n FROM events GROUP BY 1), s AS (SELECT x, n, CAST(floor((sum(n) OVER (ORDER BY x) - n + (n - 1) / 2.0) * 6 / sum(n) OVER ()) AS INTEGER) AS bin FROM c)
SELECT bin, CAST(sum(n) AS BIGINT) AS n, min(x) AS least, max(x) AS most FROM s GROUP BY bin""")
def tied_bins(spark, sf_dir):
    rows = scaling.tied_bins(events(spark, sf_dir).select((C("user_id") % 50).alias("x")), "x", 6, "bin")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))


@query(f"""WITH m AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id, {r("(value - m) / s", "z")} FROM events, m""")
def standardised(spark, sf_dir):
    return scaling.standardise(events(spark, sf_dir).select("event_id", "value"), "value", "z").select("event_id", tidy("z").alias("z"))


@query(f"""WITH {BACKTEST}, n AS (SELECT symbol, log_equity AS y, CAST(row_number() {P} AS DOUBLE) AS x FROM e),
s AS (SELECT symbol, count(*) AS n, regr_slope(y, x) AS b, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(x, y) AS c FROM n GROUP BY symbol)
SELECT symbol, {r("b / nullif(sqrt(greatest(vy - c * c / vx, 0.0) / vx / (n - 2)), 0) / sqrt(n)", "k_ratio", 5)} FROM s""")
def k_ratio(spark, sf_dir):
    """Slope of the log equity over its standard error, over the root of the rows."""
    rows = _tested(spark, sf_dir).withColumn("x", K.number().cast("double"))
    n, vx, c = F.count(F.lit(1)), F.var_pop("x"), F.covar_pop("x", "log_equity")
    rest = F.greatest(F.var_pop("log_equity") - div(c * c, vx), F.lit(0.0))
    error = F.sqrt(div(rest, vx) / (n - 2))
    return rows.groupBy("symbol").agg(tidy(div(div(c, vx), error) / F.sqrt(n), 5).alias("k_ratio"))


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice AS v, coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false) AS urgent FROM orders),
a AS (SELECT date, sum(v) AS v FROM o WHERE urgent GROUP BY 1), b AS (SELECT date, sum(v) AS v FROM o WHERE NOT urgent GROUP BY 1)
SELECT CAST(coalesce(a.date, b.date) AS VARCHAR) AS date, round(a.v / b.v + 1.2345e-8, 6) + 0.0 AS ratio, CAST(greatest(a.date, b.date) AS VARCHAR) AS available FROM a FULL JOIN b ON a.date = b.date""")
def macro_ratio(spark, sf_dir):
    """The orders of the two upper priorities over all others, aligned by a full outer join; known when the later of the two is."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    urgent = F.coalesce(C("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit(False))
    side = lambda which, v: orders.where(which).groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias(v), F.max(F.to_date("o_orderdate")).alias(f"{v}_known"))
    both = side(urgent, "a").join(side(~urgent, "b"), "date", "full_outer")
    return both.select(C("date").cast("string").alias("date"), tidy(div("a", "b")).alias("ratio"), F.greatest("a_known", "b_known").cast("string").alias("available"))


@query(f"""WITH {STATES_SQL}, n AS (SELECT symbol, ts, state, CASE WHEN volume > 3 THEN 1 ELSE 0 END AS b, CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END AS c FROM states WHERE state IS NOT NULL)
SELECT symbol, ts, CAST(CASE WHEN state = b OR state = c THEN state WHEN b = c THEN b ELSE 0 END AS INTEGER) AS consensus FROM n""")
def label_consensus(spark, sf_dir):
    rows = states(spark, sf_dir).where("state is not null")
    labels = F.array(C("state"), F.when(C("volume") > 3, 1).otherwise(0), F.when(C("close") > C("open"), 1).when(C("close") < C("open"), -1).otherwise(0))
    votes = F.filter(labels, lambda x: F.size(F.filter(labels, lambda y: y == x)) >= 2)
    return rows.select("symbol", "ts", F.coalesce(F.get(votes, F.lit(0)), F.lit(0)).alias("consensus"))


@query(f"""WITH {STATES_SQL}, m AS (SELECT state, avg(ret) AS mean FROM states WHERE state IS NOT NULL GROUP BY state) SELECT state, CAST(dense_rank() OVER (ORDER BY mean) AS INTEGER) AS score FROM m""")
def label_momentum_score(spark, sf_dir):
    means = states(spark, sf_dir).where("state is not null").groupBy("state").agg(F.avg("ret").alias("mean"))
    return means.select("state", F.dense_rank().over(Window.orderBy("mean")).alias("score"))


@query(f"""WITH {STATES_SQL}, x AS (SELECT symbol, CAST(ntile(4) {P} - 1 AS INTEGER) AS block, volume AS x, lead(ret) {P} AS y FROM states),
k AS (SELECT symbol, block, rank() OVER (PARTITION BY symbol, block ORDER BY x) + (count(*) OVER (PARTITION BY symbol, block, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY symbol, block ORDER BY y) + (count(*) OVER (PARTITION BY symbol, block, y) - 1) / 2.0 AS ry FROM x WHERE y IS NOT NULL),
i AS (SELECT symbol, block, corr(rx, ry) AS ic FROM k GROUP BY 1, 2)
SELECT symbol, count(ic) AS blocks, {r("avg(ic)", "mean_ic")}, {r("avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)", "positive")} FROM i GROUP BY symbol""")
def screen_block_ic(spark, sf_dir):
    """Stability of a feature: its rank correlation with the next return in each block of time."""
    rows = V.walk_forward_folds(states(spark, sf_dir), 4).withColumnRenamed("fold", "block").select("symbol", "block", C("volume").alias("x"), K.lead("ret").alias("y"))
    ic = V.spearman(rows, "x", "y", ["symbol", "block"])
    found = ic.groupBy("symbol").agg(F.count("ic").alias("blocks"), F.avg("ic").alias("mean_ic"), F.avg((C("ic") > 0).cast("double")).alias("positive"))
    return tidied(found, "mean_ic", "positive")


# kernels of rolling windows


def _rolling(spark, sf_dir, n, fn, outputs, inputs=("ret",)):
    return W.rolling(returns(spark, sf_dir), n, fn, outputs, inputs)


def _windows(n: int, x: str = "ret") -> str:
    """Rows of returns with the trailing n values as a list x, null where there are fewer."""
    return f"{RETURNS}, bw AS (SELECT symbol, ts, close FROM bars), x AS (SELECT symbol, ts, CASE WHEN count({x}) {w(n)} >= {n} THEN list({x}) {w(n)} END AS x FROM {'n' if x == 'ret' else 'bw'})"


def _rescaled(n: int, whole: int) -> str:
    """Mean rescaled range of the parts of length n of a list x."""
    path = f"list_transform(range(1, {n + 1}), lambda i: list_sum(d[1:i]))"
    part = f"list_transform([x[k * {n} + 1:(k + 1) * {n}]], lambda q: list_transform(q, lambda v: v - list_avg(q)))[1]"
    one = f"list_transform([{part}], lambda d: CASE WHEN list_sum(list_transform(d, lambda v: v * v)) > 0 THEN (list_max({path}) - list_min({path})) / sqrt(list_avg(list_transform(d, lambda v: v * v))) END)[1]"
    return f"ln(list_avg(list_transform(range(0, {whole // n}), lambda k: {one})))"


_LENGTHS = [64, 32, 16, 8]
_CENTRE = [math.log(n) - sum(map(math.log, _LENGTHS)) / 4 for n in _LENGTHS]
HURST = " + ".join(f"({c / sum(v * v for v in _CENTRE)!r}) * {_rescaled(n, 64)}" for c, n in zip(_CENTRE, _LENGTHS, strict=True))


@query(f"""WITH {_windows(64)} SELECT symbol, ts, {r(f"CASE WHEN x IS NOT NULL THEN {HURST} END", "hurst", 5)} FROM x""")
def kernel_hurst(spark, sf_dir):
    return tidied(_rolling(spark, sf_dir, 64, W.hurst, "hurst double"), "hurst", digits=5)


_CHI = " + ".join(f"pow(q / 2, {k}) / {math.factorial(k)}" for k in range(5))


@query(f"""WITH {_windows(60)}, d AS (SELECT symbol, ts, list_transform(x, lambda v: v - list_avg(x)) AS d FROM x),
q AS (SELECT symbol, ts, 60 * 62 * list_sum(list_transform(range(1, 11), lambda k: pow(list_sum(list_transform(range(1, 61 - k), lambda i: d[i] * d[i + k])) / list_sum(list_transform(d, lambda v: v * v)), 2) / (60 - k))) AS q FROM d)
SELECT symbol, ts, {r("q", digits=5)}, {r(f"exp(-q / 2) * ({_CHI})", "p_value")} FROM q""")
def kernel_ljung_box(spark, sf_dir):
    return tidied(tidied(_rolling(spark, sf_dir, 60, W.ljung_box(10), "q double, p_value double"), "p_value"), "q", digits=5)


@query(f"""WITH {_windows(50)}, s AS (SELECT symbol, ts, list_filter(list_transform(x, lambda v: sign(v)), lambda v: v <> 0) AS s FROM x),
c AS (SELECT symbol, ts, len(list_filter(s, lambda v: v > 0))::DOUBLE AS u, len(list_filter(s, lambda v: v < 0))::DOUBLE AS d, list_sum(list_transform(range(2, len(s) + 1), lambda i: CASE WHEN s[i] <> s[i - 1] THEN 1 ELSE 0 END)) + 1 AS runs FROM s)
SELECT symbol, ts, {r("CASE WHEN u > 0 AND d > 0 AND u + d >= 3 AND 2 * u * d > u + d THEN (runs - 1 - 2 * u * d / (u + d)) / sqrt(2 * u * d * (2 * u * d - u - d) / ((u + d) * (u + d) * (u + d - 1))) END", "z")} FROM c""")
def kernel_runs_test(spark, sf_dir):
    return tidied(_rolling(spark, sf_dir, 50, W.runs_test, "z double"), "z")


@query(f"""WITH {_windows(81, "close")}, u AS (SELECT symbol, ts, list_transform(range(1, 81), lambda i: CASE WHEN x[i + 1] > x[i] THEN 1 ELSE 0 END) AS u, x FROM x),
v AS (SELECT symbol, ts, x, list_transform(range(1, 79), lambda i: u[i] + 2 * u[i + 1] + 4 * u[i + 2]) AS v, u FROM u),
j AS (SELECT symbol, ts, x, v, list_transform(range(0, 16), lambda c: len(list_filter(range(1, 78), lambda i: 2 * v[i] + u[i + 3] = c)) / 77.0) AS j FROM v)
SELECT symbol, ts, {r("CASE WHEN x IS NOT NULL THEN -list_sum(list_transform(list_transform(range(0, 8), lambda c: len(list_filter(v, lambda y: y = c)) / 78.0), lambda s: CASE WHEN s > 0 THEN s * log2(s) ELSE 0.0 END)) / 3 END", "entropy")},
  {r("CASE WHEN x IS NOT NULL THEN list_sum(list_transform(range(0, 16), lambda c: CASE WHEN j[c + 1] > 0 THEN j[c + 1] * ln(j[c + 1] / ((j[c // 2 * 2 + 1] + j[c // 2 * 2 + 2]) * list_sum(list_transform(range(0, 8), lambda b: j[2 * b + c % 2 + 1])))) ELSE 0.0 END)) END", "mutual_information")} FROM j""")
def kernel_word_entropy(spark, sf_dir):
    return tidied(_rolling(spark, sf_dir, 81, W.word_entropy(3), "entropy double, mutual_information double", ("close",)), "entropy", "mutual_information")


@query(f"""WITH RECURSIVE {BARS_SQL}, k AS (SELECT *, row_number() {P} AS i FROM bars), z AS (
  SELECT a.symbol, a.i AS start, a.i AS i, a.close AS x, 0 AS side, 0 AS turns FROM k a JOIN k b ON b.symbol = a.symbol AND b.i = a.i + 47 UNION ALL
  SELECT symbol, start, i, CASE WHEN side = 0 AND now = 0 OR side <> 0 AND now = side AND (p - x) * side <= 0 THEN x ELSE p END, now, turns + CASE WHEN side <> 0 AND now <> side THEN 1 ELSE 0 END FROM (
    SELECT z.symbol, z.start, k.i, k.close AS p, z.x, z.side, z.turns, CASE WHEN z.side = 0 THEN CASE WHEN abs(k.close / z.x - 1) > 0.5 THEN CASE WHEN k.close > z.x THEN 1 ELSE -1 END ELSE 0 END
      WHEN z.side * (k.close - z.x) <= 0 AND z.side * (z.x - k.close) > 0.5 * z.x THEN -z.side ELSE z.side END AS now FROM z JOIN k ON k.symbol = z.symbol AND k.i = z.i + 1 WHERE z.i < z.start + 47))
SELECT k.symbol, k.ts, {r("z.turns / 48.0", "density")} FROM k LEFT JOIN z ON z.symbol = k.symbol AND z.i = k.i AND z.i = z.start + 47""")
def kernel_zigzag_density(spark, sf_dir):
    return tidied(_rolling(spark, sf_dir, 48, W.zigzag_density(0.5), "density double", ("close",)), "density")


_SMOOTH = W.savitzky_golay(11, 2)


@query(f"""WITH {BARS_SQL} SELECT symbol, ts, {r(f"CASE WHEN count(close) {w(11)} >= 11 THEN " + " + ".join(f"({c!r}) * coalesce(lag(close, {10 - i}) {P}, 0)" for i, c in enumerate(_SMOOTH)) + " END", "smoothed")} FROM bars""")
def kernel_savitzky_golay(spark, sf_dir):
    """A fixed filter: the last value of the parabola through the trailing eleven closes."""
    return hourly(spark, sf_dir).select("symbol", "ts", tidy(price.fir(K, "close", _SMOOTH)).alias("smoothed"))


def _panel(spark, sf_dir) -> DataFrame:
    """Closes of all markets at the times that all have, as one key."""
    wide = hourly(spark, sf_dir).groupBy("ts").pivot("symbol").agg(F.max("close"))
    return wide.withColumn("panel", F.lit("all")).dropna()


def _pairs(spark, sf_dir) -> DataFrame:
    """Closes of every two markets at the times that both have, each pair a key."""
    closes = hourly(spark, sf_dir).select("ts", "symbol", "close")
    side = lambda n: closes.select("ts", C("symbol").alias(f"{n}_market"), C("close").alias(n))
    return side("first").join(side("second"), "ts").where("first_market < second_market")


PAIR = ("first_market", "second_market")
PAIRS_SQL = f"{BARS_SQL}, pairs AS (SELECT a.symbol AS first_market, b.symbol AS second_market, a.ts, a.close AS y, b.close AS x FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol)"


def _pair_window(n: int) -> str:
    return f"OVER (PARTITION BY first_market, second_market ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _ranks(a: str) -> str:
    return f"list_transform({a}, lambda v: len(list_filter({a}, lambda o: o < v)) + (len(list_filter({a}, lambda o: o = v)) + 1) / 2.0 - 32)"


@query(f"""WITH {PAIRS_SQL}, l AS (SELECT first_market, second_market, ts, CASE WHEN count(*) {_pair_window(63)} >= 63 THEN list(y) {_pair_window(63)} END AS y, list(x) {_pair_window(63)} AS x FROM pairs),
k AS (SELECT first_market, second_market, ts, {_ranks("y")} AS a, {_ranks("x")} AS b FROM l)
SELECT first_market, second_market, ts, {r("list_dot_product(a, b) / nullif(sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 0)", "rho")} FROM k""")
def pair_rank_correlation(spark, sf_dir):
    return tidied(W.rolling(_pairs(spark, sf_dir), 63, W.rank_correlation, "rho double", ("first", "second"), PAIR), "rho")


@query(f"""WITH {PAIRS_SQL}, g AS (SELECT *, count(*) {_pair_window(20)} AS n, regr_sxx(y, x) {_pair_window(20)} AS sxx, regr_syy(y, x) {_pair_window(20)} AS syy, regr_sxy(y, x) {_pair_window(20)} AS sxy, avg(y) {_pair_window(20)} AS my, avg(x) {_pair_window(20)} AS mx FROM pairs),
d AS (SELECT *, y - my - sxy / nullif(sxx, 0) * (x - mx) AS rest, sqrt(greatest(syy - sxy * sxy / nullif(sxx, 0), 0) / 18) AS s FROM g)
SELECT first_market, second_market, ts, {r("CASE WHEN n >= 20 AND sxx > 1e-18 THEN CASE WHEN s > 1e-12 THEN rest / s ELSE 0.0 END END", "deviation", 5)} FROM d""")
def pair_deviation(spark, sf_dir):
    return tidied(W.rolling(_pairs(spark, sf_dir), 20, W.spread_deviation, "deviation double", ("first", "second"), PAIR), "deviation", digits=5)


@query()
def pair_purified(spark, sf_dir):
    """Held to a plain least-squares fit by a test: SQL has no regression on four columns."""
    return tidied(W.rolling(_pairs(spark, sf_dir), 80, W.purified(20, 20, 20), "purified double", ("first", "second"), PAIR), "purified")


@query()
def panel_risk(spark, sf_dir):
    """Held to plain arrays by a test: SQL has no eigenvalues."""
    wide = _panel(spark, sf_dir)
    markets = [c for c in wide.columns if c not in ("ts", "panel")]
    found = W.rolling(wide, 60, W.panel_risk(0.4), "abs_ratio double, coherence double, mahalanobis double", markets, ("panel",))
    return tidied(found, "abs_ratio", "coherence", "mahalanobis")


STRENGTH_SQL = f"""{BARS_SQL}, al AS (SELECT ts FROM bars GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)),
lr AS (SELECT symbol, ts, ln(close) - lag(ln(close)) {P} AS r, lag(ts) {P} AS was FROM bars WHERE ts IN (SELECT ts FROM al)),
md AS (SELECT ts, quantile_cont(r, 0.5) AS m FROM lr WHERE r IS NOT NULL GROUP BY ts),
sx AS (SELECT lr.*, CASE WHEN count(*) {w(40)} >= 40 THEN sum(r - m) {w(40)} END AS s FROM lr JOIN md USING (ts)),
pk AS (SELECT ts, arg_max(symbol, (round(s, 9), symbol)) AS leader, arg_min(symbol, (round(s, 9), symbol)) AS laggard, max(s) - min(s) AS spread FROM sx WHERE s IS NOT NULL GROUP BY ts)"""


@query(f"""WITH {STRENGTH_SQL}, eq AS (SELECT md.ts, md.m, coalesce(a.r, 0.0) AS a, coalesce(b.r, 0.0) AS b FROM md
  LEFT JOIN (SELECT lr.ts, lr.r FROM lr JOIN pk ON lr.was = pk.ts AND lr.symbol = pk.leader) a ON a.ts = md.ts LEFT JOIN (SELECT lr.ts, lr.r FROM lr JOIN pk ON lr.was = pk.ts AND lr.symbol = pk.laggard) b ON b.ts = md.ts),
cu AS (SELECT ts, sum(m) OVER o AS i, sum(a) OVER o AS a, sum(b) OVER o AS b FROM eq WINDOW o AS (ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT ts, {r("i", "market_index", 5)}, leader, laggard, {r("a", "leader_equity", 5)}, {r("b", "laggard_equity", 5)}, {r("spread", "strength_spread", 5)} FROM pk JOIN cu USING (ts)""")
def panel_relative_strength(spark, sf_dir):
    """Of each time that all markets have: the index of median returns, the strongest and weakest market over 40 rows, and what following them earned."""
    returns_, picks, middle = _strength(spark, sf_dir)
    follow = lambda side, out: returns_.join(picks.select(C("ts").alias("was"), C(side).alias("symbol")), ["was", "symbol"]).select("ts", C("r").alias(out))
    path = middle.join(follow("leader", "a"), "ts", "left").join(follow("laggard", "b"), "ts", "left").na.fill(0.0, ["a", "b"])
    path = running(path.withColumn("at", F.unix_micros(F.to_timestamp("ts"))), "at", {"m": "m", "a": "a", "b": "b"})
    total = lambda c, out: (C(f"{c}_before") + C(c)).alias(out)
    found = picks.join(path.select("ts", total("m", "market_index"), total("a", "leader_equity"), total("b", "laggard_equity")), "ts")
    return tidied(found.select("ts", "market_index", "leader", "laggard", "leader_equity", "laggard_equity", "strength_spread"), "market_index", "leader_equity", "laggard_equity", "strength_spread", digits=5)


@query(f"""WITH {STRENGTH_SQL} SELECT symbol, ts, {r("(row_number() OVER (PARTITION BY ts ORDER BY round(s, 9), symbol) - 1) / greatest(count(*) OVER (PARTITION BY ts) - 1, 1)", "fractile")} FROM sx WHERE s IS NOT NULL""")
def panel_fractiles(spark, sf_dir):
    """A market's place among all by its strength, 0 to 1."""
    at = Window.partitionBy("ts")
    place = F.row_number().over(at.orderBy(F.round("s", 9), "symbol"))
    found = _strengths(spark, sf_dir)[0].where("s is not null")
    return found.select("symbol", "ts", tidy((place - 1) / F.greatest(F.count(F.lit(1)).over(at) - 1, F.lit(1))).alias("fractile"))


def _strengths(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(symbol, ts, r, was, s): returns between times that all markets have, and their excess over the median summed over 40 rows; the medians."""
    bars = hourly(spark, sf_dir).select("symbol", "ts", F.log("close").alias("l"))
    markets = bars.agg(F.count_distinct("symbol").alias("k"))  # one row
    times = bars.groupBy("ts").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(markets)).where("n = k").select("ts")
    rows = bars.join(times, "ts", "left_semi").select("symbol", "ts", (C("l") - K.lag("l")).alias("r"), K.lag("ts").alias("was"))
    middle = rows.where("r is not null").groupBy("ts").agg(F.percentile("r", 0.5).alias("m"))
    rows = rows.join(middle, "ts").withColumn("_e", C("r") - C("m"))
    return rows.select("symbol", "ts", "r", "was", K.sum("_e", 40).alias("s")), middle


def _strength(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, middle = _strengths(spark, sf_dir)
    by = F.struct(F.round("s", 9), "symbol")
    picks = rows.where("s is not null").groupBy("ts").agg(F.max_by("symbol", by).alias("leader"), F.min_by("symbol", by).alias("laggard"), (F.max("s") - F.min("s")).alias("strength_spread"))
    return rows, picks, middle


@query()
def hidden_markov_fit(spark, sf_dir):
    return R.fit_chains(returns(spark, sf_dir), "ret", 2)


@query()
def circular_shift_null(spark, sf_dir):
    return R.circular_shift_null(_tested(spark, sf_dir), "position", "ret", 500)


def _chances(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    rows = probs(spark, sf_dir)
    columns = [f"p{i}" for i in range(_width(rows))]
    return rows.select("block", "vec_id", *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(columns)]), columns


BLOCKS_SQL = f"{CHANCES_SQL}, n AS (SELECT vec_id, block, p, row_number() OVER (PARTITION BY block ORDER BY vec_id) AS i FROM pr)"


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, e AS (SELECT block, vec_id, i, p AS h FROM n WHERE i = 1 UNION ALL
  SELECT n.block, n.vec_id, n.i, list_transform(list_zip(e.h, n.p), lambda z: z[1] + 0.2 * (z[2] - z[1])) FROM e JOIN n ON n.block = e.block AND n.i = e.i + 1)
SELECT block, vec_id, {r("h[1] / list_sum(h)", "first")}, {r("list_max(h) / list_sum(h)", "top")} FROM e""")
def posterior_smoothed(spark, sf_dir):
    rows, columns = _chances(spark, sf_dir)
    found = M.run(rows, lambda: R.SmoothedPosterior(columns), ("block",), "vec_id")
    return found.select("block", "vec_id", tidy(F.get("smoothed", F.lit(0))).alias("first"), tidy(F.array_max("smoothed")).alias("top"))


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, b AS (SELECT *, list_position(p, list_max(p)) AS best FROM n), e AS (SELECT block, vec_id, i, best AS state, NULL::BIGINT AS asked, 0 AS k FROM b WHERE i = 1 UNION ALL
  SELECT block, vec_id, i, CASE WHEN moved THEN best ELSE state END, CASE WHEN rising AND NOT moved THEN best END, CASE WHEN rising AND NOT moved THEN k ELSE 0 END FROM (
    SELECT *, rising AND low < 0.05 AND k >= 2 AS moved FROM (
      SELECT b.block, b.vec_id, b.i, b.best, e.state, b.p[e.state] AS low, b.best <> e.state AND list_max(b.p) >= 0.06 AS rising, CASE WHEN b.best = e.asked THEN e.k + 1 ELSE 1 END AS k FROM e JOIN b ON b.block = e.block AND b.i = e.i + 1)))
SELECT block, vec_id, CAST(state - 1 AS INTEGER) AS filtered FROM e""")
def posterior_hysteresis(spark, sf_dir):
    rows, columns = _chances(spark, sf_dir)
    return M.run(rows, lambda: R.Hysteresis(columns, 0.06, 0.05, 2), ("block",), "vec_id")


@query(f"""WITH RECURSIVE {STATES_SQL}, n AS (SELECT symbol, ts, state, row_number() {P} AS i FROM states WHERE state IS NOT NULL), e AS (SELECT symbol, ts, i, state AS held, NULL::INTEGER AS asked, 0 AS k FROM n WHERE i = 1 UNION ALL
  SELECT symbol, ts, i, CASE WHEN c >= 2 THEN state ELSE held END, CASE WHEN c BETWEEN 1 AND 1 THEN state END, CASE WHEN c >= 2 THEN 0 ELSE c END FROM (
    SELECT n.symbol, n.ts, n.i, n.state, e.held, CASE WHEN n.state = e.held THEN 0 WHEN n.state = e.asked THEN e.k + 1 ELSE 1 END AS c FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1))
SELECT symbol, ts, CAST(held AS INTEGER) AS filtered FROM e""")
def regime_least_duration(spark, sf_dir):
    return M.run(states(spark, sf_dir), lambda: R.LeastDuration("state", 2))
