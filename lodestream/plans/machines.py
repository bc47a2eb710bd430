"""Queries of sequential machines, with recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.functions.frames import Keyed, div, ln
from lodestream.operators import kernels as M
from lodestream.plans.relational import query, r, tidied
from lodestream.plans.suite import BARS_SQL, P, events, hourly, tidy

K = Keyed()
C = F.col

NUMBERED = f"n AS (SELECT *, row_number() {P} AS i FROM bars)"
#: Bars with a log return, numbered.
RETURNS = f"{BARS_SQL}, rets AS (SELECT *, ln(close / lag(close) {P}) AS ret FROM bars), n AS (SELECT symbol, ts, ret, row_number() {P} AS i FROM rets WHERE ret IS NOT NULL)"
NEXT = "FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1"


def returns(spark, sf_dir):
    return hourly(spark, sf_dir).withColumn("ret", ln(div("close", K.lag("close"))))


@query(f"""WITH RECURSIVE {BARS_SQL}, {NUMBERED}, e AS (
  SELECT symbol, ts, i, close AS f, close AS s, 0.0::DOUBLE AS g FROM n WHERE i = 1 UNION ALL
  SELECT symbol, ts, i, f, s, g + 0.2 * (f - s - g) AS g FROM (SELECT n.symbol, n.ts, n.i, e.f + 2.0 / 13 * (n.close - e.f) AS f, e.s + 2.0 / 27 * (n.close - e.s) AS s, e.g {NEXT}))
SELECT symbol, ts, {r("f", "fast", 5)}, {r("s", "slow", 5)}, {r("f - s", "macd", 5)}, {r("g", "signal", 5)} FROM e""")
def machine_macd(spark, sf_dir):
    return tidied(M.run(hourly(spark, sf_dir), M.Means), "fast", "slow", "macd", "signal", digits=5)


@query(f"""WITH RECURSIVE {BARS_SQL}, {NUMBERED}, e AS (
  SELECT symbol, ts, i, close AS start, close AS x, 0 AS side FROM n WHERE i = 1 UNION ALL
  SELECT symbol, ts, i, start, CASE WHEN now <> side THEN p WHEN (p - x) * side > 0 THEN p ELSE x END AS x, now AS side FROM (
    SELECT n.symbol, n.ts, n.i, e.start, e.x, e.side, n.close AS p,
      CASE WHEN e.side = 0 THEN CASE WHEN n.close - e.start > e.start * 0.5 THEN 1 WHEN e.start - n.close > e.start * 0.5 THEN -1 ELSE 0 END
           WHEN (n.close - e.x) * e.side <= 0 AND (e.x - n.close) * e.side > e.x * 0.5 THEN -e.side ELSE e.side END AS now
    {NEXT}))
SELECT symbol, ts, CAST(side AS INTEGER) AS label FROM e""")
def machine_trend_labels(spark, sf_dir):
    return M.run(hourly(spark, sf_dir), lambda: M.TrendFlip(0.5))


@query(f"""WITH RECURSIVE {RETURNS}, e AS (
  SELECT symbol, ts, 0::BIGINT AS i, 0.0::DOUBLE AS u, 0.0::DOUBLE AS d, 0 AS side FROM n WHERE i = 1 UNION ALL
  SELECT symbol, ts, i, CASE WHEN side = 0 THEN u ELSE 0.0 END, CASE WHEN side = 0 THEN d ELSE 0.0 END, side FROM (
    SELECT *, CASE WHEN u >= 2.0 THEN 1 WHEN d <= -2.0 THEN -1 ELSE 0 END AS side FROM (
      SELECT n.symbol, n.ts, n.i, greatest(0.0, e.u + n.ret) AS u, least(0.0, e.d + n.ret) AS d {NEXT})))
SELECT symbol, ts, CAST(side AS INTEGER) AS side FROM e WHERE side <> 0""")
def machine_cusum_events(spark, sf_dir):
    return M.run(returns(spark, sf_dir), lambda: M.CusumEvents(2.0))


@query(f"""WITH RECURSIVE {BARS_SQL}, {NUMBERED}, e AS (
  SELECT symbol, ts, i, close AS p, 0.0::DOUBLE AS v FROM n WHERE i = 1 UNION ALL
  SELECT n.symbol, n.ts, n.i, n.close, e.v + 2.0 / 51 * (pow(ln(n.close / e.p), 2) - e.v) {NEXT})
SELECT symbol, ts, {r("CASE WHEN i > 25 THEN sqrt(v) END", "vol")} FROM e""")
def machine_ewma_volatility(spark, sf_dir):
    return tidied(M.run(hourly(spark, sf_dir), lambda: M.EwmaVolatility(50)), "vol")


#: hp/hi and lp/li are the extremes before the first trend, sp/si its start, xp/xi the extreme so far; d* a trend that ended.
@query(f"""WITH RECURSIVE {BARS_SQL}, {NUMBERED}, e AS (
  SELECT symbol, ts, i, close AS p, 0 AS side, close AS hp, 0::BIGINT AS hi, close AS lp, 0::BIGINT AS li, close AS sp, 0::BIGINT AS si, close AS xp, 0::BIGINT AS xi,
    0 AS d, NULL::DOUBLE AS dsp, NULL::BIGINT AS dsi, NULL::DOUBLE AS dxp, NULL::BIGINT AS dxi FROM n WHERE i = 1 UNION ALL
  SELECT symbol, ts, i, p, CASE WHEN turned THEN -side WHEN side = 0 THEN begun ELSE side END, hp, hi, lp, li,
    CASE WHEN turned THEN xp WHEN begun = -1 THEN hp WHEN begun = 1 THEN lp ELSE sp END, CASE WHEN turned THEN xi WHEN begun = -1 THEN hi WHEN begun = 1 THEN li ELSE si END,
    CASE WHEN turned OR begun <> 0 THEN p ELSE xp END, CASE WHEN turned OR begun <> 0 THEN i - 1 ELSE xi END,
    CASE WHEN turned THEN side ELSE 0 END, sp, si, xp, xi FROM (
    SELECT *, CASE WHEN side <> 0 THEN 0 WHEN p <= hp * (1 - 0.5) THEN -1 WHEN p >= lp * (1 + 0.5) THEN 1 ELSE 0 END AS begun,
      side > 0 AND p <= xp * (1 - 0.5) OR side < 0 AND p >= xp * (1 + 0.5) AS turned FROM (
      SELECT n.symbol, n.ts, n.i, n.close AS p, e.side, e.sp, e.si,
        CASE WHEN e.side = 0 AND n.close > e.hp THEN n.close ELSE e.hp END AS hp, CASE WHEN e.side = 0 AND n.close > e.hp THEN n.i - 1 ELSE e.hi END AS hi,
        CASE WHEN e.side = 0 AND n.close < e.lp THEN n.close ELSE e.lp END AS lp, CASE WHEN e.side = 0 AND n.close < e.lp THEN n.i - 1 ELSE e.li END AS li,
        CASE WHEN (n.close - e.xp) * e.side > 0 THEN n.close ELSE e.xp END AS xp, CASE WHEN (n.close - e.xp) * e.side > 0 THEN n.i - 1 ELSE e.xi END AS xi
      {NEXT})))
SELECT symbol, ts, CAST(d AS INTEGER) AS direction, dsp AS start_price, dsi AS start_pos, dxp AS end_price, dxi AS end_pos, p AS confirm_price, i - 1 AS confirm_pos,
  {r("d * (dxp - dsp) / dsp / 0.5", "tmv")}, dxi - dsi AS t, {r("d * (dxp - dsp) / dsp / nullif(dxi - dsi, 0)", "r")} FROM e WHERE d <> 0""")
def machine_directional_change(spark, sf_dir):
    return tidied(M.run(hourly(spark, sf_dir), lambda: M.DirectionalChange(0.5)), "tmv", "r")


@query(f"""WITH RECURSIVE {BARS_SQL}, {NUMBERED}, e AS (
  SELECT symbol, ts, i, high, low, close, 0.0::DOUBLE AS tr, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l, 0.0::DOUBLE AS p, 0.0::DOUBLE AS m, 0.0::DOUBLE AS dx FROM n WHERE i = 1 UNION ALL
  SELECT symbol, ts, i, high, low, close, tr, g, l, p, m, CASE WHEN i < 15 THEN 0.0 WHEN i < 29 THEN dx + one / 14 ELSE (dx * 13 + one) / 14 END FROM (
    SELECT *, CASE WHEN tr > 0 AND p + m > 0 THEN 100 * abs(p - m) / (p + m) ELSE 0.0 END AS one FROM (
      SELECT symbol, ts, i, high, low, close, dx, keep * tr + now_tr AS tr, keep * g + greatest(change, 0) AS g, keep * l + greatest(-change, 0) AS l,
        keep * p + CASE WHEN up > greatest(down, 0) THEN up ELSE 0 END AS p, keep * m + CASE WHEN down > greatest(up, 0) THEN down ELSE 0 END AS m FROM (
        SELECT n.symbol, n.ts, n.i, n.high, n.low, n.close, e.tr, e.g, e.l, e.p, e.m, e.dx, CASE WHEN n.i <= 15 THEN 1.0 ELSE 13.0 / 14 END AS keep,
          greatest(n.high, e.close) - least(n.low, e.close) AS now_tr, n.close - e.close AS change, n.high - e.high AS up, e.low - n.low AS down {NEXT}))))
SELECT symbol, ts, {r("CASE WHEN i >= 15 THEN tr / 14 END", "atr")}, {r("CASE WHEN i >= 15 THEN CASE WHEN g + l > 0 THEN 100 * g / (g + l) ELSE 50.0 END END", "rsi")},
  {r("CASE WHEN i >= 15 THEN CASE WHEN tr > 0 THEN 100 * p / tr ELSE 0.0 END END", "plus_di")}, {r("CASE WHEN i >= 15 THEN CASE WHEN tr > 0 THEN 100 * m / tr ELSE 0.0 END END", "minus_di")}, {r("CASE WHEN i >= 28 THEN dx END", "adx")} FROM e""")
def machine_wilder(spark, sf_dir):
    return tidied(M.run(hourly(spark, sf_dir), M.Wilder), "atr", "rsi", "plus_di", "minus_di", "adx")


@query(f"""WITH RECURSIVE {BARS_SQL}, {NUMBERED}, e AS (
  SELECT symbol, ts, i, close, 0.0::DOUBLE AS u, 0.0::DOUBLE AS d FROM n WHERE i = 1 UNION ALL
  SELECT symbol, ts, i, close, CASE WHEN i < 14 THEN u + greatest(c, 0) WHEN i = 14 THEN (u + greatest(c, 0)) / 13 ELSE u * 13 / 14 + greatest(c, 0) / 14 END,
    CASE WHEN i < 14 THEN d + greatest(-c, 0) WHEN i = 14 THEN (d + greatest(-c, 0)) / 13 ELSE d * 13 / 14 + greatest(-c, 0) / 14 END FROM (
    SELECT n.symbol, n.ts, n.i, n.close, n.close - e.close AS c, e.u, e.d {NEXT}))
SELECT symbol, ts, {r("CASE WHEN i > 14 THEN 100 * u / (u + d + 1e-60) END", "rsi")} FROM e""")
def machine_rsi(spark, sf_dir):
    """Seeded by the mean of the first n - 1 changes."""
    return tidied(M.run(hourly(spark, sf_dir), M.SeededStrength), "rsi")


@query(f"""WITH RECURSIVE {BARS_SQL}, {NUMBERED}, s AS (SELECT symbol, CAST(round_even(close / 25, 0) AS BIGINT) AS k FROM n WHERE i = 1), e AS (
  SELECT symbol, NULL::TIMESTAMP AS ts, 0::BIGINT AS i, k, k AS top, k AS was, 0::BIGINT AS made, 0.0::DOUBLE AS vol, 0.0::DOUBLE AS held FROM s UNION ALL
  SELECT symbol, ts, i, least(top, CAST(ceil(low / 25) AS BIGINT)) AS k, top, was, made, CASE WHEN top > was OR least(top, CAST(ceil(low / 25) AS BIGINT)) < top THEN 0.0 ELSE held END AS vol, held FROM (
    SELECT n.symbol, n.ts, n.i, n.low, greatest(e.k, CAST(floor(n.high / 25) AS BIGINT)) AS top, e.k AS was, e.made + (e.top - e.was) + (e.top - e.k) AS made, e.vol + n.volume AS held {NEXT})),
b AS (SELECT symbol, ts, was, top, made, held, unnest(range(0, (top - was) + (top - k))) AS j FROM e WHERE i > 0)
SELECT symbol, ts, made + j AS brick_num, CAST(CASE WHEN j < top - was THEN 1 ELSE -1 END AS INTEGER) AS direction,
  CAST(25 * CASE WHEN j < top - was THEN was + j ELSE top - (j - (top - was)) END AS DOUBLE) AS brick_open, CAST(25 * CASE WHEN j < top - was THEN was + j + 1 ELSE top - (j - (top - was)) - 1 END AS DOUBLE) AS brick_close,
  CASE WHEN j = 0 THEN held ELSE 0.0 END AS brick_volume FROM b""")
def machine_renko(spark, sf_dir):
    return M.run(hourly(spark, sf_dir), lambda: M.Bricks(25.0))


@query(f"""WITH RECURSIVE {BARS_SQL}, {NUMBERED}, e AS (
  SELECT symbol, ts, i, close AS x, 1.0::DOUBLE AS err FROM n WHERE i = 1 UNION ALL
  SELECT symbol, ts, i, x + g * (p - x), (1 - g) * (err + 0.1) FROM (SELECT n.symbol, n.ts, n.i, n.close AS p, e.x, e.err, (e.err + 0.1) / (e.err + 1.1) AS g {NEXT}))
SELECT symbol, ts, {r("x", "level")} FROM e""")
def machine_kalman(spark, sf_dir):
    return tidied(M.run(hourly(spark, sf_dir), M.Kalman), "level")


#: Run length j - 1 has seen j - 1 values: kappa is j, and alpha 1 + (j - 1) / 2.
RUN_TABLES = """g AS (SELECT list_transform(range(1, 501), lambda j: lgamma((j + 2) / 2.0) - lgamma((j + 1) / 2.0) - 0.5 * ln(pi() * 2 * (j + 1) / j)) AS head, list_transform(range(1, 501), lambda j: -(j + 2) / 2.0) AS power, list_transform(range(1, 501), lambda j: 2.0 * (j + 1) / j) AS scale)"""


@query(f"""WITH RECURSIVE {RETURNS}, {RUN_TABLES}, e AS (
  SELECT symbol, ts, 0::BIGINT AS i, list_transform(range(0, 500), lambda j: CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS p, list_transform(range(0, 500), lambda j: 0.0::DOUBLE) AS m, list_transform(range(0, 500), lambda j: 1.0::DOUBLE) AS b FROM n WHERE i = 1 UNION ALL
  SELECT symbol, ts, i, list_concat([0.01::DOUBLE], list_concat(list_transform(q[1:498], lambda v: v * 0.99 / t), [(q[499] + q[500]) * 0.99 / t])) AS p,
    list_concat([0.0::DOUBLE], list_transform(range(1, 500), lambda j: m[j] + (ret - m[j]) / (j + 1))) AS m, list_concat([1.0::DOUBLE], list_transform(range(1, 500), lambda j: b[j] + 0.5 * j / (j + 1) * pow(ret - m[j], 2))) AS b FROM (
    SELECT *, list_sum(q) AS t FROM (
      SELECT *, list_transform(range(1, 501), lambda j: p[j] * exp(lg[j] - best)) AS q FROM (
        SELECT *, list_max(list_transform(range(1, 501), lambda j: CASE WHEN p[j] > 0 THEN lg[j] ELSE -1e300 END)) AS best FROM (
          SELECT n.symbol, n.ts, n.i, n.ret, e.p, e.m, e.b, list_transform(range(1, 501), lambda j: head[j] - 0.5 * ln(e.b[j]) + power[j] * ln(1 + pow(n.ret - e.m[j], 2) / (e.b[j] * scale[j]))) AS lg FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1 CROSS JOIN g)))))
SELECT symbol, ts, {r("p[1]", "change_prob")}, CAST(list_position(list_transform(p, lambda v: round(v, 9)), round(list_max(p), 9)) - 1 AS INTEGER) AS map_run, {r("list_sum(list_transform(p, lambda v, j: v * (j - 1)))", "mean_run", 4)} FROM e WHERE i > 0""")
def machine_change_points(spark, sf_dir):
    return tidied(tidied(M.run(returns(spark, sf_dir), M.RunLength), "change_prob"), "mean_run", digits=4)


@query(f"""WITH RECURSIVE {RETURNS}, e AS (
  SELECT symbol, ts, 0::BIGINT AS i, 0.0::DOUBLE AS u, 0.0::DOUBLE AS d FROM n WHERE i = 1 UNION ALL
  SELECT n.symbol, n.ts, n.i, greatest(0.0, e.u + n.ret - 0.5), greatest(0.0, e.d - n.ret - 0.5) {NEXT})
SELECT symbol, ts, {r("u", "s_up")}, {r("d", "s_down")} FROM e WHERE i > 0""")
def machine_cusum_statistic(spark, sf_dir):
    return tidied(M.run(returns(spark, sf_dir), lambda: M.CusumStatistic(M.NormalReference(0.0, 1.0, 0.5))), "s_up", "s_down")


@query(f"""WITH RECURSIVE {RETURNS}, e AS (
  SELECT symbol, ts, 0::BIGINT AS i, 0.0::DOUBLE AS m, 4.0::DOUBLE AS v, 0.0::DOUBLE AS u, 0.0::DOUBLE AS d FROM n WHERE i = 1 UNION ALL
  SELECT symbol, ts, i, m + 0.02 * gap, 0.98 * (v + 0.02 * gap * gap), greatest(0.0, u + gap / sqrt(greatest(v, 1e-24)) - 0.5), greatest(0.0, d - gap / sqrt(greatest(v, 1e-24)) - 0.5) FROM (
    SELECT n.symbol, n.ts, n.i, e.m, e.v, e.u, e.d, n.ret - e.m AS gap {NEXT}))
SELECT symbol, ts, {r("u", "s_up", 5)}, {r("d", "s_down", 5)} FROM e WHERE i > 0""")
def machine_cusum_adaptive(spark, sf_dir):
    """Against a reference that learns: an exponential mean and deviation of the values before."""
    return tidied(M.run(returns(spark, sf_dir), lambda: M.CusumStatistic(M.AdaptiveReference(0.0, 2.0, 0.5))), "s_up", "s_down", digits=5)


@query(f"""WITH RECURSIVE {RETURNS}, e AS (
  SELECT symbol, ts, 0::BIGINT AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM n WHERE i = 1 UNION ALL
  SELECT symbol, ts, i, wa / (wa + wb), wb / (wa + wb) FROM (
    SELECT *, pa * exp(-0.5 * pow(ret / 0.5, 2)) / 0.5 AS wa, pb * exp(-0.5 * pow(ret / 1.5, 2)) / 1.5 AS wb FROM (
      SELECT n.symbol, n.ts, n.i, n.ret, CASE WHEN n.i = 1 THEN 0.5 ELSE e.a * 0.95 + e.b * 0.1 END AS pa, CASE WHEN n.i = 1 THEN 0.5 ELSE e.a * 0.05 + e.b * 0.9 END AS pb {NEXT})))
SELECT symbol, ts, {r("a", "calm")}, {r("b", "wild")}, CAST(CASE WHEN a >= b THEN 0 ELSE 1 END AS INTEGER) AS state FROM e WHERE i > 0""")
def machine_hidden_states(spark, sf_dir):
    found = M.run(returns(spark, sf_dir), lambda: M.ForwardFilter([0.5, 0.5], [[0.95, 0.05], [0.1, 0.9]], [0.0, 0.0], [0.5, 1.5]))
    return found.select("symbol", "ts", *[tidy(F.get("probs", F.lit(i))).alias(name) for i, name in enumerate(("calm", "wild"))], "state")


@query("""WITH t AS (SELECT event_type AS symbol, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec, value, event_id FROM events),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, sec ORDER BY ts, value) AS k FROM t) WHERE k = 1),
g AS (SELECT *, sec // 14400 * 14400 AS period, CASE WHEN sec - lag(sec) OVER w > 7200 THEN 1 ELSE 0 END AS cut FROM one WINDOW w AS (PARTITION BY symbol ORDER BY sec)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY symbol ORDER BY sec ROWS UNBOUNDED PRECEDING) AS session FROM g),
b AS (SELECT symbol, session, period, arg_min(value, sec) AS o, max(value) AS h, min(value) AS l, arg_max(value, sec) AS c, CAST(count(*) AS DOUBLE) AS v, CAST(count(*) AS INTEGER) AS n, min(sec) AS first FROM s GROUP BY 1, 2, 3),
o AS (SELECT *, lead(first) OVER (PARTITION BY symbol, session ORDER BY period) AS opened FROM b)
SELECT o.symbol, one.ts, period AS bar_start, o AS bar_open, h AS bar_high, l AS bar_low, c AS bar_close, v AS bar_volume, n AS samples, n < 4 AS partial FROM o JOIN one ON one.symbol = o.symbol AND one.sec = o.opened""")
def machine_gap_bars(spark, sf_dir):
    """Four-hour bars from ticks; repeated seconds are passed over and a gap of more than two hours begins anew."""
    v = C("value")
    ticks = events(spark, sf_dir).select(C("event_type").alias("symbol"), "ts", F.floor(F.unix_micros(F.to_timestamp("ts")) / 1_000_000).cast("double").alias("epoch"), v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"), F.lit(1.0).alias("volume"))
    return M.run(ticks, lambda: M.GapBars(14400, 3600, 7200))


@query()
def machine_adaptive_change(spark, sf_dir):
    """Directional change whose threshold follows the volatility of the last 48 bars; held to a plain loop by a test."""
    return M.run(hourly(spark, sf_dir), lambda: M.AdaptiveChange(0.5, 48, 24, 0.5, 0.1, 2.0))
