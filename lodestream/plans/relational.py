"""Queries of joins, aggregations, set operations, labels and evaluations, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import posterior
from lodestream.functions.frames import Keyed, div, ln
from lodestream.operators import bars as B
from lodestream.operators import evaluation as V
from lodestream.operators import temporal_joins as J
from lodestream.plans.suite import BARS_SQL, P, SO_FAR, events, gains, hourly, tidy, tidy_sql, w

K = Keyed()
C = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"{tidy_sql(x, digits)} AS {name or x}"


def tidied(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[tidy(c, digits).alias(c) if c in columns else c for c in df.columns])


#: Returns and a state per bar: up, down or flat by one per cent.
STATES_SQL = f"""{BARS_SQL},
rets AS (SELECT *, close / lag(close) {P} - 1 AS ret FROM bars),
states AS (SELECT *, CASE WHEN ret > 0.01 THEN 1 WHEN ret < -0.01 THEN -1 WHEN ret IS NOT NULL THEN 0 END AS state FROM rets)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly(spark, sf_dir).withColumn("ret", div("close", K.lag("close")) - 1)
    return bars.withColumn("state", F.when(C("ret") > 0.01, 1).when(C("ret") < -0.01, -1).when(C("ret").isNotNull(), 0))


# bars


@query(f"WITH {BARS_SQL} SELECT symbol, ts, open, high, low, close, volume FROM bars")
def bars_hourly(spark, sf_dir):
    return hourly(spark, sf_dir)


RESAMPLED = """q AS (
  SELECT symbol, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume
  FROM bars GROUP BY 1, 2)"""


@query(f"WITH {BARS_SQL}, {RESAMPLED} SELECT * FROM q")
def bars_resampled_4h(spark, sf_dir):
    return B.resample(hourly(spark, sf_dir), 4 * 3600)


@query(f"""WITH {BARS_SQL}, ends AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1),
spine AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL '1 hour')) AS ts FROM ends)
SELECT symbol, ts, open, high, low, close, coalesce(volume, 0.0) AS volume FROM spine LEFT JOIN bars USING (symbol, ts)""")
def bars_without_gaps(spark, sf_dir):
    return B.fill_gaps(hourly(spark, sf_dir), 3600)


@query("""WITH raw AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, event_id, value AS open, value + 1 AS high, value - 1 AS low, CASE WHEN minute(ts) BETWEEN 10 AND 19 THEN NULL ELSE value END AS close, CAST(greatest(minute(ts) - 5, 0) AS DOUBLE) AS volume, nullif(value, 1) AS note FROM events),
one AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id) AS n FROM raw)
SELECT symbol, ts, event_id, open, high, low, close, volume, note FROM one
WHERE n = 1 AND volume > 0 AND isodow(ts) <= 5 AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL""")
def bars_clean(spark, sf_dir):
    """A feed with repeated times, nulls and bars without volume: every event, as if it were a bar of its hour."""
    v, minute = C("value"), F.minute("ts")
    raw = events(spark, sf_dir).select(
        C("event_type").alias("symbol"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        "event_id",
        v.alias("open"),
        (v + 1).alias("high"),
        (v - 1).alias("low"),
        F.when(~minute.between(10, 19), v).alias("close"),
        F.greatest(minute - 5, F.lit(0)).cast("double").alias("volume"),
        F.nullif(v, F.lit(1.0)).alias("note"),
    )
    return B.clean(raw, order="event_id")


MERGED = """s AS (SELECT * FROM bars WHERE hour(ts) <> 3), f AS (SELECT * FROM bars WHERE hour(ts) >= 2),
m AS (SELECT symbol, ts FROM s UNION SELECT symbol, ts FROM f)"""


@query(f"""WITH {BARS_SQL}, {MERGED}, c AS (SELECT symbol, sum(s) AS stored, sum(f) AS fetched, sum(m) AS merged FROM (
  SELECT symbol, 1 AS s, 0 AS f, 0 AS m FROM s UNION ALL SELECT symbol, 0, 1, 0 FROM f UNION ALL SELECT symbol, 0, 0, 1 FROM m) GROUP BY symbol)
SELECT symbol, CAST(stored AS BIGINT) AS stored, CAST(fetched AS BIGINT) AS fetched, CAST(merged AS BIGINT) AS merged, CAST(0 AS BIGINT) AS repeated,
  CASE WHEN merged < stored THEN 'stored rows lost' WHEN merged < fetched THEN 'fetched rows lost' END AS fault FROM c""")
def bars_merge_report(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    stored, fetched = bars.where(F.hour("ts") != 3), bars.where(F.hour("ts") >= 2)
    return B.merge_report(stored, fetched, B.upsert(stored, fetched))


@query(f"""WITH {BARS_SQL}, e AS (SELECT symbol, count(*) AS rows, CAST(floor(30 * 24 * 60 * CASE WHEN symbol = 'view' THEN 1.0 ELSE 5.0 / 7 * 20 / 24 END / 60) AS BIGINT) AS expected FROM bars GROUP BY symbol)
SELECT symbol, rows, expected, {r("rows / expected", "ratio")}, rows / expected >= 0.1 AS plausible FROM e""")
def bars_plausibility(spark, sf_dir):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return tidied(B.plausibility(hourly(spark, sf_dir), 60, at("2024-01-01"), at("2024-01-31"), C("symbol") == "view"), "ratio")


@query(f"""WITH {BARS_SQL}, n AS (SELECT symbol, ts, open, high, low, close + 1 AS close, volume FROM bars WHERE hour(ts) = 12)
SELECT * FROM n UNION ALL SELECT * FROM bars WHERE (symbol, ts) NOT IN (SELECT symbol, ts FROM n)""")
def bars_upsert(spark, sf_dir):
    stored = hourly(spark, sf_dir)
    return B.upsert(stored, stored.where(F.hour("ts") == 12).withColumn("close", C("close") + 1)).select(stored.columns)


@query(f"""WITH {BARS_SQL}, a AS (SELECT * FROM bars WHERE hour(ts) <> 3), b AS (SELECT symbol, ts, open, high, low, CASE WHEN hour(ts) = 7 THEN close + 1 ELSE close END AS close FROM bars WHERE hour(ts) <> 5)
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ts, b.ts) AS ts, CASE WHEN b.symbol IS NULL THEN 'left_only' WHEN a.symbol IS NULL THEN 'right_only' ELSE 'both' END AS status,
  {', '.join(f"CASE WHEN abs(a.{c} - b.{c}) > 1e-9 THEN 1 ELSE 0 END AS {c}_differs" for c in B.PRICES)}
FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts""")
def bars_feed_diff(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    other = bars.where(F.hour("ts") != 5).withColumn("close", F.when(F.hour("ts") == 7, C("close") + 1).otherwise(C("close")))
    return B.compare_feeds(bars.where(F.hour("ts") != 3), other)


@query(f"WITH {BARS_SQL} SELECT symbol, ts, {', '.join(f'lag({c}, {n}) {P} AS {c}_lag_{n}' for c in ('close', 'volume') for n in (1, 2, 5))} FROM bars")
def bars_lag_features(spark, sf_dir):
    return B.lag_features(hourly(spark, sf_dir), ["close", "volume"], [1, 2, 5]).drop("open", "high", "low", "close", "volume")


@query(f"""WITH {BARS_SQL} SELECT symbol, ts, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(day(ts) AS INTEGER) AS day, CAST(month(ts) AS INTEGER) AS month, CAST(quarter(ts) AS INTEGER) AS quarter,
  {r("sin(2 * pi() * hour(ts) / 24)", "hour_sin")}, {r("cos(2 * pi() * hour(ts) / 24)", "hour_cos")}, {r("sin(2 * pi() * (isodow(ts) - 1) / 7)", "weekday_sin")}, {r("cos(2 * pi() * (isodow(ts) - 1) / 7)", "weekday_cos")} FROM bars""")
def bars_temporal_features(spark, sf_dir):
    found = B.temporal_features(hourly(spark, sf_dir)).drop("open", "high", "low", "close", "volume")
    return tidied(found, "hour_sin", "hour_cos", "weekday_sin", "weekday_cos")


@query(f"WITH {BARS_SQL} SELECT symbol, ts, close FROM (SELECT *, lead(ts, 5) {P} AS a FROM bars) WHERE a IS NOT NULL")
def bars_drop_horizon(spark, sf_dir):
    return B.drop_last(hourly(spark, sf_dir), 5).select("symbol", "ts", "close")


# joins along time


def _sides(spark, sf_dir):
    every = events(spark, sf_dir).select("event_type", "ts", "event_id", "value")
    left = every.where(C("event_id") % 2 == 0).select("event_type", "ts", "event_id")
    return left, every.where(C("event_id") % 2 == 1).select("event_type", C("ts").alias("at"), C("value").alias("last_value"))


SIDES = "l AS (SELECT event_type, ts, event_id FROM events WHERE event_id % 2 = 0), r AS (SELECT event_type, ts AS at, value FROM events WHERE event_id % 2 = 1)"


@query(f"""WITH {SIDES} SELECT l.event_type, l.ts, l.event_id, CASE WHEN l.ts - r.at <= INTERVAL '1 hour' THEN r.value END AS last_value, CASE WHEN l.ts - r.at <= INTERVAL '1 hour' THEN r.at END AS matched_time
FROM l ASOF LEFT JOIN r ON l.event_type = r.event_type AND l.ts >= r.at""")
def join_as_of(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return J.as_of(left, right, ["event_type"], "ts", "at", ["last_value"], max_age="1 HOUR")


@query(f"""WITH {SIDES} SELECT l.event_type, l.ts, l.event_id, r.value AS last_value, r.at AS matched_time
FROM l ASOF LEFT JOIN r ON l.event_type = r.event_type AND l.ts <= r.at""")
def join_as_of_forward(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return J.as_of(left, right, ["event_type"], "ts", "at", ["last_value"], forward=True)


def _bar_events(bars: DataFrame) -> DataFrame:
    """An event at every bar."""
    return bars.select("symbol", C("ts").alias("t0"), C("close").alias("price"), (div(C("high") - C("low"), "close") + 0.05).alias("vol"))


LABEL_EVENTS = """ev AS (SELECT symbol, ts AS t0, close AS price, (high - low) / close + 0.05 AS vol FROM bars),
ends AS (SELECT symbol, max(ts) AS last FROM bars GROUP BY 1),
w AS (SELECT ev.*, b.ts AS due FROM ev ASOF LEFT JOIN bars b ON b.symbol = ev.symbol AND ev.t0 + INTERVAL '12 hours' <= b.ts),
v AS (SELECT w.* EXCLUDE (due), coalesce(due, ends.last) AS t1 FROM w JOIN ends ON ends.symbol = w.symbol)"""
LABELS = f"""{LABEL_EVENTS},
s AS (SELECT *, price * (1 + 1.5 * vol) AS upper, price * (1 - 0.8 * vol) AS lower FROM v WHERE 0.8 * vol < 1 AND vol > 0),
x AS (SELECT s.*, b.ts, b.close, CASE WHEN b.low <= lower THEN -1 WHEN b.high >= upper THEN 1 END AS touch FROM s JOIN bars b ON b.symbol = s.symbol AND b.ts > t0 AND b.ts <= t1),
f AS (SELECT symbol, t0, any_value(price) AS price, any_value(upper) AS upper, any_value(lower) AS lower, min(ts) FILTER (WHERE touch IS NOT NULL) AS hit, arg_min(touch, ts) FILTER (WHERE touch IS NOT NULL) AS label, max(ts) AS last, arg_max(close, ts) AS close FROM x GROUP BY 1, 2),
lab AS (SELECT symbol, t0, coalesce(hit, last) AS exit_ts, ln(CASE WHEN label = 1 THEN upper WHEN label = -1 THEN lower ELSE close END / price) AS ret, CAST(coalesce(label, 0) AS INTEGER) AS label,
  CASE label WHEN 1 THEN 'upper' WHEN -1 THEN 'lower' ELSE 'vertical' END AS barrier FROM f)"""


def _barriers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    bars = hourly(spark, sf_dir)
    return J.vertical_barriers(_bar_events(bars), bars, "12 HOURS"), bars


def _labels(spark, sf_dir) -> DataFrame:
    return J.triple_barrier(*_barriers(spark, sf_dir), 1.5, 0.8)


@query(f"WITH {BARS_SQL}, {LABEL_EVENTS} SELECT symbol, t0, t1 FROM v")
def label_vertical_barriers(spark, sf_dir):
    return _barriers(spark, sf_dir)[0].select("symbol", "t0", "t1")


@query(f"WITH {BARS_SQL}, {LABELS} SELECT symbol, t0, exit_ts, {r('ret')}, label, barrier FROM lab")
def label_triple_barrier(spark, sf_dir):
    return tidied(_labels(spark, sf_dir), "ret")


@query(f"WITH {BARS_SQL}, {LABELS} SELECT symbol, t0, exit_ts, {r('ret')}, CASE WHEN round(abs(ret), 9) < 0.1 THEN 0 ELSE label END AS label, barrier FROM lab")
def label_min_return(spark, sf_dir):
    """Labels of moves under a tenth become 0; their barrier stays."""
    found = J.min_return(_labels(spark, sf_dir).withColumn("_r", F.round("ret", 9)), 0.1, "_r")
    return tidied(found.drop("_r"), "ret")


@query(f"""WITH {BARS_SQL}, {LABEL_EVENTS} SELECT symbol, t0, t1 FROM v WHERE t1 < TIMESTAMP '2024-01-15' OR t0 > TIMESTAMP '2024-01-18'""")
def label_purged_train(spark, sf_dir):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return J.purge(_barriers(spark, sf_dir)[0], at("2024-01-15"), at("2024-01-18")).select("symbol", "t0", "t1")


@query(f"""WITH {STATES_SQL}, f AS (SELECT symbol, ts, CASE WHEN close > 0 THEN ln(lead(close, 5) {P} / close) END AS fwd, stddev_samp(ret) {w(20)} AS sd, count(ret) {w(20)} AS n FROM states),
z AS (SELECT symbol, ts, CASE WHEN n >= 20 AND sd > 1e-12 THEN fwd / sd END AS z FROM f), lim AS (SELECT quantile_cont(abs(z), 0.9) AS m FROM z)
SELECT symbol, ts, {r("greatest(least(z, m), -m)", "label")} FROM z, lim WHERE z IS NOT NULL""")
def label_forward_return(spark, sf_dir):
    bars = states(spark, sf_dir).withColumn("z", div(ln(div(K.lead("close", 5), "close")), F.when(K.sd("ret", 20) > 1e-12, K.sd("ret", 20)))).where("z is not null")
    limit = V.exact_quantiles(bars.select(F.abs("z").alias("size")), "size", [0.9]).select(F.get("quantiles", F.lit(0)).alias("m"))  # one row
    return bars.crossJoin(F.broadcast(limit)).select("symbol", "ts", tidy(F.greatest(F.least("z", "m"), -C("m"))).alias("label"))


# cross-section and markets


@query(f"""WITH {STATES_SQL}, m AS (SELECT symbol, ts, close / lag(close, 20) {P} - 1 AS mom FROM states),
x AS (SELECT *, avg(mom) OVER (PARTITION BY ts) AS mean, stddev_samp(mom) OVER (PARTITION BY ts) AS sd, count(mom) OVER (PARTITION BY ts) AS n FROM m WHERE mom IS NOT NULL)
SELECT symbol, ts, {r("CASE WHEN n > 1 AND sd > 1e-12 THEN (mom - mean) / sd END", "z")}, {r("100.0 * (rank() OVER (PARTITION BY ts ORDER BY mom) - 1) / nullif(n - 1, 0)", "pct_rank")} FROM x""")
def cross_section_momentum(spark, sf_dir):
    rows = hourly(spark, sf_dir).withColumn("mom", div("close", K.lag("close", 20)) - 1).where("mom is not null")
    at = Window.partitionBy("ts")
    n, sd = F.count("mom").over(at), F.stddev_samp("mom").over(at)
    z = F.when((n > 1) & (sd > 1e-12), div(C("mom") - F.avg("mom").over(at), sd))
    rank = div(100.0 * (F.rank().over(at.orderBy("mom")) - 1), n - 1)
    return rows.select("symbol", "ts", tidy(z).alias("z"), tidy(rank).alias("pct_rank"))


@query(f"""WITH {BARS_SQL}, m AS (SELECT symbol, ts, close / lag(close, 20) {P} - 1 AS mom FROM bars),
g AS (SELECT ts, count(*) AS markets, quantile_cont(mom, 0.5) AS median, max(mom) - min(mom) AS spread, quantile_cont(mom, 0.75) - quantile_cont(mom, 0.25) AS iqr, list_sort(list(mom)) AS x, greatest(CAST(floor(0.4 * (count(*) + 1)) AS BIGINT) - 1, 0) AS k FROM m WHERE mom IS NOT NULL GROUP BY ts)
SELECT ts, markets, {r("median")}, {r("spread")}, {r("iqr")}, {r("CASE WHEN x[k + 1] > 0 THEN x[k + 1] WHEN x[markets - k] < 0 THEN x[markets - k] ELSE 0.0 END", "clump")} FROM g""")
def cross_section_summary(spark, sf_dir):
    """Median, range, quartile distance and clump of the markets' momentum: the 40th fractile if above 0, the 60th if below, else 0."""
    rows = hourly(spark, sf_dir).withColumn("mom", div("close", K.lag("close", 20)) - 1).where("mom is not null")
    q = lambda p: F.percentile("mom", p)
    found = rows.groupBy("ts").agg(F.count(F.lit(1)).alias("markets"), q(0.5).alias("median"), (F.max("mom") - F.min("mom")).alias("spread"), (q(0.75) - q(0.25)).alias("iqr"), F.sort_array(F.collect_list("mom")).alias("x"))
    k = F.greatest(F.floor(0.4 * (C("markets") + 1)) - 1, F.lit(0)).cast("int")
    low, high = F.get("x", k), F.get("x", C("markets").cast("int") - k - 1)
    clump = F.when(low > 0, low).when(high < 0, high).otherwise(0.0)
    return tidied(found.withColumn("clump", clump).drop("x"), "median", "spread", "iqr", "clump")


@query(f"""WITH {STATES_SQL}, p AS (SELECT a.symbol, a.ts, a.ret - b.ret AS excess FROM states a JOIN states b ON a.ts = b.ts WHERE a.symbol <> b.symbol AND b.symbol = (SELECT min(symbol) FROM bars) AND a.ret IS NOT NULL AND b.ret IS NOT NULL)
SELECT symbol, ts, {r("CASE WHEN count(excess) " + w(10) + " >= 10 THEN avg(excess) " + w(10) + " END", "excess")} FROM p""")
def peer_excess_return(spark, sf_dir):
    every = states(spark, sf_dir).where("ret is not null").select("symbol", "ts", "ret")
    market = every.agg(F.min("symbol").alias("m"))
    peer = every.join(F.broadcast(market), C("symbol") == C("m")).select("ts", C("ret").alias("peer"), C("symbol").alias("peer_symbol"))
    both = every.join(peer, "ts").where("symbol <> peer_symbol").withColumn("excess", C("ret") - C("peer"))
    return both.select("symbol", "ts", tidy(K.avg("excess", 10)).alias("excess"))


#: The markets of the test tables.
PIVOT = ", ".join(f"max(close) FILTER (WHERE symbol = '{m}') AS close_{m}" for m in ("click", "error", "purchase", "signup", "view"))


@query(f"WITH {BARS_SQL} SELECT ts, {PIVOT} FROM bars GROUP BY ts")
def panel_pivot(spark, sf_dir):
    """A column for each market that there is; the SQL names those of the test tables."""
    wide = hourly(spark, sf_dir).groupBy("ts").pivot("symbol").agg(F.max("close"))
    return wide.select("ts", *[C(f"`{c}`").alias(f"close_{c}") for c in wide.columns if c != "ts"])


# labels and evaluation

RUNS = f"runs AS (SELECT *, sum(c) {SO_FAR} AS run FROM (SELECT *, CASE WHEN state <> lag(state) {P} THEN 1 ELSE 0 END AS c FROM states WHERE state IS NOT NULL))"


@query(f"""WITH {STATES_SQL}, {RUNS} SELECT symbol, CAST(run AS BIGINT) AS run, state, count(*) AS length, min(ts) AS "start", max(ts) AS "end" FROM runs GROUP BY symbol, run, state""")
def state_runs(spark, sf_dir):
    return V.run_lengths(states(spark, sf_dir).where("state is not null"), "state")


@query(f"""WITH {STATES_SQL}, m AS (SELECT state, lead(state) {P} AS next_state FROM states WHERE state IS NOT NULL), n AS (SELECT state, next_state, count(*) AS n FROM m WHERE next_state IS NOT NULL GROUP BY 1, 2)
SELECT state, next_state, n, {r("n / sum(n) OVER (PARTITION BY state)", "share")} FROM n""")
def state_transitions(spark, sf_dir):
    return tidied(V.transition_matrix(states(spark, sf_dir).where("state is not null"), "state"), "share")


STAT = ["total", "mean", "sd", "least", "most", "q1", "median", "q3"]


@query(f"""WITH {STATES_SQL} SELECT state, count(ret) AS n, {r("sum(ret)", "total")}, {r("avg(ret)", "mean")}, {r("stddev_samp(ret)", "sd")}, {r("min(ret)", "least")}, {r("max(ret)", "most")},
{r("quantile_cont(ret, 0.25)", "q1")}, {r("quantile_cont(ret, 0.5)", "median")}, {r("quantile_cont(ret, 0.75)", "q3")} FROM states WHERE state IS NOT NULL GROUP BY state""")
def state_statistics(spark, sf_dir):
    return tidied(V.state_statistics(states(spark, sf_dir).where("state is not null"), "state", "ret"), *STAT)


@query(f"""WITH {STATES_SQL}, x AS (SELECT symbol, volume AS x, lead(ret) {P} AS y FROM states),
k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2.0 AS ry FROM x WHERE y IS NOT NULL)
SELECT symbol, count(*) AS n, {r("corr(rx, ry)", "ic")} FROM k GROUP BY symbol""")
def spearman_ic(spark, sf_dir):
    rows = states(spark, sf_dir).select("symbol", C("volume").alias("x"), K.lead("ret").alias("y"))
    return tidied(V.spearman(rows, "x", "y", ["symbol"]), "ic")


@query(f"""WITH {STATES_SQL}, e AS (SELECT quantile_cont(ret, [0.2, 0.4, 0.6, 0.8]) AS e FROM states)
SELECT CAST(len(list_filter(e, lambda q: q < ret)) AS INTEGER) AS bin, count(*) AS n, {r("avg(ret)", "mean")} FROM states, e WHERE ret IS NOT NULL GROUP BY 1""")
def quantile_bins(spark, sf_dir):
    rows = V.quantile_bins(states(spark, sf_dir).where("ret is not null"), "ret", 5)
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("ret")).alias("mean"))


BACKTEST = f"""{STATES_SQL}, a AS (SELECT *, coalesce(lag(coalesce(CAST(state AS DOUBLE), 0.0)) {P}, 0.0) AS position FROM states),
b AS (SELECT *, abs(position - coalesce(lag(position) {P}, 0.0)) * 2.0 / 10000 AS cost FROM a), c AS (SELECT *, position * coalesce(ret, 0.0) - cost AS net FROM b),
d AS (SELECT *, sum(ln(1 + greatest(net, -0.999999))) {SO_FAR} AS log_equity FROM c),
e AS (SELECT *, exp(log_equity - greatest(max(log_equity) {SO_FAR}, 0.0)) - 1 AS drawdown FROM d)"""


def _tested(spark, sf_dir):
    return V.signal_backtest(states(spark, sf_dir).withColumn("signal", C("state").cast("double")), "signal", "ret", 2.0)


@query(f"WITH {BACKTEST} SELECT symbol, ts, position, {r('cost')}, {r('net')}, {r('log_equity', digits=4)}, {r('drawdown')} FROM e")
def backtest_path(spark, sf_dir):
    found = _tested(spark, sf_dir).select("symbol", "ts", "position", "cost", "net", "log_equity", "drawdown")
    return tidied(tidied(found, "cost", "net", "drawdown"), "log_equity", digits=4)


@query(f"""WITH {BACKTEST} SELECT symbol, count(*) AS bars, {r("sum(net)", "total", 4)}, {r("CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) * sqrt(252) END", "sharpe", 4)}, {r("min(drawdown)", "max_drawdown", 4)}, CAST(sum(CASE WHEN cost > 0 THEN 1 ELSE 0 END) AS BIGINT) AS trades FROM e GROUP BY symbol""")
def backtest_summary(spark, sf_dir):
    return tidied(V.backtest_summary(_tested(spark, sf_dir)), "total", "sharpe", "max_drawdown", digits=4)


@query(f"""WITH {BACKTEST} SELECT symbol, coalesce(CAST(hour(ts) AS INTEGER), -1) AS hour, coalesce(CAST(isodow(ts) - 1 AS INTEGER), -1) AS weekday, {r("sum(net)", "pnl")}, count(*) AS n FROM e GROUP BY GROUPING SETS ((symbol, hour(ts)), (symbol, isodow(ts)))""")
def backtest_by_time(spark, sf_dir):
    rows = _tested(spark, sf_dir).select("symbol", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), "net")
    found = rows.groupingSets([["symbol", "hour"], ["symbol", "weekday"]], "symbol", "hour", "weekday").agg(F.sum("net").alias("pnl"), F.count(F.lit(1)).alias("n"))
    return tidied(found.fillna(-1, ["hour", "weekday"]), "pnl")


@query(f"""WITH {BARS_SQL}, f AS (SELECT symbol, ts, CAST(ntile(5) {P} - 1 AS INTEGER) AS fold FROM bars)
SELECT symbol, fold, count(*) AS n, min(ts) AS first, max(ts) AS last FROM f GROUP BY symbol, fold""")
def walk_forward_folds(spark, sf_dir):
    return V.walk_forward_folds(hourly(spark, sf_dir), 5).groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(f"""WITH {STATES_SQL}, g AS (SELECT unnest([1.0, 2.0, 3.0, 4.0, 6.0])::DOUBLE AS threshold), x AS (SELECT volume, lead(ret) {P} AS y FROM states), j AS (SELECT threshold, volume > threshold AS a, y FROM x, g WHERE y IS NOT NULL),
s AS (SELECT threshold, sum(CASE WHEN a THEN 1 ELSE 0 END) AS n, sum(CASE WHEN a AND y > 0 THEN y ELSE 0 END) AS g1, sum(CASE WHEN a AND y < 0 THEN -y ELSE 0 END) AS l1, sum(CASE WHEN NOT a AND y > 0 THEN y ELSE 0 END) AS g0, sum(CASE WHEN NOT a AND y < 0 THEN -y ELSE 0 END) AS l0 FROM j GROUP BY threshold)
SELECT threshold, CAST(n AS BIGINT) AS n_above, {r("g1 / nullif(l1, 0)", "pf_above")}, {r("g0 / nullif(l0, 0)", "pf_below")} FROM s""")
def profit_factor_sweep(spark, sf_dir):
    rows = states(spark, sf_dir).withColumn("y", K.lead("ret")).select("volume", "y")
    return tidied(V.profit_factor_sweep(rows, "volume", "y", [1, 2, 3, 4, 6]), "pf_above", "pf_below")


@query("""WITH s AS (SELECT user_id, sum(value) AS gain, count(*) AS trials FROM events GROUP BY user_id), t AS (SELECT user_id, CAST(round(gain) AS BIGINT) AS gain, trials FROM s)
SELECT user_id, gain, trials, EXISTS (SELECT 1 FROM t b WHERE b.gain > a.gain AND b.trials < a.trials) AS dominated FROM t a""")
def pareto_front(spark, sf_dir):
    return V.pareto_front(gains(spark, sf_dir), "user_id", "gain", "trials")


# sets


@query(f"WITH {BARS_SQL} SELECT ts FROM bars WHERE symbol = 'view' EXCEPT SELECT ts FROM bars WHERE symbol = 'click'")
def set_missing_times(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return bars.where("symbol = 'view'").select("ts").join(bars.where("symbol = 'click'").select("ts"), "ts", "left_anti").distinct()


@query(f"WITH {BARS_SQL} SELECT symbol, ts, close FROM bars WHERE ts IN (SELECT ts FROM bars WHERE symbol = 'click' AND volume > 3)")
def join_semi(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return bars.join(bars.where("symbol = 'click' and volume > 3").select("ts"), "ts", "left_semi").select("symbol", "ts", "close")


@query(f"""WITH {STATES_SQL}, g AS (SELECT unnest([5, 10, 20]) AS n), s AS (SELECT n, symbol, sum(ret) FILTER (WHERE volume > n / 5) AS total FROM states, g GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(total, 6) DESC NULLS LAST, n) AS rank FROM s) SELECT symbol, n, {r("total")} FROM k WHERE rank = 1""")
def grid_search(spark, sf_dir):
    grid = spark.createDataFrame([(5,), (10,), (20,)], "n int")
    scored = states(spark, sf_dir).crossJoin(F.broadcast(grid)).groupBy("symbol", "n").agg(F.sum(F.when(C("volume") > C("n") / 5, C("ret"))).alias("total"))
    best = B.one_per(scored, ["symbol"], F.round("total", 6).desc_nulls_last(), C("n"))
    return best.select("symbol", "n", tidy("total").alias("total"))


# arrays, JSON, strings


#: Chances from all components of a vector; even ones where none is positive.
CHANCES_SQL = """c0 AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN greatest(CAST(x AS DOUBLE), 0.0) ELSE 0.0 END) AS v FROM embeddings WHERE len(embedding) > 0),
c1 AS (SELECT vec_id, v, list_sum(v) AS t FROM c0),
pr AS (SELECT vec_id, vec_id // 100 AS block, list_transform(v, lambda x: CASE WHEN t > 0 THEN x / t ELSE 1.0 / len(v) END) AS p FROM c1)"""
_FLOOR = "greatest({}, 1e-12) * ln(greatest({}, 1e-12) / greatest({}, 1e-12))"
KL, MID = _FLOOR.format("z[1]", "z[1]", "z[2]"), "(z[1] + z[2]) / 2"
JS = f"({_FLOOR.format('z[1]', 'z[1]', MID)} + {_FLOOR.format('z[2]', 'z[2]', MID)}) / 2"


@query(f"""WITH {CHANCES_SQL}, k AS (SELECT *, lag(p) OVER (PARTITION BY block ORDER BY vec_id) AS q FROM pr)
SELECT vec_id, {r("list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0.0 END))", "entropy")}, {r("list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2]", "margin")}, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS state,
  {r("list_sum(list_transform(p, lambda x, i: x * (i - 1)))", "expected")}, {r("p[1] + p[2] + p[3]", "mass_below_3")},
  {r(f"CASE WHEN q IS NOT NULL THEN list_sum(list_transform(list_zip(p, q), lambda z: {KL})) END", "step_kl", 5)},
  {r(f"CASE WHEN q IS NOT NULL THEN list_sum(list_transform(list_zip(p, q), lambda z: {JS})) END", "step_js", 5)},
  CAST(CASE WHEN list_max(p) >= 0.1 THEN list_position(p, list_max(p)) - 1 ELSE -1 END AS INTEGER) AS gated FROM k""")
def posterior_features(spark, sf_dir):
    return _posterior_features(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", posterior.normalise_or_even("embedding").alias("p")).where("p is not null"))


def _posterior_features(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("q", F.lag("p").over(Window.partitionBy(F.floor(C("vec_id") / 100)).orderBy("vec_id")))
    p = C("p")
    return rows.select(
        "vec_id",
        tidy(posterior.entropy(p)).alias("entropy"),
        tidy(posterior.margin(p)).alias("margin"),
        posterior.argmax(p).alias("state"),
        tidy(posterior.expected(p)).alias("expected"),
        tidy(posterior.mass_below(p, 3)).alias("mass_below_3"),
        tidy(F.when(C("q").isNotNull(), posterior.kl(p, C("q"))), 5).alias("step_kl"),
        tidy(F.when(C("q").isNotNull(), posterior.js(p, C("q"))), 5).alias("step_js"),
        posterior.gated_label(p, 0.1).alias("gated"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256(event_type || ':' || CAST(user_id AS VARCHAR)) AS window_hash, upper(substr(event_type, 1, 3)) AS code FROM events")
def scalar_json_hash(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.sha2(F.concat_ws(":", "event_type", C("user_id").cast("string")), 256).alias("window_hash"),
        F.upper(F.substring("event_type", 1, 3)).alias("code"),
    )
