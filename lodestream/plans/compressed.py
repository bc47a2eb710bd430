"""Indicators that are squeezed into -50 to 50 by the normal or the F distribution."""

from __future__ import annotations

import math

from lodestream.functions import price
from lodestream.plans.features import F, K, div, fir_sql, ln, over, pf
from lodestream.plans.lazy import Lazy as Column
from lodestream.plans.suite import Suite, s_agg, s_div, s_full, s_lag, s_ln, s_slope, w

C = F.col


def f_two(x: Column, d2: float) -> Column:
    """F distribution with 2 and d2 degrees of freedom, in closed form."""
    return 1 - F.pow(1 + 2 * x / d2, F.lit(-d2 / 2))


def f_four(x: Column, d2: float) -> Column:
    """F distribution with 4 and d2 degrees of freedom, in closed form."""
    z, b = 4 * x / (4 * x + d2), d2 / 2
    return 1 - F.pow(1 - z, F.lit(b)) * (1 + b * z)


def known(value: Column) -> Column:
    """Only where there is a bar before."""
    return F.when(K.lag("close").isNotNull(), value)


def known_sql(value: str) -> str:
    return f"(CASE WHEN {s_lag('close')} IS NOT NULL THEN {value} END)"


LOG_RANGE = F.greatest(ln(over("high", "low")), F.abs(ln(over("high", K.lag("close")))), F.abs(ln(over(K.lag("close"), "low"))))
LOG_RANGE_SQL = f"greatest({s_ln('high / low')}, abs({s_ln('high / ' + s_lag('close'))}), abs({s_ln(s_lag('close') + ' / low')}))"
RANGE_SQL = f"greatest(high - low, abs(high - {s_lag('close')}), abs({s_lag('close')} - low))"
DAYS = 20
WEIGHTS = [price.legendre(DAYS, d) for d in (1, 2, 3)]
BEFORE_20 = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


def trend(coef: str) -> tuple[Column, str]:
    """A Legendre coefficient over the log range, weighted by its share of the variance."""
    share = F.greatest(F.lit(0.0), div(C(coef) * C(coef), C("_yss") + 1e-60))
    return share * C(coef) * 2 / (C("_atr60") * (DAYS - 1) + 1e-60), f"greatest(0.0, {coef} * {coef} / (_yss + 1e-60)) * {coef} * 2 / (_atr60 * {DAYS - 1} + 1e-60)"


def total(x: str, n: int) -> Column:
    return F.sum(x).over(K.trailing(n))


#: Raw values with the factor of their compression.
RAW: dict[str, tuple[Column, str, float]] = {
    "linear_trend": (*trend("_c1"), 1.0),
    "quadratic_trend": (*trend("_c2"), 1.0),
    "cubic_trend": (*trend("_c3"), 1.0),
    "close_minus_ma": (
        F.when(F.count("_lc").over(K.before(20)) >= 20, (C("_lc") - F.avg("_lc").over(K.before(20))) / (C("_atr60") * math.sqrt(21) + 1e-60)),
        f"CASE WHEN count(_lc) {BEFORE_20} >= 20 THEN (_lc - avg(_lc) {BEFORE_20}) / (_atr60 * {math.sqrt(21)!r} + 1e-60) END",
        1.0,
    ),
    "ma_difference": (
        (K.avg("close", 10) - K.avg("close", 40)) / (math.sqrt(15) * C("_range40") + 1e-60),
        f"({s_agg('avg', 'close', 10)} - {s_agg('avg', 'close', 40)}) / ({math.sqrt(15)!r} * _range40 + 1e-60)",
        1.5,
    ),
    "price_change_osc": (
        (K.avg("_abs_r", 10) - K.avg("_abs_r", 40)) / ((0.36 + 0.1 + 0.7 * math.log(2) / 1.609) * C("_atr40") + 1e-60),
        f"({s_agg('avg', '_abs_r', 10)} - {s_agg('avg', '_abs_r', 40)}) / ({0.36 + 0.1 + 0.7 * math.log(2) / 1.609!r} * _atr40 + 1e-60)",
        4.0,
    ),
    "price_intensity": ((C("close") - C("open")) / (C("_range") + 1e-60), "(close - open) / (_range + 1e-60)", 0.8),
    "price_volume_fit": (F.when(F.count("_lc").over(K.trailing(20)) >= 20, F.coalesce(K.slope("_lc", "_lv", 20), F.lit(0.0))), s_full(f"coalesce({s_slope('_lc', '_lv', 20)}, 0.0)", "_lc", 20), 9.0),
    "vwma_ratio": (
        K.full(1000 * F.log(20 * total("_cv", 20) / (total("volume", 20) * total("close", 20))) / math.sqrt(20), "close", 20),
        s_full(f"1000 * ln(20 * sum(_cv) {w(20)} / (sum(volume) {w(20)} * sum(close) {w(20)})) / {math.sqrt(20)!r}", "close", 20),
        1.0,
    ),
    "normalized_obv": (
        K.full(div(F.sum(F.signum(C("_step")) * F.when(C("_step").isNotNull(), C("volume"))).over(K.trailing(20)), F.sum(F.when(C("_step").isNotNull(), C("volume"))).over(K.trailing(20))) * math.sqrt(20), "_step", 20),
        s_full(f"sum(sign(_step) * volume) {w(20)} / sum(CASE WHEN _step IS NOT NULL THEN volume END) {w(20)} * {math.sqrt(20)!r}", "_step", 20),
        0.6,
    ),
    "volume_momentum": (ln(div(K.avg("volume", 10), K.avg("volume", 40))), s_ln(s_div(s_agg("avg", "volume", 10), s_agg("avg", "volume", 40))), 3.0 / math.pow(4.0, 1 / 3)),
}


def phi_sql(x: str, m: float) -> str:
    z = f"greatest(-4.0, least(4.0, {x} * {m / math.sqrt(2)!r}))"
    return f"(50 * CASE WHEN abs({x} * {m / math.sqrt(2)!r}) >= 4 THEN sign({x}) ELSE 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda n: pow(-1, n) * pow({z}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))) END)"


def ratio_sql(x: str) -> str:
    return f"({s_agg('var_pop', x, 10)} / ({s_agg('var_pop', x, 40)} + 1e-60))"


def ratio(x: str) -> Column:
    short, long = (K.full(F.var_pop(x).over(K.trailing(n)), x, n) for n in (10, 40))
    return short / (long + 1e-60)


compressed = Suite(
    [
        {
            "_lc": (ln("close"), s_ln("close")),
            "_lv": (F.log(C("volume") + 1), "ln(volume + 1)"),
            "_r": (pf.log_return(K), s_ln(s_div("close", s_lag("close")))),
            "_cv": (C("close") * C("volume"), "close * volume"),
            "_step": (C("close") - K.lag("close"), f"close - {s_lag('close')}"),
            "_range": (known(pf.true_range(K)), known_sql(RANGE_SQL)),
            "_log_range": (known(LOG_RANGE), known_sql(LOG_RANGE_SQL)),
        },
        {
            "_abs_r": (F.abs(C("_r")), "abs(_r)"),
            "_atr60": (K.avg("_log_range", 60), s_agg("avg", "_log_range", 60)),
            "_atr40": (K.avg("_log_range", 40), s_agg("avg", "_log_range", 40)),
            "_range40": (K.avg("_range", 40), s_agg("avg", "_range", 40)),
            "_yss": (F.var_pop("_lc").over(K.trailing(DAYS)) * DAYS, f"var_pop(_lc) {w(DAYS)} * {DAYS}"),
            "_c1": (pf.fir(K, "_lc", WEIGHTS[0]), fir_sql("_lc", WEIGHTS[0])),
            "_c2": (pf.fir(K, "_lc", WEIGHTS[1]), fir_sql("_lc", WEIGHTS[1])),
            "_c3": (pf.fir(K, "_lc", WEIGHTS[2]), fir_sql("_lc", WEIGHTS[2])),
            "_price_ratio": (ratio("_lc"), ratio_sql("_lc")),
            "_change_ratio": (ratio("_r"), ratio_sql("_r")),
        },
        {f"_raw_{name}": (column, sql) for name, (column, sql, _) in RAW.items()},
        {name: (pf.normal_compress(C(f"_raw_{name}"), m), phi_sql(f"_raw_{name}", m)) for name, (_, _, m) in RAW.items()}
        | {
            "price_variance_ratio": (100 * f_two(4 * C("_price_ratio"), 8.0) - 50, "100 * (1 - pow(1 + 2 * 4 * _price_ratio / 8.0, -4.0)) - 50"),
            "change_variance_ratio": (
                100 * f_four(C("_change_ratio"), 16.0) - 50,
                "100 * (1 - pow(1 - 4 * _change_ratio / (4 * _change_ratio + 16.0), 8.0) * (1 + 8.0 * 4 * _change_ratio / (4 * _change_ratio + 16.0))) - 50",
            ),
        },
    ],
    digits=4,
)
