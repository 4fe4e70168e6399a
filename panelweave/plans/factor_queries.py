"""Factor queries over daily bars, with the SQL that checks them."""

from __future__ import annotations

from panelweave.functions.columns import KEY, TIME
from panelweave.operators import factors
from panelweave.plans.common import bars, over, rounded, with_bars

FAMILIES = {
    "al_trend": ("ROC", "MA", "STD", "MAX", "MIN", "RSV"),
    "al_quantile": ("QTLU", "QTLD"),
    "al_regression": ("BETA", "RSQR", "RESI"),
    "al_position": ("RANK", "IMAX", "IMIN", "IMXD"),
    "al_correlation": ("CORR", "CORD"),
    "al_counts": ("CNTP", "CNTN", "CNTD", "SUMP", "SUMN", "SUMD"),
    "al_volume": ("VMA", "VSTD", "WVMA", "VSUMP", "VSUMN", "VSUMD"),
}
E = "1e-12"


def _sql_inputs() -> str:
    return with_bars(
        f"""q AS (SELECT *, (open + high + low + close) / 4 AS vwap, lag(close) OVER s AS c1, lag(volume) OVER s AS v1,
        CAST(row_number() OVER s AS DOUBLE) AS nth FROM bars WINDOW s AS (PARTITION BY stock_code ORDER BY trade_date)),
        p AS (SELECT *, close - c1 AS dc, volume - v1 AS dv, close / (c1 + {E}) AS step, ln(volume + 1) AS lv,
        CASE WHEN v1 IS NOT NULL THEN ln(greatest(volume / (v1 + {E}) + 1, {E})) END AS lvstep,
        abs(close / (c1 + {E}) - 1) * volume AS moved, CASE WHEN close > c1 THEN 1.0 ELSE 0.0 END AS up, CASE WHEN close < c1 THEN 1.0 ELSE 0.0 END AS fell FROM q)"""
    )


def _full(x: str, n: int, agg: str) -> str:
    return f"(CASE WHEN count({x}) OVER w{n} = {n} THEN {agg} OVER w{n} END)"


def _div(a: str, b: str) -> str:
    return f"(({a}) / (({b}) + {E}))"


def _listed(x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER w{n} = {n} THEN list({x}) OVER w{n} END)"


def _share(d: str, what: str, n: int) -> str:
    return f"(CASE WHEN count({d}) OVER w{n} = {n} THEN (sum({what}) OVER w{n}) / ((sum(abs({d})) OVER w{n}) + {E}) END)"


def _corr(a: str, b: str, n: int) -> str:
    return (
        f"(CASE WHEN count({a} + {b}) OVER w{n} = {n} AND var_pop({a}) OVER w{n} > {E} AND var_pop({b}) OVER w{n} > {E} "
        f"THEN (covar_pop({a}, {b}) OVER w{n}) / sqrt((var_pop({a}) OVER w{n}) * (var_pop({b}) OVER w{n})) END)"
    )


def _sql_factor(f: str, n: int) -> str:
    top, bottom = _full("high", n, "max(high)"), _full("low", n, "min(low)")
    slope = _full("close", n, "regr_slope(close, nth)")
    imax = f"(list_position({_listed('high', n)}, max(high) OVER w{n}))"
    imin = f"(list_position({_listed('low', n)}, min(low) OVER w{n}))"
    up, fell = _full("up", n, "avg(up)"), _full("fell", n, "avg(fell)")
    forms = {
        "ROC": _div(f"lag(close, {n}) OVER s", "close"),
        "MA": _div(_full("close", n, "avg(close)"), "close"),
        "STD": _div(_full("close", n, "stddev_samp(close)"), "close"),
        "BETA": _div(slope, "close"),
        "RSQR": f"(CASE WHEN count(close) OVER w{n} = {n} AND (var_pop(close) OVER w{n}) * {n} > {E} THEN regr_r2(close, nth) OVER w{n} END)",
        "RESI": _div(f"close - {_full('close', n, 'regr_intercept(close, nth)')} - {slope} * nth", "close"),
        "MAX": _div(top, "close"),
        "MIN": _div(bottom, "close"),
        "QTLU": _div(_full("close", n, "quantile_cont(close, 0.8)"), "close"),
        "QTLD": _div(_full("close", n, "quantile_cont(close, 0.2)"), "close"),
        "RANK": f"((len(list_filter({_listed('close', n)}, lambda x: x < close)) + (len(list_filter({_listed('close', n)}, lambda x: x = close)) + 1) / 2) / {n})",
        "RSV": _div(f"close - {bottom}", f"{top} - {bottom}"),
        "IMAX": _div(imax, str(n)),
        "IMIN": _div(imin, str(n)),
        "IMXD": _div(f"{imax} - {imin}", str(n)),
        "CORR": _corr("close", "lv", n),
        "CORD": _corr("step", "lvstep", n),
        "CNTP": up,
        "CNTN": fell,
        "CNTD": f"({up} - {fell})",
        "SUMP": _share("dc", "greatest(dc, 0)", n),
        "SUMN": _share("dc", "greatest(-dc, 0)", n),
        "SUMD": _share("dc", "dc", n),
        "VMA": _div(_full("volume", n, "avg(volume)"), "volume"),
        "VSTD": _div(_full("volume", n, "stddev_samp(volume)"), "volume"),
        "WVMA": f"({_full('moved', n, 'stddev_samp(moved)')} / ({_full('moved', n, 'avg(moved)')} + {E}))",
        "VSUMP": _share("dv", "greatest(dv, 0)", n),
        "VSUMN": _share("dv", "greatest(-dv, 0)", n),
        "VSUMD": _share("dv", "dv", n),
    }
    return forms[f]


def _family(name: str):
    names = [f"{f}{n}" for f in FAMILIES[name] for n in factors.WINDOWS]
    return lambda spark, sf_dir: rounded(factors.compute(bars(spark, sf_dir), names))


def _family_sql(name: str) -> str:
    windows = factors.WINDOWS
    cols = ", ".join(f"round({_sql_factor(f, n)}, 6) + 0.0 AS {f}{n}" for f in FAMILIES[name] for n in windows)
    return f"{_sql_inputs()} SELECT stock_code, trade_date, {cols} FROM p WINDOW s AS (PARTITION BY stock_code ORDER BY trade_date), {', '.join(f'w{n} AS {over(n)}' for n in windows)}"


def al_candle(spark, sf_dir):
    return rounded(factors.compute(bars(spark, sf_dir), [*factors.candle(), "OPEN0", "HIGH0", "LOW0", "VWAP0", "CLOSE1", "OPEN3", "VOLUME0", "VOLUME2"]))


AL_CANDLE_SQL = _sql_inputs() + f""" SELECT stock_code, trade_date, {', '.join(f'round({x}, 6) + 0.0 AS {n}' for n, x in {
    "KMID": _div("close - open", "open"), "KLEN": _div("high - low", "open"), "KMID2": _div("close - open", "high - low"),
    "KUP": _div("high - greatest(open, close)", "open"), "KUP2": _div("high - greatest(open, close)", "high - low"),
    "KLOW": _div("least(open, close) - low", "open"), "KLOW2": _div("least(open, close) - low", "high - low"),
    "KSFT": _div("2 * close - high - low", "open"), "KSFT2": _div("2 * close - high - low", "high - low"),
    "OPEN0": _div("open", "close"), "HIGH0": _div("high", "close"), "LOW0": _div("low", "close"), "VWAP0": _div("vwap", "close"),
    "CLOSE1": _div("lag(close) OVER s", "close"), "OPEN3": _div("lag(open, 3) OVER s", "close"),
    "VOLUME0": _div("volume", "volume"), "VOLUME2": _div("lag(volume, 2) OVER s", "volume"),
}.items())} FROM p WINDOW s AS (PARTITION BY stock_code ORDER BY trade_date)"""


def al_lag_panel(spark, sf_dir):
    """A digest row per bar of the 360-lag panel: how many values it has and their sum by field."""
    from pyspark.sql import functions as F

    wide = factors.lag_panel(bars(spark, sf_dir))
    by = lambda f: [F.coalesce(F.col(f"{f}{k}"), F.lit(0.0)) for k in range(60)]
    total = {f: sum(by(f)[1:], by(f)[0]) for f in ("CLOSE", "OPEN", "HIGH", "LOW", "VWAP", "VOLUME")}
    return wide.select(KEY, TIME, *[F.round(x, 5).alias(f"{f.lower()}_sum") for f, x in total.items()], F.round("CLOSE59", 6).alias("CLOSE59"), F.round("VOLUME30", 6).alias("VOLUME30"))


AL_LAG_PANEL_SQL = _sql_inputs() + f""" SELECT stock_code, trade_date, {', '.join(
    f"round((sum({f}) OVER w60) / ({'volume' if f == 'volume' else 'close'} + {E}), 5) AS {f}_sum" for f in ("close", "open", "high", "low", "vwap", "volume"))},
  round({_div("lag(close, 59) OVER s", "close")}, 6) AS CLOSE59, round({_div("lag(volume, 30) OVER s", "volume")}, 6) AS VOLUME30
  FROM p WINDOW s AS (PARTITION BY stock_code ORDER BY trade_date), w60 AS {over(60)}"""


def factor_long(spark, sf_dir):
    """Long form of a few factors: one row per value that is there."""
    return rounded(factors.to_long(factors.compute(bars(spark, sf_dir), ["KMID", "MA5", "ROC10", "VMA20"])))


FACTOR_LONG_SQL = _sql_inputs() + f""", f AS (SELECT stock_code, trade_date, {_div("close - open", "open")} AS "KMID",
  {", ".join(f'{_sql_factor(k, n)} AS "{k}{n}"' for k, n in (("MA", 5), ("ROC", 10), ("VMA", 20)))}
  FROM p WINDOW s AS (PARTITION BY stock_code ORDER BY trade_date), w5 AS {over(5)}, w10 AS {over(10)}, w20 AS {over(20)})
  SELECT stock_code, trade_date, feature_name, round(feature_value, 6) + 0.0 AS feature_value
  FROM (UNPIVOT f ON "KMID", "MA5", "ROC10", "VMA20" INTO NAME feature_name VALUE feature_value)"""

def al_set(spark, sf_dir):
    """The whole set of 158 columns, in long form and summed up by feature."""
    from pyspark.sql import functions as F

    long = factors.to_long(factors.compute(bars(spark, sf_dir)))
    x = F.col("feature_value")
    return rounded(long.groupBy("feature_name").agg(F.count("*").alias("n"), F.avg(F.when(F.abs(x) < 1e6, x)).alias("mean")), 4)


def al_components(spark, sf_dir):
    """How many values the factors of each component have, of six factors."""
    from pyspark.sql import functions as F

    long = factors.to_long(factors.compute(bars(spark, sf_dir), ["KMID2", "MA5", "STD20", "VMA20", "CLOSE1", "VOLUME2"]))
    return long.groupBy(factors.component(F.col("feature_name")).alias("component"), "feature_name").agg(F.count("*").alias("n"))


AL_COMPONENTS_SQL = _sql_inputs() + f""", f AS (SELECT {_div("2 * close - high - low", "high - low")} AS "KMID2", {_sql_factor("MA", 5)} AS "MA5", {_sql_factor("STD", 20)} AS "STD20", {_sql_factor("VMA", 20)} AS "VMA20", lag(close) OVER s AS "CLOSE1", lag(volume, 2) OVER s AS "VOLUME2"
  FROM p WINDOW s AS (PARTITION BY stock_code ORDER BY trade_date), w5 AS {over(5)}, w20 AS {over(20)})
  SELECT CASE WHEN feature_name IN ('MA5', 'CLOSE1') THEN 'trend' WHEN feature_name = 'STD20' THEN 'risk' ELSE 'quality' END AS component, feature_name, count(*) AS n
  FROM (UNPIVOT f ON "KMID2", "MA5", "STD20", "VMA20", "CLOSE1", "VOLUME2" INTO NAME feature_name VALUE feature_value) GROUP BY ALL"""


QUERIES = {"al_set": al_set, "al_components": al_components, "al_candle": al_candle, "al_lag_panel": al_lag_panel, "factor_long": factor_long, **{n: _family(n) for n in FAMILIES}}
SQL = {"al_components": AL_COMPONENTS_SQL, "al_candle": AL_CANDLE_SQL, "al_lag_panel": AL_LAG_PANEL_SQL, "factor_long": FACTOR_LONG_SQL, **{n: _family_sql(n) for n in FAMILIES}}
