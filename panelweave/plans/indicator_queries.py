"""Indicator queries over daily bars; the windowed ones with SQL, the recurrences with recursive SQL where short."""

from __future__ import annotations

from panelweave.functions.columns import KEY, TIME
from panelweave.operators import indicators as ti
from panelweave.plans.common import bars, over, rounded, with_bars


def _part(*names: str):
    return lambda s, d: rounded(ti.windowed_indicators(bars(s, d)).select(KEY, TIME, *names))


GROUPS = {
    "ti_moving_averages": [f"ma{n}" for n in ti.MOVING] + [f"volume_ma{n}" for n in ti.VOLUME_MOVING],
    "ti_bands": ["bb_upper", "bb_middle", "bb_lower", "bb_position", "bb_width"],
    "ti_returns": ["return_1", "return_3", "return_5", "return_20", "return_60", "intraday_return", "mean_reversion_5"],
    "ti_extremes": ["high_20", "high_60", "low_20", "distance_high_20", "distance_high_60", "distance_ma20", "distance_ma25", "distance_ma60", "pullback_quality"],
    "ti_slopes": ["ma20_slope", "ma25_slope", "ma60_slope", "ma5_10_gap", "ma5_20_gap"],
    "ti_candles": ["body_ratio", "upper_shadow", "lower_shadow"],
    "ti_volume": ["volume_ratio_5", "volume_ratio_10", "volume_cross", "volume_spike", "volume_trend", "turnover_stability"],
    "ti_ranges": ["range_position_20", "range_position_10", "price_vs_vwap"],
    "ti_oscillators": ["williams", "cyc", "cyc_ma"],
    "ti_forward": ["forward_return_20", "forward_return_40", "forward_return_60", "forward_runup_60", "forward_drawdown_60"],
    "ti_trend_regime": ["trend_regime"],
}
QUERIES = {
    **{n: _part(*cols) for n, cols in GROUPS.items()},
    "ti_range_scores": lambda s, d: rounded(ti.range_scores(ti.windowed_indicators(bars(s, d), turn=True)), 4),
    "ti_range_composite": lambda s, d: rounded(ti.range_scores(ti.windowed_indicators(ti.with_recurrences(bars(s, d), read_back=True), turn=True)), 4),
    "ti_recurrences": lambda s, d: rounded(ti.recurrences(bars(s, d)), 3),
    "ti_ema": lambda s, d: rounded(ti.recurrences(bars(s, d)).select(KEY, TIME, "ema12", "ema26", "macd"), 4),
    "ti_expected_score": lambda s, d: rounded(ti.full(bars(s, d)).select(KEY, TIME, "matrix_raw", "matrix_score", "expected_3m_score")),
}

_f = lambda x, n, agg, k=None: f"CASE WHEN count({x}) OVER w{n} >= {k or n} THEN {agg} OVER w{n} END"
WINDOWS = ", ".join(f"w{n} AS {over(n)}" for n in (5, 10, 14, 20, 25, 30, 50, 60)) + ", s AS (PARTITION BY stock_code ORDER BY trade_date)"
CTE = with_bars(
    "i1 AS (SELECT *, close * volume AS pv, " + ", ".join(f"{_f('close', n, 'avg(close)')} AS ma{n}" for n in ti.MOVING) + ", " + ", ".join(f"{_f('volume', n, 'avg(volume)')} AS volume_ma{n}" for n in ti.VOLUME_MOVING)
    + f", {_f('close', 20, 'stddev_pop(close)')} AS bb, " + ", ".join(f"close / lag(close, {n}) OVER s - 1 AS return_{n}" for n in (1, 3, 5, 20, 60))
    + f", (close - open) / open AS intraday_return, {_f('high', 20, 'max(high)', 5)} AS high_20, {_f('high', 60, 'max(high)', 20)} AS high_60, {_f('low', 20, 'min(low)', 5)} AS low_20, {_f('high', 10, 'max(high)', 5)} AS high10, {_f('low', 10, 'min(low)', 5)} AS low10,"
    + f" {_f('close', 50, 'max(close)')} AS max50, {_f('close', 50, 'min(close)')} AS min50, {_f('high', 14, 'max(high)')} AS high14, {_f('low', 14, 'min(low)')} AS low14,"
    + " lead(close, 20) OVER s / close - 1 AS forward_return_20, lead(close, 40) OVER s / close - 1 AS forward_return_40, lead(close, 60) OVER s / close - 1 AS forward_return_60,"
    + " CASE WHEN count(close) OVER n60 >= 20 THEN max(high) OVER n60 / close - 1 END AS forward_runup_60, CASE WHEN count(close) OVER n60 >= 20 THEN min(low) OVER n60 / close - 1 END AS forward_drawdown_60"
    + f" FROM bars WINDOW {WINDOWS}, n60 AS (PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING))",
    f"""i2 AS (SELECT *, ma20 AS bb_middle, ma20 + 2 * bb AS bb_upper, ma20 - 2 * bb AS bb_lower, -return_5 AS mean_reversion_5, close / high_20 - 1 AS distance_high_20, close / high_60 - 1 AS distance_high_60,
    close / ma20 - 1 AS distance_ma20, close / ma25 - 1 AS distance_ma25, close / ma60 - 1 AS distance_ma60, ma20 / lag(ma20, 5) OVER s - 1 AS ma20_slope, ma25 / lag(ma25, 5) OVER s - 1 AS ma25_slope, ma60 / lag(ma60, 10) OVER s - 1 AS ma60_slope,
    ma5 / ma10 - 1 AS ma5_10_gap, ma5 / ma20 - 1 AS ma5_20_gap, abs(close - open) / nullif(high - low, 0) AS body_ratio, (high - greatest(open, close)) / nullif(high - low, 0) AS upper_shadow, (least(open, close) - low) / nullif(high - low, 0) AS lower_shadow,
    volume / volume_ma5 AS volume_ratio_5, volume / volume_ma10 AS volume_ratio_10, volume_ma5 / volume_ma20 AS volume_trend, coalesce(volume_ma5 > volume_ma60 AND lag(volume_ma5) OVER s <= lag(volume_ma60) OVER s, false) AS volume_cross,
    (close - low_20) / nullif(high_20 - low_20, 0) AS range_position_20, (close - low10) / nullif(high10 - low10, 0) AS range_position_10, ({_f('pv', 20, 'sum(pv)', 5)}) / ({_f('volume', 20, 'sum(volume)', 5)}) AS vwap,
    -100 * (high14 - close) / nullif(high14 - low14, 0) AS williams, 100 * (close - min50) / nullif(max50 - min50, 0) AS cyc FROM i1 WINDOW {WINDOWS})""",
    f"""i3 AS (SELECT *, CASE WHEN bb > 1e-12 THEN (close - bb_lower) / (bb_upper - bb_lower) END AS bb_position, (bb_upper - bb_lower) / bb_middle AS bb_width, -abs(distance_ma20) AS pullback_quality, (close - vwap) / vwap AS price_vs_vwap,
    {_f('volume_ratio_10', 10, 'max(volume_ratio_10)', 3)} AS volume_spike, {_f('volume_ratio_10', 10, 'stddev_samp(volume_ratio_10)', 5)} AS turnover_stability, {_f('cyc', 10, 'avg(cyc)')} AS cyc_ma,
    CASE WHEN ma20 >= ma60 THEN 25.0 ELSE 0 END + CASE WHEN close >= ma20 THEN 15 ELSE 0 END + CASE WHEN ma20_slope > 0 THEN 20 ELSE 0 END + CASE WHEN ma60_slope > 0 THEN 15 ELSE 0 END + CASE WHEN return_20 > 0 THEN 15 ELSE 0 END + CASE WHEN return_60 > -0.05 THEN 10 ELSE 0 END AS trend_regime
    FROM i2 WINDOW {WINDOWS})""",
)


def _score(x: str, scale: float) -> str:
    mean, std = _f(x, 60, f"avg({x})", 20), _f(x, 60, f"stddev_samp({x})", 20)
    z = f"(({x}) - ({mean})) / (CASE WHEN ({std}) > 1e-12 THEN ({std}) END)"
    return f"(CASE WHEN {z} IS NOT NULL THEN least(greatest(50 + least(greatest({z}, -3), 3) * {scale}, 0), 100) END)"


def _select(cols: list[str]) -> str:
    return CTE + " SELECT stock_code, trade_date, " + ", ".join(c if c == "volume_cross" else f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in cols) + " FROM i3"


_EMA = lambda n: f"""e{n} AS (SELECT stock_code, nth, avg(close) OVER (PARTITION BY stock_code ORDER BY nth ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS v FROM q QUALIFY nth = {n}
  UNION ALL SELECT q.stock_code, q.nth, e.v + {2 / (n + 1)!r} * (q.close - e.v) FROM e{n} e JOIN q ON q.stock_code = e.stock_code AND q.nth = e.nth + 1)"""  # noqa: E731
# All states of a security side by side: each starts at the mean of its first values and moves by its weight.
_STATES = {f"ema{n}": ("close", n, 2 / (n + 1), 1) for n in ti.EMA} | {f"atr{n}": ("tr", n, 1 / n, 2) for n in ti.ATR} | {"gain": ("up", ti.RSI, 1 / ti.RSI, 2), "loss": ("down", ti.RSI, 1 / ti.RSI, 2)}
_begun = lambda x, n, k: f"CASE WHEN nth = {n + k - 1} THEN avg({x}) OVER (PARTITION BY stock_code ORDER BY nth ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
_moved = lambda s, x, w, at: f"CASE WHEN q.nth = {at} THEN q.{s}_0 WHEN q.nth > {at} THEN r.{s} + {w!r} * (q.{x} - r.{s}) END"
RECURSIVE = "WITH RECURSIVE " + with_bars().removeprefix("WITH ") + f""",
  q0 AS (SELECT *, row_number() OVER s AS nth, lag(close) OVER s AS was FROM bars WINDOW s AS (PARTITION BY stock_code ORDER BY trade_date)),
  q1 AS (SELECT *, greatest(close - was, 0) AS up, greatest(was - close, 0) AS down, CASE WHEN was IS NOT NULL THEN greatest(high - low, abs(high - was), abs(low - was)) END AS tr FROM q0),
  q AS MATERIALIZED (SELECT stock_code, trade_date, nth, close, up, down, tr, {", ".join(f"{_begun(x, n, k)} AS {s}_0" for s, (x, n, _, k) in _STATES.items())} FROM q1),
  r AS (SELECT stock_code, nth, {", ".join(f"CAST(NULL AS DOUBLE) AS {s}" for s in _STATES)} FROM q WHERE nth = 1
    UNION ALL SELECT q.stock_code, q.nth, {", ".join(_moved(s, x, w, n + k - 1) for s, (x, n, w, k) in _STATES.items())} FROM r JOIN q ON q.stock_code = r.stock_code AND q.nth = r.nth + 1),
  m0 AS MATERIALIZED (SELECT *, ema12 - ema26 AS macd, CASE WHEN gain + loss > 0 THEN 100 * gain / (gain + loss) WHEN gain + loss IS NOT NULL THEN 50 END AS rsi FROM r),
  m AS MATERIALIZED (SELECT *, {_begun("macd", ti.SIGNAL, 26)} AS signal_0 FROM m0),
  g AS (SELECT stock_code, nth, CAST(NULL AS DOUBLE) AS signal FROM m WHERE nth = 1 UNION ALL SELECT q.stock_code, q.nth, {_moved("signal", "macd", 2 / (ti.SIGNAL + 1), 25 + ti.SIGNAL)} FROM g r JOIN m q ON q.stock_code = r.stock_code AND q.nth = r.nth + 1),
  k0 AS (SELECT *, count(rsi) OVER k AS kn, min(rsi) OVER k AS lo, max(rsi) OVER k AS hi FROM m JOIN g USING (stock_code, nth) JOIN (SELECT stock_code, nth, trade_date FROM q) USING (stock_code, nth)
    WINDOW k AS (PARTITION BY stock_code ORDER BY nth ROWS BETWEEN {ti.STOCHASTIC - 1} PRECEDING AND CURRENT ROW)),
  k1 AS (SELECT *, macd - signal AS macd_hist, signal AS macd_signal, CASE WHEN kn = {ti.STOCHASTIC} THEN CASE WHEN hi > lo THEN 100 * (rsi - lo) / (hi - lo) ELSE 0 END END AS stoch_k FROM k0),
  k2 AS (SELECT *, CASE WHEN count(stoch_k) OVER d = 3 THEN avg(stoch_k) OVER d END AS stoch_d FROM k1 WINDOW d AS (PARTITION BY stock_code ORDER BY nth ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""
SQL = {
    "ti_recurrences": RECURSIVE + " SELECT stock_code, trade_date, " + ", ".join(f"round({n}, 3) + 0.0 AS {n}" for n in ti.RECURRENT) + " FROM k2",
    **{n: _select(cols) for n, cols in GROUPS.items()},
    "ti_range_scores": CTE + f""", r AS (SELECT *, abs(price_vs_vwap) AS stretch FROM i3) SELECT stock_code, trade_date,
      round(CASE WHEN range_position_20 + bb_position + {_score('mean_reversion_5', 12)} IS NOT NULL THEN least(greatest((1 - range_position_20) * 40 + (1 - least(greatest(bb_position, 0), 1)) * 30 + {_score('mean_reversion_5', 12)} * 0.3, 0), 100) END, 4) + 0.0 AS range_reversion,
      round(100 - {_score('stretch', 14)}, 4) + 0.0 AS vwap_stretch, round(100 - {_score('turnover_stability', 10)}, 4) + 0.0 AS range_stability, round(100 - {_score('bb_width', 10)}, 4) + 0.0 AS band_compression FROM r WINDOW {WINDOWS}""",
    "ti_ema": "WITH RECURSIVE " + with_bars().removeprefix("WITH ") + f""", q AS (SELECT stock_code, trade_date, close, row_number() OVER (PARTITION BY stock_code ORDER BY trade_date) AS nth FROM bars), {_EMA(12)}, {_EMA(26)}
      SELECT q.stock_code, trade_date, round(e12.v, 4) + 0.0 AS ema12, round(e26.v, 4) + 0.0 AS ema26, round(e12.v - e26.v, 4) + 0.0 AS macd FROM q LEFT JOIN e12 USING (stock_code, nth) LEFT JOIN e26 USING (stock_code, nth)""",
}
