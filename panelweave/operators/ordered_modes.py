"""Entry modes in a fixed order: at each bar the first mode whose rule holds decides, with its own gates and terms.

Rules are SQL over ``indicators.complete`` and a few columns of the bars before; a missing value fulfils no
condition. One ``CASE`` gives the number of the mode, bars without one go, and everything else a mode brings is
looked up by that number in a small table, so that neither plan nor generated code grows with modes times terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.columns import KEY, TIME, quantile, security, trailing, windowed

c = F.col


@dataclass(frozen=True)
class Mode:
    """A rule, what its signals start with, and the terms of a trade that follows.

    ``group`` names the securities that the mode is for (all, where it is empty). A score passes from the greater of its
    gate plus the shift and the floor on.
    """

    name: str
    rule: str
    strength: int = 6
    group: str = ""
    matrix: tuple[float, float] = (0.0, 35.0)
    expected: tuple[float, float] = (0.0, 52.0)
    horizon: int = 60
    held: int = 0
    trail: float = 0.92
    gain: float = 0.05
    tier: str = "strong"
    most_risk: int = 4
    actionable: bool = True


#: No gate, only the floor.
FREE = -1e9

# Conditions that modes share, then the modes in their order. -------------------

SHARED = {
    "_trend": "ma20 >= ma60 * 0.98 AND ma20_slope > -0.01 AND ma60_slope > -0.02",
    "_turn": "stoch_k > 15 AND stoch_k < 55 AND stoch_k > stoch_d AND stoch_k_1 IS NOT NULL AND stoch_d_1 IS NOT NULL AND (stoch_k_1 <= stoch_d_1 + 3 OR stoch_k_1 > stoch_d_1 AND stoch_k_2 <= stoch_d_2 + 3)",
    "_seen": "rsi IS NOT NULL AND ma20 IS NOT NULL AND ma60 IS NOT NULL OR _bottom AND rsi IS NOT NULL AND ma20 IS NOT NULL AND distance_ma25 IS NOT NULL AND volume_spike IS NOT NULL"
             " OR ma60 IS NULL AND rsi IS NOT NULL AND ma10 IS NOT NULL AND ma20 IS NOT NULL AND distance_high_20 IS NOT NULL AND volume_ratio_10 IS NOT NULL",
}
SINCE = "(_turn OR macd_gap > macd_gap_1 OR close > close_1)"
OVEREXTENDED = "coalesce(_bottom AND rsi >= 64 AND stoch_k >= 95 AND distance_ma25 >= 0.075 AND distance_high_20 >= -0.025 AND upper_shadow >= 0.35, false)"

MODES = (
    Mode("ma25_volume_breakout",
         "ma10 >= ma25 * 0.992 AND ma25_slope > -0.008 AND close > ma25 AND close_1 <= ma25_1 * 1.015 AND distance_ma25 BETWEEN 0 AND 0.09 AND volume_spike >= 1.9 AND volume_ratio_10 >= 0.95"
         " AND rsi BETWEEN 47 AND 67 AND return_20 > -0.03 AND return_60 > -0.22 AND distance_high_20 >= -0.10 AND macd_gap > -0.03 AND upper_shadow <= 0.50 AND intraday_return > -0.02", 7),
    Mode("momentum_reversal_breakout",
         "close > ma25 AND close_1 <= ma25_1 * 1.01 AND distance_ma25 BETWEEN 0.03 AND 0.09 AND volume_spike >= 2.0 AND volume_ratio_10 >= 1.5 AND rsi BETWEEN 50 AND 60 AND return_20 > 0"
         " AND return_60 > -0.35 AND distance_high_20 >= -0.03 AND macd_gap > 0.15 AND upper_shadow <= 0.35 AND intraday_return > 0.03", 7, matrix=(-10, 48), expected=(0, 58)),
    Mode("ma25_support_reclaim",
         "close >= ma25 AND distance_ma25 BETWEEN 0 AND 0.07 AND ma25_slope > -0.01 AND volume_ratio_10 BETWEEN 0.95 AND 1.40 AND rsi BETWEEN 48 AND 62 AND return_60 > 0.03 AND distance_high_20 >= -0.12"
         " AND macd_gap > -0.85 AND intraday_return > 0 AND ma25_1 IS NOT NULL AND (close_1 <= ma25_1 * 1.03 OR volume_ratio_10_1 >= 1.8)", group="support", matrix=(-32, 34), expected=(-8, 54)),
    Mode("ma25_volume_breakout_alt",
         "close > ma25 AND distance_ma25 BETWEEN 0.03 AND 0.08 AND ma25_slope > 0.02 AND volume_ratio_10 >= 1.2 AND rsi BETWEEN 55 AND 63 AND return_60 > 0.15 AND distance_high_20 >= -0.08 AND macd_gap > -0.40",
         group="support", matrix=(-32, 34), expected=(-6, 52)),
    Mode("ma25_trend_follow",
         "close > ma25 AND distance_ma25 BETWEEN 0.03 AND 0.07 AND ma25_slope > 0.03 AND volume_ratio_10 >= 1.15 AND rsi BETWEEN 58 AND 63 AND return_60 > 0.20 AND distance_high_20 >= -0.06 AND macd_gap > -0.40",
         group="support", matrix=(-32, 38), expected=(-8, 54)),
    Mode("bottom_volume_rebound",
         "_nth >= 3 AND volume_ratio_10_1 >= 1.8 AND distance_ma25_1 <= -0.03 AND rsi_1 <= 45 AND close > close_1 AND close >= open AND rsi BETWEEN 40 AND 55 AND distance_ma25 >= -0.10 AND macd_gap > -1.60"
         " AND matrix_score >= 15 AND expected_3m_score >= 34", group="support", matrix=(-30, 32), expected=(-6, 50)),
    Mode("bottom_volume_cluster",
         "_nth >= 21 AND ma20 IS NOT NULL AND volume_spike >= 2.5 AND volume_ratio_10 >= 1.55 AND rsi BETWEEN 27 AND 33 AND distance_ma25 <= -0.18 AND macd_gap > -3.2 AND return_20 <= -0.22",
         group="bottom", matrix=(FREE, 30), expected=(FREE, 18)),
    Mode("bottom_volume_rebound_next",
         "volume_spike_1 >= 2.5 AND rsi_1 <= 31 AND distance_ma25_1 <= -0.18 AND close >= close_1 * 1.003 AND low >= low_1 * 0.98 AND close >= open AND volume_ratio_10 >= 1.15 AND rsi BETWEEN 29 AND 37"
         " AND distance_ma25 <= -0.14 AND macd_gap > -3.2", group="bottom", matrix=(FREE, 30), expected=(FREE, 18)),
    Mode("stoch_double_bottom",
         "_nth >= 21 AND stoch_k > stoch_d AND stoch_k > 15 AND stoch_k < 65 AND stoch_k_1 <= stoch_k AND stoch_d_1 IS NOT NULL AND volume_ratio_10 >= 1.0 AND volume_spike >= 1.35 AND rsi BETWEEN 44 AND 52"
         " AND distance_ma25 BETWEEN -0.05 AND 0.01 AND return_60 > 0.20 AND distance_high_20 >= -0.14 AND macd_gap > -0.95 AND close > low_before_20 * 1.03", group="bottom", matrix=(-12, 50), expected=(-2, 58)),
    Mode("stoch_mild_volume",
         "stoch_k > stoch_d AND stoch_k BETWEEN 55 AND 90 AND stoch_k_1 <= stoch_d_1 + 8 AND volume_ratio_10 BETWEEN 1.05 AND 1.45 AND volume_spike >= 1.6 AND rsi BETWEEN 52 AND 58"
         " AND distance_ma25 BETWEEN 0 AND 0.05 AND distance_high_20 >= -0.04 AND return_60 > -0.16 AND macd_gap > 0.25", group="bottom", matrix=(-8, 58), expected=(-2, 66)),
    Mode("cost_line_expansion",
         "ema5 > ema13 AND ema13 > ema34 AND ema5_1 > ema13_1 AND ema13_1 > ema34_1 AND cyc_spread_34 BETWEEN 0.07 AND 0.16 AND cyc_spread_34 > cyc_spread_34_1 AND cyc_spread_13 >= 0.025 AND cyc34_slope > 0"
         " AND volume_ratio_10 BETWEEN 1.1 AND 1.8 AND volume_spike >= 1.6 AND macd_gap > 0.45 AND distance_high_20 >= -0.02 AND distance_ma25 BETWEEN 0.10 AND 0.17 AND upper_shadow <= 0.12"
         " AND rsi BETWEEN 60 AND 66 AND return_60 > 0.18 AND return_60 <= 0.28", 7, group="bottom", matrix=(-6, 60), expected=(-4, 60)),
    Mode("stoch_pullback",
         "_turn AND close >= ma20 * 0.97 AND close <= ma25 * 1.02 AND ma20 >= ma60 * 0.95 AND rsi BETWEEN 43 AND 58 AND return_60 > -0.35 AND distance_high_20 >= -0.12 AND macd_gap > -0.35 AND volume_spike >= 1.75"
         " AND matrix_score >= 45 AND expected_3m_score >= 58", matrix=(-18, 45), expected=(-2, 56)),
    Mode("trend_reversal",
         "ma60 IS NOT NULL AND ma20_1 IS NOT NULL AND ma25_1 IS NOT NULL AND ma60_1 IS NOT NULL AND close >= ma20 * 0.97 AND close >= ma25 * 0.95 AND distance_ma20 BETWEEN -0.04 AND 0.04"
         " AND distance_ma25 BETWEEN -0.06 AND 0.05 AND rsi BETWEEN 44 AND 60 AND stoch_k > stoch_d AND stoch_k BETWEEN 20 AND 75 AND macd_gap > -0.10 AND distance_high_20 >= -0.18 AND return_20 > -0.16"
         f" AND return_60 > -0.30 AND matrix_score >= 42 AND expected_3m_score >= 56 AND {SINCE} AND (distance_ma20_1 <= -0.02 OR return_20_1 <= -0.05 OR macd_gap_1 <= 0)",
         matrix=(-10, 42), expected=(-4, 56), horizon=80, held=8, trail=0.90, gain=0.08),
    Mode("trend_acceleration",
         "ma20 >= ma60 * 0.98 AND ma20_slope > 0 AND ma25_slope > -0.005 AND ma60_slope > -0.01 AND close >= ma20 AND distance_ma20 BETWEEN -0.01 AND 0.10 AND distance_high_20 >= -0.06 AND rsi BETWEEN 50 AND 72"
         " AND return_20 > 0 AND return_60 > -0.10 AND volume_ratio_10 BETWEEN 0.95 AND 2.6 AND volume_spike >= 1.2 AND macd_gap > -0.05 AND matrix_score >= 50 AND expected_3m_score >= 62 AND close >= close_1",
         matrix=(-8, 48), expected=(0, 62), horizon=90, held=10, trail=0.88, gain=0.10),
    Mode("early_reversal",
         "rsi BETWEEN 38 AND 52 AND macd_gap > -0.20 AND distance_high_20 BETWEEN -0.20 AND -0.04 AND volume_ratio_10 BETWEEN 0.45 AND 1.8 AND upper_shadow <= 0.35 AND intraday_return >= -0.01"
         f" AND matrix_score >= 38 AND expected_3m_score >= 52 AND {SINCE}", matrix=(-12, 40), expected=(-6, 54), horizon=75, held=6, trail=0.91, gain=0.08),
    Mode("ipo_rebound",
         "ma60 IS NULL AND close >= ma10 * 0.96 AND close >= ma20 * 0.94 AND rsi BETWEEN 42 AND 68 AND distance_high_20 >= -0.20 AND volume_ratio_10 BETWEEN 0.50 AND 2.4 AND matrix_score >= 45"
         " AND expected_3m_score >= 58 AND (close > close_1 OR intraday_return > 0 OR stoch_k > stoch_d)", matrix=(FREE, 45), expected=(FREE, 58), horizon=90, held=12, trail=0.88, gain=0.12),
    Mode("launch_breakout",
         "ma60 IS NULL AND close >= ma10 AND close >= ma20 * 0.98 AND ma10 >= ma10_1 * 0.995 AND ma20 >= ma20_1 * 0.995 AND rsi BETWEEN 52 AND 78 AND distance_high_20 >= -0.10 AND volume_ratio_10 BETWEEN 0.75 AND 2.8"
         " AND matrix_score >= 46 AND expected_3m_score >= 60 AND return_3 >= 0.03 AND intraday_return >= 0 AND (close > close_1 OR stoch_k >= stoch_d)",
         matrix=(FREE, 46), expected=(FREE, 60), horizon=100, held=15, trail=0.86, gain=0.15),
    Mode("ma25_volume_breakout_watch",
         "ma10 >= ma25 * 0.985 AND ma25_slope > -0.015 AND close > ma25 AND close_1 <= ma25_1 * 1.02 AND distance_ma25 BETWEEN 0 AND 0.10 AND volume_spike >= 1.8 AND volume_ratio_10 >= 0.9 AND rsi BETWEEN 45 AND 68"
         " AND return_20 > -0.05 AND return_60 > -0.28 AND distance_high_20 >= -0.12 AND macd_gap > -0.05 AND upper_shadow <= 0.60 AND intraday_return > -0.03", 5, tier="weak", most_risk=5, actionable=False),
    Mode("trend_pullback",
         "_trend AND distance_ma20 BETWEEN -0.06 AND 0.02 AND rsi BETWEEN 40 AND 58 AND return_20 > -0.08 AND volume_trend <= 1.15 AND macd_gap > -0.03 AND close >= close_1 AND close >= ma5 * 0.99"),
    Mode("base_breakout",
         "_trend AND distance_high_20 >= -0.02 AND distance_high_60 >= -0.03 AND volume_ratio_10 BETWEEN 1.2 AND 2.4 AND macd > macd_signal AND ma5 >= ma10 AND rsi BETWEEN 50 AND 70 AND distance_ma20 BETWEEN 0 AND 0.13"
         f" AND return_60 <= 0.30 AND close >= close_1 AND NOT {OVEREXTENDED}", 7),
    Mode("oversold_reversal",
         "NOT _trend AND stoch_k < 20 AND rsi BETWEEN 28 AND 40 AND cyc <= 18 AND close >= bb_lower AND volume_ratio_10 BETWEEN 0.75 AND 1.00 AND distance_high_20 <= -0.12 AND distance_ma20 <= -0.04 AND ma20 >= ma60 * 0.97",
         4, most_risk=2, horizon=40),
)

#: What makes a signal of a mode stronger by one; then what makes it riskier.
BONUS = {
    "ma25_volume_breakout": {"trend": "_trend", "near the high": "distance_high_20 > -0.08"},
    "stoch_pullback": {"near the high": "distance_high_20 > -0.10"},
    "trend_reversal": {"stochastic turn": "_turn"},
    "trend_acceleration": {"near the high": "distance_high_20 >= -0.03"},
    "early_reversal": {"regime": "trend_regime >= 35"},
    "ma25_volume_breakout_watch": {"trend": "_trend", "near the high": "distance_high_20 > -0.12"},
    "trend_pullback": {"near the high": "distance_high_20 > -0.08", "volume": "volume_ratio_10 >= 0.9"},
    "base_breakout": {"momentum": "return_20 > 0.05"},
    "oversold_reversal": {"stochastic rises": "stoch_k > stoch_k_1", "stochastic crosses": "stoch_k_1 <= stoch_d_1 AND stoch_k > stoch_d"},
}
RISKIER = {
    "base_breakout": ("volume_ratio_10 > 2.5",),
    "ma25_volume_breakout": ("distance_ma25 > 0.08", "upper_shadow > 0.45"),
    "oversold_reversal": ("return_20 < -0.15",),
}
#: Modes that start without confirmation: one of their bonuses or the turn must confirm them.
UNCONFIRMED = ("oversold_reversal",)
#: Securities of the groups.
GROUPS: Mapping[str, tuple[str, ...]] = {"support": ("09866",), "bottom": ("02015",)}
#: Rolling gates: window, least values, share, and the gate where there are too few.
MATRIX_GATE, EXPECTED_GATE = (40, 15, 0.40, 50.0), (40, 15, 0.45, 55.0)
LEAST_STRENGTH = 6

# ---------------------------------------------------------------------------------------------

BEFORE = ("close", "low", "ma10", "ma20", "ma25", "ma60", "ema5", "ema13", "ema34", "cyc_spread_34", "rsi", "stoch_k", "stoch_d", "macd_gap", "volume_ratio_10", "volume_spike", "distance_ma20", "distance_ma25", "return_20")
CONTEXT = ("matrix_score", "expected_3m_score", "stoch_k", "stoch_d", "rsi", "volatility_10", "cyc", "atr14", "return_3", "volume_ratio_10", "trend_regime", "forward_return_20", "forward_return_40", "forward_return_60", "forward_drawdown_60")


def _gate(x: str, window: int, least: int, share: float, otherwise: float) -> Column:
    w = trailing(window)
    return F.coalesce(F.when(F.count(x).over(w) >= least, quantile(c(x), share, w)), F.lit(otherwise))


def with_context(ind: DataFrame, groups: Mapping[str, Iterable[str]]) -> DataFrame:
    """What the rules read beside the bar's own indicators: bars before, gates, risk levels, and whether the security is in a group."""
    w = security()
    rows = ind.withColumns({
        **{f"{n}_1": F.lag(n).over(w) for n in BEFORE}, "stoch_k_2": F.lag("stoch_k", 2).over(w), "stoch_d_2": F.lag("stoch_d", 2).over(w),
        "_nth": F.row_number().over(w), "low_before_20": F.min("low").over(w.rowsBetween(-20, -1)), "matrix_gate": _gate("matrix_score", *MATRIX_GATE), "expected_gate": _gate("expected_3m_score", *EXPECTED_GATE),
        "_calm": windowed(c("volatility_10"), 20, F.avg("volatility_10")), "_wide": F.when(F.count("atr14").over(trailing(20)) == 20, quantile(c("atr14"), 0.9, trailing(20))),
    })
    rows = rows.withColumns({f"_{g}": c(KEY).isin(*codes) if codes else F.lit(False) for g, codes in groups.items()})
    for name, rule in SHARED.items():
        rows = rows.withColumn(name, F.expr(f"coalesce({rule}, false)"))
    return rows


def first_mode(modes: Iterable[Mode]) -> Column:
    """Number of the first mode whose rule holds, from 0; NULL where there is none."""
    return F.expr("CASE " + " ".join(f"WHEN {f'_{m.group} AND ' if m.group else ''}({m.rule}) THEN {k}" for k, m in enumerate(modes)) + " END")


def _by_mode(modes: tuple[Mode, ...], of: Mapping[str, Iterable[str]], over) -> Column:
    """For the bar's mode, ``over`` of its conditions; an empty list for modes that ``of`` has none of."""
    out = F.when(F.lit(False), over([]))
    for k, m in enumerate(modes):
        if m.name in of:
            out = out.when(c("_mode") == k, over(of[m.name]))
    return out.otherwise(over([]))


def _labels(rules) -> Column:
    pairs = rules.items() if isinstance(rules, Mapping) else [(r, r) for r in rules]
    return F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(label)) for label, rule in pairs], F.lit(None).cast("string")))


def mode_buys(ind: DataFrame, modes: tuple[Mode, ...] = MODES, groups: Mapping[str, Iterable[str]] = GROUPS) -> DataFrame:
    """Buys of ``ind`` (see ``indicators.complete``): a security and date each, with mode, strength, risk, gates, terms and reasons.

    Only the first mode that holds is tried: a bar that misses its gates gives no signal, even if a later mode would pass. A
    turn of the stochastic from below adds 2 to the strength of any mode, the passed gates 1.
    """
    spark, groups = ind.sparkSession, {**{m.group: () for m in modes if m.group}, "bottom": (), **groups}
    found = with_context(ind, groups).where("_nth >= 2 AND _seen").withColumn("_mode", first_mode(modes)).where("_mode IS NOT NULL")
    table = spark.createDataFrame(
        [(k, m.name, m.strength, *map(float, (*m.matrix, *m.expected)), m.horizon, m.held, m.trail, m.gain, m.tier, m.most_risk, m.actionable, m.name not in UNCONFIRMED) for k, m in enumerate(modes)],
        "_mode int, mode string, _base int, _ms double, _mf double, _es double, _ef double, holding_horizon int, min_holding_bars int, trailing_stop_pct double, trailing_activation_gain double, tier string, _most int, actionable boolean, _sure boolean",
    )  # a row for each mode
    rows = found.join(F.broadcast(table), "_mode").where("matrix_score >= greatest(matrix_gate + _ms, _mf) AND expected_3m_score >= greatest(expected_gate + _es, _ef)")
    rows = rows.withColumns({"_bonus": _by_mode(modes, BONUS, _labels), "_more": _by_mode(modes, RISKIER, lambda r: F.size(_labels(r)))})
    reasons = F.concat(c("_bonus"), F.when(c("_turn"), F.array(F.lit("stochastic turn from below"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("scores passed")))
    risk = F.expr("CASE WHEN volatility_10 > _calm * 1.2 THEN 1 ELSE 0 END + CASE WHEN atr14 > _wide THEN 2 ELSE 0 END") + c("_more")
    rows = rows.withColumns({
        "strength": (c("_base") + F.size("_bonus") + F.when(c("_turn"), 2).otherwise(0) + 1).cast("int"), "risk_score": risk.cast("int"), "reasons": reasons,
        "stop_loss_price": F.coalesce(c("close") - 2 * c("atr14"), c("close") * 0.92),
    })
    rows = rows.where((c("strength") >= LEAST_STRENGTH) & (c("risk_score") <= c("_most")) & (c("_sure") | c("_turn") | (F.size("_bonus") > 0)))
    return rows.select(
        KEY, TIME, "close", "strength", "risk_score", "mode", "tier", "actionable", "matrix_gate", "expected_gate", "stop_loss_price", "holding_horizon", "trailing_stop_pct", "trailing_activation_gain", "min_holding_bars", "reasons",
        *[n for n in CONTEXT if n in rows.columns],
    )


def group_modes(group: str, code: str) -> tuple[tuple[Mode, ...], dict[str, tuple[str, ...]]]:
    """The modes that only a group has, and the groups with ``code`` in it: arguments of ``mode_buys``."""
    return tuple(m for m in MODES if m.group == group), {group: (code,)}
