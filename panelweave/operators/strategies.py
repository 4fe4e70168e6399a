"""Rule strategies over ``indicators.complete``: what to buy and sell at each bar, as tables of conditions.

A rule is SQL over the indicators and a few trailing columns that its strategy adds; a missing value
fulfils no condition. Conditions of one ``CASE`` exclude each other, the first that holds counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import KEY, TIME
from panelweave.functions.passes import BAR, Bars, in_turn, made
from panelweave.operators.scoring import bearish_strength

c = F.col

#: Columns of a buy: its terms, and the bar's indicators that reports read.
BUY = ("close", "strength", "risk_score", "mode", "tier", "actionable", "stop_loss_price", "holding_horizon", "trailing_stop_pct", "trailing_activation_gain", "min_holding_bars")
CONTEXT = ("matrix_score", "expected_3m_score", "stoch_k", "stoch_d", "rsi", "volatility_10", "cyc", "atr14", "return_3", "volume_ratio_10", "trend_regime", "forward_return_20", "forward_return_40", "forward_return_60", "forward_drawdown_60")


def _cases(*chains: str) -> Column:
    """The sum of CASE chains, each written as ``condition: points; condition: points``."""
    total = F.lit(0)
    for chain in chains:
        arms = [arm.rsplit(":", 1) for arm in chain.split(";")]
        total = total + F.expr("CASE " + " ".join(f"WHEN {rule.strip()} THEN {points.strip()}" for rule, points in arms) + " ELSE 0 END")
    return total


def buy_signals(rows: DataFrame, mode: str, strength: Column, trailing: float, gain: float, bars_held: int, risk: Column | int = 2, tier: Column | None = None, actionable: Column | None = None, stop: Column | None = None) -> DataFrame:
    """Buys in the shape that trades and reports read; the stop is two ATR below the close, or 8 % where there is no ATR."""
    made = {
        "strength": strength.cast("int"), "risk_score": (risk if isinstance(risk, Column) else F.lit(risk)).cast("int"), "mode": F.lit(mode), "tier": tier if tier is not None else F.lit("strong"),
        "actionable": actionable if actionable is not None else F.lit(True), "stop_loss_price": F.coalesce(stop if stop is not None else c("close") - 2 * c("atr14"), c("close") * 0.92),
        "holding_horizon": F.lit(60), "trailing_stop_pct": F.lit(trailing), "trailing_activation_gain": F.lit(gain), "min_holding_bars": F.lit(bars_held),
    }
    return rows.withColumns(made).select(KEY, TIME, *BUY, *[n for n in CONTEXT if n in rows.columns])


def bullish(buffer: float) -> str:
    return f"(ma25 > ma60 AND ma25_slope > 0 AND close >= ma25 * {1 - buffer})"


def _inputs(ind: DataFrame, lags: dict[str, int], more: dict[str, Callable[[Bars], np.ndarray]] | None = None, fields: tuple[str, ...] = (), back: int = 0) -> DataFrame:
    """``ind`` with those columns that it lacks: fields of as many bars before as ``lags`` says, and ``more``, from one ordered pass."""
    kinds = dict(ind.dtypes)
    wanted = {f"{n}_{k}": (n, k) for n, most in lags.items() for k in range(1, most + 1) if f"{n}_{k}" not in kinds}
    more = {n: x for n, x in (more or {}).items() if n not in kinds}
    if not wanted and not more:
        return ind
    flags = {n for n in lags if kinds[n] == "boolean"}  # before the first bar a flag is off

    def work(b: Bars) -> dict[str, np.ndarray]:
        return {name: b.back(b[n], k) == 1 if n in flags else b.back(b[n], k) for name, (n, k) in wanted.items()} | {n: x(b) for n, x in more.items()}

    types = {name: "boolean" if n in flags else "double" for name, (n, _) in wanted.items()} | {n: "int" if n == "_nth" else "double" for n in more}
    out = made(in_turn(ind), dict.fromkeys((*lags, *fields)), work, types, back=max(back, *lags.values()))
    return out if BAR in ind.columns else out.drop(BAR)


def impulse_inputs(ind: DataFrame) -> DataFrame:
    return _inputs(ind, {"ema5": 1, "ema13": 1, "ema34": 1})


#: What ``impulse_buys`` reads of a bar and, by name, of the one before; and a condition without which there is no buy.
IMPULSE = ("ema5", "ema13", "ema34", "ma25", "ma60", "atr14", *(n for n in CONTEXT if n not in ("matrix_score", "expected_3m_score", "volatility_10")))
IMPULSE_BEFORE = {f"{n}_1": ("double", lambda b, n=n: b.back(b[n], 1)) for n in ("ema5", "ema13", "ema34")}


def impulse_stack(b: Bars) -> np.ndarray:
    return (b["ema5"] > b["ema13"]) & (b["ema13"] > b["ema34"])


def impulse_buys(ind: DataFrame) -> DataFrame:
    """Cost lines of 5, 13 and 34 bars one above the other, two of them rising at least, and the price not below the first."""
    rows = impulse_inputs(ind).withColumn("_rising", _cases("ema5 > ema5_1: 1", "ema13 > ema13_1: 1", "ema34 >= ema34_1: 1"))
    rows = rows.where("ema5 > ema13 AND ema13 > ema34 AND _rising >= 2 AND close >= ema5 * 0.995 AND NOT coalesce(ma25 <= ma60, false)")
    return buy_signals(rows, "bullish_impulse_cyc", _cases("_rising = 3 AND close >= ema5: 8; true: 7"), 0.94, 0.07, 5)


def pullback_inputs(ind: DataFrame) -> DataFrame:
    return _inputs(ind, {"stoch_k": 2, "stoch_d": 2, "divergence": 1, "close": 1})


def pullback_buys(ind: DataFrame) -> DataFrame:
    """In a rising trend the stochastic turns up from a low, with a divergence of MACD or near the average of 25 bars."""
    rows = pullback_inputs(ind).where("close_1 IS NOT NULL AND stoch_k IS NOT NULL AND stoch_d IS NOT NULL")
    crossed = "(stoch_k_1 <= stoch_d_1 AND stoch_k > stoch_d OR stoch_k_2 <= stoch_d_2 AND stoch_k_1 > stoch_d_1 OR stoch_k > stoch_k_1 AND stoch_k >= stoch_d)"
    rows = rows.withColumn("_diverges", F.expr("divergence OR coalesce(divergence_1, false)"))
    rows = rows.where(f"{bullish(0.05)} AND least(stoch_k, stoch_d, stoch_k_1, stoch_d_1, stoch_k_2) <= 30 AND {crossed} AND (_diverges OR distance_ma25 <= 0.03)")
    return buy_signals(rows, "trend_pullback_rebound", _cases("_diverges: 7; true: 6"), 0.95, 0.06, 3, risk=3)


# Where and how a bottom turns, what makes the signal stronger and what riskier.
BOTTOM = {
    "rises": "close > open AND high > low",
    "zone": "low <= low_before_20 * 1.03 OR low <= low_before_60 * 1.06 OR range_position_20 <= 0.25 OR bb_position <= 0.20 OR distance_ma25 <= -0.10",
    "volume": "volume_ratio_10 >= 1.8 AND (volume_spike >= 2.0 OR volume_ratio_10 >= 2.3 OR volume_1 > 0 AND volume >= volume_1 * 1.5)",
    "oversold": "rsi <= 36 OR stoch_k <= 12 OR return_20 <= -0.12",
    "repair": "place >= 0.62 AND macd_gap > -0.9 AND distance_high_20 <= -0.10 AND distance_ma25 <= -0.08",
}
BOTTOM_STRENGTH = (
    "low <= low_before_20 * 1.01: 2; low <= low_before_60 * 1.03: 1", "volume_ratio_10 >= 3.0: 2; volume_ratio_10 >= 2.0: 1", "place >= 0.70: 1", "body_ratio >= 0.55: 1", "rsi <= 32: 1",
    "close < close_1: 0; close >= close_1 * 0.995: 1", "distance_ma25 <= -0.18: 1",
)
BOTTOM_RISK = (
    "rsi <= 32: 0; rsi >= 38: 1", "close < close_1: 1; close >= close_1 * 0.995: 0; true: 1", "distance_ma25 <= -0.18: 0; distance_ma25 > -0.08: 1", "ma25_slope < 0: 1", "return_60 <= -0.50: 1", "upper_shadow >= 0.38: 1",
)
NEEDED = ("open", "high", "low", "close", "volume", "volume_ratio_10", "volume_spike", "rsi", "distance_ma25", "distance_high_20", "bb_position", "range_position_20", "macd_gap")


def bottom_volume_inputs(ind: DataFrame) -> DataFrame:
    before = {f"low_before_{n}": lambda b, n=n: b.back(b.lowest(b["low"], n), 1) for n in (20, 60)}
    return _inputs(ind, {"volume": 1, "close": 1}, before, ("low",), 61)


def bottom_volume_buys(ind: DataFrame) -> DataFrame:
    """A rising bar on heavy volume at a low of 20 or 60 bars after a fall, with first signs of repair."""
    rows = bottom_volume_inputs(ind).withColumn("place", F.expr("(close - low) / nullif(high - low, 0)"))
    rows = rows.where("low_before_20 IS NOT NULL AND " + " AND ".join(f"{n} IS NOT NULL" for n in NEEDED) + " AND " + " AND ".join(f"({rule})" for rule in BOTTOM.values()))
    rows = rows.withColumn("_risk", 2 + _cases(*BOTTOM_RISK))
    tier = F.when(c("_risk") <= 3, "strong").when(c("_risk") <= 5, "medium").otherwise("weak")
    return buy_signals(rows, "bottom_volume_reversal", 6 + _cases(*BOTTOM_STRENGTH), 0.94, 0.08, 3, c("_risk"), tier, c("_risk") <= 5, c("low") * 0.97)


# Reversals that pass without a trend, then what speaks against a buy (2 points and no action) and what is only a risk.
BAND_FLAGS = {
    "_up": "(close > open OR intraday_return > 0) AND close >= close_1",
    "_holds": "base_low >= half_year_low * 0.985",
    "_new_low": "low <= half_year_low * 1.002",
    "_dry": "volume <= volume_1 * 0.90 OR volume_mean_5 <= volume_mean_before * 0.92 OR volume_ratio_10 <= 0.95",
}
BAND_REVERSALS = {
    "_base": "_holds AND _up AND (_dry OR volume_ratio_10 BETWEEN 0.85 AND 1.25)",
    "_loud": "_new_low AND _up AND volume_ratio_10 >= 2.0",
    "_reclaims": "_up AND distance_ma25 >= -0.03 AND distance_ma25_1 <= -0.06 AND volume_ratio_10 >= 1.2",
}
BAND_AGAINST = (
    ("NOT _pulled", ()), ("least_distance < -0.065 AND NOT _special", ()), ("distance_ma25 > 0.075", ()), ("range_long_composite < 45 AND NOT _special", ("range_long_composite < 55",)),
    ("range_reversion < 45 AND NOT _special", ("range_reversion < 55",)), ("range_position_20 > 0.72 AND NOT _special", ("range_position_20 > 0.60",)), ("bb_position > 0.72 AND NOT _special", ("bb_position > 0.58",)),
    ("rsi < 45 AND NOT _special", ("rsi < 50", "rsi > 67")), ("distance_high_20 < -0.15 AND NOT _special", ("distance_high_20 < -0.08",)),
    ("volume_ratio_10 < 0.82 AND NOT (_base AND _dry OR _loud OR _reclaims)", ("volume_ratio_10 < 0.95 AND NOT _dry", "volume_ratio_10 > 1.75 AND NOT _loud")),
)
BAND_RISK = (
    "volatility_compression < 40: 1; volatility_compression >= 65: -1", "vwap_stretch < 40: 1", "range_stability < 40: 1", "close < close_1: 1", "close < ma10 * 0.995: 1", "ma5_10_gap < ma5_10_gap_1: 1",
)
BAND_STRENGTH = (
    "_loud: 4", "_reclaims: 3", "_base: 3", "_crosses: 2; true: 1", "stoch_k BETWEEN 15 AND 35: 2; stoch_k > 35 AND stoch_k <= 45: 1", "stoch_k - stoch_d >= 3: 1",
    "range_reversion >= 60: 1", "volatility_compression >= 60: 1", "vwap_stretch >= 60: 1", "range_stability >= 60: 1",
)


def _flags(rows: DataFrame, flags: dict[str, str]) -> DataFrame:
    return rows.withColumns({n: F.expr(f"coalesce({rule}, false)") for n, rule in flags.items()})


def range_band_inputs(ind: DataFrame) -> DataFrame:
    more = {
        "_nth": lambda b: b.at.astype("int32"), "base_low": lambda b: b.lowest(b["low"], 15), "half_year_low": lambda b: b.back(b.lowest(b["low"], 106), 15), "volume_mean_5": lambda b: b.mean(b["volume"], 5),
        "volume_mean_before": lambda b: b.back(b.mean(b["volume"], 35), 6), "least_stoch": lambda b: np.fmin(b.lowest(b["stoch_k"], 5), b.lowest(b["stoch_d"], 5)),
        "least_distance": lambda b: b.lowest(b["distance_ma25"], 5), "least_bb": lambda b: b.lowest(b["bb_position"], 5),
    }
    return _inputs(ind, dict.fromkeys(("close", "volume", "stoch_k", "stoch_d", "distance_ma25", "ma5_10_gap"), 1), more, ("low", "bb_position"), 121)


def range_band_buys(ind: DataFrame) -> DataFrame:
    """Low buys in a range: the stochastic turns up from a low in a rising trend, or at a base, a new low or a reclaimed average.

    Each sign against the buy adds risk, the strong ones also take away that it can be acted on.
    """
    rows = _flags(_flags(range_band_inputs(ind), BAND_FLAGS), BAND_REVERSALS)
    rows = _flags(rows, {"_special": "_base OR _loud OR _reclaims", "_crosses": "stoch_k_1 <= stoch_d_1 AND stoch_k > stoch_d", "_pulled": "least_distance <= 0.025 OR least_bb <= 0.50"})
    turns = "stoch_k BETWEEN 15 AND 58 AND (_crosses OR stoch_k > stoch_k_1 AND stoch_k >= stoch_d)"
    anyway = "_special AND (stoch_k BETWEEN 0 AND 62 AND stoch_k >= stoch_k_1 OR _loud AND stoch_k <= 20 OR _reclaims AND stoch_k >= stoch_d)"
    there = " AND ".join(f"{n} IS NOT NULL" for n in ("stoch_k", "stoch_d", "stoch_k_1", "stoch_d_1", "distance_ma25"))
    rows = rows.where(f"_nth >= 4 AND ({bullish(0.03)} OR _special) AND {there} AND least_stoch <= 40 AND ({turns} OR {anyway})")
    blocks = [f"{rule}: 1" for rule, _ in BAND_AGAINST]
    risk = [f"{rule}: 2" + "".join(f"; {x}: 1" for x in soft) for rule, soft in BAND_AGAINST]
    rows = rows.withColumns({"_risk": F.greatest(2 + _cases(*risk, *BAND_RISK), F.lit(0)), "_blocked": _cases(*blocks) > 0})
    yes = ~c("_blocked") & (c("_risk") <= 4)
    tier = F.when(yes & (c("_risk") <= 2), "strong").when(yes, "medium").otherwise("weak")
    return buy_signals(rows, "trend_range_band", 5 + _cases(*BAND_STRENGTH), 0.955, 0.07, 4, c("_risk"), tier, yes)


def _or_bearish(ind: DataFrame, rule: str, kind: str, strength: int) -> DataFrame:
    """Bars that fulfil ``rule`` or fall at a high on high volume, with the stronger of the two; the latter of equals."""
    rows = ind.select(KEY, TIME, "close", F.when(F.expr(rule), F.lit(strength)).alias("_own"), bearish_strength().alias("_bear")).where("_own IS NOT NULL OR _bear IS NOT NULL")
    own = c("_bear").isNull() | (c("_own") > c("_bear"))
    return rows.select(KEY, TIME, "close", F.greatest("_own", "_bear").alias("strength"), F.when(own, kind).otherwise("high_volume_bearish").alias("signal_type"))


def overbought_sells(ind: DataFrame) -> DataFrame:
    """The stochastic is overbought, or a falling bar at a high on high volume; the stronger of a date, that one of equals."""
    return _or_bearish(ind, "stoch_k >= 80 AND NOT coalesce(stoch_d < 70, false)", "stochrsi_overbought", 5)


def upper_band_sells(ind: DataFrame) -> DataFrame:
    """The price reaches the upper band while the stochastic is overbought, or a falling bar at a high on high volume."""
    return _or_bearish(ind, "close >= bb_upper * 0.99 AND stoch_k >= 80", "upper_band_overbought", 6)


def strongest_of_zone(signals: DataFrame, days: int = 5) -> DataFrame:
    """One row for signals of a security no more than ``days`` after one another: the strongest, the earliest of equals, with the zone's span."""
    w = Window.partitionBy(KEY).orderBy(TIME)
    fresh = F.coalesce(F.datediff(TIME, F.lag(TIME).over(w)) > days, F.lit(True))
    zoned = signals.withColumn("_new", fresh.cast("int")).withColumn("_zone", F.sum("_new").over(w))
    zone = Window.partitionBy(KEY, "_zone")
    span = {"zone_start": F.min(TIME).over(zone), "zone_end": F.max(TIME).over(zone), "zone_signals": F.count("*").over(zone), "_nth": F.row_number().over(zone.orderBy(F.desc_nulls_last("strength"), TIME))}
    return zoned.withColumns(span).where("_nth = 1").drop("_new", "_zone", "_nth")


def first_of_mode_zone(signals: DataFrame, modes: tuple[str, ...], name: str, days: int = 4) -> DataFrame:
    """Runs of signals in ``modes``, no more than ``days`` apart and with none of another mode between them, become their first, called ``name``.

    Signals of other modes stay as they are, each a zone of its own.
    """
    w = Window.partitionBy(KEY).orderBy(TIME, "mode")
    own = c("mode").isin(*modes)
    goes_on = own & F.coalesce(F.lag(own).over(w), F.lit(False)) & F.coalesce(F.datediff(TIME, F.lag(TIME).over(w)) <= days, F.lit(False))
    zoned = signals.withColumn("_new", (~goes_on).cast("int")).withColumn("_zone", F.sum("_new").over(w))
    zone = Window.partitionBy(KEY, "_zone")
    span = {"zone_start": F.min(TIME).over(zone), "zone_end": F.max(TIME).over(zone), "zone_signals": F.count("*").over(zone), "_nth": F.row_number().over(zone.orderBy(TIME, "mode"))}
    return zoned.withColumns(span).where("_nth = 1").withColumn("mode", F.when(own, name).otherwise(c("mode"))).drop("_new", "_zone", "_nth")
