"""Technical indicators of daily bars.

Windows and recurrences (exponential and Wilder averages, which depend on their own last value) come from
ordered passes over the bars (``functions.passes``), which are dealt once for every indicator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions import scans
from panelweave.functions.columns import EPSILON, KEY, TIME, change, clamp, ratio, security
from panelweave.functions.passes import BAR, Bars, in_turn, made
from panelweave.functions.passes import ratio as over
from panelweave.functions.rolling import _zscores, zscores
from panelweave.functions.scans import ema, wilder

c = F.col
MOVING, VOLUME_MOVING = (5, 10, 20, 25, 30, 60), (5, 10, 20, 60)


def with_zscores(df: DataFrame, values: dict[str, Column], window: int = 60, least: int = 20, total: tuple[str, dict[str, float], int] | None = None) -> DataFrame:
    """Adds for each name how many standard deviations its value is above its trailing mean; and the ``total`` of ``rolling.zscores``."""
    own = {n: f"_x{n}" for n in values}
    out = in_turn(df.withColumns({own[n]: x.cast("double") for n, x in values.items()}))
    return zscores(out, own, window, least, BAR, total).drop(*own.values(), *([BAR] if BAR not in df.columns else []))


def score(z: Column, scale: float = 12.0, higher: bool = True) -> Column:
    """50 plus ``scale`` for each standard deviation of ``z`` (three at most), within 0..100; turned round if less is better."""
    out = clamp(50 + clamp(z, -3, 3) * scale, 0, 100)
    return out if higher else 100 - out


def _windows(b: Bars) -> dict[str, np.ndarray]:
    """All windowed indicators; a mean needs all values of its window, an extreme some."""
    cl, o, h, lo, v = (b[x] for x in ("close", "open", "high", "low", "volume"))
    full = lambda got, x, n, least: np.where(b.count(x, n) >= least, got, np.nan)
    top, bottom = lambda x, n, least: full(b.highest(x, n), x, n, least), lambda x, n, least: full(b.lowest(x, n), x, n, least)
    moved = lambda x, n: over(x, b.back(x, n)) - 1
    flag = lambda rule, n: np.where(rule, float(n), 0.0)
    out = {f"ma{n}": b.mean(cl, n, n) for n in MOVING} | {f"volume_ma{n}": b.mean(v, n, n) for n in VOLUME_MOVING}
    out |= {f"return_{n}": moved(cl, n) for n in (1, 3, 5, 20, 60)}
    out |= {"high_20": top(h, 20, 5), "high_60": top(h, 60, 20), "low_20": bottom(lo, 20, 5)}
    ma20, ma60, fast, slow, spread, span = out["ma20"], out["ma60"], out["volume_ma5"], out["volume_ma60"], b.deviation(cl, 20, 20, sample=False), np.where(h != lo, h - lo, np.nan)
    upper, lower, ratio10 = ma20 + 2 * spread, ma20 - 2 * spread, over(v, out["volume_ma10"])
    high10, low10, high14, low14, high50, low50 = top(h, 10, 5), bottom(lo, 10, 5), top(h, 14, 14), bottom(lo, 14, 14), top(cl, 50, 50), bottom(cl, 50, 50)
    paid, cyc = cl * v, 100 * over(cl - low50, high50 - low50)
    vwap = over(full(b.total(paid, 20), paid, 20, 5), full(b.total(v, 20), v, 20, 5))
    out |= {
        "bb_middle": ma20, "bb_upper": upper, "bb_lower": lower, "intraday_return": over(cl - o, o),
        "body_ratio": np.abs(cl - o) / span, "upper_shadow": (h - np.fmax(o, cl)) / span, "lower_shadow": (np.fmin(o, cl) - lo) / span,
        "volume_ratio_5": over(v, fast), "volume_ratio_10": ratio10, "volume_trend": over(fast, out["volume_ma20"]),
        "ma20_slope": moved(ma20, 5), "ma25_slope": moved(out["ma25"], 5), "ma60_slope": moved(ma60, 10), "volume_cross": (fast > slow) & (b.back(fast, 1) <= b.back(slow, 1)),
        "mean_reversion_5": -out["return_5"], **{f"distance_high_{n}": over(cl, out[f"high_{n}"]) - 1 for n in (20, 60)}, **{f"distance_ma{n}": over(cl, out[f"ma{n}"]) - 1 for n in (20, 25, 60)},
        "bb_position": over(cl - lower, np.where(spread > EPSILON, upper - lower, np.nan)), "bb_width": over(upper - lower, ma20),
        "range_position_20": over(cl - out["low_20"], out["high_20"] - out["low_20"]), "range_position_10": over(cl - low10, high10 - low10),
        "ma5_10_gap": over(out["ma5"], out["ma10"]) - 1, "ma5_20_gap": over(out["ma5"], ma20) - 1, "volume_spike": top(ratio10, 10, 3), "turnover_stability": b.deviation(ratio10, 10, 5),
        "williams": -100 * over(high14 - cl, high14 - low14), "cyc": cyc, "cyc_ma": b.mean(cyc, 10, 10), "price_vs_vwap": over(cl - vwap, vwap),
    }
    near = b.count(cl, 60, ahead=True) >= 20
    out |= {
        "pullback_quality": -np.abs(out["distance_ma20"]),
        "trend_regime": flag(ma20 >= ma60, 25) + flag(cl >= ma20, 15) + flag(out["ma20_slope"] > 0, 20) + flag(out["ma60_slope"] > 0, 15) + flag(out["return_20"] > 0, 15) + flag(out["return_60"] > -0.05, 10),
        **{f"forward_return_{n}": over(b.back(cl, -n), cl) - 1 for n in (20, 40, 60)},
        "forward_runup_60": np.where(near, over(b.highest(h, 60, ahead=True), cl) - 1, np.nan), "forward_drawdown_60": np.where(near, over(b.lowest(lo, 60, ahead=True), cl) - 1, np.nan),
    }
    return out


def windowed_indicators(bars: DataFrame, turn: bool = False, names: Iterable[str] | None = None) -> DataFrame:
    """Moving averages, bands, returns, extremes, candle and volume ratios, ranges, regime score, forward returns, in one pass.

    Recurrent columns of ``bars`` stay. ``turn`` keeps the mark that rows are in turn, for another pass over them. Only the ``names`` asked for come out, if given.
    """
    prices = ("open", "high", "low", "close", "volume")
    rows = in_turn(bars).select(KEY, TIME, *prices, *[n for n in (*RECURRENT, *OF_RECURRENT) if n in bars.columns], BAR)
    out = made(rows, prices, _windows, {n: WINDOWED[n] for n in names or WINDOWED}, back=140, ahead=60)
    return out if turn else out.drop(BAR)


#: What ``windowed_indicators`` adds.
WINDOWED = dict.fromkeys([
    *(f"ma{n}" for n in MOVING), *(f"volume_ma{n}" for n in VOLUME_MOVING), *(f"return_{n}" for n in (1, 3, 5, 20, 60)), "high_20", "high_60", "low_20", "bb_middle", "bb_upper", "bb_lower", "intraday_return",
    "body_ratio", "upper_shadow", "lower_shadow", "volume_ratio_5", "volume_ratio_10", "volume_trend", "ma20_slope", "ma25_slope", "ma60_slope", "volume_cross", "mean_reversion_5",
    "distance_high_20", "distance_high_60", "distance_ma20", "distance_ma25", "distance_ma60", "bb_position", "bb_width", "range_position_20", "range_position_10", "ma5_10_gap", "ma5_20_gap",
    "volume_spike", "turnover_stability", "williams", "cyc", "cyc_ma", "price_vs_vwap", "pullback_quality", "trend_regime", "forward_return_20", "forward_return_40", "forward_return_60", "forward_runup_60", "forward_drawdown_60",
], "double") | {"volume_cross": "boolean"}


RANGE_SCORES = ("range_reversion", "vwap_stretch", "range_stability", "band_compression", "volatility_compression", "range_long_composite")


def _range_inputs(whole: bool) -> dict[str, Column]:
    return {"_revert": c("mean_reversion_5"), "_stretch": F.abs("price_vs_vwap"), "_steady": c("turnover_stability"), "_width": c("bb_width"), **({"_atr": c("atr10")} if whole else {})}


def with_range_scores(ind: DataFrame) -> DataFrame:
    """Adds composite 0..100 scores: reversion in the range, VWAP stretch, stability, width of the band.

    Where ``ind`` has the recurrent ``atr10`` too, also the compression of band and ATR and the
    composite of all of them. The z-scores of ``_range_inputs`` are made here unless ``ind`` has them already.
    """
    whole = "atr10" in ind.columns
    out = ind if "_revert" in ind.columns else with_zscores(ind, _range_inputs(whole))
    out = out.withColumn("_reversion", (1 - c("range_position_20")) * 40 + (1 - clamp(c("bb_position"), 0, 1)) * 30 + score(c("_revert")) * 0.3)
    if whole:
        out = out.withColumn("_compression", score(c("_width"), 10.0, False) * 0.55 + score(c("_atr"), 10.0, False) * 0.45)
    out = out.withColumns({
        "range_reversion": clamp(c("_reversion"), 0, 100), "vwap_stretch": score(c("_stretch"), 14.0, False), "range_stability": score(c("_steady"), 10.0, False), "band_compression": score(c("_width"), 10.0, False),
        **({"volatility_compression": clamp(c("_compression"), 0, 100)} if whole else {}),
    }).drop("_revert", "_stretch", "_steady", "_width", "_atr", "_reversion", "_compression")
    if not whole:
        return out
    blend = c("range_reversion") * 0.40 + c("volatility_compression") * 0.24 + c("vwap_stretch") * 0.18 + c("range_stability") * 0.18
    return out.withColumn("range_long_composite", clamp(blend, 0, 100))


def range_scores(ind: DataFrame) -> DataFrame:
    """The scores of ``with_range_scores`` alone."""
    out = with_range_scores(ind)
    return out.select(KEY, TIME, *[n for n in RANGE_SCORES if n in out.columns])


RECURRENT = ("ema5", "ema12", "ema13", "ema26", "ema34", "macd", "macd_signal", "macd_hist", "rsi", "atr5", "atr10", "atr14", "atr20", "stoch_k", "stoch_d")
EMA, ATR, RSI, SIGNAL, STOCHASTIC, SMOOTH = (5, 12, 13, 26, 34), (5, 10, 14, 20), 14, 9, 14, 3


def _followed():
    """The recurrent columns bar by bar: a function that carries each average, and the last bars that the stochastic reads, from batch to batch."""
    state, seen = {}, {"nth": np.zeros(0, dtype="int64"), "rsi": np.zeros(0), "close": np.nan}
    back = STOCHASTIC + SMOOTH

    def follow(b: Bars) -> dict[str, np.ndarray]:
        there = ~(np.isnan(b["high"]) | np.isnan(b["low"]) | np.isnan(b["close"]))
        begun = np.cumsum(b.at == 1)  # which of the batch's securities; 0 goes on from the batch before
        own, out = begun[there], {n: np.full(len(b.at), np.nan) for n in RECURRENT}
        before = 0 if not len(seen["nth"]) else int(seen["nth"][-1])
        place = np.arange(len(own))
        fresh = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, dtype=bool)
        nth = place - np.maximum.accumulate(np.where(fresh, place, 0)) + 1 + np.where(own == 0, before, 0) if len(own) else np.zeros(0, dtype="int64")
        if len(own):
            high, low, close = (b[n][there] for n in ("high", "low", "close"))
            was = np.where(nth > 1, np.append(seen["close"], close[:-1]), np.nan)
            step = close - was
            spread = np.fmax(np.fmax(high - low, np.abs(high - was)), np.abs(low - was))
            average = lambda name, x, a: scans.followed(state, name, x, nth, a)
            got = {f"ema{n}": average(f"ema{n}", close, ema("close", n)) for n in EMA} | {f"atr{n}": average(f"atr{n}", spread, wilder("_range", n, 2)) for n in ATR}
            gain, loss = average("gain", np.fmax(step, 0.0), wilder("_up", RSI, 2)), average("loss", np.fmax(-step, 0.0), wilder("_down", RSI, 2))
            got["macd"], both = got["ema12"] - got["ema26"], gain + loss
            got["rsi"] = np.where(both > 0, 100 * gain / np.where(both > 0, both, 1.0), np.where(np.isnan(both), np.nan, 50.0))
            got["macd_signal"] = average("signal", got["macd"], ema("macd", SIGNAL, 26))
            got["macd_hist"] = got["macd"] - got["macd_signal"]
            near, rsi = np.append(seen["nth"], nth), np.append(seen["rsi"], got["rsi"])
            bars = Bars({}, near)
            least, most = bars.lowest(rsi, STOCHASTIC), bars.highest(rsi, STOCHASTIC)
            k = np.where((near >= RSI + STOCHASTIC) & ~np.isnan(rsi), np.where(most > least, 100 * (rsi - least) / np.where(most > least, most - least, 1.0), 0.0), np.nan)
            d = bars.mean(k, SMOOTH, SMOOTH)
            got["stoch_k"], got["stoch_d"] = k[len(k) - len(nth) :], d[len(d) - len(nth) :]
            for n in RECURRENT:
                out[n][there] = got[n]
            seen.update(nth=near[-back:], rsi=rsi[-back:], close=close[-1])
        if len(begun) and begun[-1] != (own[-1] if len(own) else 0):  # the last security has no full bar yet
            seen.update(nth=np.zeros(0, dtype="int64"), rsi=np.zeros(0), close=np.nan)
        return out

    return follow


def _read_back(look_back: int = 20):
    """What rules read of the recurrent columns of the bars before.

    ``divergence``: MACD holds while the price tests a low, the lowest of the ``look_back`` bars before, which is at most 3 % above this
    bar's and 1 % below; MACD is higher than then, and the stochastic is oversold. False before there are ``look_back`` bars.
    """

    def work(b: Bars) -> dict[str, np.ndarray]:
        low, macd, slow = b["low"], b["macd"], b["ema34"]
        least, then = np.full(len(low), np.inf), np.full(len(low), np.nan)
        for k in range(look_back, 0, -1):  # the first of equal lows counts
            x = b.back(low, k)
            lower = x < least
            least, then = np.where(lower, x, least), np.where(lower, b.back(macd, k), then)
        holds = (b.at > look_back) & (least <= low * 1.03) & (low <= least * 1.01) & (macd > then + 0.01) & (b["stoch_k"] <= 35)
        lags = {f"_{n}_{k}": b.back(b[n], k) for n in ("stoch_k", "stoch_d") for k in (1, 2)}
        return {n: b[n] for n in RECURRENT} | lags | {"cyc34_slope": over(slow, b.back(slow, 5)) - 1, "divergence": holds}

    return work


_READ_BACK = ("_stoch_k_1", "_stoch_k_2", "_stoch_d_1", "_stoch_d_2", "cyc34_slope", "divergence")


def with_recurrences(bars: DataFrame, read_back: bool = False) -> DataFrame:
    """``bars`` plus exponential averages, MACD(12, 26, 9), Wilder RSI(14) and ATR, stochastic RSI(14, 14, 3).

    Averages are NULL until they have seen their length of values and start at the mean of those.
    A flat RSI is 50, a flat stochastic 0. Bars without a high, low or close are passed over and have no values.
    One ordered pass carries each average on, whatever the length of a history. ``read_back`` adds what rules read of the
    bars before and keeps the mark that rows are in turn.
    """
    out = made(in_turn(bars), ("high", "low", "close"), _read_back(), dict.fromkeys((*RECURRENT, *_READ_BACK), "double") | {"divergence": "boolean"}, back=21, begin=_followed)
    return out if read_back else out.drop(*_READ_BACK, *([BAR] if BAR not in bars.columns else []))


def recurrences(bars: DataFrame) -> DataFrame:
    return with_recurrences(bars.select(KEY, TIME, "high", "low", "close")).select(KEY, TIME, *RECURRENT)


#: Weights of the matrix score.
MATRIX = {
    "return_3": 0.4, "return_5": 0.4, "return_20": 1.0, "return_60": 0.9, "volume_ratio_5": 0.4, "volume_ratio_10": 0.7, "volume_trend": 0.5,
    "body_ratio": 0.3, "upper_shadow": -0.5, "lower_shadow": 0.4, "ma5_10_gap": 0.6, "ma5_20_gap": 0.8, "distance_high_20": 0.9, "distance_high_60": 0.7,
    "distance_ma20": -0.4, "distance_ma60": 0.2, "ma20_slope": 0.9, "ma60_slope": 0.7, "bb_position": -0.2, "macd_hist": 0.6, "rsi": 0.2, "stoch_k": 0.1,
    "cyc": -0.2, "atr14": -0.5, "atr5": -0.6, "intraday_return": 0.2,
}


def stoch_cross() -> Column:
    """Stochastic RSI in its lower half, above its average since this bar or the one before; false where a value is missing. Reads what ``with_recurrences`` reads back."""
    k, d = ([c(n), c(f"_{n}_1"), c(f"_{n}_2")] for n in ("stoch_k", "stoch_d"))
    fresh = (k[1] <= d[1] + 3) | ((k[1] > d[1]) & (k[2] <= d[2] + 3))
    return F.coalesce(k[0].between(15, 55) & d[0].between(0, 55) & (k[0] > d[0]) & fresh, F.lit(False))


#: What is made of recurrent columns of a security's bars.
OF_RECURRENT = ("cyc_stack", "cyc_spread_34", "cyc_spread_13", "cyc34_slope", "stoch_cross", "divergence")


def cost_lines() -> dict[str, Column]:
    """Whether the cost lines of 5, 13 and 34 bars lie one above the other, the gaps between them, and the rise of the slowest."""
    fast, mid, slow = c("ema5"), c("ema13"), c("ema34")
    return {"cyc_stack": F.coalesce((fast > mid) & (mid > slow), F.lit(False)), "cyc_spread_34": ratio(fast - slow, slow), "cyc_spread_13": ratio(fast - mid, mid), "cyc34_slope": change(slow, 5)}


def cycle_stack(ind: DataFrame) -> DataFrame:
    """Adds the ``cost_lines``."""
    return ind.withColumns(cost_lines())


def unscored(bars: DataFrame) -> DataFrame:
    """The columns of ``complete`` that need no z-score."""
    rows = with_recurrences(bars.select(KEY, TIME, "open", "high", "low", "close", "volume"), read_back=True)
    lines = {n: x for n, x in cost_lines().items() if n != "cyc34_slope"}
    return with_volatility(windowed_indicators(rows.withColumns({**lines, "stoch_cross": stoch_cross()}), turn=True))


#: What bars bring, and what the matrix score, the expected score and the crossing of the stochastic read besides.
PRICES = ("open", "high", "low", "close", "volume")
SCORED = ("rsi", "stoch_k", "stoch_d", "_stoch_k_1", "_stoch_k_2", "_stoch_d_1", "_stoch_d_2", "ma10", "ma20", "ma25", "ma25_slope", "return_20", "return_60", "distance_ma20", "distance_ma25", "distance_high_20", "volume_spike", "volume_ratio_10", "trend_regime")
BLENDED = ("return_20", "return_60", "ma20_slope", "ma60_slope", "distance_high_20", "volume_trend")
#: What the range scores take z-scores of, by the names of these.
OF_RANGE = {"_revert": lambda b: b["mean_reversion_5"], "_stretch": lambda b: np.abs(b["price_vs_vwap"]), "_steady": lambda b: b["turnover_stability"], "_width": lambda b: b["bb_width"], "_atr": lambda b: b["atr10"]}


def at_once(bars: DataFrame, names: Iterable[str], more: dict[str, tuple[str, Callable[[Bars], np.ndarray]]] | None = None, scores: bool = False, ranges: bool = False, only: Callable[[Bars], np.ndarray] | None = None) -> DataFrame:
    """Prices and, in a single pass, the ``names`` of recurrent, read-back and windowed columns, and ``more`` (type and function by name) of bars around each.

    With ``scores`` the matrix score and its z-score, and the z-scores that the expected score blends; with ``ranges`` those of the range scores. Each bar goes to Python and
    back once, with no column that is not asked for. ``only`` says which bars come out (see ``passes.made``); their windows and scores still read all.
    """
    names, more, read = list(dict.fromkeys(names)), dict(more or {}), _read_back()

    def work(b: Bars) -> dict[str, np.ndarray]:
        b.fields = {**b.fields, **read(b)}
        b.fields |= _windows(b)
        z, out = lambda x: _zscores(x.astype(float), b.at, 60, 20), {}
        if scores:
            every = {n: z(b[n]) for n in MATRIX}
            parts = np.column_stack([every[n] * w for n, w in MATRIX.items()])
            there = ~np.isnan(parts)
            out["matrix_raw"] = np.where(there.sum(1) >= 10, np.where(there, parts, 0).sum(1), np.nan)
            out |= {"matrix_z": z(out["matrix_raw"])} | {f"_z_{n}": every[n] for n in BLENDED}
        if ranges:
            out |= {n: z(x(b)) for n, x in OF_RANGE.items()}
        return {n: b[n] for n in names} | {n: x(b) for n, (_, x) in more.items()} | out

    types = {n: "boolean" if n in ("divergence", "volume_cross") else "double" for n in names} | {n: kind for n, (kind, _) in more.items()}
    types |= dict.fromkeys([*(["matrix_raw", "matrix_z", *(f"_z_{n}" for n in BLENDED)] if scores else []), *(OF_RANGE if ranges else [])], "double")
    # windows reach back 140 bars, the z-scores of what they make and the z-score of the sum of these 59 each
    return made(in_turn(bars.select(KEY, TIME, *PRICES)), PRICES, work, types, back=140 + 2 * 59, ahead=60, begin=_followed, only=only)


def scored(bars: DataFrame, names: Iterable[str], more: dict[str, tuple[str, Callable[[Bars], np.ndarray]]] | None = None, only: Callable[[Bars], np.ndarray] | None = None) -> DataFrame:
    """``full`` with the scores and the columns ``names`` alone, ``more`` made of bars around each, and just the bars that ``only`` holds for."""
    return _with_blend(at_once(bars, (*names, *SCORED), more, scores=True, only=only)).drop(BAR)


def complete(bars: DataFrame, inputs: Callable[[DataFrame], DataFrame] = lambda ind: ind) -> DataFrame:
    """What rule strategies read: all indicators, the range scores, the cost lines and divergences, from one pass.

    ``inputs`` adds what a strategy reads of other bars (``strategies.*_inputs``) while rows are still dealt and in order;
    later they would have to be dealt again.
    """
    rows = at_once(bars, (*RECURRENT, *_READ_BACK, *WINDOWED), scores=True, ranges=True)
    lines = {n: x for n, x in cost_lines().items() if n != "cyc34_slope"}
    return with_range_scores(inputs(_with_blend(with_volatility(rows.withColumns(lines))))).drop("band_compression", BAR)


def with_volatility(ind: DataFrame) -> DataFrame:
    """Adds the volatilities, which are average true ranges of 20, 5 and 10 bars, the gap of MACD to its signal, and the quality of the trend."""
    return ind.withColumns({"volatility": c("atr20"), "volatility_5": c("atr5"), "volatility_10": c("atr10"), "macd_gap": c("macd_hist"), "trend_quality": c("distance_high_20")})


def full(bars: DataFrame) -> DataFrame:
    """All indicators: windowed, recurrent, and the scores made of both."""
    return _with_blend(at_once(bars, (*RECURRENT, *_READ_BACK, *WINDOWED), scores=True)).drop(BAR)


def _with_blend(z: DataFrame) -> DataFrame:
    """Adds the matrix score, the expected score and ``stoch_cross`` to what ``at_once`` makes with its scores."""
    z = z.withColumn("stoch_cross", stoch_cross()).drop("_stoch_k_1", "_stoch_k_2", "_stoch_d_1", "_stoch_d_2").withColumn("matrix_score", clamp(50 + c("matrix_z") * 12, 0, 100))
    part = lambda n, scale, w: F.coalesce(50 + clamp(c(f"_z_{n}"), -2, 2) * scale, F.lit(50.0)) * w
    # Shares of the blend, then what single conditions add or take.
    blend = (
        c("matrix_score") * 0.20 + part("return_20", 12, 0.16) + part("return_60", 12, 0.16) + part("ma20_slope", 12, 0.14) + part("ma60_slope", 10, 0.12)
        + part("distance_high_20", 10, 0.10) + part("volume_trend", 8, 0.06) + c("trend_regime") * 0.06
    )
    flag = lambda rule, n: F.when(F.expr(rule), float(n)).otherwise(0.0)
    extra = (
        flag("distance_ma20 BETWEEN -0.05 AND 0.02 AND rsi BETWEEN 42 AND 60 AND close >= ma20 * 0.97", 6)
        + flag("close > ma25 AND distance_ma25 BETWEEN 0 AND 0.08 AND volume_spike >= 2 AND return_20 > -0.02 AND ma25_slope > -0.005 AND ma10 >= ma25 * 0.995 AND distance_high_20 >= -0.08", 10)
        + flag("close > ma25 AND distance_ma25 BETWEEN 0 AND 0.10 AND volume_spike >= 1.8 AND return_20 > -0.05 AND ma25_slope > -0.015 AND ma10 >= ma25 * 0.985 AND distance_high_20 >= -0.12", 4)
        + flag("distance_high_20 >= -0.03 AND volume_ratio_10 BETWEEN 1.1 AND 2.4 AND rsi BETWEEN 52 AND 68", 8)
        + flag("stoch_cross", 8)
        - flag("rsi < 40 AND distance_ma20 < -0.03 AND return_20 < 0", 12)
        - flag("rsi > 74 OR distance_ma20 > 0.12 OR return_60 > 0.45", 8)
    )
    return z.withColumn("_blend", blend + extra).withColumn("expected_3m_score", clamp(c("_blend"), 0, 100)).drop("_blend", *[f"_z_{n}" for n in BLENDED])
