"""The ordered entry modes against a plain loop over rows that hit every one of them."""

import datetime as dt
import random
from math import isnan, nan
from types import SimpleNamespace

import pytest

from panelweave.operators import ordered_modes as om

DAY = dt.date(2024, 1, 1)
GROUPS = {"support": ("sup",), "bottom": ("bot",)}
#: Range of each indicator where a recipe says nothing.
WIDE = {
    "open": (97, 103), "close": (97, 103), "low": (90, 96), "ma5": (97, 103), "ma10": (97, 103), "ma20": (97, 103), "ma25": (97, 103), "ma60": (97, 103), "ma20_slope": (-0.05, 0.05), "ma25_slope": (-0.05, 0.05),
    "ma60_slope": (-0.05, 0.05), "distance_ma20": (-0.1, 0.1), "distance_ma25": (-0.1, 0.1), "volume_spike": (0.8, 1.5), "volume_ratio_10": (0.5, 2.5), "volume_trend": (0.8, 1.4), "rsi": (25, 75), "return_3": (-0.05, 0.05),
    "return_20": (-0.2, 0.2), "return_60": (-0.3, 0.3), "distance_high_20": (-0.2, 0), "distance_high_60": (-0.3, 0), "macd": (-1, 1), "macd_signal": (-1, 1), "macd_gap": (-1, 1), "upper_shadow": (0, 1), "intraday_return": (-0.04, 0.04),
    "stoch_k": (0, 100), "stoch_d": (0, 100), "matrix_score": (20, 60), "expected_3m_score": (20, 60), "ema5": (97, 103), "ema13": (97, 103), "ema34": (97, 103), "cyc_spread_34": (0, 0.2), "cyc_spread_13": (0, 0.1), "cyc34_slope": (-0.1, 0.1),
    "trend_regime": (0, 100), "cyc": (0, 100), "bb_lower": (90, 99), "volatility_10": (0.9, 1.1), "atr14": (0.9, 1.1),
}
FLAT = {"volume_spike": 1.0, "matrix_score": 90, "expected_3m_score": 90, "ma20": 100, "ma25": 100, "ma60": 100, "ma10": 100, "ma5": 100, "close": 102, "open": 101, "ma20_slope": 0, "ma25_slope": 0, "ma60_slope": 0, "stoch_k": 40, "stoch_d": 60}
LOUD = FLAT | {"distance_ma25": 0.05, "volume_spike": 2.2, "volume_ratio_10": 1.7, "rsi": 55, "return_20": 0.02, "return_60": 0, "distance_high_20": -0.02, "macd_gap": 0.3, "upper_shadow": 0.2, "intraday_return": 0.035}
#: For each mode what its bar and the bar before it are set to.
RECIPES = {
    "ma25_volume_breakout": (LOUD, {"close": 99, "ma25": 100}),
    "momentum_reversal_breakout": (LOUD | {"ma10": 90}, {"close": 99, "ma25": 100}),
    "ma25_support_reclaim": (FLAT | {"distance_ma25": 0.02, "volume_ratio_10": 1.2, "rsi": 55, "return_60": 0.1, "distance_high_20": -0.1, "macd_gap": -0.5, "intraday_return": 0.01}, {"close": 100, "ma25": 100}),
    "ma25_volume_breakout_alt": (FLAT | {"distance_ma25": 0.05, "ma25_slope": 0.025, "volume_ratio_10": 1.3, "rsi": 60, "return_60": 0.18, "distance_high_20": -0.07, "macd_gap": -0.3, "intraday_return": -0.01}, {}),
    "ma25_trend_follow": (FLAT | {"distance_ma25": 0.05, "ma25_slope": 0.04, "volume_ratio_10": 1.17, "rsi": 60, "return_60": 0.25, "distance_high_20": -0.05, "macd_gap": -0.3, "intraday_return": -0.01}, {}),
    "bottom_volume_rebound": (FLAT | {"close": 99, "open": 98, "rsi": 50, "distance_ma25": -0.05, "macd_gap": -1.2}, {"volume_ratio_10": 1.9, "distance_ma25": -0.05, "rsi": 40, "close": 97}),
    "bottom_volume_cluster": (FLAT | {"volume_spike": 2.6, "volume_ratio_10": 1.6, "rsi": 30, "distance_ma25": -0.2, "macd_gap": -2, "return_20": -0.25}, {}),
    "bottom_volume_rebound_next": (FLAT | {"close": 98, "open": 97, "low": 95, "volume_ratio_10": 1.2, "rsi": 33, "distance_ma25": -0.15, "macd_gap": -2}, {"volume_spike": 2.6, "rsi": 30, "distance_ma25": -0.2, "close": 97, "low": 94}),
    "stoch_double_bottom": (FLAT | {"stoch_k": 60, "stoch_d": 50, "volume_ratio_10": 1.1, "volume_spike": 1.4, "rsi": 48, "distance_ma25": -0.02, "return_60": 0.3, "distance_high_20": -0.1, "macd_gap": -0.5}, {"stoch_k": 50}),
    "stoch_mild_volume": (FLAT | {"stoch_k": 60, "stoch_d": 50, "volume_ratio_10": 1.2, "volume_spike": 1.7, "rsi": 55, "distance_ma25": 0.02, "distance_high_20": -0.03, "return_60": 0, "macd_gap": 0.3}, {"stoch_k": 50, "stoch_d": 45}),
    "cost_line_expansion": (FLAT | {"ema5": 103, "ema13": 101, "ema34": 99, "cyc_spread_34": 0.1, "cyc_spread_13": 0.03, "cyc34_slope": 0.02, "volume_ratio_10": 1.5, "volume_spike": 1.7, "macd_gap": 0.5, "distance_high_20": -0.01,
                                    "distance_ma25": 0.12, "upper_shadow": 0.1, "rsi": 63, "return_60": 0.2}, {"ema5": 102, "ema13": 101, "ema34": 99, "cyc_spread_34": 0.05}),
    "stoch_pullback": (FLAT | {"close": 101, "stoch_k": 40, "stoch_d": 30, "rsi": 50, "return_60": 0, "distance_high_20": -0.11, "macd_gap": -0.3, "volume_spike": 1.78, "distance_ma25": -0.01}, {"stoch_k": 20, "stoch_d": 25}),
    "trend_reversal": (FLAT | {"stoch_k": 70, "stoch_d": 60, "distance_ma20": 0.01, "distance_ma25": 0.01, "rsi": 55, "macd_gap": 0, "distance_high_20": -0.1, "return_20": 0, "return_60": 0}, {"macd_gap": -0.1}),
    "trend_acceleration": (FLAT | {"ma20_slope": 0.01, "distance_ma20": 0.05, "distance_high_20": -0.01, "rsi": 65, "return_20": 0.1, "return_60": 0.1, "volume_ratio_10": 1.5, "volume_spike": 1.3, "macd_gap": 0}, {"close": 101}),
    "early_reversal": (FLAT | {"rsi": 45, "macd_gap": -0.1, "distance_high_20": -0.1, "volume_ratio_10": 1, "upper_shadow": 0.2, "intraday_return": 0}, {"macd_gap": -0.5}),
    "ipo_rebound": (FLAT | {"ma60": None, "rsi": 60, "distance_high_20": -0.1, "volume_ratio_10": 1}, {"close": 100}),
    "launch_breakout": (FLAT | {"ma60": None, "rsi": 60, "distance_high_20": -0.05, "volume_ratio_10": 2.6, "return_3": 0.04, "intraday_return": 0.01}, {"close": 100, "ma10": 100, "ma20": 100}),
    "ma25_volume_breakout_watch": (LOUD | {"rsi": 67.5, "volume_ratio_10": 3, "return_20": -0.04}, {"close": 99, "ma25": 100}),
    "trend_pullback": (FLAT | {"distance_ma20": 0.01, "rsi": 55, "return_20": 0, "volume_trend": 1, "macd_gap": 0, "distance_high_20": -0.07, "volume_ratio_10": 1}, {"close": 101}),
    "base_breakout": (FLAT | {"distance_high_20": -0.01, "distance_high_60": -0.02, "volume_ratio_10": 1.5, "macd": 1, "macd_signal": 0, "rsi": 65, "distance_ma20": 0.1, "return_60": 0.1, "return_20": 0.1}, {"close": 101}),
    "oversold_reversal": (FLAT | {"ma20_slope": -0.05, "stoch_k": 15, "stoch_d": 12, "rsi": 33, "cyc": 10, "bb_lower": 95, "volume_ratio_10": 0.9, "distance_high_20": -0.15, "distance_ma20": -0.05}, {"stoch_k": 10, "stoch_d": 11}),
}


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(4), {}
    for k, (name, (now, before)) in enumerate(RECIPES.items()):
        for code in {"support": ["sup"], "bottom": ["bot"]}.get(next(m.group for m in om.MODES if m.name == name), [f"s{k}"]):
            own = out.setdefault(code, [])
            for i in range(140 if code in ("sup", "bot") else 70):
                own.append({n: rng.uniform(a, b) if rng.random() > 0.02 else None for n, (a, b) in WIDE.items()})
                if i > 1 and i % 4 == 0:
                    own[-2].update(before)
                    own[-1].update({n: v if v is None or rng.random() < 0.93 else v * rng.choice([0.9, 1.1]) for n, v in now.items()})
    return out


def quantile(values, share):
    v = sorted(values)
    at = (len(v) - 1) * share
    lo = int(at)
    return v[lo] if lo == at else v[lo] * (lo + 1 - at) + v[lo + 1] * (at - lo)


def gate(values, window, least, share, otherwise):
    v = [x for x in values[-window:] if not isnan(x)]
    return quantile(v, share) if len(v) >= least else otherwise


def choose(r, p, q, i, code, lows):
    """The first mode of the bar ``r`` (bars before: p, q), what its strength starts with and gains, and its extra risk."""
    has = lambda *x: not any(map(isnan, x))
    trend = r.ma20 >= r.ma60 * 0.98 and r.ma20_slope > -0.01 and r.ma60_slope > -0.02
    turn = 15 < r.stoch_k < 55 and r.stoch_k > r.stoch_d and has(p.stoch_k, p.stoch_d) and (p.stoch_k <= p.stoch_d + 3 or (p.stoch_k > p.stoch_d and q is not None and q.stoch_k <= q.stoch_d + 3))
    up, d20, d25, high, vol, spike, gap = r.close > p.close, r.distance_ma20, r.distance_ma25, r.distance_high_20, r.volume_ratio_10, r.volume_spike, r.macd_gap
    sup, bot, candle = code == "sup", code == "bot", (r.upper_shadow, r.intraday_return)
    crossed = lambda by: r.close > r.ma25 and p.close <= p.ma25 * by
    better, k, d = turn or gap > p.macd_gap or up, r.stoch_k, r.stoch_d
    ms, es = r.matrix_score, r.expected_3m_score

    def breakout(ma, slope, by, far, most, least, low, high_rsi, r20, r60, near, g, shadow, day):
        return (r.ma10 >= r.ma25 * ma and r.ma25_slope > slope and crossed(by) and 0 <= d25 <= far and spike >= most and vol >= least and low <= r.rsi <= high_rsi
                and r.return_20 > r20 and r.return_60 > r60 and high >= near and gap > g and candle[0] <= shadow and candle[1] > day)

    if not (has(r.rsi, r.ma20, r.ma60) or (bot and has(r.rsi, r.ma20, r.ma25, d25, spike)) or (isnan(r.ma60) and has(r.rsi, r.ma10, r.ma20, high, vol))):
        return None
    if breakout(0.992, -0.008, 1.015, 0.09, 1.9, 0.95, 47, 67, -0.03, -0.22, -0.10, -0.03, 0.5, -0.02):
        return "ma25_volume_breakout", 7, trend + (high > -0.08), (d25 > 0.08) + (candle[0] > 0.45), turn
    if crossed(1.01) and 0.03 <= d25 <= 0.09 and spike >= 2 and vol >= 1.5 and 50 <= r.rsi <= 60 and r.return_20 > 0 and r.return_60 > -0.35 and high >= -0.03 and gap > 0.15 and candle[0] <= 0.35 and candle[1] > 0.03:
        return "momentum_reversal_breakout", 7, 0, 0, turn
    if sup:
        if r.close >= r.ma25 and 0 <= d25 <= 0.07 and r.ma25_slope > -0.01 and 0.95 <= vol <= 1.4 and 48 <= r.rsi <= 62 and r.return_60 > 0.03 and high >= -0.12 and gap > -0.85 and candle[1] > 0 and has(p.ma25) and (p.close <= p.ma25 * 1.03 or p.volume_ratio_10 >= 1.8):
            return "ma25_support_reclaim", 6, 0, 0, turn
        if r.close > r.ma25 and 0.03 <= d25 <= 0.08 and r.ma25_slope > 0.02 and vol >= 1.2 and 55 <= r.rsi <= 63 and r.return_60 > 0.15 and high >= -0.08 and gap > -0.4:
            return "ma25_volume_breakout_alt", 6, 0, 0, turn
        if r.close > r.ma25 and 0.03 <= d25 <= 0.07 and r.ma25_slope > 0.03 and vol >= 1.15 and 58 <= r.rsi <= 63 and r.return_60 > 0.2 and high >= -0.06 and gap > -0.4:
            return "ma25_trend_follow", 6, 0, 0, turn
        if q is not None and p.volume_ratio_10 >= 1.8 and p.distance_ma25 <= -0.03 and p.rsi <= 45 and up and r.close >= r.open and 40 <= r.rsi <= 55 and d25 >= -0.1 and gap > -1.6 and ms >= 15 and es >= 34:
            return "bottom_volume_rebound", 6, 0, 0, turn
    if bot:
        if i >= 20 and has(r.ma20, r.ma25) and spike >= 2.5 and vol >= 1.55 and 27 <= r.rsi <= 33 and d25 <= -0.18 and gap > -3.2 and r.return_20 <= -0.22:
            return "bottom_volume_cluster", 6, 0, 0, turn
        if p.volume_spike >= 2.5 and p.rsi <= 31 and p.distance_ma25 <= -0.18 and r.close >= p.close * 1.003 and r.low >= p.low * 0.98 and r.close >= r.open and vol >= 1.15 and 29 <= r.rsi <= 37 and d25 <= -0.14 and gap > -3.2:
            return "bottom_volume_rebound_next", 6, 0, 0, turn
        if i >= 20 and k > d and 15 < k < 65 and has(p.stoch_d) and p.stoch_k <= k and vol >= 1 and spike >= 1.35 and 44 <= r.rsi <= 52 and -0.05 <= d25 <= 0.01 and r.return_60 > 0.2 and high >= -0.14 and gap > -0.95 and r.close > min(lows) * 1.03:
            return "stoch_double_bottom", 6, 0, 0, turn
        if k > d and 55 <= k <= 90 and p.stoch_k <= p.stoch_d + 8 and 1.05 <= vol <= 1.45 and spike >= 1.6 and 52 <= r.rsi <= 58 and 0 <= d25 <= 0.05 and high >= -0.04 and r.return_60 > -0.16 and gap > 0.25:
            return "stoch_mild_volume", 6, 0, 0, turn
        if (r.ema5 > r.ema13 > r.ema34 and p.ema5 > p.ema13 > p.ema34 and 0.07 <= r.cyc_spread_34 <= 0.16 and r.cyc_spread_34 > p.cyc_spread_34 and r.cyc_spread_13 >= 0.025 and r.cyc34_slope > 0 and 1.1 <= vol <= 1.8
                and spike >= 1.6 and gap > 0.45 and high >= -0.02 and 0.1 <= d25 <= 0.17 and candle[0] <= 0.12 and 60 <= r.rsi <= 66 and 0.18 < r.return_60 <= 0.28):
            return "cost_line_expansion", 7, 0, 0, turn
    if turn and r.ma20 * 0.97 <= r.close <= r.ma25 * 1.02 and r.ma20 >= r.ma60 * 0.95 and 43 <= r.rsi <= 58 and r.return_60 > -0.35 and high >= -0.12 and gap > -0.35 and spike >= 1.75 and ms >= 45 and es >= 58:
        return "stoch_pullback", 6, int(high > -0.1), 0, turn
    if (has(r.ma60, p.ma20, p.ma25, p.ma60) and r.close >= r.ma20 * 0.97 and r.close >= r.ma25 * 0.95 and -0.04 <= d20 <= 0.04 and -0.06 <= d25 <= 0.05 and 44 <= r.rsi <= 60 and k > d and 20 <= k <= 75 and gap > -0.1
            and high >= -0.18 and r.return_20 > -0.16 and r.return_60 > -0.3 and ms >= 42 and es >= 56 and better and (p.distance_ma20 <= -0.02 or p.return_20 <= -0.05 or p.macd_gap <= 0)):
        return "trend_reversal", 6, int(turn), 0, turn
    if (r.ma20 >= r.ma60 * 0.98 and r.ma20_slope > 0 and r.ma25_slope > -0.005 and r.ma60_slope > -0.01 and r.close >= r.ma20 and -0.01 <= d20 <= 0.1 and high >= -0.06 and 50 <= r.rsi <= 72 and r.return_20 > 0
            and r.return_60 > -0.1 and 0.95 <= vol <= 2.6 and spike >= 1.2 and gap > -0.05 and ms >= 50 and es >= 62 and r.close >= p.close):
        return "trend_acceleration", 6, int(high >= -0.03), 0, turn
    if 38 <= r.rsi <= 52 and gap > -0.2 and -0.2 <= high <= -0.04 and 0.45 <= vol <= 1.8 and candle[0] <= 0.35 and candle[1] >= -0.01 and ms >= 38 and es >= 52 and better:
        return "early_reversal", 6, int(r.trend_regime >= 35), 0, turn
    if isnan(r.ma60) and r.close >= r.ma10 * 0.96 and r.close >= r.ma20 * 0.94 and 42 <= r.rsi <= 68 and high >= -0.2 and 0.5 <= vol <= 2.4 and ms >= 45 and es >= 58 and (up or candle[1] > 0 or k > d):
        return "ipo_rebound", 6, 0, 0, turn
    if (isnan(r.ma60) and r.close >= r.ma10 and r.close >= r.ma20 * 0.98 and r.ma10 >= p.ma10 * 0.995 and r.ma20 >= p.ma20 * 0.995 and 52 <= r.rsi <= 78 and high >= -0.1 and 0.75 <= vol <= 2.8 and ms >= 46 and es >= 60
            and r.return_3 >= 0.03 and candle[1] >= 0 and (up or k >= d)):
        return "launch_breakout", 6, 0, 0, turn
    if breakout(0.985, -0.015, 1.02, 0.10, 1.8, 0.9, 45, 68, -0.05, -0.28, -0.12, -0.05, 0.6, -0.03):
        return "ma25_volume_breakout_watch", 5, trend + (high > -0.12), 0, turn
    if trend:
        if -0.06 <= d20 <= 0.02 and 40 <= r.rsi <= 58 and r.return_20 > -0.08 and r.volume_trend <= 1.15 and gap > -0.03 and r.close >= p.close and r.close >= r.ma5 * 0.99:
            return "trend_pullback", 6, (high > -0.08) + (vol >= 0.9), 0, turn
        stretched = bot and r.rsi >= 64 and k >= 95 and d25 >= 0.075 and high >= -0.025 and candle[0] >= 0.35
        if high >= -0.02 and r.distance_high_60 >= -0.03 and 1.2 <= vol <= 2.4 and r.macd > r.macd_signal and r.ma5 >= r.ma10 and 50 <= r.rsi <= 70 and 0 <= d20 <= 0.13 and r.return_60 <= 0.3 and r.close >= p.close and not stretched:
            return "base_breakout", 7, int(r.return_20 > 0.05), 0, turn
    elif k < 20 and 28 <= r.rsi <= 40 and r.cyc <= 18 and r.close >= r.bb_lower and 0.75 <= vol <= 1 and high <= -0.12 and d20 <= -0.04 and r.ma20 >= r.ma60 * 0.97:
        return "oversold_reversal", 4, (k > p.stoch_k) + (p.stoch_k <= p.stoch_d and k > d), int(r.return_20 < -0.15), turn
    return None


#: Gates of each mode (shift and floor of both scores), and terms, where they are not the usual ones.
GATES = {
    "momentum_reversal_breakout": (-10, 48, 0, 58), "ma25_support_reclaim": (-32, 34, -8, 54), "ma25_volume_breakout_alt": (-32, 34, -6, 52), "ma25_trend_follow": (-32, 38, -8, 54), "bottom_volume_rebound": (-30, 32, -6, 50),
    "bottom_volume_cluster": (-999, 30, -999, 18), "bottom_volume_rebound_next": (-999, 30, -999, 18), "stoch_double_bottom": (-12, 50, -2, 58), "stoch_mild_volume": (-8, 58, -2, 66), "cost_line_expansion": (-6, 60, -4, 60),
    "stoch_pullback": (-18, 45, -2, 56), "trend_reversal": (-10, 42, -4, 56), "trend_acceleration": (-8, 48, 0, 62), "early_reversal": (-12, 40, -6, 54), "ipo_rebound": (-999, 45, -999, 58), "launch_breakout": (-999, 46, -999, 60),
}
TERMS = {
    "trend_reversal": (80, 8, 0.90, 0.08), "trend_acceleration": (90, 10, 0.88, 0.10), "early_reversal": (75, 6, 0.91, 0.08), "ipo_rebound": (90, 12, 0.88, 0.12), "launch_breakout": (100, 15, 0.86, 0.15), "oversold_reversal": (40, 0, 0.92, 0.05),
}


def expected(rows):
    out, tried = {}, set()
    for code, own in rows.items():
        own = [SimpleNamespace(**{n: nan if v is None else v for n, v in r.items()}) for r in own]
        for i in range(1, len(own)):
            r = own[i]
            found = choose(r, own[i - 1], own[i - 2] if i > 1 else None, i, code, [x.low for x in own[max(0, i - 20) : i] if not isnan(x.low)])
            if found is None:
                continue
            mode, base, bonus, risk, turn = found
            tried.add(mode)
            mg, eg = (gate([x.__dict__[n] for x in own[: i + 1]], 40, 15, q, o) for n, q, o in (("matrix_score", 0.4, 50), ("expected_3m_score", 0.45, 55)))
            ms, mf, es, ef = GATES.get(mode, (0, 35, 0, 52))
            if not (r.matrix_score >= max(mg + ms, mf) and r.expected_3m_score >= max(eg + es, ef)):
                continue
            last = own[max(0, i - 19) : i + 1]
            calm, wide = ([x.__dict__[n] for x in last if not isnan(x.__dict__[n])] for n in ("volatility_10", "atr14"))
            risk += (len(calm) == 20 and r.volatility_10 > sum(calm) / 20 * 1.2) + 2 * (len(wide) == 20 and r.atr14 > quantile(wide, 0.9))
            strength = base + bonus + 2 * turn + 1
            sure = mode != "oversold_reversal" or turn or bonus > 0
            if strength >= 6 and sure and risk <= {"ma25_volume_breakout_watch": 5, "oversold_reversal": 2}.get(mode, 4):
                stop = r.close * 0.92 if isnan(r.atr14) else r.close - 2 * r.atr14
                watch = mode == "ma25_volume_breakout_watch"
                out[code, i] = (mode, strength, risk, "weak" if watch else "strong", not watch, *TERMS.get(mode, (60, 0, 0.92, 0.05)), round(mg, 6), round(stop, 6))
    return out, tried


def frame(spark, rows):
    kind = "stock_code string, trade_date date, " + ", ".join(f"{n} double" for n in WIDE)
    return spark.createDataFrame([(code, DAY + dt.timedelta(days=i), *(None if r[n] is None else float(r[n]) for n in WIDE)) for code, own in rows.items() for i, r in enumerate(own)], kind)


def signals(df):
    names = ("mode", "strength", "risk_score", "tier", "actionable", "holding_horizon", "min_holding_bars", "trailing_stop_pct", "trailing_activation_gain")
    return {(r["stock_code"], (r["trade_date"] - DAY).days): (*(r[n] for n in names), round(r["matrix_gate"], 6), round(r["stop_loss_price"], 6)) for r in df.collect()}


def test_every_mode_as_a_plain_loop_has_it(spark, rows):
    want, tried = expected(rows)
    assert tried == {m.name for m in om.MODES} == {v[0] for v in want.values()}
    got = signals(om.mode_buys(frame(spark, rows), groups=GROUPS))
    assert got == want


def test_modes_of_a_group_need_its_security(spark, rows):
    other = {{"sup": "x", "bot": "y"}.get(code, code): own for code, own in rows.items()}
    got = signals(om.mode_buys(frame(spark, other), groups=GROUPS))
    assert got == expected(other)[0] and not {m.name for m in om.MODES if m.group} & {v[0] for v in got.values()}
    modes, groups = om.group_modes("support", "x")
    only = signals(om.mode_buys(frame(spark, other), modes, groups))
    assert only and {v[0] for v in only.values()} <= {m.name for m in modes} and {k[0] for k in only} == {"x"}


def test_empty_and_short_histories(spark, rows):
    df = frame(spark, rows)
    assert om.mode_buys(df.where("false")).collect() == [] and om.mode_buys(df.where("trade_date = DATE '2024-01-01'")).collect() == []
