"""Strategies, layers and reports against plain Python on small panels."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelweave.operators import indicators as ti, layers as ly, portfolio as pf, reports as rp, scorecards as wt, scoring as sc, strategies as st
from panelweave.sources import store
from tests.test_operators import BAR

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    """Securities that rise, fall hard with bursts of volume, and go sideways; their indicators in order."""
    rng, rows = random.Random(11), []
    for code in "abcdef":
        price = 30.0
        for i in range(260):
            drift = (1.004, 0.985, 1.0, 1.008)[(i // 40 + ord(code)) % 4]
            o = price * rng.uniform(0.985, 1.012)
            price = max(price * drift * rng.uniform(0.97, 1.032), 0.5)
            rows.append((code, DAY + dt.timedelta(days=i), o, max(o, price) * rng.uniform(1, 1.02), min(o, price) * rng.uniform(0.97, 1), price, rng.uniform(5e5, 1e6) * rng.choice([0.6, 1, 1, 1, 3, 4])))
    ind = ti.complete(spark.createDataFrame(rows, BAR)).cache()
    by = {}
    for r in sorted(ind.collect(), key=lambda r: (r["stock_code"], r["trade_date"])):
        by.setdefault(r["stock_code"], []).append(r)
    return ind, by


def ge(x, y):
    return x is not None and y is not None and x >= y


def le(x, y):
    return x is not None and y is not None and x <= y


def found(df, *columns):
    return {(r["stock_code"], r["trade_date"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_divergences_and_cost_lines(panel):
    seen = 0
    for rows in panel[1].values():
        for i, r in enumerate(rows):
            past, want = [x for x in rows[max(0, i - 20) : i] if x["low"] <= r["low"] * 1.03], False
            if i >= 20 and past and r["macd"] is not None:
                low = min(past, key=lambda x: x["low"])
                want = low["macd"] is not None and r["low"] <= low["low"] * 1.01 and r["macd"] > low["macd"] + 0.01 and le(r["stoch_k"], 35)
            assert r["divergence"] == want
            seen += want
            stack = None not in (r["ema5"], r["ema13"], r["ema34"]) and r["ema5"] > r["ema13"] > r["ema34"]
            assert r["cyc_stack"] == stack
            if r["ema34"] is not None:
                assert r["cyc_spread_34"] == pytest.approx((r["ema5"] - r["ema34"]) / r["ema34"])
    assert seen


def test_impulse_buys(panel):
    want = {}
    for code, rows in panel[1].items():
        for p, r in zip(rows, rows[1:]):
            if not r["cyc_stack"] or (r["ma25"] is not None and r["ma60"] is not None and r["ma25"] <= r["ma60"]):
                continue
            up = (p["ema5"] is not None and r["ema5"] > p["ema5"]) + (p["ema13"] is not None and r["ema13"] > p["ema13"]) + ge(r["ema34"], p["ema34"])
            if up >= 2 and r["close"] >= r["ema5"] * 0.995:
                want[code, r["trade_date"]] = (8 if up == 3 and r["close"] >= r["ema5"] else 7, round(r["close"] - 2 * r["atr14"], 6))
    got = found(st.impulse_buys(panel[0]).withColumn("stop", F.round("stop_loss_price", 6)), "strength", "stop")
    assert got == want and {x[0] for x in want.values()} == {7, 8}


def test_pullback_buys(panel):
    want = {}
    for code, rows in panel[1].items():
        for pp, p, r in zip(rows, rows[1:], rows[2:]):
            if None in (r["ma25"], r["ma60"], r["ma25_slope"], r["stoch_k"], r["stoch_d"]) or r["ma25"] <= r["ma60"] or r["ma25_slope"] <= 0 or r["close"] < r["ma25"] * 0.95:
                continue
            if min(x for x in (r["stoch_k"], r["stoch_d"], p["stoch_k"], p["stoch_d"], pp["stoch_k"]) if x is not None) > 30:
                continue
            crossed = (le(p["stoch_k"], p["stoch_d"]) and r["stoch_k"] > r["stoch_d"]) or (le(pp["stoch_k"], pp["stoch_d"]) and p["stoch_k"] > p["stoch_d"]) or (p["stoch_k"] is not None and r["stoch_k"] > p["stoch_k"] and r["stoch_k"] >= r["stoch_d"])
            turned = r["divergence"] or p["divergence"]
            if crossed and (turned or le(r["distance_ma25"], 0.03)):
                want[code, r["trade_date"]] = (7 if turned else 6,)
    assert found(st.pullback_buys(panel[0]), "strength") == want and want


def test_bottom_volume_buys(panel):
    want = {}
    for code, rows in panel[1].items():
        for i in range(1, len(rows)):
            r, p = rows[i], rows[i - 1]
            if any(r[n] is None for n in st.NEEDED) or r["close"] <= r["open"] or r["high"] <= r["low"]:
                continue
            low20, low60 = min(x["low"] for x in rows[max(0, i - 20) : i]), min(x["low"] for x in rows[max(0, i - 60) : i])
            place, v, d = (r["close"] - r["low"]) / (r["high"] - r["low"]), r["volume_ratio_10"], r["distance_ma25"]
            zone = r["low"] <= low20 * 1.03 or r["low"] <= low60 * 1.06 or r["range_position_20"] <= 0.25 or r["bb_position"] <= 0.2 or d <= -0.1
            loud = v >= 1.8 and (r["volume_spike"] >= 2 or v >= 2.3 or r["volume"] >= p["volume"] * 1.5)
            sold = r["rsi"] <= 36 or le(r["stoch_k"], 12) or le(r["return_20"], -0.12)
            if not (zone and loud and sold and place >= 0.62 and r["macd_gap"] > -0.9 and r["distance_high_20"] <= -0.1 and d <= -0.08):
                continue
            s, k = 6, 2
            s += 2 if r["low"] <= low20 * 1.01 else 1 if r["low"] <= low60 * 1.03 else 0
            s += 2 if v >= 3 else 1 if v >= 2 else 0
            s += (place >= 0.7) + ge(r["body_ratio"], 0.55) + (r["rsi"] <= 32) + (d <= -0.18)
            k += r["rsi"] >= 38
            if r["close"] < p["close"]:
                k += 1
            elif r["close"] >= p["close"] * 0.995:
                s += 1
            k += (d > -0.08) + (r["ma25_slope"] is not None and r["ma25_slope"] < 0) + le(r["return_60"], -0.5) + ge(r["upper_shadow"], 0.38)
            want[code, r["trade_date"]] = (s, k, "strong" if k <= 3 else "medium" if k <= 5 else "weak", k <= 5, round(r["low"] * 0.97, 6))
    got = found(st.bottom_volume_buys(panel[0]).withColumn("stop", F.round("stop_loss_price", 6)), "strength", "risk_score", "tier", "actionable", "stop")
    assert got == want and want


def test_range_band_buys_keep_their_gates(panel):
    rows = st.range_band_buys(panel[0]).collect()
    at = {(c, r["trade_date"]): (i, own) for c, own in panel[1].items() for i, r in enumerate(own)}
    assert {r["tier"] for r in rows} >= {"weak"} and len(rows) > 10
    for b in rows:
        i, own = at[b["stock_code"], b["trade_date"]]
        recent = [x for r in own[max(0, i - 4) : i + 1] for x in (r["stoch_k"], r["stoch_d"]) if x is not None]
        assert i >= 3 and min(recent) <= 40 and b["actionable"] == (b["tier"] != "weak") and b["risk_score"] >= 0 and b["strength"] >= 6
        if own[i]["distance_ma25"] > 0.075:
            assert not b["actionable"]


def test_range_band_buys_row_by_row(panel):
    """Strength, risk, tier and action of every bar, from the bars and indicators alone."""
    want = {}
    for code, rows in panel[1].items():
        for i in range(3, len(rows)):
            r, p = rows[i], rows[i - 1]
            k, d, k1, d1, v, d25 = r["stoch_k"], r["stoch_d"], p["stoch_k"], p["stoch_d"], r["volume_ratio_10"], r["distance_ma25"]
            if None in (k, d, k1, d1, d25):
                continue
            last = rows[max(0, i - 4) : i + 1]
            low = lambda own, n: min((x[n] for x in own if x[n] is not None), default=None)
            mean = lambda own: sum(x["volume"] for x in own) / len(own) if own else None
            half = low(rows[max(0, i - 120) : max(0, i - 14)], "low")
            up = (r["close"] > r["open"] or (r["intraday_return"] or 0) > 0) and r["close"] >= p["close"]
            before = mean(rows[max(0, i - 40) : max(0, i - 5)])
            dry = r["volume"] <= p["volume"] * 0.9 or (before is not None and mean(last) <= before * 0.92) or le(v, 0.95)
            base = half is not None and low(rows[max(0, i - 14) : i + 1], "low") >= half * 0.985 and up and (dry or (ge(v, 0.85) and le(v, 1.25)))
            loud = half is not None and r["low"] <= half * 1.002 and up and ge(v, 2.0)
            reclaims = up and d25 >= -0.03 and le(p["distance_ma25"], -0.06) and ge(v, 1.2)
            special, crosses = base or loud or reclaims, k1 <= d1 and k > d
            rising = None not in (r["ma25"], r["ma60"], r["ma25_slope"]) and r["ma25"] > r["ma60"] and r["ma25_slope"] > 0 and r["close"] >= r["ma25"] * 0.97
            turns = 15 <= k <= 58 and (crosses or (k > k1 and k >= d))
            anyway = special and ((0 <= k <= 62 and k >= k1) or (loud and k <= 20) or (reclaims and k >= d))
            if not (rising or special) or min(low(last, "stoch_k"), low(last, "stoch_d")) > 40 or not (turns or anyway):
                continue
            lt = lambda x, y: x is not None and x < y
            gt = lambda x, y: x is not None and x > y
            pulled, plain = le(low(last, "distance_ma25"), 0.025) or le(low(last, "bb_position"), 0.5), not special
            against = [
                (not pulled, False), (plain and lt(low(last, "distance_ma25"), -0.065), False), (gt(d25, 0.075), False), (plain and lt(r["range_long_composite"], 45), lt(r["range_long_composite"], 55)),
                (plain and lt(r["range_reversion"], 45), lt(r["range_reversion"], 55)), (plain and gt(r["range_position_20"], 0.72), gt(r["range_position_20"], 0.6)), (plain and gt(r["bb_position"], 0.72), gt(r["bb_position"], 0.58)),
                (plain and lt(r["rsi"], 45), lt(r["rsi"], 50) or gt(r["rsi"], 67)), (plain and lt(r["distance_high_20"], -0.15), lt(r["distance_high_20"], -0.08)),
                (lt(v, 0.82) and not ((base and dry) or loud or reclaims), (lt(v, 0.95) and not dry) or (gt(v, 1.75) and not loud)),
            ]
            risk = 2 + sum(2 if strong else int(soft) for strong, soft in against)
            risk += 1 if lt(r["volatility_compression"], 40) else -1 if ge(r["volatility_compression"], 65) else 0
            risk += lt(r["vwap_stretch"], 40) + lt(r["range_stability"], 40) + (r["close"] < p["close"]) + (r["ma10"] is not None and r["close"] < r["ma10"] * 0.995)
            risk = max(risk + (p["ma5_10_gap"] is not None and lt(r["ma5_10_gap"], p["ma5_10_gap"])), 0)
            strength = 5 + 4 * loud + 3 * reclaims + 3 * base + (2 if crosses else 1) + (2 if 15 <= k <= 35 else 1 if 35 < k <= 45 else 0) + (k - d >= 3)
            strength += sum(ge(r[n], 60) for n in ("range_reversion", "volatility_compression", "vwap_stretch", "range_stability"))
            yes = not any(strong for strong, _ in against) and risk <= 4
            want[code, r["trade_date"]] = (strength, risk, "strong" if yes and risk <= 2 else "medium" if yes else "weak", yes)
    got = found(st.range_band_buys(panel[0]), "strength", "risk_score", "tier", "actionable")
    assert got == want and len(want) > 50


def test_matrix_and_blend(panel):
    """The matrix score and the expected score from the indicators that they are made of."""
    seen = 0
    for rows in panel[1].values():
        history = {n: [r[n] for r in rows] for n in ti.MATRIX}

        def zed(values, i):
            w = [x for x in values[max(0, i - 59) : i + 1] if x is not None]
            if len(w) < 20 or values[i] is None:
                return None
            m = sum(w) / len(w)
            spread = (sum((x - m) ** 2 for x in w) / (len(w) - 1)) ** 0.5
            return (values[i] - m) / spread if spread > 1e-12 else None

        raws = []
        for i, r in enumerate(rows):
            z = {n: zed(history[n], i) for n in ti.MATRIX}
            have = [z[n] * w for n, w in ti.MATRIX.items() if z[n] is not None]
            raws.append(sum(have) if len(have) >= 10 else None)
            assert r["matrix_raw"] == (None if raws[-1] is None else pytest.approx(raws[-1], rel=1e-6, abs=1e-6))
            m = zed(raws, i)
            score = None if m is None else min(max(50 + 12 * m, 0), 100)
            assert r["matrix_score"] == (None if score is None else pytest.approx(score, rel=1e-6, abs=1e-5))
            if score is None or r["trend_regime"] is None:
                assert r["expected_3m_score"] is None
                continue
            part = lambda n, scale, w: (50 if z[n] is None else 50 + max(-2, min(2, z[n])) * scale) * w  # noqa: B023, E731
            x = score * 0.2 + part("return_20", 12, 0.16) + part("return_60", 12, 0.16) + part("ma20_slope", 12, 0.14) + part("ma60_slope", 10, 0.12) + part("distance_high_20", 10, 0.10) + part("volume_trend", 8, 0.06) + r["trend_regime"] * 0.06
            between = lambda n, a, b: r[n] is not None and a <= r[n] <= b  # noqa: B023, E731
            more = lambda n, a: r[n] is not None and r[n] > a  # noqa: B023, E731
            least = lambda n, a: r[n] is not None and r[n] >= a  # noqa: B023, E731
            over25 = r["ma25"] is not None and r["close"] > r["ma25"]
            x += 6 * (between("distance_ma20", -0.05, 0.02) and between("rsi", 42, 60) and r["close"] >= r["ma20"] * 0.97)
            x += 10 * (over25 and between("distance_ma25", 0, 0.08) and least("volume_spike", 2) and more("return_20", -0.02) and more("ma25_slope", -0.005) and r["ma10"] >= r["ma25"] * 0.995 and least("distance_high_20", -0.08))
            x += 4 * (over25 and between("distance_ma25", 0, 0.10) and least("volume_spike", 1.8) and more("return_20", -0.05) and more("ma25_slope", -0.015) and r["ma10"] >= r["ma25"] * 0.985 and least("distance_high_20", -0.12))
            x += 8 * (least("distance_high_20", -0.03) and between("volume_ratio_10", 1.1, 2.4) and between("rsi", 52, 68)) + 8 * r["stoch_cross"]
            x -= 12 * (r["rsi"] is not None and r["rsi"] < 40 and r["distance_ma20"] < -0.03 and r["return_20"] < 0)
            x -= 8 * (more("rsi", 74) or more("distance_ma20", 0.12) or more("return_60", 0.45))
            assert r["expected_3m_score"] == pytest.approx(min(max(x, 0), 100), rel=1e-6, abs=1e-5)
            seen += 1
    assert seen > 500


def test_sells_take_the_stronger_of_a_date(panel):
    ind, by = panel
    bear = {k: v[0] for k, v in found(sc.high_volume_bearish_sells(ind), "strength").items()}
    for df, kind, strength, rule in (
        (st.overbought_sells(ind), "stochrsi_overbought", 5, lambda r: ge(r["stoch_k"], 80) and (r["stoch_d"] is None or r["stoch_d"] >= 70)),
        (st.upper_band_sells(ind), "upper_band_overbought", 6, lambda r: r["bb_upper"] is not None and r["close"] >= r["bb_upper"] * 0.99 and ge(r["stoch_k"], 80)),
    ):
        own = {(c, r["trade_date"]) for c, rows in by.items() for r in rows if rule(r)}
        want = {k: (strength, kind) if k in own and strength > bear.get(k, 0) else (bear[k], "high_volume_bearish") for k in own | set(bear)}
        assert found(df, "strength", "signal_type") == want and own


def test_zones(spark):
    rows = [("a", 1, 5, "x"), ("a", 4, 7, "z"), ("a", 9, 7, "z"), ("a", 20, 1, "x"), ("a", 22, 1, "z"), ("a", 27, 3, "z"), ("b", 2, 1, "z")]
    sig = spark.createDataFrame([(c, DAY + dt.timedelta(days=d), s, m) for c, d, s, m in rows], "stock_code string, trade_date date, strength int, mode string")
    day = lambda x: (x - DAY).days
    got = sorted((r["stock_code"], day(r["trade_date"]), day(r["zone_start"]), day(r["zone_end"]), r["zone_signals"]) for r in st.strongest_of_zone(sig).collect())
    assert got == [("a", 4, 1, 9, 3), ("a", 27, 20, 27, 3), ("b", 2, 2, 2, 1)]
    got = sorted((r["stock_code"], day(r["trade_date"]), r["mode"], r["zone_signals"]) for r in st.first_of_mode_zone(sig, ("z",), "zone").collect())
    assert got == [("a", 1, "x", 1), ("a", 4, "zone", 1), ("a", 9, "zone", 1), ("a", 20, "x", 1), ("a", 22, "zone", 1), ("a", 27, "zone", 1), ("b", 2, "zone", 1)]


def test_pruned_factors(spark):
    card = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7), ("d", 0.6), ("lone", 0.95), ("none", None)], "feature_name string, abs_coefficient double")
    corr = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.95), ("a", "c", 0.1), ("c", "d", 0.85), ("a", "d", None)], "feature_a string, feature_b string, correlation double")
    got = [r["feature_name"] for r in wt.pruned(card, corr).orderBy("place").collect()]
    assert got == ["a", "c", "lone", "none"]


def test_selection_prefers_active_signals(spark):
    kind = "stock_code string, current_signal_active boolean, current_signal_actionable boolean, current_signal_score double, expected_3m_score double, matrix_score double, regime_score double, signal_tier string, setup_type string, setup_score double, sideways_penalty double, low_price_candidate boolean, freshness double, backtest_return double"
    rows = [
        ("a", True, True, 50.0, 50.0, 50.0, 50.0, "strong", "neutral", 10.0, 0.0, True, 90.0, 1.0), ("b", False, False, 99.0, 99.0, 99.0, 99.0, "medium", "pre_breakout", 90.0, 0.0, True, 100.0, 1.0),
        ("c", True, True, 10.0, 10.0, 10.0, None, "weak", "bottom_rebound", 60.0, 1.0, True, 40.0, None), ("d", None, None, None, None, None, None, "weak", "sideways", None, None, None, None, 0.0),
    ]
    r = pf.rank_securities(spark.createDataFrame(rows, kind))
    got = {x["stock_code"]: (x["place"], x["ranking_score"]) for x in r.collect()}
    assert got["a"] == (1, pytest.approx(100 + 50 + 1.8 + 9 + 8)) and got["d"] == (4, pytest.approx(-16 - 22)) and got["c"][1] == pytest.approx(100 + 5 + 2 + 1.5 + 20 + 10.8 + 4 + 8 - 0.9)
    assert [x["stock_code"] for x in pf.selected(r, 2).collect()] == ["c"]  # the only active one with a wanted setup
    assert [x["stock_code"] for x in pf.selected(r.where("stock_code <> 'c'"), 2).collect()] == ["a"]
    assert [x["stock_code"] for x in pf.selected(r.where("stock_code IN ('b', 'd')"), 2).collect()] == ["b"]
    assert [x["stock_code"] for x in pf.watchlist(r, 5).collect()] == ["c"]
    money = {x["stock_code"]: x["capital"] for x in pf.allocate(r, 1000.0).collect()}
    assert set(money.values()) == {250.0} and sum(x["capital"] for x in pf.allocate(r, 1000.0, False).collect()) == pytest.approx(1000)
    assert [x["place"] for x in pf.rank_securities(spark.createDataFrame(rows, kind), 2).collect()] == [1, 2]
    assert [x["stock_code"] for x in pf.trading_table(spark.createDataFrame(rows, kind)).orderBy("place").collect()] == ["a", "b", "d"]


def test_planned_exits_and_minimum_commission(spark):
    bars = spark.createDataFrame([("a", DAY + dt.timedelta(days=i), 10.0 + i, 11.0, 9.0, 10.5 + i, 1.0) for i in range(6)], BAR)
    picks = spark.createDataFrame([("a", DAY, 1), ("a", DAY + dt.timedelta(days=1), 0), ("a", DAY + dt.timedelta(days=3), 60), ("a", DAY + dt.timedelta(days=5), 5), ("a", dt.date(2020, 1, 1), 5)], "stock_code string, trade_date date, holding_horizon int")
    got = {(r["signal_date"] - DAY).days: ((r["entry_date"] - DAY).days, r["entry_price"], (r["exit_date"] - DAY).days) for r in pf.planned_exits(bars, picks).collect()}
    assert got == {0: (1, 11.0, 1), 1: (2, 12.0, 2), 3: (4, 14.0, 5)}
    row = spark.range(1).select(sc.net_return(F.lit(0.1)).alias("a"), sc.net_return(F.lit(0.1), least=50.0, notional=10_000.0).alias("b")).first()
    out = 10_000 * 1.1 * 0.999 / 1.001
    assert row["a"] == pytest.approx(1.1 * 0.999 * 0.9997 / (1.001 * 1.0003) - 1) and row["b"] == pytest.approx((out - 50) / 10_050 - 1)


def test_layers_on_disk(spark, tmp_path):
    raw = spark.createDataFrame([("7", "2024-01-02", "buy", "3", "x", "1.5", "b1", 1), ("7", "2024-01-02", "buy", "4", "true", "2.5", "b1", 2), ("7", "soon", "buy", "4", "true", "2.5", "b1", 3), ("7", "2024-01-02", "buy", "9", None, None, "b2", 4)], "stock_code string, date string, signal_type string, signal_strength string, actionable string, score string, batch_id string, nth int")
    sig = ly.normalize_signals(raw, F.col("nth"), strategy="s")
    path = str(tmp_path / "signals")
    store.write(sig, path, by=("market", "year"))
    back = ly.read_layer(spark.read.parquet(path), "signals", {"batch_id": "b1", "strategy_name": ["s"]}, since="2024-01-01")
    got = [(r["stock_code"], r["signal_strength"], r["actionable"], r["score"], r["exchange"], r["source"]) for r in back.collect()]
    assert got == [("00007", 4.0, True, 2.5, "HKEX", "unknown")]
    trade = ly.normalize_trades(spark.createDataFrame([("7", "2024-01-02", "o1", "buy", "10", "100", "1000", None)], "stock_code string, date string, order_id string, trade_type string, price string, shares string, amount string, commission string"), F.lit(0)).first()
    assert (trade["price"], trade["shares"], trade["amount"], trade["commission"], trade["account_id"]) == (10.0, 100.0, 1000.0, 0.0, "default")
    acts = spark.createDataFrame([("1", "2024-01-02", None, "dividend", "0.5", 1), ("1", "2024-01-02", None, "cash", "0.7", 2), ("1", None, "2024-02-02", "split", None, 3), ("1", None, None, "split", None, 4), ("1", "2024-03-01", None, "party", "1", 5)], "stock_code string, date string, `发放日` string, action string, cash string, nth int")
    got = sorted((str(r["event_date"]), r["action_type"], r["cash_dividend"]) for r in ly.normalize_actions(acts, F.col("nth")).collect())
    assert got == [("2024-01-02", "cash_dividend", 0.7), ("2024-02-02", "stock_split", 0.0)]
    with pytest.raises(Exception, match="unknown name: party"):
        ly.normalize_actions(acts, F.col("nth"), strict=True).collect()
    snap = ly.snapshot(raw, "feed", ("2024-01-01", "2024-01-31"), F.lit("2024-02-01"))
    for _ in range(2):
        ly.write_snapshot(snap, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 8
    ly.export(sig, str(tmp_path / "csv"))
    ly.export(sig, str(tmp_path / "json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2 and spark.read.json(str(tmp_path / "json")).count() == 2


def test_reports_are_written(spark, panel, tmp_path):
    ind = panel[0]
    bars = ind.select("stock_code", "trade_date", "open", "high", "low", "close", "volume")
    from panelweave.operators import setups as sg

    rp.write_tables(sg.signal_report(sg.with_recipes(sg.setup_features(bars)), bars, last=50), str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {"events", "zones", "summary"}


def test_buy_point_scores(spark, panel):
    ind, by = panel
    sig = st.impulse_buys(ind).select("stock_code", "trade_date", F.col("strength").alias("signal_strength"))
    got = found(rp.buy_point_scores(sig, ind), "score")
    step = lambda x, *s: next((p for lim, p in s if x is not None and x < lim), 0)
    strength = {k: v[0] for k, v in found(sig, "signal_strength").items()}
    assert set(got) == set(strength) and got
    for (code, day), (score,) in got.items():
        rows = by[code]
        r = next(x for x in rows if x["trade_date"] == day)
        vol = [x["volatility"] for x in rows[-50:] if x["volatility"] is not None]
        gap = (r["close"] - r["bb_lower"]) / r["close"] if r["bb_lower"] is not None else None
        want = step(r["stoch_k"], (10, 20), (20, 15), (30, 10)) + step(r["rsi"], (25, 15), (35, 10), (45, 5)) + step(r["cyc"], (20, 10), (40, 5)) + step(r["volume_ratio_10"] if r["volume_ratio_10"] is not None else 1.0, (0.8, 10), (1.5, 5))
        want += 0 if gap is None else 15 if gap > 0.05 else 10 if gap > 0.02 else 5 if gap > 0 else 0
        if r["volatility"] is not None and r["atr14"] is not None:
            q = r["volatility"] / (sum(vol) / len(vol))
            want += 15 if q < 0.7 else 10 if q < 1 else 5
        assert score == want + min(strength[code, day] * 3, 15)


def test_strategies_deal_the_bars_once(spark):
    """What a strategy reads of other bars is there before the z-scores, so that wide rows are neither dealt nor sorted again."""
    from panelweave.plans.common import bars

    for buys, inputs in ((st.impulse_buys, st.impulse_inputs), (st.pullback_buys, st.pullback_inputs), (st.bottom_volume_buys, st.bottom_volume_inputs), (st.range_band_buys, st.range_band_inputs)):
        plan = buys(ti.complete(bars(spark, "/root/testdata/sf0.001"), inputs))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1, buys


def test_windows_joined_from_halves_are_exact():
    import numpy as np

    from panelweave.functions.rolling import _moments

    rng = np.random.default_rng(5)
    at = np.concatenate([np.arange(1, n + 1) for n in (3, 150, 61, 1, 90)])
    x = 1e6 + rng.random(len(at))
    x[rng.random(len(at)) < 0.2] = np.nan
    x[100:180] = 7.7
    for window in (1, 13, 60):
        n, mean, m2 = _moments(x, at, window)
        for i in range(len(x)):
            own = x[i + 1 - min(window, at[i]) : i + 1]
            own = own[~np.isnan(own)]
            assert n[i] == len(own)
            assert not len(own) or (mean[i] == pytest.approx(own.mean(), rel=1e-12) and m2[i] == pytest.approx(np.square(own - own.mean()).sum(), rel=1e-6, abs=1e-12))
