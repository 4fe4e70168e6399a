"""Small literal panels with known answers, and properties that hold for any panel."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelweave.functions.columns import student_p
from panelweave.operators import cleaning as cl, factors, indicators as ti, scoring as sc, setups as sg, validation as va
from panelweave.sources import store

BAR = "stock_code string, trade_date date, open double, high double, low double, close double, volume double"


def linear(spark, n=90, code="00001"):
    """A rising security: close 100 to 140, volume 1.0 to 1.5 million."""
    day, rows = dt.date(2024, 1, 2), []
    for i in range(n):
        close = 100 + 40 * i / (n - 1)
        rows.append((code, day + dt.timedelta(days=i), close * 0.995, close * 1.015, close * 0.985, close, 1e6 + 5e5 * i / (n - 1)))
    return spark.createDataFrame(rows, BAR)


def test_factor_set_of_a_line(spark):
    out = factors.compute(linear(spark))
    assert len(out.columns) - 2 == 158 == len(factors.factor_names())
    last = out.orderBy(F.desc("trade_date")).first()
    assert last["KMID"] == pytest.approx((140 - 139.3) / 139.3, abs=1e-9)
    assert last["MA5"] == pytest.approx(sum(100 + 40 * i / 89 for i in range(85, 90)) / 5 / 140, abs=1e-9)
    assert last["RSQR60"] == pytest.approx(1, abs=1e-9) and last["RANK20"] == 1 and last["IMAX10"] == pytest.approx(1, abs=1e-9)
    panel = factors.lag_panel(linear(spark))
    assert len(panel.columns) - 2 == 360
    last = panel.orderBy(F.desc("trade_date")).first()
    assert last["CLOSE0"] == pytest.approx(1, abs=1e-9) and last["VOLUME0"] == pytest.approx(1, abs=1e-9)


def test_factors_do_not_look_ahead_and_ignore_partitioning(spark):
    bars = linear(spark, 80)
    names = ["MA5", "RSV10", "SUMP20", "CORR10", "QTLU20"]
    all_bars = {r["trade_date"]: r for r in factors.compute(bars.repartition(7), names).collect()}
    early = factors.compute(bars.where(F.col("trade_date") < "2024-02-20").coalesce(1), names).collect()
    assert early and all(all_bars[r["trade_date"]] == r for r in early)
    with pytest.raises(ValueError):
        factors.compute(bars, ["NOPE5"])


def monotone(spark):
    """Six securities whose score orders their daily returns."""
    bars, scores = [], []
    for k in range(1, 7):
        close = 10.0
        for i in range(8):
            day = dt.date(2024, 1, 1) + dt.timedelta(days=i)
            bars.append((f"{k:05d}", day, close, close, close, close, 1.0))
            scores.append((f"{k:05d}", day, "alpha", float(k)))
            close *= 1 + 0.01 * (k - 3.5)
    return spark.createDataFrame(bars, BAR), spark.createDataFrame(scores, "stock_code string, trade_date date, feature_name string, feature_value double")


def test_validation_of_a_monotone_panel(spark):
    bars, scores = monotone(spark)
    returns = va.forward_returns(bars, [1, 2])
    ic = va.ic_by_date(va.validation_frame(scores, returns), 3)
    summary = {r["horizon"]: r for r in va.summarize_ic(ic).collect()}
    assert summary[1]["ic_mean"] > 0.99 and summary[1]["rank_ic_mean"] == pytest.approx(1)
    members = va.quantile_membership(scores, 3, 3)
    spread = va.long_short(va.quantile_returns(members, returns, 3, 3)).collect()
    assert spread and all(r["top"] > r["bottom"] and r["spread"] > 0 for r in spread)
    assert {r["decay"] for r in va.decay(va.summarize_ic(ic), "rank_ic_mean").where("horizon = 1").collect()} == {1.0}
    assert {r["turnover"] for r in va.turnover_by_date(members).collect()} == {0.0}


@pytest.mark.parametrize("t,df,p", [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (2.576, 100_0, 0.01), (0.0, 7, 1.0), (3.182, 3, 0.05)])
def test_student_p(spark, t, df, p):
    got = spark.range(1).select(student_p(F.lit(t), F.lit(df)).alias("p")).first()["p"]
    assert got == pytest.approx(p, abs=3e-4)


def test_quality_counts(spark):
    d = dt.date
    clean = [("c", d(2024, 1, i), 1.0, 2.0, 0.5, 1.5, 5.0, i) for i in (1, 2)]
    dirty = [("x", d(2024, 1, 3), 1.0, 1.0, 1.0, 1.0, 0.0, 1), ("x", d(2024, 1, 2), -1.0, 2.0, -1.0, 1.0, -5.0, 2), ("x", d(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 0.0, 3), ("x", None, 1.0, 2.0, 0.5, 1.5, 0.0, 4)]
    got = {r["stock_code"]: r for r in cl.quality(spark.createDataFrame(clean + dirty, BAR + ", arrival int"), "arrival").collect()}
    assert got["c"]["passed"] and got["c"]["errors"] == 0
    x = got["x"]
    assert (x["missing_required_values"], x["duplicate_trade_date"], x["non_monotonic_trade_date"], x["non_positive_price"], x["negative_volume"], x["zero_volume_flat_bar"], x["zero_volume_nonflat_bar"]) == (1, 1, 1, 1, 1, 2, 2)  # a negative volume counts here too
    assert not x["passed"]


def test_calendar_and_resampling(spark):
    days = spark.createDataFrame([(dt.date(2026, 4, 24),), (dt.date(2026, 4, 25),)], "d date")
    got = days.select(cl.last_trading_day(F.col("d")), cl.next_trading_day(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(dt.date(2026, 4, 24), dt.date(2026, 4, 27))] * 2
    ts = lambda h, m, s=0: dt.datetime(2026, 4, 24, h, m, s)
    times = [(ts(9, 29),), (ts(9, 30),), (ts(12, 0),), (ts(12, 1),), (ts(16, 5),), (ts(16, 8),), (ts(16, 9),)]
    marks = spark.createDataFrame(times, "ts timestamp").select(cl.in_session(F.col("ts"), "HK"), cl.in_session(F.col("ts"), "HK", True)).collect()
    assert [r[0] for r in marks] == [False, True, True, False, False, False, False] and [r[1] for r in marks] == [False, True, True, False, True, True, False]
    ticks = [("a", ts(9, 30), 1, 10.0, 100.0)] + [("a", ts(9, 30 + i), i + 1, 10.0 + i, 100.0) for i in range(1, 6)]
    bars = {r["end_ts"]: r for r in cl.resample(spark.createDataFrame(ticks, "stock_code string, ts timestamp, seq int, price double, qty double"), (5,)).collect()}
    assert bars[ts(9, 30)]["close"] == 10.0 and (bars[ts(9, 35)]["open"], bars[ts(9, 35)]["close"], bars[ts(9, 35)]["volume"]) == (11.0, 15.0, 500.0)


def shaped(spark, path, volume):
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), p, p * 1.01, p * 0.99, p, v) for i, (p, v) in enumerate(zip(path, volume))]
    return sg.latest(sg.with_recipes(sg.setup_features(spark.createDataFrame(rows, BAR)))).first()


def ramp(*parts):
    return [a + (b - a) * i / max(1, n - 1) for a, b, n in parts for i in range(n)]


def test_setup_shapes(spark):
    got = shaped(spark, ramp((1.05, 1.18, 55), (1.19, 1.22, 20), (1.225, 1.245, 15)), ramp((8e5, 8e5, 75), (9e5, 1.8e6, 15)))
    assert got["low_price_setup_type"] == "pre_breakout" and got["low_price_setup_score"] >= 55
    got = shaped(spark, ramp((2.8, 1.05, 60), (1.0, 1.18, 15), (1.2, 1.34, 15)), ramp((6.5e5, 6.5e5, 75), (9e5, 2.1e6, 15)))
    assert got["low_price_setup_type"] == "bottom_rebound" and got["low_price_setup_score"] >= 52


def test_zones_and_trades(spark):
    day = lambda i: dt.date(2025, 1, 1) + dt.timedelta(days=i)
    ev = spark.createDataFrame([("a", day(i), "r", "s", float(x)) for i, x in ((0, 1), (20, 3), (41, 2), (45, 2))], "stock_code string, trade_date date, recipe string, setup_type string, setup_score double")
    zones = {r["zone"]: r for r in sg.merge_zones(ev, 20).collect()}
    assert zones[1]["trade_date"] == day(20) and zones[1]["zone_events"] == 2 and zones[2]["trade_date"] == day(41)
    assert sg.merge_zones(ev, 0).count() == 4
    bars = spark.createDataFrame([("a", day(i), 10.0 + i, 10.5 + i, 9.5 + i, 10.0 + i, 1.0) for i in range(5)], BAR)
    one = sc.trade_outcomes(bars, ev.limit(1), horizon=2).first()
    assert (one["entry"], one["exit"], one["exit_reason"]) == (11.0, 13.0, "time")
    held = sc.trade_outcomes(bars, ev.limit(1)).first()
    assert (held["exit"], held["exit_reason"]) == (14.0, "held") and math.isclose(held["trade_return"], 14 / 11 - 1)


def test_store_round_trip(spark, tmp_path):
    bars, path = linear(spark, 30), str(tmp_path / "bars")
    store.write(bars, path)
    back = store.read_dataset(spark, path, since="2024-01-10", columns=["stock_code", "trade_date", "close"])
    assert back.count() == 22
    new = bars.limit(3).withColumn("close", F.lit(1.0)).withColumn("stamp", F.lit(2))
    store.upsert(spark, path, new, ["stock_code", "trade_date"], "stamp", str(tmp_path / "staging"))
    again = spark.read.parquet(path)
    assert again.count() == 30 and again.where("close = 1.0").count() == 3
    assert tuple(store.change_counts(bars.limit(10), bars, ["stock_code", "trade_date"]).first()) == (20, 10)


def test_pick_weights_sum_to_one(spark):
    picks = spark.createDataFrame([("a", dt.date(2025, 1, 1), 3.0), ("b", dt.date(2025, 1, 1), -1.0), ("c", dt.date(2025, 1, 2), None)], "stock_code string, trade_date date, x double")
    got = {(r["stock_code"]): r["weight"] for r in sc.pick_weights(picks, "x").collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 1.0}


def walk(spark, n=160, codes="abcd"):
    """Securities that drift up with bursts of volume."""
    rng, rows = random.Random(5), []
    for code in codes:
        price = 20.0
        for i in range(n):
            o, price = price * rng.uniform(0.99, 1.012), price * rng.uniform(0.97, 1.036)
            rows.append((code, dt.date(2024, 1, 1) + dt.timedelta(days=i), o, max(o, price) * rng.uniform(1, 1.02), min(o, price) * rng.uniform(0.98, 1), price, rng.uniform(5e5, 1e6) * rng.choice([1, 1, 1, 2.5])))
    return spark.createDataFrame(rows, BAR)


def test_buy_and_sell_rules_row_by_row(spark):
    ind = ti.windowed_indicators(walk(spark)).join(ti.recurrences(walk(spark)), ["stock_code", "trade_date"]).cache()
    rows = sorted(ind.collect(), key=lambda r: (r["stock_code"], r["trade_date"]))
    ge = lambda x, y: x is not None and x >= y
    buys, sells, lost = {}, {}, 0
    for i, r in enumerate(rows):
        at = r["stock_code"], r["trade_date"]
        highs = [ge(r["distance_high_20"], -0.03), ge(r["distance_high_60"], -0.05), ge(r["bb_position"], 0.78), ge(r["return_60"], 0.18)]
        if r["close"] < r["open"] and any(highs) and (ge(r["volume_ratio_10"], 1.35) or ge(r["volume_spike"], 1.6)):
            lost += not (highs[0] or highs[1])
            sells[at] = 5 + ge(r["upper_shadow"], 0.28) + ge(r["volume_ratio_10"], 1.8) + (ge(r["distance_high_20"], -0.01) or ge(r["bb_position"], 0.92))
        if r["ma60"] is None or r["ma25_slope"] is None or r["ma25"] <= r["ma60"] or r["ma25_slope"] <= 0 or r["close"] <= r["ma25"]:
            continue
        if r["rsi"] < 52 or r["distance_high_20"] < -0.12 or r["volume_ratio_10"] < 0.95:
            continue
        recent = any(x["volume_cross"] for x in rows[i - 3 : i + 1])
        if (recent or r["volume_ma5"] >= r["volume_ma60"] * 1.05) and (r["distance_high_20"] >= -0.06 or r["close"] >= rows[i - 1]["close"]):
            buys[at] = ("cross" if r["volume_cross"] else "recent" if recent else "sustained", 8 if r["volume_cross"] else 7, round(r["close"] - 2 * r["atr14"], 9))
    got = {(r["stock_code"], r["trade_date"]): (r["mode"], r["strength"], round(r["stop_loss_price"], 9)) for r in sc.trend_2560_buys(ind).collect()}
    assert got == buys and {x[0] for x in buys.values()} == {"cross", "recent", "sustained"}
    assert {(r["stock_code"], r["trade_date"]): r["strength"] for r in sc.high_volume_bearish_sells(ind).collect()} == sells and sells and lost


def test_sell_signals_and_terms_of_entries_end_trades(spark):
    day = lambda i: dt.date(2025, 1, 1) + dt.timedelta(days=i)
    bars = spark.createDataFrame([("a", day(i), 10.0 + i, 10.5 + i, 9.5 + i, 10.0 + i, 1.0) for i in range(8)], BAR)
    buy = "'a' AS stock_code, DATE '2025-01-01' AS trade_date"
    sells = spark.createDataFrame([("a", day(1)), ("a", day(1)), ("a", day(4)), ("b", day(2))], "stock_code string, trade_date date")

    def outcome(terms="", **kw):
        r = sc.trade_outcomes(bars, spark.sql(f"SELECT {buy}{terms}"), **kw).first()
        return r["entry"], r["exit"], r["exit_reason"], r["exit_date"]

    assert outcome(sells=sells) == (11.0, 12.0, "strategy_sell", day(2))
    assert outcome(", 2 AS min_holding_bars", sells=sells) == (11.0, 15.0, "strategy_sell", day(5))
    assert outcome(", 3 AS holding_horizon, 2 AS min_holding_bars", sells=sells) == (11.0, 14.0, "time", day(4))
    assert outcome(", 11.0D AS stop_loss_price", sells=sells) == (11.0, 12.0, "stop", day(2))  # before the sell signal of that day
    assert outcome(", 1.0D AS trailing_stop_pct, 0.3D AS trailing_activation_gain") == (11.0, 16.0, "trailing", day(6))
    assert outcome(", CAST(NULL AS DOUBLE) AS stop_loss_price, CAST(NULL AS INT) AS holding_horizon") == outcome() == (11.0, 17.0, "held", day(7))


def test_range_composite_and_stochastic_cross(spark, monkeypatch):
    rows = {(r["stock_code"], r["trade_date"]): r for r in ti.full(walk(spark)).collect()}
    by = {code: [rows[x] for x in sorted(rows) if x[0] == code] for code in "abcd"}
    want = set()
    for series in by.values():
        for two, one, r in zip(series, series[1:], series[2:]):
            if two["stoch_d"] is not None and 15 <= r["stoch_k"] <= 55 and 0 <= r["stoch_d"] <= 55 and r["stoch_k"] > r["stoch_d"]:
                if one["stoch_k"] <= one["stoch_d"] + 3 or (one["stoch_k"] > one["stoch_d"] and two["stoch_k"] <= two["stoch_d"] + 3):
                    want.add((r["stock_code"], r["trade_date"]))
    assert want and want == {x for x, r in rows.items() if r["stoch_cross"]}
    monkeypatch.setattr(ti, "stoch_cross", lambda: F.lit(False))
    bare = {(r["stock_code"], r["trade_date"]): r["expected_3m_score"] for r in ti.full(walk(spark)).collect()}
    scored = {x for x in rows if bare[x] is not None}
    assert scored & want
    for x in scored:
        assert rows[x]["expected_3m_score"] == pytest.approx(min(bare[x] + 8, 100) if x in want and bare[x] > 0 else bare[x]) or (x in want and bare[x] == 0)

    ind = ti.windowed_indicators(walk(spark)).join(ti.recurrences(walk(spark)), ["stock_code", "trade_date"])
    got = {(r["stock_code"], r["trade_date"]): r for r in ti.range_scores(ind).collect()}
    seen = 0
    for series in by.values():
        for i, r in enumerate(series):
            g, have = got[r["stock_code"], r["trade_date"]], [x["atr10"] for x in series[max(0, i - 59) : i + 1] if x["atr10"] is not None]
            if g["band_compression"] is None or len(have) < 20:
                assert g["volatility_compression"] is None
                continue
            mean = sum(have) / len(have)
            z = (have[-1] - mean) / math.sqrt(sum((x - mean) ** 2 for x in have) / (len(have) - 1))
            assert g["volatility_compression"] == pytest.approx(g["band_compression"] * 0.55 + (50 - max(-3, min(3, z)) * 10) * 0.45)
            if g["range_reversion"] is not None and g["range_stability"] is not None:
                seen += 1
                assert g["range_long_composite"] == pytest.approx(g["range_reversion"] * 0.4 + g["volatility_compression"] * 0.24 + g["vwap_stretch"] * 0.18 + g["range_stability"] * 0.18)
    assert seen > 100


def test_codes_longer_than_the_padding_stay_whole(spark):
    from panelweave.sources.bars import daily_bars

    rows = [(1, 1, 1, k, 10.0, 100.0, dt.datetime(2024, 1, 2)) for k in (7, 123456, 123457)]
    line = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp")
    assert sorted(r[0] for r in daily_bars(line).select("stock_code").collect()) == ["00007", "123456", "123457"]
    codes = ["sz000001", "600000.SH", "300001bj", "000001", "100001", "12345", "7", "430001", "abc", None]
    got = spark.createDataFrame([(x,) for x in codes], "x string").select(cl.stock_code(F.col("x"), "CN").alias("c"), cl.exchange_of(F.col("x"), "CN").alias("e"), cl.stock_code(F.col("x"), "HK").alias("h")).collect()
    assert [r["c"] for r in got] == ["000001.SZ", "600000.SH", "300001.BJ", "000001.SZ", "100001", "12345", "7", "430001.BJ", "ABC", ""]
    assert [r["e"] for r in got] == ["SZSE", "SSE", "SZSE", "SZSE", "CN", "CN", "CN", "BSE", "CN", "CN"]
    assert [r["h"] for r in got][:7] == ["000001", "600000", "300001", "000001", "100001", "12345", "00007"]


def test_names_and_missing_names(spark):
    x = spark.createDataFrame([(" BFQ ",), ("no_adjust",), (None,), ("nope",)], "x string")
    assert [r[0] for r in x.select(cl.mapped(F.col("x"), cl.ADJUST, missing=cl.NO_ADJUST)).collect()] == ["raw", "raw", "qfq", None]
    with pytest.raises(Exception, match="unknown name: nope"):
        x.select(cl.mapped(F.col("x"), cl.ADJUST, strict=True, missing=cl.NO_ADJUST)).collect()
    with pytest.raises(Exception, match="unknown name: NULL"):
        x.where("x IS NULL").select(cl.mapped(F.col("x"), cl.ACTIONS, strict=True)).collect()


def test_an_older_row_does_not_replace_a_newer_one(spark, tmp_path):
    kind = "stock_code string, trade_date date, close double, stamp int"
    day = [dt.date(2023, 5, 1), dt.date(2024, 5, 1)]
    old = spark.createDataFrame([("a", day[0], 1.0, 9), ("a", day[1], 1.0, 3), ("b", day[0], 1.0, 5)], kind)
    new = spark.createDataFrame([("a", day[0], 2.0, 3), ("a", day[1], 2.0, 3), ("c", day[1], 2.0, None)], kind)
    got = {(r["stock_code"], r["trade_date"]): r["close"] for r in store.upserted(old, new, ["stock_code", "trade_date"], "stamp").collect()}
    assert got == {("a", day[0]): 1.0, ("a", day[1]): 2.0, ("b", day[0]): 1.0, ("c", day[1]): 2.0}
    path = str(tmp_path / "d")
    store.write(old, path)
    import os

    untouched = {f for f in os.listdir(f"{path}/year=2023") if f.endswith("parquet")}
    store.upsert(spark, path, new.where("year(trade_date) = 2024"), ["stock_code", "trade_date"], "stamp", str(tmp_path / "s1"))
    assert {f for f in os.listdir(f"{path}/year=2023") if f.endswith("parquet")} == untouched  # a year without new rows isn't rewritten
    assert {(r["stock_code"], r["trade_date"]): r["close"] for r in spark.read.parquet(path).collect()} == {("a", day[0]): 1.0, ("a", day[1]): 2.0, ("b", day[0]): 1.0, ("c", day[1]): 2.0}
    store.write(old, path, "append")
    store.compact(spark, path, ["stock_code", "trade_date"], ["stamp"], str(tmp_path / "s2"))
    assert spark.read.parquet(path).count() == 4


def test_a_total_loss_leaves_nothing(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, i), r) for i, r in ((1, 0.1), (2, -1.0), (3, 0.5))], "trade_date date, r double")
    assert [x["equity"] for x in sc.compounded(days, "r", 100.0).orderBy("trade_date").collect()] == pytest.approx([110.0, 0.0, 0.0])


def test_distribution_plans(spark):
    texts = ["每股派末期息派0.5港元", "每10股派3元", "股息0.2", "每10股送3股派1元", "每10股转增5股", "每2股供1股，供股价为3.5元", "不派息", "取消派息", "", None, "每0股派3"]
    rows = spark.createDataFrame([(str(i), dt.date(2024, 1, 1), t) for i, t in enumerate(texts)], "stock_code string, trade_date date, plan string")
    got = sorted((r["stock_code"], r["action"], r["cash"] if r["cash"] is not None else r["ratio"], r["price"]) for r in cl.distribution_actions(rows).collect())
    assert got == [("0", "cash_dividend", 0.5, None), ("1", "cash_dividend", 0.3, None), ("2", "cash_dividend", 0.2, None), ("3", "bonus_issue", 0.3, None), ("3", "cash_dividend", 0.1, None), ("4", "bonus_issue", 0.5, None), ("5", "rights_issue", 0.5, 3.5)]


def test_disorder_across_a_gap_and_off_hours(spark):
    d = dt.date
    rows = [("a", d(2024, 1, 3), 1), ("a", d(2024, 1, 5), 2), ("a", d(2024, 1, 4), 3), ("b", d(2024, 1, 3), 1), ("b", None, 2), ("c", d(2024, 1, 3), 1), ("c", d(2024, 1, 4), 2)]
    full = spark.createDataFrame([(k, x, 1.0, 1.0, 1.0, 1.0, 1.0, i) for k, x, i in rows], BAR + ", arrival int")
    assert {r["stock_code"]: r["non_monotonic_trade_date"] for r in cl.quality(full, "arrival").collect()} == {"a": 1, "b": 1, "c": 0}
    ts = lambda h, m, s=0, u=0: dt.datetime(2026, 4, 24, h, m, s, u)
    ticks = [("a", ts(9, 29), 1, 9.0, 1.0), ("a", ts(11, 59), 2, 10.0, 1.0), ("a", ts(12, 0), 3, 11.0, 1.0), ("a", ts(12, 0, 0, 5), 4, 99.0, 1.0), ("a", ts(13, 0), 5, 12.0, 0.0), ("a", ts(13, 30), 6, 13.0, 2.0)]
    got = {r["end_ts"]: (r["open"], r["close"], r["volume"]) for r in cl.resample(spark.createDataFrame(ticks, "stock_code string, ts timestamp, seq int, price double, qty double"), (60,)).collect()}
    assert got == {ts(12, 0): (10.0, 11.0, 2.0), ts(14, 0): (13.0, 13.0, 2.0)}


def test_dates_of_wide_rows_move_each_bar_once(spark):
    """Correlations, buckets and turnover from one table by date equal those of the long frame, without rows for each feature and horizon in an exchange."""
    import random

    from pyspark.sql import functions as F

    from panelweave.operators import validation as va

    rng = random.Random(3)
    day = lambda d: f"2020-01-{d + 1:02d}"
    data = [(f"s{k:02d}", day(d), rng.choice([1.0, 2.0, rng.random()]), rng.random() if d % 7 or k > 2 else None, 1 + rng.random()) for k in range(14) for d in range(20) if rng.random() < (0.2 if d == 9 else 0.9)]
    wide = spark.createDataFrame(data, "stock_code string, d string, A double, B double, close double").select("stock_code", F.to_date("d").alias("trade_date"), "A", "B", "close")
    names, horizons = ["A", "B"], [1, 3]
    long = wide.unpivot(["stock_code", "trade_date"], names, "feature_name", "feature_value").where("feature_value IS NOT NULL")
    frame, members, dated = va.frame_of(wide, names, horizons), va.quantile_membership(long), va.by_dates(wide, names, horizons, 3)
    pairs = [
        (va.ic_by_date(frame, rank_method="min"), va.ic_of_set(dated, names, horizons, rank_method="min")), (va.quantile_returns(members, va.forward_returns(wide, horizons)), va.quantile_returns_of_set(dated, names, horizons)),
        (va.turnover_by_date(members), va.turnover_of_set(va.buckets_of_set(dated, names), names, 2)), (va.fama_macbeth(frame, dates=3), va.mean_slopes(va.slopes_of_set(dated, names, horizons), dates=3)),
    ]
    for want, got in pairs:
        rows = [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.select(*want.columns).collect()) for t in (want, got)]
        assert rows[0] == rows[1] and rows[0]


def test_bars_keep_the_dealing_that_windows_need(spark):
    """One exchange and one sort serve bars and all windows by security, however many there are."""
    from panelweave.operators import indicators as ti
    from panelweave.plans.common import bars

    plan = ti.windowed_indicators(bars(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1


def test_quality_does_not_hang_on_ties_of_arrival(spark):
    """Rows that arrived as one count in the order of their dates, whichever comes first in the table."""
    from pyspark.sql import functions as F

    from panelweave.operators import cleaning as cl

    data = [("a", "2020-02-10", 5), ("a", "2020-01-01", 5), ("a", "2020-03-01", 9)]
    for rows in (data, data[::-1], [data[1], data[0], data[2]]):
        df = spark.createDataFrame(rows, "stock_code string, d string, arrival int").coalesce(1).select("stock_code", F.to_date("d").alias("trade_date"), *[F.lit(1.0).alias(n) for n in ("open", "high", "low", "close", "volume")], "arrival")
        assert cl.quality(df, "arrival").select("non_monotonic_trade_date").collect()[0][0] == 0
