"""Stored factor sets, plan texts, stamped bars, scorecards and ridge coefficients against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import cleaning as cl, factors, layers as ly, scoring as sc, validation as va
from panelweave.sources import store

DAY = dt.date(2020, 12, 1)
BARS = "stock_code string, trade_date date, open double, high double, low double, close double, volume double"


def bars_of(spark, n=40, codes=("00001", "00002", "00003"), seed=4):
    rng, rows = random.Random(seed), []
    for code in codes:
        for i in range(n):
            o, x = rng.uniform(5, 9), rng.uniform(5, 9)
            rows.append((code, DAY + dt.timedelta(days=i), o, max(o, x) + rng.random(), min(o, x) - rng.random(), x, float(rng.randrange(1, 50))))
    return spark.createDataFrame(rows, BARS), rows


def test_a_factor_set_is_stored_and_replaced(spark, tmp_path):
    """Two overlapping ranges over the turn of a year: later rows replace earlier ones of their key, the rest stays."""
    bars, rows = bars_of(spark)
    config, path = {"names": ("KMID", "ROC5")}, str(tmp_path / "features")
    first = ly.factor_rows(bars, "rolling158", until=DAY + dt.timedelta(days=34), config=config)
    store.write(first.withColumn("ingest_time", F.lit(1)), path)
    raised = bars.withColumn("close", F.col("close") + 1)
    second = ly.factor_rows(raised, "rolling158", since=DAY + dt.timedelta(days=30), config=config)
    ly.sync_factors(spark, path, second, str(tmp_path / "staging"), F.lit(2))
    got = {(r.stock_code, r.trade_date, r.feature_name): r.feature_value for r in store.read_dataset(spark, path).collect()}
    want = {}
    for code in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == code]
        for i, (_, day, o, _, _, close, _) in enumerate(own):
            new = i >= 30
            if i < 35 or new:
                want[code, day, "KMID"] = (close + new - o) / o
            if new and i >= 35:
                want[code, day, "ROC5"] = (own[i - 5][5] + 1) / (close + 1)
            elif 5 <= i < 35:
                want[code, day, "ROC5"] = own[i - 5][5] / close  # the later range has no window yet: the earlier row stays
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_values_that_are_not_finite_are_not_stored(spark, monkeypatch):
    bars, rows = bars_of(spark, 4, ("00001",))
    nth = F.datediff("trade_date", F.lit(DAY))
    value = F.when(nth == 0, F.lit(float("inf"))).when(nth == 1, F.lit(float("-inf"))).when(nth == 2, F.lit(float("nan"))).otherwise(F.lit(7.0))
    monkeypatch.setitem(ly.FACTOR_SETS, "odd", lambda b: b.select("stock_code", "trade_date", value.alias("x")))
    assert [(r.trade_date, r.feature_value, r.feature_set) for r in ly.factor_rows(bars, "odd").collect()] == [(DAY + dt.timedelta(days=3), 7.0, "odd")]


def test_plans_become_whole_rows(spark):
    """Dates, texts and repeated plans; a row without a plan, with a cancelled one or without any date gives nothing."""
    kind = "stock_code string, nth int, `分红方案` string, `除净日` string, `最新公告日期` string, `截至过户日` string, `发放日` string, `财政年度` string, `分配类型` string, action string, cash double"
    rows = [
        ("1", 1, " 每10股送3股派2.5元 ", "2021-05-03", "2021-04-01", "bad", "2021-06-01", "2020", "末期", "merger", 9.0), ("1", 2, "每股派末期息派0.75港元", "2021-05-03", None, None, None, None, None, None, None),
        ("2", 3, "每8股供2股，供股价为1.25元", None, "2021-04-01", None, "2021-06-02", None, "特别", None, None), ("3", 4, "不派息", "2021-05-03", None, None, None, None, None, None, None),
        ("3", 5, None, "2021-05-03", None, None, None, None, None, None, None), ("4", 6, "股息0.5元", None, None, None, None, None, None, None, None), ("5", 7, "每0股送1股", "2021-05-03", None, None, None, None, None, None, None),
    ]
    out = ly.normalize_plans(spark.createDataFrame(rows, kind), F.col("nth")).orderBy("stock_code", "action_type").collect()
    assert [(r.stock_code, r.action_type, r.cash_dividend, r.bonus_share_ratio, r.rights_issue_ratio, r.rights_issue_price) for r in out] == [
        ("00001", "bonus_issue", 0.0, 0.3, 0.0, 0.0), ("00001", "cash_dividend", 0.75, 0.0, 0.0, 0.0), ("00002", "rights_issue", 0.0, 0.0, 0.25, 1.25),
    ]
    bonus, cash, rights = out
    assert (bonus.event_date, bonus.announcement_date, bonus.record_date, bonus.payment_date) == (dt.date(2021, 5, 3), dt.date(2021, 4, 1), None, dt.date(2021, 6, 1))
    assert (bonus.plan_explain, bonus.fiscal_year, bonus.distribution_type, cash.announcement_date) == ("每10股送3股派2.5元", "2020", "末期", None)
    assert (rights.event_date, rights.ex_date, rights.distribution_type) == (dt.date(2021, 6, 2), None, "特别")
    assert ly.normalize_plans(spark.createDataFrame([], kind), F.col("nth")).count() == 0


def test_bars_with_their_origin(spark):
    rows = [("700", "2021-01-04", "1", "2", "1", "2", None, 1), ("700", "2021-01-04", "3", "4", "3", "4", "x", 2), ("700", "2021-01-05", "1", None, "1", "1", "9", 3), ("700", None, "1", "1", "1", "1", "9", 4), ("700", "soon", "1", "1", "1", "1", "9", 5)]
    raw = spark.createDataFrame(rows, "stock_code string, Date string, Open string, High string, Low string, Close string, Volume string, nth int")
    stamp = F.lit("2021-02-01").cast("timestamp")
    (bar,) = ly.normalize_ohlcv(raw, F.col("nth"), adjust=" HFQ ", source="desk", ingested=stamp).collect()
    assert (bar.stock_code, bar.trade_date, bar.open, bar.close, bar.volume) == ("00700", dt.date(2021, 1, 4), 3.0, 4.0, 0.0)
    assert (bar.market, bar.exchange, bar.asset_type, bar.frequency, bar.adjust, bar.currency, bar.source, bar.ingest_time) == ("HK", "HKEX", "equity", "daily", "hfq", "HKD", "desk", dt.datetime(2021, 2, 1))
    hour = ly.normalize_ohlcv(raw, F.col("nth"), "us", "nyse", frequency="60min", ingested=stamp).first()
    assert (hour.trade_date, hour.exchange, hour.currency, hour.stock_code, hour.adjust) == (dt.datetime(2021, 1, 4), "NYSE", "USD", "700", "qfq")
    assert ly.normalize_ohlcv(raw.limit(0), F.col("nth")).count() == 0
    with pytest.raises(ValueError):
        ly.normalize_ohlcv(raw, F.col("nth"), adjust="sideways")


def test_profiles_of_adjustments(spark):
    made = spark.createDataFrame([("Forward",), (None,), ("bfq",), ("other",)], "a string").select(cl.adjust_profile(F.col("a")).alias("p")).select("p.*").collect()
    assert [(r.adjust, r.label, r.needs_actions) for r in made] == [("qfq", "前复权", True), ("qfq", "前复权", True), ("raw", "不复权", False), (None, None, None)]
    with pytest.raises(Exception, match="unknown name"):
        spark.createDataFrame([("other",)], "a string").select(cl.adjust_profile(F.col("a"), True)).collect()


def test_decay_and_a_scorecard_with_gaps(spark):
    ic = spark.createDataFrame([("a", 1, 0.2, -0.4, 0.6, 0.7, 1.0, 2.0), ("a", 5, -0.1, 0.1, 0.4, 0.5, 3.0, 4.0), ("b", 1, 0.0, None, 0.5, 0.5, None, None), ("b", 5, 0.3, 0.2, 0.5, 0.5, 1.0, 1.0)], "feature_name string, horizon int, ic_mean double, rank_ic_mean double, ic_positive double, rank_ic_positive double, ic_ir double, rank_ic_ir double")
    spread = spark.createDataFrame([("a", 1, 0.02, 1.0, 0.5), ("a", 5, -0.01, 2.0, 0.7)], "feature_name string, horizon int, spread_mean double, spread_ir double, spread_positive double")
    turnover = spark.createDataFrame([("a", 1, 0.2, 0.9), ("a", 2, 0.4, 0.6), ("z", 1, 1.5, 2.0)], "feature_name string, bucket int, mean double, most double")
    decay = va.decay_summary(ic, spread)
    got = {(r.feature_name, r.horizon): (r.ic_decay, r.rank_ic_decay, r.spread_decay, r.base_horizon) for r in decay.collect()}
    assert got == {("a", 1): (1.0, 1.0, 1.0, 1), ("a", 5): (0.5, 0.25, 0.5, 1), ("b", 1): (None, None, None, 1), ("b", 5): (None, None, None, 1)}
    card = {r.feature_name: r for r in sc.scorecard(ic, spread, turnover, None, decay).collect()}
    a, b, z = card["a"], card["b"], card["z"]
    assert (a.horizons, a.ic_ir, a.rank_ic_ir, a.spread_ir, a.turnover_most, a.ic_decay, a.rank_ic_decay, a.spread_decay) == pytest.approx((2, 2.0, 3.0, 1.5, 0.9, 0.75, 0.625, 0.75))
    assert a.score == pytest.approx(0.15 * 35 + 0.05 * 20 + 0.005 * 2000 + 0.6 * 15 + 0.5 * 5 + 0.7 * 5)
    assert (b.spread_mean, b.turnover, b.ic_decay, z.horizons, z.score) == (None, None, None, None, 0.0)
    assert sum(r.recommended_weight for r in card.values()) == pytest.approx(1)


@pytest.mark.parametrize("parts", [1, 5])
def test_ridge_is_the_solution_of_its_normal_equations(spark, parts):
    """Dates of fewer than five whole rows, rows with gaps and a feature that does not vary on a date."""
    rng, rows = random.Random(11), []
    for d in range(12):
        for k in range(4 if d == 3 else 9):
            x, z = rng.gauss(0, 2), 1.0 if d == 5 else rng.gauss(3, 1)
            rows.append((f"s{k}", DAY + dt.timedelta(days=d), None if rng.random() < 0.1 else x, z, 0.3 * x - 0.2 * z + rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "stock_code string, trade_date date, x double, z double, y double").repartition(parts)
    made = {r.feature_name: r.coefficient for r in sc.ridge(df, ["x", "z"], "y", 2.0).collect()}
    a, b = [], []
    for day in sorted({r[1] for r in rows}):
        own = np.array([r[2:] for r in rows if r[1] == day and None not in r], dtype=float)
        if len(own) >= 5:
            std = own[:, :2].std(0, ddof=1)
            a.append(np.where(std > 1e-12, (own[:, :2] - own[:, :2].mean(0)) / np.where(std > 1e-12, std, 1), 0))
            b.append(own[:, 2] - own[:, 2].mean())
    a, b = np.vstack(a), np.concatenate(b)
    want = np.linalg.solve(a.T @ a + 2.0 * np.eye(2), a.T @ b)
    assert [made["x"], made["z"]] == pytest.approx(list(want), rel=1e-9)


def test_features_of_the_largest_coefficients(spark):
    coefficients = spark.createDataFrame([("a", 0.5), ("b", -0.7), ("c", 0.5), ("d", None), ("e", 0.01)], "feature_name string, coefficient double")
    assert [r.feature_name for r in sc.select_top(coefficients, 3, 0.02).collect()] == ["b", "a", "c"]
    assert sc.select_top(coefficients, 3, 9.0).count() == 0


def test_values_past_the_bound_are_left_out(spark):
    values = [1e150, 1.01e150, -2e150, math.inf, math.nan, None, 0.0]
    f = spark.createDataFrame([(str(i), DAY, "f", x) for i, x in enumerate(values)], "stock_code string, trade_date date, feature_name string, feature_value double")
    r = spark.createDataFrame([(str(i), DAY, 1, 1e151 if i == 6 else 0.1) for i in range(7)], "stock_code string, trade_date date, horizon int, forward_return double")
    assert [x.feature_value for x in va.validation_frame(f, r).collect()] == [1e150]
