"""Work that is done in parts, or in one pass over the bars, against the same work done at once or by joins."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from panelweave.functions import rolling
from panelweave.operators import factors, indicators as ti, reports as rp, scoring as sc, setups as sg, strategies as st, validation as va
from panelweave.plans import report_queries as rq, score_queries as pq, strategy_queries as stq

BAR = "stock_code string, trade_date date, open double, high double, low double, close double, volume double"


def panel(spark, codes=7, days=260):
    """Securities that trade on some days only, one of them at the end alone, with repeated prices."""
    rng, rows = random.Random(11), []
    for k in range(codes):
        price = 20.0
        for i in range(days - 30 if k == 6 else 0, days):
            if rng.random() < 0.25 * (k % 3):
                continue
            o, price = price, round(price * rng.uniform(0.96, 1.045), 1)
            rows.append((f"s{k}", dt.date(2024, 1, 1) + dt.timedelta(days=i), o, max(o, price) + rng.choice([0, 0.1]), min(o, price) - rng.choice([0, 0.1]), price, float(rng.randrange(0, 9) * 100)))
    return spark.createDataFrame(rows, BAR)


def test_correlations_by_ranges_of_dates(spark, monkeypatch):
    bars, horizons = factors.prepare(panel(spark)), (1, 5, 20)
    names = factors.factor_names()
    edges = va.date_edges(bars, F.col("trade_date"), 4)
    assert len(edges) == 3 and va.date_edges(bars.where("false"), F.col("trade_date"), 4) == []
    seen = []

    def dated(near, only):
        seen.append(near.count())
        return va.by_dates(factors.compute(near, names, also=va.returns_ahead(horizons), only=only), names, horizons, 2)

    keys = ("feature_name", "trade_date", "horizon", "n", "ic", "rank_ic")
    whole = factors.compute(bars, names, also=va.returns_ahead(horizons))
    text = lambda got: [repr(r) for r in got]
    want = text(rows_of(va.ic_of_set(va.by_dates(whole, names, horizons, 2), names, horizons), keys))
    assert len(want) > 40_000
    assert text(rows_of(va.ic_in_parts(bars, dated, names, horizons, edges, 61), keys)) == want
    assert len(seen) == 4 and min(seen) < 0.7 * bars.count()  # a range reads its own bars and those near them
    monkeypatch.setattr(va, "MATRIX_VALUES", 200)  # a few factors of a date at a time
    assert text(rows_of(va.ic_of_set(va.by_dates(whole, names, horizons, 2), names, horizons), keys)) == want


def rows_of(df, keys):
    return sorted((tuple(None if r[k] is None else round(r[k], 9) + 0.0 if isinstance(r[k], float) else r[k] for k in keys) for r in df.collect()), key=lambda r: r[:3])


def test_outcomes_of_every_bar_equal_joined_trades(spark):
    bars = panel(spark, days=90)
    bars = bars.withColumn("open", F.when(F.dayofmonth("trade_date") != 13, F.col("open"))).withColumn("close", F.when(F.dayofmonth("trade_date") != 17, F.col("close"))).cache()
    sells = bars.where("volume = 0").select("stock_code", "trade_date")
    keys = ("stock_code", "signal_date", "entry_date", "entry", "exit_date", "exit", "exit_reason", "trade_return")
    reasons = set()
    for kw, sold in (({}, None), ({"horizon": 3}, "_sell"), ({"stop": 0.05, "trail": 0.97, "gain": 0.02, "horizon": 30}, "_sell")):
        want = sc.trade_outcomes(bars, bars.select("stock_code", "trade_date"), sells=sells if sold else None, **kw)
        got = sc.taken(sc.with_outcomes(bars.withColumn("_sell", F.col("volume") == 0), sell=sold, **kw))
        assert got.columns == want.columns and rows_of(got, keys) == rows_of(want, keys)
        reasons |= {r["exit_reason"] for r in got.select("exit_reason").distinct().collect()}
    assert reasons == {"held", "stop", "trailing", "time", "strategy_sell"}


def test_first_events_of_zones(spark):
    events = panel(spark).where("volume >= 600").select("stock_code", "trade_date", F.lit("r").alias("recipe"), F.when(F.col("volume") > 600, "a").otherwise("b").alias("setup_type"), F.col("close").alias("setup_score"))
    keys = ("stock_code", "trade_date", "setup_type", "setup_score")
    for cooldown in (0, 3, 20):
        assert rows_of(sg.zone_starts(events, cooldown), keys) == rows_of(sg.merge_zones(events, cooldown, "first"), keys)


def test_trades_need_one_dealing_of_bars(spark):
    plan = pq.QUERIES["to_non_overlapping"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan and "sequence(" not in plan


def test_events_do_not_write_the_rules_into_a_condition(spark):
    """A condition that reads a recipe's type is not moved below the rules, where each of them would be written out at every place that reads it."""
    scored = sg.with_recipes(sg.setup_features(panel(spark)))
    plan = sg.setup_events(scored, recipes=("range_breakout",))._jdf.queryExecution().optimizedPlan().toString()
    conditions = [line for line in plan.splitlines() if "Filter" in line]
    assert conditions and not any("CASE WHEN" in line for line in conditions)


def test_impulse_buys_send_each_bar_to_python_once(spark):
    plan = stq.QUERIES["st_impulse"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_one_pass_for_bars_that_are_asked_for(spark, monkeypatch):
    """Indicators, scores and fields of bars before, of some bars only and wherever batches are cut, against separate passes over all columns."""
    bars = panel(spark, codes=5)
    rows = ti.unscored(bars)
    want = ti.with_zscores(rows, {f"_z_{n}": F.col(n) for n in ti.MATRIX}, total=("matrix_raw", {f"_z_{n}": w for n, w in ti.MATRIX.items()}, 10)).withColumn("ema5_1", F.lag("ema5").over(factors.security()))
    keys = ("stock_code", "trade_date", "matrix_raw", "matrix_raw_z", "_z_ma20_slope", "ema5_1", "atr10", "forward_return_60", "stoch_cross")
    want = rows_of(want.where("ema5 > ema13 AND ema13 > ema34"), keys)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("13", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = ti.at_once(bars, ("atr10", "forward_return_60", *ti.SCORED), st.IMPULSE_BEFORE, scores=True, only=st.impulse_stack).withColumn("stoch_cross", ti.stoch_cross()).withColumnRenamed("matrix_z", "matrix_raw_z")
            got = rows_of(got, keys)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
        assert [repr(r) for r in got] == [repr(r) for r in want] and any(r[3] is not None for r in got)


def test_buy_points_of_one_pass_equal_joined_ones(spark, monkeypatch):
    """Scores of signals and the late bars' volatility from one table of bars, against indicators that are made again for each and joined."""
    bars = panel(spark)
    monkeypatch.setattr(rq, "bars", lambda s, d: bars)
    signals = sc.trend_2560_buys(ti.unscored(bars))
    want = rp.buy_point_scores(signals.withColumnRenamed("strength", "signal_strength"), ti.with_volatility(ti.full(bars)))
    keys = ("stock_code", "trade_date", "close", "signal_strength", "score")
    assert len({r[0] for r in rows_of(want, keys)}) > 3
    assert rows_of(rq.buy_points(spark, ""), keys) == rows_of(want, keys)
    monkeypatch.undo()
    plan = rq.buy_points(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("MapInArrow") == 1 and "Join" not in plan


def test_packed_factors_equal_columns_to_the_last_bit(spark):
    """The whole set and returns as one binary column, from arrays, against Spark's columns; correlations of both are the same."""
    bars, horizons, names = panel(spark), (1, 5, 20), factors.factor_names()
    only, ahead = F.col("trade_date") >= F.lit("2024-03-01").cast("date"), va.returns_ahead(horizons)
    wide, narrow = (factors.compute(bars, names, also=ahead, only=only, pack=pack) for pack in (False, True))
    assert narrow.columns == ["stock_code", "trade_date", rolling.PACKED]
    columns = [*names, *ahead]
    want = {(r["stock_code"], r["trade_date"]): [np.nan if r[n] is None else r[n] for n in columns] for r in wide.collect()}
    got = narrow.toArrow()
    keys, values = list(zip(got["stock_code"].to_pylist(), got["trade_date"].to_pylist())), rolling.unpacked(got[rolling.PACKED], len(columns))
    assert sorted(keys) == sorted(want) and np.isnan(values).any() and not np.isnan(values).all(0).any()
    np.testing.assert_array_equal(values, np.array([want[k] for k in keys]))
    of = lambda rows: [repr(r) for r in rows_of(va.ic_of_set(va.by_dates(rows, names, horizons, 2), names, horizons), ("feature_name", "trade_date", "horizon", "n", "ic", "rank_ic"))]
    assert of(narrow) == of(wide)


def test_correlations_of_a_date_are_those_of_each_pair():
    """Missing values, absurd ones, ties and constant columns, against a plain loop."""
    import pandas as pd
    import pyarrow as pa

    rng, names, seen = np.random.default_rng(4), [f"f{k}" for k in range(9)], 0
    for trial in range(40):
        m = int(rng.integers(4, 40))
        data = {n: rng.integers(0, rng.integers(1, 30), m).astype(float) for n in [*names, "_ahead_1", "_ahead_5"]}
        for n, x in data.items():
            if trial % 3 and rng.random() < 0.6:
                x[rng.random(m) < rng.random()] = np.nan
        data["f0"][0] = 1e200
        day = pa.table({"trade_date": pa.array([dt.date(2024, 1, 1)] * m), **{n: pa.array(x, mask=np.isnan(x)) for n, x in data.items()}})
        got = {(r["feature_name"], r["horizon"]): r for r in va._cross_section(names, [1, 5], 5, "average")(day).to_pylist()}
        for n in names:
            for h in (1, 5):
                x, y = pd.Series(data[n]), pd.Series(data[f"_ahead_{h}"])
                there = (x.abs() <= va.LARGEST) & (y.abs() <= va.LARGEST)
                x, y = x[there], y[there]
                if len(x) < 5 or x.nunique() < 2 or y.nunique() < 2:
                    assert (n, h) not in got
                    continue
                r, seen = got[n, h], seen + 1
                assert r["n"] == len(x) and abs(r["ic"] - np.corrcoef(x, y)[0, 1]) < 1e-9 and abs(r["rank_ic"] - np.corrcoef(x.rank(), y.rank())[0, 1]) < 1e-9
    assert seen > 300
