"""Ordered passes over bars give what windows of each bar give, wherever batches are cut."""

import datetime as dt
import random

import numpy as np
import pytest

from panelweave.functions import passes

SCHEMA = "stock_code string, trade_date date, x double"


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_windows_of_a_pass(spark, size):
    rng = random.Random(3)
    series = {code: [None if rng.random() < 0.2 else float(rng.randint(0, 9)) for _ in range(n)] for code, n in (("a", 1), ("b", 40), ("c", 2), ("d", 25))}
    rows = [(code, dt.date(2024, 1, 1) + dt.timedelta(days=i), x) for code, xs in series.items() for i, x in enumerate(xs)]
    rng.shuffle(rows)

    def work(b):
        x = b["x"]
        return {
            "nth": b.at.astype("int32"), "newest": b.last == np.arange(len(x)), "high": b.highest(x, 13), "low": b.lowest(x, 5, ahead=True), "mean": b.mean(x, 13, 3), "total": b.total(x, 6), "std": b.deviation(x, 13, 2),
            "median": b.quantile(x, 6, 0.5), "upper": b.quantile(x, 6, 0.8), "before": b.back(x, 3), "after": b.back(x, -4), "left": b.count(x, 5, ahead=True).astype("int32"),
        }

    kinds = {"nth": "int", "newest": "boolean", "left": "int"}
    names = ("nth", "newest", "high", "low", "mean", "total", "std", "median", "upper", "before", "after", "left")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        out = passes.made(passes.in_turn(spark.createDataFrame(rows, SCHEMA)), ["x"], work, {n: kinds.get(n, "double") for n in names}, back=13, ahead=5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(out) == len(rows)
    for r in out:
        xs, i = series[r["stock_code"]], (r["trade_date"] - dt.date(2024, 1, 1)).days
        seen = lambda n: [x for x in xs[max(0, i - n + 1) : i + 1] if x is not None]  # noqa: B023, E731
        ahead = [x for x in xs[i : i + 5] if x is not None]
        assert r["nth"] == i + 1 and r["newest"] == (i == len(xs) - 1) and r["x"] == xs[i]
        assert r["high"] == max(seen(13), default=None) and r["low"] == min(ahead, default=None) and r["left"] == len(ahead) and r["total"] == sum(seen(6))
        assert r["mean"] == (pytest.approx(np.mean(seen(13))) if len(seen(13)) >= 3 else None)
        assert r["std"] == (pytest.approx(np.std(seen(13), ddof=1), abs=1e-9) if len(seen(13)) >= 2 else None)
        for name, q in (("median", 0.5), ("upper", 0.8)):
            assert r[name] == (pytest.approx(np.quantile(seen(6), q)) if seen(6) else None)
        assert r["before"] == (xs[i - 3] if i >= 3 else None) and r["after"] == (xs[i + 4] if i + 4 < len(xs) else None)


def test_recurrences_go_on_over_batches(spark):
    """Averages are carried from batch to batch; bars without a price are passed over."""
    from panelweave.operators import indicators as ti

    rng, rows = random.Random(9), []
    for code in "abc":
        for i in range(120 if code != "b" else 3):
            x = rng.uniform(10, 12)
            rows.append((code, dt.date(2024, 1, 1) + dt.timedelta(days=i), x + 1, None if rng.random() < 0.1 else x - 1, x))
    df = spark.createDataFrame(rows, "stock_code string, trade_date date, high double, low double, close double")
    was, got = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    for size in ("5", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got.append(sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in ti.recurrences(df).collect()))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert str(got[0]) == str(got[1]) and any(r[-1] is not None for r in got[0])


def test_rules_fit_a_method_that_is_compiled(spark):
    """Tables of rules are split into methods that the JVM compiles."""
    from panelweave.plans.common import bars

    bars(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_scores_and_signals_deal_the_bars_once(spark):
    """Scores and their trailing limits go on in the order that factors came in."""
    from panelweave.plans import score_queries as pq

    plan = pq.signals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
