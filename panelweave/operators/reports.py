"""Reports over bars, signals and strategies."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import KEY, TIME
from panelweave.operators.layers import export
from panelweave.operators.setups import latest

c = F.col


def describe_history(bars: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """For each security and column: count, mean, standard deviation, least, quartiles and greatest, and the range of dates."""
    long = bars.unpivot([KEY, TIME], list(columns), "field", "x")
    return long.groupBy(KEY, "field").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), F.percentile("x", 0.25).alias("p25"), F.percentile("x", 0.5).alias("p50"), F.percentile("x", 0.75).alias("p75"),
        F.max("x").alias("greatest"), F.min(TIME).alias("first_date"), F.max(TIME).alias("last_date"),
    )


def last_rows(bars: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy(F.desc(TIME))
    return bars.withColumn("_nth", F.row_number().over(w)).where(c("_nth") <= n).drop("_nth")


#: Why a bar is no buy. Fixed values.
BLOCKING = {
    "not oversold": "stoch_k >= 20", "RSI strong": "rsi > 40", "CYC not low": "cyc > 5", "above the upper band": "close > bb_upper", "volume broke out": "volume > volume_ma10 * 1.5",
}


def target_alignment(ind: DataFrame, signals: DataFrame, targets: DataFrame, window: int = 3) -> DataFrame:
    """For each target (security, date): whether there is a signal on it, or within ``window`` bars, the first such, and what speaks against one.

    Rules over columns that ``ind`` lacks are left out. A target that is no bar of its security has no hit.
    """
    w = Window.partitionBy(KEY).orderBy(TIME)
    marks = signals.select(KEY, TIME).distinct().withColumn("_signal", F.lit(True))
    near = F.min(F.when(c("_signal"), c(TIME))).over(w.rowsBetween(-window, window))
    rules = [(why, rule) for why, rule in BLOCKING.items() if rule.split()[0] in ind.columns and (rule.split()[2] in ind.columns or rule.split()[2].replace(".", "").isdigit())]
    why = F.array_join(F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules])), ", ")
    seen = ind.join(marks, [KEY, TIME], "left").select(KEY, TIME, F.coalesce("_signal", F.lit(False)).alias("hit"), near.alias("matched_date"), F.when(why == "", "near match").otherwise(why).alias("reason"))
    out = targets.select(KEY, TIME).distinct().join(seen, [KEY, TIME], "left")
    return out.select(KEY, TIME, F.coalesce("hit", F.lit(False)).alias("hit"), c("matched_date").isNotNull().alias("nearby_hit"), "matched_date", F.coalesce("reason", F.lit("not a bar")).alias("reason"))


def _steps(x: Column, *steps: tuple[float, int], above: bool = False) -> Column:
    """Points of the first step that ``x`` is below, or above."""
    out = F.when(F.lit(False), 0)
    for limit, points in steps:
        out = out.when(x > limit if above else x < limit, points)
    return out.otherwise(0)


def buy_point_scores(signals: DataFrame, ind: DataFrame) -> DataFrame:
    """Signals (``signal_strength``) with a score of up to 100 for how good a moment they are.

    Points for oversold oscillators, distance above the lower band, volatility below its mean of the
    security's last 50 bars, a low cycle, quiet volume and the signal's strength.
    """
    w = Window.partitionBy(KEY).orderBy(F.desc(TIME))
    calm = ind.withColumn("_age", F.row_number().over(w)).where("_age <= 50").groupBy(KEY).agg(F.avg("volatility").alias("_calm"))
    rows = signals.select(KEY, TIME, "signal_strength").join(ind, [KEY, TIME]).join(calm, KEY)
    return rows.select(KEY, TIME, "close", "signal_strength", (_moment() + _calmness(_own_volatility(), c("_calm"))).cast("double").alias("score"))


def _moment() -> Column:
    """Points for all but the volatility."""
    return (
        _steps(c("stoch_k"), (10, 20), (20, 15), (30, 10)) + _steps(c("rsi"), (25, 15), (35, 10), (45, 5))
        + _steps((c("close") - c("bb_lower")) / c("close"), (0.05, 15), (0.02, 10), (0.0, 5), above=True)
        + _steps(c("cyc"), (20, 10), (40, 5)) + _steps(F.coalesce(c("volume_ratio_10"), F.lit(1.0)), (0.8, 10), (1.5, 5)) + F.least(c("signal_strength") * 3, F.lit(15))
    )


def _own_volatility() -> Column:
    return F.when(c("atr14").isNotNull(), c("volatility"))


def _calmness(own: Column, calm: Column) -> Column:
    ratio = own / F.when(calm != 0, calm)
    return F.when(ratio.isNull(), 0).otherwise(F.when(ratio < 0.7, 15).when(ratio < 1.0, 10).otherwise(5))


#: Indicators that the score reads, and the mark of the last 50 bars of each security.
BUY_POINT = ("stoch_k", "rsi", "bb_lower", "atr14", "atr20", "cyc", "volume_ratio_10")
LATE = {"_late": ("boolean", lambda b: b.last - np.arange(len(b.at)) < 50)}


def marked_buy_points(rows: DataFrame) -> DataFrame:
    """``buy_point_scores`` from one table with ``signal_strength`` (NULL without a signal), ``volatility``, ``BUY_POINT`` and ``LATE``.

    It needs the signals and the late bars, no others; these are dealt once by security, with what the score still lacks alone.
    """
    own = rows.where(c(KEY).isNotNull() & (c("signal_strength").isNotNull() | c("_late")))
    own = own.select(KEY, TIME, "close", "signal_strength", _moment().alias("_points"), _own_volatility().alias("_own"), F.when(c("_late"), c("volatility")).alias("_last"))
    scored = own.withColumn("_calm", F.avg("_last").over(Window.partitionBy(KEY))).where(c("signal_strength").isNotNull() & c(TIME).isNotNull())
    return scored.select(KEY, TIME, "close", "signal_strength", (c("_points") + _calmness(c("_own"), c("_calm"))).cast("double").alias("score"))


def buy_point_summary(scored: DataFrame) -> DataFrame:
    """For each security the number of good signals (70 and more), the mean score, the best, and the dates of the best five."""
    w = Window.partitionBy(KEY).orderBy(F.desc("score"), TIME)
    rows = scored.withColumn("_nth", F.row_number().over(w))
    best = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("_nth") <= 5, F.struct("_nth", F.date_format(TIME, "yyyy-MM-dd").alias("d"))))), lambda x: x["d"]), ",")
    return rows.groupBy(KEY).agg(F.count("*").alias("signals"), F.sum(F.when(c("score") >= 70, 1).otherwise(0)).alias("good"), F.avg("score").alias("mean_score"), F.max("score").alias("best_score"), best.alias("best_dates"))


def compare_strategies(trades: dict[str, DataFrame]) -> DataFrame:
    """One row for each strategy (``stock_code, net_return`` of its trades): mean return and win rate in percent, trades and securities."""
    every = reduce(lambda a, b: a.unionByName(b), [df.select(KEY, "net_return", F.lit(n).alias("strategy")) for n, df in trades.items()])
    r = c("net_return")
    return every.groupBy("strategy").agg(
        (F.avg(r) * 100).alias("mean_return"), F.avg(F.when(r > 0, 100.0).otherwise(0.0)).alias("win_rate"), F.count("*").alias("trades"), F.count_distinct(KEY).alias("securities")
    )


def return_matrix(trades: dict[str, DataFrame]) -> DataFrame:
    """For each security the compounded return of each strategy, NULL where it has no trade."""
    every = reduce(lambda a, b: a.unionByName(b), [df.select(KEY, "net_return", F.lit(n).alias("strategy")) for n, df in trades.items()])
    return every.groupBy(KEY).pivot("strategy", list(trades)).agg(F.product(1 + c("net_return")) - 1)


def strategy_rankings(trades: dict[str, DataFrame], n: int = 5) -> DataFrame:
    """The securities that each strategy does best in."""
    every = reduce(lambda a, b: a.unionByName(b), [df.select(KEY, "net_return", F.lit(k).alias("strategy")) for k, df in trades.items()])
    total = every.groupBy("strategy", KEY).agg((F.product(1 + c("net_return")) - 1).alias("total_return"), F.count("*").alias("trades"))
    w = Window.partitionBy("strategy").orderBy(F.desc(F.round("total_return", 9)), KEY)
    return total.withColumn("place", F.row_number().over(w)).where(c("place") <= n)


def write_tables(tables: dict[str, DataFrame], path: str, form: str = "csv") -> None:
    """Each table of a report in a folder of its own name."""
    for name, df in tables.items():
        export(df, f"{path}/{name}", form)


def analysis_window(bars: DataFrame, n: int, least: int = 60) -> DataFrame:
    """The last ``n`` bars of each security that has ``least``; indicators are made before, so that they are warm."""
    own = Window.partitionBy(KEY)
    out = bars.withColumns({"_all": F.count("*").over(own), "_age": F.row_number().over(own.orderBy(F.desc(TIME)))})
    return out.where((c("_all") >= least) & (c("_age") <= n)).drop("_all", "_age")


def strategy_snapshot(bars: DataFrame, scores: DataFrame, buys: DataFrame, names: tuple[str, ...], active: int = 5) -> DataFrame:
    """For each security its last close, change over 30 bars, last known scores, and its last buy.

    The buy is active if it is among the last ``active`` bars, and actionable only then; with the mean
    return after 60 bars of actionable buys and of the others, in percent. ``buys`` has
    ``actionable, score, forward_return_60``.
    """
    w = Window.partitionBy(KEY).orderBy(TIME)
    moved = bars.withColumns({"_before": F.lag("close", 29).over(w), "_cut": F.lag(TIME, active - 1).over(w), "_first": F.min(TIME).over(Window.partitionBy(KEY))})
    now = latest(moved).select(KEY, TIME, "close", F.coalesce((c("close") - c("_before")) / c("_before") * 100, F.lit(0.0)).alias("change_30"), F.coalesce("_cut", "_first").alias("_cut"))
    known = scores.groupBy(KEY).agg(*[F.max_by(n, F.when(c(n).isNotNull(), c(TIME))).alias(f"latest_{n}") for n in names])
    r, yes = c("forward_return_60"), F.coalesce(c("actionable"), F.lit(True))
    last = buys.groupBy(KEY).agg(
        F.max(TIME).alias("latest_signal_date"), F.max_by(yes, TIME).alias("_yes"), F.max_by("score", TIME).alias("_score"),
        (F.coalesce(F.avg(F.when(yes, r)), F.lit(0.0)) * 100).alias("mean_after_signal"), (F.coalesce(F.avg(F.when(~yes, r)), F.lit(0.0)) * 100).alias("mean_after_watch"),
    )
    out = now.join(known, KEY, "left").join(last, KEY, "left").withColumn("current_signal_active", F.coalesce(c("latest_signal_date") >= c("_cut"), F.lit(False)))
    return out.withColumns({
        "current_signal_actionable": c("current_signal_active") & F.coalesce("_yes", F.lit(False)), "current_signal_score": F.when(c("current_signal_active"), c("_score")),
        "mean_after_signal": F.coalesce("mean_after_signal", F.lit(0.0)), "mean_after_watch": F.coalesce("mean_after_watch", F.lit(0.0)),
    }).drop("_yes", "_score", "_cut")
