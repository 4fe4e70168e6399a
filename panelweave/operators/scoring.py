"""Scores of securities from factors, actionable signals, rankings, picks and their weights."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import EPSILON, KEY, TIME, clamp, trailing, windowed
from panelweave.functions.passes import BAR, Bars, in_turn, made
from panelweave.functions.positions import in_order
from panelweave.operators.indicators import score, with_zscores
from panelweave.operators.validation import average_rank

c = F.col


def factor_scores(factors: DataFrame, names: dict[str, bool], window: int = 120, least: int = 30) -> DataFrame:
    """0..100 score of each factor against its own trailing history; ``names`` says whether more is better. Other columns stay."""
    z = with_zscores(factors, {f"_z_{n}": c(n) for n in names}, window, least)
    return z.select(KEY, TIME, *[score(c(f"_z_{n}"), 12.0, higher).alias(n) for n, higher in names.items()], *(n for n in factors.columns if n not in (KEY, TIME, *names)))


def composite(scores: DataFrame, components: dict[str, dict[str, float]], shares: dict[str, float]) -> DataFrame:
    """Weighted mean of each component's scores, and of the components; weights of what is missing are left out.

    A component is NULL until one of its factors has a score, empty components don't count.
    """
    out, used = scores, [n for n, w in components.items() if w]
    for n in used:
        w = components[n]
        have = sum(F.when(c(f).isNotNull(), F.lit(float(x))).otherwise(0.0) for f, x in w.items())
        out = out.withColumn(n, F.when(have > 0, sum(F.coalesce(c(f), F.lit(0.0)) * x for f, x in w.items()) / have))
    have = sum(F.when(c(n).isNotNull(), F.lit(float(shares[n]))).otherwise(0.0) for n in used)
    total = sum(F.coalesce(c(n), F.lit(0.0)) * shares[n] for n in used)
    return out.withColumn("_total", F.when(have > 0, total / have)).withColumn("composite", clamp(c("_total"), 0, 100)).drop("_total")


def cross_section_scores(long: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Sum over features of coefficient times the feature's z-score of its date, within three deviations."""
    w = Window.partitionBy("feature_name", TIME)
    std = F.stddev_samp("feature_value").over(w)
    z = long.withColumn("_std", std).withColumn("_z", F.when(c("_std") > EPSILON, (c("feature_value") - F.avg("feature_value").over(w)) / c("_std")))
    z = z.withColumn("_z", clamp(c("_z"), -3, 3))
    return z.join(F.broadcast(coefficients), "feature_name").groupBy(KEY, TIME).agg(F.sum(c("_z") * c("coefficient")).alias("raw"))


def percentile_of_date(df: DataFrame, x: str) -> Column:
    """Average rank of ``x`` in its date, as a percentage."""
    return F.try_divide(average_rank(x, [TIME]), F.count(x).over(Window.partitionBy(TIME))) * 100


def select_top(coefficients: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    return coefficients.where(F.abs("coefficient") >= least).orderBy(F.desc(F.abs("coefficient")), "feature_name").limit(k)


def explanation(scores: DataFrame, weights: dict[str, float], n: int = 2) -> DataFrame:
    """The ``n`` factors that add most and least to each security's newest score."""
    newest = scores.withColumn("_age", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TIME)))).where("_age = 1")
    parts = F.array(*[F.struct(F.lit(f).alias("feature_name"), (c(f) * w).alias("contribution")) for f, w in weights.items()])
    long = newest.select(KEY, TIME, F.inline(parts)).where("contribution IS NOT NULL")
    by = lambda o: F.row_number().over(Window.partitionBy(KEY).orderBy(o, "feature_name"))
    return long.withColumns({"from_top": by(F.desc("contribution")), "from_bottom": by(F.asc("contribution"))}).where((c("from_top") <= n) | (c("from_bottom") <= n))


def freshness(day: Column, as_of: Column) -> Column:
    """100 less four for each day since; 0 where there is no day."""
    return F.when(day.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - 4 * F.datediff(as_of, day)))


def signals(scored: DataFrame) -> DataFrame:
    """Actionable bars: composite, quality and risk each reach their trailing quantile, or fixed floors before there is one."""
    limits = {"composite": (0.80, 70.0), "quality": (0.65, 55.0), "risk": (0.45, 55.0)}

    def work(b: Bars) -> dict[str, np.ndarray]:
        return {f"{n}_limit": np.where(b.count(b[n], 60) >= 20, b.quantile(b[n], 60, q), floor) for n, (q, floor) in limits.items()} | {"newest": b.last == np.arange(len(b.at))}

    out = made(in_turn(scored), limits, work, {**{f"{n}_limit": "double" for n in limits}, "newest": "boolean"}, back=60, ahead=1)
    out = out if BAR in scored.columns else out.drop(BAR)
    rule = F.lit(True)
    for n in limits:
        rule = rule & F.coalesce(F.round(n, 9) >= F.round(f"{n}_limit", 9), F.lit(False))  # a value is often its own limit
    tier = F.when(c("composite") >= 75, "strong").when(c("composite") >= 60, "medium").otherwise("weak")
    return out.withColumns({"actionable": rule, "tier": tier, "risk_level": (100 - c("risk")) / 25})


def signal_summary(marked: DataFrame, outcome: str) -> DataFrame:
    """Mean, win rate and number of outcomes of actionable bars, and the mean of the others."""
    x, yes = c(outcome), c("actionable")
    return marked.groupBy(KEY).agg(
        F.avg(F.when(yes, x)).alias("mean_outcome"), (F.sum(F.when(yes & (x > 0), 1).otherwise(0)) / F.when(F.count(F.when(yes, x)) > 0, F.count(F.when(yes, x)))).alias("win_rate"),
        F.count(F.when(yes, x)).alias("n"), F.avg(F.when(~yes, x)).alias("mean_other"),
    )


def daily_top(signals_: DataFrame, n: int, order: Iterable[Column]) -> DataFrame:
    """The first ``n`` of each date with their place and the number of candidates."""
    day = Window.partitionBy(TIME)
    return signals_.withColumns({"place": F.row_number().over(day.orderBy(*order)), "candidates": F.count("*").over(day)}).where(c("place") <= n)


def pick_weights(picks: DataFrame, x: str, equal: bool = False) -> DataFrame:
    """Weights of a date's picks that sum to 1: equal, or in proportion to ``x`` where that is positive."""
    day = Window.partitionBy(TIME)
    value = F.greatest(F.coalesce(c(x), F.lit(0.0)), F.lit(0.0))
    picks = picks.withColumn("_value", value).withColumns({"_sum": F.sum("_value").over(day), "_n": F.count("*").over(day)})
    weight = F.when(F.lit(not equal) & (c("_sum") > EPSILON), c("_value") / c("_sum")).otherwise(1 / c("_n"))
    return picks.withColumn("weight", weight).drop("_value", "_sum", "_n")


def tiered(candidates: DataFrame, tiers: Iterable[Column], n: int, order: Iterable[Column]) -> DataFrame:
    """The first ``n`` of the first tier that isn't empty; one row for each security comes in."""
    rank = F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tiers)], F.lit(99))
    tagged = candidates.withColumn("tier_rank", rank)
    best = tagged.agg(F.min("tier_rank").alias("tier_rank"))
    first = tagged.join(F.broadcast(best), "tier_rank").orderBy(*order).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def compounded(daily: DataFrame, x: str, capital: float) -> DataFrame:
    """``equity`` and ``log_equity`` (natural) after each date of a table of one row for each date.

    The product of 1 + x is a running sum of logarithms with the number of signs and of total losses so far, so that it
    neither under- nor overflows: the logarithm stays exact where ``equity`` itself is out of a double's range. A total
    loss leaves 0 for good, and no logarithm; a missing x changes nothing. A debt (negative equity) has no logarithm.
    """
    factor = 1 + c(x)
    sums = {"_log": F.ln(F.when(factor != 0, F.abs(factor))), "_turns": (factor < 0).cast("int"), "_lost": (factor == 0).cast("int")}
    rows = in_order(daily, [c(TIME)], sums, position="_nth")
    log = F.lit(math.log(capital)) + c("_log")
    sign = F.when(c("_turns") % 2 == 0, 1.0).otherwise(-1.0)
    rows = rows.withColumns({"equity": F.when(c("_lost") > 0, 0.0).otherwise(sign * F.exp(log)), "log_equity": F.when((c("_lost") == 0) & (c("_turns") % 2 == 0), log)})
    return rows.drop("_nth", *sums)


def scorecard(ic: DataFrame, spread: DataFrame, turnover: DataFrame, components: dict[str, str] | None = None, decay: DataFrame | None = None) -> DataFrame:
    """One row for each feature: means over horizons, a score from them and the feature's share of the scores of its component.

    ``components`` names the component of each feature; without it all are in one. ``decay`` is a ``decay_summary``, whose
    shares are averaged over horizons. Features that only some of the tables have are kept, with NULL for the rest.
    """
    mean = lambda names: [F.avg(n).alias(n) for n in names]
    a = ic.groupBy("feature_name").agg(*mean(("ic_mean", "rank_ic_mean", "ic_positive", "rank_ic_positive", "ic_ir", "rank_ic_ir")), F.count_distinct("horizon").alias("horizons"))
    b = spread.groupBy("feature_name").agg(*mean(("spread_mean", "spread_ir", "spread_positive")))
    t = turnover.groupBy("feature_name").agg(F.avg("mean").alias("turnover"), F.max("most").alias("turnover_most"))
    out = a.join(b, "feature_name", "full_outer").join(t, "feature_name", "full_outer")
    if decay is not None:
        out = out.join(decay.groupBy("feature_name").agg(*mean(("ic_decay", "rank_ic_decay", "spread_decay"))), "feature_name", "full_outer")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    total = (
        zero(F.abs("rank_ic_mean")) * 35 + zero(F.abs("ic_mean")) * 20 + F.greatest(zero(c("spread_mean")), F.lit(0.0)) * 2000
        + zero(c("rank_ic_positive")) * 15 + zero(c("ic_positive")) * 5 + F.greatest(1 - F.coalesce("turnover", F.lit(1.0)), F.lit(0.0)) * 5
    )
    names = F.create_map(*[F.lit(x) for kv in components.items() for x in kv])[c("feature_name")] if components else F.lit("all")
    out = out.withColumn("score", total).withColumn("component", names)
    out = out.withColumn("_all", F.sum(F.greatest("score", F.lit(0.0))).over(Window.partitionBy("component")))
    return out.withColumn("recommended_weight", F.when(c("_all") > 0, F.greatest("score", F.lit(0.0)) / c("_all"))).drop("_all")


def _gram(names: list[str]):
    """Sums of products of each two columns, and of each with the target, of a task's rows: one row for each sum."""
    import numpy as np
    import pandas as pd

    def run(batches):
        p = len(names)
        gram, cross = np.zeros((p, p)), np.zeros(p)
        for b in batches:
            x, y = b[names].to_numpy(dtype=float), b["_y"].to_numpy(dtype=float)
            gram += x.T @ x
            cross += x.T @ y
        yield pd.DataFrame({"place": np.arange(p * p + p, dtype="int32"), "total": np.concatenate([gram.ravel(), cross])})

    return run


def ridge(wide: DataFrame, names: list[str], target: str, alpha: float = 1.0, least: int = 5) -> DataFrame:
    """Coefficients of a pooled ridge regression on features standardised within their dates.

    Each task sums the products of its rows, so what moves is a matrix for each task; the driver
    solves a system of as many unknowns as there are names.
    """
    import numpy as np

    ready = wide.select(TIME, target, *names).na.drop()
    day = Window.partitionBy(TIME)
    ready = ready.withColumn("_n", F.count("*").over(day)).where(c("_n") >= least)
    std = {n: F.stddev_samp(n).over(day) for n in names}
    x = ready.select((c(target) - F.avg(target).over(day)).alias("_y"), *[F.when(std[n] > EPSILON, (c(n) - F.avg(n).over(day)) / std[n]).otherwise(0.0).alias(n) for n in names])
    gram, cross = np.zeros((len(names), len(names))), np.zeros(len(names))
    for part in x.select(*names, "_y").mapInPandas(_gram(names), "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect():
        at = part["place"]  # p * (p + 1) sums, whatever the rows
        if at < len(names) ** 2:
            gram[divmod(at, len(names))] = part["total"]
        else:
            cross[at - len(names) ** 2] = part["total"]
    beta = np.linalg.solve(gram + alpha * np.eye(len(names)), cross)
    return wide.sparkSession.createDataFrame([(n, float(b)) for n, b in zip(names, beta)], "feature_name string, coefficient double")


def price_asof(bars: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (security, date) with the last close on or before that date."""
    both = bars.select(KEY, TIME, F.lit(0).alias("_asked"), "close").unionByName(wanted.select(KEY, TIME, F.lit(1).alias("_asked"), F.lit(None).cast("double").alias("close")))
    w = Window.partitionBy(KEY).orderBy(TIME, "_asked").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("price", F.last("close", True).over(w)).where("_asked = 1").select(KEY, TIME, "price")


#: Optional columns of entries: the terms of each trade.
TERMS = ("stop_loss_price", "holding_horizon", "trailing_stop_pct", "trailing_activation_gain", "min_holding_bars")


def trade_outcomes(bars: DataFrame, entries: DataFrame, stop: float = 0.08, trail: float = 0.9, gain: float = 0.05, horizon: int = 20, sells: DataFrame | None = None) -> DataFrame:
    """What becomes of each signal: bought at the next open, sold at the open after the first exit rule holds.

    In order: close at or below the stop, close at or below ``trail`` of the peak close after a gain
    of ``gain``, ``horizon`` bars held, a sell signal of ``sells`` once the signal's minimum of bars
    is held. Columns of ``entries`` named in TERMS go before the arguments where they have a value.
    The last bar of a security triggers nothing, so a position without an exit before it stays open
    (``exit_reason`` held, valued at the last close).
    """
    nth = bars.withColumn("_nth", F.row_number().over(Window.partitionBy(KEY).orderBy(TIME))).withColumn("_last", F.max("_nth").over(Window.partitionBy(KEY)))
    own = lambda n, other: F.coalesce(c(n), F.lit(other)) if n in entries.columns else F.lit(other)
    terms = [own(n, x).alias(f"_{n}") for n, x in zip(TERMS, (None, horizon, trail, gain, 0))]
    at = nth.select(KEY, TIME, "_nth").join(entries.select(KEY, TIME, *terms), [KEY, TIME]).withColumnRenamed(TIME, "signal_date")
    path = at.select(KEY, "signal_date", c("_nth").alias("_signal"), *[f"_{n}" for n in TERMS], F.explode(F.sequence(c("_nth") + 1, c("_nth") + c("_holding_horizon").cast("int") + 1)).alias("_nth"))
    path = path.join(nth.select(KEY, "_nth", "_last", TIME, "open", "close"), [KEY, "_nth"])
    path = path.withColumn("_sell", F.lit(False)) if sells is None else path.join(sells.select(KEY, TIME, F.lit(True).alias("_sell")).distinct(), [KEY, TIME], "left")
    w = Window.partitionBy(KEY, "signal_date").orderBy("_nth")
    path = path.withColumns({"entry": F.first("open").over(w), "peak": F.max("close").over(w), "next_open": F.lead("open").over(w), "next_date": F.lead(TIME).over(w), "held": c("_nth") - c("_signal")})
    reason = (
        F.when(c("close") <= F.coalesce(c("_stop_loss_price").cast("double"), c("entry") * (1 - stop)), "stop")
        .when((c("close") <= c("peak") * c("_trailing_stop_pct")) & (c("close") > c("entry") * (1 + c("_trailing_activation_gain"))), "trailing")
        .when(c("held") >= c("_holding_horizon"), "time").when(c("_sell") & (c("held") >= c("_min_holding_bars")), "strategy_sell")
    )
    path = path.withColumn("reason", F.when((c("_nth") < c("_last")) & c("next_open").isNotNull(), reason))
    first = F.min(F.when(c("reason").isNotNull(), F.struct(c("_nth"), "reason", "next_open", "next_date")))
    out = path.groupBy(KEY, "signal_date").agg(F.first("entry").alias("entry"), F.min(TIME).alias("entry_date"), first.alias("x"), F.max_by("close", "_nth").alias("_close"), F.max_by(TIME, "_nth").alias("_date"))
    return out.select(
        KEY, "signal_date", "entry_date", "entry", F.coalesce("x.next_date", "_date").alias("exit_date"), F.coalesce("x.next_open", "_close").alias("exit"), F.coalesce("x.reason", F.lit("held")).alias("exit_reason"),
        (F.coalesce("x.next_open", "_close") / c("entry") - 1).alias("trade_return"),
    )


#: What ``with_outcomes`` adds: what a signal at the bar comes to; dates as days since 1970, the reason as its place in ``_EXITS``.
OUTCOME = ("_entry", "_entry_day", "_exit", "_exit_day", "_exit_reason")
_EXITS = ("held", "stop", "trailing", "time", "strategy_sell")


def with_outcomes(bars: DataFrame, stop: float = 0.08, trail: float = 0.9, gain: float = 0.05, horizon: int = 20, sell: str | None = None) -> DataFrame:
    """``bars`` (in turn) plus ``OUTCOME``: the rules of ``trade_outcomes`` for a signal at each bar, from one ordered pass, without a row for each bar held.

    ``sell`` names a boolean column of bars with a sell signal. A security's last bar has no entry. ``taken`` makes trades of the bars that are signals.
    """
    rows = in_turn(bars).withColumn("_day", F.unix_date(TIME))

    def work(b: Bars) -> dict[str, np.ndarray]:
        op, cl, day, sold = b["open"], b["close"], b["_day"], b[sell] == 1 if sell else np.zeros(len(b.at), dtype=bool)
        left = b.last - np.arange(len(b.at))  # bars that follow
        at = lambda x, k: b.back(x, -k)
        entry, peak, ended = at(op, 1), np.full(len(op), np.nan), np.zeros(len(op), dtype=bool)
        out, when, why = at(cl, 1), at(day, 1), np.zeros(len(op))
        for k in range(1, horizon + 2):
            now, there = at(cl, k), (left >= k) & ~ended
            peak, then = np.fmax(peak, now), at(op, k + 1)
            rules = (now <= entry * (1 - stop), (now <= peak * trail) & (now > entry * (1 + gain)), np.full(len(op), k >= horizon), b.back(sold.astype(float), -k, 0.0) == 1)
            reason = np.select(rules, (1.0, 2.0, 3.0, 4.0), 0.0) * (there & (left > k) & ~np.isnan(then) & (k <= horizon))
            ends = reason > 0
            out, when, why = np.where(ends, then, np.where(there, now, out)), np.where(ends, at(day, k + 1), np.where(there, at(day, k), when)), np.where(ends, reason, why)
            ended |= ends
        return dict(zip(OUTCOME, (entry, at(day, 1), out, when, why)))

    return made(rows, ("open", "close", "_day", *([sell] if sell else [])), work, dict.fromkeys(OUTCOME, "double"), back=0, ahead=horizon + 2).drop("_day")


def taken(signals_: DataFrame) -> DataFrame:
    """``trade_outcomes`` of signals that have ``OUTCOME`` from their bars."""
    date = lambda n: F.date_from_unix_date(c(n).cast("int"))
    out = signals_.where("_entry_day IS NOT NULL").select(
        KEY, c(TIME).alias("signal_date"), date("_entry_day").alias("entry_date"), c("_entry").alias("entry"), date("_exit_day").alias("exit_date"), c("_exit").alias("exit"),
        F.element_at(F.array(*map(F.lit, _EXITS)), c("_exit_reason").cast("int") + 1).alias("exit_reason"),
    )
    return out.withColumn("trade_return", c("exit") / c("entry") - 1)


def net_return(gross: Column, slippage: float = 0.001, commission: float = 0.0003, least: float = 0.0, notional: float = 100_000.0) -> Column:
    """Return after slippage and commission on both sides; a side of ``notional`` pays ``least`` at least."""
    out = notional * (1 + gross) * (1 - slippage) / (1 + slippage)
    fee = lambda amount: F.greatest(amount * commission, F.lit(least)) if least else amount * commission
    return (out - fee(out)) / (notional + fee(F.lit(notional))) - 1


def trade_summary(trades: DataFrame, reasons: Iterable[str] = ("stop", "trailing", "time", "held")) -> DataFrame:
    r = c("net_return")
    return trades.groupBy(KEY).agg(
        F.count("*").alias("trades"), F.sum(F.when(r > 0, 1).otherwise(0)).alias("wins"), F.avg(r).alias("mean_return"), (F.product(1 + r) - 1).alias("compounded"),
        *[F.sum(F.when(c("exit_reason") == x, 1).otherwise(0)).alias(f"n_{x}") for x in reasons],
    )


def _one_at_a_time(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows kept of trades in order; what is carried on is the security and when its last kept trade ends."""
    key = free = None
    for b in batches:
        kept = []
        for i, (code, begins, ends) in enumerate(zip(*(b[n].to_pylist() for n in (KEY, "signal_date", "exit_date")))):
            if code != key:
                key, free = code, None
            if code is not None and (free is None or (begins is not None and begins > free)):
                kept.append(i)
                free = ends
        yield b.take(pa.array(kept, pa.int64()))


def non_overlapping(trades: DataFrame) -> DataFrame:
    """One position at a time for each security: a signal counts once the trade before it is over.

    An ordered pass over the trades of each security, read once; its state is when the last kept trade ends. Of
    signals of one date the one that ends first counts; after a trade without an end the next signal counts.
    """
    order = [KEY, "signal_date", F.col("exit_date").asc_nulls_last(), *[x for x in trades.columns if x not in (KEY, "signal_date", "exit_date")]]
    return trades.repartition(c(KEY)).sortWithinPartitions(*order).mapInArrow(_one_at_a_time, trades.schema)


def bullish_trend(ind: DataFrame, buffer: float = 0.03) -> Column:
    return F.coalesce((c("ma25") > c("ma60")) & (c("ma25_slope") > 0) & (c("close") >= c("ma25") * (1 - buffer)), F.lit(False))


def volume_cross_buys(ind: DataFrame) -> DataFrame:
    """Bars in a rising trend whose short volume average crossed the long one within three bars.

    A reduced rule; ``trend_2560_buys`` is the whole one.
    """
    w = Window.partitionBy(KEY).orderBy(TIME).rowsBetween(-3, 0)
    recent = F.max(c("volume_cross").cast("int")).over(w) == 1
    rows = ind.withColumns({"_trend": bullish_trend(ind), "_recent": recent})
    return rows.where("_trend AND _recent").select(KEY, TIME, "close", F.when(c("volume_cross"), "cross").otherwise("recent").alias("mode"))


def high_volume_sells(bars: DataFrame) -> DataFrame:
    """Falling bars at a high on high volume, with the number of highs that they are at.

    A reduced rule; ``high_volume_bearish_sells`` is the whole one.
    """
    cl, o, v = c("close"), c("open"), c("volume")
    highs = {n: c("high") >= F.max("high").over(trailing(n)) * 0.98 for n in (20, 60)}
    loud = (v >= 1.8 * windowed(v, 20, F.avg(v))) | (v >= F.max("volume").over(trailing(20)))
    rows = bars.withColumns({**{f"_h{n}": x.cast("int") for n, x in highs.items()}, "_loud": F.coalesce(loud, F.lit(False))})
    return rows.where((cl < o) & c("_loud") & (c("_h20") + c("_h60") > 0)).select(KEY, TIME, "close", (5 + c("_h20") + c("_h60")).alias("strength"))


#: What the trend rule reads of a bar, and by name (with type) what it reads of those before.
TREND = ("ma25", "ma60", "ma25_slope", "volume_ma5", "volume_ma60", "volume_cross", "distance_high_20", "rsi", "volume_ratio_10", "atr14")
TREND_NEAR = {"_recent": ("boolean", lambda b: b.highest(b["volume_cross"].astype(float), 4) == 1), "_before": ("double", lambda b: b.back(b["close"], 1))}


def rising(b: Bars) -> np.ndarray:
    """A condition without which the trend rule gives no buy."""
    return (b["ma25"] > b["ma60"]) & (b["ma25_slope"] > 0) & (b["close"] > b["ma25"])


def trend_2560() -> Column:
    """Whether a bar fulfils the rule of ``trend_2560_buys``; reads ``TREND`` and ``TREND_NEAR``."""
    no, yes = F.lit(False), F.lit(True)
    sustained = F.coalesce(c("volume_ma5") >= c("volume_ma60") * 1.05, no)
    quality = F.coalesce(c("distance_high_20") >= -0.06, no) | F.coalesce(c("close") >= c("_before"), no)
    gates = F.coalesce(c("rsi") >= 52, yes) & F.coalesce(c("distance_high_20") >= -0.12, yes) & F.coalesce(c("volume_ratio_10") >= 0.95, yes)
    return bullish_trend(None, 0.0) & (c("close") > c("ma25")) & c("volume_ma5").isNotNull() & c("volume_ma60").isNotNull() & gates & (c("_recent") | sustained) & quality


def trend_strength() -> Column:
    return F.when(c("volume_cross"), 8).otherwise(7)


def trend_2560_buys(ind: DataFrame) -> DataFrame:
    """Bars above a rising MA25 over MA60 with volume that crosses up now or within three bars, or stays strong.

    ``ind`` has windowed and recurrent indicators. Gates on RSI, distance to the high and volume
    pass where their value is missing. With the terms of the trade: stop, horizon, trailing stop,
    and the bars held before a sell signal counts.
    """
    near = lambda b: {n: x(b) for n, (_, x) in TREND_NEAR.items()}
    rows = ind if "_recent" in ind.columns else made(in_turn(ind), ("volume_cross", "close"), near, {n: kind for n, (kind, _) in TREND_NEAR.items()}, back=3)
    return rows.where(trend_2560()).select(
        KEY, TIME, "close", F.when(c("volume_cross"), "cross").when(c("_recent"), "recent").otherwise("sustained").alias("mode"), trend_strength().alias("strength"),
        F.coalesce(c("close") - 2 * c("atr14"), c("close") * 0.92).alias("stop_loss_price"), F.lit(60).alias("holding_horizon"), F.lit(0.945).alias("trailing_stop_pct"),
        F.lit(0.07).alias("trailing_activation_gain"), F.lit(4).alias("min_holding_bars"),
    )


#: Windowed indicators that ``bearish_strength`` reads.
BEARISH = ("intraday_return", "distance_high_20", "distance_high_60", "bb_position", "return_60", "volume_ratio_10", "volume_spike", "upper_shadow")


def bearish_strength() -> Column:
    """5 for a falling bar at any of four highs on either kind of high volume, and 1 more for each of three signs; NULL for other bars."""
    has = lambda rule: F.coalesce(rule, F.lit(False))
    falls = has(c("close") < c("open")) | has(c("intraday_return") < 0)
    high = has(c("distance_high_20") >= -0.03) | has(c("distance_high_60") >= -0.05) | has(c("bb_position") >= 0.78) | has(c("return_60") >= 0.18)
    loud = has(c("volume_ratio_10") >= 1.35) | has(c("volume_spike") >= 1.6)
    signs = (has(c("upper_shadow") >= 0.28), has(c("volume_ratio_10") >= 1.8), has(c("distance_high_20") >= -0.01) | has(c("bb_position") >= 0.92))
    return F.when(falls & high & loud, F.lit(5) + sum(x.cast("int") for x in signs))


def high_volume_bearish_sells(ind: DataFrame) -> DataFrame:
    """Bars that have a ``bearish_strength``."""
    return ind.select(KEY, TIME, "close", bearish_strength().alias("strength")).where("strength IS NOT NULL")
