"""Price and volume setups, evaluated for every bar at once, and the events and zones they make.

A recipe is a table of rules: points and a condition over trailing-window columns. A condition
over a missing value doesn't hold. The features are one window pass per security.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import KEY, TIME, ratio, security
from panelweave.functions.passes import BAR, Bars, in_turn, made
from panelweave.functions.passes import ratio as over
from panelweave.functions.positions import in_order, pinned, quantiles

c = F.col


@dataclass(frozen=True)
class Bounds:
    """What counts as a low price and as enough median turnover."""

    low: float = 0.20
    high: float = 8.0
    turnover: float = 1_000_000.0


# Points and limits of the rules.
PRE_BREAKOUT = [
    (16, "low_price"), (14, "liquid"), (18, "distance_to_high20 >= -0.035"), (16, "compression <= 0.85"),
    (12, "coalesce(compression > 0.85, true) AND range20 <= range60 * 0.72"), (16, "volume_ratio >= 1.12"), (10, "return20 >= 0.04"), (8, "close >= ma20"),
]
BOTTOM_REBOUND = [
    (16, "low_price"), (12, "liquid"), (18, "return60 <= -0.18"), (16, "distance_from_low60 BETWEEN 0.06 AND 0.35"),
    (14, "volume_ratio >= 1.15"), (12, "return5 >= 0.04"), (10, "close >= ma10"), (8, "close >= ma20 * 0.97"),
]
LOW_PRICE_SIDEWAYS = [
    (10, "abs(return20) <= 0.06"), (8, "range20 <= 0.14"), (8, "volume_ratio < 1.05"),
    (6, "distance_to_high20 < -0.05 AND coalesce(distance_from_low60 < 0.08, true)"),
]
RANGE_BREAKOUT = [
    (8, "low_price"), (12, "liquid"), (24, "above_high20"), (14, "distance_to_previous_high20 >= -0.015 AND distance_to_previous_high20 < 0.005"),
    (18, "compressed"), (18, "volume_up"), (10, "return5 >= 0.025"), (6, "return20 >= 0.02"), (4, "close >= ma20"),
]
RANGE_SIDEWAYS = [(8, "NOT above_high20"), (8, "previous_volume_ratio < 1.05"), (6, "abs(return20) <= 0.04")]
BOX_PULLBACK = [
    (8, "low_price"), (12, "liquid"), (14, "compact"), (20, "box_broken"), (22, "holding"), (16, "dry"),
    (8, "pullback_depth BETWEEN -0.12 AND -0.015"), (4, "return20 >= 0.02"),
]
BOX_SIDEWAYS = [(8, "NOT box_broken"), (8, "NOT holding"), (6, "volume_ratio > 1.15")]

#: Conditions with names, in the order in which they build on each other.
FLAGS = {
    "above_high20": "coalesce(distance_to_previous_high20 >= 0.005, false)",
    "volume_up": "coalesce(previous_volume_ratio >= 1.30, false)",
    "compressed": "coalesce(compression <= 0.82, false) OR coalesce(range20 <= range60 * 0.70, false) OR coalesce(range20 <= 0.12, false)",
    "compact": "coalesce(box_height <= 0.18, false)",
    "box_broken": "coalesce(box_height <= 0.18 AND breakout_peak_return >= 0.035, false)",
    "holding": "coalesce(distance_to_box_top BETWEEN -0.015 AND 0.045 AND pullback_low >= box_top * 0.985, false)",
    "dry": "coalesce(volume_ratio <= 0.85, false) OR coalesce(pullback_volume_ratio <= 0.70, false)",
}
NEUTRAL = ("neutral", "sideways")

#: Setup and score of each recipe, from its summed points.
LABELS = {
    "low_price_setup": (
        "CASE WHEN coalesce(return60 <= -0.18, false) AND bottom_rebound >= greatest(52.0, pre_breakout - 4, low_price_sideways + 6) THEN 'bottom_rebound' "
        "WHEN pre_breakout >= bottom_rebound AND pre_breakout >= greatest(55.0, low_price_sideways + 8) THEN 'pre_breakout' "
        "WHEN bottom_rebound > pre_breakout AND bottom_rebound >= greatest(55.0, low_price_sideways + 8) THEN 'bottom_rebound' "
        "WHEN low_price_sideways >= 18 THEN 'sideways' ELSE 'neutral' END"
    ),
    "range_breakout": "CASE WHEN above_high20 AND compressed AND volume_up AND range_breakout >= 60 THEN 'range_breakout' WHEN range_sideways >= 18 THEN 'sideways' ELSE 'neutral' END",
    "box_pullback": (
        "CASE WHEN nth < 45 THEN 'neutral' WHEN box_broken AND holding AND dry AND box_pullback >= 60 THEN 'box_pullback' WHEN box_sideways >= 18 THEN 'sideways' ELSE 'neutral' END"
    ),
}
SCORES = {
    "low_price_setup": "CASE low_price_setup_type WHEN 'bottom_rebound' THEN bottom_rebound WHEN 'pre_breakout' THEN pre_breakout ELSE greatest(pre_breakout, bottom_rebound) END",
    "range_breakout": "range_breakout",
    "box_pullback": "CASE WHEN nth < 45 THEN 0.0 ELSE box_pullback END",
}
POINTS = {
    "pre_breakout": PRE_BREAKOUT, "bottom_rebound": BOTTOM_REBOUND, "low_price_sideways": LOW_PRICE_SIDEWAYS, "range_breakout": RANGE_BREAKOUT,
    "range_sideways": RANGE_SIDEWAYS, "box_pullback": BOX_PULLBACK, "box_sideways": BOX_SIDEWAYS,
}


def points(rules: list[tuple[int, str]]) -> str:
    return " + ".join(f"CASE WHEN {rule} THEN {n}.0 ELSE 0.0 END" for n, rule in rules)


def _around(b: Bars) -> dict[str, np.ndarray]:
    """The windows of each bar's features; those of less than their length at a security's start are partial."""
    cl, v, turnover = b["close"], b["volume"], b["turnover"]
    daily = over(cl, b.back(cl, 1)) - 1
    return {
        "nth": b.at.astype("int32"), "newest": b.last == np.arange(len(b.at)), "daily": daily, "median_turnover20": b.quantile(turnover, 20, 0.5), **{f"return{n}": over(cl, b.back(cl, n)) - 1 for n in (5, 20, 60)},
        "high20": b.highest(cl, 20), "low20": b.lowest(cl, 20), "high60": b.highest(cl, 60), "low60": b.lowest(cl, 60), "previous_high20": b.back(b.highest(cl, 20), 1),
        "ma10": b.mean(cl, 10), "ma20": b.mean(cl, 20), "volume_ma20": b.mean(v, 20), "previous_volume_ma20": b.back(b.mean(v, 20), 1), "vol20": b.deviation(daily, 20, 5), "vol60": b.deviation(daily, 60, 10),
        "box_top": b.back(b.highest(cl, 40), 20), "box_bottom": b.back(b.lowest(cl, 40), 20), "breakout_peak": b.back(b.highest(cl, 15), 5), "pullback_low": b.lowest(cl, 5), "breakout_volume": b.back(b.quantile(v, 15, 0.5), 5),
    }


AROUND = ("daily", "median_turnover20", "return5", "return20", "return60", "high20", "low20", "high60", "low60", "previous_high20", "ma10", "ma20", "volume_ma20", "previous_volume_ma20", "vol20", "vol60", "box_top", "box_bottom", "breakout_peak", "pullback_low", "breakout_volume")


def setup_features(bars: DataFrame, bounds: Bounds = Bounds(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Trailing columns of each bar; windows may be partial, as at a security's start. ``newest`` marks each security's last bar; columns in ``keep`` stay."""
    cl, v = c("close"), c("volume")
    base = in_turn(bars).select(KEY, TIME, "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"), BAR, *keep).where("close IS NOT NULL")
    out = made(base.withColumn("turnover", cl * v), ("close", "volume", "turnover"), _around, {"nth": "int", "newest": "boolean", **dict.fromkeys(AROUND, "double")}, back=61, ahead=1)
    out = out.withColumns({
        "distance_to_high20": ratio(cl, c("high20")) - 1, "distance_from_low60": ratio(cl, c("low60")) - 1,
        "distance_to_previous_high20": ratio(cl, c("previous_high20")) - 1, "volume_ratio": ratio(v, c("volume_ma20")),
        "previous_volume_ratio": ratio(v, F.coalesce(F.when(c("previous_volume_ma20") != 0, c("previous_volume_ma20")), c("volume_ma20"))),
        "compression": F.when(c("vol60") > 0, c("vol20") / c("vol60")), "range20": ratio(c("high20") - c("low20"), cl), "range60": ratio(c("high60") - c("low60"), cl),
        "box_height": ratio(c("box_top"), c("box_bottom")) - 1, "breakout_peak_return": ratio(c("breakout_peak"), c("box_top")) - 1,
        "distance_to_box_top": ratio(cl, c("box_top")) - 1, "pullback_depth": ratio(cl, c("breakout_peak")) - 1, "pullback_volume_ratio": ratio(v, c("breakout_volume")),
        "low_price": cl.between(bounds.low, bounds.high), "liquid": c("median_turnover20") >= bounds.turnover,
    })
    return out.drop(BAR)


def with_recipes(features: DataFrame) -> DataFrame:
    """Points, setup type and score of every recipe on every bar."""
    out = features.withColumns({n: F.expr(x) for n, x in FLAGS.items()})
    out = out.withColumns({n: F.expr(points(r)) for n, r in POINTS.items()})
    out = out.withColumns({f"{n}_type": F.expr(x) for n, x in LABELS.items()})
    return out.withColumns({f"{n}_score": F.expr(x).cast("double") for n, x in SCORES.items()})


def best_recipe(scored: DataFrame) -> DataFrame:
    """The recipe of the best score, the first named on ties, and the scores of all."""
    names = list(LABELS)
    options = F.array(*[F.struct(c(f"{n}_score").alias("score"), F.lit(-i).alias("first"), F.lit(n).alias("recipe"), c(f"{n}_type").alias("setup_type")) for i, n in enumerate(names)])
    scores = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[c(f"{n}_score") for n in names]))
    return scored.withColumn("_best", F.array_max(options)).select(*scored.columns, c("_best.recipe").alias("recipe"), c("_best.setup_type").alias("setup_type"), c("_best.score").alias("setup_score"), scores.alias("recipe_scores"))


def setup_events(scored: DataFrame, history: int = 60, last: int | None = None, keep: tuple[str, ...] = (), recipes: tuple[str, ...] = tuple(LABELS)) -> DataFrame:
    """A row for each bar and recipe (of ``recipes``) that has a setup, once a security has ``history`` bars; of the ``last`` bars of each only, if given. Columns in ``keep`` stay."""
    if last is not None:
        scored = scored.withColumn("_age", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TIME)))).where(c("_age") <= last)
    options = F.array(*[F.struct(F.lit(n).alias("recipe"), c(f"{n}_type").alias("setup_type"), c(f"{n}_score").alias("setup_score")) for n in recipes])
    # a condition on types before the rows are made would be moved below the rules, with all of them written out in it again and again
    return scored.where(c("nth") >= history).select(KEY, TIME, *keep, F.explode(options).alias("e")).select(KEY, TIME, "e.*", *keep).where(~c("setup_type").isin(*NEUTRAL))


def with_forward(bars: DataFrame, horizons=(20, 40, 60), truncate: bool = False) -> DataFrame:
    """``bars`` (in turn) plus the return after h bars and the worst low of the next h bars, relative to the close.

    ``truncate`` takes the last bar where fewer than h follow; otherwise the return is NULL there.
    """
    rows = in_turn(bars)
    if truncate:
        rows = rows.withColumn("_end", F.last("close").over(security().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))

    def work(b: Bars) -> dict[str, np.ndarray]:
        cl, out = b["close"], {}
        for h in horizons:
            then = b.back(cl, -h)
            out[f"forward_return_{h}"] = over(np.where(np.isnan(then), b["_end"], then) if truncate else then, cl) - 1
            out[f"max_drawdown_{h}"] = over(b.back(b.lowest(b["low"], h, ahead=True), -1), cl) - 1
        return out

    return made(rows, ("close", "low", *(["_end"] if truncate else [])), work, {f"{n}_{h}": "double" for h in horizons for n in ("forward_return", "max_drawdown")}, back=0, ahead=max(horizons) + 1).drop("_end")


def forward_metrics(bars: DataFrame, horizons=(20, 40, 60), truncate: bool = False) -> DataFrame:
    """``with_forward`` of securities and dates alone."""
    return with_forward(bars.select(KEY, TIME, "low", "close"), horizons, truncate).drop("low", "close", BAR)


def merge_zones(events: DataFrame, cooldown: int = 20, policy: str = "best_score") -> DataFrame:
    """Events of one security, recipe and setup no more than ``cooldown`` days apart, as one row.

    ``policy`` names the event a zone keeps: ``first``, ``latest`` or ``best_score`` (the earliest
    of equals). With cooldown 0 every event is a zone.
    """
    keys = [KEY, "recipe", "setup_type"]
    w = Window.partitionBy(*keys).orderBy(TIME)
    new = F.when(F.lag(TIME).over(w).isNull() | (F.lit(cooldown) <= 0) | (F.datediff(TIME, F.lag(TIME).over(w)) > cooldown), 1).otherwise(0)
    zoned = events.withColumn("_new", new).withColumn("zone", F.sum("_new").over(w))
    order = {"first": F.struct(F.datediff(F.lit("2200-01-01"), TIME)), "latest": F.struct(TIME), "best_score": F.struct("setup_score", F.datediff(F.lit("2200-01-01"), TIME))}[policy]
    return zoned.groupBy(*keys, "zone").agg(
        F.max_by(TIME, order).alias(TIME), F.max_by("setup_score", order).alias("setup_score"), F.min(TIME).alias("zone_start"), F.max(TIME).alias("zone_end"),
        F.count("*").alias("zone_events"), F.max("setup_score").alias("zone_best"),
    )


def zone_starts(events: DataFrame, cooldown: int = 20) -> DataFrame:
    """The first event of each zone of ``merge_zones``, with all its columns."""
    before = F.lag(TIME).over(Window.partitionBy(KEY, "recipe", "setup_type").orderBy(TIME))
    return events.withColumn("_before", before).where(c("_before").isNull() | (F.lit(cooldown) <= 0) | (F.datediff(TIME, "_before") > cooldown)).drop("_before")


def summarize_events(events: DataFrame, metrics: DataFrame | None = None, h: int = 20) -> DataFrame:
    """Counts, concentration and outcome distribution of each recipe's setups; without ``metrics`` events have theirs already."""
    keys = ["recipe", "setup_type"]
    r, d = c(f"forward_return_{h}"), c(f"max_drawdown_{h}")
    rows = events if metrics is None else events.join(metrics, [KEY, TIME], "left")
    rows = pinned(rows.select(*keys, KEY, r.alias("_r"), d.alias("_d")))  # read for the counts, the means and twice for quantiles
    per = rows.groupBy(*keys, KEY).agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), KEY)))
    top = per.groupBy(*keys).agg(F.sum(F.when(c("rank") <= 5, c("n"))).alias("_top"), F.sum("n").alias("_all"))
    r, d = c("_r"), c("_d")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("events"), F.count_distinct(KEY).alias("securities"), F.avg(r).alias("mean_return"), (F.sum(F.when(r > 0, 1).otherwise(0)) / F.count(r)).alias("win_rate"),
        F.avg(d).alias("mean_drawdown"), F.avg(F.when(r > 0, r)).alias("mean_win"), F.avg(F.when(r <= 0, r)).alias("mean_loss"),
    )
    for own in (quantiles(rows, keys, "_r", {"median_return": 0.5, "p25_return": 0.25, "p75_return": 0.75}), quantiles(rows, keys, "_d", {"p5_drawdown": 0.05})):
        out = out.join(own, keys, "left")
    return out.join(top, keys).withColumn("top5_share", c("_top") / c("_all")).drop("_top", "_all")


def signal_report(scored: DataFrame, bars: DataFrame, last: int | None = None, cooldown: int = 20, policy: str = "best_score") -> dict[str, DataFrame]:
    """Tables of a setup report: events of the last bars, what followed each, zones of events, and their summary."""
    events = setup_events(scored, last=last)
    metrics = forward_metrics(bars, truncate=True)
    return {"events": events.join(metrics, [KEY, TIME], "left"), "zones": merge_zones(events, cooldown, policy), "summary": summarize_events(events, metrics)}


def latest(df: DataFrame, marked: bool = False) -> DataFrame:
    """The newest row of each security; where ``newest`` of all its rows is ``marked``, only those rows are dealt."""
    df = df.where("newest") if marked else df
    w = Window.partitionBy(KEY).orderBy(F.desc(TIME))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def ranked(df: DataFrame, *order: Column, limit: int | None = None) -> DataFrame:
    """``df`` with ``rank_position``; with ``limit`` only the first rows, which no task sorts but those."""
    if limit:
        return df.orderBy(*order).limit(limit).withColumn("rank_position", F.row_number().over(Window.orderBy(*order)))
    return in_order(df, list(order), position="rank_position").withColumn("rank_position", c("rank_position").cast("int"))
