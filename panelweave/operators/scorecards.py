"""Weights of factors: what is configured, what validation says, and both together.

Tables here have one row for each factor, a few hundred, so they are broadcast freely.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import KEY, TIME
from panelweave.operators import validation as va
from panelweave.operators.indicators import with_zscores
from panelweave.functions.columns import clamp

c = F.col

# Shares of the composite score, and the weight of the component that validation adds.
BLEND = {"ridge": 0.40, "ic": 0.15, "fm": 0.20, "mono": 0.15, "rest": 0.10}
VALIDATED_SHARE, MOST_T = 0.15, 5.0


def configured_weights(spark: SparkSession, components: dict[str, dict[str, tuple[float, bool]]], shares: dict[str, float]) -> DataFrame:
    """A row for each configured factor: ``component, feature_name, factor_weight, component_weight, higher_is_better``."""
    rows = [(n, f, float(w), float(shares.get(n, 0.0)), bool(up)) for n, own in components.items() for f, (w, up) in own.items()]
    return spark.createDataFrame(rows, "component string, feature_name string, factor_weight double, component_weight double, higher_is_better boolean")


def _spread(x: Column) -> Column:
    """Place between the least and the greatest value of all rows; one half where these are equal."""
    every = Window.partitionBy(F.lit(1))  # a row for each factor
    lo, hi = F.min(x).over(every), F.max(x).over(every)
    return F.when(lo.isNull() | (lo == hi), 0.5).otherwise((x - lo) / (hi - lo))


def validation_scores(ridge: DataFrame, ic: DataFrame | None = None, fm: DataFrame | None = None, mono: DataFrame | None = None) -> DataFrame:
    """``ridge`` (``feature_name, coefficient``) with ``validation_score``.

    ``ic`` (``horizon, rank_ic_mean``) counts at its shortest horizon, as do ``fm`` (``t``) and
    ``mono`` (``score``). With two of them or more the score is a blend, in which the share of one
    that is absent goes to the coefficient; otherwise it is the size of the coefficient. A blend
    with a missing part is missing.
    """
    first = lambda df, n: df.groupBy("feature_name").agg(F.min_by(n, "horizon").alias(f"_{n}")) if "horizon" in df.columns else df.select("feature_name", c(n).alias(f"_{n}"))
    out = ridge.withColumns({"abs_coefficient": F.abs("coefficient"), "higher_is_better": F.coalesce("coefficient", F.lit(0.0)) > 0})
    have = {}
    for kind, df, n in (("ic", ic, "rank_ic_mean"), ("fm", fm, "t"), ("mono", mono, "score")):
        if df is not None:
            out = out.join(F.broadcast(first(df, n)), "feature_name", "left")
            have[kind] = {"ic": F.abs(f"_{n}"), "fm": F.least(F.abs(f"_{n}"), F.when(c(f"_{n}").isNotNull(), F.lit(MOST_T))), "mono": c(f"_{n}")}[kind]
    if len(have) < 2:
        return out.withColumn("validation_score", c("abs_coefficient")).drop("_rank_ic_mean", "_t", "_score")
    spare = BLEND["rest"] + sum(w for k, w in BLEND.items() if k in ("ic", "fm", "mono") and k not in have)
    out = out.withColumns({"_ridge": c("abs_coefficient"), **{f"_{k}": x for k, x in have.items()}})
    total = _spread(c("_ridge")) * BLEND["ridge"] + spare
    for k in have:
        total = total + _spread(c(f"_{k}")) * BLEND[k]
    return out.withColumn("validation_score", F.when(total.isNotNull(), F.greatest(total, F.lit(0.0)))).drop("_ridge", "_rank_ic_mean", "_t", "_score", *[f"_{k}" for k in have])


def sanitized(scorecard: DataFrame, components: dict[str, str], numbers: Iterable[str] = ("validation_score", "recommended_weight", "coefficient")) -> DataFrame:
    """Infinite and NaN numbers as NULL; an empty component filled in by the name of the factor, or else ``validated``."""
    out = scorecard
    for n in numbers:
        if n in out.columns:
            x = F.expr(f"try_cast(`{n}` AS double)")
            out = out.withColumn(n, F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))
    known = F.create_map(*[F.lit(x) for kv in components.items() for x in kv])[c("feature_name")] if components else F.lit(None).cast("string")
    empty = c("component").isNull() | (F.trim("component") == "")
    return out.withColumn("component", F.when(empty, F.coalesce(known, F.lit("validated"))).otherwise(c("component")))


def usable(scorecard: DataFrame) -> DataFrame:
    """One row: whether any score is finite and positive."""
    x = c("validation_score")
    return scorecard.agg(F.coalesce(F.max(~F.isnan(x) & (F.abs(x) < float("inf")) & (x > 0)), F.lit(False)).alias("usable"))


def merged_weights(configured: DataFrame, scorecard: DataFrame) -> DataFrame:
    """The configuration with recommended weights: a factor stays in its component, a new one goes into that of the scorecard.

    A component of the scorecard counts if any of its weights is positive. Components without a
    configured weight of their own get the one of validated factors.
    """
    per = Window.partitionBy("component")
    said = scorecard.withColumn("_sum", F.sum("recommended_weight").over(per)).where((c("_sum") > 0) & c("recommended_weight").isNotNull())
    said = said.select("feature_name", c("component").alias("_component"), "recommended_weight", c("higher_is_better").alias("_up"))
    shares = configured.groupBy("component").agg(F.max("component_weight").alias("_share"))
    out = configured.join(said, "feature_name", "full_outer").withColumn("component", F.coalesce("component", "_component"))
    return out.join(F.broadcast(shares), "component", "left").select(
        "component", "feature_name", F.coalesce("recommended_weight", "factor_weight").alias("factor_weight"),
        F.coalesce("_share", F.lit(VALIDATED_SHARE)).alias("component_weight"), F.coalesce("higher_is_better", "_up", F.lit(True)).alias("higher_is_better"),
    )


def pruned(scorecard: DataFrame, correlations: DataFrame, threshold: float = 0.80) -> DataFrame:
    """``feature_name, place`` of the factors that are kept: from the largest coefficient down, those that none kept before resembles.

    A factor resembles another if their correlation is over ``threshold`` in size. Factors without
    correlations come last and are kept. Each step depends on the one before, so the names, at most
    a few hundred, are folded in one row.
    """
    both = correlations.select("feature_a", "feature_b").union(correlations.select("feature_b", "feature_a")).toDF("feature_name", "_other")
    alike = correlations.where(F.abs("correlation") > threshold).select("feature_a", "feature_b")
    alike = alike.union(alike.select("feature_b", "feature_a")).toDF("feature_name", "_other").groupBy("feature_name").agg(F.collect_set("_other").alias("_alike"))
    rows = scorecard.join(both.select("feature_name").distinct().withColumn("_known", F.lit(True)), "feature_name", "left").join(alike, "feature_name", "left")
    row = F.struct(c("_known").isNull().alias("late"), (-F.coalesce("abs_coefficient", F.lit(-1.0))).alias("size"), "feature_name", F.coalesce("_alike", F.array().cast("array<string>")).alias("alike"))
    kept = F.aggregate(F.array_sort(F.collect_list(row)), F.array().cast("array<string>"), lambda done, x: F.when(F.arrays_overlap(done, x["alike"]), done).otherwise(F.concat(done, F.array(x["feature_name"]))))
    return rows.agg(kept.alias("kept")).select(F.posexplode("kept").alias("place", "feature_name")).withColumn("place", c("place") + 1)


def single_security_scores(factors: DataFrame, coefficients: dict[str, float], window: int = 120, least: int = 30) -> DataFrame:
    """Sum of coefficient times the factor's z-score against its own history, for where there is no cross section.

    NULL until one factor has a z-score; after that a missing one counts as 0.
    """
    z = with_zscores(factors, {f"_z_{n}": c(n) for n in coefficients}, window, least)
    parts = [clamp(c(f"_z_{n}"), -3, 3) * w for n, w in coefficients.items()]
    total = sum(F.coalesce(p, F.lit(0.0)) for p in parts)
    return z.select(KEY, TIME, F.when(F.coalesce(*parts).isNotNull(), total).alias("raw"))


def coverage(long: DataFrame) -> DataFrame:
    """For each feature the securities, dates and values that it has."""
    return long.groupBy("feature_name").agg(F.count_distinct(KEY).alias("securities"), F.count_distinct(TIME).alias("dates"), F.count("*").alias("values"), F.avg("feature_value").alias("mean"))


def security_coverage(long: DataFrame) -> DataFrame:
    """For each security the features and values that it has, and the first and last date of them."""
    return long.groupBy(KEY).agg(F.count_distinct("feature_name").alias("features"), F.count("*").alias("values"), F.min(TIME).alias("first_date"), F.max(TIME).alias("last_date"))


def validation_report(long: DataFrame, bars: DataFrame, horizons: Iterable[int], q: int = 5, least: int = 5, dated: DataFrame | None = None, names: Iterable[str] = ()) -> dict[str, DataFrame]:
    """All tables of a validation, from features and bars; the joined frame is planned once and shared.

    With ``dated`` (``validation.by_dates`` of the features ``names``) correlations, buckets and turnover are made of that, in one exchange of
    a row for each security and date instead of one for each feature and horizon of it.
    Each table is a DataFrame; who needs several caches or saves ``frame`` and ``members`` first.
    """
    returns = va.forward_returns(bars, horizons)
    frame, members = va.validation_frame(long, returns), va.quantile_membership(long, q, least)
    ic, buckets = va.ic_by_date(frame, least), va.quantile_returns(members, returns, q, least)
    turnover = va.turnover_by_date(members)
    if dated is not None:
        names, horizons = list(names), list(horizons)
        ic, buckets, turnover = va.ic_of_set(dated, names, horizons, least), va.quantile_returns_of_set(dated, names, horizons, q, least), va.turnover_of_set(va.buckets_of_set(dated, names, q, least), names)
    spread = va.long_short(buckets)
    quantiles, summary = va.summarize_quantiles(buckets), va.summarize_ic(ic)
    return {
        "frame": frame, "members": members, "ic": ic, "ic_summary": summary, "monthly_ic": va.monthly_ic(ic), "quantile_returns": buckets, "quantile_summary": quantiles, "long_short": spread,
        "long_short_summary": va.summarize_long_short(spread), "turnover": turnover, "turnover_summary": va.summarize_turnover(turnover), "decay": va.decay(summary, "rank_ic_mean"),
        "correlation": va.factor_correlation(long), "rank_autocorrelation": va.rank_autocorrelation(long), "alpha_beta": va.alpha_beta(frame), "fama_macbeth": va.fama_macbeth(frame),
        "monotonicity": va.monotonicity(quantiles), "coverage": coverage(long), "security_coverage": security_coverage(long),
    }


def report_means(report: dict[str, DataFrame]) -> DataFrame:
    """One row: means over all features and horizons."""
    ic = report["ic_summary"].agg(F.avg("ic_mean").alias("mean_ic"), F.avg("rank_ic_mean").alias("mean_rank_ic"))
    spread = report["long_short_summary"].agg(F.avg("spread_mean").alias("mean_spread"))
    turnover = report["turnover_summary"].agg(F.avg("mean").alias("mean_turnover"))
    return ic.join(F.broadcast(spread)).join(F.broadcast(turnover))  # one row each


def turnover_step(before: DataFrame, now: DataFrame) -> DataFrame:
    """Turnover of one date against saved members of the date before, without the history: ``feature_name, bucket`` and counts.

    ``before`` and ``now`` have ``feature_name, bucket, stock_code`` of one date each. Buckets that had no members before are left out.
    """
    keys = ["feature_name", "bucket"]
    both = now.select(*keys, KEY, F.lit(1).alias("_now")).join(before.select(*keys, KEY, F.lit(1).alias("_then")), [*keys, KEY], "full_outer")
    own = both.groupBy(*keys).agg(F.count("_now").alias("size"), F.count("_then").alias("previous"), F.count(c("_now") + c("_then")).alias("retained"))
    return own.where((c("previous") > 0) & (c("size") > 0)).withColumns({"entered": c("size") - c("retained"), "exited": c("previous") - c("retained"), "turnover": 1 - c("retained") / F.greatest("size", "previous")})
