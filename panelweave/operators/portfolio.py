"""Ranking of securities, choice of picks, their weights and what becomes of them.

A snapshot has one row for each security: ``current_signal_active, current_signal_actionable,
current_signal_score, expected_3m_score, matrix_score, regime_score, signal_tier, setup_type,
setup_score, sideways_penalty, low_price_candidate, freshness, backtest_return``. Signals have the
same scores for each date, ``actionable, signal_strength, risk_score`` and the returns that follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import EPSILON, KEY, TIME
from panelweave.operators.scoring import daily_top, pick_weights
from panelweave.operators.setups import ranked

c = F.col

# What a setup adds to the ranking score, and the setups worth waiting for.
SETUP_BONUS = {"pre_breakout": 18.0, "bottom_rebound": 20.0, "neutral": 0.0, "sideways": -16.0}
WANTED = ("pre_breakout", "bottom_rebound")
SNAPSHOT = ("setup_type", "setup_score", "sideways_penalty", "low_price_candidate", "freshness")


def _zero(n: str) -> Column:
    return F.coalesce(c(n), F.lit(0.0))


def _yes(rule: Column, missing: bool = False) -> Column:
    return F.coalesce(rule, F.lit(missing))


def _fit() -> Column:
    """Whether a security is cheap enough: as it says, or unless it goes sideways."""
    return F.coalesce(c("low_price_candidate"), _yes(c("setup_type") != "sideways", True))


def ranking_score() -> Column:
    """Active signals first; then weighted scores, the setup and its freshness, less the penalty for going sideways."""
    bonus = F.coalesce(F.create_map(*[F.lit(x) for kv in SETUP_BONUS.items() for x in kv])[F.coalesce("setup_type", F.lit("neutral"))], F.lit(0.0))
    active = F.when(_yes(c("current_signal_active") & c("current_signal_actionable")), 100.0).otherwise(0.0)
    scores = _zero("current_signal_score") * 0.50 + _zero("expected_3m_score") * 0.20 + _zero("matrix_score") * 0.15 + _zero("regime_score") * 0.15
    return active + scores + bonus + _zero("setup_score") * 0.18 + _zero("freshness") * 0.10 + F.when(_fit(), 8.0).otherwise(-22.0) - _zero("sideways_penalty") * 0.90


def order_of_rank() -> list[Column]:
    """By ranking score, then other scores, of which a missing one counts as -1, then what a backtest gave."""
    low = lambda n: F.coalesce(c(n), F.lit(-1.0)).desc()
    return [F.desc("ranking_score"), low("current_signal_score"), low("regime_score"), low("matrix_score"), F.desc_nulls_last("backtest_return"), F.asc(KEY)]


def rank_securities(snapshot: DataFrame, n: int | None = None) -> DataFrame:
    """The snapshot with ``ranking_score`` and ``place``; only the first ``n`` where it is given."""
    scored = snapshot.withColumn("ranking_score", F.round(ranking_score(), 9))
    return ranked(scored, *order_of_rank(), limit=n).withColumnRenamed("rank_position", "place")


def signal_rows(signals: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Signals whose return after 60 bars is known, with what the snapshot says of their security today."""
    return signals.where("forward_return_60 IS NOT NULL").join(snapshot.select(KEY, *SNAPSHOT), KEY)


def eligible(rows: DataFrame) -> DataFrame:
    """Actionable signals of securities that are fresh, cheap and don't go sideways."""
    return rows.where(_yes(c("actionable")) & (_zero("freshness") >= 35) & _yes(c("low_price_candidate"), True) & _yes(c("setup_type") != "sideways", True))


def selection_score() -> Column:
    good = c("expected_3m_score") * 0.50 + c("matrix_score") * 0.22 + c("regime_score") * 0.12 + c("signal_strength") * 3.0 + _zero("setup_score") * 0.18 + _zero("freshness") * 0.10
    return good - c("risk_score") * 4.0 - _zero("sideways_penalty") * 1.10 - F.abs("max_drawdown_60") * 100 * 0.35


def daily_picks(rows: DataFrame, n: int, equal: bool = True) -> DataFrame:
    """The first ``n`` eligible signals of each date by selection score, with weights that sum to 1."""
    scored = eligible(rows).withColumn("selection_score", F.round(selection_score(), 9))
    order = [F.desc_nulls_last(x) for x in ("selection_score", "expected_3m_score", "matrix_score", "regime_score", "signal_strength")]
    return pick_weights(daily_top(scored, n, [*order, F.asc(KEY)]), "selection_score", equal)


def contributions(picks: DataFrame) -> DataFrame:
    return picks.select(KEY, TIME, (c("forward_return_60") * 100).alias("contribution_return"), "selection_score")


def estimate(picks: DataFrame) -> DataFrame:
    """Mean return in percent of all picks, the share of them that gain, in percent, and their number."""
    r = c("contribution_return")
    return contributions(picks).agg(F.coalesce(F.avg(r), F.lit(0.0)).alias("mean_return"), F.coalesce(F.avg(F.when(r > 0, 100.0).otherwise(0.0)), F.lit(0.0)).alias("win_rate"), F.count("*").alias("picks"))


def period_returns(picks: DataFrame) -> DataFrame:
    """The weighted return of each date's picks."""
    return picks.groupBy(TIME).agg(F.sum(c("weight") * c("forward_return_60")).alias("period_return"), F.count("*").alias("picks"))


def _first_tier(candidates: DataFrame, tiers: list[Column], n: int) -> DataFrame:
    """The first ``n`` by place of the first tier that isn't empty."""
    rank = F.coalesce(*[F.when(_yes(t), F.lit(i)) for i, t in enumerate(tiers)])
    tagged = candidates.withColumn("tier", rank).where("tier IS NOT NULL")
    best = tagged.agg(F.min("tier").alias("tier"))
    return tagged.join(F.broadcast(best), "tier").orderBy("place").limit(n)


def selected(ranking: DataFrame, n: int) -> DataFrame:
    """Active signals with a wanted setup; or else active ones; or else those that aren't weak; or else any; the first ``n``."""
    active = c("current_signal_active") & c("current_signal_actionable")
    fresh, moves = F.coalesce(c("freshness"), F.lit(100.0)), _yes(c("setup_type") != "sideways", True)
    tiers = [active & _yes(c("low_price_candidate"), True) & (fresh >= 40) & c("setup_type").isin(*WANTED), active & (fresh >= 35) & moves, _yes(c("signal_tier") != "weak", True) & (fresh >= 30) & moves, F.lit(True)]
    return _first_tier(ranking, tiers, n)


def watchlist(ranking: DataFrame, n: int) -> DataFrame:
    """Weak signals with a wanted setup; or else weak signals; the first ``n``."""
    weak = c("signal_tier") == "weak"
    return _first_tier(ranking, [weak & c("setup_type").isin(*WANTED), weak], n)


def allocate(chosen: DataFrame, capital: float, equal: bool = True) -> DataFrame:
    """Weights of the chosen that sum to 1, and their capital; by ranking score unless ``equal``, where it is positive."""
    value = F.greatest(_zero("ranking_score"), F.lit(0.0))
    sums = chosen.agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    weight = F.when(F.lit(not equal) & (c("_sum") > EPSILON), value / c("_sum")).otherwise(1 / c("_n"))
    return chosen.join(F.broadcast(sums)).withColumn("weight", weight).withColumn("capital", c("weight") * capital).drop("_sum", "_n")


def planned_exits(bars: DataFrame, picks: DataFrame, horizon: int = 60) -> DataFrame:
    """When each pick is bought, at the next open, and the last bar that it is held; picks on a last bar are left out.

    ``holding_horizon`` of a pick goes before ``horizon``; a position is held one bar at least.
    """
    nth = bars.select(KEY, TIME, "open", F.row_number().over(Window.partitionBy(KEY).orderBy(TIME)).alias("_nth")).withColumn("_last", F.max("_nth").over(Window.partitionBy(KEY)))
    h = F.greatest(F.coalesce(c("holding_horizon"), F.lit(horizon)) if "holding_horizon" in picks.columns else F.lit(horizon), F.lit(1))
    at = picks.select(KEY, TIME, h.alias("_h")).join(nth.select(KEY, TIME, "_nth", "_last"), [KEY, TIME]).where("_nth < _last")
    at = at.withColumns({"_in": c("_nth") + 1, "_out": F.least(c("_nth") + c("_h"), c("_last"))})
    enter = nth.select(KEY, c("_nth").alias("_in"), c(TIME).alias("entry_date"), c("open").alias("entry_price"))
    leave = nth.select(KEY, c("_nth").alias("_out"), c(TIME).alias("exit_date"))
    return at.join(enter, [KEY, "_in"]).join(leave, [KEY, "_out"]).select(KEY, c(TIME).alias("signal_date"), "entry_date", "entry_price", "exit_date")


def trading_score() -> Column:
    """The plainer score of the trading table: active signals first, then weighted scores."""
    active = F.when(_yes(c("current_signal_active") & c("current_signal_actionable")), 100.0).otherwise(0.0)
    return active + _zero("current_signal_score") * 0.50 + _zero("expected_3m_score") * 0.20 + _zero("matrix_score") * 0.15 + _zero("regime_score") * 0.15


def trading_table(snapshot: DataFrame, n: int | None = None) -> DataFrame:
    """Securities that have a backtest, by ``trading_score``; with their ``place``, the first ``n`` where it is given."""
    low = lambda x: F.coalesce(c(x), F.lit(-1.0)).desc()
    scored = snapshot.where("backtest_return IS NOT NULL").withColumn("ranking_score", F.round(trading_score(), 9))
    order = [F.desc("ranking_score"), low("current_signal_score"), low("matrix_score"), F.desc("backtest_return"), F.asc(KEY)]
    return ranked(scored, *order, limit=n).withColumnRenamed("rank_position", "place")


def batch_review(rows: DataFrame, batch_id: str) -> DataFrame:
    """How many rows of each kind a batch has, and their mean score, 0 where there are none."""
    own = rows.where(c("batch_id") == batch_id)
    kinds, made = ("ranking", "selected", "watchlist"), []
    for k in kinds:
        mine = c("signal_type") == k
        made += [F.count(F.when(mine, 1)).alias(f"{k}_count"), F.coalesce(F.avg(F.when(mine, c("score"))), F.lit(0.0)).alias(f"{k}_mean_score")]
    return own.agg(F.lit(batch_id).alias("batch_id"), *made)


def batch_picks(rows: DataFrame, batch_id: str) -> DataFrame:
    """The securities that a batch selected, with their places."""
    return rows.where((c("batch_id") == batch_id) & (c("signal_type") == "selected")).select("rank_position", KEY, "score")
