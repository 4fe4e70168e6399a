"""Scores, picks and trade outcomes over daily bars, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.columns import KEY, TIME
from panelweave.functions.passes import BAR
from panelweave.operators import factors, indicators as ti, scoring as sc, setups as sg, validation as va
from panelweave.plans import setup_queries as sq, validation_queries as vq
from panelweave.plans.common import bars, over, rounded, with_bars
from panelweave.plans.indicator_queries import CTE as INDICATORS, WINDOWS as NAMED

FACTORS = {"MA5": False, "ROC10": False, "VMA20": True, "KMID": True}
COMPONENTS = {"trend": {"MA5": 0.6, "ROC10": 0.4}, "quality": {"VMA20": 1.0}, "risk": {"KMID": 1.0}, "validated": {}}
FACTOR_COMPONENT = {f: n for n, w in COMPONENTS.items() for f in w}
SHARES = {"trend": 0.5, "quality": 0.3, "risk": 0.2, "validated": 0.15}
CARD = ("ic_mean", "rank_ic_mean", "ic_positive", "rank_ic_positive", "spread_mean", "turnover", "score")
c = F.col


def scores(s, d, turn=False):
    """``turn`` keeps the mark that rows are in turn, for further passes."""
    rows = factors.compute(bars(s, d), FACTORS, keep=("_at",)).withColumnRenamed("_at", BAR)
    out = sc.factor_scores(rows, FACTORS)
    return out if turn else out.drop(BAR)


def composite(s, d, turn=False):
    return sc.composite(scores(s, d, turn), COMPONENTS, SHARES)


def signals(s, d):
    return sc.signals(composite(s, d, turn=True)).drop(BAR)


def outcomes(s, d, sells=False):
    """What becomes of each signal, a bar with a range breakout, the first of a zone of twenty days: setups and trades come from ordered passes over the same bars."""
    rows = bars(s, d)
    if sells:
        rows = ti.windowed_indicators(rows, turn=True, names=sc.BEARISH).withColumn("_sell", sc.bearish_strength().isNotNull()).drop(*sc.BEARISH)
    rows = sc.with_outcomes(rows, sell="_sell" if sells else None)
    events = sg.setup_events(sg.with_recipes(sg.setup_features(rows, sq.BOUNDS, sc.OUTCOME)), keep=sc.OUTCOME, recipes=("range_breakout",))
    return sc.taken(sg.zone_starts(events, 20))


#: Ways out of a trade where there are sell signals.
REASONS = ("stop", "trailing", "time", "strategy_sell", "held")


def sells(s, d):
    return sc.high_volume_bearish_sells(ti.windowed_indicators(bars(s, d)))


def strategy_trades(s, d):
    """Each buy of the trend strategy on its own terms, until its sell rule or another exit."""
    out = sc.trade_outcomes(bars(s, d), trend_2560(s, d), sells=sells(s, d))
    return out.withColumn("net_return", sc.net_return(c("trade_return")))


def trades(s, d, sells=False):
    return outcomes(s, d, sells).withColumn("net_return", sc.net_return(c("trade_return")))


def picks(s, d):
    order = [F.desc("composite"), F.desc_nulls_last("quality"), F.asc(KEY)]
    return sc.pick_weights(sc.daily_top(signals(s, d).where("actionable"), 5, order), "composite")


def tiers(s, d):
    now = sg.latest(composite(s, d)).where("composite IS NOT NULL")
    return sc.tiered(now, [c("composite") >= 90, c("composite") >= 60, F.lit(True)], 10, [F.desc("composite"), F.asc(KEY)]).select(KEY, TIME, "composite", "tier_rank", "place")


def cross_section(s, d):
    coef = s.createDataFrame([("KMID", 0.5), ("MA5", -1.0), ("ROC10", 0.25)], "feature_name string, coefficient double")
    out = sc.cross_section_scores(vq.features(s, d), coef)
    return out.withColumn("raw", F.round("raw", 9)).withColumn("percentile", sc.percentile_of_date(out, "raw"))


def ridge(s, d):
    wide = factors.compute(bars(s, d), FACTORS).join(va.forward_returns(bars(s, d), [5]).select(KEY, TIME, "forward_return"), [KEY, TIME])
    return sc.ridge(wide, list(FACTORS), "forward_return")


def scorecard(s, d):
    rows = vq.dated(s, d)
    return sc.scorecard(va.summarize_ic(vq._ic(s, d, rows)), va.summarize_long_short(va.long_short(vq._buckets(s, d, rows))), va.summarize_turnover(vq._turnover(s, d, rows)), FACTOR_COMPONENT)


def whole_scorecard(s, d):
    rows = vq.dated(s, d)
    ic, spread = va.summarize_ic(vq._ic(s, d, rows)), va.summarize_long_short(va.long_short(vq._buckets(s, d, rows)))
    return sc.scorecard(ic, spread, va.summarize_turnover(vq._turnover(s, d, rows)), FACTOR_COMPONENT, va.decay_summary(ic, spread))


def top_factors(s, d):
    """The features whose slopes over five bars are the largest."""
    slopes = vq._slopes(s, d).where("horizon = 5").select("feature_name", c("slope").alias("coefficient"))
    return sc.select_top(slopes, 3, 1e-4).withColumns({"higher_is_better": c("coefficient") > 0, "component": factors.component(c("feature_name"))})


def trend_2560(s, d):
    return sc.trend_2560_buys(ti.at_once(bars(s, d), sc.TREND, sc.TREND_NEAR, only=sc.rising))


def asof(s, d):
    wanted = bars(s, d).select(KEY).distinct().withColumn(TIME, F.explode(F.sequence(F.lit("1993-01-01").cast("date"), F.lit("1998-01-01").cast("date"), F.expr("interval 3 months"))))
    return sc.price_asof(bars(s, d), wanted)


QUERIES = {
    "sc_factor_scores": lambda s, d: rounded(scores(s, d), 4),
    "sc_composite": lambda s, d: rounded(composite(s, d).select(KEY, TIME, "trend", "quality", "risk", "composite"), 4),
    "sc_cross_section": lambda s, d: rounded(cross_section(s, d), 5),
    "sc_explanation": lambda s, d: rounded(sc.explanation(scores(s, d), {"MA5": 0.6, "ROC10": 0.4, "VMA20": 1.0, "KMID": 0.2}), 4),
    "sc_signals": lambda s, d: rounded(signals(s, d).select(KEY, TIME, "actionable", "tier"), 4),
    "sc_signal_summary": lambda s, d: rounded(sc.signal_summary(signals(s, d).join(sg.forward_metrics(bars(s, d)), [KEY, TIME]), "forward_return_20"), 5),
    "sc_snapshot": lambda s, d: rounded(sg.latest(bars(s, d).withColumn("change_30", F.coalesce((F.try_divide(c("close"), F.lag("close", 29).over(sg.security())) - 1) * 100, F.lit(0.0)))).select(KEY, TIME, "change_30", sc.freshness(c(TIME), F.lit("1998-12-01").cast("date")).alias("freshness"))),
    "pf_daily_picks": lambda s, d: rounded(picks(s, d).select(KEY, TIME, "place", "candidates", "weight"), 5),
    "pf_tiers": lambda s, d: rounded(tiers(s, d), 4),
    "to_trades": lambda s, d: rounded(outcomes(s, d).select(KEY, "signal_date", "exit_date", "exit_reason", "trade_return")),
    "to_trade_summary": lambda s, d: rounded(sc.trade_summary(trades(s, d)), 5),
    "to_non_overlapping": lambda s, d: rounded(sc.trade_summary(sc.non_overlapping(trades(s, d, sells=True)), REASONS), 5),
    "to_one_position": lambda s, d: rounded(sc.non_overlapping(trades(s, d)).select(KEY, "signal_date", "exit_date", "net_return")),
    "to_strategy_trades": lambda s, d: rounded(strategy_trades(s, d).drop("net_return")),
    "to_strategy_summary": lambda s, d: rounded(sc.trade_summary(sc.non_overlapping(strategy_trades(s, d)), REASONS), 5),
    "to_price_asof": asof,
    "st_volume_cross": lambda s, d: sc.volume_cross_buys(ti.windowed_indicators(bars(s, d))),
    "st_high_volume_sell": lambda s, d: sc.high_volume_sells(bars(s, d)),
    "st_trend_2560": lambda s, d: rounded(trend_2560(s, d)),
    "st_high_volume_bearish": lambda s, d: sc.high_volume_bearish_sells(ti.windowed_indicators(bars(s, d))),
    "wt_ridge": lambda s, d: rounded(ridge(s, d)),
    "wt_scorecard": lambda s, d: rounded(scorecard(s, d).select("feature_name", "component", *CARD, "recommended_weight"), 4),
    "wt_scorecard_whole": lambda s, d: rounded(whole_scorecard(s, d), 4),
    "sc_top_factors": lambda s, d: rounded(top_factors(s, d), 5),
}


def _z(x: str) -> str:
    full = lambda agg: f"CASE WHEN count({x}) OVER w >= 30 THEN {agg}({x}) OVER w END"
    return f"({x} - ({full('avg')})) / (CASE WHEN ({full('stddev_samp')}) > 1e-12 THEN ({full('stddev_samp')}) END)"


def _clip(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END)"


_W = {"trend": {"MA5": 0.6, "ROC10": 0.4}, "quality": {"VMA20": 1.0}, "risk": {"KMID": 1.0}}
_comp = lambda n: "(" + " + ".join(f"coalesce({f} * {w}, 0)" for f, w in _W[n].items()) + ") / nullif(" + " + ".join(f"CASE WHEN {f} IS NOT NULL THEN {w} ELSE 0 END" for f, w in _W[n].items()) + ", 0)"
SCORES = vq.BASE + ", z AS (SELECT stock_code, trade_date, " + ", ".join(f"{_z(n)} AS {n}" for n in FACTORS) + f" FROM wide WINDOW w AS {over(120)})" + (
    ", sc AS (SELECT stock_code, trade_date, " + ", ".join((f"{_clip('50 + ' + _clip(n, -3, 3) + ' * 12', 0, 100)}" if up else f"100 - {_clip('50 + ' + _clip(n, -3, 3) + ' * 12', 0, 100)}") + f" AS {n}" for n, up in FACTORS.items()) + " FROM z)"
    + ", co AS (SELECT *, " + ", ".join(f"{_comp(n)} AS {n}" for n in _W) + " FROM sc)"
    + ", cm AS (SELECT *, (coalesce(trend * 0.5, 0) + coalesce(quality * 0.3, 0) + coalesce(risk * 0.2, 0)) / nullif(CASE WHEN trend IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN risk IS NOT NULL THEN 0.2 ELSE 0 END, 0) AS composite FROM co)"
    + ", sg AS (SELECT *, "
    + " AND ".join(f"coalesce(round({n}, 9) >= round(coalesce(CASE WHEN count({n}) OVER w60 >= 20 THEN quantile_cont({n}, {q}) OVER w60 END, {floor}), 9), false)" for n, q, floor in (("composite", 0.8, 70), ("quality", 0.65, 55), ("risk", 0.45, 55)))
    + f" AS actionable, CASE WHEN composite >= 75 THEN 'strong' WHEN composite >= 60 THEN 'medium' ELSE 'weak' END AS tier FROM cm WINDOW w60 AS {over(60)})"
)
PICKS = SCORES + """, pk AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY composite DESC, quality DESC NULLS LAST, stock_code) AS place, count(*) OVER (PARTITION BY trade_date) AS candidates FROM sg WHERE actionable),
  pw AS (SELECT *, composite / sum(composite) OVER (PARTITION BY trade_date) AS weight FROM pk WHERE place <= 5)"""
TRADES = sq.CTE + """, en AS (SELECT stock_code, trade_date FROM (SELECT *, CASE WHEN lag(trade_date) OVER w IS NULL OR trade_date - lag(trade_date) OVER w > 20 THEN 1 ELSE 0 END AS fresh FROM ev WHERE recipe = 'range_breakout' WINDOW w AS (PARTITION BY stock_code, recipe, setup_type ORDER BY trade_date)) WHERE fresh = 1),
  nb AS (SELECT stock_code, trade_date, open, close, row_number() OVER (PARTITION BY stock_code ORDER BY trade_date) AS i, count(*) OVER (PARTITION BY stock_code) AS last FROM bars),
  ph AS (SELECT nb.stock_code, s.trade_date AS signal_date, nb.i - s.i AS held, nb.i, nb.last, nb.trade_date, nb.open, nb.close FROM en JOIN nb s USING (stock_code, trade_date) JOIN nb ON nb.stock_code = s.stock_code AND nb.i BETWEEN s.i + 1 AND s.i + 21),
  pp AS (SELECT *, first_value(open) OVER w AS entry, max(close) OVER w AS peak, lead(open) OVER w AS next_open, lead(trade_date) OVER w AS next_date FROM ph WINDOW w AS (PARTITION BY stock_code, signal_date ORDER BY i)),
  pr AS (SELECT *, CASE WHEN i < last AND next_open IS NOT NULL THEN CASE WHEN close <= entry * (1 - 0.08) THEN 'stop' WHEN close <= peak * 0.9 AND close > entry * (1 + 0.05) THEN 'trailing' WHEN held >= 20 THEN 'time' END END AS reason FROM pp),
  tr AS (SELECT stock_code, signal_date, any_value(entry) AS entry, coalesce(arg_min(next_date, i) FILTER (reason IS NOT NULL), max(trade_date)) AS exit_date, coalesce(arg_min(next_open, i) FILTER (reason IS NOT NULL), arg_max(close, i)) AS exit,
    coalesce(arg_min(reason, i) FILTER (reason IS NOT NULL), 'held') AS exit_reason FROM pr GROUP BY ALL),
  tn AS (SELECT *, exit / entry - 1 AS trade_return, (exit / entry) * (1 - 0.001) * (1 - 0.0003) / ((1 + 0.001) * (1 + 0.0003)) - 1 AS net_return FROM tr)"""
_SUM = vq._ic_sql().removeprefix("WITH ")
SQL = {
    "to_one_position": TRADES.replace("WITH ", "WITH RECURSIVE ", 1) + """, op AS (SELECT stock_code, min(signal_date) AS signal_date FROM tn GROUP BY 1
      UNION ALL SELECT n.stock_code, min(n.signal_date) FROM op JOIN tn o ON o.stock_code = op.stock_code AND o.signal_date = op.signal_date JOIN tn n ON n.stock_code = o.stock_code AND n.signal_date > o.exit_date GROUP BY 1)
      SELECT stock_code, signal_date, exit_date, round(net_return, 6) + 0.0 AS net_return FROM tn JOIN op USING (stock_code, signal_date)""",
    "sc_factor_scores": SCORES + " SELECT stock_code, trade_date, " + ", ".join(f'round({n}, 4) + 0.0 AS "{n}"' for n in FACTORS) + " FROM sc",
    "sc_composite": SCORES + " SELECT stock_code, trade_date, " + ", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in ("trend", "quality", "risk", "composite")) + " FROM cm",
    "sc_signals": SCORES + " SELECT stock_code, trade_date, actionable, tier FROM sg",
    "sc_explanation": SCORES + """, n AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) = 1),
      l AS (SELECT stock_code, trade_date, feature_name, contribution FROM (SELECT stock_code, trade_date, MA5 * 0.6 AS "MA5", ROC10 * 0.4 AS "ROC10", VMA20 AS "VMA20", KMID * 0.2 AS "KMID" FROM n) UNPIVOT (contribution FOR feature_name IN ("MA5", "ROC10", "VMA20", "KMID"))),
      r AS (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY contribution DESC, feature_name) AS from_top, row_number() OVER (PARTITION BY stock_code ORDER BY contribution, feature_name) AS from_bottom FROM l)
      SELECT stock_code, trade_date, feature_name, round(contribution, 4) + 0.0 AS contribution, CAST(from_top AS INT) AS from_top, CAST(from_bottom AS INT) AS from_bottom FROM r WHERE from_top <= 2 OR from_bottom <= 2""",
    "sc_signal_summary": SCORES + """, f AS (SELECT sg.*, x FROM sg JOIN (SELECT stock_code, trade_date, lead(close, 20) OVER (PARTITION BY stock_code ORDER BY trade_date) / close - 1 AS x FROM bars) USING (stock_code, trade_date))
      SELECT stock_code, round(avg(x) FILTER (actionable), 5) + 0.0 AS mean_outcome, round(count(*) FILTER (actionable AND x > 0) / nullif(count(x) FILTER (actionable), 0), 5) AS win_rate, count(x) FILTER (actionable) AS n, round(avg(x) FILTER (NOT actionable), 5) + 0.0 AS mean_other FROM f GROUP BY 1""",
    "sc_snapshot": with_bars() + """ SELECT stock_code, trade_date, round(change_30, 6) + 0.0 AS change_30, greatest(0.0, 100.0 - 4 * (DATE '1998-12-01' - trade_date)) + 0.0 AS freshness FROM (
      SELECT stock_code, trade_date, coalesce((close / lag(close, 29) OVER (PARTITION BY stock_code ORDER BY trade_date) - 1) * 100, 0) AS change_30, row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) AS k FROM bars) WHERE k = 1""",
    "sc_cross_section": vq.BASE + """, z AS (SELECT *, (feature_value - avg(feature_value) OVER g) / (CASE WHEN stddev_samp(feature_value) OVER g > 1e-12 THEN stddev_samp(feature_value) OVER g END) AS z FROM feats WINDOW g AS (PARTITION BY feature_name, trade_date)),
      r AS (SELECT stock_code, trade_date, round(sum(CASE WHEN z IS NOT NULL THEN least(greatest(z, -3), 3) END * CASE feature_name WHEN 'KMID' THEN 0.5 WHEN 'MA5' THEN -1.0 ELSE 0.25 END), 9) AS raw FROM z WHERE feature_name <> 'VMA20' GROUP BY ALL)
      SELECT stock_code, trade_date, round(raw, 5) + 0.0 AS raw, round((rank() OVER (PARTITION BY trade_date ORDER BY raw NULLS FIRST) + (count(*) OVER (PARTITION BY trade_date, raw) - 1) / 2) / nullif(count(raw) OVER (PARTITION BY trade_date), 0) * 100, 5) AS percentile FROM r""",
    "pf_daily_picks": PICKS + " SELECT stock_code, trade_date, CAST(place AS INT) AS place, candidates, round(weight, 5) + 0.0 AS weight FROM pw",
    "pf_tiers": SCORES + """, n AS (SELECT *, CASE WHEN composite >= 90 THEN 0 WHEN composite >= 60 THEN 1 ELSE 2 END AS tier_rank FROM (SELECT * FROM cm QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) = 1) WHERE composite IS NOT NULL)
      SELECT stock_code, trade_date, round(composite, 4) + 0.0 AS composite, tier_rank, CAST(row_number() OVER (ORDER BY composite DESC, stock_code) AS INT) AS place FROM n WHERE tier_rank = (SELECT min(tier_rank) FROM n) QUALIFY row_number() OVER (ORDER BY composite DESC, stock_code) <= 10""",
    "to_trades": TRADES + " SELECT stock_code, signal_date, exit_date, exit_reason, round(trade_return, 6) + 0.0 AS trade_return FROM tn",
    "to_trade_summary": TRADES + """ SELECT stock_code, count(*) AS trades, count(*) FILTER (net_return > 0) AS wins, round(avg(net_return), 5) + 0.0 AS mean_return, round(product(1 + net_return) - 1, 5) + 0.0 AS compounded,
      count(*) FILTER (exit_reason = 'stop') AS n_stop, count(*) FILTER (exit_reason = 'trailing') AS n_trailing, count(*) FILTER (exit_reason = 'time') AS n_time, count(*) FILTER (exit_reason = 'held') AS n_held FROM tn GROUP BY 1""",
    "to_price_asof": with_bars() + """ SELECT w.stock_code, w.trade_date, b.close AS price FROM (SELECT stock_code, CAST(unnest(generate_series(DATE '1993-01-01', DATE '1998-01-01', INTERVAL 3 MONTH)) AS DATE) AS trade_date FROM (SELECT DISTINCT stock_code FROM bars)) w
      ASOF LEFT JOIN bars b ON w.stock_code = b.stock_code AND w.trade_date >= b.trade_date""",
    "st_volume_cross": INDICATORS + """ SELECT stock_code, trade_date, close AS "close", CASE WHEN volume_cross THEN 'cross' ELSE 'recent' END AS mode FROM (SELECT *, max(CASE WHEN volume_cross THEN 1 ELSE 0 END) OVER (PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent FROM i3)
      WHERE recent = 1 AND ma25 > ma60 AND ma25_slope > 0 AND close >= ma25 * 0.97""",
    "st_high_volume_sell": with_bars() + f""" SELECT stock_code, trade_date, close AS "close", 5 + h20 + h60 AS strength FROM (SELECT *, CASE WHEN high >= max(high) OVER w20 * 0.98 THEN 1 ELSE 0 END AS h20, CASE WHEN high >= max(high) OVER w60 * 0.98 THEN 1 ELSE 0 END AS h60,
      coalesce(volume >= 1.8 * CASE WHEN count(volume) OVER w20 = 20 THEN avg(volume) OVER w20 END OR volume >= max(volume) OVER w20, false) AS loud FROM bars WINDOW {NAMED}) WHERE close < open AND loud AND h20 + h60 > 0""",
    "st_high_volume_bearish": INDICATORS + """ SELECT stock_code, trade_date, close AS "close", 5 + CASE WHEN upper_shadow >= 0.28 THEN 1 ELSE 0 END + CASE WHEN volume_ratio_10 >= 1.8 THEN 1 ELSE 0 END + CASE WHEN distance_high_20 >= -0.01 OR bb_position >= 0.92 THEN 1 ELSE 0 END AS strength FROM i3
      WHERE (close < open OR intraday_return < 0) AND (distance_high_20 >= -0.03 OR distance_high_60 >= -0.05 OR bb_position >= 0.78 OR return_60 >= 0.18) AND (volume_ratio_10 >= 1.35 OR volume_spike >= 1.6)""",
}
SQL["sc_top_factors"] = vq.SQL["va_fama_macbeth"].rpartition(" SELECT feature_name, horizon, round(m, 5)")[0] + """ SELECT feature_name, round(m, 5) + 0.0 AS coefficient, m > 0 AS higher_is_better, CASE feature_name WHEN 'MA5' THEN 'trend' WHEN 'ROC10' THEN 'trend' ELSE 'quality' END AS component
  FROM g WHERE horizon = 5 AND abs(m) >= 1e-4 ORDER BY abs(m) DESC, feature_name LIMIT 3"""
