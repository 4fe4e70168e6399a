"""Scorecards, windows and reports, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.columns import KEY, TIME
from panelweave.functions.positions import pinned
from panelweave.operators import factors, indicators as ti, layers as ly, reports as rp, scorecards as wt, scoring as sc, setups as sg, validation as va
from panelweave.plans import layer_queries as lq, score_queries as pq, validation_queries as vq
from panelweave.plans.common import bars, over, past_ties, rounded, with_bars
from panelweave.plans.indicator_queries import CTE as INDICATORS

c = F.col
#: A configuration: factors of each component with their weights and whether more is better.
CONFIG = {"trend": {"MA5": (0.6, False), "ROC10": (0.4, False)}, "quality": {"VMA20": (1.0, True)}, "risk": {"STD20": (1.0, False)}}
#: Coefficients as a ridge regression might give them.
RIDGE = {"KMID": 0.9, "MA5": -0.5, "ROC10": 0.45, "VMA20": 0.05}


def ridge_rows(s):
    return s.createDataFrame([(n, x) for n, x in RIDGE.items()], "feature_name string, coefficient double")


def monotone(s, d, rows=None):
    return va.monotonicity(va.summarize_quantiles(vq._buckets(s, d, rows)))


def buy_points(s, d):
    """Scores of the buys of the trend strategy; these and the volatility of a security's last bars come from one pass."""
    near = sc.TREND_NEAR | rp.LATE
    rows = ti.at_once(bars(s, d), (*sc.TREND, *rp.BUY_POINT), near, only=lambda b: sc.rising(b) | near["_late"][1](b))
    return rp.marked_buy_points(rows.withColumnRenamed("atr20", "volatility").withColumn("signal_strength", F.when(sc.trend_2560(), sc.trend_strength())))


def validation_scores(s, d):
    rows = vq.dated(s, d)
    return wt.validation_scores(ridge_rows(s), va.summarize_ic(vq._ic(s, d, rows)), vq._slopes(s, d, rows), monotone(s, d, rows))


def card(s, d):
    """Scores with a component: that of the configuration, or else none yet."""
    names = {f: n for n, own in CONFIG.items() for f in own}
    out = validation_scores(s, d).withColumn("component", F.when(c("feature_name") == "VMA20", " ").otherwise(F.lit(None).cast("string")))
    return wt.sanitized(out, names)


def merged(s, d):
    own = card(s, d).withColumn("recommended_weight", c("validation_score"))
    return wt.merged_weights(wt.configured_weights(s, CONFIG, pq.SHARES), own)


def pruned(s, d):
    return wt.pruned(ridge_rows(s).withColumn("abs_coefficient", F.abs("coefficient")), va.factor_correlation(vq.features(s, d)), 0.3)


def step(s, d):
    m = vq._members(s, d)
    return wt.turnover_step(m.where(f"{TIME} = DATE '1995-03-01'"), m.where(f"{TIME} = DATE '1995-03-02'"))


def feature_set(s, d):
    """Evaluation of stored features."""
    long = ly.read_layer(lq.features(s, d), "features", {"feature_set": "shapes"}, [KEY, TIME, "feature_name", "feature_value"])
    return va.summarize_ic(va.ic_by_date(va.validation_frame(long, va.forward_returns(bars(s, d), (1, 5)))))


def suite(s, d):
    t = pinned(pq.trades(s, d).select(KEY, "signal_date", "net_return"))  # read for each strategy
    return {"breakouts": t, "recent": t.where("signal_date >= DATE '1996-01-01'")}


def alignment(s, d):
    ind = ti.windowed_indicators(bars(s, d)).withColumn("volume_ma10", c("volume_ma10"))
    targets = bars(s, d).select(KEY).distinct().withColumn(TIME, F.explode(F.sequence(F.lit("1995-01-02").cast("date"), F.lit("1997-01-01").cast("date"), F.expr("interval 1 month"))))
    return rp.target_alignment(ind, sc.high_volume_bearish_sells(ind), targets)


def snapshot(s, d):
    b = bars(s, d)
    buys = pq.signals(s, d).where("composite >= 60").join(sg.forward_metrics(b), [KEY, TIME]).select(KEY, TIME, "actionable", c("composite").alias("score"), "forward_return_60")
    return rp.strategy_snapshot(b, pq.composite(s, d), buys, ("composite", "trend"))


QUERIES = {
    "wt_configured": lambda s, d: wt.configured_weights(s, CONFIG, pq.SHARES).join(wt.coverage(vq.features(s, d)), "feature_name", "left").select("component", "feature_name", "factor_weight", "component_weight", "higher_is_better", "values"),
    "wt_validation_scores": lambda s, d: rounded(validation_scores(s, d), 4),
    "wt_sanitized": lambda s, d: rounded(card(s, d).select("feature_name", "component", "validation_score"), 4),
    "wt_usable": lambda s, d: wt.usable(card(s, d)),
    "wt_merged": lambda s, d: rounded(merged(s, d), 4),
    "sc_pruned": pruned,
    "sc_single_scores": lambda s, d: rounded(wt.single_security_scores(factors.compute(bars(s, d), list(RIDGE)), RIDGE), 4),
    "sc_analysis_window": lambda s, d: rp.analysis_window(bars(s, d), 120, 500),
    "sc_strategy_snapshot": lambda s, d: rounded(snapshot(s, d).drop("close"), 4),
    "va_coverage": lambda s, d: rounded(wt.coverage(vq.features(s, d))),
    "va_security_coverage": lambda s, d: wt.security_coverage(vq.features(s, d)),
    "va_report_means": lambda s, d: rounded(wt.report_means(wt.validation_report(vq.features(s, d), bars(s, d), vq.HORIZONS, dated=vq.dated(s, d), names=vq.NAMES))),
    "va_turnover_step": lambda s, d: rounded(step(s, d)),
    "va_feature_set": lambda s, d: rounded(feature_set(s, d)),
    "rp_describe": lambda s, d: past_ties(rp.describe_history(bars(s, d)), 4),
    "rp_last_rows": lambda s, d: rp.last_rows(bars(s, d)),
    "rp_target_alignment": alignment,
    "rp_buy_points": lambda s, d: rounded(rp.buy_point_summary(buy_points(s, d))),
    "st_compare": lambda s, d: rounded(rp.compare_strategies(suite(s, d)), 4),
    "st_return_matrix": lambda s, d: rounded(rp.return_matrix(suite(s, d)), 5),
    "st_rankings": lambda s, d: rounded(rp.strategy_rankings(suite(s, d)), 5),
}

_card = ", ".join(f"('{n}', {x})" for n, x in RIDGE.items())
_place = lambda x: f"CASE WHEN min({x}) OVER () IS NULL OR min({x}) OVER () = max({x}) OVER () THEN 0.5 ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"
VALIDATED = vq._ic_sql() + ", " + vq.BUCKETS.removeprefix(vq.BASE + ", ") + ", " + vq.QSUM + f""",
  mo AS (SELECT feature_name, horizon, (abs({vq._corr('bucket', 'rk')}) + 1) / 2 AS score FROM (SELECT *, rank() OVER (PARTITION BY feature_name, horizon ORDER BY mean_return) + (count(*) OVER (PARTITION BY feature_name, horizon, mean_return) - 1) / 2 AS rk FROM qs) GROUP BY ALL HAVING count(*) >= 3),
  fd AS (SELECT feature_name, trade_date, horizon, regr_slope(forward_return, feature_value) AS slope FROM frame GROUP BY ALL HAVING count(*) >= 5 AND var_pop(feature_value) > 1e-12),
  fm AS (SELECT feature_name, horizon, CASE WHEN stddev_samp(slope) > 1e-12 THEN avg(slope) / (stddev_samp(slope) / sqrt(count(*))) END AS t FROM fd GROUP BY ALL HAVING count(*) >= 10),
  rg AS (SELECT feature_name, coefficient, abs(coefficient) AS a, abs(ic) AS i, least(abs(t), CASE WHEN t IS NOT NULL THEN 5 END) AS f, score AS m FROM (VALUES {_card}) v(feature_name, coefficient)
    LEFT JOIN (SELECT feature_name, arg_min(r, horizon) AS ic FROM (SELECT feature_name, horizon, avg(rank_ic) AS r FROM ic GROUP BY ALL) GROUP BY 1) USING (feature_name) LEFT JOIN (SELECT feature_name, arg_min(t, horizon) AS t FROM fm GROUP BY 1) USING (feature_name) LEFT JOIN (SELECT feature_name, arg_min(score, horizon) AS score FROM mo GROUP BY 1) USING (feature_name)),
  vs AS (SELECT feature_name, coefficient, a AS abs_coefficient, coefficient > 0 AS higher_is_better, greatest({_place('a')} * 0.4 + 0.1 + {_place('i')} * 0.15 + {_place('f')} * 0.2 + {_place('m')} * 0.15, 0) AS validation_score FROM rg)"""
_conf = ", ".join(f"('{n}', '{f}', {w}, {pq.SHARES[n]}, {up})" for n, own in CONFIG.items() for f, (w, up) in own.items())
_comp = "CASE feature_name WHEN 'MA5' THEN 'trend' WHEN 'ROC10' THEN 'trend' WHEN 'VMA20' THEN 'quality' ELSE 'validated' END"
_HIGH = """(close < open OR intraday_return < 0) AND (distance_high_20 >= -0.03 OR distance_high_60 >= -0.05 OR bb_position >= 0.78 OR return_60 >= 0.18) AND (volume_ratio_10 >= 1.35 OR volume_spike >= 1.6)"""
_both = "SELECT 'breakouts' AS strategy, * FROM tn UNION ALL SELECT 'recent', * FROM tn WHERE signal_date >= DATE '1996-01-01'"
_z0 = lambda n: f"(({n} - CASE WHEN count({n}) OVER w >= 30 THEN avg({n}) OVER w END) / CASE WHEN count({n}) OVER w >= 30 AND stddev_samp({n}) OVER w > 1e-12 THEN stddev_samp({n}) OVER w END)"
_zs = lambda n: f"(CASE WHEN {_z0(n)} IS NOT NULL THEN least(greatest({_z0(n)}, -3), 3) END)"
SQL = {
    "wt_configured": vq.BASE + f" SELECT component, feature_name, CAST(fw AS DOUBLE) AS factor_weight, CAST(cw AS DOUBLE) AS component_weight, up AS higher_is_better, n AS values FROM (VALUES {_conf}) v(component, feature_name, fw, cw, up) LEFT JOIN (SELECT feature_name, count(*) AS n FROM feats GROUP BY 1) USING (feature_name)",
    "wt_validation_scores": VALIDATED + " SELECT feature_name, CAST(coefficient AS DOUBLE) AS coefficient, CAST(abs_coefficient AS DOUBLE) AS abs_coefficient, higher_is_better, round(validation_score, 4) + 0.0 AS validation_score FROM vs",
    "wt_sanitized": VALIDATED + f" SELECT feature_name, {_comp} AS component, round(validation_score, 4) + 0.0 AS validation_score FROM vs",
    "wt_usable": VALIDATED + " SELECT max(validation_score) > 0 AS usable FROM vs",
    "wt_merged": VALIDATED + f""", cd AS (SELECT *, {_comp} AS component FROM vs), cf AS (SELECT * FROM (VALUES {_conf}) v(component, feature_name, fw, cw, up)),
      sd AS (SELECT *, sum(validation_score) OVER (PARTITION BY component) AS s FROM cd)
      SELECT coalesce(cf.component, sd.component) AS component, feature_name, round(CAST(coalesce(sd.validation_score, fw) AS DOUBLE), 4) + 0.0 AS factor_weight, CAST(coalesce(cw, 0.15) AS DOUBLE) AS component_weight, coalesce(up, higher_is_better, true) AS higher_is_better
      FROM cf FULL JOIN (SELECT * FROM sd WHERE s > 0 AND validation_score IS NOT NULL) sd USING (feature_name)""",
    "sc_single_scores": vq.BASE + f""", z AS (SELECT stock_code, trade_date, {', '.join(f'{_zs(n)} * {x} AS p{i}' for i, (n, x) in enumerate(RIDGE.items()))} FROM wide WINDOW w AS {over(120)})
      SELECT stock_code, trade_date, CASE WHEN {' OR '.join(f'p{i} IS NOT NULL' for i in range(len(RIDGE)))} THEN round({' + '.join(f'coalesce(p{i}, 0)' for i in range(len(RIDGE)))}, 4) + 0.0 END AS raw FROM z""",
    "sc_analysis_window": with_bars() + " SELECT stock_code, trade_date, " + ", ".join(f'"{x}"' for x in ("open", "high", "low", "close", "volume")) + " FROM bars QUALIFY count(*) OVER (PARTITION BY stock_code) >= 500 AND row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) <= 120",
    "sc_strategy_snapshot": pq.SCORES + """, bn AS (SELECT *, lag(close, 29) OVER w AS before, coalesce(lag(trade_date, 4) OVER w, min(trade_date) OVER (PARTITION BY stock_code)) AS cut FROM bars WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date)),
      nw AS (SELECT stock_code, trade_date, close, coalesce((close - before) / before * 100, 0) AS change_30, cut FROM bn QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) = 1),
      kn AS (SELECT stock_code, arg_max(composite, trade_date) FILTER (composite IS NOT NULL) AS lc, arg_max(trend, trade_date) FILTER (trend IS NOT NULL) AS lt FROM cm GROUP BY 1),
      by_ AS (SELECT stock_code, trade_date, actionable, composite, lead60 FROM sg JOIN (SELECT stock_code, trade_date, lead(close, 60) OVER (PARTITION BY stock_code ORDER BY trade_date) / close - 1 AS lead60 FROM bars) USING (stock_code, trade_date) WHERE composite >= 60),
      ls AS (SELECT stock_code, max(trade_date) AS last, arg_max(actionable, trade_date) AS yes, arg_max(composite, trade_date) AS score, coalesce(avg(lead60) FILTER (actionable), 0) * 100 AS ms, coalesce(avg(lead60) FILTER (NOT actionable), 0) * 100 AS mw FROM by_ GROUP BY 1)
      SELECT stock_code, trade_date, round(change_30, 4) + 0.0 AS change_30, round(lc, 4) + 0.0 AS latest_composite, round(lt, 4) + 0.0 AS latest_trend, last AS latest_signal_date, coalesce(last >= cut, false) AS current_signal_active, coalesce(last >= cut, false) AND coalesce(yes, false) AS current_signal_actionable,
        round(CASE WHEN last >= cut THEN score END, 4) + 0.0 AS current_signal_score, round(coalesce(ms, 0), 4) + 0.0 AS mean_after_signal, round(coalesce(mw, 0), 4) + 0.0 AS mean_after_watch FROM nw LEFT JOIN kn USING (stock_code) LEFT JOIN ls USING (stock_code)""",
    "va_coverage": vq.BASE + " SELECT feature_name, count(DISTINCT stock_code) AS securities, count(DISTINCT trade_date) AS dates, count(*) AS values, round(avg(feature_value), 6) + 0.0 AS mean FROM feats GROUP BY 1",
    "va_security_coverage": vq.BASE + " SELECT stock_code, count(DISTINCT feature_name) AS features, count(*) AS values, min(trade_date) AS first_date, max(trade_date) AS last_date FROM feats GROUP BY 1",
    "va_report_means": vq._ic_sql() + ", " + vq.SPREAD.removeprefix(vq.BASE + ", ") + ", " + vq.TURN.removeprefix(vq.MEMBERS + ", ") + """ SELECT * FROM (SELECT round(avg(i), 6) + 0.0 AS mean_ic, round(avg(r), 6) + 0.0 AS mean_rank_ic FROM (SELECT avg(ic) AS i, avg(rank_ic) AS r FROM ic GROUP BY feature_name, horizon)),
      (SELECT round(avg(s), 6) + 0.0 AS mean_spread FROM (SELECT avg(spread) AS s FROM spread GROUP BY feature_name, horizon)), (SELECT round(avg(t), 6) + 0.0 AS mean_turnover FROM (SELECT avg(turnover) AS t FROM turn GROUP BY feature_name, bucket))""",
    "va_turnover_step": vq.MEMBERS + """, st AS (SELECT feature_name, bucket, stock_code, max(CASE WHEN trade_date = DATE '1995-03-02' THEN 1 END) AS now, max(CASE WHEN trade_date = DATE '1995-03-01' THEN 1 END) AS was FROM members WHERE trade_date IN (DATE '1995-03-01', DATE '1995-03-02') GROUP BY ALL),
      n AS (SELECT feature_name, CAST(bucket AS INT) AS bucket, count(now) AS size, count(was) AS previous, count(now + was) AS retained FROM st GROUP BY ALL) SELECT *, size - retained AS entered, previous - retained AS exited, round(1 - retained / greatest(size, previous), 6) + 0.0 AS turnover FROM n WHERE size > 0 AND previous > 0""",
    "va_feature_set": with_bars(lq.FEATURES) + f""", rets AS (SELECT * FROM (SELECT stock_code, trade_date, 1 AS horizon, lead(close, 1) OVER (PARTITION BY stock_code ORDER BY trade_date) / close - 1 AS forward_return FROM bars UNION ALL SELECT stock_code, trade_date, 5, lead(close, 5) OVER (PARTITION BY stock_code ORDER BY trade_date) / close - 1 FROM bars) WHERE forward_return IS NOT NULL),
      raw AS (SELECT stock_code, trade_date, feature_name, feature_value FROM (SELECT stock_code, trade_date, high / low - 1 AS "range", CASE WHEN open <> close THEN close / open - 1 END AS body, volume FROM bars) UNPIVOT (feature_value FOR feature_name IN ("range", body, volume))),
      frame AS (SELECT raw.*, horizon, forward_return FROM raw JOIN rets USING (stock_code, trade_date)),
      ranked AS (SELECT *, rank() OVER (PARTITION BY feature_name, trade_date, horizon ORDER BY feature_value) + (count(*) OVER (PARTITION BY feature_name, trade_date, horizon, feature_value) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature_name, trade_date, horizon ORDER BY forward_return) + (count(*) OVER (PARTITION BY feature_name, trade_date, horizon, forward_return) - 1) / 2 AS ry FROM frame),
      ic AS (SELECT feature_name, trade_date, horizon, count(*) AS n, greatest(least({vq._corr('feature_value', 'forward_return')}, 1), -1) AS ic, greatest(least({vq._corr('rx', 'ry')}, 1), -1) AS rank_ic FROM ranked GROUP BY ALL HAVING count(*) >= 5 AND min(feature_value) < max(feature_value) AND min(forward_return) < max(forward_return)) {vq.SUMMARY}""",
    "rp_describe": with_bars() + """ SELECT stock_code, field, count(x) AS n, round(avg(x) + 1e-7, 4) AS mean, round(stddev_samp(x) + 1e-7, 4) AS std, round(min(x) + 1e-7, 4) AS least, round(quantile_cont(x, 0.25) + 1e-7, 4) AS p25, round(quantile_cont(x, 0.5) + 1e-7, 4) AS p50, round(quantile_cont(x, 0.75) + 1e-7, 4) AS p75, round(max(x) + 1e-7, 4) AS greatest, min(trade_date) AS first_date, max(trade_date) AS last_date
      FROM (UNPIVOT bars ON open, high, low, "close", volume INTO NAME field VALUE x) GROUP BY ALL""",
    "rp_last_rows": with_bars() + " SELECT stock_code, trade_date, " + ", ".join(f'"{x}"' for x in ("open", "high", "low", "close", "volume")) + " FROM bars QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) <= 5",
    "rp_target_alignment": INDICATORS + f""", sn AS (SELECT *, {_HIGH} AS sgn FROM i3),
      nr AS (SELECT stock_code, trade_date, coalesce(sgn, false) AS hit, min(trade_date) FILTER (sgn) OVER (PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near,
        concat_ws(', ', CASE WHEN cyc > 5 THEN 'CYC not low' END, CASE WHEN close > bb_upper THEN 'above the upper band' END, CASE WHEN volume > volume_ma10 * 1.5 THEN 'volume broke out' END) AS why FROM sn),
      tg AS (SELECT DISTINCT stock_code, CAST(unnest(generate_series(DATE '1995-01-02', DATE '1997-01-01', INTERVAL 1 MONTH)) AS DATE) AS trade_date FROM (SELECT DISTINCT stock_code FROM bars))
      SELECT stock_code, trade_date, coalesce(hit, false) AS hit, near IS NOT NULL AS nearby_hit, near AS matched_date, CASE WHEN why IS NULL THEN 'not a bar' WHEN why = '' THEN 'near match' ELSE why END AS reason FROM tg LEFT JOIN nr USING (stock_code, trade_date)""",
    "st_compare": pq.TRADES + f" SELECT strategy, round(avg(net_return) * 100, 4) + 0.0 AS mean_return, round(avg(CASE WHEN net_return > 0 THEN 100.0 ELSE 0.0 END), 4) AS win_rate, count(*) AS trades, count(DISTINCT stock_code) AS securities FROM ({_both}) GROUP BY 1",
    "st_return_matrix": pq.TRADES + " SELECT stock_code, round(product(1 + net_return) - 1, 5) + 0.0 AS breakouts, round(product(1 + net_return) FILTER (signal_date >= DATE '1996-01-01') - 1, 5) + 0.0 AS recent FROM tn GROUP BY 1",
    "st_rankings": pq.TRADES + f" SELECT strategy, stock_code, round(total, 5) + 0.0 AS total_return, trades, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY round(total, 9) DESC, stock_code) AS place FROM (SELECT strategy, stock_code, product(1 + net_return) - 1 AS total, count(*) AS trades FROM ({_both}) GROUP BY ALL)) WHERE place <= 5",
}
CARD = vq._ic_sql() + ", " + vq.SPREAD.removeprefix(vq.BASE + ", ") + ", " + vq.TURN.removeprefix(vq.MEMBERS + ", ") + """,
  ca AS (SELECT feature_name, avg(i) AS ic_mean, avg(r) AS rank_ic_mean, avg(ip) AS ic_positive, avg(rp) AS rank_ic_positive FROM (SELECT feature_name, horizon, avg(ic) AS i, avg(rank_ic) AS r, sum(CASE WHEN ic > 1e-12 THEN 1 ELSE 0 END) / count(*) AS ip, sum(CASE WHEN rank_ic > 1e-12 THEN 1 ELSE 0 END) / count(*) AS rp FROM ic GROUP BY ALL) GROUP BY 1),
  cb AS (SELECT feature_name, avg(s) AS spread_mean FROM (SELECT feature_name, horizon, avg(spread) AS s FROM spread GROUP BY ALL) GROUP BY 1),
  ct AS (SELECT feature_name, avg(m) AS turnover FROM (SELECT feature_name, bucket, avg(turnover) AS m FROM turn GROUP BY ALL) GROUP BY 1),
  cs AS (SELECT *, coalesce(abs(rank_ic_mean), 0) * 35 + coalesce(abs(ic_mean), 0) * 20 + greatest(coalesce(spread_mean, 0), 0) * 2000 + coalesce(rank_ic_positive, 0) * 15 + coalesce(ic_positive, 0) * 5 + greatest(1 - coalesce(turnover, 1), 0) * 5 AS score,
    CASE feature_name WHEN 'VMA20' THEN 'quality' WHEN 'KMID' THEN 'risk' ELSE 'trend' END AS component FROM ca FULL JOIN cb USING (feature_name) FULL JOIN ct USING (feature_name))"""
SQL["wt_scorecard"] = CARD + " SELECT feature_name, component, " + ", ".join(f"round({x}, 4) + 0.0 AS {x}" for x in ("ic_mean", "rank_ic_mean", "ic_positive", "rank_ic_positive", "spread_mean", "turnover", "score")) + """,
  round(CASE WHEN sum(greatest(score, 0)) OVER (PARTITION BY component) > 0 THEN greatest(score, 0) / sum(greatest(score, 0)) OVER (PARTITION BY component) END, 4) AS recommended_weight FROM cs"""

_MEAN = lambda names: ", ".join(f"avg({x}) AS {x}" for x in names)
_IR = lambda x: f"CASE WHEN stddev_samp({x}) > 1e-12 THEN avg({x}) / stddev_samp({x}) * sqrt(count({x})) END"
_DECAYS = vq.SQL["va_decay_summary"].replace("round(abs(", "((abs(").replace(", 0), 5) AS", ", 0))) AS")  # averaged before rounding
SQL["wt_scorecard_whole"] = CARD + f""", ir AS (SELECT feature_name, avg(a) AS ic_ir, avg(b) AS rank_ic_ir, count(*) AS horizons FROM (SELECT feature_name, horizon, {_IR("ic")} AS a, {_IR("rank_ic")} AS b FROM ic GROUP BY ALL) GROUP BY 1),
  sp AS (SELECT feature_name, {_MEAN(("spread_ir", "spread_positive"))} FROM (SELECT feature_name, horizon, {_IR("spread")} AS spread_ir, sum(CASE WHEN spread > 1e-12 THEN 1 ELSE 0 END) / count(*) AS spread_positive FROM spread GROUP BY ALL) GROUP BY 1),
  tm AS (SELECT feature_name, max(turnover) AS turnover_most FROM turn GROUP BY 1), dk AS (SELECT feature_name, {_MEAN(("ic_decay", "rank_ic_decay", "spread_decay"))} FROM ({_DECAYS}) GROUP BY 1)
  SELECT feature_name, component, horizons, """ + ", ".join(f"round({x}, 4) + 0.0 AS {x}" for x in ("ic_mean", "rank_ic_mean", "ic_positive", "rank_ic_positive", "ic_ir", "rank_ic_ir", "spread_mean", "spread_ir", "spread_positive", "turnover", "turnover_most", "ic_decay", "rank_ic_decay", "spread_decay", "score")) + """,
  round(CASE WHEN sum(greatest(score, 0)) OVER (PARTITION BY component) > 0 THEN greatest(score, 0) / sum(greatest(score, 0)) OVER (PARTITION BY component) END, 4) AS recommended_weight FROM cs JOIN ir USING (feature_name) JOIN sp USING (feature_name) JOIN tm USING (feature_name) JOIN dk USING (feature_name)"""
