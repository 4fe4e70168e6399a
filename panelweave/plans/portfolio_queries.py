"""Rankings, picks and what becomes of them, with SQL."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from panelweave.functions.columns import KEY, TIME
from panelweave.operators import layers as ly, portfolio as pf, scoring as sc, setups as sg
from panelweave.plans import score_queries as pq, setup_queries as sq
from panelweave.plans.common import bars, rounded
from panelweave.sources.bars import BARS_SQL

c = F.col
N, CAPITAL, AS_OF = 5, 100_000.0, "1998-12-01"


def snapshot(s, d):
    """The newest scores and setup of each security; its return over 20 bars stands for a backtest."""
    own = sg.latest(pq.signals(s, d), marked=True).select(
        KEY, F.coalesce(c("composite") >= 60, F.lit(False)).alias("current_signal_active"), c("actionable").alias("current_signal_actionable"), c("composite").alias("current_signal_score"),
        c("trend").alias("expected_3m_score"), c("quality").alias("matrix_score"), c("risk").alias("regime_score"), c("tier").alias("signal_tier"), sc.freshness(c(TIME), F.lit(AS_OF).cast("date")).alias("freshness"),
    )
    setup = sg.latest(sq.scored(s, d), marked=True).select(KEY, c("low_price_setup_type").alias("setup_type"), c("low_price_setup_score").alias("setup_score"), c("low_price_sideways").alias("sideways_penalty"), c("low_price").alias("low_price_candidate"), c("return20").alias("backtest_return"))
    return own.join(setup, KEY)


def signal_rows(s, d):
    own = pq.signals(s, d).select(KEY, TIME, "actionable", c("trend").alias("expected_3m_score"), c("quality").alias("matrix_score"), c("risk").alias("regime_score"), (c("composite") / 10).alias("signal_strength"), c("risk_level").alias("risk_score"))
    return pf.signal_rows(own.join(sg.forward_metrics(bars(s, d)), [KEY, TIME]), snapshot(s, d))


def picks(s, d, equal=True):
    return pf.daily_picks(signal_rows(s, d), N, equal)


def ranking(s, d, n=None):
    return pf.rank_securities(snapshot(s, d), n)


def persisted(s, d):
    """The tables of a selection as rows of the signal layer."""
    r = ranking(s, d)
    rows = ly.ranking_rows(r, pf.selected(r, N), pf.watchlist(r, N), "batch_1", F.lit(AS_OF).cast("date"))
    return ly.normalize_signals(rows, F.lit(0), signal_set="scan", strategy="scores", source="portfolio")


def curve(s, d):
    out = sc.compounded(pf.period_returns(picks(s, d)), "period_return", CAPITAL)
    return out.select(TIME, "picks", F.round("period_return", 6).alias("period_return"), F.round(c("log_equity") / math.log(10), 5).alias("log_equity"))


def persisted_trades(s, d):
    rows = ly.trade_rows(pq.outcomes(s, d))
    return ly.normalize_trades(rows, F.lit(0), account_id="replay", strategy="breakouts", source="replay")


_SNAP = ["ranking_score", "current_signal_score", "freshness"]
QUERIES = {
    "pf_ranking": lambda s, d: rounded(ranking(s, d).select(KEY, "place", "setup_type", *_SNAP), 5),
    "pf_signal_rows": lambda s, d: rounded(pf.eligible(signal_rows(s, d)).select(KEY, TIME, "forward_return_60", pf.selection_score().alias("selection_score")), 5),
    "pf_picks": lambda s, d: rounded(picks(s, d, False).select(KEY, TIME, "place", "candidates", "weight"), 5),
    "pf_contributions": lambda s, d: rounded(pf.contributions(picks(s, d)), 4),
    "pf_estimate": lambda s, d: rounded(pf.estimate(picks(s, d)), 4),
    "pf_selected": lambda s, d: rounded(pf.selected(ranking(s, d), N).select(KEY, "tier", "place", "ranking_score"), 5),
    "pf_watchlist": lambda s, d: rounded(pf.watchlist(ranking(s, d), N).select(KEY, "tier", "place", "ranking_score"), 5),
    "pf_allocation": lambda s, d: rounded(pf.allocate(pf.selected(ranking(s, d), N), CAPITAL, False).select(KEY, "weight", "capital"), 4),
    "pf_curve": curve,
    "pf_trading_table": lambda s, d: rounded(pf.trading_table(snapshot(s, d)).select(KEY, "place", "ranking_score"), 5),
    "pf_batch_review": lambda s, d: rounded(pf.batch_review(persisted(s, d), "batch_1"), 4),
    "io_persist_ranking": lambda s, d: rounded(persisted(s, d).select(KEY, TIME, "signal_type", "batch_id", "rank_position", "score", "actionable"), 4),
    "io_persist_trades": lambda s, d: persisted_trades(s, d).select(KEY, TIME, "order_id", "trade_type", "price", "amount", "commission"),
    "to_planned_exits": lambda s, d: pf.planned_exits(bars(s, d), picks(s, d).select(KEY, TIME, (c("place") * 10).alias("holding_horizon"))),
}

SNAP = pq.SCORES + ", " + sq.CTE.removeprefix("WITH " + BARS_SQL + ", ") + f""", sn AS (SELECT l.stock_code, coalesce(composite >= 60, false) AS active, actionable, composite, trend, quality, risk, tier, greatest(0.0, 100.0 - 4 * (DATE '{AS_OF}' - l.trade_date)) AS freshness,
    b.low_price_setup_type AS setup_type, b.low_price_setup_score AS setup_score, b.low_price_sideways AS penalty, b.low_price AS cheap, b.return20 AS back
    FROM (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) = 1) l JOIN (SELECT * FROM b6 QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) = 1) b USING (stock_code))"""
_PLAIN = "CASE WHEN active AND actionable THEN 100 ELSE 0 END + coalesce(composite, 0) * 0.5 + coalesce(trend, 0) * 0.2 + coalesce(quality, 0) * 0.15 + coalesce(risk, 0) * 0.15"
RANK = SNAP + f""", rk AS (SELECT *, round({_PLAIN} + CASE setup_type WHEN 'pre_breakout' THEN 18 WHEN 'bottom_rebound' THEN 20 WHEN 'sideways' THEN -16 ELSE 0 END + coalesce(setup_score, 0) * 0.18 + freshness * 0.1
    + CASE WHEN coalesce(cheap, coalesce(setup_type <> 'sideways', true)) THEN 8 ELSE -22 END - coalesce(penalty, 0) * 0.9, 9) AS ranking_score FROM sn),
  rp AS (SELECT *, row_number() OVER (ORDER BY ranking_score DESC, coalesce(composite, -1) DESC, coalesce(risk, -1) DESC, coalesce(quality, -1) DESC, back DESC NULLS LAST, stock_code) AS place FROM rk),
  t1 AS (SELECT *, CASE WHEN active AND actionable AND coalesce(cheap, true) AND freshness >= 40 AND setup_type IN ('pre_breakout', 'bottom_rebound') THEN 0 WHEN active AND actionable AND freshness >= 35 AND setup_type <> 'sideways' THEN 1
    WHEN tier <> 'weak' AND freshness >= 30 AND setup_type <> 'sideways' THEN 2 ELSE 3 END AS k FROM rp),
  se AS (SELECT * FROM t1 WHERE k = (SELECT min(k) FROM t1) ORDER BY place LIMIT {N}),
  w1 AS (SELECT *, CASE WHEN setup_type IN ('pre_breakout', 'bottom_rebound') THEN 0 ELSE 1 END AS k FROM rp WHERE tier = 'weak'),
  wl AS (SELECT * FROM w1 WHERE k = (SELECT min(k) FROM w1) ORDER BY place LIMIT {N})"""
ROWS = SNAP + f""", fw AS ({sq._forward(False).replace("round(", "(").replace(", 6) + 0.0", ")")}),
  sr AS (SELECT sg.*, forward_return_60, max_drawdown_60, setup_type, setup_score, penalty, cheap, freshness FROM sg JOIN fw USING (stock_code, trade_date) JOIN (SELECT stock_code, setup_type, setup_score, penalty, cheap, freshness FROM sn) USING (stock_code) WHERE forward_return_60 IS NOT NULL),
  el AS (SELECT *, round(trend * 0.5 + quality * 0.22 + risk * 0.12 + composite / 10 * 3 + coalesce(setup_score, 0) * 0.18 + freshness * 0.1 - (100 - risk) / 25 * 4 - coalesce(penalty, 0) * 1.1 - abs(max_drawdown_60) * 35, 9) AS selection
    FROM sr WHERE actionable AND freshness >= 35 AND coalesce(cheap, true) AND setup_type <> 'sideways'),
  pp AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY selection DESC NULLS LAST, trend DESC NULLS LAST, quality DESC NULLS LAST, risk DESC NULLS LAST, composite DESC NULLS LAST, stock_code) AS place, count(*) OVER (PARTITION BY trade_date) AS candidates FROM el),
  pk AS (SELECT *, greatest(coalesce(selection, 0), 0) AS v, sum(greatest(coalesce(selection, 0), 0)) OVER (PARTITION BY trade_date) AS vs, count(*) OVER (PARTITION BY trade_date) AS vn FROM pp WHERE place <= {N})"""
ROWS = re.sub(r"\b(el|sr|fw|pp|pk|sn|sg) AS \(", r"\1 AS MATERIALIZED (", ROWS)  # else each is planned anew wherever it is read
SAVED = RANK + f""", sv AS (SELECT stock_code, 'ranking' AS signal_type, place, ranking_score FROM rp UNION ALL SELECT stock_code, 'selected', row_number() OVER (ORDER BY place), ranking_score FROM se UNION ALL SELECT stock_code, 'watchlist', row_number() OVER (ORDER BY place), ranking_score FROM wl)"""
_mean = lambda k: f"count(*) FILTER (signal_type = '{k}') AS {k}_count, round(coalesce(avg(ranking_score) FILTER (signal_type = '{k}'), 0), 4) + 0.0 AS {k}_mean_score"
SQL = {
    "pf_ranking": RANK + " SELECT stock_code, CAST(place AS INT) AS place, setup_type, round(ranking_score, 5) + 0.0 AS ranking_score, round(composite, 5) + 0.0 AS current_signal_score, freshness FROM rp",
    "pf_signal_rows": ROWS + " SELECT stock_code, trade_date, round(forward_return_60, 5) + 0.0 AS forward_return_60, round(selection, 5) + 0.0 AS selection_score FROM el",
    "pf_picks": ROWS + " SELECT stock_code, trade_date, CAST(place AS INT) AS place, candidates, round(CASE WHEN vs > 1e-12 THEN v / vs ELSE 1 / vn END, 5) AS weight FROM pk",
    "pf_contributions": ROWS + " SELECT stock_code, trade_date, round(forward_return_60 * 100, 4) + 0.0 AS contribution_return, round(selection, 4) + 0.0 AS selection_score FROM pk",
    "pf_estimate": ROWS + " SELECT round(coalesce(avg(forward_return_60 * 100), 0), 4) AS mean_return, round(coalesce(avg(CASE WHEN forward_return_60 > 0 THEN 100.0 ELSE 0.0 END), 0), 4) AS win_rate, count(*) AS picks FROM pk",
    "pf_selected": RANK + " SELECT stock_code, k AS tier, CAST(place AS INT) AS place, round(ranking_score, 5) + 0.0 AS ranking_score FROM se",
    "pf_watchlist": RANK + " SELECT stock_code, k AS tier, CAST(place AS INT) AS place, round(ranking_score, 5) + 0.0 AS ranking_score FROM wl",
    "pf_allocation": RANK + f""", al AS (SELECT *, greatest(coalesce(ranking_score, 0), 0) AS v, sum(greatest(coalesce(ranking_score, 0), 0)) OVER () AS vs, count(*) OVER () AS vn FROM se)
      SELECT stock_code, round(CASE WHEN vs > 1e-12 THEN v / vs ELSE 1 / vn END, 4) AS weight, round(CASE WHEN vs > 1e-12 THEN v / vs ELSE 1 / vn END * {CAPITAL}, 4) AS capital FROM al""",
    "pf_curve": ROWS + f""", pr AS (SELECT trade_date, avg(forward_return_60) AS r, count(*) AS n FROM pk GROUP BY 1)
      SELECT trade_date, n AS picks, round(r, 6) AS period_return, CASE WHEN max(CASE WHEN r <= -1 THEN 1 ELSE 0 END) OVER o = 0 THEN round(log10({CAPITAL}) + sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER o / ln(10), 5) END AS log_equity FROM pr WINDOW o AS (ORDER BY trade_date)""",
    "pf_trading_table": SNAP + f""", tt AS (SELECT *, round({_PLAIN}, 9) AS score FROM sn WHERE back IS NOT NULL)
      SELECT stock_code, CAST(row_number() OVER (ORDER BY score DESC, coalesce(composite, -1) DESC, coalesce(quality, -1) DESC, back DESC, stock_code) AS INT) AS place, round(score, 5) + 0.0 AS ranking_score FROM tt""",
    "pf_batch_review": SAVED + f" SELECT 'batch_1' AS batch_id, {', '.join(_mean(k) for k in ('ranking', 'selected', 'watchlist'))} FROM sv",
    "io_persist_trades": pq.TRADES + """, n1 AS (SELECT stock_code, signal_date, min(trade_date) AS entry_date FROM pp GROUP BY ALL),
      lg AS (SELECT stock_code, signal_date, entry_date AS trade_date, 'buy' AS trade_type, entry AS price FROM tr JOIN n1 USING (stock_code, signal_date) UNION ALL SELECT stock_code, signal_date, exit_date, 'sell', exit FROM tr)
      SELECT stock_code, trade_date, strftime(trade_date, '%Y-%m-%d') || '_' || trade_type || '_' || row_number() OVER (PARTITION BY stock_code ORDER BY trade_date, trade_type DESC, signal_date) AS order_id, trade_type, price, price * 100 AS amount, price * 100 * 0.0003 AS commission FROM lg WHERE price IS NOT NULL""",
    "io_persist_ranking": SAVED + f" SELECT stock_code, DATE '{AS_OF}' AS trade_date, signal_type, 'batch_1' AS batch_id, CAST(place AS DOUBLE) AS rank_position, round(ranking_score, 4) + 0.0 AS score, signal_type = 'selected' AS actionable FROM sv",
    "to_planned_exits": ROWS + """, nb AS (SELECT stock_code, trade_date, open, row_number() OVER (PARTITION BY stock_code ORDER BY trade_date) AS i, count(*) OVER (PARTITION BY stock_code) AS z FROM bars)
      SELECT a.stock_code, a.trade_date AS signal_date, b.trade_date AS entry_date, b.open AS entry_price, e.trade_date AS exit_date FROM pk JOIN nb a USING (stock_code, trade_date) JOIN nb b ON b.stock_code = a.stock_code AND b.i = a.i + 1 JOIN nb e ON e.stock_code = a.stock_code AND e.i = least(a.i + pk.place * 10, a.z)""",
}
