"""Setup queries over daily bars, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.columns import KEY, TIME
from panelweave.operators import setups as sg
from panelweave.plans.common import bars, over, rounded, with_bars

#: Prices of the derived bars are near a thousand.
BOUNDS = sg.Bounds(200.0, 1500.0, 20_000.0)


def scored(s, d):
    return sg.with_recipes(sg.setup_features(bars(s, d), BOUNDS))


def events_ahead(s, d):
    """Events with what follows them, from one pass over the bars."""
    metrics = ("forward_return_20", "max_drawdown_20")
    return sg.setup_events(sg.with_recipes(sg.setup_features(sg.with_forward(bars(s, d), (20,), truncate=True), BOUNDS, metrics)), keep=metrics)


def _events(s, d):
    return sg.setup_events(scored(s, d))


FEATURES = ["return5", "return20", "return60", "distance_to_high20", "distance_from_low60", "distance_to_previous_high20", "volume_ratio", "previous_volume_ratio", "compression", "range20", "range60"]


def range_breakout_ranking(s, d):
    """The latest bar of each security, ranked by its range-breakout score."""
    now = sg.latest(scored(s, d), marked=True).select(KEY, TIME, F.round("close", 2).alias("close"), "range_breakout_type", "range_breakout_score", "return20")
    return rounded(sg.ranked(now, F.desc("range_breakout_score"), F.desc_nulls_last("return20"), F.col(KEY)))


QUERIES = {
    "range_breakout_ranking": range_breakout_ranking,
    "sg_features": lambda s, d: rounded(sg.setup_features(bars(s, d), BOUNDS).select(KEY, TIME, *FEATURES)),
    "sg_low_price_setup": lambda s, d: rounded(scored(s, d).select(KEY, TIME, "pre_breakout", "bottom_rebound", "low_price_sideways", "low_price_setup_type", "low_price_setup_score")),
    "sg_range_breakout": lambda s, d: rounded(scored(s, d).select(KEY, TIME, "range_breakout", "range_sideways", "range_breakout_type", "range_breakout_score")),
    "sg_box_pullback": lambda s, d: rounded(scored(s, d).select(KEY, TIME, "box_pullback", "box_sideways", "box_pullback_type", "box_pullback_score")),
    "sg_best_recipe": lambda s, d: rounded(sg.best_recipe(scored(s, d)).select(KEY, TIME, "recipe", "setup_type", "setup_score")),
    "sg_events": lambda s, d: rounded(_events(s, d)),
    "sg_recent_events": lambda s, d: rounded(sg.signal_report(scored(s, d), bars(s, d), last=250)["events"].select(KEY, TIME, "recipe", "setup_type", "setup_score", "forward_return_20")),
    "sg_forward_metrics": lambda s, d: rounded(sg.forward_metrics(bars(s, d))),
    "sg_forward_truncated": lambda s, d: rounded(sg.forward_metrics(bars(s, d), truncate=True)),
    "sg_zones_best": lambda s, d: rounded(sg.merge_zones(_events(s, d))),
    "sg_zones_first": lambda s, d: rounded(sg.merge_zones(_events(s, d), 5, "first")),
    "sg_event_summary": lambda s, d: rounded(sg.summarize_events(events_ahead(s, d))),
}

CTE = with_bars(
    """b0 AS (SELECT *, close * volume AS turnover, close / nullif(lag(close) OVER s, 0) - 1 AS daily, row_number() OVER s AS nth FROM bars WINDOW s AS (PARTITION BY stock_code ORDER BY trade_date))""",
    f"""b1 AS (SELECT *, quantile_cont(turnover, 0.5) OVER w20 AS median_turnover20, {", ".join(f"close / nullif(lag(close, {n}) OVER s, 0) - 1 AS return{n}" for n in (5, 20, 60))},
    max(close) OVER w20 AS high20, min(close) OVER w20 AS low20, max(close) OVER w60 AS high60, min(close) OVER w60 AS low60, max(close) OVER {over(20, 1)} AS previous_high20,
    avg(close) OVER w10 AS ma10, avg(close) OVER w20 AS ma20, avg(volume) OVER w20 AS volume_ma20, avg(volume) OVER {over(20, 1)} AS previous_volume_ma20,
    CASE WHEN count(daily) OVER w20 >= 5 THEN stddev_samp(daily) OVER w20 END AS vol20, CASE WHEN count(daily) OVER w60 >= 10 THEN stddev_samp(daily) OVER w60 END AS vol60,
    max(close) OVER {over(40, 20)} AS box_top, min(close) OVER {over(40, 20)} AS box_bottom, max(close) OVER {over(15, 5)} AS breakout_peak, min(close) OVER {over(5)} AS pullback_low,
    quantile_cont(volume, 0.5) OVER {over(15, 5)} AS breakout_volume
    FROM b0 WINDOW s AS (PARTITION BY stock_code ORDER BY trade_date), w10 AS {over(10)}, w20 AS {over(20)}, w60 AS {over(60)})""",
    f"""b2 AS (SELECT *, close / high20 - 1 AS distance_to_high20, close / low60 - 1 AS distance_from_low60, close / previous_high20 - 1 AS distance_to_previous_high20,
    volume / volume_ma20 AS volume_ratio, volume / coalesce(nullif(previous_volume_ma20, 0), volume_ma20) AS previous_volume_ratio, CASE WHEN vol60 > 0 THEN vol20 / vol60 END AS compression,
    (high20 - low20) / close AS range20, (high60 - low60) / close AS range60, box_top / box_bottom - 1 AS box_height, breakout_peak / box_top - 1 AS breakout_peak_return,
    close / box_top - 1 AS distance_to_box_top, close / breakout_peak - 1 AS pullback_depth, volume / breakout_volume AS pullback_volume_ratio,
    close BETWEEN {BOUNDS.low} AND {BOUNDS.high} AS low_price, median_turnover20 >= {BOUNDS.turnover} AS liquid FROM b1)""",
    "b3 AS (SELECT *, " + ", ".join(f"({x}) AS {n}" for n, x in sg.FLAGS.items()) + " FROM b2)",
    "b4 AS (SELECT *, " + ", ".join(f"CAST({sg.points(r)} AS DOUBLE) AS {n}" for n, r in sg.POINTS.items()) + " FROM b3)",
    "b5 AS (SELECT *, " + ", ".join(f"{x} AS {n}_type" for n, x in sg.LABELS.items()) + " FROM b4)",
    "b6 AS (SELECT *, " + ", ".join(f"CAST({x} AS DOUBLE) AS {n}_score" for n, x in sg.SCORES.items()) + " FROM b5)",
    "ev AS (SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT stock_code, trade_date, '{n}' AS recipe, {n}_type AS setup_type, {n}_score AS setup_score FROM b6 WHERE nth >= 60" for n in sg.LABELS)
    + ") WHERE setup_type NOT IN ('neutral', 'sideways'))",
)


def _forward(truncate: bool) -> str:
    last = "last_value(close) OVER (PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    cols = []
    for h in (20, 40, 60):
        ahead = f"lead(close, {h}) OVER (PARTITION BY stock_code ORDER BY trade_date)"
        cols.append(f"round({f'coalesce({ahead}, {last})' if truncate else ahead} / close - 1, 6) + 0.0 AS forward_return_{h}")
        cols.append(f"round(min(low) OVER (PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) / close - 1, 6) + 0.0 AS max_drawdown_{h}")
    return f"SELECT stock_code, trade_date, {', '.join(cols)} FROM bars"


def _zones(cooldown: int, kept: str) -> str:
    return CTE + f""", z0 AS (SELECT *, CASE WHEN lag(trade_date) OVER w IS NULL OR trade_date - lag(trade_date) OVER w > {cooldown} THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY stock_code, recipe, setup_type ORDER BY trade_date)),
      z1 AS (SELECT *, sum(fresh) OVER (PARTITION BY stock_code, recipe, setup_type ORDER BY trade_date) AS zone FROM z0),
      z2 AS (SELECT *, row_number() OVER (PARTITION BY stock_code, recipe, setup_type, zone ORDER BY {kept}) AS nth FROM z1)
      SELECT stock_code, recipe, setup_type, CAST(zone AS BIGINT) AS zone, max(trade_date) FILTER (nth = 1) AS trade_date, max(setup_score) FILTER (nth = 1) AS setup_score,
      min(trade_date) AS zone_start, max(trade_date) AS zone_end, count(*) AS zone_events, max(setup_score) AS zone_best FROM z2 GROUP BY stock_code, recipe, setup_type, zone"""


SQL = {
    "range_breakout_ranking": CTE + """ SELECT stock_code, trade_date, round(close, 2) AS "close", range_breakout_type, range_breakout_score, round(return20, 6) + 0.0 AS return20,
      CAST(row_number() OVER (ORDER BY range_breakout_score DESC, return20 DESC NULLS LAST, stock_code) AS INT) AS rank_position
      FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) AS age FROM b6) WHERE age = 1""",
    "sg_features": CTE + " SELECT stock_code, trade_date, " + ", ".join(f"round({x}, 6) + 0.0 AS {x}" for x in FEATURES) + " FROM b2",
    "sg_low_price_setup": CTE + " SELECT stock_code, trade_date, pre_breakout, bottom_rebound, low_price_sideways, low_price_setup_type, low_price_setup_score FROM b6",
    "sg_range_breakout": CTE + " SELECT stock_code, trade_date, range_breakout, range_sideways, range_breakout_type, range_breakout_score FROM b6",
    "sg_box_pullback": CTE + " SELECT stock_code, trade_date, box_pullback, box_sideways, box_pullback_type, box_pullback_score FROM b6",
    "sg_best_recipe": CTE + """ SELECT stock_code, trade_date, CASE WHEN low_price_setup_score >= greatest(range_breakout_score, box_pullback_score) THEN 'low_price_setup' WHEN range_breakout_score >= box_pullback_score THEN 'range_breakout' ELSE 'box_pullback' END AS recipe,
      CASE WHEN low_price_setup_score >= greatest(range_breakout_score, box_pullback_score) THEN low_price_setup_type WHEN range_breakout_score >= box_pullback_score THEN range_breakout_type ELSE box_pullback_type END AS setup_type,
      greatest(low_price_setup_score, range_breakout_score, box_pullback_score) AS setup_score FROM b6""",
    "sg_events": CTE + " SELECT * FROM ev",
    "sg_recent_events": CTE + f""", m AS ({_forward(True)}) SELECT stock_code, trade_date, recipe, setup_type, setup_score, forward_return_20 FROM ev JOIN m USING (stock_code, trade_date) JOIN (SELECT stock_code, trade_date FROM bars QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) <= 250) USING (stock_code, trade_date)""",
    "sg_forward_metrics": with_bars() + " " + _forward(False),
    "sg_forward_truncated": with_bars() + " " + _forward(True),
    "sg_zones_best": _zones(20, "setup_score DESC, trade_date"),
    "sg_zones_first": _zones(5, "trade_date"),
    "sg_event_summary": CTE + f""", m AS ({_forward(True).replace("round(", "(").replace(", 6) + 0.0", ")")}),
      j AS (SELECT ev.*, forward_return_20 AS r, max_drawdown_20 AS d FROM ev LEFT JOIN m USING (stock_code, trade_date)),
      c AS (SELECT recipe, setup_type, stock_code, count(*) AS n FROM ev GROUP BY ALL),
      t AS (SELECT recipe, setup_type, sum(n) FILTER (k <= 5) / sum(n) AS top5_share FROM (SELECT *, row_number() OVER (PARTITION BY recipe, setup_type ORDER BY n DESC, stock_code) AS k FROM c) GROUP BY ALL)
      SELECT recipe, setup_type, count(*) AS events, count(DISTINCT stock_code) AS securities, round(avg(r), 6) AS mean_return, round(quantile_cont(r, 0.5), 6) AS median_return, round(quantile_cont(r, 0.25), 6) AS p25_return,
      round(quantile_cont(r, 0.75), 6) AS p75_return, round(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) / count(r), 6) AS win_rate, round(avg(d), 6) AS mean_drawdown, round(quantile_cont(d, 0.05), 6) AS p5_drawdown,
      round(avg(r) FILTER (r > 0), 6) AS mean_win, round(avg(r) FILTER (r <= 0), 6) AS mean_loss, round(max(top5_share), 6) AS top5_share FROM j JOIN t USING (recipe, setup_type) GROUP BY recipe, setup_type""",
}
