"""Evaluation of four factors over daily bars, with the SQL that checks each table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.columns import TIME
from panelweave.operators import factors, validation as va
from panelweave.plans.common import bars, over, rounded, tasks, with_bars
from panelweave.sources.bars import table

NAMES, HORIZONS = ("KMID", "MA5", "ROC10", "VMA20"), (1, 5, 20)
E = "1e-12"


def features(spark, sf_dir) -> DataFrame:
    return factors.to_long(factors.compute(bars(spark, sf_dir), NAMES))


def frame(spark, sf_dir) -> DataFrame:
    return va.frame_of(factors.compute(bars(spark, sf_dir), NAMES, keep=("close",)), NAMES, HORIZONS)


def dated(spark, sf_dir, names=NAMES) -> DataFrame:
    """Features and returns of all dates, dealt by date once for all that is made of them."""
    return va.by_dates(factors.compute(bars(spark, sf_dir), names, also=va.returns_ahead(HORIZONS)), names, HORIZONS, tasks(spark, sf_dir))


def _ic(spark, sf_dir, rows=None, rank_method="average") -> DataFrame:
    return va.ic_of_set(rows or dated(spark, sf_dir), NAMES, HORIZONS, rank_method=rank_method)


#: Values of factors that are exchanged by date at one time, and the most ranges of dates that bars are read for.
VALUES_AT_ONCE, MOST_PARTS = 150_000_000, 12


def ic_of_all(spark, sf_dir) -> DataFrame:
    """Correlations of the whole set, a range of dates at a time where the table is large."""
    trades, names, parts = table(spark, sf_dir, "lineitem"), factors.factor_names(), tasks(spark, sf_dir)
    ahead, ranges = va.returns_ahead(HORIZONS), -(-trades.count() * len(names) // VALUES_AT_ONCE)
    dated = lambda near, only: va.by_dates(factors.compute(near, names, also=ahead, only=only, pack=True, prepared=True), names, HORIZONS, parts)
    edges = va.date_edges(trades, F.to_date("l_shipdate"), min(ranges, MOST_PARTS)) if ranges > 1 else []
    return va.ic_in_parts(factors.prepare(bars(spark, sf_dir)), dated, names, HORIZONS, edges, max(factors.WINDOWS) + 1)


def _slopes(spark, sf_dir, rows=None) -> DataFrame:
    return va.mean_slopes(va.slopes_of_set(rows or dated(spark, sf_dir), NAMES, HORIZONS))


def _turnover(spark, sf_dir, rows=None) -> DataFrame:
    return va.turnover_of_set(va.buckets_of_set(rows or dated(spark, sf_dir), NAMES), NAMES, tasks(spark, sf_dir))


def _members(spark, sf_dir) -> DataFrame:
    return va.quantile_membership(features(spark, sf_dir))


def _buckets(spark, sf_dir, rows=None) -> DataFrame:
    return va.quantile_returns_of_set(rows or dated(spark, sf_dir), NAMES, HORIZONS)


def joined(spark, sf_dir) -> DataFrame:
    """The frame from stored features and returns, which have to be joined."""
    return va.validation_frame(features(spark, sf_dir), va.forward_returns(bars(spark, sf_dir), HORIZONS))


def decays(spark, sf_dir) -> DataFrame:
    rows = dated(spark, sf_dir)
    return va.decay_summary(va.summarize_ic(_ic(spark, sf_dir, rows)), va.summarize_long_short(va.long_short(_buckets(spark, sf_dir, rows))))


def bounded(spark, sf_dir) -> DataFrame:
    """How many pairs of value and return a feature keeps when it is so large that a part of it passes the bound."""
    large = features(spark, sf_dir).withColumn("feature_value", F.col("feature_value") * va.LARGEST)
    return va.validation_frame(large, va.forward_returns(bars(spark, sf_dir), HORIZONS)).groupBy("feature_name", "horizon").agg(F.count("*").alias("n"), F.max(F.abs("feature_value") > va.LARGEST).alias("beyond"))


QUERIES = {
    "va_forward_returns": lambda s, d: rounded(va.forward_returns(bars(s, d), HORIZONS)),
    "va_frame": lambda s, d: rounded(joined(s, d)),
    "va_ic_by_date": lambda s, d: rounded(_ic(s, d)),
    "va_ic_p_values": lambda s, d: rounded(va.with_p_values(_ic(s, d)).drop("ic_t", "rank_ic_t")),
    "va_ic_t_values": lambda s, d: rounded(va.with_p_values(_ic(s, d)).select("feature_name", TIME, "horizon", "n", "ic_t", "rank_ic_t"), 5),
    "va_ic_summary": lambda s, d: rounded(va.summarize_ic(_ic(s, d))),
    "va_ic_of_set": lambda s, d: rounded(va.summarize_ic(ic_of_all(s, d)), 5),
    "va_ic_matrix": lambda s, d: rounded(_ic(s, d)),
    "va_ic_significance": lambda s, d: rounded(va.significance(_ic(s, d)), 5),
    "va_ic_min_rank": lambda s, d: rounded(va.summarize_ic(_ic(s, d, rank_method="min"))),
    "va_monthly_ic": lambda s, d: rounded(va.monthly_ic(_ic(s, d))),
    "va_quantile_membership": lambda s, d: rounded(_members(s, d)),
    "va_quantile_share": lambda s, d: rounded(va.quantile_membership(features(s, d), 3, bucket_method="share")),
    "va_quantile_returns": lambda s, d: rounded(_buckets(s, d)),
    "va_quantile_summary": lambda s, d: rounded(va.summarize_quantiles(_buckets(s, d))),
    "va_long_short": lambda s, d: rounded(va.long_short(_buckets(s, d))),
    "va_long_short_summary": lambda s, d: rounded(va.summarize_long_short(va.long_short(_buckets(s, d)))),
    "va_turnover": lambda s, d: rounded(_turnover(s, d)),
    "va_turnover_summary": lambda s, d: rounded(va.summarize_turnover(_turnover(s, d))),
    "va_decay": lambda s, d: rounded(va.decay(va.summarize_ic(_ic(s, d)), "rank_ic_mean"), 5),
    "va_decay_summary": lambda s, d: rounded(decays(s, d), 5),
    "va_bounded": lambda s, d: bounded(s, d),
    "va_factor_correlation": lambda s, d: rounded(va.factor_correlation(features(s, d))),
    "va_rank_autocorrelation": lambda s, d: rounded(va.rank_autocorrelation(features(s, d))),
    "va_fama_macbeth": lambda s, d: rounded(_slopes(s, d), 5),
    "va_alpha_beta": lambda s, d: rounded(va.alpha_beta(frame(s, d)), 5),
    "va_monotonicity": lambda s, d: rounded(va.monotonicity(va.summarize_quantiles(_buckets(s, d)))),
}

_FULL = lambda x, n: f"CASE WHEN count({x}) OVER w{n} = {n} THEN avg({x}) OVER w{n} END"
BASE = with_bars(
    f"""wide AS (SELECT stock_code, trade_date, (close - open) / (open + {E}) AS "KMID", ({_FULL("close", 5)}) / (close + {E}) AS "MA5",
    lag(close, 10) OVER s / (close + {E}) AS "ROC10", ({_FULL("volume", 20)}) / (volume + {E}) AS "VMA20"
    FROM bars WINDOW s AS (PARTITION BY stock_code ORDER BY trade_date), w5 AS {over(5)}, w20 AS {over(20)})""",
    'feats AS (SELECT * FROM (UNPIVOT wide ON "KMID", "MA5", "ROC10", "VMA20" INTO NAME feature_name VALUE feature_value))',
    "rets AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT stock_code, trade_date, {h} AS horizon, lead(close, {h}) OVER (PARTITION BY stock_code ORDER BY trade_date) / close - 1 AS forward_return FROM bars" for h in HORIZONS) + ") WHERE forward_return IS NOT NULL)",
    "frame AS (SELECT feats.*, horizon, forward_return FROM feats JOIN rets USING (stock_code, trade_date))",
    """ranked AS (SELECT *, rank() OVER (PARTITION BY feature_name, trade_date, horizon ORDER BY feature_value) + (count(*) OVER (PARTITION BY feature_name, trade_date, horizon, feature_value) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY feature_name, trade_date, horizon ORDER BY forward_return) + (count(*) OVER (PARTITION BY feature_name, trade_date, horizon, forward_return) - 1) / 2 AS ry,
    CAST(rank() OVER (PARTITION BY feature_name, trade_date, horizon ORDER BY feature_value) AS DOUBLE) AS mx, CAST(rank() OVER (PARTITION BY feature_name, trade_date, horizon ORDER BY forward_return) AS DOUBLE) AS my FROM frame)""",
)


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN var_pop({x}) > {E} AND var_pop({y}) > {E} THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"


def _ic_sql(x: str = "rx", y: str = "ry") -> str:
    return BASE + f""", ic AS (SELECT feature_name, trade_date, horizon, count(*) AS n, greatest(least({_corr('feature_value', 'forward_return')}, 1), -1) AS ic,
    greatest(least({_corr(x, y)}, 1), -1) AS rank_ic FROM ranked GROUP BY ALL
    HAVING count(*) >= 5 AND min(feature_value) < max(feature_value) AND min(forward_return) < max(forward_return))"""


def _moments(x: str, name: str) -> str:
    return f"""round(avg({x}), 6) + 0.0 AS {name}_mean, round(stddev_samp({x}), 6) AS {name}_std,
    round(CASE WHEN stddev_samp({x}) > {E} THEN avg({x}) / stddev_samp({x}) * sqrt(count({x})) END, 6) + 0.0 AS {name}_ir,
    round(sum(CASE WHEN {x} > {E} THEN 1 ELSE 0 END) / count(*), 6) AS {name}_positive"""


SUMMARY = f"SELECT feature_name, horizon, count(*) AS dates, {_moments('ic', 'ic')}, {_moments('rank_ic', 'rank_ic')} FROM ic GROUP BY ALL"
MEMBERS = BASE + """, members AS (SELECT stock_code, trade_date, feature_name, feature_value, bucket FROM (
    SELECT *, count(*) OVER (PARTITION BY feature_name, trade_date) AS n, ntile(5) OVER (PARTITION BY feature_name, trade_date ORDER BY feature_value, stock_code) AS bucket FROM feats) WHERE n >= 5)"""
BUCKETS = MEMBERS + """, buckets AS (SELECT feature_name, trade_date, horizon, bucket, avg(forward_return) AS mean_return, count(*) AS n FROM (
    SELECT *, count(*) OVER (PARTITION BY feature_name, trade_date, horizon) AS m FROM members JOIN rets USING (stock_code, trade_date)) WHERE m >= 5 GROUP BY ALL)"""
SPREAD = BUCKETS + """, spread AS (SELECT feature_name, trade_date, horizon, arg_max(mean_return, bucket) AS top, arg_min(mean_return, bucket) AS bottom,
    arg_max(mean_return, bucket) - arg_min(mean_return, bucket) AS spread FROM buckets GROUP BY ALL HAVING count(*) > 1)"""
QSUM = """qs AS (SELECT feature_name, horizon, bucket, avg(mean_return) AS mean_return, stddev_samp(mean_return) AS std_return, avg(n) AS mean_n, count(*) AS dates FROM buckets GROUP BY ALL)"""
TURN = MEMBERS + """, days AS (SELECT feature_name, trade_date, lag(trade_date) OVER (PARTITION BY feature_name ORDER BY trade_date) AS prev FROM (SELECT DISTINCT feature_name, trade_date FROM members)),
    size AS (SELECT feature_name, bucket, trade_date, count(*) AS n FROM members GROUP BY ALL),
    kept AS (SELECT a.feature_name, a.bucket, a.trade_date, count(*) AS retained FROM members a JOIN days d ON a.feature_name = d.feature_name AND a.trade_date = d.trade_date
      JOIN members b ON b.feature_name = a.feature_name AND b.bucket = a.bucket AND b.stock_code = a.stock_code AND b.trade_date = d.prev GROUP BY ALL),
    turn AS (SELECT s.feature_name, s.bucket, s.trade_date, s.n AS size, p.n AS previous, coalesce(retained, 0) AS retained, s.n - coalesce(retained, 0) AS entered, p.n - coalesce(retained, 0) AS exited,
      1 - coalesce(retained, 0) / greatest(s.n, p.n) AS turnover FROM size s JOIN days d USING (feature_name, trade_date)
      JOIN size p ON p.feature_name = s.feature_name AND p.bucket = s.bucket AND p.trade_date = d.prev LEFT JOIN kept k ON k.feature_name = s.feature_name AND k.bucket = s.bucket AND k.trade_date = s.trade_date)"""
T = lambda r, n: f"CASE WHEN {n} > 2 AND abs({r}) < 1 THEN {r} * sqrt(({n} - 2) / (1 - {r} * {r})) END"


def _p(t: str, df: str) -> str:
    """Two-sided p of Student's t, from the finite series of its distribution with factors by the gamma function."""
    cos2, angle = f"({df} / ({df} + ({t}) * ({t})))", f"atan(abs({t}) / sqrt({df}))"
    even = f"sqrt(1 - {cos2}) * list_sum(list_transform(range(0, CAST({df} AS BIGINT) // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) - 0.5 * ln(pi()) + j * ln({cos2}))))"
    odd = f"2 / pi() * ({angle} + sqrt(1 - {cos2}) * sqrt({cos2}) * coalesce(list_sum(list_transform(range(0, (CAST({df} AS BIGINT) - 1) // 2), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5) + j * ln({cos2})))), 0))"
    return f"greatest(0, 1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


_mean_t = lambda x: f"CASE WHEN {x}_s > {E} THEN {x}_mean / {x}_s * sqrt({x}_n) END"
SQL = {
    "va_ic_significance": _ic_sql() + f""", g AS (SELECT feature_name, horizon, {", ".join(f"count({x}) AS {x}_n, avg({x}) AS {x}_mean, stddev_samp({x}) AS {x}_s" for x in ("ic", "rank_ic"))} FROM ic GROUP BY ALL),
      t AS (SELECT *, {_mean_t("ic")} AS ic_t, {_mean_t("rank_ic")} AS rank_ic_t FROM g)
      SELECT feature_name, horizon, {", ".join(f"{x}_n, round({x}_mean, 5) + 0.0 AS {x}_mean, round({x}_t, 5) + 0.0 AS {x}_t, round({_p(f'{x}_t', f'({x}_n - 1)')}, 5) + 0.0 AS {x}_p" for x in ("ic", "rank_ic"))} FROM t""",
    "va_ic_p_values": _ic_sql() + f""", t AS (SELECT *, {T('ic', 'n')} AS ic_t, {T('rank_ic', 'n')} AS rank_ic_t FROM ic)
      SELECT feature_name, trade_date, horizon, n, round(ic, 6) + 0.0 AS ic, round(rank_ic, 6) + 0.0 AS rank_ic,
      {", ".join(f"round(CASE WHEN abs({x}) >= 1 THEN 0 WHEN n > 2 THEN {_p(f'{x}_t', '(n - 2)')} END, 6) + 0.0 AS {x}_p" for x in ("ic", "rank_ic"))} FROM t""",
    "va_forward_returns": BASE + " SELECT stock_code, trade_date, horizon, round(forward_return, 6) + 0.0 AS forward_return FROM rets",
    "va_frame": BASE + " SELECT stock_code, trade_date, feature_name, round(feature_value, 6) + 0.0 AS feature_value, horizon, round(forward_return, 6) + 0.0 AS forward_return FROM frame",
    "va_ic_by_date": _ic_sql() + " SELECT feature_name, trade_date, horizon, n, round(ic, 6) + 0.0 AS ic, round(rank_ic, 6) + 0.0 AS rank_ic FROM ic",
    "va_ic_t_values": _ic_sql() + f" SELECT feature_name, trade_date, horizon, n, round({T('ic', 'n')}, 5) + 0.0 AS ic_t, round({T('rank_ic', 'n')}, 5) + 0.0 AS rank_ic_t FROM ic",
    "va_ic_summary": _ic_sql() + " " + SUMMARY,
    "va_ic_min_rank": _ic_sql("mx", "my") + " " + SUMMARY,
    "va_monthly_ic": _ic_sql() + " SELECT feature_name, horizon, CAST(year(trade_date) AS INT) AS year, CAST(month(trade_date) AS INT) AS month, round(avg(ic), 6) + 0.0 AS ic, round(avg(rank_ic), 6) + 0.0 AS rank_ic, count(*) AS dates FROM ic GROUP BY ALL",
    "va_quantile_membership": MEMBERS + " SELECT stock_code, trade_date, feature_name, round(feature_value, 6) + 0.0 AS feature_value, CAST(bucket AS INT) AS bucket FROM members",
    "va_quantile_share": BASE + """ SELECT stock_code, trade_date, feature_name, round(feature_value, 6) + 0.0 AS feature_value, CAST(ceil(nth * 3 / n) AS INT) AS bucket FROM (
      SELECT *, count(*) OVER (PARTITION BY feature_name, trade_date) AS n, row_number() OVER (PARTITION BY feature_name, trade_date ORDER BY feature_value, stock_code) AS nth FROM feats) WHERE n >= 5""",
    "va_quantile_returns": BUCKETS + " SELECT feature_name, trade_date, horizon, CAST(bucket AS INT) AS bucket, round(mean_return, 6) + 0.0 AS mean_return, n FROM buckets",
    "va_quantile_summary": BUCKETS + ", " + QSUM + " SELECT feature_name, horizon, CAST(bucket AS INT) AS bucket, round(mean_return, 6) + 0.0 AS mean_return, round(std_return, 6) AS std_return, round(mean_n, 6) AS mean_n, dates, round(std_return / sqrt(dates), 6) AS std_error FROM qs",
    "va_long_short": SPREAD + " SELECT feature_name, trade_date, horizon, round(top, 6) + 0.0 AS top, round(bottom, 6) + 0.0 AS bottom, round(spread, 6) + 0.0 AS spread FROM spread",
    "va_long_short_summary": SPREAD + f" SELECT feature_name, horizon, count(*) AS dates, {_moments('spread', 'spread')} FROM spread GROUP BY ALL",
    "va_turnover": TURN + " SELECT feature_name, CAST(bucket AS INT) AS bucket, trade_date, size, previous, retained, entered, exited, round(turnover, 6) + 0.0 AS turnover FROM turn",
    "va_turnover_summary": TURN + ' SELECT feature_name, CAST(bucket AS INT) AS bucket, round(avg(turnover), 6) AS mean, round(stddev_samp(turnover), 6) AS std, round(min(turnover), 6) + 0.0 AS least, round(max(turnover), 6) AS "most", count(*) AS dates FROM turn GROUP BY ALL',
    "va_decay": _ic_sql() + """, m AS (SELECT feature_name, horizon, avg(rank_ic) AS metric FROM ic GROUP BY ALL)
      SELECT feature_name, horizon, round(metric, 5) + 0.0 AS metric, round(abs(metric) / first_value(abs(metric)) OVER (PARTITION BY feature_name ORDER BY horizon), 5) AS decay FROM m""",
    "va_factor_correlation": BASE + f""" SELECT a.feature_name AS feature_a, b.feature_name AS feature_b, round({_corr('a.feature_value', 'b.feature_value')}, 6) + 0.0 AS correlation, count(*) AS n
      FROM feats a JOIN feats b USING (stock_code, trade_date) WHERE a.feature_name < b.feature_name GROUP BY ALL""",
    "va_rank_autocorrelation": BASE + f""", r AS (SELECT *, rank() OVER (PARTITION BY feature_name, trade_date ORDER BY feature_value) + (count(*) OVER (PARTITION BY feature_name, trade_date, feature_value) - 1) / 2 AS rk,
      dense_rank() OVER (PARTITION BY feature_name ORDER BY trade_date) AS nth FROM feats),
      d AS (SELECT a.feature_name, a.nth, {_corr('a.rk', 'b.rk')} AS r, count(*) AS n FROM r a JOIN r b ON a.feature_name = b.feature_name AND a.stock_code = b.stock_code AND a.nth = b.nth + 1 GROUP BY ALL HAVING count(*) >= 5)
      SELECT feature_name, round(avg(r), 6) + 0.0 AS autocorrelation, count(r) AS dates FROM d GROUP BY ALL""",
    "va_fama_macbeth": BASE + f""", d AS (SELECT feature_name, trade_date, horizon, count(*) AS n, regr_slope(forward_return, feature_value) AS slope FROM frame GROUP BY ALL HAVING count(*) >= 5 AND var_pop(feature_value) > {E}),
      g AS (SELECT feature_name, horizon, avg(slope) AS m, CASE WHEN stddev_samp(slope) > {E} THEN avg(slope) / (stddev_samp(slope) / sqrt(count(*))) END AS t, count(*) AS dates FROM d GROUP BY ALL HAVING count(*) >= 10)
      SELECT feature_name, horizon, round(m, 5) + 0.0 AS slope, round(t, 5) + 0.0 AS t, dates, round({_p('t', '(dates - 1)')}, 5) + 0.0 AS p FROM g""",
    "va_alpha_beta": BASE + f""", z AS (SELECT *, (feature_value - avg(feature_value) OVER g) / CASE WHEN stddev_samp(feature_value) OVER g > {E} THEN stddev_samp(feature_value) OVER g ELSE 1 END AS z FROM frame WINDOW g AS (PARTITION BY feature_name, trade_date, horizon)),
      d AS (SELECT feature_name, trade_date, horizon, sum(z * forward_return) / nullif(sum(abs(z)), 0) AS own, avg(forward_return) AS market FROM z GROUP BY ALL),
      f AS (SELECT feature_name, horizon, regr_slope(own, market) AS beta, regr_intercept(own, market) * 252 AS alpha, {_corr('own', 'market')} AS r, count(*) AS dates FROM d WHERE own IS NOT NULL GROUP BY ALL)
      SELECT feature_name, horizon, round(alpha, 5) + 0.0 AS alpha, round(beta, 5) + 0.0 AS beta, round({T('r', 'dates')}, 5) + 0.0 AS beta_t, dates FROM f WHERE dates >= 10""",
    "va_monotonicity": BUCKETS + ", " + QSUM + f""", r AS (SELECT *, rank() OVER (PARTITION BY feature_name, horizon ORDER BY mean_return) + (count(*) OVER (PARTITION BY feature_name, horizon, mean_return) - 1) / 2 AS rk FROM qs),
      m AS (SELECT feature_name, horizon, {_corr('bucket', 'rk')} AS rho, count(*) AS buckets FROM r GROUP BY ALL HAVING count(*) >= 3)
      SELECT feature_name, horizon, round(rho, 6) + 0.0 AS rho, buckets, round((abs(rho) + 1) / 2, 6) AS score FROM m""",
}
_share = lambda x: f"round(abs({x}) / nullif(first_value(abs({x})) OVER w, 0), 5) AS"
SQL["va_decay_summary"] = _ic_sql() + ", " + SPREAD.removeprefix(BASE + ", ") + f""", m AS (SELECT feature_name, horizon, avg(ic) AS ic_mean, avg(rank_ic) AS rank_ic_mean FROM ic GROUP BY ALL), sm AS (SELECT feature_name, horizon, avg(spread) AS spread_mean FROM spread GROUP BY ALL)
  SELECT feature_name, horizon, round(ic_mean, 5) + 0.0 AS ic_mean, round(rank_ic_mean, 5) + 0.0 AS rank_ic_mean, round(spread_mean, 5) + 0.0 AS spread_mean, {_share('ic_mean')} ic_decay, {_share('rank_ic_mean')} rank_ic_decay, {_share('spread_mean')} spread_decay, first_value(horizon) OVER w AS base_horizon
  FROM m LEFT JOIN sm USING (feature_name, horizon) WINDOW w AS (PARTITION BY feature_name ORDER BY horizon)"""
SQL["va_bounded"] = BASE + " SELECT feature_name, horizon, count(*) AS n, false AS beyond FROM frame WHERE abs(feature_value * 1e150) <= 1e150 GROUP BY ALL"
SQL["va_ic_matrix"] = SQL["va_ic_by_date"]
