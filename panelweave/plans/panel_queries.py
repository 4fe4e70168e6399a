"""Queries of the store, cleaning and calendar operators, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.columns import KEY, TIME, padded
from panelweave.operators import cleaning as cl
from panelweave.plans.common import bars, rounded, with_bars
from panelweave.sources import store
from panelweave.sources.bars import pad_sql, registry, table, ticks


def _registry(s, d):
    return registry(table(s, d, "supplier"), table(s, d, "nation"), table(s, d, "region"))


def _raw(s, d):
    """Bars as they might arrive: text, some of it unreadable, with an arrival number."""
    b = bars(s, d).withColumn("seq", F.xxhash64(KEY, TIME))
    day = F.datediff(TIME, F.lit("1970-01-01"))
    return b.select(
        KEY, F.when(day % 101 == 0, "n/a").otherwise(F.date_format(TIME, "yyyy-MM-dd")).alias(TIME), F.when(day % 97 == 0, "?").otherwise(F.col("open").cast("string")).alias("open"),
        F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low"), F.col("close").cast("string").alias("close"),
        F.when(day % 89 == 0, "").otherwise(F.col("volume").cast("string")).alias("volume"), "seq",
    )


def _dirty(s, d):
    """Bars with faults planted by date: missing dates and closes, negative volume, zero prices, crossed ranges, disorder."""
    day = F.datediff(TIME, F.lit("1970-01-01"))
    b = bars(s, d).withColumn("arrival", F.when(day % 500 == 0, day - 40).otherwise(day))
    out = b.withColumns({
        TIME: F.when(day % 1009 != 0, F.col(TIME)), "close": F.when(day % 101 != 0, F.col("close")),
        "volume": F.when(day % 89 == 0, -F.col("volume")).when(day % 83 == 0, 0.0).otherwise(F.col("volume")),
        "low": F.when(day % 97 == 0, 0.0).when(day % 79 == 0, F.col("high") + 1).otherwise(F.col("low")), "frequency": F.when(day % 2 == 0, "daily").otherwise("60min"),
    })
    return out.unionByName(out.where(day % 211 == 0).withColumn("arrival", F.col("arrival") + 100_000))


def _stamped(s, d):
    return bars(s, d).withColumn("stamp", F.datediff(TIME, F.lit("1970-01-01")) % 3 + 1)


def _late(s, d):
    """Bars of a year again, some of them older than what is there."""
    return bars(s, d).where(F.year(TIME) == 1996).withColumn("close", F.col("close") + 1).withColumn("stamp", F.lit(2))


def _repeated(s, d):
    """Bars that were appended twice, the second time with later stamps for some dates."""
    day = F.datediff(TIME, F.lit("1970-01-01"))
    b = bars(s, d).withColumn("stamp", F.lit(1))
    return b.unionByName(b.where(day % 5 == 0).withColumn("close", F.col("close") + 1).withColumn("stamp", F.when(day % 2 == 0, 2).otherwise(0)))


def _by_frequency(s, d):
    """Daily bars of all securities, and bars of 60 minutes of a third of them until 1997."""
    b = bars(s, d).withColumn("ts", F.col(TIME).cast("timestamp"))
    hour = b.where((F.col(KEY).cast("long") % 3 == 0) & (F.col(TIME) < "1997-01-01")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 HOURS"))
    return b.withColumn("frequency", F.lit("daily")).unionByName(hour.withColumn("frequency", F.lit("60min")))


PLANS = {"daily": ("1992-01-01 00:00:00", "1998-11-28 00:00:00"), "60min": ("1995-06-01 00:00:00", "1996-12-30 23:59:59"), "5min": ("1998-01-01 00:00:00", "1998-11-28 23:59:59")}


def calendar(s, d):
    days = table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", cl.is_trading_day(F.col("day")).alias("trading"), cl.next_trading_day(F.col("day")).alias("next_day"), cl.last_trading_day(F.col("day")).alias("last_day"))


#: Ways to write a code of the market CN, by order key.
CODES = ("concat('sz', k)", "concat(k, '.sh')", "concat(k, 'BJ')", "lpad(k, greatest(6, length(k)), '0')", "concat('6', lpad(k % 100000, 5, '0'))")


def names(s, d):
    """Aliases made from order keys, in their standard form."""
    k = F.col("o_orderkey")
    alias = lambda ns: F.element_at(F.array(*[F.lit(f" {n.upper()} ") for n in [*ns, "other"]], F.lit(None)), (k % (len(ns) + 2) + 1).cast("int"))
    code = F.element_at(F.array(*[F.expr(x.replace("k", "cast(o_orderkey as string)").replace("cast(o_orderkey as string) %", "o_orderkey %")) for x in CODES]), (k % 5 + 1).cast("int"))
    rows = table(s, d, "orders").select("o_orderkey", alias(cl.ADJUST).alias("a"), alias(cl.PERIODS).alias("p"), alias(cl.ACTIONS).alias("x"), code.alias("code"))
    return rows.select(
        "o_orderkey", cl.mapped(F.col("a"), cl.ADJUST, missing=cl.NO_ADJUST).alias("adjust"), cl.mapped(F.col("p"), cl.PERIODS, missing=cl.NO_PERIOD).alias("period"), cl.mapped(F.col("x"), cl.ACTIONS).alias("action"),
        cl.stock_code(F.col("code"), "HK").alias("hk_code"), cl.stock_code(F.col("code"), "CN").alias("cn_code"), cl.exchange_of(F.col("code"), "CN").alias("cn_exchange"), cl.exchange_of(F.col("code"), "HK").alias("hk_exchange"),
    )


def plan_text(k):
    """The text of a distribution plan, made from a number."""
    n = lambda x: x.cast("string")
    return (
        F.when(k % 11 == 0, "不派息").when(k % 13 == 0, None).when(k % 7 == 0, F.concat(F.lit("每10股送"), n(k % 5 + 1), F.lit("股派"), n(k % 90 + 10), F.lit(".5元")))
        .when(k % 5 == 0, F.concat(F.lit("每8股供"), n(k % 3 + 1), F.lit("股，供股价为"), n(k % 20), F.lit(".25元"))).when(k % 3 == 0, F.concat(F.lit("每股派末期息"), F.lit("派"), n(k % 4), F.lit(".25港元")))
        .when(k % 3 == 1, F.concat(F.lit("末期股息0."), n(k % 9 + 1), F.lit("元"))).otherwise(F.concat(F.lit("每20股转增"), n(k % 6), F.lit("股")))
    )


def plans(s, d):
    rows = table(s, d, "lineitem").select(padded(F.col("l_suppkey")).alias(KEY), F.to_date("l_shipdate").alias(TIME), plan_text(F.col("l_orderkey")).alias("plan"))
    return rounded(cl.distribution_actions(rows))


def _log(s, d):
    """A log of the orders: each was written by one of three operations."""
    kind = F.element_at(F.array(F.lit("upsert"), F.lit("fetch"), F.lit("compact")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("log_id"), F.to_date("o_orderdate").alias("logged_at"), kind.alias("operation"), F.col("o_custkey").alias("affected"))


#: Two derivations that meet without a gap: together they are one without bounds.
DERIVED_UNTIL, DERIVED_SINCE = "2024-01-15", "2024-01-16"
QUERIES = {
    "io_read_filtered": lambda s, d: rounded(store.filtered(bars(s, d), {KEY: ["00001", "00002", "00003"], "market": None}, [KEY, TIME, "close"], "1995-01-01", "1996-12-31")),
    "io_distinct": lambda s, d: bars(s, d).select(KEY).distinct(),
    "io_statistics": lambda s, d: store.statistics(bars(s, d)),
    "io_latest_dates": lambda s, d: bars(s, d).groupBy(KEY).agg(F.max(TIME).alias("latest")),
    "io_verification": lambda s, d: store.verification(bars(s, d)),
    "io_upsert": lambda s, d: store.upserted(_stamped(s, d), _late(s, d), [KEY, TIME], "stamp"),
    "io_compact": lambda s, d: store.compacted(_repeated(s, d), [KEY, TIME], ["stamp"]),
    "io_change_counts": lambda s, d: store.change_counts(bars(s, d).where(F.col(TIME) < "1996-07-01"), _late(s, d), [KEY, TIME]),
    "io_log_row": lambda s, d: store.log_row(store.change_counts(bars(s, d).where(F.col(TIME) < "1996-07-01"), _late(s, d), [KEY, TIME]), "upsert", F.lit("1998-12-01").cast("date")),
    "io_update_log": lambda s, d: store.update_log(_log(s, d), 50, {"operation": ["upsert", "compact"]}),
    "io_scalar": lambda s, d: rounded(store.scalar(bars(s, d), "sum(volume) / count(*)", {KEY: ["00001", "00002", "00007"]})),
    "io_incremental_plans": lambda s, d: store.incremental_plans(_registry(s, d), _by_frequency(s, d), PLANS),
    "io_frequency_coverage": lambda s, d: store.frequency_coverage(_registry(s, d), _by_frequency(s, d), PLANS),
    "io_partial_securities": lambda s, d: store.partial_securities(_registry(s, d), _by_frequency(s, d), ("daily", "60min")),
    "io_registry_latest": lambda s, d: store.keep_last(table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("exchange"), "c_custkey", "c_name"), ["exchange"], [F.desc("c_custkey")]),
    "io_incremental_plan": lambda s, d: store.incremental_plan(_registry(s, d), bars(s, d), "1992-01-01", "1998-12-01").drop("fresh"),
    "io_coverage": lambda s, d: store.coverage(_registry(s, d), bars(s, d), 540),
    "nm_registry": _registry,
    "nm_bars": lambda s, d: cl.normalize_bars(_raw(s, d), F.col("seq")),
    "nm_names": names,
    "nm_distribution_plans": plans,
    "qa_report": lambda s, d: cl.quality(_dirty(s, d), "arrival"),
    "qa_issues": lambda s, d: cl.quality_issues(cl.quality(_dirty(s, d), "arrival")),
    "qa_with_empty": lambda s, d: cl.with_empty(cl.quality(_dirty(s, d).where(F.col(KEY).cast("long") % 7 != 0), "arrival"), _registry(s, d)).select(KEY, "n_rows", "errors", "warnings", "empty_frame", "passed"),
    "qa_by_frequency": lambda s, d: cl.quality_by_frequency(cl.quality(_dirty(s, d), "arrival", (KEY, "frequency"))),
    "ca_calendar": calendar,
    "ca_session_filter": lambda s, d: rounded(ticks(table(s, d, "events")).where(cl.in_session(F.col("ts"), "HK")).groupBy(KEY).agg(F.count("*").alias("n"), F.sum(F.when(cl.in_session(F.col("ts"), "CN"), 1).otherwise(0)).alias("n_cn"))),
    "ca_resample": lambda s, d: cl.resample(ticks(table(s, d, "events"))),
    "ca_derived": lambda s, d: cl.derived(ticks(table(s, d, "events")), DERIVED_SINCE).unionByName(cl.derived(ticks(table(s, d, "events")), until=DERIVED_UNTIL)),
    "ca_drop_flat": lambda s, d: cl.drop_flat(_dirty(s, d).na.drop().drop("arrival", "frequency")),
    "ca_eligible": lambda s, d: cl.intraday_eligible(bars(s, d), 530),
}

_DAY = "date_diff('day', DATE '1970-01-01', trade_date)"
DIRTY = with_bars(
    f"""d0 AS (SELECT stock_code, CASE WHEN {_DAY} % 1009 <> 0 THEN trade_date END AS trade_date, open, high, CASE WHEN {_DAY} % 97 = 0 THEN 0 WHEN {_DAY} % 79 = 0 THEN high + 1 ELSE low END AS low, CASE WHEN {_DAY} % 101 <> 0 THEN close END AS "close",
      CASE WHEN {_DAY} % 89 = 0 THEN -volume WHEN {_DAY} % 83 = 0 THEN 0 ELSE volume END AS volume, CASE WHEN {_DAY} % 500 = 0 THEN {_DAY} - 40 ELSE {_DAY} END AS arrival, CASE WHEN {_DAY} % 2 = 0 THEN 'daily' ELSE '60min' END AS frequency FROM bars)""",
    f"dirty AS (SELECT * FROM d0 UNION ALL SELECT * REPLACE (arrival + 100000 AS arrival) FROM d0 WHERE {_DAY} % 211 = 0)",
)
_ISSUE = {
    "missing_required_values": "sum(CASE WHEN trade_date IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL THEN 1 ELSE 0 END)",
    "duplicate_trade_date": "count(*) - count(DISTINCT coalesce(CAST(trade_date AS VARCHAR), ''))",
    "non_monotonic_trade_date": "max(CASE WHEN trade_date IS NULL OR prev > trade_date THEN 1 ELSE 0 END)",
    "non_positive_price": "sum(CASE WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 1 ELSE 0 END)",
    "negative_volume": "sum(CASE WHEN volume < 0 THEN 1 ELSE 0 END)",
    "invalid_ohlc_relationship": "sum(CASE WHEN high < greatest(open, close, low) OR low > least(open, close, high) OR low > high THEN 1 ELSE 0 END)",
    "zero_volume_flat_bar": "sum(CASE WHEN volume <= 0 AND open = high AND high = low AND low = close THEN 1 ELSE 0 END)",
    "zero_volume_nonflat_bar": "sum(CASE WHEN volume <= 0 AND NOT (open = high AND high = low AND low = close) THEN 1 ELSE 0 END)",
}


def _qa(by: str, where: str = "true") -> str:
    return (
        DIRTY + f", qa AS (SELECT {by}, count(*) AS n_rows, " + ", ".join(f"CAST({x} AS BIGINT) AS {n}" for n, x in _ISSUE.items())
        + f" FROM (SELECT *, max(trade_date) OVER (PARTITION BY {by} ORDER BY arrival, trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM dirty WHERE {where}) GROUP BY {by})"
    )


QA = _qa("stock_code")
_sum = lambda kind: " + ".join(n for n, k in cl.ISSUES.items() if k == kind)
_case = lambda x, names, missing: "CASE " + " ".join(f"WHEN {x} % {len(names) + 2} = {i} THEN '{v}'" for i, v in enumerate(names.values())) + f" WHEN {x} % {len(names) + 2} = {len(names) + 1} THEN {missing} END"
REG = f"reg AS (SELECT {pad_sql('s_suppkey')} AS stock_code, s_name AS stock_name, n_name AS exchange, r_name AS market FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_R = lambda cols: ", ".join(f'{x} AS "{x}"' for x in cols)
FREQUENCIES = "fq AS (SELECT stock_code, trade_date::TIMESTAMP AS ts, 'daily' AS frequency FROM bars UNION ALL SELECT stock_code, trade_date + INTERVAL 10 HOUR, '60min' FROM bars WHERE CAST(stock_code AS BIGINT) % 3 = 0 AND trade_date < DATE '1997-01-01')"
OHLCV = ("open", "high", "low", "close", "volume")
_S = "(epoch_us(ts) % 86400000000 / 1000000)"
SQL = {
    "io_read_filtered": with_bars() + " SELECT stock_code, trade_date, round(close, 6) AS \"close\" FROM bars WHERE stock_code IN ('00001', '00002', '00003') AND trade_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'",
    "io_distinct": with_bars() + " SELECT DISTINCT stock_code FROM bars",
    "io_statistics": with_bars() + " SELECT count(*) AS n_rows, count(DISTINCT stock_code) AS securities, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars",
    "io_latest_dates": with_bars() + " SELECT stock_code, max(trade_date) AS latest FROM bars GROUP BY 1",
    "io_verification": with_bars() + " SELECT stock_code, count(*) AS n_rows, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars GROUP BY ROLLUP (stock_code)",
    "io_upsert": with_bars() + f" SELECT stock_code, trade_date, {_R(('open', 'high', 'low'))}, CASE WHEN year(trade_date) = 1996 AND {_DAY} % 3 < 2 THEN close + 1 ELSE close END AS \"close\", volume, CASE WHEN year(trade_date) = 1996 AND {_DAY} % 3 < 2 THEN 2 ELSE {_DAY} % 3 + 1 END AS stamp FROM bars",
    "io_compact": with_bars() + f" SELECT stock_code, trade_date, {_R(('open', 'high', 'low'))}, CASE WHEN {_DAY} % 10 = 0 THEN close + 1 ELSE close END AS \"close\", volume, CASE WHEN {_DAY} % 10 = 0 THEN 2 ELSE 1 END AS stamp FROM bars",
    "io_change_counts": with_bars() + " SELECT sum(CASE WHEN trade_date >= DATE '1996-07-01' THEN 1 ELSE 0 END) AS inserted, sum(CASE WHEN trade_date < DATE '1996-07-01' THEN 1 ELSE 0 END) AS updated FROM bars WHERE year(trade_date) = 1996",
    "io_update_log": """SELECT o_orderkey AS log_id, CAST(o_orderdate AS DATE) AS logged_at, CASE o_orderkey % 3 WHEN 0 THEN 'upsert' ELSE 'compact' END AS operation, o_custkey AS affected FROM orders
      WHERE o_orderkey % 3 <> 1 ORDER BY logged_at DESC, log_id DESC LIMIT 50""",
    "io_log_row": with_bars() + " SELECT 'upsert' AS operation, DATE '1998-12-01' AS logged_at, sum(CASE WHEN trade_date >= DATE '1996-07-01' THEN 1 ELSE 0 END) AS inserted, sum(CASE WHEN trade_date < DATE '1996-07-01' THEN 1 ELSE 0 END) AS updated, count(*) AS affected FROM bars WHERE year(trade_date) = 1996",
    "io_scalar": with_bars() + " SELECT round(sum(volume) / count(*), 6) AS value FROM bars WHERE stock_code IN ('00001', '00002', '00007')",
    "io_incremental_plans": with_bars(REG, FREQUENCIES) + """, p AS (SELECT DISTINCT stock_code, frequency, start_ts, end_ts FROM reg, (VALUES ('daily', TIMESTAMP '1992-01-01', TIMESTAMP '1998-11-28'), ('60min', TIMESTAMP '1995-06-01', TIMESTAMP '1996-12-30 23:59:59'), ('5min', TIMESTAMP '1998-01-01', TIMESTAMP '1998-11-28 23:59:59')) v(frequency, start_ts, end_ts)),
      n AS (SELECT p.*, latest FROM p LEFT JOIN (SELECT stock_code, frequency, max(ts) AS latest FROM fq GROUP BY ALL) USING (stock_code, frequency))
      SELECT stock_code, frequency, start_ts, end_ts, latest, CASE WHEN latest IS NULL THEN start_ts WHEN frequency = 'daily' THEN date_trunc('day', greatest(start_ts, latest - INTERVAL 7 DAY)) ELSE greatest(start_ts, latest - INTERVAL 15 DAY) END AS fetch_from,
        coalesce(latest >= end_ts, false) AS fresh, NOT coalesce(latest >= end_ts, false) AS should_fetch FROM n""",
    "io_frequency_coverage": with_bars(REG, FREQUENCIES) + """ SELECT f AS frequency, sum(coalesce(n, 0)) AS n_rows, count(n) AS with_rows, count(*) - count(n) AS missing FROM (SELECT DISTINCT stock_code, f FROM reg, (VALUES ('daily'), ('60min'), ('5min')) v(f)) LEFT JOIN (SELECT stock_code, frequency AS f, count(*) AS n FROM fq GROUP BY ALL) USING (stock_code, f) GROUP BY 1""",
    "io_partial_securities": with_bars(REG, FREQUENCIES) + " SELECT stock_code, count(DISTINCT frequency) AS n_have, '60min' AS lacking FROM reg JOIN fq USING (stock_code) GROUP BY 1 HAVING count(DISTINCT frequency) = 1 AND min(frequency) = 'daily'",
    "io_registry_latest": "SELECT n_name AS exchange, max(c_custkey) AS c_custkey, arg_max(c_name, c_custkey) AS c_name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "io_incremental_plan": with_bars(REG) + " SELECT reg.stock_code, max(trade_date) AS latest, coalesce(greatest(DATE '1992-01-01', CAST(max(trade_date) - INTERVAL 7 DAY AS DATE)), DATE '1992-01-01') AS fetch_from, NOT coalesce(DATE '1998-12-01' - max(trade_date) <= 3, false) AS should_fetch FROM reg LEFT JOIN bars USING (stock_code) GROUP BY 1",
    "io_coverage": with_bars(REG) + " SELECT reg.stock_code, count(trade_date) AS n_rows, CASE WHEN count(trade_date) = 0 THEN 'missing' WHEN count(trade_date) < 540 THEN 'partial' ELSE 'complete' END AS state FROM reg LEFT JOIN bars USING (stock_code) GROUP BY 1",
    "nm_registry": "WITH " + REG + " SELECT * FROM reg",
    "nm_bars": with_bars() + f" SELECT stock_code, trade_date, {_R(('open', 'high', 'low', 'close'))}, CASE WHEN {_DAY} % 89 = 0 THEN 0.0 ELSE volume END AS volume FROM bars WHERE {_DAY} % 101 <> 0 AND {_DAY} % 97 <> 0",
    "nm_names": f"""WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders),
      t AS (SELECT *, CASE o_orderkey % 5 WHEN 3 THEN {pad_sql('k', 6)} WHEN 4 THEN '6' || {pad_sql('o_orderkey % 100000')} ELSE k END AS digits, CASE o_orderkey % 5 WHEN 1 THEN 'SH' WHEN 2 THEN 'BJ' END AS tail FROM o),
      g AS (SELECT *, CASE WHEN tail IS NOT NULL THEN {pad_sql('digits', 6)} || '.' || tail WHEN len(digits) <> 6 THEN digits WHEN digits[1] IN ('5', '6', '9') THEN digits || '.SH' WHEN digits[1] IN ('0', '2', '3') THEN digits || '.SZ' WHEN digits[1] IN ('4', '8') THEN digits || '.BJ' ELSE digits END AS cn_code FROM t)
      SELECT o_orderkey, {_case('o_orderkey', cl.ADJUST, "'qfq'")} AS adjust, {_case('o_orderkey', cl.PERIODS, "'daily'")} AS period, {_case('o_orderkey', cl.ACTIONS, 'NULL')} AS action, {pad_sql('digits')} AS hk_code, cn_code, 'HKEX' AS hk_exchange,
        CASE WHEN cn_code LIKE '%.SH' OR cn_code[1] IN ('5', '6', '9') THEN 'SSE' WHEN cn_code LIKE '%.SZ' OR cn_code[1] IN ('0', '2', '3') THEN 'SZSE' WHEN cn_code LIKE '%.BJ' OR cn_code[1] IN ('4', '8') THEN 'BSE' ELSE 'CN' END AS cn_exchange FROM g""",
    "nm_distribution_plans": f"""WITH p AS (SELECT {pad_sql('l_suppkey')} AS stock_code, CAST(l_shipdate AS DATE) AS trade_date, l_orderkey AS k FROM lineitem WHERE l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0)
      SELECT stock_code, trade_date, 'cash_dividend' AS action, round(CASE WHEN k % 7 = 0 THEN (k % 90 + 10.5) / 10 WHEN k % 3 = 0 THEN k % 4 + 0.25 ELSE (k % 9 + 1) / 10 END, 6) AS cash, CAST(NULL AS DOUBLE) AS ratio, CAST(NULL AS DOUBLE) AS price FROM p WHERE k % 7 = 0 OR (k % 5 <> 0 AND k % 3 < 2)
      UNION ALL SELECT stock_code, trade_date, 'bonus_issue', NULL, round((k % 5 + 1) / 10, 6), NULL FROM p WHERE k % 7 = 0
      UNION ALL SELECT stock_code, trade_date, 'bonus_issue', NULL, round(k % 6 / 20, 6), NULL FROM p WHERE k % 7 <> 0 AND k % 5 <> 0 AND k % 3 = 2 AND k % 6 > 0
      UNION ALL SELECT stock_code, trade_date, 'rights_issue', NULL, round((k % 3 + 1) / 8, 6), k % 20 + 0.25 FROM p WHERE k % 7 <> 0 AND k % 5 = 0""",
    "qa_report": QA + f" SELECT *, {_sum('error')} AS errors, {_sum('warning')} AS warnings, {_sum('error')} = 0 AS passed FROM qa",
    "qa_issues": QA + " SELECT stock_code, issue, n, CASE WHEN issue LIKE 'zero%' THEN 'warning' ELSE 'error' END AS severity FROM (UNPIVOT (SELECT * EXCLUDE (n_rows) FROM qa) ON COLUMNS(* EXCLUDE (stock_code)) INTO NAME issue VALUE n) WHERE n > 0",
    "qa_with_empty": _qa("stock_code", "CAST(stock_code AS BIGINT) % 7 <> 0") + f", {REG} SELECT stock_code, coalesce(n_rows, 0) AS n_rows, coalesce({_sum('error')}, 0) AS errors, coalesce({_sum('warning')}, 1) AS warnings, CASE WHEN n_rows IS NULL THEN 1 ELSE 0 END AS empty_frame, coalesce({_sum('error')}, 0) = 0 AS passed FROM (SELECT DISTINCT stock_code FROM reg) LEFT JOIN qa USING (stock_code)",
    "qa_by_frequency": _qa("stock_code, frequency") + f" SELECT frequency, count(*) FILTER ({_sum('error')} > 0) AS error_stocks, count(*) FILTER ({_sum('warning')} > 0) AS warning_stocks, CAST(sum({_sum('error')}) AS BIGINT) AS error_issues, CAST(sum({_sum('warning')}) AS BIGINT) AS warning_issues FROM qa GROUP BY 1",
    "ca_calendar": """SELECT DISTINCT day, isodow(day) < 6 AS trading, CAST(day + CASE isodow(day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS DATE) AS next_day, CAST(day - CASE isodow(day) WHEN 7 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS DATE) AS last_day
      FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders)""",
    "ca_session_filter": f"""SELECT event_type AS stock_code, count(*) AS n, CAST(sum(CASE WHEN {_S} BETWEEN 34200 AND 41400 OR {_S} BETWEEN 46800 AND 54000 THEN 1 ELSE 0 END) AS BIGINT) AS n_cn FROM events
      WHERE isodow(ts) < 6 AND ({_S} BETWEEN 34200 AND 43200 OR {_S} BETWEEN 46800 AND 57600) GROUP BY 1""",
    "ca_resample": f"""WITH e AS (SELECT event_type AS stock_code, ts, event_id, value + 1 AS price, unnest([5, 15, 30, 60]) AS minutes FROM events WHERE {_S} BETWEEN 34200 AND 43200 OR {_S} BETWEEN 46800 AND 57600),
      b AS (SELECT *, CAST(ceil(epoch_us(ts) / 1000000 / (minutes * 60)) * (minutes * 60) AS BIGINT) AS e_s FROM e)
      SELECT stock_code, CAST(minutes AS INT) AS minutes, make_timestamp(e_s * 1000000) AS end_ts, arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id)) AS "close", CAST(count(*) AS DOUBLE) AS volume FROM b GROUP BY ALL""",
    "ca_drop_flat": DIRTY + f" SELECT stock_code, trade_date, {_R(OHLCV)} FROM dirty WHERE close IS NOT NULL AND trade_date IS NOT NULL AND NOT (volume <= 0 AND open = high AND high = low AND low = close)",
    "ca_eligible": with_bars() + " SELECT stock_code, count(*) AS n FROM bars GROUP BY 1 HAVING count(*) >= 530",
}
SQL["ca_derived"] = SQL["ca_resample"]
