"""Queries of the layers beside the bars, with SQL. Raw rows, some unreadable, are made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.columns import KEY, TIME, padded
from panelweave.operators import cleaning as cl, layers as ly
from panelweave.plans import validation_queries as vq
from panelweave.plans.common import bars, rounded, with_bars
from panelweave.plans.panel_queries import REG, SQL as PANEL, _raw, _registry, plan_text
from panelweave.sources.bars import pad_sql, table

c = F.col


def raw_signals(s, d):
    k = c("o_orderkey")
    return table(s, d, "orders").select(
        (c("o_custkey") % 1000 + 1).alias(KEY), F.when(k % 17 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.when(k % 2 == 0, "buy").otherwise("sell").alias("signal_type"),
        F.when(k % 7 == 0, "x").otherwise((k % 10).cast("string")).alias("signal_strength"), (c("o_totalprice") / 1000).cast("string").alias("score"),
        F.when(k % 3 == 0, "true").when(k % 3 == 1, "false").alias("actionable"), F.concat(F.lit("b"), (k % 4).cast("string")).alias("batch_id"), k.alias("nth"),
    )


def signals(s, d):
    return ly.normalize_signals(raw_signals(s, d), c("nth"), signal_set="orders", strategy="plain")


def trades(s, d):
    k = c("l_orderkey")
    rows = table(s, d, "lineitem").select(
        c("l_suppkey").alias(KEY), F.to_date("l_shipdate").alias(TIME), F.concat(k.cast("string"), F.lit("-"), (c("l_linenumber") % 2).cast("string")).alias("order_id"), F.when(c("l_linenumber") % 3 == 0, "sell").otherwise("buy").alias("trade_type"),
        (c("l_extendedprice") / c("l_quantity")).alias("price"), c("l_quantity").cast("string").alias("shares"), c("l_extendedprice").alias("amount"), F.when(k % 3 == 0, "free").otherwise((k % 10).cast("string")).alias("commission"),
        F.struct(k, "l_linenumber", "l_partkey", "l_extendedprice").alias("nth"),
    )
    return ly.normalize_trades(rows, c("nth"), account_id="main", source="lines")


def features(s, d):
    b = bars(s, d)
    wide = b.select(KEY, TIME, (c("high") / c("low") - 1).alias("range"), F.when(c("open") != c("close"), c("close") / c("open") - 1).alias("body"), c("volume").alias("volume"))
    long = wide.unpivot([KEY, TIME], ["range", "body", "volume"], "feature_name", "feature_value")
    return ly.normalize_features(long, F.lit(0), feature_set="shapes", source="bars")


def actions(s, d):
    k, day = c("o_orderkey"), F.to_date("o_orderdate")
    text = lambda x: F.date_format(x, "yyyy-MM-dd")
    names = [*cl.ACTIONS, "picnic"]
    rows = table(s, d, "orders").select(
        (c("o_custkey") % 1000 + 1).alias(KEY), F.when(k % 4 != 0, text(day)).alias("除净日"), F.when(k % 3 != 0, text(F.date_add(day, 30))).otherwise("later").alias("发放日"), F.when(k % 5 != 0, text(F.date_sub(day, 10))).alias("最新公告日期"),
        F.year(day).cast("string").alias("财政年度"), F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int")).alias("action"), F.when(k % 2 == 0, (k % 9).cast("string")).otherwise("-").alias("cash"), (k % 3).alias("split_ratio"), k.alias("nth"),
    )
    return ly.normalize_actions(rows, c("nth"), source="orders")


def plan_rows(s, d):
    """Distribution plans as a provider lists them, with dates as text, some unreadable."""
    k, day = c("l_orderkey"), F.to_date("l_shipdate")
    rows = table(s, d, "lineitem").select(
        c("l_suppkey").alias(KEY), plan_text(k).alias("分红方案"), F.when(k % 4 == 0, "later").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("除净日"), F.date_format(F.date_add(day, 20), "yyyy-MM-dd").alias("发放日"),
        F.when(k % 3 == 0, F.date_format(F.date_sub(day, 15), "yyyy-MM-dd")).alias("最新公告日期"), F.year(day).cast("string").alias("财政年度"), F.when(k % 2 == 0, "final").alias("分配类型"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("nth"),
    )
    return ly.normalize_plans(rows, c("nth"), source="plans")


def ohlcv(s, d):
    return ly.normalize_ohlcv(_raw(s, d), c("seq"), adjust=" PRE ", source="desk", ingested=F.lit("1998-12-02").cast("timestamp"))


def profiles(s, d):
    names = [*cl.ADJUST, "other"]
    k = c("o_orderkey")
    alias = F.element_at(F.array(*[F.lit(f" {n.upper()} ") for n in names], F.lit(None)), (k % (len(names) + 1) + 1).cast("int"))
    return table(s, d, "orders").select("o_orderkey", cl.adjust_profile(alias).alias("p")).select("o_orderkey", "p.*")


def info(s, d):
    k = c("s_suppkey")
    rows = table(s, d, "supplier").select(
        F.concat(F.lit("hk"), k.cast("string")).alias(KEY), c("s_name").alias("name"), (k % 100 + 1).cast("string").alias("current_price"), F.when(k % 5 == 0, "n/a").otherwise((k % 7).cast("string")).alias("pe_ratio"),
        F.when(k % 2 == 0, k % 50).alias("52_week_high"), (k % 60).alias("week_52_high"), (k % 9).alias("week_52_low"), F.when(k % 3 == 0, "desk").alias("source"),
    )
    return ly.normalize_info(rows)


#: Names of listed securities by customer key; %s is the number.
NAMES = ("Firm %s", "恒生ETF%s", "牛证%s", "恒指牛证%s", "汇丰控股", "%s", "---", "Bond 债券%s", "gold reit %s", "tracker %s", "")


def listed(s, d):
    k = c("c_custkey")
    number = k.cast("string")
    made = [F.concat(F.lit(x.split("%s")[0]), number, F.lit(x.split("%s")[1])) if "%s" in x else F.lit(x) for x in NAMES]
    rows = table(s, d, "customer").select(padded(k % 7000).alias("code"), F.element_at(F.array(*made), (k % len(NAMES) + 1).cast("int")).alias("name"), k.alias("nth"))
    return ly.universe(rows, c("nth"))


def history(s, d):
    day = F.datediff(TIME, F.lit("1970-01-01"))
    b = bars(s, d).select(KEY, F.date_format(TIME, "yyyy-MM-dd").alias("日期"), F.when(day % 97 == 0, "-").otherwise(c("open").cast("string")).alias("开盘"), c("high").alias("最高"), c("low").alias("最低"), c("close").alias("收盘"), c("volume").alias("成交量"), day.alias("nth"))
    return ly.normalize_history(b, {"日期": TIME, "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume"}, c("nth"))


def marked(s, d):
    up = bars(s, d).where("volume >= 40")
    buys = up.where("close > open").select(KEY, TIME, c("close").alias("expected_3m_score"), F.lit(7).alias("signal_strength"), (c("volume") > 60).alias("actionable"), F.lit(0).alias("nth"))
    sells = up.where("close < open").select(KEY, TIME, F.lit(0).alias("nth"))
    return ly.normalize_signals(ly.signal_rows(buys, sells), c("nth"), signal_set="plain", strategy="bodies", source="replay")


def registry_upsert(s, d):
    old = _registry(s, d).withColumn("ingest_time", F.lit(1))
    code = c(KEY).cast("long")
    new = _registry(s, d).where(code % 2 == 0).withColumns({"stock_name": F.concat("stock_name", F.lit(" new")), "ingest_time": F.when(code % 4 == 0, 2).otherwise(0)})
    return ly.upserted_registry(old, new)


def scan_list(s, d):
    k = c("c_custkey")
    base = table(s, d, "customer").select(padded(k).alias(KEY), c("c_name").alias("stock_name"), k.alias("k"))
    k = c("k")
    old = base.where(k % 3 != 0).select(KEY, "stock_name", F.lit("active").alias("status"), F.lit("2024-01-01").cast("date").alias("added"))
    new = base.where(k % 2 == 0).select(KEY, F.concat("stock_name", F.lit("*")).alias("stock_name"), F.when(k % 8 == 0, "paused").otherwise("active").alias("status"), F.lit("2024-06-01").cast("date").alias("added"))
    return ly.upserted_scan_list(old, new)


QUERIES = {
    "nm_signals": lambda s, d: rounded(signals(s, d)),
    "nm_trades": lambda s, d: trades(s, d),
    "nm_features": lambda s, d: rounded(features(s, d)),
    "nm_actions": lambda s, d: rounded(actions(s, d)),
    "nm_info": lambda s, d: rounded(info(s, d)),
    "nm_universe": listed,
    "nm_history": lambda s, d: history(s, d),
    "nm_date_filter": lambda s, d: ly.date_filter(bars(s, d), "1994-01-01", "1997-06-30", 5),
    "nm_ohlcv": ohlcv,
    "nm_adjust_profiles": profiles,
    "nm_plan_actions": lambda s, d: rounded(plan_rows(s, d)),
    "nm_factor_rows": lambda s, d: rounded(ly.factor_rows(bars(s, d), "rolling158", config={"names": vq.NAMES})),
    "io_read_signals": lambda s, d: rounded(ly.read_layer(signals(s, d), "signals", {"batch_id": ["b0", "b3"], "signal_type": "buy", "strategy_name": None}, [KEY, TIME, "score", "actionable"], "1994-01-01", "1996-12-31")),
    "io_read_trades": lambda s, d: ly.read_layer(trades(s, d), "trades", {"account_id": "main", "trade_type": ["sell"]}, [KEY, TIME, "order_id", "price", "commission"], since="1996-01-01"),
    "io_read_features": lambda s, d: rounded(ly.read_layer(features(s, d), "features", {"feature_set": "shapes", "feature_name": ["range", "body"]}, [KEY, TIME, "feature_name", "feature_value"], until="1995-12-31")),
    "io_read_actions": lambda s, d: rounded(ly.read_layer(actions(s, d), "actions", {"action_type": ["cash_dividend", "stock_split"]}, [KEY, "event_date", "action_type", "cash_dividend"], "1994-01-01", "1996-12-31")),
    "io_persist_signals": lambda s, d: marked(s, d),
    "io_registry_upsert": registry_upsert,
    "io_scan_list": lambda s, d: scan_list(s, d).where("status = 'active'"),
    "io_scan_counts": lambda s, d: scan_list(s, d).groupBy("status").agg(F.count("*").alias("n")),
}

_ID = "'HK' AS market, 'HKEX' AS exchange, 'equity' AS asset_type, 'daily' AS frequency, 'qfq' AS adjust"
_LAST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY {} DESC) = 1"
_k = lambda names, x: "CASE " + " ".join(f"WHEN {x} % {len(names) + 1} = {i} THEN '{v}'" for i, v in enumerate(names)) + " END"
SIGNALS = f"""sig AS (SELECT {pad_sql('o_custkey % 1000 + 1')} AS stock_code, CAST(o_orderdate AS DATE) AS trade_date, {_ID}, 'orders' AS signal_set, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS signal_type,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 10 AS DOUBLE) END AS signal_strength, round(o_totalprice / 1000, 6) AS score, o_orderkey % 3 = 0 AS actionable, 'b' || o_orderkey % 4 AS batch_id, CAST(NULL AS DOUBLE) AS rank_position,
  'plain' AS strategy_name, 'unknown' AS source FROM orders WHERE o_orderkey % 17 <> 0 {_LAST.format("o_custkey % 1000, CAST(o_orderdate AS DATE), o_orderkey % 4", "o_orderkey")})"""
TRADES = f"""trd AS (SELECT {pad_sql('l_suppkey')} AS stock_code, CAST(l_shipdate AS DATE) AS trade_date, {_ID}, 'main' AS account_id, CAST(NULL AS VARCHAR) AS strategy_name, l_orderkey || '-' || l_linenumber % 2 AS order_id,
  CASE WHEN l_linenumber % 3 = 0 THEN 'sell' ELSE 'buy' END AS trade_type, l_extendedprice / l_quantity AS price, CAST(l_quantity AS DOUBLE) AS shares, l_extendedprice AS amount, CASE WHEN l_orderkey % 3 = 0 THEN 0.0 ELSE CAST(l_orderkey % 10 AS DOUBLE) END AS commission,
  'lines' AS source FROM lineitem {_LAST.format("l_suppkey, CAST(l_shipdate AS DATE), l_orderkey, l_linenumber % 2", "row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)")})"""
FEATURES = f"""ft AS (SELECT stock_code, trade_date, {_ID}, 'shapes' AS feature_set, feature_name, round(feature_value, 6) + 0.0 AS feature_value, 'bars' AS source FROM (SELECT stock_code, trade_date, high / low - 1 AS "range", CASE WHEN open <> close THEN close / open - 1 END AS body, volume FROM bars)
  UNPIVOT (feature_value FOR feature_name IN ("range", body, volume)))"""
ACTIONS = f"""act AS (SELECT * FROM (SELECT o_orderkey AS k, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN day END, CASE WHEN o_orderkey % 3 <> 0 THEN day + 30 END, CASE WHEN o_orderkey % 5 <> 0 THEN day - 10 END) AS event_date,
  CASE WHEN o_orderkey % 5 <> 0 THEN day - 10 END AS announcement_date, CASE WHEN o_orderkey % 4 <> 0 THEN day END AS ex_date, CAST(NULL AS DATE) AS record_date, CASE WHEN o_orderkey % 3 <> 0 THEN day + 30 END AS payment_date,
  CAST(year(day) AS VARCHAR) AS fiscal_year, CAST(NULL AS VARCHAR) AS plan_explain, CAST(NULL AS VARCHAR) AS distribution_type, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 9 AS DOUBLE) ELSE 0.0 END AS cash_dividend, CAST(o_orderkey % 3 AS DOUBLE) AS stock_split_ratio,
  0.0 AS bonus_share_ratio, 0.0 AS rights_issue_ratio, 0.0 AS rights_issue_price, {pad_sql('o_custkey % 1000 + 1')} AS stock_code, 'HK' AS market, 'HKEX' AS exchange, 'equity' AS asset_type, {_k(cl.ACTIONS.values(), 'o_orderkey')} AS action_type, 'orders' AS source
  FROM (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders)) WHERE event_date IS NOT NULL AND action_type IS NOT NULL {_LAST.format("stock_code, event_date, action_type", "k")})"""
SQL = {
    "nm_signals": f"WITH {SIGNALS} SELECT * FROM sig",
    "nm_trades": f"WITH {TRADES} SELECT * FROM trd",
    "nm_features": with_bars(FEATURES) + " SELECT * FROM ft",
    "nm_actions": f"WITH {ACTIONS} SELECT * EXCLUDE (k) FROM act",
    "nm_info": f"""SELECT {pad_sql('s_suppkey')} AS stock_code, 'HK' AS market, 'HKEX' AS exchange, 'equity' AS asset_type, s_name AS name, CAST(s_suppkey % 100 + 1 AS DOUBLE) AS current_price, CAST(NULL AS DOUBLE) AS close_price, CAST(NULL AS DOUBLE) AS open_price, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS low,
      CAST(NULL AS DOUBLE) AS volume, CAST(NULL AS DOUBLE) AS market_cap, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 7 AS DOUBLE) END AS pe_ratio, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 50 ELSE s_suppkey % 60 END AS DOUBLE) AS week_52_high, CAST(s_suppkey % 9 AS DOUBLE) AS week_52_low,
      CASE WHEN s_suppkey % 3 = 0 THEN 'desk' ELSE 'unknown' END AS source FROM supplier""",
    "nm_universe": f"""SELECT code AS stock_code, name AS stock_name FROM (SELECT {pad_sql('c_custkey % 7000')} AS code, CASE c_custkey % 11 WHEN 0 THEN 'Firm ' || c_custkey WHEN 1 THEN '恒生ETF' || c_custkey WHEN 3 THEN '恒指牛证' || c_custkey WHEN 4 THEN '汇丰控股' WHEN 9 THEN 'tracker ' || c_custkey END AS name, c_custkey
      FROM customer) WHERE name IS NOT NULL {_LAST.format("code", "-c_custkey")}""",
    "nm_history": with_bars() + " SELECT stock_code, trade_date, " + ", ".join(f'"{x}"' for x in ("open", "high", "low", "close", "volume")) + " FROM bars WHERE date_diff('day', DATE '1970-01-01', trade_date) % 97 <> 0",
    "nm_date_filter": with_bars() + " SELECT stock_code, trade_date, " + ", ".join(f'"{x}"' for x in ("open", "high", "low", "close", "volume")) + " FROM bars WHERE trade_date BETWEEN DATE '1994-01-01' AND DATE '1997-06-30' QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) <= 5",
    "io_read_signals": f"WITH {SIGNALS} SELECT stock_code, trade_date, score, actionable FROM sig WHERE batch_id IN ('b0', 'b3') AND signal_type = 'buy' AND trade_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'",
    "io_read_trades": f"WITH {TRADES} SELECT stock_code, trade_date, order_id, price, commission FROM trd WHERE trade_type = 'sell' AND trade_date >= DATE '1996-01-01'",
    "io_read_features": with_bars(FEATURES) + " SELECT stock_code, trade_date, feature_name, feature_value FROM ft WHERE feature_name <> 'volume' AND trade_date <= DATE '1995-12-31'",
    "io_read_actions": f"WITH {ACTIONS} SELECT stock_code, event_date, action_type, cash_dividend FROM act WHERE action_type IN ('cash_dividend', 'stock_split') AND event_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'",
    "io_persist_signals": with_bars() + f""" SELECT stock_code, trade_date, {_ID}, 'plain' AS signal_set, CASE WHEN close > open THEN 'buy' ELSE 'sell' END AS signal_type, CASE WHEN close > open THEN 7.0::DOUBLE END AS signal_strength, CASE WHEN close > open THEN close END AS score,
      close < open OR volume > 60 AS actionable, CAST(NULL AS VARCHAR) AS batch_id, CAST(NULL AS DOUBLE) AS rank_position, 'bodies' AS strategy_name, 'replay' AS source FROM bars WHERE volume >= 40 AND close <> open""",
    "io_registry_upsert": f"WITH {REG} SELECT stock_code, CASE WHEN CAST(stock_code AS BIGINT) % 4 = 0 THEN stock_name || ' new' ELSE stock_name END AS stock_name, exchange, market, CASE WHEN CAST(stock_code AS BIGINT) % 4 = 0 THEN 2 ELSE 1 END AS ingest_time FROM reg",
}
_PLAN = """CASE WHEN k % 7 = 0 THEN '每10股送' || (k % 5 + 1) || '股派' || (k % 90 + 10) || '.5元' WHEN k % 5 = 0 THEN '每8股供' || (k % 3 + 1) || '股，供股价为' || (k % 20) || '.25元' WHEN k % 3 = 0 THEN '每股派末期息派' || (k % 4) || '.25港元'
  WHEN k % 3 = 1 THEN '末期股息0.' || (k % 9 + 1) || '元' ELSE '每20股转增' || (k % 6) || '股' END"""
_TOLD = """SELECT *, 'cash_dividend' AS action_type, round(CASE WHEN k % 7 = 0 THEN (k % 90 + 10.5) / 10 WHEN k % 3 = 0 THEN k % 4 + 0.25 ELSE (k % 9 + 1) / 10 END, 6) AS cash, 0.0 AS bonus, 0.0 AS rights, 0.0 AS price FROM p WHERE k % 7 = 0 OR (k % 5 <> 0 AND k % 3 < 2)
  UNION ALL SELECT *, 'bonus_issue', 0.0, round(CASE WHEN k % 7 = 0 THEN (k % 5 + 1) / 10 ELSE k % 6 / 20 END, 6), 0.0, 0.0 FROM p WHERE k % 7 = 0 OR (k % 5 <> 0 AND k % 3 = 2 AND k % 6 > 0)
  UNION ALL SELECT *, 'rights_issue', 0.0, 0.0, round((k % 3 + 1) / 8, 6), k % 20 + 0.25 FROM p WHERE k % 7 <> 0 AND k % 5 = 0"""
SQL["nm_plan_actions"] = f"""WITH p AS (SELECT {pad_sql('l_suppkey')} AS stock_code, CAST(l_shipdate AS DATE) AS day, l_orderkey AS k, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS nth FROM lineitem WHERE l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0),
  t AS ({_TOLD}), e AS (SELECT *, CASE WHEN k % 4 = 0 THEN CAST(day + 20 AS DATE) ELSE day END AS event_date FROM t)
  SELECT event_date, CASE WHEN k % 3 = 0 THEN CAST(day - 15 AS DATE) END AS announcement_date, CASE WHEN k % 4 <> 0 THEN day END AS ex_date, CAST(NULL AS DATE) AS record_date, CAST(day + 20 AS DATE) AS payment_date, CAST(year(day) AS VARCHAR) AS fiscal_year, {_PLAN} AS plan_explain,
    CASE WHEN k % 2 = 0 THEN 'final' END AS distribution_type, CAST(cash AS DOUBLE) AS cash_dividend, 0.0::DOUBLE AS stock_split_ratio, CAST(bonus AS DOUBLE) AS bonus_share_ratio, CAST(rights AS DOUBLE) AS rights_issue_ratio, CAST(price AS DOUBLE) AS rights_issue_price,
    stock_code, 'HK' AS market, 'HKEX' AS exchange, 'equity' AS asset_type, action_type, 'plans' AS source FROM e {_LAST.format("stock_code, event_date, action_type", "nth")}"""
SQL["nm_ohlcv"] = "SELECT *, 'HK' AS market, 'HKEX' AS exchange, 'equity' AS asset_type, 'daily' AS frequency, 'qfq' AS adjust, 'HKD' AS currency, 'desk' AS source, TIMESTAMP '1998-12-02' AS ingest_time FROM (" + PANEL["nm_bars"] + ")"
SQL["nm_factor_rows"] = vq.BASE + f" SELECT stock_code, trade_date, {_ID}, 'rolling158' AS feature_set, feature_name, round(feature_value, 6) + 0.0 AS feature_value, 'factor_engine' AS source FROM feats"
_ALIASES = [*cl.ADJUST, "other"]
SQL["nm_adjust_profiles"] = f"""WITH a AS (SELECT o_orderkey, CASE o_orderkey % {len(_ALIASES) + 1} {" ".join(f"WHEN {i} THEN '{cl.ADJUST.get(n, '')}'" for i, n in enumerate(_ALIASES))} ELSE 'qfq' END AS alias FROM orders)
  SELECT o_orderkey, v.* FROM a LEFT JOIN (VALUES {", ".join(f"('{k}', '{label}', '{text}', {str(needs).lower()})" for k, (label, text, needs) in cl.ADJUST_PROFILES.items())}) v(adjust, label, description, needs_actions) ON alias = v.adjust"""
_SCAN = f"""WITH sl AS (SELECT {pad_sql('c_custkey')} AS stock_code, CASE WHEN c_custkey % 2 = 0 THEN c_name || '*' ELSE c_name END AS stock_name, CASE WHEN c_custkey % 8 = 0 THEN 'paused' ELSE 'active' END AS status,
  CASE WHEN c_custkey % 3 <> 0 THEN DATE '2024-01-01' ELSE DATE '2024-06-01' END AS added FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0)"""
SQL["io_scan_list"] = _SCAN + " SELECT * FROM sl WHERE status = 'active'"
SQL["io_scan_counts"] = _SCAN + " SELECT status, count(*) AS n FROM sl GROUP BY 1"
