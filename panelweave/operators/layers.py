"""Layers beside the bars: features, signals, trades, corporate actions and the registry.

Every normaliser takes rows of a provider, with text where numbers should be, and gives the columns
of its layer, one row for each key. Where a key repeats, the row that comes last by ``order`` is
kept. Columns that the rows lack are NULL. What the rows can't know, such as the market, is stamped.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import KEY, TIME
from panelweave.functions.positions import in_order
from panelweave.operators.cleaning import ACTIONS, ADJUST, PRICES, exchange_of, mapped, normalize_bars, plan_actions, stock_code
from panelweave.operators.factors import FACTOR_SETS, to_long
from panelweave.sources.store import filtered, keep_last, upsert

c = F.col

IDENTITY = ("market", "exchange", "asset_type", "frequency", "adjust")
#: What tells the rows of a layer apart, and the column of its dates.
LAYERS = {
    "features": ((KEY, TIME, "market", "frequency", "adjust", "feature_set", "feature_name"), TIME),
    "signals": ((KEY, TIME, "market", "frequency", "adjust", "signal_set", "signal_type", "batch_id"), TIME),
    "trades": ((KEY, TIME, "market", "account_id", "order_id"), TIME),
    "actions": ((KEY, "event_date", "market", "action_type"), "event_date"),
}


def read_layer(rows: DataFrame, layer: str, filters: dict | None = None, columns: Iterable[str] | None = None, since=None, until=None) -> DataFrame:
    """Rows of a layer by equality and IN filters and a range of its dates."""
    day = LAYERS[layer][1]
    if day != TIME:
        rows = rows.withColumn(TIME, c(day))
    out = filtered(rows, filters, since=since, until=until)
    out = out if day == TIME else out.drop(TIME)
    return out.select(*columns) if columns else out


def _as(df: DataFrame, name: str, kind: str) -> Column:
    """The column as ``kind``, NULL where it can't be or isn't there."""
    return F.expr(f"try_cast(`{name}` AS {kind})") if name in df.columns else F.lit(None).cast(kind)


def _first(df: DataFrame, names: Iterable[str], kind: str) -> Column:
    return F.coalesce(*[_as(df, n, kind) for n in names])


def _stamps(df: DataFrame, market: str, asset_type: str = "equity", frequency: str = "daily", adjust: str = "qfq") -> dict[str, Column]:
    code = stock_code(c(KEY).cast("string"), market)
    return {KEY: code, "market": F.lit(market), "exchange": exchange_of(c(KEY).cast("string"), market), "asset_type": F.lit(asset_type), "frequency": F.lit(frequency), "adjust": F.lit(adjust)}


def _named(df: DataFrame, own: str | None, column: str, other: str | None) -> Column:
    return F.coalesce(F.lit(own).cast("string"), _as(df, column, "string"), F.lit(other).cast("string"))


def _kept(df: DataFrame, made: dict[str, Column], keys: Iterable[str], order: Column, needed: Iterable[str]) -> DataFrame:
    out = df.select(*[x.alias(n) for n, x in made.items()], order.alias("_order"))
    for n in needed:
        out = out.where(c(n).isNotNull())
    return keep_last(out, list(keys), [F.desc("_order")]).drop("_order")


def normalize_signals(rows: DataFrame, order: Column, market: str = "HK", signal_set: str = "default", strategy: str | None = None, source: str | None = None, **stamps) -> DataFrame:
    """Signals; one that doesn't say whether it is actionable is not. Rows without a date are dropped.

    The batch is part of the key, so that two batches of a day don't replace each other.
    """
    made = {TIME: _first(rows, (TIME, "date"), "date"), **_stamps(rows, market, **stamps)}
    made |= {
        "signal_set": F.lit(signal_set), "signal_type": _as(rows, "signal_type", "string"), "signal_strength": _as(rows, "signal_strength", "double"), "score": _as(rows, "score", "double"),
        "actionable": F.coalesce(_as(rows, "actionable", "boolean"), F.lit(False)), "batch_id": _as(rows, "batch_id", "string"), "rank_position": _as(rows, "rank_position", "double"),
        "strategy_name": _named(rows, strategy, "strategy_name", None), "source": _named(rows, source, "source", "unknown"),
    }
    return _kept(rows, made, LAYERS["signals"][0], order, (TIME,))


def normalize_trades(rows: DataFrame, order: Column, market: str = "HK", account_id: str = "default", strategy: str | None = None, source: str | None = None, **stamps) -> DataFrame:
    """Trades; a missing commission is 0. Rows without a date are dropped."""
    made = {TIME: _first(rows, (TIME, "date"), "date"), **_stamps(rows, market, **stamps)}
    made |= {
        "account_id": F.lit(account_id), "strategy_name": _named(rows, strategy, "strategy_name", None), "order_id": _as(rows, "order_id", "string"), "trade_type": _as(rows, "trade_type", "string"),
        "price": _as(rows, "price", "double"), "shares": _as(rows, "shares", "double"), "amount": _as(rows, "amount", "double"), "commission": F.coalesce(_as(rows, "commission", "double"), F.lit(0.0)),
        "source": _named(rows, source, "source", "unknown"),
    }
    return _kept(rows, made, LAYERS["trades"][0], order, (TIME,))


def normalize_features(long: DataFrame, order: Column, market: str = "HK", feature_set: str = "default", source: str | None = None, **stamps) -> DataFrame:
    """Long features; those without a value are dropped."""
    made = {TIME: _first(long, (TIME, "date"), "date"), **_stamps(long, market, **stamps)}
    made |= {"feature_set": F.lit(feature_set), "feature_name": _as(long, "feature_name", "string"), "feature_value": _as(long, "feature_value", "double"), "source": _named(long, source, "source", "unknown")}
    return _kept(long, made, LAYERS["features"][0], order, (TIME, "feature_value"))


#: Numbers of a registry row, each with other names for it.
INFO = {n: (n,) for n in ("current_price", "close_price", "open_price", "high", "low", "volume", "market_cap", "pe_ratio")}
INFO |= {"week_52_high": ("52_week_high", "week_52_high"), "week_52_low": ("52_week_low", "week_52_low")}


def normalize_info(rows: DataFrame, market: str = "HK", source: str | None = None, asset_type: str = "equity") -> DataFrame:
    """Registry rows of securities."""
    made = {n: x for n, x in _stamps(rows, market, asset_type).items() if n not in ("frequency", "adjust")}
    made |= {"name": _as(rows, "name", "string"), **{n: _first(rows, names, "double") for n, names in INFO.items()}, "source": _named(rows, source, "source", "unknown")}
    return rows.select(*[x.alias(n) for n, x in made.items()])


# What providers call the columns of corporate actions.
ACTION_COLUMNS = {
    "announcement_date": ("announcement_date", "最新公告日期"), "ex_date": ("ex_date", "除净日"), "record_date": ("record_date", "截至过户日"), "payment_date": ("payment_date", "发放日"),
    "fiscal_year": ("fiscal_year", "财政年度"), "plan_explain": ("plan_explain", "分红方案"), "distribution_type": ("distribution_type", "分配类型"),
    "cash_dividend": ("cash_dividend", "cash"), "stock_split_ratio": ("stock_split_ratio", "split_ratio"), "bonus_share_ratio": ("bonus_share_ratio", "bonus_ratio"),
    "rights_issue_ratio": ("rights_issue_ratio", "rights_ratio"), "rights_issue_price": ("rights_issue_price", "rights_price"),
}
DATES, TEXTS = ("announcement_date", "ex_date", "record_date", "payment_date"), ("fiscal_year", "plan_explain", "distribution_type")


def normalize_actions(rows: DataFrame, order: Column, market: str = "HK", source: str | None = None, strict: bool = False) -> DataFrame:
    """Corporate actions by their event, or else ex, payment or announcement date; missing amounts are 0.

    Rows without any date or without a known action are dropped; if ``strict``, an unknown action is an error.
    """
    kind = lambda n: "date" if n in DATES else "string" if n in TEXTS else "double"
    made = {n: _first(rows, names, kind(n)) for n, names in ACTION_COLUMNS.items()}
    action = _first(rows, ("action_type", "action"), "string")
    if strict:
        rows = rows.where(action.isNotNull())
    event = F.coalesce(_first(rows, ("event_date", "date"), "date"), made["ex_date"], made["payment_date"], made["announcement_date"])
    made = {n: F.coalesce(x, F.lit(0.0)) if kind(n) == "double" else x for n, x in made.items()}
    made = {"event_date": event, **made, **{n: x for n, x in _stamps(rows, market).items() if n not in ("frequency", "adjust")}, "action_type": mapped(action, ACTIONS, strict), "source": _named(rows, source, "source", "unknown")}
    return _kept(rows, made, LAYERS["actions"][0], order, ("event_date", "action_type"))


def normalize_plans(rows: DataFrame, order: Column, market: str = "HK", source: str | None = None) -> DataFrame:
    """Corporate actions read from the plan texts of a provider's distributions, with all dates and texts of their rows.

    The event of an action is its ex date, or else its payment or announcement date; see ``plan_actions`` for what a text gives.
    """
    text = F.trim(_first(rows, ACTION_COLUMNS["plan_explain"], "string"))
    known = [KEY, "source", *[x for n in (*DATES, "fiscal_year", "distribution_type") for x in ACTION_COLUMNS[n]]]
    told = rows.select(*[n for n in known if n in rows.columns], text.alias("plan_explain"), order.alias("_came"), F.inline(plan_actions(text)))
    kind = c("action")
    made = told.withColumns({
        "cash_dividend": c("cash"), "bonus_share_ratio": F.when(kind == "bonus_issue", c("ratio")), "rights_issue_ratio": F.when(kind == "rights_issue", c("ratio")), "rights_issue_price": c("price"),
    })
    return normalize_actions(made.drop("cash", "ratio", "price"), c("_came"), market, source, True)


# What providers call the date of a bar, and the currency of a market.
BAR_DATES = (TIME, "date", "datetime")
CURRENCIES = {"HK": "HKD", "CN": "CNY", "US": "USD"}


def normalize_ohlcv(
    rows: DataFrame, order: Column, market: str = "HK", exchange: str | None = None, asset_type: str = "equity", frequency: str = "daily", adjust: str | None = "qfq", currency: str | None = None,
    source: str | None = None, ingested: Column | None = None,
) -> DataFrame:
    """Clean bars with where they come from: market, exchange, kind, frequency, adjustment, currency, source and time of ingestion.

    Rows without a date or any price are dropped, a missing volume is 0. Of rows of a security and date (of daily bars; else
    time) the last by ``order`` is kept. ``ingested`` is the time of the query unless given; an unknown ``adjust`` is an error.
    """
    adjust = ADJUST.get("qfq" if adjust is None else adjust.strip().lower())
    if adjust is None:
        raise ValueError("unknown adjustment")
    rows = rows.withColumnsRenamed({n: n.lower() for n in rows.columns if n.lower() in (KEY, *BAR_DATES, *PRICES, "volume")})
    stamps, market = _stamps(rows, market.upper(), asset_type, frequency, adjust), market.upper()
    made = {TIME: _first(rows, BAR_DATES, "date" if frequency == "daily" else "timestamp"), **stamps, **{p: _as(rows, p, "double") for p in PRICES}, "volume": F.coalesce(_as(rows, "volume", "double"), F.lit(0.0))}
    made |= {
        "exchange": F.lit(exchange.upper()) if exchange else stamps["exchange"], "source": F.lit(source or "unknown"), "currency": F.lit((currency or CURRENCIES.get(market, market)).upper()),
        "ingest_time": F.current_timestamp() if ingested is None else ingested,
    }
    return _kept(rows, made, ("market", KEY, TIME, "frequency", "adjust"), order, (TIME, *PRICES))


def factor_rows(bars: DataFrame, factor_set: str, since=None, until=None, market: str = "HK", source: str = "factor_engine", config: dict | None = None, **stamps) -> DataFrame:
    """A factor set of the bars of a range of dates, as rows of the layer of features; values that are not finite are left out.

    Windows start with the range: bars before ``since`` are not read. ``config`` has arguments of the set, as ``names``.
    """
    wide = FACTOR_SETS[factor_set](filtered(bars, since=since, until=until), **(config or {}))
    long = to_long(wide).where(~F.isnan("feature_value") & (F.abs("feature_value") < float("inf")))
    return normalize_features(long, F.lit(0), market, factor_set, source, **stamps)


def sync_factors(spark: SparkSession, path: str, rows: DataFrame, staging: str, stamp: Column) -> None:
    """Put the rows of a factor set into the stored layer, where they replace those of the same key with an earlier ``stamp``."""
    new = rows.withColumn("ingest_time", stamp)
    upsert(spark, path, new, list(LAYERS["features"][0]), "ingest_time", staging)


def normalize_history(rows: DataFrame, names: dict[str, str], order: Column) -> DataFrame:
    """Bars of a provider whose columns are called otherwise; ``names`` has our name of each of theirs."""
    return normalize_bars(rows.withColumnsRenamed(names), order)


def date_filter(bars: DataFrame, since=None, until=None, last: int | None = None) -> DataFrame:
    """Rows of a range of dates, and of these the last ``last`` of each security."""
    out = filtered(bars, since=since, until=until)
    if last is None:
        return out
    w = Window.partitionBy(KEY).orderBy(F.desc(TIME))
    return out.withColumn("_nth", F.row_number().over(w)).where(c("_nth") <= last).drop("_nth")


# Words in names of index products, which are kept, and of what is not a stock.
INDEX_WORDS = (
    "指数", "ETF", "ETP", "TRACKER", "TRUST", "杠杆", "反向", "两倍", "二倍", "三倍", "2X", "3X", "XL2", "XL3", "做多", "做空", "恒指", "国指", "科指", "纳指", "纳斯达克", "标普", "道指", "日经", "罗素", "比特币", "以太币",
)
NOT_STOCKS = ("牛证", "熊证", "牛熊证", "认购证", "认沽证", "窝轮", "界内证", "权证", "票据", "债券", "债务", "房托", "房地产投资信托", "REIT")


def universe(listed: DataFrame, order: Column) -> DataFrame:
    """``stock_code, stock_name`` of the stocks and index products of a list (``code, name``), each code once, its first row.

    A code has five digits; a name has a letter and is not the code itself. A word for index products
    beats one for other kinds.
    """
    code, name = F.regexp_replace(F.trim("code"), "[^0-9]", ""), F.trim("name")
    word = lambda words: name.rlike("|".join(words)) | F.upper(name).rlike("|".join(words))
    own = name.isin("") | (name == c("_code")) | (name == F.ltrim(c("_code"), F.lit("0"))) | F.upper(name).eqNullSafe(F.concat(F.lit("HK"), "_code")) | name.rlike(r"^0*\d{5}$")
    rows = listed.withColumn("_code", code).where(F.length("_code") == 5)
    rows = rows.where(F.coalesce(~own & name.rlike(r"[\x{4e00}-\x{9fff}A-Za-z]") & (word(INDEX_WORDS) | ~word(NOT_STOCKS)), F.lit(False)))
    return keep_last(rows.select(c("_code").alias(KEY), name.alias("stock_name"), order.alias("_order")), [KEY], [F.asc("_order")]).drop("_order")


def signal_rows(buys: DataFrame, sells: DataFrame) -> DataFrame:
    """Buys and sells of a strategy as rows to normalise: a buy is scored by its expectation if it has no score, a sell is actionable."""
    b = buys.withColumn("signal_type", F.lit("buy"))
    if "score" not in b.columns and "expected_3m_score" in b.columns:
        b = b.withColumn("score", c("expected_3m_score"))
    s = sells.withColumn("signal_type", F.lit("sell"))
    if "actionable" not in s.columns:
        s = s.withColumn("actionable", F.lit(True))
    for n in ("signal_strength", "score"):
        if n not in s.columns:
            s = s.withColumn(n, F.lit(None).cast("double"))
    return b.unionByName(s, allowMissingColumns=True)


def trade_rows(outcomes: DataFrame, shares: float = 100.0, rate: float = 0.0003) -> DataFrame:
    """A buy and a sell for each outcome, numbered within the security by date, the sell of a day before its buy."""
    leg = lambda kind, day, price: F.struct(F.lit(kind).alias("trade_type"), c(day).alias("date"), c(price).alias("price"))
    legs = F.filter(F.array(leg("buy", "entry_date", "entry"), leg("sell", "exit_date", "exit")), lambda x: x["price"].isNotNull())
    out = outcomes.select(KEY, "signal_date", F.inline(legs)).withColumns({"shares": F.lit(shares), "amount": c("price") * shares, "commission": c("price") * shares * rate})
    nth = F.row_number().over(Window.partitionBy(KEY).orderBy("date", F.desc("trade_type"), "signal_date"))
    named = F.concat_ws("_", F.date_format("date", "yyyy-MM-dd"), "trade_type", nth.cast("string"))
    return out.withColumn("order_id", F.when(c("date").isNotNull() & c("trade_type").isNotNull(), named).otherwise(F.concat(F.lit("trade_"), nth.cast("string")))).drop("signal_date")


def ranking_rows(ranked: DataFrame, chosen: DataFrame, watched: DataFrame, batch_id: str, day: Column) -> DataFrame:
    """The tables of a selection, in the order of ``place``, as signal rows of one batch with their position in their own table."""
    parts = {"ranking": ranked, "selected": chosen, "watchlist": watched}
    rows = None
    for kind, df in parts.items():
        part = df.select(
            KEY, day.alias(TIME), F.lit(kind).alias("signal_type"), c("current_signal_score").alias("signal_strength"), F.coalesce("ranking_score", "current_signal_score").alias("score"),
            F.lit(kind == "selected").alias("actionable"), F.lit(batch_id).alias("batch_id"), c("place").alias("rank_position"),
        )
        rows = part if rows is None else rows.unionByName(part)
    numbered = in_order(rows, [c("rank_position")], position="_nth", group=("signal_type",))
    return numbered.withColumn("rank_position", c("_nth").cast("int")).drop("_nth")


def upserted_registry(old: DataFrame, new: DataFrame, as_of: str = "ingest_time") -> DataFrame:
    """Registry rows of both, the newest for each market and code."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, ["market", KEY], [F.desc(as_of), F.desc("_new")]).drop("_new")


def upserted_scan_list(old: DataFrame, new: DataFrame) -> DataFrame:
    """The list of securities to scan; a row of ``new`` replaces the one of its code but keeps the day that this was added."""
    mine = new.withColumnsRenamed({n: f"_{n}" for n in new.columns if n != KEY}).withColumn("_here", F.lit(True))
    out = old.join(mine, KEY, "full_outer")
    names = [n for n in old.columns if n not in (KEY, "added")]
    return out.select(KEY, *[F.when(c("_here"), c(f"_{n}")).otherwise(c(n)).alias(n) for n in names], F.coalesce("added", "_added").alias("added"))


def snapshot(rows: DataFrame, source: str, requested: tuple[str, str], captured: Column) -> DataFrame:
    """Rows as a provider gave them, all columns, with the request that they answer; snapshots are appended, never changed."""
    return rows.withColumns({"source": F.lit(source), "requested_from": F.lit(requested[0]).cast("date"), "requested_to": F.lit(requested[1]).cast("date"), "captured": captured})


def write_snapshot(rows: DataFrame, path: str, by: tuple[str, ...] = ("source",)) -> None:
    rows.write.mode("append").partitionBy(*by).parquet(path)


def export(df: DataFrame, path: str, form: str = "csv") -> None:
    """A report as files of CSV with a header, or of JSON lines."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)
