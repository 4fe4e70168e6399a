"""Normalisers, quality checks, the trading calendar and intraday bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import KEY, TIME, padded

c = F.col
PRICES = ("open", "high", "low", "close")

# Names that mean the same.
ADJUST = {
    "": "raw", "none": "raw", "raw": "raw", "bfq": "raw", "unadjusted": "raw", "no_adjust": "raw", "qfq": "qfq", "forward": "qfq", "forward_adjusted": "qfq", "pre": "qfq",
    "hfq": "hfq", "backward": "hfq", "backward_adjusted": "hfq", "post": "hfq",
}
PERIODS = {
    "d": "daily", "day": "daily", "daily": "daily", "1m": "1min", "1min": "1min", "1minute": "1min", "minute": "1min", "5m": "5min", "5min": "5min", "5minute": "5min",
    "15m": "15min", "15min": "15min", "30m": "30min", "30min": "30min", "60m": "60min", "60min": "60min", "1h": "60min", "hour": "60min", "hourly": "60min",
}
#: Of each adjustment: its label, what it does to prices, and whether it needs the corporate actions.
ADJUST_PROFILES = {
    "raw": ("不复权", "保持交易所原始价格口径，不做分红拆股价格回溯处理。", False),
    "qfq": ("前复权", "用当前口径回溯历史价格，便于做技术分析、研究和回测连续收益。", True),
    "hfq": ("后复权", "将历史口径映射到当时真实成交价格附近，便于核对长期涨跌幅。", True),
}
ACTIONS = {
    "cash_dividend": "cash_dividend", "dividend": "cash_dividend", "cash": "cash_dividend", "split": "stock_split", "stock_split": "stock_split", "reverse_split": "reverse_split",
    "bonus": "bonus_issue", "bonus_issue": "bonus_issue", "rights": "rights_issue", "rights_issue": "rights_issue", "spinoff": "spin_off", "spin_off": "spin_off", "merger": "merger",
}
#: What a missing name means; there is no action without a name.
NO_ADJUST, NO_PERIOD = "qfq", "daily"
# Exchanges of a market, and of the first digit of a code of six.
MARKET_EXCHANGE = {"HK": "HKEX", "US": "NASDAQ"}
FIRST_DIGITS = {"SH": ("5", "6", "9"), "SZ": ("0", "2", "3"), "BJ": ("4", "8")}
SUFFIX_EXCHANGE = {"SH": "SSE", "SZ": "SZSE", "BJ": "BSE"}
SESSIONS = {"HK": ((34_200, 43_200), (46_800, 57_600)), "CN": ((34_200, 41_400), (46_800, 54_000))}
CLOSING_AUCTION = 58_080  # 16:08


def mapped(x: Column, names: dict[str, str], strict: bool = False, missing: str | None = None) -> Column:
    """The standard name of a trimmed, lower-case alias; ``missing`` for NULL; NULL, or an error if ``strict``, for unknown ones."""
    key = F.lower(F.trim(x))
    found = F.coalesce(F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[key], F.when(x.isNull(), F.lit(missing)))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown name: "), F.coalesce(x, F.lit("NULL"))))) if strict else found


def adjust_profile(x: Column, strict: bool = False) -> Column:
    """The adjustment that an alias names and its profile: ``adjust, label, description, needs_actions``; all NULL for unknown ones, or an error if ``strict``."""
    name = mapped(x, ADJUST, strict, NO_ADJUST)
    part = lambda i: F.create_map(*[F.lit(v) for k, p in ADJUST_PROFILES.items() for v in (k, p[i])])[name]
    return F.struct(name.alias("adjust"), part(0).alias("label"), part(1).alias("description"), part(2).alias("needs_actions"))


def stock_code(x: Column, market: str) -> Column:
    """HK: digits padded to five. CN: six digits and the exchange, from a suffix or, of codes of six digits, the first one.

    Other codes of CN are their digits, or the text itself where it has none; other markets keep the trimmed text.
    """
    code = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    digits = F.regexp_replace(code, "[^0-9]", "")
    if market == "HK":
        return padded(digits, 5)
    if market != "CN":
        return code
    dotted = F.regexp_replace(F.regexp_replace(code, "(SH|SZ|BJ)", ".$1"), r"\.\.", ".")
    left = F.regexp_replace(F.substring_index(dotted, ".", 1), "[^0-9]", "")
    right = F.when(F.instr(dotted, ".") > 0, F.regexp_replace(F.regexp_replace(dotted, r"^[^.]*\.", ""), "[^0-9A-Z_]", "")).otherwise("")
    plain = F.when(digits == "", code).otherwise(digits)
    guess = F.when(F.lit(False), F.lit(""))
    for suffix, firsts in FIRST_DIGITS.items():
        guess = guess.when(F.substring(digits, 1, 1).isin(*firsts), F.concat(digits, F.lit(f".{suffix}")))
    guess = F.when(F.length(digits) == 6, F.coalesce(guess, digits)).otherwise(plain)
    return F.when((left != "") & (right != ""), F.concat(padded(left, 6), F.lit("."), right)).otherwise(guess)


def exchange_of(x: Column, market: str) -> Column:
    """The exchange of a code: by its first digit or suffix in CN, else that of the market."""
    if market != "CN":
        return F.lit(MARKET_EXCHANGE.get(market, market))
    code = stock_code(x, market)
    first, out = F.substring(F.regexp_replace(code, "[^0-9]", ""), 1, 1), F.when(F.lit(False), F.lit(""))
    for suffix, firsts in FIRST_DIGITS.items():
        out = out.when(code.endswith(f".{suffix}") | first.isin(*firsts), SUFFIX_EXCHANGE[suffix])
    return out.otherwise("CN")


def normalize_bars(rows: DataFrame, order: Column) -> DataFrame:
    """Text columns cast, rows without date or prices dropped, volume 0 if missing, the last row of a date kept."""
    cast = {p: F.expr(f"try_cast({p} AS double)") for p in (*PRICES, "volume")}
    day = F.expr(f"try_cast({TIME} AS date)")
    out = rows.withColumn("_order", order).select(KEY, day.alias(TIME), *[x.alias(p) for p, x in cast.items()], "_order")
    out = out.where(c(TIME).isNotNull() & c("close").isNotNull() & c("open").isNotNull()).withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    w = Window.partitionBy(KEY, TIME).orderBy(F.desc("_order"))
    return out.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_order")


ISSUES = {"missing_required_values": "error", "duplicate_trade_date": "error", "non_monotonic_trade_date": "error", "non_positive_price": "error", "negative_volume": "error", "invalid_ohlc_relationship": "error", "zero_volume_flat_bar": "warning", "zero_volume_nonflat_bar": "warning"}


def quality(rows: DataFrame, arrival: str, by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Counts of each issue for each security, or each value of ``by``, with totals; ``arrival`` is the column of input order.

    Rows that arrived as one count in the order of their dates, so that the counts do not hang on how ties fall.
    """
    needed = (TIME, *PRICES, "volume")
    missing = F.lit(False)
    for n in needed:
        missing = missing | c(n).isNull()
    flat = (c("open") == c("high")) & (c("high") == c("low")) & (c("low") == c("close"))
    bad = (c("high") < F.greatest("open", "close", "low")) | (c("low") > F.least("open", "close", "high")) | (c("low") > c("high"))
    count = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("long")
    before = F.max(TIME).over(Window.partitionBy(*by).orderBy(arrival, TIME).rowsBetween(Window.unboundedPreceding, -1))
    back = c(TIME).isNull() | F.coalesce(before > c(TIME), F.lit(False))  # dates with gaps are not in order
    out = rows.withColumn("_back", back).groupBy(*by).agg(
        F.count("*").alias("n_rows"), count(missing).alias("missing_required_values"),
        (F.count("*") - F.count_distinct(F.coalesce(F.date_format(TIME, "yyyy-MM-dd"), F.lit("")))).alias("duplicate_trade_date"),
        F.max(c("_back").cast("long")).alias("non_monotonic_trade_date"),
        count((c("open") <= 0) | (c("high") <= 0) | (c("low") <= 0) | (c("close") <= 0)).alias("non_positive_price"), count(c("volume") < 0).alias("negative_volume"),
        count(bad).alias("invalid_ohlc_relationship"), count((c("volume") <= 0) & flat).alias("zero_volume_flat_bar"), count((c("volume") <= 0) & ~flat).alias("zero_volume_nonflat_bar"),
    )
    total = lambda kind: sum(c(n) for n, k in ISSUES.items() if k == kind)
    return out.withColumns({"errors": total("error"), "warnings": total("warning")}).withColumn("passed", c("errors") == 0)


def with_empty(report: DataFrame, universe: DataFrame) -> DataFrame:
    """The report with a row for each security of the universe that has none: no rows, one warning, and passed."""
    out = universe.select(KEY).distinct().join(report, KEY, "left").withColumn("empty_frame", c("n_rows").isNull().cast("long"))
    return out.na.fill(0).withColumns({"warnings": F.coalesce("warnings", F.lit(0)) + c("empty_frame"), "passed": F.coalesce("passed", F.lit(True))})


def quality_by_frequency(report: DataFrame) -> DataFrame:
    """Securities with errors and with warnings, and how many of each, by frequency."""
    count = lambda n: F.sum(F.when(c(n) > 0, 1).otherwise(0)).cast("long")
    return report.groupBy("frequency").agg(count("errors").alias("error_stocks"), count("warnings").alias("warning_stocks"), F.sum("errors").alias("error_issues"), F.sum("warnings").alias("warning_issues"))


def quality_issues(report: DataFrame) -> DataFrame:
    """One row for each security and issue that it has."""
    return report.unpivot([KEY], list(ISSUES), "issue", "n").where("n > 0").withColumn("severity", mapped(c("issue"), ISSUES))


def is_trading_day(day: Column) -> Column:
    return F.weekday(day) < 5


def next_trading_day(day: Column) -> Column:
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))


def last_trading_day(day: Column) -> Column:
    return F.date_sub(day, F.when(F.weekday(day) == 6, 2).when(F.weekday(day) == 5, 1).otherwise(0))


def seconds_of_day(ts: Column) -> Column:
    """Seconds since midnight, with their fraction."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)


def within_hours(ts: Column, market: str, auction: bool = False) -> Column:
    """Whether a time of day lies in a session of the market, ends included."""
    s, inside = seconds_of_day(ts), F.lit(False)
    spans = list(SESSIONS[market])
    if auction and market == "HK":
        spans[-1] = (spans[-1][0], CLOSING_AUCTION)
    for lo, hi in spans:
        inside = inside | s.between(lo, hi)
    return inside


def in_session(ts: Column, market: str, auction: bool = False) -> Column:
    return is_trading_day(F.to_date(ts)) & within_hours(ts, market, auction)


def drop_flat(bars: DataFrame) -> DataFrame:
    flat = (c("open") == c("high")) & (c("high") == c("low")) & (c("low") == c("close"))
    return bars.where(~((c("volume") <= 0) & flat))


def resample(ticks: DataFrame, minutes: tuple[int, ...] = (5, 15, 30, 60), market: str = "HK", auction: bool = False) -> DataFrame:
    """Bars of several lengths from one scan; a bar holds what comes after its predecessor's end, its own end included.

    Ticks out of the market's hours and of no quantity are left out, and so are bars that come out flat without volume.
    """
    valid = ticks.where(within_hours(c("ts"), market, auction) & c("price").isNotNull() & F.coalesce(c("qty") > 0, F.lit(False)))
    sized = valid.withColumn("minutes", F.explode(F.array(*map(F.lit, minutes))))
    step = c("minutes") * 60
    end = F.ceil(F.unix_micros(c("ts").cast("timestamp")) / 1_000_000 / step) * step
    order = F.struct("ts", "seq")
    return drop_flat(sized.withColumn("end_ts", F.timestamp_seconds(end)).groupBy(KEY, "minutes", "end_ts").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume")
    ))


def derived(ticks: DataFrame, since=None, until=None, **how) -> DataFrame:
    """``resample`` of the dates from ``since`` to ``until``, ends included: all periods of the affected days from one scan.

    No bar spans two dates, so these are the rows of a derivation without bounds; an open end has no bound. Merged by
    ``store.upsert`` they replace what was derived from the days before their ticks changed.
    """
    day = F.to_date("ts")
    for bound, keep in ((since, lambda x: day >= x), (until, lambda x: day <= x)):
        ticks = ticks if bound is None else ticks.where(keep(F.lit(bound).cast("date")))
    return resample(ticks, **how)


def intraday_eligible(daily: DataFrame, least: int) -> DataFrame:
    """Securities with enough daily bars for intraday work."""
    return daily.groupBy(KEY).agg(F.count("*").alias("n")).where(c("n") >= least)


# What distribution plans say. A number may have decimals; a clause ends at a comma, a stop or a semicolon.
_N, _CLAUSE = r"(\d+(?:\.\d+)?)", "[^，。,;；]*?"
CANCELLED = "不派|无|取消"
CASH = (rf"每股{_CLAUSE}派\s*{_N}", rf"每\s*{_N}\s*股{_CLAUSE}派\s*{_N}", rf"股息\s*{_N}")
BONUS = tuple(rf"每\s*{_N}\s*股{_CLAUSE}{word}\s*{_N}" for word in ("送", "转增", "转"))
RIGHTS, RIGHTS_PRICE = rf"每\s*{_N}\s*股{_CLAUSE}供\s*{_N}\s*股", rf"供股价[为:]?\s*{_N}"


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found.cast("double"))


def _per_share(text: Column, pattern: str) -> Column:
    """What a clause "for each N shares M" gives for one share; NULL where it isn't there or N is 0."""
    base = _number(text, pattern, 1)
    return F.when(base > 0, _number(text, pattern, 2) / base)


def plan_actions(text: Column) -> Column:
    """The actions that a distribution plan tells of, up to three structs ``action, cash, ratio, price``.

    Plans that are cancelled, empty or NULL give none. Amounts and ratios are per share, the price of a rights issue 0 if
    it isn't named.
    """
    none = F.lit(None).cast("double")
    cash = F.coalesce(_number(text, CASH[0]), _per_share(text, CASH[1]), _number(text, CASH[2]))
    bonus, rights = F.coalesce(*[_per_share(text, p) for p in BONUS]), _per_share(text, RIGHTS)
    row = lambda kind, amount, ratio, price: F.struct(F.lit(kind).alias("action"), amount.alias("cash"), ratio.alias("ratio"), price.alias("price"))
    made = F.array(row("cash_dividend", cash, none, none), row("bonus_issue", none, bonus, none), row("rights_issue", none, rights, F.coalesce(_number(text, RIGHTS_PRICE), F.lit(0.0))))
    told = F.filter(made, lambda a: F.coalesce(a["cash"], a["ratio"]) > 0)
    return F.when(~F.coalesce(text.rlike(CANCELLED), F.lit(True)), told)


def distribution_actions(plans: DataFrame) -> DataFrame:
    """A row for each of the ``plan_actions`` of a security's plans."""
    return plans.select(KEY, TIME, F.inline(plan_actions(F.trim("plan"))))
