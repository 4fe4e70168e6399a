"""Panels derived from the star-schema tables: daily bars, intraday ticks, the security registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.columns import padded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Trades that a task sorts and turns into bars, and the fewest that are worth a task of their own.
TASK_TRADES, LEAST_TRADES = 250_000, 20_000


def tasks_for(trades: DataFrame) -> int:
    """How many tasks the trades are dealt to: as many as the session has cores, more if a task's share grows too large, fewer if there are few."""
    n = trades.count()  # of a table of Parquet: from the footers
    return max(1, -(-n // TASK_TRADES), min(trades.sparkSession.sparkContext.defaultParallelism, n // LEAST_TRADES))


def daily_bars(lineitem: DataFrame) -> DataFrame:
    """``stock_code, trade_date, open, high, low, close, volume``: a supplier's trades of a day make a bar.

    Trades are dealt by security and sorted once; the bars keep that dealing and order, so that windows by security and
    date need neither an exchange nor a sort of their own, and a task's share does not grow with the table.
    """
    code, fields = padded(F.col("l_suppkey")), ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    own = lineitem.select("l_suppkey", F.to_date("l_shipdate").alias("trade_date"), *fields, F.col("l_quantity"))
    trades = own.repartition(tasks_for(lineitem), code).select(  # what follows from a trade's own fields is not moved with it
        code.alias("stock_code"), "trade_date", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.struct(*fields).alias("nth"), F.col("l_quantity").cast("double").alias("quantity"),
    )
    return trades.groupBy("stock_code", "trade_date").agg(
        F.min_by("price", "nth").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "nth").alias("close"), F.sum("quantity").alias("volume"),
    )


def ticks(events: DataFrame) -> DataFrame:
    """``stock_code, ts, seq, price, qty`` from the event stream."""
    return events.select(F.col("event_type").alias("stock_code"), "ts", F.col("event_id").alias("seq"), (F.col("value") + 1).alias("price"), F.lit(1.0).alias("qty"))


def registry(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """``stock_code, stock_name, exchange, market``: suppliers, their nation and region."""
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("exchange"), F.col("r_name").alias("market"))
    return supplier.join(F.broadcast(places), supplier.s_nationkey == places.n_nationkey).select(
        padded(F.col("s_suppkey")).alias("stock_code"), F.col("s_name").alias("stock_name"), "exchange", "market"
    )


def pad_sql(x: str, n: int = 5) -> str:
    return f"lpad(CAST({x} AS VARCHAR), CAST(greatest({n}, len(CAST({x} AS VARCHAR))) AS INT), '0')"


BARS_SQL = f"""bars AS (
  SELECT {pad_sql('l_suppkey')} AS stock_code, CAST(l_shipdate AS DATE) AS trade_date,
         arg_min(px, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS "close", CAST(sum(l_quantity) AS DOUBLE) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem) GROUP BY ALL)"""
