"""Bars from an unbounded stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.columns import KEY
from panelweave.operators.cleaning import within_hours


def streaming_bars(ticks: DataFrame, minutes: int = 5, late: str = "10 minutes", market: str = "HK") -> DataFrame:
    """``stock_code, end_ts`` and prices of each closed bar; ticks later than ``late`` behind the newest are left out.

    Ticks out of the market's hours make no bars, but move the watermark. A bar holds what comes after its predecessor's end, its own end included, as ``resample`` does:
    the built-in window begins with its start, so times are moved by a microsecond.
    """
    moved = ticks.withColumn("ts", F.col("ts").cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")).withWatermark("ts", late)
    moved = moved.where(within_hours(F.col("ts") + F.expr("INTERVAL 1 MICROSECOND"), market))  # of the event time, so it stays behind the watermark
    order = F.struct("ts", "seq")
    out = moved.groupBy(KEY, F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume")
    )
    return out.select(KEY, F.col("w.end").alias("end_ts"), "open", "high", "low", "close", "volume")
