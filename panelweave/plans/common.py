"""Helpers of the query modules: the bars of a folder, rounding, SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.sources.bars import BARS_SQL, daily_bars, table, tasks_for


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily bars of a folder. A method over 8,000 bytes, as tables of rules become, is never compiled by the JVM, so Spark is asked to split such ones."""
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535")) > 8000:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return daily_bars(table(spark, sf_dir, "lineitem"))


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the bars are dealt to."""
    return tasks_for(table(spark, sf_dir, "lineitem"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show; no negative zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def past_ties(df: DataFrame, digits: int) -> DataFrame:
    """As ``rounded``, a little above each value, so that quotients that end in a five do not hang on their last bit."""
    return rounded(df.select(*[(F.col(f"`{c}`") + 1e-7).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]), digits)


def with_bars(*ctes: str) -> str:
    return "WITH " + ", ".join([BARS_SQL, *ctes])


def over(n: int, back: int = 0, key: str = "stock_code") -> str:
    """The SQL window of the last ``n`` bars that ended ``back`` bars ago."""
    end = f"{back} PRECEDING" if back else "CURRENT ROW"
    return f"(PARTITION BY {key} ORDER BY trade_date ROWS BETWEEN {n - 1 + back} PRECEDING AND {end})"
