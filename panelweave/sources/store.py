"""Datasets of the panel: reading with filters, appending, upserting, reports on coverage.

A dataset is a folder of Parquet partitioned by ``market`` and ``year``. Writers that replace a
dataset write beside it first, since a folder that is being read can't be overwritten.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import KEY, TIME

c = F.col


def filtered(df: DataFrame, filters: dict | None = None, columns: Iterable[str] | None = None, since=None, until=None, order_by: Iterable[str] = ()) -> DataFrame:
    """Equality and IN filters (None and empty lists are skipped), a date range, columns and order."""
    for name, value in (filters or {}).items():
        if value is None or value == []:
            continue
        df = df.where(c(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else c(name) == value)
    for bound, op in ((since, "ge"), (until, "le")):
        if bound is not None:
            day = F.lit(bound).cast("date")
            df = df.where(c(TIME) >= day if op == "ge" else c(TIME) <= day)
            if "year" in df.columns:  # prunes partitions; an open end stays open
                df = df.where(c("year") >= F.year(day) if op == "ge" else c("year") <= F.year(day))
    df = df.select(*columns) if columns else df.drop("year")
    return df.orderBy(*order_by) if order_by else df


def read_dataset(spark: SparkSession, path: str, **options) -> DataFrame:
    return filtered(spark.read.parquet(path), **options)


def write(df: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ("year",)) -> None:
    """Rows without a date are dropped; ``year`` is added. Large partitions are split over tasks, small ones share them.

    ``by=("market", "year")`` needs a column ``market``. Mode "dynamic" replaces the partitions that ``df`` has rows of.
    """
    out = df.where(c(TIME).isNotNull()).withColumn("year", F.year(TIME))
    writer = out.hint("rebalance", *by).write.partitionBy(*by)
    if mode == "dynamic":
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        writer.mode(mode).parquet(path)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows, the last of each key by ``order``; rows of ``new`` win ties, no order comes first."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, [F.desc(order), F.desc("_new")]).drop("_new")


def _replace(spark: SparkSession, path: str, rows: DataFrame, staging: str, by: tuple[str, ...]) -> None:
    """Write ``rows`` beside the dataset, then put them in place of the partitions that they are of."""
    write(rows, staging, by=by)
    swap(spark, path, staging, by)


#: Empty file of a staging folder whose partitions are all in place.
SWAPPED = "_swapped"


def _exists(spark: SparkSession, file: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(file)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def swap(spark: SparkSession, path: str, staging: str, by: tuple[str, ...] = ("year",)) -> None:
    """Put the partitions staged in ``staging`` in place of those of the dataset, and record that they are.

    Staged partitions are whole, so this can be repeated: what an interrupted swap has replaced is replaced again by the same rows.
    """
    spark.read.parquet(staging).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{staging}/{SWAPPED}")
    done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done, True).close()


def resume(spark: SparkSession, path: str, staging: str, by: tuple[str, ...] = ("year",)) -> bool:
    """Finish a replacement that broke off after its rows were staged whole; says whether there was one.

    One that broke off while staging has changed nothing: its folder lacks Spark's ``_SUCCESS`` and is written anew.
    """
    if not _exists(spark, f"{staging}/_SUCCESS") or _exists(spark, f"{staging}/{SWAPPED}"):
        return False
    swap(spark, path, staging, by)
    return True


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: str, staging: str, by: tuple[str, ...] = ("year",)) -> None:
    """Merge ``new`` into a dataset; only partitions that it has rows of are read and replaced. ``keys`` have the date.

    Can be repeated after a failure at any point: a replacement that ``staging`` still holds is finished first.
    """
    resume(spark, path, staging, by)
    new = new.where(c(TIME).isNotNull()).withColumn("year", F.year(TIME))
    touched = new.select(*by).distinct()  # a row for each partition
    old = spark.read.parquet(path).join(F.broadcast(touched), list(by), "left_semi")
    _replace(spark, path, upserted(old.drop("year"), new.drop("year"), keys, order), staging, by)


def compacted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by ``order``, ties by the other columns."""
    rest = [F.desc(x) for x in df.columns if x not in (*keys, *order)]
    return keep_last(df, keys, [*(F.desc(x) for x in order), *rest])


def compact(spark: SparkSession, path: str, keys: list[str], order: list[str], staging: str, by: tuple[str, ...] = ("year",)) -> None:
    """Rewrite a dataset with one row for each key; ``keys`` have the date."""
    _replace(spark, path, compacted(spark.read.parquet(path).drop("year"), keys, order), staging, by)


def scalar(df: DataFrame, expression: str, filters: dict | None = None) -> DataFrame:
    """One aggregate of the rows that pass the filters."""
    return filtered(df, filters).agg(F.expr(expression).alias("value"))


def update_log(log: DataFrame, limit: int, filters: dict | None = None) -> DataFrame:
    """The newest ``limit`` rows of a log (``log_id, logged_at``)."""
    return filtered(log, filters).orderBy(F.desc("logged_at"), F.desc("log_id")).limit(limit)


def log_row(counts: DataFrame, operation: str, as_of: Column) -> DataFrame:
    """What an upsert did, as a row to append to the log."""
    return counts.select(F.lit(operation).alias("operation"), as_of.alias("logged_at"), "inserted", "updated", (c("inserted") + c("updated")).alias("affected"))


#: Days that a fetch goes back before the latest bar, by frequency. Fixed values.
OVERLAP_DAYS = {"daily": 7, "1min": 5, "5min": 10, "15min": 10, "30min": 10, "60min": 15}


def incremental_plans(universe: DataFrame, bars: DataFrame, plans: dict[str, tuple[str, str]], skip_fresh: bool = True) -> DataFrame:
    """For each security and frequency the latest bar, where to fetch from, whether it is fresh, and whether to fetch.

    ``bars`` has ``frequency`` and ``ts``; ``plans`` has the first and last time wanted of each frequency.
    """
    newest = bars.groupBy(KEY, "frequency").agg(F.max("ts").alias("latest"))
    days = F.create_map(*[F.lit(x) for kv in OVERLAP_DAYS.items() for x in kv])
    each = [F.struct(F.lit(f).alias("frequency"), F.lit(a).cast("timestamp").alias("start_ts"), F.lit(z).cast("timestamp").alias("end_ts")) for f, (a, z) in plans.items()]
    wanted = universe.select(KEY).distinct().select(KEY, F.inline(F.array(*each)))
    out = wanted.join(newest, [KEY, "frequency"], "left").withColumn("_days", F.coalesce(F.try_element_at(days, c("frequency")), F.lit(7)))
    start = F.greatest("start_ts", F.expr("latest - make_dt_interval(_days)"))
    start = F.when(c("frequency") == "daily", F.date_trunc("day", start)).otherwise(start)
    out = out.withColumns({"fetch_from": F.when(c("latest").isNull(), c("start_ts")).otherwise(start), "fresh": F.coalesce(c("latest") >= c("end_ts"), F.lit(False))})
    return out.withColumn("should_fetch", ~(F.lit(skip_fresh) & c("fresh"))).drop("_days")


def frequency_coverage(universe: DataFrame, bars: DataFrame, frequencies: Iterable[str]) -> DataFrame:
    """Rows, securities with rows and without, for each frequency."""
    wanted = universe.select(KEY).distinct().withColumn("frequency", F.explode(F.array(*map(F.lit, frequencies))))
    have = bars.groupBy(KEY, "frequency").agg(F.count("*").alias("n"))
    return wanted.join(have, [KEY, "frequency"], "left").groupBy("frequency").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_rows"), F.count("n").alias("with_rows"), F.sum(F.when(c("n").isNull(), 1).otherwise(0)).alias("missing"))


def partial_securities(universe: DataFrame, bars: DataFrame, frequencies: Iterable[str]) -> DataFrame:
    """Securities that have some frequencies and lack others, with those that they lack."""
    wanted = universe.select(KEY).distinct().withColumn("frequency", F.explode(F.array(*map(F.lit, frequencies))))
    have = bars.select(KEY, "frequency").distinct().withColumn("_have", F.lit(1))
    out = wanted.join(have, [KEY, "frequency"], "left").groupBy(KEY).agg(F.count("_have").alias("n_have"), F.array_join(F.array_sort(F.collect_set(F.when(c("_have").isNull(), c("frequency")))), ",").alias("lacking"))
    return out.where((c("n_have") > 0) & (c("lacking") != ""))


def change_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys of ``new`` an upsert inserts and how many it updates."""
    fresh = new.select(*keys).distinct()
    known = old.select(*keys).distinct().withColumn("_old", F.lit(1))
    return fresh.join(known, keys, "left").agg(F.sum(F.when(c("_old").isNull(), 1).otherwise(0)).alias("inserted"), F.sum(F.coalesce("_old", F.lit(0))).cast("long").alias("updated"))


def statistics(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count("*").alias("n_rows"), F.count_distinct(KEY).alias("securities"), F.min(TIME).alias("first_date"), F.max(TIME).alias("last_date"))


def verification(bars: DataFrame) -> DataFrame:
    """Rows and date range of each security, and of all (NULL code)."""
    return bars.rollup(KEY).agg(F.count("*").alias("n_rows"), F.min(TIME).alias("first_date"), F.max(TIME).alias("last_date"))


def incremental_plan(universe: DataFrame, bars: DataFrame, base: str, as_of: str, overlap: int = 7, fresh_days: int = 3) -> DataFrame:
    """Per security the latest bar, where to fetch from, and whether there is anything to fetch."""
    newest = bars.groupBy(KEY).agg(F.max(TIME).alias("latest"))
    start, day = F.lit(base).cast("date"), F.lit(as_of).cast("date")
    plan = universe.select(KEY).distinct().join(newest, KEY, "left").withColumn("fetch_from", F.coalesce(F.greatest(start, F.date_sub("latest", overlap)), start))
    return plan.withColumn("fresh", F.coalesce(F.datediff(day, "latest") <= fresh_days, F.lit(False))).withColumn("should_fetch", ~c("fresh"))


def coverage(universe: DataFrame, bars: DataFrame, least: int = 1) -> DataFrame:
    """Rows of each security of the universe and whether it is missing, partial or complete."""
    have = bars.groupBy(KEY).agg(F.count("*").alias("n_rows"))
    out = universe.select(KEY).distinct().join(have, KEY, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return out.withColumn("state", F.when(c("n_rows") == 0, "missing").when(c("n_rows") < least, "partial").otherwise("complete"))
