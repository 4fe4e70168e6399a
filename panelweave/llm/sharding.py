"""Uniform shuffle into shards of exact size, driven by a hypergeometric communication matrix.

Input partition ``p`` holds ``n_p`` rows; shard ``s`` gets exactly ``m_s``. How many rows of ``p``
a uniformly random permutation sends to ``s`` follows the multivariate hypergeometric law with
these margins, so the matrix of counts is drawn first, on the driver, from the margins alone.
Then every partition permutes its rows locally and deals them out by its row of the matrix, the
rows are exchanged, and every shard permutes what it received. Only ids, sizes and checksums
move; texts do not.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import saved, table

#: numpy's sampler takes populations below this; larger ones use ``_hypergeometric_large``.
NUMPY_LIMIT = 10**9


def _hypergeometric_large(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Inverse-CDF draw from the hypergeometric law, for populations numpy refuses.

    The mass within 14 standard deviations of the mean is tabulated by its logarithm; what lies
    beyond is below the resolution of a double.
    """
    total = good + bad
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    lo, hi = max(0, draws - bad), min(good, draws)
    mean = draws * (good / total)
    spread = math.sqrt(max(mean * (bad / total) * ((total - draws) / max(1, total - 1)), 0.0))
    a, b = max(lo, int(mean - 14 * spread - 8)), min(hi, int(mean + 14 * spread + 8))
    k = np.arange(a, b, dtype=np.float64)  # ratios p(k+1)/p(k) for k in [a, b)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.exp(logs - logs.max())
    return a + int(np.searchsorted(np.cumsum(mass), rng.random() * mass.sum(), side="right").clip(0, b - a))


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Counts per partition and shard with the given margins, drawn exactly."""
    if sum(rows) != sum(shards):
        raise ValueError("partition and shard sizes must have the same sum")
    rng = np.random.default_rng(seed)
    left = np.array(shards, dtype=np.int64)
    out = np.zeros((len(rows), len(shards)), dtype=np.int64)
    for p, n in enumerate(rows):
        rest = int(left.sum())
        for s in range(len(shards)):
            good, bad = int(left[s]), rest - int(left[s])
            if good + bad < NUMPY_LIMIT:
                got = int(rng.hypergeometric(good, bad, n)) if n and good else 0
            else:
                got = _hypergeometric_large(rng, good, bad, n)
            out[p, s] = got
            n, rest = n - got, bad
        left -= out[p]
    return out


def uniform_shards(df: DataFrame, n_shards: int = 8, seed: int = 17, rows_per_bucket: int = 50_000) -> DataFrame:
    """``df`` plus ``shard`` int and ``slot`` long: a uniform shuffle, shard sizes at most one apart.

    Every row counts on its own: nulls, ties and repeated rows get slots like any other. An empty
    input gives an empty output. ``df`` should be narrow; it is written once to the shared folder,
    so that a lost executor reruns its tasks on the same rows in the same places.
    Columns of the same names as those added here are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = df.sparkSession
    own = [c for c in df.columns if c not in ("shard", "slot")]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row") if own else F.struct(F.lit(None).alias("_")).alias("row"))
    placed = saved(packed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").count().orderBy("part").collect()  # a row for each input partition
    rows = [r["count"] for r in sizes]
    total = sum(rows)
    shard_sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    ends = np.cumsum(communication_matrix(rows, shard_sizes, seed), axis=1)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ends", T.ArrayType(T.LongType()))])
    deal = spark.createDataFrame([(r["part"], [int(x) for x in e]) for r, e in zip(sizes, ends)], schema)

    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "at"), "at")
    dealt = (
        placed.withColumn("rank", F.row_number().over(local))
        .join(deal, "part")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))).cast("int"))
        .withColumn("draw", F.xxhash64(F.lit(seed + 1), "at"))
        .select("row", "at", "shard", "draw")
    )
    # The second permutation: a random order within the shard, ranked bucket by bucket of equal
    # shares of the hash range, so that no task holds a whole shard.
    buckets = max(1, -(-max(shard_sizes) // rows_per_bucket))
    dealt = dealt.withColumn("bucket", F.pmod(F.shiftright("draw", 20), F.lit(buckets)).cast("int"))
    filled = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = filled.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    inside = Window.partitionBy("shard", "bucket").orderBy("draw", "at")
    out = dealt.withColumn("nth", F.row_number().over(inside) - 1).join(before, ["shard", "bucket"])
    return out.select(*[F.col(f"row.`{c}`") for c in own], "shard", (F.col("nth") + F.col("start")).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Files of the shards, ordered by slot within each file."""
    df.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def op10_shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_size(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"))
    out = uniform_shards(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
