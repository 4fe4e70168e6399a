"""What several operators of this subpackage share: tables, scratch folders, words, hashes."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts can be long, so batches hold few of them.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(run):
    """``run`` (batches to batches) on slices of ``BATCH_ROWS`` rows: what a Python worker unpacks at a time is bounded, whatever the session's batches hold."""

    def on_slices(batches):
        return run(b.slice(k, BATCH_ROWS) for b in batches for k in range(0, max(b.num_rows, 1), BATCH_ROWS))

    return on_slices


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; a local one is made only where the
    setting is absent and all tasks run on this machine, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


#: Seconds between two collections of the driver's garbage.
COLLECT_EVERY = 5.0
_collected = [0.0]


def _collect_garbage(spark: SparkSession) -> None:
    """Shuffle files, broadcasts and buffers of what is written go only once the driver collects its garbage."""
    if time.monotonic() - _collected[0] > COLLECT_EVERY:
        gc.collect()
        spark._jvm.System.gc()
        _collected[0] = time.monotonic()


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that ``saved`` wrote, once nothing reads them any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Paths of the stages under way, the innermost last.
_open: list[list[str]] = []


@contextmanager
def stage(spark: SparkSession):
    """Inside it, what ``saved`` writes is removed at the end, but for the last table, whose path is put into the list that it gives."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        discard(spark, made[:-1])
        del made[:-1]


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage as checkpoint() does, in a columnar and compressed form. Python workers get small batches meanwhile; the
    session's own setting holds again afterwards. The files go at the end of the ``stage``, or when the application ends.
    """
    spark, setting = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, own = scratch(spark), df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(setting, str(BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, own)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    for paths in _open[-1:]:
        paths.append(path)
    _collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """Tells texts of rows that share an id apart; null has a key of its own."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


#: Names of the columns of ``row_key``.
ROW_KEY = ["k1", "k2"]


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """``k1, k2``: never null, and equal for rows of equal id and text only."""
    return [F.coalesce(doc_id.cast("long"), F.lit(0)).alias("k1"), F.xxhash64(F.coalesce(text, F.lit("")), text.isNull(), doc_id.isNull()).alias("k2")]


def partitions_for(rows: int, per_task: int, least: int = 12) -> int:
    return int(max(least, -(-rows // per_task)))


# Word hashing on raw bytes, used inside tasks. --------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_table(which: str, n: int) -> np.ndarray:
    """1, b, b*b, ... modulo 2**64; grown by doubling and kept for the task."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        out = np.full(size, _BASE if which == "up" else _INVERSE, dtype=np.uint64)
        out[0] = 1
        have = _powers[which] = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D."""
    return text.split() if text else []


def word_starts(words: list[bytes]) -> np.ndarray:
    """Offsets of the words in their single-space join, and one past its end plus a space."""
    out = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, out=out[1:])
    return out


class Grams:
    """Hashes of runs of words of one text, from prefix sums over the bytes of its joined words.

    Equal runs have equal hashes everywhere; unequal runs may collide, so callers that need an
    exact answer compare the words themselves.
    """

    def __init__(self, words: list[bytes]):
        self.joined, self.starts = b" ".join(words), word_starts(words)
        raw = np.frombuffer(self.joined, dtype=np.uint8).astype(np.uint64)
        raw += np.uint64(1)
        raw *= _power_table("up", len(raw))
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(raw, out=self.sums[1:])
        self.down = _power_table("down", len(raw) + 1)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def of(self, k: int) -> np.ndarray:
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        lo, hi = self.starts[:n], self.starts[k : k + n] - 1
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])

    def text(self, start: int, stop: int) -> bytes:
        """Words ``start`` to ``stop``, joined by one space."""
        return self.joined[self.starts[start] : self.starts[stop] - 1]
