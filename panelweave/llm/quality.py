"""Quality rules by a hashed n-gram likelihood ratio between a trusted target and the raw corpus.

Words and word pairs are hashed into ``BUCKETS``; one multinomial is counted over the documents
labelled as good, one over all documents. A document's score is the mean over its n-grams of the
log ratio of the two, so long and short texts compare. Every document whose score reaches the
threshold passes, the rest fail: nothing is drawn at random.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import Grams, sliced, table, words_of

BITS = 14
BUCKETS = 1 << BITS
SMOOTHING = 1.0
#: Mean log ratio per n-gram that a document must reach.
THRESHOLD = -0.15
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_INNER = bytes(range(0x80, 0xC0))  # bytes of a code point after its first


def buckets_of(grams: Grams) -> np.ndarray:
    return (np.concatenate([grams.of(1), grams.of(2)]) >> np.uint64(64 - BITS)).astype(np.int64)


def repeated_words(grams: Grams) -> int:
    """Words in windows of WINDOW words that are found twice or more in the text."""
    h = grams.of(WINDOW)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twin = np.zeros(len(h), dtype=bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    at = np.flatnonzero(twin)
    seen: dict[bytes, int] = {}
    texts = [grams.text(i, i + WINDOW) for i in at.tolist()]  # equal hashes may be of unequal words
    for t in texts:
        seen[t] = seen.get(t, 0) + 1
    steps = np.zeros(len(grams) + 1, dtype=np.int64)
    for i, t in zip(at.tolist(), texts):
        if seen[t] > 1:
            steps[i] += 1
            steps[i + WINDOW] -= 1
    return int((np.cumsum(steps[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += bool(line.strip(_SPACE))
        else:
            seen.add(line)
    return n


def measures(text: bytes | None, log_ratio: np.ndarray) -> tuple[int, int, int, int, int, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score; a text without words scores 0."""
    text = text or b""
    words = words_of(text)
    body = text.translate(None, _SPACE)
    chars = len(body.translate(None, _INNER))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    if not words:
        return 0, 0, symbols, 0, 0, 0.0
    grams = Grams(words)
    return len(words), chars, symbols, repeated_lines(text), repeated_words(grams), float(log_ratio[buckets_of(grams)].mean())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for b in batches:
        for text in b["text"].cast(pa.binary()).to_pylist():
            if words := words_of(text):
                total += np.bincount(buckets_of(Grams(words)), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all n-grams of all texts by bucket; the driver gets BUCKETS rows whatever the input."""
    out = np.zeros(BUCKETS, dtype=np.float64)
    for r in docs.select("text").mapInArrow(sliced(_count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p_target - log p_raw for each bucket, smoothed by the raw corpus.

    The target is every document that some label calls good. Without any the ratio is 0 everywhere.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    raw = bucket_counts(docs)
    # Labels grow with the corpus, so this is a shuffle join at any size.
    target = bucket_counts(docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left_semi"))
    if not target.sum():
        return np.zeros(BUCKETS)
    p_raw = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    p_target = (target + SMOOTHING * BUCKETS * p_raw) / (target.sum() + SMOOTHING * BUCKETS)
    return np.log(p_target) - np.log(p_raw)


def _score(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for b in batches:
            got = [measures(t, ratio) for t in b["text"].cast(pa.binary()).to_pylist()]
            columns = list(zip(*got)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.float64())], ["doc_id", *names, "llr"])

    return run


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the five measures, ``llr`` double, ``base_failed`` and ``kept`` for every row of ``docs``.

    Reads ``doc_id, text`` of docs and ``doc_id, quality`` of labels; other columns are ignored.
    Null and empty texts have no words, score 0 and fail the base rule. Repeated rows are kept and
    counted as often as they occur.
    """
    ratio = log_ratio(docs, labels)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sliced(_score(ratio)), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"
    )
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= THRESHOLD))


def op9_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
