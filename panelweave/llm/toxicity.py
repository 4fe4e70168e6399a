"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its hashed character n-grams and of itself, a document the
mean of its words, and a linear softmax on that mean gives the two class probabilities.
Embeddings and softmax are trained jointly in numpy. A misspelling that was never seen shares
most of its n-grams with the word it comes from and so gets nearly the same vector.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import sliced, table

BUCKETS, DIM = 1 << 17, 4
SHORTEST, LONGEST = 3, 6
#: Bounds of the training sample: toxic rows, other rows, and bytes of a text used for training.
MOST_TOXIC, MOST_CLEAN, TEXT_BYTES = 1200, 2400, 50_000
FOLDS = 5
#: Subwords in fewer training texts are left out.
MIN_TEXTS = 5
#: Weight of the toxic rows in the loss, whatever their number.
TOXIC_SHARE = 0.25
GAIN, EPOCHS, RATE = 10.0, 24, 0.5
CACHE = 300_000
MOST = ((0, MOST_CLEAN), (1, MOST_TOXIC))

_WORD = re.compile(r"\w+")


def subwords(word: str) -> list[int]:
    """Buckets of a lower-case word: itself and its character n-grams with its ends marked."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in range(SHORTEST, min(LONGEST, len(marked) - 1) + 1) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]


@dataclass
class Model:
    """The trained net folded into what scoring needs: a logit for each bucket, and a bias."""

    buckets: np.ndarray
    bias: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def words(self):
        """A function from a word to its logit."""
        logits = self.buckets.tolist()

        def word(w: str) -> float:
            parts = subwords(w)
            return sum([logits[b] for b in parts]) / len(parts)

        return word


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights: the mean over its words of the mean over a word's subwords."""
    counts = Counter(_WORD.findall(text.lower()))
    if not counts:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    parts = [subwords(w) for w in counts]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    share = np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) / counts.total() / sizes
    found, at = np.unique(np.fromiter(chain.from_iterable(parts), dtype=np.int32, count=int(sizes.sum())), return_inverse=True)
    return found, np.bincount(at, weights=np.repeat(share, sizes)).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Gradient descent with momentum on the weighted cross entropy, embeddings and softmax jointly.

    Subwords are weighted by the inverse square root of their mean share, as frequent ones say
    little, and the mean bag is taken off; both are folded into the returned logits. Without rows
    of both labels nothing can be learned, and every text scores below one half by the bias alone.
    """
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, dtype=np.float32), -1.0)
    bags = [_bag(t) for t in texts]
    doc = np.repeat(np.arange(len(bags), dtype=np.int32), [len(b) for b, _ in bags])
    sub, weight = np.concatenate([b for b, _ in bags]), np.concatenate([w for _, w in bags])
    del bags
    often = np.bincount(sub, minlength=BUCKETS) >= MIN_TEXTS
    used, place = np.flatnonzero(often), np.cumsum(often).astype(np.int32) - 1
    keep = often[sub]
    doc, sub, weight = doc[keep], place[sub[keep]], weight[keep]
    n, m = len(y), len(used)
    mean = np.bincount(sub, weights=weight, minlength=m) / n
    scale = 1.0 / np.sqrt(mean + 1e-6)
    weight = weight * scale[sub]
    norm = np.sqrt((weight**2).sum() / n) or 1.0
    weight, mean, scale = (weight * (GAIN / norm)).astype(np.float32), mean * scale * (GAIN / norm), scale * (GAIN / norm)

    rng = np.random.default_rng(seed)
    e, u, bias = rng.normal(0, 0.01, (m, DIM)), rng.normal(0, 1, (DIM, 2)), np.zeros(2)
    per_row = np.where(y == 1, TOXIC_SHARE / (y == 1).sum(), (1 - TOXIC_SHARE) / (y == 0).sum())
    speed = [np.zeros_like(p) for p in (e, u, bias)]
    for _ in range(EPOCHS):
        h = np.stack([np.bincount(doc, weights=weight * e[sub, k], minlength=n) for k in range(DIM)], axis=1) - mean @ e
        z = h @ u + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p *= per_row[:, None]
        back = p @ u.T
        to_e = np.stack([np.bincount(sub, weights=weight * back[doc, k], minlength=m) for k in range(DIM)], axis=1) - np.outer(mean, back.sum(axis=0))
        for param, grad, v in zip((e, u, bias), (to_e, h.T @ p, p.sum(axis=0)), speed):
            v *= 0.9
            v += grad
            param -= RATE * v
    logit = e @ (u[:, 1] - u[:, 0])
    buckets = np.zeros(BUCKETS, dtype=np.float32)
    buckets[used] = logit * scale
    return Model(buckets, float(bias[1] - bias[0] - mean @ logit))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as an empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of a bounded number of rows of either label outside fold 0.

    The rows with the least hashes of their ids are taken. An id labelled twice counts once, as
    toxic if any of its rows says so; labels other than 0 and 1, and null ids, are left out.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Twice the rows, as ids can be absent from docs or have long texts; a few thousand ids at most.
    chosen = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * n) for v, n in MOST]
    picked = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col("doc_id"), "text").where(F.coalesce(F.octet_length("text"), F.lit(0)).between(1, TEXT_BYTES))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((toxic, text) for b in batches for toxic, text in zip(b["toxic"].to_pylist(), b["text"].to_pylist()))
    model = train([text for _, text in rows], [toxic for toxic, _ in rows])
    yield pa.RecordBatch.from_pydict({"buckets": [model.buckets.tobytes()], "bias": [model.bias]}, pa.schema([("buckets", pa.binary()), ("bias", pa.float64())]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the bounded sample, trained in one task; the driver gets its logits, BUCKETS floats."""
    rows = sample(docs, labels)
    parts = [rows.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in MOST]
    row = parts[0].unionByName(parts[1]).select("toxic", "text").coalesce(1).mapInArrow(sliced(_train), "buckets binary, bias double").first()
    return Model(np.frombuffer(row["buckets"], dtype=np.float32), row["bias"]) if row else train([], [])


#: Logits of words by model; a Python worker keeps them from task to task.
_known: dict[str, dict[str, float]] = {}


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.name not in _known:
            _known.clear()
        known = _known.setdefault(model.name, {})
        logit = model.words()
        for b in batches:
            out = []
            for text in b["text"].to_pylist():
                words = _WORD.findall(text.lower()) if text else []
                total = 0.0
                for w in words:
                    x = known.get(w)
                    if x is None:
                        if len(known) >= CACHE:
                            known.clear()
                        x = known[w] = logit(w)
                    total += x
                z = model.bias + (total / len(words) if words else 0.0)
                out.append(1.0 / (1.0 + np.exp(-min(max(z, -40.0), 40.0))))
            at = b.schema.get_field_index("text")
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(out, pa.float64())], [*(b.schema.names[i] for i in keep), "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``docs`` (``doc_id, text``); other columns are ignored.

    The score is the probability of the toxic class, over the whole text. Texts without words,
    null ones too, get the probability that the softmax gives an empty bag. Repeated rows are kept.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sliced(_scorer(model)), "doc_id long, score double")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that a model fitted on ``labels`` doesn't call toxic."""
    run = _scorer(fit(docs, labels))
    columns = list(docs.columns)
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    kind = packed.schema["row"].dataType.simpleString()
    kept = packed.mapInArrow(sliced(run), f"row {kind}, score double").where("score < 0.5")
    return kept.select(*[F.col(f"row.`{c}`") for c in columns])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
