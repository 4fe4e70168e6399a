"""Stupid-backoff scores from count tables partitioned by hash.

Documents are dealt into blocks of bounded size. Each block is exploded into the n-grams of all
orders; the block's distinct n-grams with their counts go to the partition of the count table that
their hash names, where the counts of all blocks are added up and sent back to the blocks that
asked. There each document's n-grams are joined with their counts and summed to its score. An
n-gram moves once per block that has it, however many documents of the block repeat it, so a very
common one is no more work for its partition than there are blocks.

Every document is scored by the counts of all others: its own are taken off first. So the table
covers the whole corpus and no document vouches for itself.

An n-gram is known by 64 bits of hash, whatever its order. Two that collide would add their counts:
of n distinct ones about n * n / 2**65 pairs do, fewer than one pair in 6 billion n-grams.

What is exchanged is packed, a row for each block and partition: as plain rows the n-grams of a
corpus take about twice as much. ``count_table`` gives the table as plain rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import Grams, partitions_for, saved, sliced, table, words_of

ORDER, ALPHA = 3, 0.4
#: Bytes of text in one block, and blocks for one partition of the count table; both bound a task's memory.
BLOCK_BYTES, BLOCKS_PER_PART = 10 << 20, 2
#: Least number of blocks, so that small inputs keep many tasks busy.
LEAST_BLOCKS = 12
#: n-grams of one partition that are added up at once.
AT_ONCE = 1 << 19


def _pack(x: np.ndarray, random: int = 0) -> bytes:
    """Unsigned numbers as planes of bytes, lowest first; all but the ``random`` lowest planes compress well."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return planes[:random].tobytes() + zlib.compress(planes[random:].tobytes(), 1)


def _unpack(raw: bytes, kind: type, n: int, random: int = 0) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(raw[: random * n] + zlib.decompress(raw[random * n :]), dtype=np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


#: Low planes of the gaps between sorted hashes that look random.
RANDOM = 5


def _edges(parts: int) -> np.ndarray:
    """The least hash of each partition of the count table but the first."""
    return np.array([(b << 64) // parts for b in range(1, parts)], dtype=np.uint64)


def _exploded(texts: list[bytes]) -> list[list[np.ndarray]]:
    """Hashes of the n-grams of every order of each compressed text."""
    out = []
    for t in texts:
        words = words_of(zlib.decompress(t))
        g = Grams(words) if words else None
        out.append([g.of(k) if g else np.zeros(0, dtype=np.uint64) for k in range(1, ORDER + 1)])
    return out


def _distinct(docs: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of all orders of a block, sorted, and their counts."""
    every = np.concatenate([g for d in docs for g in d])
    every.sort()
    if not len(every):
        return every, np.zeros(0, dtype=np.uint32)
    start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[start], np.diff(start, append=len(every)).astype(np.uint32)


def _count(parts: int):
    edges = _edges(parts)

    def run(rows: pa.Table) -> pa.Table:
        block = rows["block"][0].as_py()
        grams, counts = _distinct(_exploded(rows["text"].to_pylist()))
        at = [0, *np.searchsorted(grams, edges).tolist(), len(grams)]
        out = [(p, block, hi - lo, _pack(np.diff(grams[lo:hi], prepend=np.uint64(0)), RANDOM), _pack(counts[lo:hi])) for p, (lo, hi) in enumerate(zip(at, at[1:])) if lo < hi]
        c = list(zip(*out)) or [()] * 5
        return pa.table([*(pa.array(x, pa.int32()) for x in c[:3]), pa.array(c[3], pa.binary()), pa.array(c[4], pa.binary())], names=["part", "block", "n", "grams", "counts"])

    return run


def _ranges(rows: pa.Table):
    """A partition's rows, unpacked: their n-grams and counts, and cuts of all of them at the same hashes."""
    size = rows["n"].to_pylist()
    grams = [np.cumsum(_unpack(g, np.uint64, n, RANDOM), dtype=np.uint64) for g, n in zip(rows["grams"].to_pylist(), size)]
    counts = [_unpack(c, np.uint32, n) for c, n in zip(rows["counts"].to_pylist(), size)]
    most = max(grams, key=len)
    step = max(1, len(most) * AT_ONCE // sum(size))
    cuts = [np.append(np.searchsorted(g, most[step::step]), len(g)) for g in grams]
    return grams, counts, [list(zip([0, *ends[:-1]], ends)) for ends in (c.tolist() for c in cuts)]


def _total(rows: pa.Table) -> pa.Table:
    """The counts of all blocks for the n-grams of each row: what the others have, in the row's order."""
    grams, counts, spans = _ranges(rows)
    others = [np.empty(len(g), dtype=np.uint64) for g in grams]
    for at in zip(*spans):
        known, place = np.unique(np.concatenate([g[lo:hi] for g, (lo, hi) in zip(grams, at)]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([c[lo:hi] for c, (lo, hi) in zip(counts, at)]), minlength=len(known)).astype(np.uint64)[place]
        stop = 0
        for o, c, (lo, hi) in zip(others, counts, at):
            start, stop = stop, stop + hi - lo
            o[lo:hi] = total[start:stop] - c[lo:hi]
    return pa.table([rows["block"], rows["part"], rows["n"], pa.array([_pack(o) for o in others], pa.binary())], names=["block", "part", "n", "others"])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for n, g, c in zip(b["n"].to_pylist(), b["grams"].to_pylist(), b["counts"].to_pylist()):
            gram = np.cumsum(_unpack(g, np.uint64, n, RANDOM), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(_unpack(c, np.uint32, n).astype(np.int64))], ["gram", "n"])


def backoff_scores(left: list[np.ndarray], rest: int) -> np.ndarray:
    """Log score of each word: ``left[k][i]`` is what other documents have of the (k+1)-gram that starts at i."""
    n = len(left[0])
    with np.errstate(divide="ignore"):
        # an unseen word: one more back-off, to one in all words
        score = np.where(left[0] > 0, np.log(left[0] / rest), np.log(ALPHA / rest)) + np.log(ALPHA) * np.minimum(np.arange(n), ORDER - 1)
    for k in range(1, ORDER):
        seen = np.flatnonzero(left[k] > 0)  # the (k+1)-gram from i scores word i + k in the context from i
        skipped = np.minimum(seen + k, ORDER - 1) - k
        score[seen + k] = np.log(left[k][seen] / left[k - 1][seen]) + np.log(ALPHA) * skipped
    return score


def _left(grams: list[np.ndarray], known: np.ndarray, others: np.ndarray) -> list[np.ndarray]:
    """For each document the counts that other documents have of its n-grams of one order.

    ``others`` holds what other blocks have of this block's distinct n-grams ``known``.
    """
    size = np.array([len(g) for g in grams])
    here, place, mine = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    pair = np.repeat(np.arange(len(grams)), size) * max(len(here), 1) + place
    _, at, own = np.unique(pair, return_inverse=True, return_counts=True)
    left = (mine + others[np.searchsorted(known, here)].astype(np.int64))[place] - own[at]
    return np.split(left, np.cumsum(size)[:-1])


def _score(n_all: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        grams = _exploded(docs["text"].to_pylist())
        size, packed = replies["n"].to_pylist(), replies["others"]
        parts = np.argsort(replies["part"].to_numpy(), kind="stable").tolist()
        others = np.concatenate([_unpack(packed[i].as_py(), np.uint64, size[i]) for i in parts] or [np.zeros(0, dtype=np.uint64)])
        known, left = _distinct(grams)[0], []
        for k in range(ORDER):
            left.append(_left([d[k] for d in grams], known, others))
        n_words = [len(d[0]) for d in grams]
        total = [float(backoff_scores([x[i] for x in left], max(n_all - n, 1)).sum()) if n else 0.0 for i, n in enumerate(n_words)]
        return pa.table([docs["doc_id"], pa.array(n_words, pa.int64()), pa.array(total, pa.float64())], names=["doc_id", "n_words", "log_score"])

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes: they are exchanged once and held by their block."""
    for b in batches:
        texts = [zlib.compress(t or b"", 1) for t in b["text"].cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["block"], pa.array(texts, pa.binary())], ["doc_id", "block", "text"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = size = 0
    for b in batches:
        texts = b["text"].cast(pa.binary()).to_pylist()
        n += sum(len(words_of(t)) for t in texts)
        size += sum(len(t or b"") for t in texts)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["n", "size"])


def _asked(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, int, int]:
    """Texts dealt into blocks; a row for each block and partition with its n-grams; numbers of blocks, partitions and words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sums = saved(docs.select("text").mapInArrow(sliced(_words), "n long, size long")).agg(F.sum("n"), F.sum("size")).first()
    blocks = partitions_for(sums[1] or 0, BLOCK_BYTES, LEAST_BLOCKS)
    parts = partitions_for(blocks, BLOCKS_PER_PART, 1)
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")).mapInArrow(sliced(_squeeze), "doc_id long, block int, text binary")
    dealt = dealt.repartition(blocks, "block")  # as many tasks as blocks, however many they are
    asked = dealt.groupBy("block").applyInArrow(_count(parts), "part int, block int, n int, grams binary, counts binary")
    return dealt, asked.repartition(max(parts, LEAST_BLOCKS), "part"), blocks, parts, sums[0] or 0


def count_table(docs: DataFrame) -> DataFrame:
    """``gram, n``: the hash of each n-gram of 1 to ORDER words as a signed long, and how often it is in the texts."""
    return _asked(docs)[1].select("n", "grams", "counts").mapInArrow(sliced(_plain), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def scores(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score`` for every row of ``docs`` (``doc_id, text``).

    ``log_score`` is the sum over the words of a text; the mean is null for a text without words
    (null, empty or blank). Other columns are ignored. Repeated rows are documents of their own:
    each is scored by the other. A corpus of one document scores all its words as unseen.
    """
    dealt, asked, blocks, _, n_all = _asked(docs)
    replies = asked.groupBy("part").applyInArrow(_total, "block int, part int, n int, others binary").repartition(blocks, "block")
    out = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(n_all), "doc_id long, n_words long, log_score double")
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
