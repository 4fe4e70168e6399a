"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints within three bits of each other agree in at least one of four 16-bit blocks (or in
one of the block combinations used for more fingerprints), so each distinct fingerprint is sent,
once per combination, to the group named by the leading bits of those blocks. In a group,
fingerprints are sorted by Gray rank, which puts those that differ in few bits side by side;
runs of ``FANOUT`` are factored into upper nodes that hold the bits all members share. Pairs of
nodes whose shared bits already differ in more than three places are dropped with all that lies
below them; what is left is compared bit by bit. Groups return stars, not pairs, and the stars
are joined into components over all groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import ROW_KEY, partitions_for, row_key, saved, sliced, table, words_of

SEED, SHINGLE, DISTANCE = 42, 3, 3
FANOUT = 16
#: Distinct fingerprints aimed at in one group, and node pairs compared at once.
GROUP, AT_ONCE = 4096, 1 << 16
#: A group of more is grouped again by these numbers of blocks, with all bits of those that are chosen.
HEAVY, FINER = 4 * GROUP, ((8, 40), (16, 52))


def fingerprint(text: bytes | None) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's shingles; 0 without words."""
    words = words_of(text.lower() if text else text)  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - SHINGLE + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    lo = [0, *(ends[: n - 1] + 1).tolist()]
    hi = ends[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(lo, hi)), dtype=np.uint64, count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter(map(fingerprint, b["text"].cast(pa.binary()).to_pylist()), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b["doc_id"], *(b[k] for k in ROW_KEY), pa.array(fps.view(np.int64))], ["doc_id", *ROW_KEY, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, the row's key and ``fp`` (the 64 bits as a signed long) of every row of ``docs``; null texts count as empty."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(F.col("doc_id"), F.col("text")), "text")
    return own.mapInArrow(sliced(_fingerprints), "doc_id long, k1 long, k2 long, fp long")


# The index of one group. ------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask of shared bits) of the nodes of each level; leaves first, few nodes last."""
    ones, zeros = fps, ~fps
    out = [(ones, ones | zeros)]
    while len(ones) > FANOUT:
        at = np.arange(0, len(ones), FANOUT)
        ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
        out.append((ones, ones | zeros))
    return out


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]; a label is the least member of its component."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up


def _one_label(label: np.ndarray) -> np.ndarray:
    """The common label of each node's members, or -1."""
    at = np.arange(0, len(label), FANOUT)
    lo, hi = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
    return np.where(lo == hi, lo, -1)


def components_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in Gray order, and for each the index of its component's first one.

    Links are at most ``DISTANCE`` bits. Node pairs whose members all are in one component
    already are dropped like those that are too far apart, so a dense group costs little more
    than its own size.
    """
    fps = np.unique(fps)
    fps = fps[np.argsort(gray_rank(fps), kind="stable")]
    label = np.arange(len(fps))
    near = np.flatnonzero(np.bitwise_count(fps[1:] ^ fps[:-1]) <= DISTANCE)
    label = _roots(label, near, near + 1)
    levels = _levels(fps)
    top = len(levels) - 1
    i, j = np.triu_indices(len(levels[top][0]))
    stack = [(top, i, j)]
    while stack:
        k, i, j = stack.pop()
        if len(i) > AT_ONCE:
            stack.append((k, i[AT_ONCE:], j[AT_ONCE:]))
            i, j = i[:AT_ONCE], j[:AT_ONCE]
        pattern, mask = levels[k]
        ok = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= DISTANCE
        i, j = i[ok], j[ok]
        if k == 0:
            label = _roots(label, i, j)
            continue
        one = label
        for _ in range(k):
            one = _one_label(one)
        ok = (one[i] != one[j]) | (one[i] < 0)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        below = np.arange(FANOUT)
        for at in range(0, len(i), 256):  # children of a few hundred pairs at a time
            a = (i[at : at + 256, None, None] * FANOUT + below[None, :, None]) + np.zeros((1, 1, FANOUT), dtype=np.int64)
            b = (j[at : at + 256, None, None] * FANOUT + below[None, None, :]) + np.zeros((1, FANOUT, 1), dtype=np.int64)
            a, b = a.ravel(), b.ravel()
            n = len(levels[k - 1][0])
            ok = (a <= b) & (a < n) & (b < n)
            stack.append((k - 1, a[ok], b[ok]))
    return fps, label


def _stars(rows: pd.DataFrame) -> pd.DataFrame:
    """The stars of all groups (``c, value``) among the rows; a group of one has none."""
    rows = rows.sort_values(["c", "value"], kind="stable")
    fps, c, value = rows["fp"].to_numpy().view(np.uint64), rows["c"].to_numpy(), rows["value"].to_numpy()
    start = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (value[1:] != value[:-1])]))
    size = np.diff(start, append=len(fps))
    a, b = fps[start[size == 2]], fps[start[size == 2] + 1]
    near = np.bitwise_count(a ^ b) <= DISTANCE
    us, vs = [np.maximum(a, b)[near]], [np.minimum(a, b)[near]]
    for lo, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        own, label = components_of(fps[lo : lo + n])
        linked = label != np.arange(len(own))
        us.append(own[linked])
        vs.append(own[label[linked]])
    return pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})


def _masks(blocks: int, bits: int) -> list[int]:
    """A mask, as a signed long, for each choice of all but DISTANCE blocks: the first ``bits`` bits of these."""
    edges, out = [round(64 * b / blocks) for b in range(blocks + 1)], []
    for chosen in combinations(range(blocks), blocks - DISTANCE):
        places = [p for b in chosen for p in range(edges[b], edges[b + 1])][:bits]
        mask = sum(1 << (63 - p) for p in places)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _keyed(distinct: DataFrame, blocks: int, bits: int) -> DataFrame:
    """``fp, c, value``: a row for each mask ``c``, with the bits that it leaves."""
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(blocks, bits)])
    return distinct.select("fp", F.posexplode(masks).alias("c", "mask")).select("fp", "c", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))


def links(distinct: DataFrame, n: int) -> DataFrame:
    """Stars ``u, v`` that connect what is linked within each group of the ``n`` fingerprints ``fp``.

    Fingerprints within DISTANCE bits agree in all but DISTANCE blocks, whatever the blocks, so they
    meet in some group. What is in a group of over HEAVY is grouped again by more and smaller blocks;
    sixteen blocks leave 2 ** 12 fingerprints to a group at most.
    """
    blocks = 4 if n <= 1 << 22 else 5 if n <= 1 << 30 else 6
    stars, rest = None, distinct
    for count, bits in ((blocks, max(0, int(n // GROUP).bit_length())), *FINER):
        spread = _keyed(rest, count, bits)
        last = (count, bits) == FINER[-1]
        heavy = None if last else saved(spread.groupBy("c", "value").count().where(F.col("count") > HEAVY).select("c", "value"))
        heavy = heavy if heavy is not None and not heavy.isEmpty() else None
        light = spread if heavy is None else spread.join(heavy, ["c", "value"], "left_anti")
        buckets = partitions_for(n * comb(count, DISTANCE), 4 * HEAVY)  # many groups to a call, each whole
        found = light.withColumn("bucket", F.pmod(F.xxhash64("c", "value"), F.lit(buckets))).groupBy("bucket").applyInPandas(_stars, "u long, v long")
        stars = found if stars is None else stars.union(found)
        if heavy is None:
            break
        rest = saved(spread.join(heavy, ["c", "value"], "left_semi").select("fp").distinct())
        n = rest.count()
    return stars


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (u, v); root is the least node of its component.

    Alternates large-star and small-star steps until nothing changes; each result is written to
    the shared folder. Minima are combined before they move.
    """
    edges = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), F.col("m"), "u")
        small = small.select(F.col("a").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = saved(small.where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        state = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, fp, component_id, root`` for every row of ``docs`` (``doc_id, text``); other columns are ignored.

    ``root`` tells components apart, ``component_id`` is the least doc_id reachable by links of at most three bits. Texts without
    words (null, empty, white space) have fingerprint 0 and are linked like any other. Repeated
    rows are kept; null ids are carried but never name a component unless it has no other.
    """
    marked = saved(fingerprints(docs))
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(links(distinct.select("fp"), distinct.count()))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.join(named, "root").select("fp", "component_id", "root"), "fp").select("doc_id", *ROW_KEY, "fp", "component_id", "root")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, of each component.

    The row of the least id stays, of several of that id the one of the least key; a row without
    id stays only where no row of its component has one. Of equal rows one stays.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), *ROW_KEY)
    best = near_duplicates(docs).groupBy("root").agg(F.min(rank).alias("best")).select("best.k1", "best.k2").distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(F.col("doc_id"), F.col("text")))
    kept = own.join(best, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY)
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
