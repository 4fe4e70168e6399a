"""Substring deduplication by prefix-partitioned suffix trees over words.

A window of WINDOW words counts as repeated if its words also start in a document with a smaller
id. Not every suffix needs a place in a tree: among the PREFIX-word prefixes in a window the one of
the least hash is chosen, and equal windows choose alike, so suffixes that start at chosen prefixes
suffice. A prefix found in one document only heads no repeat and is dropped before any text moves.

The remaining suffixes are dealt by prefix into groups that fit a task's memory. In a group one
suffix tree is built over the words to the right of each prefix and one over the words to its left,
nearest first, both as sorted suffixes with the depths at which neighbours part; an internal node
at depth d is a run of neighbours that share d words. Nodes deep enough on both sides together are
the maximal repeats: a window with o words left of its prefix is in the same place of both trees
for equal windows. A prefix of more suffixes than a task should hold is lengthened to all of the
window, for each place the window can have; such a subtree is a single node, and its least
document is found by a grouped minimum.

One prefix or passage may be a third of all rows. What is known of a key is joined to its rows by
a shuffle only where the key has few rows; keys with a fixed share of all rows and more are so few
that they are broadcast, and their rows are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.llm.common import ROW_KEY, Grams, partitions_for, row_key, saved, sliced, table, words_of

WINDOW, PREFIX = 50, 8
#: Prefix places in a window, so also the most words a window has to the left of one, plus one.
PLACES = WINDOW - PREFIX + 1
#: Suffixes aimed at in one group, and in one prefix before it is lengthened.
GROUP, HOT = 20_000, 50_000
#: A key of more than one of so many parts of all rows is broadcast, so at most this many are.
SHARES = 10_000
KEY = ROW_KEY


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key(F.col("doc_id"), F.col("text")))


def chosen(h: np.ndarray) -> np.ndarray:
    """Positions of the leftmost least hash of each window of PLACES prefixes, each once, ascending."""
    if len(h) < PLACES:
        return np.zeros(0, dtype=np.int64)
    best, width = np.arange(len(h)), 1
    while width < PLACES:
        step = min(width, PLACES - width)
        a, b = best[:-step], best[step:]
        best, width = np.where(h[a] <= h[b], a, b), width + step
    return np.unique(best)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, at, anchor = [], [], []
        for i, text in enumerate(b["text"].cast(pa.binary()).to_pylist()):
            words = words_of(text)
            if len(words) >= WINDOW:
                h = Grams(words).of(PREFIX)
                p = chosen(h)
                row.append(np.full(len(p), i))
                at.append(p)
                anchor.append(h[p])
        if not row:
            continue
        rows = pa.array(np.concatenate(row))
        yield pa.RecordBatch.from_arrays(
            [*(b[c].take(rows) for c in ("doc_id", *KEY)), pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(anchor).view(np.int64))],
            ["doc_id", *KEY, "at", "anchor"],
        )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each marked prefix of a text the words around it that its windows can reach."""
    names = ["g", "doc_id", *KEY, "at", "left", "body"]
    for b in batches:
        doc_id, k1, k2 = (b[c].to_pylist() for c in ("doc_id", *KEY))
        out: list[tuple] = []
        for i, (text, marks) in enumerate(zip(b["text"].cast(pa.binary()).to_pylist(), b["marks"].to_pylist())):
            words = words_of(text)
            for at, g in {(m["at"], m["g"]) for m in marks}:
                lo, hi = max(0, at - PLACES + 1), min(len(words), at + WINDOW)
                out.append((g, doc_id[i], k1[i], k2[i], at, at - lo, b" ".join(words[lo:hi])))
            if len(out) >= 5000 or (out and i == b.num_rows - 1):
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.int32()), pa.array(c[5], pa.int32()), pa.array(c[6], pa.binary()).cast(pa.string())], names)
                out = []


class SuffixTree:
    """Sorted rows of word ids and the depth at which each parts from the one before it."""

    def __init__(self, rows: np.ndarray):
        self.order = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))
        ordered = rows[self.order]
        apart = ordered[1:] != ordered[:-1]
        self.depth = np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1])

    def nodes(self, depth: int) -> np.ndarray:
        """For each row the node whose subtree it is in when the tree is cut at ``depth``."""
        out = np.zeros(len(self.order), dtype=np.int64)
        out[self.order[1:]] = np.cumsum(self.depth < depth)
        return out


def repeats(bodies: list[bytes], left: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the least and greatest offset of its windows that a smaller document has, or -1."""
    n, ids = len(bodies), {}
    right_of = -1 - np.arange(n)[:, None].repeat(WINDOW, axis=1)  # words that are not there equal none
    left_of = -1 - np.arange(n)[:, None].repeat(PLACES - 1, axis=1)
    for i, body in enumerate(bodies):
        w = np.array([ids.setdefault(x, len(ids)) for x in body.split(b" ")])
        k = left[i]
        right_of[i, : len(w) - k] = w[k:]
        left_of[i, :k] = w[:k][::-1]
    right, before = SuffixTree(right_of), SuffixTree(left_of)
    first, last = np.full(n, -1), np.full(n, -1)
    for o in range(PLACES):
        node = right.nodes(WINDOW - o) * n + before.nodes(o)
        order = np.lexsort((docs, node))
        start = np.concatenate([[True], node[order][1:] != node[order][:-1]])
        least = docs[order][start][np.cumsum(start) - 1]
        hit = order[least < docs[order]]
        first[hit] = np.where(first[hit] < 0, o, first[hit])
        last[hit] = o
    return first, last


def _tree(rows: pa.Table) -> pa.Table:
    left, docs, at = (rows[c].to_numpy() for c in ("left", "doc_id", "at"))
    first, last = repeats(rows["body"].cast(pa.binary()).to_pylist(), left, docs)
    hit = np.flatnonzero(first >= 0)
    keys = [rows[c].take(pa.array(hit)) for c in KEY]
    # All these windows hold the prefix, so together they cover one unbroken span.
    return pa.table([*keys, pa.array(at[hit] - last[hit], pa.int32()), pa.array(at[hit] - first[hit] + WINDOW, pa.int32())], names=[*KEY, "start", "stop"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each whole window around a prefix, by a digest of its words."""
    for b in batches:
        cols = [b[c].to_pylist() for c in ("doc_id", *KEY, "at", "left")]
        out: list[tuple] = []
        for i, body in enumerate(b["body"].cast(pa.binary()).to_pylist()):
            doc_id, k1, k2, at, left = (c[i] for c in cols)
            words = body.split(b" ")
            for s in range(len(words) - WINDOW + 1):
                out.append((blake2b(b" ".join(words[s : s + WINDOW]), digest_size=16).digest(), doc_id, k1, k2, at - left + s))
            if len(out) >= 20_000 or (out and i == b.num_rows - 1):
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), *(pa.array(x, pa.int64()) for x in c[1:4]), pa.array(c[4], pa.int32())], ["digest", "doc_id", *KEY, "start"])
                out = []


def _looked_up(rows: DataFrame, key: str, known: DataFrame, total: int) -> DataFrame:
    """``rows`` with what ``known`` has of their key; ``n`` in it is the number of the key's rows, of at most ``total``.

    Keys of over ``total / SHARES`` rows, SHARES at most, are broadcast; no other key's rows are more than that.
    """
    names = [c for c in known.columns if c not in (key, "n")]
    heavy = known.where(F.col("n") > total / SHARES).select(key, *[F.col(c).alias(f"heavy_{c}") for c in names], F.lit(True).alias("heavy"))
    light = known.where(F.col("n") <= total / SHARES).select(F.col(key).alias("at_key"), *names, F.lit(True).alias("light"))
    out = rows.join(F.broadcast(heavy), key, "left")
    spread = F.xxhash64(*KEY, *[c for c in rows.columns if c in ("at", "start")])  # rows that are done go anywhere
    spread = F.when(F.col("heavy"), spread.cast(rows.schema[key].dataType) if key == "anchor" else F.unhex(F.hex(spread))).otherwise(F.col(key))
    out = out.withColumn("at_key", spread).join(light.hint("merge"), "at_key", "left").where("heavy OR light")
    return out.select(*rows.columns, *[F.coalesce(f"heavy_{c}", F.when(F.col("heavy").isNull(), F.col(c))).alias(c) for c in names])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``k1, k2, start, stop``: spans of words that repeated windows cover; ``docs`` is keyed.

    Documents without an id neither repeat nor are repeated: no id is smaller or greater than null.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    anchors = saved(known.mapInArrow(sliced(_anchors), "doc_id long, k1 long, k2 long, at int, anchor long"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    # Prefixes are packed into groups by running sums of their suffixes, in slices of the hash range.
    shared = saved(shared.where("lo < hi").select("anchor", "n"))
    slices = partitions_for(shared.agg(F.sum("n")).first()[0] or 0, 50 * GROUP)
    within = Window.partitionBy("slice").orderBy("anchor")
    before = F.sum(F.when(F.col("n") <= HOT, F.col("n")).otherwise(0)).over(within)
    packed = shared.withColumn("slice", F.pmod(F.xxhash64("anchor"), F.lit(slices))).withColumn("g", F.shiftleft("slice", 32) + F.floor(before / GROUP))
    size = shared.agg(F.sum(F.when(F.col("n") <= HOT, F.col("n"))), F.sum(F.when(F.col("n") > HOT, F.col("n")))).first()
    contexts = "g long, doc_id long, k1 long, k2 long, at int, left int, body string"

    def around(which: DataFrame) -> DataFrame:
        found = _looked_up(anchors, "anchor", which.select("anchor", "g", "n"), sum(x or 0 for x in size))
        marks = found.groupBy(*KEY).agg(F.collect_list(F.struct("at", "g")).alias("marks"))
        return docs.join(marks.hint("merge"), KEY).select("doc_id", *KEY, "text", "marks").mapInArrow(sliced(_contexts), contexts)

    cold = around(packed.where(F.col("n") <= HOT)).groupBy("g").applyInArrow(_tree, "k1 long, k2 long, start int, stop int")
    if not size[1]:
        return cold
    whole = around(packed.where(F.col("n") > HOT)).mapInArrow(sliced(_windows), "digest binary, doc_id long, k1 long, k2 long, start int").distinct()
    least = whole.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    hot = _looked_up(whole, "digest", least, PLACES * size[1]).where("least < doc_id").select(*KEY, "start", (F.col("start") + WINDOW).cast("int").alias("stop"))
    return cold.unionByName(hot)


def _kept(text: bytes | None, spans: list | None) -> tuple[list[bytes], int]:
    words = words_of(text)
    if not spans:
        return words, len(words)
    keep = np.ones(len(words), dtype=bool)
    for s in spans:
        keep[s["start"] : s["stop"]] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()], len(words)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without its repeats (unchanged if it has none) and the counts and digest of what is left."""
    for b in batches:
        texts, total, gone, digest = [], [], [], []
        for text, spans in zip(b["text"].cast(pa.binary()).to_pylist(), b["spans"].to_pylist()):
            kept, n = _kept(text, spans)
            joined = b" ".join(kept)
            texts.append(joined if len(kept) < n else text)
            total.append(n)
            gone.append(n - len(kept))
            digest.append(sha256(joined).hexdigest())
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], ["row", "kept_text", "n_words", "n_removed", "kept_sha256"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [(n, n - len(kept), sha256(b" ".join(kept)).hexdigest()) for kept, n in map(_kept, b["text"].cast(pa.binary()).to_pylist(), b["spans"].to_pylist())]
        c = list(zip(*got)) or [()] * 3
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    each = spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return docs.join(each.hint("merge"), KEY, "left")


def removed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs`` (``doc_id, text``).

    Other columns are ignored. Null, empty and blank texts have no words; texts of fewer than
    WINDOW words lose none. Rows of one id are not repeats of each other; repeated rows are kept,
    each with the result of its text.
    """
    keyed = _keyed(docs)
    full = _with_spans(keyed, repeated_spans(keyed)).select("doc_id", *KEY, "text", "spans")
    return full.select("doc_id", "text", "spans").mapInArrow(sliced(_digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with repeats cut out of ``text``: what is left is joined by one space.

    Texts without repeats stay as they are. A document that loses all of its words is left out.
    """
    columns = list(docs.columns)
    keyed = _keyed(docs)
    spans = saved(repeated_spans(keyed))
    rest = [c for c in columns if c != "text"]
    own = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), *row_key(F.col("doc_id"), F.col("text")))
    full = _with_spans(own, spans).select("row", "text", "spans")
    kind = full.schema["row"].dataType.simpleString()
    out = full.mapInArrow(sliced(_edit), f"row {kind}, kept_text string, n_words long, n_removed long, kept_sha256 string")
    out = out.where("n_removed = 0 OR n_removed < n_words")
    return out.select(*[F.col("kept_text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in columns])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, r, i, array_to_string(w[i:i + 49], ' ') AS span
  FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT span, min(doc_id) AS least FROM win GROUP BY span HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (span) WHERE least.least < win.doc_id)),
lost AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [x FOR x, i IN w IF NOT list_contains(ps, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (r)
"""
