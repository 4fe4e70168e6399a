"""Byte-level BPE encoding by overlapping chunks, and decoding.

Short texts are encoded where they lie. Long texts are cut into chunks that overlap by
``OVERLAP`` characters and are dealt over all tasks. Every chunk is pre-tokenised on its own; in
an overlap, the first boundary that both neighbours found is where they resynchronise, because
the pattern never looks back: from a common boundary on, both find the same pre-tokens. The
pieces between these cuts are encoded independently and put together in order. Where no boundary
is common, the rest of the text stays one piece, so the result is exact for any text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.llm.common import sliced, table, text_key

CHUNK, OVERLAP = 32_768, 512
#: Characters after a match that can still change it: a contraction is three characters long.
LOOKAHEAD = 2
KEY = ["doc_id", "tkey"]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _scanner():
    import regex

    return regex.compile(pattern())


def safe_boundaries(text: str, start: int, whole: bool) -> list[int]:
    """Ends of pre-tokens, as offsets in the text that ``text`` is cut from at ``start``.

    Left out are ends that characters beyond the cut could move, and ends after white space: a
    piece that ends there would let white space at its end match differently.
    """
    limit = len(text) if whole else len(text) - LOOKAHEAD
    return [start + e for m in _scanner().finditer(text) if (e := m.end()) <= limit and not text[e - 1].isspace()]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc_id, tkey, text in zip(b["doc_id"], b["tkey"], b["text"]):
            t = text.as_py()
            for at in range(0, len(t), CHUNK):
                part = t[at : at + CHUNK + OVERLAP]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id.as_py()], pa.int64()), "tkey": pa.array([tkey.as_py()], pa.int64()), "start": pa.array([at], pa.int64()), "whole": pa.array([at + CHUNK + OVERLAP >= len(t)]), "text": pa.array([part], pa.string())})


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        heads, tails = [], []
        for at, whole, text in zip(b["start"].to_pylist(), b["whole"].to_pylist(), b["text"].to_pylist()):
            found = safe_boundaries(text, at, whole)
            heads.append([x for x in found if x < at + OVERLAP])
            tails.append([x for x in found if x >= at + CHUNK])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["tkey"], b["start"], pa.array(heads, kind), pa.array(tails, kind)], ["doc_id", "tkey", "start", "head", "tail"])


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for b in batches:
            ids = [np.array(encode(t or ""), dtype="<u4").tobytes() for t in b["text"].to_pylist()]
            at = b.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(ids, pa.binary())], [*(n for i, n in enumerate(b.schema.names) if i != at), "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(path).decode_bytes
        for b in batches:
            raw = [decode(np.frombuffer(x, dtype="<u4").tolist()) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], [*b.schema.names, "decoded"])

    return run


def _encode_long(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, tkey, ids`` of each different (doc_id, text) of ``docs``."""
    chunks = docs.mapInArrow(sliced(_cut), "doc_id long, tkey long, start long, whole boolean, text string")
    chunks = chunks.dropDuplicates([*KEY, "start"])  # deals them over the tasks, and repeated rows go
    found = chunks.mapInArrow(sliced(_scan), "doc_id long, tkey long, start long, head array<long>, tail array<long>")
    w = Window.partitionBy(*KEY).orderBy("start")
    met = F.array_min(F.array_intersect("head", F.lag("tail").over(w)))
    marks = (
        found.withColumn("met", F.when(F.col("start") == 0, F.lit(0).cast("long")).otherwise(met)).drop("head", "tail")
        .withColumn("sound", F.min(F.col("met").isNotNull()).over(w))  # all cuts so far were found
        .withColumn("begin", F.when(F.col("sound"), F.col("met")).otherwise(F.col("start")))
        .withColumn("stop", F.lead("begin").over(w))
        .withColumn("piece", F.max(F.when(F.col("sound"), F.col("met"))).over(w))
        .select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"), F.col("start").alias("s"), "begin", "stop", "piece", "sound")
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t")) & (F.col("start") == F.col("s"))
    cuts = chunks.join(marks, same).select(
        *KEY, "piece", "begin",
        F.when(F.col("stop").isNull(), F.expr("substring(text, int(begin - start + 1))")).otherwise(F.expr("substring(text, int(begin - start + 1), int(stop - begin))")).alias("text"),
    )
    # A piece is one cut, or, where the neighbours found no common boundary, the rest of the text.
    pieces = cuts.groupBy(*KEY, "piece").agg(F.array_sort(F.collect_list(F.struct("begin", "text"))).alias("cuts"))
    pieces = pieces.select(*KEY, "piece", F.array_join(F.col("cuts.text"), "").alias("text"))
    coded = pieces.mapInArrow(sliced(_encode(path)), "doc_id long, tkey long, piece long, ids binary")
    parts = coded.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("piece", F.hex("ids").alias("ids")))).alias("parts"))
    return parts.select(*KEY, F.unhex(F.array_join(F.col("parts.ids"), "")).alias("ids"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs`` (``doc_id long, text string``); other columns are ignored.

    ``ids`` holds little-endian unsigned 32-bit ids of the whole text, encoded by the rank file at
    ``path`` without special tokens. Null and empty texts have no ids. Repeated rows are kept, null
    ids of documents too; an empty table gives none. Only texts of over ``CHUNK`` characters move.
    """
    path = path or default_ranks()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text") > CHUNK, F.lit(False))
    short = docs.where(~is_long).mapInArrow(sliced(_encode(path)), "doc_id long, ids binary")
    keyed = docs.where(is_long).withColumn("tkey", text_key(F.col("text")))
    coded = _encode_long(keyed, path).select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"), "ids")
    rows = keyed.select(*KEY).join(coded, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t"))).select("doc_id", "ids")
    return short.unionByName(rows)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``coded`` (``doc_id, ids``) plus ``decoded`` binary: the bytes of the ids, concatenated."""
    return coded.select("doc_id", "ids").mapInArrow(sliced(_decode(path or default_ranks())), "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame) -> DataFrame:
    both = decode(encode(docs))
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
