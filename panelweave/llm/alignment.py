"""Alignment of two tokenizers' tokens over the same bytes, in Arrow.

A batch of texts is encoded by both. Their id lists are flattened, with the index of each token's
text; segmented cumulative sums of the tokens' byte lengths give the end of every token in its text.
A full join of both sides on (text, end) yields the ends of either: where both have one, a group of
tokens ends; and between two ends that follow each other lies just one pair of tokens that overlap,
a link. How often the corpus links a pair of ids is counted by ``group_by`` within blocks of texts
and summed by Spark; each block gets back the counts of its own pairs and adds them up per text.
What a block keeps of its texts meanwhile is packed: for each text its different pairs, as sorted
numbers of the block's table, and how often.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import saved, sliced, table

#: Bytes of text and rows that a block gathers, and bytes that one Arrow step aligns at a time; a longer text is a step of its own.
BLOCK_BYTES, BLOCK_ROWS, STEP_BYTES = 24 << 20, 1 << 16, 2 << 20
#: A pair of ids is one number: a * B_IDS + b.
B_IDS = 1 << 15
#: The join key is one number: the text's index times this, plus the token's end.
SPAN = 1 << 40
#: Ids as decimal text, taken by id.
DECIMALS = 1 << 16


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others for 256, 257, ... in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _byte_level(path: str):
    """Encoder and each id's bytes of a byte-level BPE file; ids are ranks, which gives what the file's own library gives."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters = byte_letters()
    entries = {bytes(letters[c] for c in word): i for word, i in vocabulary.items() if all(c in letters for c in word)}
    special = {i for i in vocabulary.values()} - set(entries.values())
    for word, i in vocabulary.items():
        if word.startswith("<|") and word.endswith("|>"):  # a special token, which no text is encoded to
            special.add(i)
    ranks = {b: i for b, i in entries.items() if i not in special}
    raw = [b""] * (max(vocabulary.values()) + 1)
    for b, i in entries.items():
        raw[i] = b
    coder = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return coder.encode_ordinary, pa.array(raw, pa.binary())


@lru_cache(maxsize=1)
def _pieces(path: str):
    """Encoder and each id's bytes of a piece model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    return (lambda texts: model.encode(texts, num_threads=1)), pa.array(raw, pa.binary())


@lru_cache(maxsize=1)
def _decimals() -> pa.Array:
    return pa.array([str(i) for i in range(DECIMALS)], pa.string())


def _ends(ids: pa.ListArray, lengths: pa.Array) -> pa.Array:
    """Key of each token's end: its text's index and its end in that text, by a segmented cumulative sum."""
    flat, parent = ids.flatten(), pc.list_parent_indices(ids)
    sums = pc.cumulative_sum(pc.take(lengths, flat))
    before = np.concatenate([[0], sums.to_numpy()])[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]  # what lies before each text
    inside = pc.subtract(sums, pc.take(pa.array(before, pa.int64()), parent))
    return pc.add(pc.multiply(pc.cast(parent, pa.int64()), SPAN), inside)


def _lists(values: pa.Array, stops: np.ndarray) -> pa.ListArray:
    """``values`` cut before each of ``stops``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), values)


def _joined_ids(ids: pa.Array, stops: np.ndarray) -> pa.Array:
    return pc.binary_join(_lists(pc.take(_decimals(), ids), stops), ",")


def align(texts: list[str | None], a_path: str, b_path: str) -> tuple[pa.Table, pa.Table]:
    """Texts and links of a batch.

    The first table has a row for each text, in order: ``n_a, n_b, n_groups, n_links`` and ``groups``, its groups written as
    ``a1,a2|b1;a3|b2,b3``; zeros and an empty string for a text that is null, empty, or whose tokens of either side do not join to
    a space and the text. The second has a row for each link: ``text`` (index), ``pair``.
    """
    encode_a, raw_a = _byte_level(a_path)
    encode_b, raw_b = _pieces(b_path)
    texts = [t or "" for t in texts]
    spaced = [f" {t}" for t in texts]
    a = pa.array([encode_a(s) if t else [] for s, t in zip(spaced, texts)], pa.list_(pa.int32()))
    b = pa.array(encode_b(texts) if texts else [], pa.list_(pa.int32()))
    want = pa.array([s.encode() for s in spaced], pa.binary())
    whole = [pc.equal(pc.binary_join(_lists(pc.take(raw, x.flatten()), x.offsets.to_numpy()[1:]), b""), want) for x, raw in ((a, raw_a), (b, raw_b))]
    sound = pc.and_(pc.and_(*whole), pa.array([bool(t) for t in texts], pa.bool_()))
    at = np.flatnonzero(sound.to_numpy(zero_copy_only=False))  # texts that have tokens
    a, b = a.filter(sound), b.filter(sound)
    ids_a, ids_b = a.flatten(), b.flatten()
    ends = [pa.table({"end": _ends(x, pc.cast(pc.binary_length(raw), pa.int64())), name: pa.array(np.arange(len(flat)), pa.int64())}) for x, raw, name, flat in ((a, raw_a, "a", ids_a), (b, raw_b, "b", ids_b))]
    met = ends[0].join(ends[1], keys="end", join_type="full outer", use_threads=False).sort_by("end").combine_chunks()
    end, of_a, of_b = (met[n].combine_chunks() if isinstance(met[n], pa.ChunkedArray) else met[n] for n in ("end", "a", "b"))
    text = end.to_numpy() // SPAN
    cut = pc.and_(of_a.is_valid(), of_b.is_valid()).to_numpy(zero_copy_only=False)
    # the last end of a text is one of both sides, so filling backward never leaves it
    link_a, link_b = (pc.take(ids, pc.fill_null_backward(x)) for ids, x in ((ids_a, of_a), (ids_b, of_b)))
    links = pa.table({"text": pa.array(at[text], pa.int64()), "pair": pc.add(pc.multiply(link_a, B_IDS), link_b)})
    # groups as text, then the texts' groups
    stops_a, stops_b = (x.filter(pa.array(cut)).to_numpy() + 1 for x in (of_a, of_b))
    group = pc.binary_join_element_wise(_joined_ids(ids_a, stops_a), _joined_ids(ids_b, stops_b), "|")
    n_groups = np.bincount(text[cut], minlength=len(at))
    written = pc.binary_join(_lists(group, np.cumsum(n_groups)), ";")
    n = len(texts)

    def spread(values: np.ndarray) -> pa.Array:
        out = np.zeros(n, dtype=np.int64)
        out[at] = values
        return pa.array(out)

    place = np.full(n, -1)
    place[at] = np.arange(len(at))
    written = pc.fill_null(pc.take(written, pa.array(place, mask=place < 0)), "")
    counts = [spread(v) for v in (np.diff(a.offsets.to_numpy()), np.diff(b.offsets.to_numpy()), n_groups, np.bincount(text, minlength=len(at)))]
    return pa.table([*counts, written], names=["n_a", "n_b", "n_groups", "n_links", "groups"]), links


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts, as many at a time as make ``STEP_BYTES``."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t or "")
            if size >= STEP_BYTES or len(ids) >= BLOCK_ROWS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _pack(x: np.ndarray) -> bytes:
    """Small numbers, compressed byte plane by byte plane."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


_TEXTS = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}
_BLOCK = "block long, texts array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>, pairs array<int>, counts array<long>, widths binary, steps binary, times binary"


def _block(number: int, texts: list[pa.Table], uses: list[pa.Table]) -> pa.RecordBatch:
    """One row: the block's texts, its pairs with their counts, and what pairs each text has (numbers in ``pairs``, as steps from one to the next)."""
    rows, used = pa.concat_tables(texts), pa.concat_tables(uses)
    total = used.group_by("pair", use_threads=False).aggregate([("count_all", "sum")])
    most_first = np.argsort(-total["count_all_sum"].to_numpy(), kind="stable")  # frequent pairs get small numbers, which pack well
    pairs, counts = total["pair"].to_numpy()[most_first], total["count_all_sum"].to_numpy()[most_first]
    code = pc.index_in(used["pair"], value_set=pa.array(pairs)).to_numpy().astype(np.int64)
    text, times = used["text"].to_numpy(), used["count_all"].to_numpy()
    order = np.argsort((text << 32) | code, kind="stable")
    text, code, times = text[order], code[order], times[order]
    steps = np.diff(code, prepend=0)
    fresh = np.diff(text, prepend=-1) != 0
    steps[fresh] = code[fresh]
    one = lambda x, kind: pa.array([x], kind)
    structs = pa.StructArray.from_arrays([rows[n].combine_chunks() for n in _TEXTS], names=list(_TEXTS))
    return pa.RecordBatch.from_arrays(
        [one(number, pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs), one(pairs, pa.list_(pa.int32())), one(counts, pa.list_(pa.int64())),
         one(_pack(np.bincount(text, minlength=len(rows))), pa.binary()), one(_pack(steps), pa.binary()), one(_pack(times), pa.binary())],
        ["block", "texts", "pairs", "counts", "widths", "steps", "times"],
    )


def _blocks(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        texts, uses, size, rows = [], [], 0, 0
        for ids, step in _steps(batches):
            each, links = align(step, a_path, b_path)
            digests = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in each["groups"].to_pylist()], pa.string())
            texts.append(pa.table([pa.array(ids, pa.int64()), *(each[n] for n in ("n_a", "n_b", "n_groups", "n_links")), digests], names=list(_TEXTS)))
            part = links.group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")])
            uses.append(part.set_column(part.schema.get_field_index("text"), "text", pc.add(part["text"], rows)))
            size, rows = size + sum(map(len, filter(None, step))), rows + len(ids)
            if size >= BLOCK_BYTES or rows >= BLOCK_ROWS:
                yield _block(number, texts, uses)
                number, texts, uses, size, rows = number + 1, [], [], 0, 0
        if rows:
            yield _block(number, texts, uses)

    return run


def _totals(block: pa.Table, known: pa.Table) -> pa.Table:
    """Rows of a block's texts with the sums over their links of the corpus' counts (``known``: number in the block, count, best)."""
    if not len(block):
        return pa.table({n: pa.array([], t) for n, t in [*_TEXTS.items(), ("n_best", pa.int64()), ("count_sum", pa.int64())]})
    texts = block["texts"].combine_chunks().flatten()
    number = known["number"].to_numpy()
    counts, best = np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=bool)
    counts[number], best[number] = known["count"].to_numpy(), known["best"].to_numpy()
    widths, steps, times = (_unpack(block[n][0].as_py()).astype(np.int64) for n in ("widths", "steps", "times"))
    at = np.concatenate([[0], np.cumsum(widths)])
    sums = np.cumsum(steps)
    code = sums - np.repeat(np.concatenate([[0], sums])[at[:-1]], widths)  # segmented cumulative sums again
    over = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[at])
    made = {"n_best": over(times * best[code]), "count_sum": over(times * counts[code])} if len(code) else {"n_best": np.zeros(len(widths), np.int64), "count_sum": np.zeros(len(widths), np.int64)}
    return pa.table([*(pc.struct_field(texts, n) for n in _TEXTS), *map(pa.array, made.values())], names=[*_TEXTS, *made])


def blocks(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A row for each block of texts of ``docs`` (``doc_id, text``), see ``_block``; written, so that all that read it read the same."""
    own_a, own_b = default_paths()
    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sliced(_blocks(a_path or own_a, b_path or own_b)), _BLOCK))


def pair_counts(made: DataFrame) -> DataFrame:
    """``pair, count, best`` of the corpus: links of the pair of ids, and whether no other pair of its B id has more."""
    pairs = made.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n")).groupBy("pair").agg(F.sum("n").alias("count"))
    pairs = saved(pairs)
    most = pairs.groupBy((F.col("pair") % B_IDS).alias("b")).agg(F.max("count").alias("most"))  # a row for each id of the vocabulary at most
    return pairs.join(F.broadcast(most), F.col("pair") % B_IDS == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def totals(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """For every row of ``docs`` (``doc_id long, text string``; others are ignored): ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Texts that are null, empty or not spelt alike by both tokenizers have zeros and an empty digest. Repeated rows and null
    ids are kept, each with its own text's result; an empty table gives none. A text is aligned in one task.
    """
    made = blocks(docs, a_path, b_path)
    numbered = made.select(F.col("block").alias("of"), F.posexplode("pairs").alias("number", "pair"))
    back = numbered.join(pair_counts(made), "pair").select("of", "number", "count", "best")
    held = made.select("block", "texts", "widths", "steps", "times")
    out = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in [*_TEXTS, "n_best", "count_sum"])
    return held.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_totals, out)


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``doc_id, n_links, groups`` of every row: the groups themselves, written as ``a1,a2|b1;a3|b2,b3``."""
    own_a, own_b = default_paths()
    paths = (a_path or own_a, b_path or own_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, step in _steps(batches):
            each = align(step, *paths)[0]
            yield from pa.table([pa.array(ids, pa.int64()), each["n_links"], each["groups"]], names=["doc_id", "n_links", "groups"]).to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sliced(run), "doc_id long, n_links long, groups string")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = totals(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
