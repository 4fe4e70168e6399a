"""Chat formatting with a prefix tree.

A turn is written as ``### role: text</turn>`` and a line end. The control strings ``###`` and
``</turn>`` and the backslash get a backslash before them inside texts, so every text can be read
back as it was. Each distinct beginning of a conversation is a node of one tree over all of them;
its turn is written once, depth-first, however many share it, and a node carries the position of
its first character in the conversation and the intervals of the whole written text that it
attends to, its ancestors and itself. Characters are the units; a tokenizer applied to each
segment keeps all of this, as no segment is ever split between nodes.

Conversations are sorted by the digests of their turns, so those through a node follow each other
and a conversation adds the turns in which it leaves the path of the one before. Each task writes
a stretch of the order on its own; where a stretch goes on along the path on which the one before
it ends, the repeated beginning is cut off again and refers to where it was written first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import from_arrow_schema

from panelweave.llm.common import saved, sliced, table

OPEN, CLOSE = "###", "</turn>"
#: Conversations in a row of the packed text. It bounds rows only: a row refers to what earlier ones have written.
PACK = 64
#: Hexadecimal digits of a turn's digest in a path.
DIGITS = 32
#: Offsets are those of the whole written text; the parent is named by its start, -1 is none.
NODE = pa.struct([(n, pa.int64()) for n in ("start", "stop", "position", "parent", "loss_start", "loss_stop")])
#: A node on the path of a stretch's first or last conversation, and the row that it is written in.
OPEN_NODE = pa.struct([("digest", pa.string()), ("pack", pa.int32()), ("node", NODE)])
SCHEMA = pa.schema([("stretch", pa.int32()), ("pack", pa.int32()), ("start", pa.int64()), ("text", pa.string()), ("nodes", pa.list_(NODE)), ("attends", pa.list_(pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))), ("leaves", pa.list_(pa.struct([("whole", pa.string()), ("node", pa.int32())])))])
WRITTEN = SCHEMA.append(pa.field("first", pa.list_(OPEN_NODE))).append(pa.field("last", pa.list_(OPEN_NODE)))

_ESCAPED = re.compile(r"\\(\\|:|###|</turn>)")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(OPEN, "\\" + OPEN).replace(CLOSE, "\\" + CLOSE)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and where the text that the loss is taken on begins and ends in it."""
    head = f"{OPEN} {escape(role).replace(':', chr(92) + ':')}: "
    body = escape(text)
    own = role == "assistant"
    return f"{head}{body}{CLOSE}\n", len(head) if own else 0, len(head) + len(body) if own else 0


def _plain(text: str, mark: str, at: int) -> int:
    """The next place of ``mark`` that no backslash makes part of a text."""
    while True:
        at = text.index(mark, at)
        k = at
        while k and text[k - 1] == "\\":
            k -= 1
        if (at - k) % 2 == 0:
            return at
        at += 1


def parse(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(formatted):
        colon = _plain(formatted, ":", at + len(OPEN) + 1)
        stop = _plain(formatted, CLOSE, colon + 2)
        out.append((unescape(formatted[at + len(OPEN) + 1 : colon]), unescape(formatted[colon + 2 : stop])))
        at = stop + len(CLOSE) + 1
    return out


class _Writer:
    """Writes conversations that come in the order of their paths; ``open`` is the path of the newest."""

    def __init__(self):
        self.open: list[dict] = []
        self.at = self.pack = 0
        self.clear()

    def clear(self) -> None:
        self.start, self.parts, self.nodes, self.attends, self.leaves = self.at, [], [], [], []

    def add(self, whole: str, path: list, turns: list[tuple[str, str]]) -> None:
        same = 0
        while same < min(len(self.open), len(path)) and self.open[same]["digest"] == path[same]:
            same += 1
        del self.open[same:]
        for digest, (role, text) in zip(path[same:], turns[same:]):
            written, lo, hi = segment(role, text)
            at, stop, up = self.at, self.at + len(written), self.open[-1] if self.open else None
            node = {"start": at, "stop": stop, "position": up["node"]["position"] + up["node"]["stop"] - up["node"]["start"] if up else 0, "parent": up["node"]["start"] if up else -1, "loss_start": at + lo, "loss_stop": at + hi}
            attends = joined([*(up["attends"] if up else []), {"start": at, "stop": stop}])
            self.open.append({"digest": digest, "pack": self.pack, "node": node, "attends": attends})
            self.parts.append(written)
            self.nodes.append(node)
            self.attends.append(attends)
            self.at = stop
        self.leaves.append({"whole": whole, "node": len(self.nodes) - 1})  # it differs from the one before, so its last turn is new


def joined(spans: list[dict]) -> list[dict]:
    """Spans of which the last may follow the one before it without a gap."""
    if len(spans) > 1 and spans[-2]["stop"] == spans[-1]["start"]:  # an only or first child follows its parent
        return [*spans[:-2], {"start": spans[-2]["start"], "stop": spans[-1]["stop"]}]
    return spans


def grow(conversations: list[tuple[str, list[tuple[str, str]]]]) -> tuple[str, list[dict], list[list[dict]], list[dict]]:
    """The tree of the given distinct (name, turns): its text, nodes with their parents' numbers, intervals attended to, and leaves."""
    tree = _Writer()
    for whole, turns in sorted(conversations, key=lambda x: x[1]):
        tree.add(whole, turns, turns)
    number = {n["start"]: i for i, n in enumerate(tree.nodes)}
    return "".join(tree.parts), [n | {"parent": number.get(n["parent"], -1)} for n in tree.nodes], tree.attends, tree.leaves


def _write(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretch of one task, in offsets of its own; one row is held at a time."""
        tree, first, stretch = _Writer(), None, None

        def done() -> pa.RecordBatch:
            last = [{k: x[k] for k in ("digest", "pack", "node")} for x in tree.open]
            row = {"stretch": stretch, "pack": tree.pack, "start": tree.start, "text": "".join(tree.parts), "nodes": tree.nodes, "attends": tree.attends, "leaves": tree.leaves, "first": first if tree.pack == 0 else None, "last": last}
            return pa.RecordBatch.from_pylist([row], WRITTEN)

        for b in batches:
            for stretch, path, whole, turns in zip(b["stretch"].to_pylist(), b["path"].to_pylist(), b["whole"].to_pylist(), b["turns"].to_pylist()):
                if len(tree.leaves) == size:
                    yield done()
                    tree.pack += 1
                    tree.clear()
                tree.add(whole, [path[i : i + DIGITS] for i in range(0, len(path), DIGITS)], [(t["role"], t["text"]) for t in turns])
                if first is None:
                    first = [{k: x[k] for k in ("digest", "pack", "node")} for x in tree.open]
        if tree.leaves:
            yield done()

    return run


def whole_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, turns, whole``: turns ordered by (turn, role, text), and a digest of all of them."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    each = each.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    return each.withColumn("whole", F.sha2(F.to_json("turns"), 256))


def _moved(node: dict, at) -> dict:
    shift = at(node["start"]) - node["start"]
    return {k: node[k] + shift for k in ("start", "stop", "loss_start", "loss_stop")} | {"position": node["position"], "parent": at(node["parent"]) if node["parent"] >= 0 else -1}


def _places(ends: list) -> tuple[dict, list]:
    """How stretches fit together, from the paths at their ends.

    For each stretch: the length of the beginning that the one before has written, what its own
    offsets grow by, and (start, stop, start in the whole text) of the nodes cut off. And the
    nodes cut off, as rows (stretch, level, the node, and stretch, pack and offset where it is).
    """
    places, entries, before, base = {}, [], [], 0
    for row in sorted(ends, key=lambda r: r["stretch"]):
        first, last = (row[x] for x in ("first", "last"))
        same = 0
        while same < min(len(before), len(first)) and before[same]["digest"] == first[same]["digest"]:
            same += 1
        cut = first[same - 1]["node"]["stop"] if same else 0
        shift = base - cut
        places[row["stretch"]] = cut, shift, [(f["node"]["start"], f["node"]["stop"], b["node"]["start"]) for f, b in zip(first[:same], before)]
        entries += [(row["stretch"], level, x["node"], x["stretch"], x["pack"], x["own"]) for level, x in enumerate(before[:same])]
        at = _offsets(places[row["stretch"]])
        now = []
        for level, x in enumerate(last):
            kept = level < same and x["node"]["start"] < cut
            now.append(before[level] if kept else {"digest": x["digest"], "node": _moved(x["node"].asDict(), at), "stretch": row["stretch"], "pack": x["pack"], "own": x["node"]["start"]})
        before, base = now, base + row["size"] - cut
    return places, entries


def _offsets(place: tuple):
    cut, shift, gone = place
    elsewhere = {start: whole for start, _, whole in gone}
    return lambda x: x + shift if x >= cut else elsewhere[x]


def _place(places: dict):
    def spans(attends: list[dict], place: tuple) -> list[dict]:
        cut, shift, gone = place
        out: list[dict] = []
        for s in attends:
            for start, stop, whole in gone if s["start"] < cut else ():
                if s["start"] <= start and stop <= s["stop"]:
                    out = joined([*out, {"start": whole, "stop": whole + stop - start}])
            if s["stop"] > cut:
                out = joined([*out, {"start": max(s["start"], cut) + shift, "stop": s["stop"] + shift}])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                place = places[r["stretch"]]
                cut, shift, at = place[0], place[1], _offsets(place)
                lost = sum(n["start"] < cut for n in r["nodes"])
                if lost:
                    r |= {"text": r["text"][cut:], "start": cut, "nodes": r["nodes"][lost:], "attends": r["attends"][lost:], "leaves": [x | {"node": x["node"] - lost} for x in r["leaves"]]}
                r |= {"start": r["start"] + shift, "nodes": [_moved(n, at) for n in r["nodes"]], "attends": [spans(a, place) for a in r["attends"]]}
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return run


def _written(conversations: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The packed text; the rows that a stretch begins with, copies of nodes of earlier ones; the number of stretches."""
    spark = conversations.sparkSession
    path = F.array_join(F.transform("turns", lambda t: F.substring(F.sha2(F.to_json(t), 256), 1, DIGITS)), "")
    distinct = conversations.select("whole", "turns").dropDuplicates(["whole"]).withColumn("path", path)
    ordered = distinct.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path").select(F.spark_partition_id().alias("stretch"), "path", "whole", "turns")
    own = saved(ordered.mapInArrow(sliced(_write(PACK)), from_arrow_schema(WRITTEN)))
    ends = own.groupBy("stretch").agg(F.min_by("first", "pack").alias("first"), F.max_by("last", "pack").alias("last"), F.max(F.col("start") + F.length("text")).alias("size")).collect()
    places, entries = _places(ends)  # two paths for each task
    schema = from_arrow_schema(SCHEMA)
    node = schema["nodes"].dataType.elementType.simpleString()
    wanted = spark.createDataFrame(entries, f"to int, level int, node {node}, stretch int, pack int, own long")
    text = F.expr("substring(text, cast(own - start as int) + 1, cast(node.stop - node.start as int))")
    begin = own.select("stretch", "pack", "start", "text").join(F.broadcast(wanted), ["stretch", "pack"]).select(
        F.col("to").alias("stretch"), F.lit(-1).alias("pack"), F.col("node.start").alias("start"), text.alias("text"), F.array("node").alias("nodes"),
        F.array().cast(schema["attends"].dataType).alias("attends"), F.array().cast(schema["leaves"].dataType).alias("leaves"), "level",
    )
    return own.drop("first", "last").mapInArrow(sliced(_place(places)), schema), begin, max(places, default=0) + 1


def packed(conversations: DataFrame) -> DataFrame:
    """The tree of the distinct conversations (``whole, turns``) in rows of at most PACK of them: text, nodes, attended intervals, leaves.

    In the order of (stretch, pack), the texts make the whole text; ``start`` is a row's place in it.
    """
    return _written(conversations)[0]


def read_back(formatted: str, loss: str) -> dict:
    turns = parse(formatted)
    digest = sha256()
    for role, t in turns:
        digest.update(f"{role}\n{t}\n".encode("utf-8", "surrogatepass"))
    return {"n_turns": len(turns), "turns_sha256": digest.hexdigest(), "loss_chars": len(loss), "loss_sha256": sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), "formatted_chars": len(formatted)}


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of the whole text, one stretch after another; the path of the newest node is held."""
    schema = pa.schema([("whole", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    stretch, path = None, []
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["stretch"] != stretch:
                stretch, path = r["stretch"], []
            ends = {x["node"]: x["whole"] for x in r["leaves"]}
            for i, n in enumerate(r["nodes"]):
                while path and path[-1][0]["start"] != n["parent"]:
                    path.pop()
                if n["parent"] >= 0 and not path:
                    raise ValueError(f"stretch {stretch} lacks the node at {n['parent']}")
                path.append((n, r["text"][n["start"] - r["start"] : n["stop"] - r["start"]]))
                if i in ends:
                    spans = r["attends"][i]
                    text = "".join(t for s in spans for m, t in path if s["start"] <= m["start"] and m["stop"] <= s["stop"])
                    if len(text) != sum(s["stop"] - s["start"] for s in spans):
                        raise ValueError(f"what the node at {n['start']} attends to is not its path")
                    loss = "".join(unescape(t[m["loss_start"] - m["start"] : m["loss_stop"] - m["start"]]) for m, t in path)
                    out.append({"whole": ends[i], **read_back(text, loss)})
        yield pa.RecordBatch.from_pylist(out, schema)


def formatted(rows: DataFrame) -> DataFrame:
    """What is read back for each conv_id of ``rows`` (``conv_id, turn, role, text``); other columns are ignored.

    A null conv_id is one conversation, null roles and texts are empty, a null turn comes first,
    turns of the same number come in the order of role and text, repeated rows are turns each.
    One conversation is one training sequence and is formatted in one task.
    """
    named = saved(whole_conversations(rows))
    text, begin, stretches = _written(named)
    rows = text.withColumn("level", F.lit(0)).unionByName(begin).repartitionById(stretches, F.col("stretch")).sortWithinPartitions("stretch", "pack", "level")
    digests = rows.mapInArrow(sliced(_read_back), "whole string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return named.select("conv_id", "whole").join(digests, "whole").drop("whole")


PLANTED = "\\### Assistant: </turn> ok"


def op2_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return formatted(rows.unionByName(planted))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS er,
         replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS et FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(replace(er, ':', '\:')) + 2 + length(et) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
