"""A dataset's manifest as a Merkle DAG: leaves are rows, every inner node is stored by its digest.

Each group's rows, in order, are the leaves of a tree of three children a node; the groups' roots,
in order, are the leaves of the tree on top. A record maps a node's digest to those of its children,
so equal subtrees are stored once. Proofs are made by descent: requests start at the root and follow
the digits of their rank, at every node the children that are not chosen are collected, and the path's
segments are reversed at the end. Requests that share the first digits descend as one, so that no
node is visited more than once and the root is no hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.llm.common import saved, table

FANOUT = 3
#: Levels built from one gathered block of at most FANOUT ** LEVELS neighbours.
LEVELS = 5
#: Levels that a descent goes down between two written tables.
WRITE_EVERY = 6
#: Index of a row within its partition, in Spark's increasing ids.
_INDEX_BITS = 33


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hexed(b: Column) -> Column:
    return F.lower(F.hex(b))


def field(value: Column) -> Column:
    """A dash for null, else the number of UTF-8 bytes, a colon and the value, so that no two rows read alike."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(F.concat(*map(field, values)))


def group_key(group: Column) -> Column:
    """Orders as the group's UTF-8 bytes with null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def depth(n: Column) -> Column:
    """Levels above ``n`` leaves: how often the number must be divided by three, rounding up, to reach one."""
    return sum((F.when(n > FANOUT**k, 1).otherwise(0) for k in range(1, 39)), F.when(n > 1, 1).otherwise(0))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (with ``g``) plus ``rank`` from 0 in the order given, ``n`` of the group, and ``depth``.

    Rows are sorted by sampled ranges of group and order, and a range's ranks start where those before it end,
    so no task holds a group. The table is written, so a rerun task reads the same places.
    """
    placed = saved(rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftrightunsigned("at", _INDEX_BITS)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)))
    held = placed.groupBy("g", "part").agg(F.min("at").alias("least"), F.count("*").alias("c"))
    w = Window.partitionBy("g")
    starts = held.select("g", "part", (F.sum("c").over(w.orderBy("part")) - F.col("c") - F.col("least")).alias("start"), F.sum("c").over(w).alias("n"))
    out = placed.join(starts, ["g", "part"]).withColumn("rank", F.col("at") + F.col("start")).drop("at", "part", "start")
    return out.withColumn("depth", depth(F.col("n")))


def _parents(level: Column) -> Column:
    """Digests of the next level: one for every three consecutive nodes."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int")), lambda i: F.slice(level, i * FANOUT + 1, FANOUT))
    return F.transform(runs, lambda run: digest(F.array_join(F.transform(run, hexed), "")))


def grow(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records ``digest, children`` of all trees over ``leaves`` (``g, rank, depth, digest``), and roots ``g, digest``."""
    spark = leaves.sparkSession
    nodes, records, roots = leaves.select("g", "rank", "depth", "digest"), [], []
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    for low in range(0, max(deepest, 1), LEVELS):
        block = nodes.groupBy("g", "depth", F.floor(F.col("rank") / FANOUT**LEVELS).alias("rank")).agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("b"))
        block = block.select("g", "depth", "rank", F.col("b.digest").alias("l0"))
        made = []
        for k in range(LEVELS):
            on = F.col("depth") > low + k
            block = block.withColumn(f"l{k + 1}", F.when(on, _parents(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
            children = lambda i, k=k: F.slice(F.col(f"l{k}"), i * FANOUT + 1, FANOUT)
            made.append(F.when(on, F.transform(F.col(f"l{k + 1}"), lambda d, i: F.struct(d.alias("digest"), children(i).alias("children")))).otherwise(F.array()))
        block = saved(block.select("g", "depth", "rank", F.get(f"l{LEVELS}", F.lit(0)).alias("digest"), F.concat(*made).alias("made")))
        records.append(block.select(F.inline("made")))
        roots.append(block.where(F.col("depth") <= low + LEVELS).select("g", "digest"))
        nodes = block.where(F.col("depth") > low + LEVELS).select("g", "rank", "depth", "digest")
    every = records[0]
    for r in records[1:]:
        every = every.unionByName(r)
    ends = roots[0]
    for r in roots[1:]:
        ends = ends.unionByName(r)
    return saved(every.dropDuplicates(["digest"])), saved(ends)


@dataclass
class Manifest:
    """``leaves``: g, rank, n, depth, digest and what was carried; ``records``: digest, children; ``groups``: g, rank, depth, digest of the top leaves, inner (depth of the group's tree)."""

    leaves: DataFrame
    records: DataFrame
    groups: DataFrame
    root: bytes | None


def build(leaves: DataFrame, order: list[str]) -> Manifest:
    """The manifest over ``leaves``: ``g`` (see ``group_key``), ``digest`` binary, columns to order by, and any others to carry.

    Leaves of a group ascend by ``order``, nulls first; ties by their digest, so repeated rows give one order. An empty table has no
    root (None). A lone leaf is its group's root, a lone group's root that of the whole.
    """
    rows = saved(ranked(leaves, [*[F.col(c).asc_nulls_first() for c in order], F.col("digest")]))
    inner, subroots = grow(rows)
    sizes = rows.groupBy("g").agg(F.max("depth").alias("inner"))
    top = ranked(subroots.join(sizes, "g").select(F.lit("").alias("g"), F.col("g").alias("name"), "digest", "inner"), [F.col("name")])
    top = saved(top)
    outer, root = grow(top)
    first = root.first()
    groups = top.select(F.col("name").alias("g"), "rank", "depth", "digest", "inner")
    return Manifest(rows, saved(inner.unionByName(outer).dropDuplicates(["digest"])), groups, bytes(first["digest"]) if first else None)


def _down(front: DataFrame, records: DataFrame) -> DataFrame:
    """One level: every node of ``front`` gives way to its children, each with the others added to its path."""
    c = lambda k: F.coalesce(F.get("children", F.lit(k)), F.lit(b""))
    met = front.join(records, "digest").select(*front.drop("digest").columns, "children", F.posexplode("children").alias("digit", "digest"))
    others = F.concat(*[F.when(F.col("digit") != k, c(k)).otherwise(F.lit(b"")) for k in range(FANOUT)])
    step = F.array(F.struct(F.col("digit").cast("byte").alias("digit"), others.alias("others")))
    return met.withColumns({"pos": F.col("pos") * FANOUT + F.col("digit"), "path": F.concat("path", step)}).drop("children", "digit")


def _wanted(front: DataFrame, requests: DataFrame | None, left: int) -> DataFrame:
    """Nodes that have a requested leaf ``left`` levels below them."""
    if requests is None:
        return front
    return front.join(requests.select("g", F.floor(F.col("rank") / FANOUT**left).alias("pos")).distinct(), ["g", "pos"], "left_semi")


def proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``g, rank, subroot, path`` of the requested leaves (``g, rank``), or of all.

    ``path`` goes from the leaf up: at each level the digit of the node among its siblings and the digests of the others, joined
    from left to right. Unknown ranks give no row.
    """
    tall = m.groups.agg(F.max("depth").alias("top"), F.max("inner").alias("inner")).first()
    if m.root is None:
        return m.leaves.select("g", "rank", F.lit(None).cast("binary").alias("subroot"), F.array().cast("array<struct<digit:tinyint,others:binary>>").alias("path"))
    empty = F.array().cast("array<struct<digit:tinyint,others:binary>>")
    front = m.leaves.sparkSession.range(1).select(F.lit(m.root).alias("digest"), F.lit(0).cast("long").alias("pos"), empty.alias("path"))
    for k in range(tall["top"]):
        front = _down(front, m.records)
        front = saved(front) if k % WRITE_EVERY == WRITE_EVERY - 1 else front
    named = front.join(m.groups.select("g", F.col("rank").alias("pos"), "inner"), "pos")
    start = saved(named.select("g", "inner", F.col("digest").alias("subroot"), "digest", F.lit(0).cast("long").alias("pos"), "path"))
    front = None
    for left in range(tall["inner"], -1, -1):  # a group of fewer levels sets out later, so that all arrive together
        here = start.where(F.col("inner") == left).drop("inner")
        front = _wanted(here if front is None else _down(front, m.records).unionByName(here), requests, left)
        front = saved(front) if left and left % WRITE_EVERY == 0 else front
    return front.select("g", F.col("pos").alias("rank"), "subroot", F.reverse("path").alias("path"))


def proof_text(path: Column) -> Column:
    """The siblings of a proof as hex text, level by level from the leaf to the root, left to right."""
    return F.array_join(F.transform(path, lambda p: hexed(p["others"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root, as hex text, that ``leaf`` (binary) and the siblings of ``path`` give."""

    def up(node: Column, p: Column) -> Column:
        others, left = hexed(p["others"]), p["digit"].cast("int") * 64
        return F.sha2(F.concat(F.substring(others, F.lit(1), left), node, F.substring(others, left + 1, F.lit(64 * FANOUT))), 256)

    return F.aggregate(path, hexed(leaf), up)


def verified(m: Manifest, found: str = "found") -> DataFrame:
    """Every leaf of ``m``, with its proof and the root that its column ``found`` (a digest seen later) folds to."""
    each = m.leaves.join(proofs(m), ["g", "rank"])
    root = F.lit(m.root.hex() if m.root is not None else None)
    out = each.withColumns({"proof": proof_text(F.col("path")), "folded": folded(F.col(found), F.col("path")), "root": root})
    return out.withColumn("verified", F.col("folded").eqNullSafe(F.col("root"))).drop("path")


def tampered(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``stored``: the text without its line feeds where 2 divides the CRC-32 of the decimal doc_id; null ids are left alone."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return docs.withColumn("stored", F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def op13_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tampered(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text"))
    own = leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    found = leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "stored")])
    m = build(docs.select("doc_id", group_key(F.col("source")).alias("g"), own.alias("digest"), found.alias("found")), ["doc_id"])
    return verified(m).select(
        "doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), "root",
        F.sha2("proof", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified",
    )


def _tree_sql(name: str, leaves: str) -> str:
    """Levels of the trees over ``leaves`` (g, i, n, h), then each node with its siblings left (l) and right (r)."""
    return f"""
{name}_nodes AS (
  SELECT 0 AS lvl, g, i, n, h FROM {leaves}
  UNION ALL SELECT lvl + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name}_nodes WHERE n > 1 GROUP BY lvl, g, i // 3, n),
{name}_sides AS (
  SELECT lvl, g, i, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}_nodes WHERE n > 1 WINDOW w AS (PARTITION BY lvl, g, i // 3 ORDER BY i))"""


def _fold_sql(name: str, start: str) -> str:
    return f"""
{name}_fold AS (
  SELECT row, g, i, 0 AS lvl, proof, h FROM {start}
  UNION ALL SELECT row, f.g, f.i // 3, f.lvl + 1, proof || l || r, sha256(l || h || r)
  FROM {name}_fold f JOIN {name}_sides s ON f.g = s.g AND f.i = s.i AND f.lvl = s.lvl),
{name}_end AS (SELECT row, g, proof, h FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY lvl DESC) AS nth FROM {name}_fold) WHERE nth = 1)"""


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of a decimal number: each character, then eight shifts (-1).
_CRC_SQL = "xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, CAST(x AS BIGINT)) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295), 4294967295)"

OP13_SQL = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT *, CASE WHEN {_CRC_SQL} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS stored FROM documents),
leaves AS MATERIALIZED (
  SELECT doc_id, g, leaf, found, row_number() OVER () AS row, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, leaf AS h
  FROM (SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf_sql("text")} AS leaf, {_leaf_sql("stored")} AS found FROM docs)),
{_tree_sql("inner", "leaves")},
subs AS MATERIALIZED (SELECT g AS name, '' AS g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
{_tree_sql("top", "subs")},
start AS (SELECT row, g, i, '' AS proof, found AS h FROM leaves),
{_fold_sql("inner", "start")},
upper AS (SELECT row, '' AS g, subs.i, proof, inner_end.h FROM inner_end JOIN subs ON inner_end.g = subs.name),
{_fold_sql("top", "upper")}
SELECT doc_id, leaf, subs.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, top_end.h AS folded_root, top_end.h = root.h AS verified
FROM leaves JOIN top_end USING (row) JOIN subs ON leaves.g = subs.name JOIN (SELECT h FROM top_nodes WHERE n = 1) AS root ON true
"""
