"""Merkle fixity audit of archive replicas.

Records are laid end to end in archive files; a record's digest covers its header and payload.
A leaf covers a fixed range of offsets of one file, a node covers ``FANOUT`` neighbours one level
below, and above a file's root the files themselves are grouped, so that one root stands for a
whole replica. Two replicas are compared from the roots down: children are read only below nodes
that differ, and record digests only in leaves that differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.llm.common import saved, table

FANOUT = 16
LEAF_BYTES = 1 << 16
RECORDS_PER_FILE = 4096
KEYS = ["page_id", "url", "html"]


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a record: a header, an empty line, the payload, two line ends.

    A null field is written as a dash in the header and an empty payload; the header says so, so
    null and empty differ.
    """
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: "), F.coalesce(page_id.cast("string"), F.lit("-")),
        F.lit("\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("-")),
        F.lit("\r\nX-Null: "), F.concat(url.isNull().cast("string"), F.lit(","), html.isNull().cast("string")),
        F.lit("\r\nContent-Length: "), F.coalesce(F.octet_length(html), F.lit(0)).cast("string"),
        F.lit("\r\n\r\n"), F.coalesce(html, F.lit("")), F.lit("\r\n\r\n"),
    )


def manifest(pages: DataFrame, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Where each record lies: ``file long, offset long, page_id, length long, copies long, digest``.

    Identical records share one entry with ``copies``; they lie next to each other. Files are
    dealt by record digest, so that no id, host or page can overfill one.
    """
    body = record_text(*[F.col(c) for c in KEYS])
    records = saved(
        pages.select("page_id", F.octet_length(body).cast("long").alias("length"), F.sha2(body, 256).alias("digest"))
        .groupBy("page_id", "length", "digest")
        .agg(F.count("*").alias("copies"))
    )
    files = max(1, -(-records.count() // records_per_file))
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    return (
        records.withColumn("file", F.pmod(F.xxhash64("digest"), F.lit(files)))
        .withColumn("end", F.sum(F.col("length") * F.col("copies")).over(order))
        .select("file", (F.col("end") - F.col("length") * F.col("copies")).alias("offset"), "page_id", "length", "copies", "digest")
    )


@dataclass
class Tree:
    """``records``: (file, offset, digest, ...); ``levels``: node digests, leaves first, root last."""

    records: DataFrame
    levels: list[DataFrame]


def shape(layout: DataFrame) -> tuple[int, int]:
    """Levels within a file and above the files; both replicas must be built to the same shape."""
    top = layout.agg(F.max(F.col("offset")).alias("o"), F.max("file").alias("f")).first()
    deep = lambda n: 0 if n <= 0 else 1 + deep(n // FANOUT)
    return deep((top["o"] or 0) // LEAF_BYTES), deep(top["f"] or 0)


def _digest_of(parts: Column) -> Column:
    ordered = F.array_sort(F.collect_list(parts))
    return F.sha2(F.array_join(F.transform(ordered, lambda p: F.concat(p["at"].cast("string"), F.lit(":"), p["digest"])), "\n"), 256)


def build(records: DataFrame, inner: int, outer: int) -> Tree:
    """The tree over ``records`` (file, offset, digest, ...).

    Every group has a bound: a leaf holds the records that start in its range (a record has a
    header of over 100 bytes), a node at most FANOUT children.
    """
    leaf = (
        records.groupBy("file", F.floor(F.col("offset") / LEAF_BYTES).alias("node"))
        .agg(_digest_of(F.struct(F.col("offset").alias("at"), F.concat_ws("x", "digest", "copies").alias("digest"))).alias("digest"))
    )
    levels = [saved(leaf)]
    for k in range(inner + outer):
        # below a file's root the nodes of one file are grouped, above it the files
        key = [F.col("file"), F.floor(F.col("node") / FANOUT).alias("node")] if k < inner else [F.floor(F.col("file") / FANOUT).alias("file"), F.lit(0).cast("long").alias("node")]
        at = F.col("node") if k < inner else F.col("file")
        below = levels[-1].withColumn("at", at)
        levels.append(saved(below.groupBy(*key).agg(_digest_of(F.struct("at", "digest")).alias("digest"))))
    return Tree(records, levels)


def _differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    a, b = left.select(*keys, F.col("digest").alias("a")), right.select(*keys, F.col("digest").alias("b"))
    return a.join(b, keys, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


def audit(left: Tree, right: Tree, inner: int, outer: int) -> DataFrame:
    """Records in which the replicas differ, found by descending differing branches only.

    Returns ``file, offset, page_id, status`` with status ``changed``, ``missing`` (not in the
    right replica) or ``extra`` (only there). Equal replicas give no row and read the roots only.
    """
    keys = ["file", "node"]
    bad = _differing(left.levels[-1], right.levels[-1], keys)
    for k in range(inner + outer - 1, -1, -1):
        parent = [F.col("file"), F.floor(F.col("node") / FANOUT).alias("node")] if k < inner else [F.floor(F.col("file") / FANOUT).alias("file"), F.lit(0).cast("long").alias("node")]
        up = [c.alias(n) for c, n in zip(parent, ("pf", "pn"))]
        hit = bad.select(F.col("file").alias("pf"), F.col("node").alias("pn"))
        below = [t.levels[k].select("file", "node", "digest", *up).join(hit, ["pf", "pn"], "left_semi") for t in (left, right)]
        bad = saved(_differing(*below, keys))
    leaf = F.floor(F.col("offset") / LEAF_BYTES).alias("node")
    a, b = (t.records.withColumn("node", leaf).join(bad, keys, "left_semi") for t in (left, right))
    a = a.select("file", "offset", "page_id", F.concat_ws("x", "digest", "copies").alias("a"))
    b = b.select("file", "offset", F.col("page_id").alias("other_id"), F.concat_ws("x", "digest", "copies").alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return (
        a.join(b, ["file", "offset"], "full_outer")
        .where(~F.col("a").eqNullSafe(F.col("b")))
        .select("file", "offset", F.coalesce("page_id", "other_id").alias("page_id"), status.alias("status"))
    )


def decayed(pages: DataFrame) -> DataFrame:
    """A second replica derived from ``pages``: some payloads lose a byte's value, some records go.

    Of the records with an id, those of remainder 13 by 97 have their payload's first character
    replaced, those of remainder 17 by 211 are lost.
    """
    flipped = F.concat(F.when(F.col("html").startswith("#"), "*").otherwise("#"), F.substring("html", 2, 2_147_483_647))
    hit = (F.pmod("page_id", F.lit(97)) == 13) & (F.length("html") > 0)
    return pages.withColumn("stored", F.when(hit, flipped).otherwise(F.col("html"))).withColumn("lost", F.coalesce(F.pmod("page_id", F.lit(211)) == 17, F.lit(False)))


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of the given pages and of their decayed copy, both at the manifest's offsets."""
    body, copy = record_text(*[F.col(c) for c in KEYS]), record_text(F.col("page_id"), F.col("url"), F.col("stored"))
    sums = decayed(pages.select(*KEYS)).select("page_id", F.sha2(body, 256).alias("digest"), F.sha2(copy, 256).alias("found"), "lost")
    layout = saved(manifest(pages))
    other = (
        layout.join(sums.distinct().withColumnRenamed("page_id", "pid"), "digest")
        .where(F.col("page_id").eqNullSafe(F.col("pid")) & ~F.col("lost"))
        .select("file", "offset", "page_id", "length", "copies", F.col("found").alias("digest"))
    )
    return layout, saved(other)


def op1_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of ``pages`` whose decayed copy differs, with its id and what befell it."""
    ours, theirs = replicas(table(spark, sf_dir, "pages"))
    inner, outer = shape(ours)
    found = audit(build(ours, inner, outer), build(theirs, inner, outer), inner, outer)
    copies = ours.select("file", "offset", "copies", "length")
    return found.join(copies, ["file", "offset"], "left").select("page_id", "status", F.col("length").alias("record_bytes"), "copies")


OP1_SQL = """
SELECT page_id,
       CASE WHEN page_id % 211 = 17 THEN 'missing' ELSE 'changed' END AS status,
       CAST(strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: ')
          + strlen(CAST(page_id AS VARCHAR)) + 2 + strlen('WARC-Target-URI: ') + strlen(coalesce(url, '-')) + 2
          + strlen('X-Null: ') + CASE WHEN url IS NULL THEN 4 ELSE 5 END + 1 + CASE WHEN html IS NULL THEN 4 ELSE 5 END + 2
          + strlen('Content-Length: ') + strlen(CAST(coalesce(strlen(html), 0) AS VARCHAR)) + 4
          + coalesce(strlen(html), 0) + 4 AS BIGINT) AS record_bytes,
       count(*) AS copies
FROM pages
WHERE page_id % 211 = 17 OR (page_id % 97 = 13 AND length(html) > 0)
GROUP BY page_id, url, html
"""
