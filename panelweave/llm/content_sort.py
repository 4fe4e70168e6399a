"""Exact duplicates by content sort, in DataFrame functions only.

Splitters are drawn from a bounded sample of the rows and cut the order of all rows into ranges of
about equal bytes. Each range is sorted whole (Spark's external sort spills where it must), so equal
texts come to lie next to each other, and each row is compared with its neighbours byte for byte. The
order ends with the id, so that a splitter can also fall within a group of copies: a group of any
size is spread over as many ranges as it needs, and its parts are put together from one row each.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.llm.common import saved, table

#: Bytes of texts that a range aims at, and the number of ranges beyond which they grow instead.
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 15
#: Sampled rows for each range. The sample only sets where ranges end, never what is found.
SAMPLED = 20
#: Leading bytes by which ranges are told apart; a hash of the whole text and the id break ties.
LEAD = 48
#: Bytes that a row counts beside those of its text.
ROW_BYTES = 64


def _place(body: Column, id: Column) -> Column:
    """Where a row lies in the order that the splitters cut."""
    return F.struct(F.substring(body.cast("binary"), 1, LEAD).alias("lead"), F.xxhash64(body).alias("whole"), id.alias("id"))


def splitters(rows: DataFrame, body: Column, id: Column, range_bytes: int = RANGE_BYTES, sampled: int = SAMPLED) -> list:
    """Places that cut ``rows`` into ranges of about ``range_bytes``, ascending, from a sample of at most about ``sampled`` rows a range.

    There are at least twice as many ranges as shuffle partitions, where there are rows enough.
    """
    least = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = F.octet_length(body) + ROW_BYTES
    total = rows.agg(F.count("*").alias("n"), F.sum(weight).alias("bytes")).first()
    if not total["n"]:
        return []
    ranges = min(MOST_RANGES, max(least, -(-total["bytes"] // range_bytes)))
    share = sampled * ranges / total["n"]
    some = rows.sample(fraction=share, seed=7) if share < 1 else rows
    drawn = some.select(_place(body, id).alias("p"), weight.alias("w")).orderBy("p").collect()
    out, step, sum_, due = [], sum(r["w"] for r in drawn) / ranges, 0, 1
    for r in drawn:
        if sum_ >= due * step and (not out or r["p"] != out[-1]):
            out.append(r["p"])
            due = int(sum_ // step) + 1
        sum_ += r["w"]
    return out


def ranged(rows: DataFrame, body: Callable[[], Column], id: Column, **how) -> DataFrame:
    """``rows`` plus ``range`` int and ``cut`` (a splitter has this very text, so that its group may lie in several ranges), dealt by range."""
    cuts = splitters(rows, body(), id, **how)
    kind = rows.select(_place(body(), id).alias("p")).schema["p"].dataType.simpleString()
    text = json.dumps([{"lead": base64.b64encode(bytes(c["lead"])).decode(), "whole": c["whole"], "id": c["id"]} for c in cuts], default=str)
    bounds = F.from_json(F.lit(text), f"array<{kind}>")
    steps = [1 << b for b in range(max(1, len(cuts).bit_length()) - 1, -1, -1)]

    def halve(s: Column, step: Column) -> Column:  # s.at: splitters known to lie at or before the row
        return F.struct(F.when(F.get(bounds, s["at"] + step - 1) <= s["key"], s["at"] + step).otherwise(s["at"]).alias("at"), s["key"].alias("key"))

    def same(s: Column, at: Column) -> Column:
        b = F.get(bounds, at)
        return F.coalesce((b["lead"] == s["key"]["lead"]) & (b["whole"] == s["key"]["whole"]), F.lit(False))

    found = F.aggregate(
        F.array(*map(F.lit, steps)), F.struct(F.lit(0).alias("at"), _place(body(), id).alias("key")), halve,
        lambda s: F.struct(s["at"].alias("range"), ((s["at"] > 0) & same(s, F.greatest(s["at"] - 1, F.lit(0))) | same(s, s["at"])).alias("cut")),
    )
    out = rows.withColumn("_found", found).withColumn("range", F.col("_found.range")).withColumn("cut", F.col("_found.cut")).drop("_found")
    # more tasks than a hash of few range numbers would fill evenly: about two ranges each
    return out.repartition(max(1, -(-(len(cuts) + 1) // 2)), "range")


def _neighbours(df: DataFrame, text: str, id: str, normalise: Callable[[Column], Column] | None, **how) -> DataFrame:
    """``row`` (all columns), ``id, body, range, cut, pos``, ``first`` and ``last`` of a run of equal bodies in its range."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))

    def body() -> Column:
        whole = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
        return normalise(whole) if normalise else whole

    at = Window.partitionBy("range").orderBy("body", F.col("id").asc_nulls_first())
    dealt = ranged(rows, body, F.col(f"row.`{id}`"), **how).withColumn("body", body()).withColumn("id", F.col(f"row.`{id}`"))
    return dealt.withColumns({
        "first": F.coalesce(F.col("body") != F.lag("body").over(at), F.lit(True)),
        "last": F.coalesce(F.col("body") != F.lead("body").over(at), F.lit(True)),
        "pos": F.row_number().over(at),
    })


def duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, **how) -> DataFrame:
    """For every row of ``df``: ``id, keep_id, group_size long, kept boolean, text_sha256``, dropped rows too.

    Texts are equal if their normalised bytes are; null counts as empty. Of each group the row of the
    ``smallest`` or ``largest`` id stays; a null id is smaller than any other, and of rows that repeat id and
    text exactly one stays. An empty table gives no rows. Only ``text`` and ``id`` are read. A group is
    never gathered in one task: a range holds a bounded part of it, and its parts meet as one row each.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    best = F.max if keep == "largest" else F.min
    seen = _neighbours(df.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "text", "doc_id", normalise, **how)
    narrow = seen.select("id", "range", "pos", "first", F.when(F.col("first"), F.sha2("body", 256)).alias("sha"), F.when(F.col("first") & F.col("cut"), F.col("body")).alias("edge"))
    run = F.sum(F.col("first").cast("long")).over(Window.partitionBy("range").orderBy("pos"))
    rows = saved(narrow.withColumn("run", run))
    # Runs of a range; the few that a splitter may have cut meet those of the same text in other ranges.
    runs = rows.groupBy("range", "run").agg(best(F.struct("id", "range", "pos")).alias("stays"), F.count("*").alias("n"), F.max("sha").alias("sha"), F.max("edge").alias("edge"))
    w = Window.partitionBy("edge")
    parts = runs.where(F.col("edge").isNotNull()).withColumn("stays", best("stays").over(w)).withColumn("n", F.sum("n").over(w))
    groups = runs.where(F.col("edge").isNull()).unionByName(parts).select("range", "run", "stays", "n", "sha")
    same = (F.col("range") == F.col("stays.range")) & (F.col("pos") == F.col("stays.pos"))
    out = rows.drop("sha", "edge").join(groups, ["range", "run"])
    return out.select(F.col("id").alias(id), F.col("stays.id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), same.alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicated(df: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, **how) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; rules as in ``duplicates``. Texts move once."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    seen = _neighbours(df, text, id, normalise, **how).where("last" if keep == "largest" else "first").select("row", "body", "range", "cut")
    seen = saved(seen.withColumn("body", F.when(F.col("cut"), F.col("body"))))  # the survivors of each range
    # A group's parts lie in ascending ranges, as ids break ties: the last, or first, has the row that stays.
    end = F.col("range").desc() if keep == "largest" else F.col("range")
    parts = seen.where("cut").withColumn("nth", F.row_number().over(Window.partitionBy("body").orderBy(end))).where("nth = 1")
    return seen.where("NOT cut").select("row.*").unionByName(parts.select("row.*"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are identical ones; the row of the largest doc_id stays."""
    return duplicates(table(spark, sf_dir, "documents"), keep="largest")


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
