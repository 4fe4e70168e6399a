"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is 13 consecutive words. From each window the minimum of the hashes of its K-word grams
is kept: equal windows keep equal hashes, so a passage of 13 words or more that a document shares
with a benchmark item cannot go unseen. The hashes a document keeps are joined with those of the
benchmark; only documents with a common hash are read again, where each place of such a hash is
extended to its window and compared word for word with the benchmark windows of the same hash. Items of fewer than 13 words are looked up
by the hash of their first words at every position of a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.llm.common import saved, table, text_key

WINDOW, K = 13, 6
MIN_PART, MIN_OF_WORDS = 20, 1  # contaminated: 20 * n_hit >= n_words
#: Gram sizes that hashes exist of; an item of n words is looked up by the largest that fits.
SIZES = (1, 2, 3, 6)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes up to which a side is broadcast, as counted from its rows.
BROADCAST_BYTES, ROW_BYTES = 4 << 20, 64
KEY = ["doc_id", "tkey"]


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; null has none."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(F.coalesce(lower, F.lit("")), F.lit(WORD), F.lit(0))


def _shifted(a: Column, b: Column, by: int, f) -> Column:
    """f(a[i], b[i + by]) for each i that has both."""
    n = F.greatest(F.size(b) - by, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, by + 1, n), f)


def _with_hashes(df: DataFrame) -> DataFrame:
    """Adds g1, g2, g3, g6 (hashes of grams at each position) and ``low`` (minimum of each window) to ``words``.

    Longer grams are put together from shorter ones, and the minimum over a window's grams from
    minima over half as many.
    """
    pair, least = lambda a, b: F.xxhash64(a, b), lambda a, b: F.least(a, b)
    df = df.withColumn("g1", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("g2", _shifted(F.col("g1"), F.col("g1"), 1, pair))
    df = df.withColumn("g3", _shifted(F.col("g2"), F.col("g1"), 2, pair))
    df = df.withColumn("g6", _shifted(F.col("g3"), F.col("g3"), 3, pair))
    low = F.col("g6")
    df = df.withColumn("m2", _shifted(low, low, 1, least))
    df = df.withColumn("m4", _shifted(F.col("m2"), F.col("m2"), 2, least))
    return df.withColumn("low", _shifted(F.col("m4"), F.col("m4"), 4, least)).drop("m2", "m4")


def _span(start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice("words", start + 1, n), " ")


def _places(hashes: Column, n: int) -> Column:
    """For each hash its position, and ``n``."""
    return F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"), F.lit(n).alias("n")))


def items(benchmark: DataFrame) -> DataFrame:
    """Windows of the benchmark: ``hash, span, n_span, item_id``, each different row once."""
    b = _with_hashes(benchmark.select("item_id", words(F.col("text")).alias("words"))).where(F.size("words") > 0)
    full = b.where(F.size("words") >= WINDOW).select("item_id", "words", F.posexplode("low").alias("at", "hash"))
    full = full.select("hash", _span(F.col("at"), WINDOW).alias("span"), F.lit(WINDOW).alias("n_span"), "item_id")
    short = b.where(F.size("words") < WINDOW)
    first = reduce(lambda c, k: c.when(F.size("words") >= k, F.element_at(f"g{k}", 1)), SIZES[-2::-1], F.when(F.size("words") >= SIZES[-1], F.element_at(f"g{SIZES[-1]}", 1)))
    short = short.select(first.alias("hash"), _span(F.lit(0), WINDOW).alias("span"), F.size("words").alias("n_span"), "item_id")
    return full.unionByName(short).distinct()


def _small(df: DataFrame, size: int) -> DataFrame:
    """``df`` with a broadcast hint where its counted bytes allow it; else Spark shuffles both sides."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, tkey, n_words, n_hit, item_ids`` of each different (doc_id, text) of ``docs``.

    ``item_ids`` is the array of items with windows in the text, sorted as strings, each once.
    """
    windows = saved(items(benchmark))
    size = windows.agg(F.sum(F.octet_length("span") + F.octet_length(F.col("item_id").cast("string")) + ROW_BYTES)).first()[0] or 0  # words have no bound of length
    lengths = {r["n_span"] for r in windows.select("n_span").distinct().collect()}  # 13 values at most
    looked_up = sorted({max(k for k in SIZES if k <= n) for n in lengths if n < WINDOW})
    hashes = _small(windows.select("hash").distinct(), size)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tkey", text_key(F.col("text")))
    worded = text.select(*KEY, words(F.col("text")).alias("words"))
    known = _with_hashes(worded).select(*KEY, F.size("words").alias("n_words"), F.array_distinct(F.concat(F.col("low"), *[F.col(f"g{k}") for k in looked_up])).alias("kept"))
    marked = known.select(*KEY, "n_words", F.explode_outer("kept").alias("hash")).join(hashes.withColumn("found", F.lit(1)), "hash", "left")
    counted = saved(marked.groupBy(*KEY, "n_words").agg(F.max("found").alias("found")))

    again = counted.where("found = 1").select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"))
    near = worded.join(_small(again, ROW_BYTES * again.count()), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t")), "left_semi")
    near = near.dropDuplicates(KEY)
    # Places where a window of the benchmark may start, by hash: for long windows and for each short length.
    places = _places(F.col("low"), WINDOW)
    for n in sorted(x for x in lengths if x < WINDOW):
        k = max(k for k in SIZES if k <= n)
        places = F.concat(places, _places(F.slice(f"g{k}", 1, F.greatest(F.size("words") - n + 1, F.lit(0))), n))
    seen = _with_hashes(near).select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"), F.explode(places).alias("p")).select("d", "t", "p.*").join(hashes, "hash")
    seen = seen.groupBy("d", "t").agg(F.collect_list(F.struct("hash", "at", "n")).alias("places"))
    # Each is extended to its whole window and compared with those of the benchmark word for word.
    spread = near.join(seen, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t")))
    whole = F.transform("places", lambda p: F.struct(p["hash"].alias("hash"), p["at"].alias("at"), p["n"].alias("n"), _span(p["at"], p["n"]).alias("span")))
    at = spread.select(*KEY, F.explode(whole).alias("s")).select(*KEY, "s.*")
    hit = at.join(_small(windows, size), ["hash", "span"]).select(*KEY, "at", "n", "item_id")
    hit = saved(hit)

    own = hit.select(*KEY, "item_id").distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    w = Window.partitionBy(*KEY).orderBy("at")
    reach = hit.select(*KEY, "at", F.col("at") + F.col("n")).toDF(*KEY, "at", "stop").groupBy(*KEY, "at").agg(F.max("stop").alias("stop"))
    before = F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = reach.withColumn("new", F.greatest(F.col("stop") - F.greatest("at", before), F.lit(0))).groupBy(*KEY).agg(F.sum("new").alias("n_hit"))
    found = own.join(covered, [own.doc_id.eqNullSafe(covered.doc_id), own.tkey == covered.tkey]).select(own.doc_id.alias("d"), own.tkey.alias("t"), "n_hit", "item_ids")
    each = counted.select(*KEY, "n_words").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t")), "left")
    return each.select(*KEY, F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (MIN_PART * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, plus ``n_words, n_hit, item_ids, contaminated``.

    Reads ``doc_id, text`` of docs and ``item_id, text`` of benchmark. Null and empty texts have no
    words and are clean; items without words have no windows; items of the same id count once; an
    item with a null id marks words but is not listed. Repeated rows of docs are all kept, each with
    the result of its own text. Columns of docs named like the added ones are replaced.
    """
    added = ["n_words", "n_hit", "item_ids", "contaminated"]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("row"), text_key(F.col("text")).alias("k"), F.col("doc_id").cast("long").alias("i"))
    found = overlaps(docs, benchmark)
    out = own.join(found, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("tkey"))).withColumn("contaminated", is_contaminated())
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *added)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    bad = overlaps(docs, benchmark).where(is_contaminated()).select(F.col("doc_id").alias("bad_id"), F.col("tkey").alias("bad_key"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), text_key(F.col("text")).alias("own_key"))
    kept = own.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_key") == F.col("bad_key")), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), text_key(F.col("text")).alias("k"))
    found = overlaps(docs, table(spark, sf_dir, "benchmark"))
    out = rows.join(found, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("tkey")))
    return out.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, hash(text, text IS NULL) AS k,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS span
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dk AS (SELECT DISTINCT doc_id, k, w FROM d),
dw AS (
  SELECT doc_id, k, n, i, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM (SELECT doc_id, k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dk, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, k, item_id, i, n FROM dw JOIN bw USING (n, span)),
pos AS (SELECT doc_id, k, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, k, unnest(range(i, i + n)) AS p FROM h) GROUP BY ALL),
its AS (SELECT doc_id, k, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, k, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY ALL)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id IS NOT DISTINCT FROM pos.doc_id AND d.k = pos.k
       LEFT JOIN its ON d.doc_id IS NOT DISTINCT FROM its.doc_id AND d.k = its.k
"""
