"""The registered queries themselves, on a small folder of tables with nulls, ties, repeats and extra columns."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelweave.llm import sharding, toxicity
from panelweave.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_bpe_simhash_sharding_audit import bpe_expected, components_expected, simhash_expected
from tests.llm.test_decontaminate import expected as windows_expected
from tests.llm.test_lm_chat import chat_expected, scores_expected
from tests.llm.test_quality_toxicity import base_expected, corpus
from tests.llm.test_suffix_dedup import expected as repeats_expected
from tests.test_queries import rows as plain_rows

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short item"), (3, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(8), tmp_path_factory.mktemp("ops")
    rows = corpus(120, 5)
    toxic = {i for i, _, y in rows if y}
    docs = [(i, t) for i, t, _ in rows]
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(200 + i, f"{docs[i][1]} {passage} {docs[i + 1][1]}") for i in range(6)] + [(300, ITEMS[0][1]), (301, "a short item"), (302, ""), (303, None), (None, "no id"), (5, docs[5][1]), (304, docs[7][1]), (305, docs[7][1].upper())]
    docs.append((400, " ".join(rng.choice(docs[k][1].split()) for k in range(100)) + " x" * 40_000))
    spark.createDataFrame([(i, t, "en", None, len(t or ""), 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, shard int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1 if i % 3 else 0, int(i in toxic)) for i in range(120)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    chats = [(c, k, "user" if k % 2 == 0 else "assistant", None if c % 9 == 0 else "same start" if k == 0 else f"turn {c % 5} {k} ### </turn>") for c in range(60) for k in range(c % 4 + 1)]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(i, f"http://x/{i}" if i % 7 else None, f"<p>{i % 20}</p>" * (i % 5)) for i in range(400)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path), docs, chats


def found(spark, folder, name, *columns):
    return Counter(tuple(r[c] for c in columns) for r in QUERIES[name](spark, folder[0]).collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder[0]}/{t}.parquet/*.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    df = QUERIES[name](spark, folder[0])
    assert plain_rows(df.columns, [tuple(r) for r in df.collect()]) == plain_rows([d[0] for d in cur.description], cur.fetchall())


def test_op2(spark, folder):
    _, _, chats = folder
    want = chat_expected([*chats, (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")])
    assert found(spark, folder, "op2_chat_tree", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars") == want


def test_op3_and_op4(spark, folder):
    docs = folder[1]
    assert found(spark, folder, "op3_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(x[:4] for x in repeats_expected(docs))
    small = [(i, t) for i, t in docs if i != 400]
    want = Counter((i, n, hit, len(ids), bad) for i, t in small for n, hit, ids, bad in [windows_expected(t, ITEMS)])
    got = found(spark, folder, "op4_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "contaminated")
    assert sum(got.values()) == len(docs) and Counter({k: v for k, v in got.items() if k[0] != 400}) == want


def test_op5(spark, folder):
    assert found(spark, folder, "op5_bpe_roundtrip", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == Counter((i, *bpe_expected(t)) for i, t in folder[1])


def test_op6(spark, folder):
    docs = folder[1]
    got = Counter((r["doc_id"], r["n_words"], round(r["log_score"], 4)) for r in QUERIES["op6_stupid_backoff"](spark, folder[0]).collect())
    assert got == Counter((i, n, round(s, 4)) for (i, _), (n, s) in zip(docs, scores_expected([t for _, t in docs])))


def test_op7(spark, folder):
    docs = folder[1]
    comp, least = components_expected({simhash_expected(t) for _, t in docs}), {}
    for i, t in docs:
        c = comp[simhash_expected(t)]
        least[c] = min((x for x in (i, least.get(c)) if x is not None), default=None)
    want = Counter((i, f"{simhash_expected(t):016x}", least[comp[simhash_expected(t)]]) for i, t in docs)
    assert found(spark, folder, "op7_simhash_components", "doc_id", "fingerprint", "component_id") == want


def test_op8_scores_are_those_of_the_model(spark, folder):
    path, docs, _ = folder
    model = toxicity.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    logit = lambda w: sum(float(model.buckets[b]) for b in toxicity.subwords(w)) / len(toxicity.subwords(w))

    def score(text):
        words = re.findall(r"\w+", (text or "").lower())
        z = model.bias + (sum(map(logit, words)) / len(words) if words else 0.0)
        return 1 / (1 + math.exp(-z))

    got = QUERIES["op8_toxicity"](spark, path).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    want = Counter((i, fold(i), round(score(t), 4), int(score(t) >= 0.5)) for i, t in docs)
    assert Counter((r["doc_id"], r["held_out"], round(r["score"], 4), r["predicted"]) for r in got) == want


def test_op9(spark, folder):
    got = QUERIES["op9_quality_ratio"](spark, folder[0]).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((i, *base_expected(t)) for i, t in folder[1])
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got) and any(r["kept"] for r in got)


def test_op10_is_the_plain_shuffle(spark, folder):
    path, docs, _ = folder
    own = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", sharding.text_size(F.col("text")).alias("size"), sharding.text_crc32(F.col("text")).alias("crc"))
    seed = 17
    placed = own.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()).withColumns({"first": F.xxhash64(F.lit(seed), "at"), "second": F.xxhash64(F.lit(seed + 1), "at")}).collect()
    by_part = {}
    for r in placed:
        by_part.setdefault(r["part"], []).append(r)
    total = len(placed)
    sizes = [total // 8 + (s < total % 8) for s in range(8)]
    matrix = sharding.communication_matrix([len(by_part[p]) for p in sorted(by_part)], sizes, seed)
    shards = [[] for _ in range(8)]
    for p, counts in zip(sorted(by_part), matrix.tolist()):
        rows = iter(sorted(by_part[p], key=lambda r: (r["first"], r["at"])))  # each part is shuffled, then dealt out
        for s, n in enumerate(counts):
            shards[s] += [next(rows) for _ in range(n)]
    want = Counter()
    for s, rows in enumerate(shards):
        want.update((r["doc_id"], r["size"], r["crc"], "rows", s, k, None) for k, r in enumerate(sorted(rows, key=lambda r: (r["second"], r["at"]))))
    assert found(spark, folder, "op10_shard_rows", "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard") == want
