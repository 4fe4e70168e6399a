import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from panelweave.llm import quality, toxicity
from panelweave.llm.common import Grams, words_of

DOCS = "doc_id long, text string, score double, n_words int, quality int"
LABELS = "doc_id long, quality int, toxic int, text string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0.1, 3, 1) for i, t in rows], DOCS)


def test_gram_hashes_depend_on_the_words_only():
    a, b = Grams(words_of(b"x  a b\tc d e")), Grams(words_of(b"a b c"))
    assert a.of(3)[1] == b.of(3)[0] and len(b.of(4)) == 0 and len(set(a.of(2).tolist())) == 5
    assert a.text(1, 4) == b"a b c"


def base_expected(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_equals_brute_force(spark):
    rng = random.Random(2)
    vocab = ["a", "é", "漢字", "#x", "<b>", "word", " ", " y", "🙂", "|"]
    texts = [None, "", " \n\t", "\x0b\x0c", "same\nsame\n \n \nsame", "q " * 40, "a b c d e f g h " * 3, "a b c d e f g h a b c d e f g h i"]
    texts += ["".join(rng.choice(vocab) + rng.choice([" ", "\n", "  ", "\r\n"]) for _ in range(rng.randint(1, 300))) for _ in range(30)]
    texts.append("long " + "tail piece " * 30_000)
    rows = list(enumerate(texts)) + [(None, "null id " * 30), (3, texts[3]), (3, texts[9])]
    labels = spark.createDataFrame([(i, i % 2, 0, "") for i in range(20)] + [(None, 1, 0, ""), (9, 1, 0, ""), (11, None, 0, "")], LABELS)
    d = docs(spark, rows)
    got = quality.quality(d, labels).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    key = lambda r: (r["doc_id"], *(r[n] for n in names))
    assert Counter(map(key, got)) == Counter((i, *base_expected(t)) for i, t in rows)

    good = {i for i in range(20) if i % 2} | {9}
    grams = {i: quality.buckets_of(Grams(w)) if (w := words_of((t or "").encode())) else np.zeros(0, int) for i, (_, t) in enumerate(rows)}
    size = quality.BUCKETS
    raw = sum(np.bincount(g, minlength=size) for g in grams.values())
    target = sum(np.bincount(grams[i], minlength=size) for i, (d_id, _) in enumerate(rows) if d_id in good)
    p = (raw + 1) / (raw.sum() + size)
    ratio = np.log((target + size * p) / (target.sum() + size)) - np.log(p)
    want = Counter((d_id, round(float(ratio[grams[i]].mean()) if len(grams[i]) else 0.0, 9)) for i, (d_id, _) in enumerate(rows))
    assert Counter((r["doc_id"], round(r["llr"], 9)) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    got = quality.quality(docs(spark, [(1, "w%d " % 1 + " ".join(f"v{i}" for i in range(30)))]), none).first()
    assert got["llr"] == 0.0 and got["kept"]
    assert quality.quality(docs(spark, []), none).count() == 0


def corpus(n, seed):
    rng = random.Random(seed)
    plain = [a + b for a in ("ba", "de", "fi", "go", "lu", "ma") for b in ("ran", "sel", "tip", "von", "wex")]
    rude = ["grumblat", "snorfing", "wobblerot"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(30, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3 + len(words) // 25):
                words[rng.randrange(len(words))] = rng.choice(rude)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_learns_and_reads_misspellings(spark):
    rows = corpus(500, 1)
    d, labels = docs(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, 1, y, "") for i, _, y in rows] + [(None, 1, 1, ""), (7, 1, None, ""), (9, 1, 5, "")], LABELS)
    model = toxicity.fit(d, labels)
    truth = {i: y for i, _, y in rows}
    held = [r for r in toxicity.score(d, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 60 and sum((r["score"] >= 0.5) == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    odd = docs(spark, [(1, "baran desel fitip govon luwex grumbblat snorfingg " * 5), (2, "baran desel fitip govon luwex maran basel " * 5), (3, None), (4, ""), (5, "..."), (None, "baran")])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] == got[5] and all(0 <= s <= 1 for s in got.values()) and len(got) == 6


def test_toxicity_filter_keeps_all_columns(spark):
    rows = corpus(300, 2)
    d, labels = docs(spark, [(i, t) for i, t, _ in rows] + [(None, None), (3, rows[3][1])]), spark.createDataFrame([(i, 1, y, "") for i, _, y in rows], LABELS)
    kept = toxicity.accepted(d, labels)
    assert kept.columns == d.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[None] == 1 and ids[3] == 2 and sum(truth == 0 for i, _, truth in rows if i in ids) > 210 and sum(y for i, _, y in rows if i in ids) < 5


def test_toxicity_without_labels(spark):
    d = docs(spark, [(1, "a"), (2, None)])
    model = toxicity.fit(d, spark.createDataFrame([], LABELS))
    assert [r["score"] < 0.5 for r in toxicity.score(d, model).collect()] == [True, True]
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", toxicity.fold(F.col("id")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
