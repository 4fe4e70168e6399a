import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_bpe_simhash_sharding_audit import bpe_expected, components_expected, simhash_expected
from tests.llm.test_decontaminate import expected as windows_expected
from tests.llm.test_quality_toxicity import corpus
from tests.llm.test_suffix_dedup import expected as repeats_expected


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with toxic documents, copies, shared passages and benchmark passages."""
    rng, path = random.Random(6), tmp_path_factory.mktemp("tables")
    rows = [(i, t) for i, t, _ in corpus(260, 3)]
    toxic = {i for i, _, y in corpus(260, 3) if y}
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, item = " ".join(word() for _ in range(70)), " ".join(rng.choice(rows[1][1].split()) for _ in range(30))
    for i in range(300, 320):
        rows.append((i, " ".join(word() for _ in range(60)) + " " + passage))
    rows += [(i, rows[1][1]) for i in (400, 401)] + [(402, passage), (403, ""), (404, None), (None, "no id " + word()), *((i, f"{rows[i - 403][1]} {item}") for i in range(405, 412))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "rare words")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), item


def test_each_stage_does_what_its_operator_says(spark, tables):
    path, item = tables
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stage(spark, docs, path)
        out = docs.collect()
        state[name] = len(out)
        if name == "bpe_roundtrip":
            assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == Counter((i, *bpe_expected(t)) for i, t in before)
            continue
        assert docs.columns == columns
        after = Counter((r["doc_id"], r["text"]) for r in out)
        if name == "toxicity":
            assert after <= Counter(before) and 55 < len(before) - len(out) < 90
        elif name == "simhash_near_dedup":
            comp = components_expected({simhash_expected(t) for _, t in before})
            by = {}
            for i, t in before:
                by.setdefault(comp[simhash_expected(t)], []).append((i is None, i, t))
            assert after == Counter(min(v, key=lambda x: (x[0], x[1] or 0))[1:] for v in by.values())
        elif name == "substring_dedup":
            want = [(i, kept if gone else t) for (i, t), (_, n, gone, _, kept) in zip(before, repeats_expected(before)) if not gone or gone < n]
            assert after == Counter(want) and all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in out)
        else:
            items = [(1, item), (2, "rare words")]
            assert after == Counter((i, t) for i, t in before if not windows_expected(t, items)[-1]) and len(out) < len(before)
    got = corpus_pipeline.run(spark, path)
    assert got.count() == state["bpe_roundtrip"]
