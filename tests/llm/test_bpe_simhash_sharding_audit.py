import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelweave.llm import bpe, sharding, simhash, warc_audit

DOCS = "doc_id long, text string, ids string, text_key string, start int"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", None, 1) for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# byte-level BPE ---------------------------------------------------------------------------


def bpe_expected(text):
    ids = np.array(bpe._encoder(bpe.default_ranks()).encode_ordinary(text or ""), dtype="<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_equals_whole_encoding(spark, monkeypatch):
    rng = random.Random(3)
    bits = ["ab", " the", "'re", "'", "\n", "  ", "\n\n\n", "é", "漢字", " 12", "!?", "\t", "🙂", "'ll", "x"]
    texts = [None, "", " ", "a", "it's\n\n  we'll   " * 40]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 900))) for _ in range(12)]
    texts += ["z" * 70_000, "word " * 20_000, " \n" * 30_000 + "end", "".join(rng.choice(bits) for _ in range(60_000)), "y" * 40_000 + " ab" * 40_000]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)]
    rows += [(7, texts[7]), (7, "another text with the same id"), (len(texts) - 1, texts[-1]), (len(texts) - 1, texts[-2])]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs(spark, rows)).collect())
    assert got == Counter((i, *bpe_expected(t)) for i, t in rows)
    assert bpe.digests(empty(spark)).count() == 0


def test_bpe_boundaries_ignore_what_the_cut_can_change():
    text = "we're here  now\n\n x'll"
    full = {m.end() for m in bpe._scanner().finditer(text)}
    for cut in range(1, len(text)):
        assert set(bpe.safe_boundaries(text[:cut], 0, False)) <= full


# SimHash ----------------------------------------------------------------------------------


def simhash_expected(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_expected(fps):
    todo, out = set(fps), {}
    while todo:
        seen, edge = set(), [todo.pop()]
        while edge:
            x = edge.pop()
            seen.add(x)
            near = {y for y in todo if (x ^ y).bit_count() <= 3}
            todo -= near
            edge += near
        for x in seen:
            out[x] = min(seen)
    return out


def test_simhash_components(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 400))] for _ in range(40)]
    texts = [None, "", " \t\n", "One", "one", "A b", "a B c"]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.randint(0, 6)):
            c = list(b)
            c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    rows = list(enumerate(texts)) + [(None, texts[8]), (3, "One"), (None, "lonely words of their own here")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["fp"] % 2**64) for r in got) == Counter((i, simhash_expected(t)) for i, t in rows)
    comp, least = components_expected({simhash_expected(t) for _, t in rows}), {}
    for i, t in rows:
        c = comp[simhash_expected(t)]
        least[c] = min(x for x in (i, least.get(c)) if x is not None) if (i, least.get(c)) != (None, None) else None
    assert all(r["component_id"] == least[comp[r["fp"] % 2**64]] for r in got)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.representatives(docs(spark, rows)).collect()
    by = {}
    for i, t in rows:
        by.setdefault(comp[simhash_expected(t)], []).append((i is None, i or 0))
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == Counter(min(v) for v in by.values())


@pytest.mark.parametrize("n", [1, 2, 40, 700])
def test_gray_index_equals_brute_force(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, size=max(1, n // 7), dtype=np.uint64)
    fps = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        fps = fps ^ (rng.integers(0, 2, n).astype(np.uint64) << rng.integers(0, 64, n).astype(np.uint64))
    got, label = simhash.components_of(fps)
    want = components_expected({int(x) for x in fps})
    groups = {}
    for x, c in zip(got, label):
        groups.setdefault(int(c), set()).add(int(x))
    others = {}
    for x, c in want.items():
        others.setdefault(c, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, others.values()))


@pytest.mark.parametrize("n", [3, 5_000_000, 2_000_000_000])
def test_linked_fingerprints_meet_for_every_block_plan(spark, n):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, size=60, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)
    fps = np.unique(np.concatenate([a, b])).view(np.int64)
    roots = {r["node"]: r["root"] for r in simhash.connected(simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), n)).collect()}
    for x, y in zip(a.view(np.int64), b.view(np.int64)):
        assert x == y or roots.get(int(x), int(x)) == roots.get(int(y), int(y))


@pytest.mark.parametrize("heavy", [8, 60])
def test_large_groups_are_grouped_again(spark, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    rng = np.random.default_rng(3)
    family = np.full(400, 0x0F0F0F0F12345678, dtype=np.uint64)  # around one fingerprint, so that all first groups are large
    for _ in range(4):
        family ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    fps = np.unique(np.concatenate([family, rng.integers(0, 2**64, 50, dtype=np.uint64)]))
    got = {r["node"]: r["root"] for r in simhash.connected(simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), len(fps))).collect()}
    want = components_expected({int(x) for x in fps})
    groups, others = {}, {}
    for x in fps:
        groups.setdefault(got.get(int(x.view(np.int64)), int(x.view(np.int64))), []).append(int(x))
        others.setdefault(want[int(x)], []).append(int(x))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, others.values()))


def test_connected_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = simhash.connected(edges.union(spark.createDataFrame([(100, 99), (100, 100)], "u long, v long"))).collect()
    assert {(r["node"], r["root"]) for r in got} - {(0, 0), (99, 99)} == {(i, 0) for i in range(1, 61)} | {(100, 99)}


# sharding ---------------------------------------------------------------------------------


def test_matrix_has_the_given_margins():
    m = sharding.communication_matrix([5, 0, 9, 1], [4, 4, 4, 3], seed=1)
    assert m.sum(axis=1).tolist() == [5, 0, 9, 1] and m.sum(axis=0).tolist() == [4, 4, 4, 3]
    with pytest.raises(ValueError):
        sharding.communication_matrix([1], [2], seed=1)


def test_matrix_follows_the_hypergeometric_law():
    draws = [sharding.communication_matrix([6, 6], [4, 8], seed=s)[0, 0] for s in range(3000)]
    rng = np.random.default_rng(0)
    large = [sharding._hypergeometric_large(rng, 4, 8, 6) for _ in range(3000)]
    for got in (draws, large):
        assert abs(np.mean(got) - 2) < 0.06
        assert abs(np.mean(np.array(got) == 2) - 420 / 924) < 0.04
    big = [sharding._hypergeometric_large(rng, 3 * 10**9, 6 * 10**9, 10**6) for _ in range(50)]
    assert abs(np.mean(big) - 10**6 / 3) < 400


@pytest.mark.parametrize("n", [0, 3, 1000])
def test_shards_are_exact_and_gapless(spark, n):
    rows = spark.createDataFrame([(None if i % 7 == 0 else i % 50, "t" * (i % 3), 9) for i in range(n)], "doc_id long, text string, shard int").repartition(5)
    got = sharding.uniform_shards(rows, 8, rows_per_bucket=20).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in rows.collect())
    sizes = Counter(r["shard"] for r in got)
    assert n == 0 or max(sizes[s] for s in range(8)) - min(sizes[s] for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


def test_sizes_and_checksums(spark):
    d = spark.createDataFrame([(1, "é"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["s"], r["c"]) for r in d.select("doc_id", sharding.text_size(F.col("text")).alias("s"), sharding.text_crc32(F.col("text")).alias("c")).collect()}
    assert got == {1: (3, zlib.crc32("é".encode())), 2: (1, 0), 3: (1, 0)}


# fixity audit -----------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, file int"


def pages(spark, n):
    rows = [(i if i % 10 else None, None if i % 11 == 0 else f"http://a/{i}", "" if i % 13 == 0 else None if i % 17 == 0 else f"<p>{i % 40}</p>" * 50, "d", 1) for i in range(n)]
    return spark.createDataFrame(rows + rows[:9] + [(13, "u", "#same", "d", 1)] * 5, PAGES)


@pytest.mark.parametrize("per_file", [7, 10_000])
def test_audit_finds_each_decayed_record(spark, monkeypatch, per_file):
    monkeypatch.setattr(warc_audit.manifest, "__defaults__", (per_file,))
    monkeypatch.setattr(warc_audit, "LEAF_BYTES", 1500)
    p = pages(spark, 700)
    ours, theirs = warc_audit.replicas(p)
    shape = warc_audit.shape(ours)
    got = warc_audit.audit(warc_audit.build(ours, *shape), warc_audit.build(theirs, *shape), *shape).collect()
    want = {(r["page_id"], "missing" if r["page_id"] % 211 == 17 else "changed") for r in p.collect() if r["page_id"] is not None and (r["page_id"] % 211 == 17 or r["page_id"] % 97 == 13 and r["html"])}
    assert {(r["page_id"], r["status"]) for r in got} == want and want
    back = warc_audit.audit(warc_audit.build(theirs, *shape), warc_audit.build(ours, *shape), *shape).collect()
    assert {(r["page_id"], r["status"].replace("extra", "missing")) for r in back} == want
    same = warc_audit.build(ours, *shape)
    assert warc_audit.audit(same, warc_audit.build(ours, *shape), *shape).count() == 0


def test_audit_of_an_empty_table(spark):
    ours, theirs = warc_audit.replicas(spark.createDataFrame([], PAGES))
    shape = warc_audit.shape(ours)
    assert warc_audit.audit(warc_audit.build(ours, *shape), warc_audit.build(theirs, *shape), *shape).count() == 0


def test_records_of_null_and_empty_fields_differ(spark):
    rows = [(None, None, None), (None, None, ""), (None, "-", None), (1, "", "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert d.select(F.countDistinct(warc_audit.record_text(F.col("page_id"), F.col("url"), F.col("html")))).first()[0] == 4
