"""Token alignment, content sort and the dataset manifest against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelweave.llm import alignment, content_sort, dataset_manifest
from panelweave.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, range int, g string, row string"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    words = ["alpha", "Über", "naïve", "don't", "  two", "\n", "\t", "日本語", "😀", "x1y2", "<|endoftext|>", "<s>", "..."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    out = [(i, t, "en", f"s{i % 7 if i % 2 else 0}") for i, t in enumerate(texts)]
    out += [(100 + i, texts[0], "de", "s0") for i in range(150)]  # one large group of copies
    out += [(300, "", "en", "lone"), (301, None, None, None), (302, None, "en", None), (303, "▁ odd", "en", "s1"), (304, "word " * 30_000, "en", "ü"), (None, "no id\n", "en", "s1"), (5, texts[5], "en", "s5"), (5, texts[5], "en", "s5"), (306, texts[0] + "\n", "en", "s0")]
    return [(i, t, la, s, None if i == 7 else len(t or ""), 1, "g", "r") for i, t, la, s in out]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("three")
    spark.createDataFrame(docs, SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/none/documents.parquet")
    return str(path)


# Alignment ---------------------------------------------------------------------------------


class Plain:
    """Both tokenizers by their own libraries, and links pair by pair."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = alignment.default_paths()
        self.a, self.b, letters = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b), alignment.byte_letters()
        self.a.encode_special_tokens = True
        self.raw_a = {i: bytes(letters[c] for c in w) for w, i in self.a.get_vocab().items() if all(c in letters for c in w)}

    def raw_b(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(self, text):
        """(id, start, end) of both sides; none where the bytes differ."""
        sides = []
        for ids, raw in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.raw_a.get), (self.b.encode(text), self.raw_b)) if text else ():
            at, side = 0, []
            for i in ids:
                side.append((i, at, at + len(raw(i))))
                at = side[-1][2]
            if b"".join(map(raw, ids)) != f" {text}".encode():
                return [], []
            sides.append(side)
        return sides or ([], [])


def alignment_expected(texts):
    plain = Plain()
    sides = [plain.tokens(t) for t in texts]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 3000 else near(a, b) for a, b in sides]
    counts = Counter(p for each in links for p in each)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for (a, b), each in zip(sides, links):
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        parts = ["|".join(",".join(str(i) for i, s, e in side if lo < e <= hi) for side in (a, b)) for lo, hi in zip([0, *cuts], cuts)] if len(a) < 3000 else grouped(a, b, cuts)
        out.append((len(a), len(b), len(cuts), len(each), sum(counts[p] == most[p[1]] for p in each), sum(counts[p] for p in each), sha(";".join(parts)) if a else ""))
    return out


def near(a, b):
    out, k = [], 0
    for i, s, e in a:
        while b[k][2] <= s:
            k += 1
        j = k
        while j < len(b) and b[j][1] < e:
            out.append((i, b[j][0]))
            j += 1
    return out


def grouped(a, b, cuts):
    sides = []
    for side in (a, b):
        rest, parts = iter([*side, (0, 0, float("inf"))]), []
        now = next(rest)
        for hi in cuts:
            part = []
            while now[2] <= hi:
                part.append(str(now[0]))
                now = next(rest)
            parts.append(",".join(part))
        sides.append(parts)
    return ["|".join(p) for p in zip(*sides)]


def test_op11(spark, folder, docs, monkeypatch):
    want = Counter((d[0], *r) for d, r in zip(docs, alignment_expected([d[1] for d in docs])))
    got = QUERIES["op11_token_alignment"](spark, folder)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert got.columns == list(names) and Counter(tuple(r) for r in got.collect()) == want
    assert QUERIES["op11_token_alignment"](spark, f"{folder}/none").collect() == []


def test_alignment_does_not_depend_on_blocks(docs):
    texts = [d[1] for d in docs if len(d[1] or "") < 5000]
    paths = alignment.default_paths()
    whole, links = alignment.align(texts, *paths)
    parts = [alignment.align(texts[k : k + 7], *paths) for k in range(0, len(texts), 7)]
    assert [r for p, _ in parts for r in p.to_pylist()] == whole.to_pylist()
    assert sum(len(x) for _, x in parts) == len(links) and sum((Counter(x["pair"].to_pylist()) for _, x in parts), Counter()) == Counter(links["pair"].to_pylist())
    assert alignment.align([], *paths)[0].num_rows == 0 and alignment.align([None, ""], *paths)[1].num_rows == 0


def test_groups_are_the_alignment_itself(spark, docs):
    few = [d for d in docs if len(d[1] or "") < 200][:30]
    got = {r["doc_id"]: r["groups"] for r in alignment.groups(spark.createDataFrame(few, SCHEMA)).collect()}
    assert all(sha(got[d[0]]) == e[-1] or (not got[d[0]] and not e[-1]) for d, e in zip(few, alignment_expected([d[1] for d in few])))


def test_byte_level_encoder_equals_the_files_own_library():
    """Every code point that a string can hold, beside letters, digits and spaces."""
    from tokenizers import Tokenizer

    path = alignment.default_paths()[0]
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    encode = alignment._byte_level(path)[0]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4000):
        texts = [f" a{''.join(points[i : i + 4])}b {points[i]}  {points[i + 1]}1.'s" for i in range(k, min(k + 4000, len(points) - 3), 4)]
        assert [encode(t) for t in texts] == [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]


# Content sort ------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("range_bytes", [200, 1 << 24])
def test_duplicates(spark, docs, keep, range_bytes):
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    groups = {}
    for d in docs:
        groups.setdefault(d[1] or "", []).append(d[0])
    order = lambda i: (i is not None, i or 0)
    want = Counter()
    for t, ids in groups.items():
        stays = (max if keep == "largest" else min)(ids, key=order)
        want.update((i, stays, len(ids), False, sha(t)) for i in ids)
        want[(stays, stays, len(ids), False, sha(t))] -= 1
        want[(stays, stays, len(ids), True, sha(t))] += 1
    got = Counter(tuple(r) for r in content_sort.duplicates(df, keep=keep, range_bytes=range_bytes).collect())
    assert got == +want
    left = content_sort.deduplicated(df, keep=keep, range_bytes=range_bytes)
    assert left.columns == df.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in left.collect()) == Counter((i, t) for t, ids in groups.items() for i in [(max if keep == "largest" else min)(ids, key=order)])


def test_a_group_of_copies_is_spread_over_ranges(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    body = lambda: F.col("text")
    sizes = [r["count"] for r in content_sort.ranged(df, body, F.col("doc_id"), range_bytes=4000).groupBy("range").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 400
    out = content_sort.duplicates(df, keep="largest", range_bytes=4000)
    assert out.where("kept").collect()[0]["doc_id"] == 3999 and out.where("kept").count() == 1 and out.select("group_size", "keep_id").distinct().collect()[0][:] == (4000, 3999)


def test_normalised_duplicates(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    out = content_sort.duplicates(df, normalise=lambda t: F.lower(F.regexp_replace(t, r"\s+", " ")))
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in out.collect()} == {(1, 1, True), (2, 1, False), (3, 3, True)}
    assert content_sort.duplicates(df.where("doc_id > 9")).collect() == [] and content_sort.deduplicated(df.where("doc_id > 9")).collect() == []


def test_content_sort_runs_no_python(spark, folder):
    plan = QUERIES["op12_exact_dedup"](spark, folder)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# Manifest ----------------------------------------------------------------------------------


def up(level):
    return [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(up(levels[-1]))
    return levels


def path(levels, i):
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        yield i % 3, run[: i % 3], run[i % 3 + 1 :]
        i //= 3


def manifest_expected(docs):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text: sha("".join(map(part, (d[0], d[3], d[2], d[4], text))))
    groups = {}
    for d in docs:
        groups.setdefault(d[3], []).append((d[0] is not None, d[0] or 0, leaf(d, d[1]), d))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = Counter()
    for k, s in enumerate(names):
        for i, (_, _, own, d) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0
            node = leaf(d, d[1].replace("\n", "") if hit and d[1] else d[1])
            proof = ""
            for _, left, right in [*path(trees[s], i), *path(top, k)]:
                proof += "".join(left + right)
                node = sha("".join([*left, node, *right]))
            out[(d[0], own, trees[s][-1][0], top[-1][0], sha(proof), node, node == top[-1][0])] += 1
    return out


def test_op13(spark, folder, docs):
    got = QUERIES["op13_dataset_manifest"](spark, folder)
    rows = [tuple(r) for r in got.collect()]
    assert Counter(rows) == manifest_expected(docs) and {True, False} == {r[-1] for r in rows}
    assert QUERIES["op13_dataset_manifest"](spark, f"{folder}/none").collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28, 243, 244, 800])
def test_manifest_of_one_group(spark, n):
    leaves = spark.range(n).select(F.lit("=g").alias("g"), F.col("id").alias("i"), dataset_manifest.leaf_digest(F.col("id")).alias("digest"))
    m = dataset_manifest.build(leaves, ["i"])
    levels = tree([sha(f"{len(str(i))}:{i}") for i in range(n)])
    assert m.root.hex() == levels[-1][0]
    assert m.records.count() == sum(map(len, levels[1:]))
    asked = m.leaves.where("rank % 5 = 1").select("g", "rank")
    got = {r["rank"]: r["p"] for r in dataset_manifest.proofs(m, asked).select("rank", dataset_manifest.proof_text(F.col("path")).alias("p")).collect()}
    assert got == {i: "".join("".join(a + b) for _, a, b in path(levels, i)) for i in range(n) if i % 5 == 1}


def test_equal_subtrees_are_stored_once(spark):
    leaves = spark.range(81).select(F.lit("=g").alias("g"), F.lit(1).alias("i"), dataset_manifest.leaf_digest(F.lit(1)).alias("digest"))
    m = dataset_manifest.build(leaves, ["i"])
    assert m.records.count() == 4 and dataset_manifest.proofs(m).count() == 81
