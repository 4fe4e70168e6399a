import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from panelweave.llm import suffix_dedup as sd

DOCS = "doc_id long, text string, k1 string, start int, spans int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(rows):
    least = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - 49):
            if i is not None:
                x = tuple(w[s : s + 50])
                least[x] = min(i, least.get(x, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for s in range(len(w) - 49) if i is not None and least[tuple(w[s : s + 50])] < i for p in range(s, s + 50)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), sha256(kept.encode()).hexdigest(), kept))
    return out


def sources(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "é", "漢", "w,", "zz"] if seed else [f"w{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [text(n) for n in (49, 50, 51, 70, 200, 400)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "x " * 49), (4, "x " * 50), (5, "x " * 120), (6, "y x " * 60)]
    for i in range(10, 60):
        w = text(rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            w += s[a : rng.randint(a, len(s))] + text(rng.randint(0, 60))
        rows.append((i if i % 9 else None, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [rows[20], (rows[21][0], "other " + (rows[25][1] or "")), (3, rows[30][1]), (100, " ".join(text(3000) + shared[4] + text(3000)))]
    return rows


@pytest.mark.parametrize("seed,hot", [(0, 50_000), (1, 50_000), (0, 3), (1, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = sources(seed)
    want = expected(rows)
    got = sd.removed(docs(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter(x[:4] for x in want)
    assert sum(r["n_removed"] > 0 for r in got) > 5
    if hot == 3:
        out = sd.deduplicated(docs(spark, rows))
        assert out.columns == DOCS.replace(",", "").split()[::2]
        texts = [(i, kept if n_gone else t) for (i, t), (_, n, n_gone, _, kept) in zip(rows, want) if not n_gone or n_gone < n]
        assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(texts)


def test_empty_table(spark):
    assert sd.removed(docs(spark, [])).count() == 0 and sd.deduplicated(docs(spark, [])).count() == 0


def test_chosen_is_the_leftmost_least_of_each_window():
    rng = np.random.default_rng(0)
    for n in (0, 42, 43, 44, 500):
        h = rng.integers(0, 30, n).astype(np.uint64)
        want = sorted({i + int(np.argmin(h[i : i + sd.PLACES])) for i in range(n - sd.PLACES + 1)})
        assert sd.chosen(h).tolist() == want


def test_tree_nodes_are_common_prefixes():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (200, 6))
    tree = sd.SuffixTree(rows)
    for d in range(7):
        node, seen = tree.nodes(d), {}
        for i, r in enumerate(rows):
            seen.setdefault(tuple(r[:d]), set()).add(int(node[i]))
        assert all(len(v) == 1 for v in seen.values()) and len(set(node.tolist())) == len(seen)
