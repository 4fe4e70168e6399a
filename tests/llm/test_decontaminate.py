import random
import re
from collections import Counter

import pytest

from panelweave.llm import decontaminate as dc

DOCS = "doc_id long, text string, n_words string, hash int, words int, d int, t string"
ITEMS = "item_id long, text string, hash int"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(dc.WORD, lower)


def expected(text, items):
    w, hit, found = words(text), set(), set()
    for item_id, t in items:
        v = words(t)
        n = min(13, len(v))
        for j in range(len(v) - n + 1) if v else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    hit.update(range(i, i + n))
                    if item_id is not None:
                        found.add(str(item_id))
    return len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)


def sources():
    rng = random.Random(4)
    vocab = ["Ab", "cd", "É", "ß9", "漢", "q", "the", "x1", "İ"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "-", ", ", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([13, 14, 30, 12, 5, 7, 6]))) for i in range(12)]
    items += [(20, "rare"), (21, "two rares"), (22, None), (23, "..."), (None, text(15)), (3, items[3][1]), (3, text(16)), (30, "A " * 20)]
    docs = [None, "", "!!", "a " * 40, "rare", "TWO-RARES rare", text(300)]
    for _, t in items:
        docs.append(text(rng.randint(0, 30)) + " " + (t or "") + " " + text(rng.randint(0, 300)))
        docs.append(" ".join(words(t)[1:]) + " zz " + " ".join(words(t)[:-1]))
    docs.append(text(4000) + items[0][1] + text(4000))
    rows = list(enumerate(docs)) + [(None, docs[8]), (8, docs[8]), (8, docs[10])]
    return rows, items


@pytest.mark.parametrize("broadcast", [4 << 20, 0])
def test_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", broadcast)
    rows, items = sources()
    d = spark.createDataFrame([(i, t, "x", 1, 2, 3, "t") for i, t in rows], DOCS)
    b = spark.createDataFrame([(i, t, 5) for i, t in items], ITEMS)
    got = dc.decontaminate(d, b)
    assert got.columns == ["doc_id", "text", "hash", "words", "d", "t", "n_words", "n_hit", "item_ids", "contaminated"]
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in got.collect()) == Counter((i, *expected(t, items)) for i, t in rows)
    kept = Counter((r["doc_id"], r["text"]) for r in dc.clean(d, b).collect())
    assert kept == Counter((i, t) for i, t in rows if not expected(t, items)[-1])


def test_long_items_only_and_empty_tables(spark):
    rows, items = sources()
    items = [x for x in items if len(words(x[1])) >= 13]
    d, b = spark.createDataFrame([(i, t, "x", 1, 2, 3, "t") for i, t in rows], DOCS), spark.createDataFrame([(i, t, 5) for i, t in items], ITEMS)
    got = dc.decontaminate(d, b).collect()
    assert Counter((r["doc_id"], r["n_hit"]) for r in got) == Counter((i, expected(t, items)[1]) for i, t in rows)
    assert dc.decontaminate(spark.createDataFrame([], DOCS), b).count() == 0
    assert {r["n_hit"] for r in dc.decontaminate(d, spark.createDataFrame([], ITEMS)).collect()} == {0}
