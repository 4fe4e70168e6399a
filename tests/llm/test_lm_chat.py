import math
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from panelweave.llm import backoff_lm as lm
from panelweave.llm import chat_tree as ct
from panelweave.llm.common import Grams

DOCS = "doc_id long, text string, block int, k int, n_words string"
ROWS = "conv_id long, turn long, role string, text string, whole string, pack int"


def scores_expected(texts):
    docs = [(t or "").encode().split() for t in texts]
    grams = [[Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in (1, 2, 3)] for w in docs]
    total = [sum((g[k] for g in grams), Counter()) for k in range(3)]
    n_all, out = sum(map(len, docs)), []
    for w, own in zip(docs, grams):
        rest, s = max(n_all - len(w), 1), 0.0
        c = lambda *x: total[len(x) - 1][x] - own[len(x) - 1][x]  # noqa: B023, E731
        for i in range(len(w)):
            depth, back = min(i, 2), 1.0
            for k in range(depth, -1, -1):
                gram = tuple(w[i - k : i + 1])
                if c(*gram) > 0:
                    s += math.log(back * c(*gram) / (c(*gram[:-1]) if k else rest))
                    break
                back *= lm.ALPHA
            else:
                s += math.log(back / rest)
        out.append((len(w), s))
    return out


@pytest.mark.parametrize("block_bytes,at_once", [(1 << 30, 1 << 20), (400, 50), (900, 7)])
def test_scores_equal_brute_force(spark, monkeypatch, block_bytes, at_once):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(lm, "AT_ONCE", at_once)
    rng = random.Random(1)
    vocab = ["the", "a", "é", "x", "漢"] + [f"w{i}" for i in range(40)]
    texts = [None, "", " \n", "the", "unique words only here", "the the the the"]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    texts += [texts[9]] * 5 + [texts[10] + " tail"]
    rows = [(i if i % 13 else None, t) for i, t in enumerate(texts)] + [(7, texts[7])]
    got = lm.scores(spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], DOCS)).collect()
    want = [(i, n, round(s, 6)) for (i, _), (n, s) in zip(rows, scores_expected([t for _, t in rows]))]
    assert Counter((r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in got) == Counter(want)
    for r in got:
        assert (r["mean_log_score"] is None) == (r["n_words"] == 0)
    assert lm.scores(spark.createDataFrame([], DOCS)).count() == 0


def test_count_table_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 300)
    rng = random.Random(4)
    texts = [None, "", "one"] + [" ".join(rng.choice("abcdé") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    got = {r["gram"] & (2**64 - 1): r["n"] for r in lm.count_table(spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)], DOCS)).collect()}
    want = Counter()
    for t in texts:
        w = (t or "").encode().split()
        want.update(b" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert got == {int(Grams(g.split()).of(len(g.split()))[0]): n for g, n in want.items()}
    assert lm.count_table(spark.createDataFrame([], DOCS)).count() == 0


def test_packed_numbers_come_back():
    x = np.array([0, 1, 255, 256, 2**40, 2**64 - 1], dtype=np.uint64)
    for random in (0, 5):
        assert lm._unpack(lm._pack(x, random), np.uint64, 6, random).tolist() == x.tolist()
        assert lm._unpack(lm._pack(x[:0], random), np.uint64, 0, random).tolist() == []


HARD = ["", "\\", "###", "####", "\\###", "</turn>", "\\</turn>", "</turn>\n### user: x", "a: b", "\\\\</turn>\\", ct.PLANTED, "é漢🙂", "<" * 3 + "/turn>", "#\\##", "\\:", "x\n"]


def test_template_is_reversible():
    rng = random.Random(0)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "a:b", "\\", "", "###", "x</turn>:"]), "".join(rng.choice(HARD) for _ in range(rng.randint(0, 4)))) for _ in range(rng.randint(1, 5))]
        assert ct.parse("".join(ct.segment(*t)[0] for t in turns)) == turns


def test_tree_shares_beginnings_and_keeps_positions():
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("assistant", "no")
    conversations = [("1", [a, b]), ("2", [a, c, a]), ("3", [a]), ("4", [b]), ("5", [a, c, a, b])]
    text, nodes, attends, leaves = ct.grow(conversations)
    assert len(nodes) == 6 and len(text) == sum(n["stop"] - n["start"] for n in nodes)
    for whole, turns in conversations:
        leaf = next(x["node"] for x in leaves if x["whole"] == whole)
        spans = attends[leaf]
        assert "".join(text[s["start"] : s["stop"]] for s in spans) == "".join(ct.segment(*t)[0] for t in turns)
        at = [p for s in spans for p in range(s["start"], s["stop"])]
        position = {p: n["position"] + p - n["start"] for n in nodes for p in range(n["start"], n["stop"])}
        assert [position[p] for p in at] == list(range(len(at)))  # along its path a conversation counts from 0


def chat_expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = Counter()
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for *_, role, t in turns)
        size = sum(len(ct.segment(role, t)[0]) for *_, role, t in turns)
        out[conv, len(turns), sha256(whole.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), size] += 1
    return out


@pytest.mark.parametrize("pack", [64, 3, 1])
def test_formatted_equals_brute_force(spark, monkeypatch, pack):
    monkeypatch.setattr(ct, "PACK", pack)
    rng = random.Random(2)
    rows = [(None, 0, "user", "a"), (None, None, None, None), (5, 1, "user", "dup"), (5, 1, "user", "dup"), (5, 1, "assistant", "dup")]
    for conv in range(10, 60):
        rows += [(conv, k, rng.choice(["user", "assistant"]) if k else "system", rng.choice(HARD[:6]) if k else "same start") for k in range(rng.randint(1, 6))]
    for conv in range(100, 110):
        rows += [(conv, 0, "user", "copy"), (conv, 1, "assistant", "copy" * 2000)]
    rng.shuffle(rows)
    d = spark.createDataFrame([(*r, "w", 1) for r in rows], ROWS)
    got = ct.formatted(d).collect()
    assert Counter((r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in got) == chat_expected(rows)
    packs = ct.packed(ct.whole_conversations(d)).collect()
    assert all(len(p["leaves"]) <= max(pack * 3, 4) for p in packs)


@pytest.mark.parametrize("pack", [64, 5])
def test_each_beginning_is_written_once_whatever_its_frequency(spark, monkeypatch, pack):
    monkeypatch.setattr(ct, "PACK", pack)
    rows = []
    for conv in range(300):  # one system prompt, and twelve common turns for half of them
        common = ["prompt"] + [f"common {i}" for i in range(12)] * (conv % 2)
        rows += [(conv, k, "system" if k == 0 else "assistant", t) for k, t in enumerate([*common, f"own {conv}", "é" * (conv % 7)])]
    rows += [(1000, 0, "system", "prompt"), (1001, 0, "user", "alone"), (1002, 0, "user", "alone"), (1002, 1, "assistant", "x")]
    d = spark.createDataFrame([(*r, "w", 1) for r in rows], ROWS)
    by = {}
    for conv, k, role, text in sorted(rows):
        by.setdefault(conv, []).append((role, text))
    beginnings = {tuple(t[: i + 1]) for t in by.values() for i in range(len(t))}
    packs = sorted(ct.packed(ct.whole_conversations(d)).collect(), key=lambda p: (p["stretch"], p["pack"]))
    text, seen = "".join(p["text"] for p in packs), []
    assert len({p["stretch"] for p in packs}) > 1  # the prompt is shared by several tasks
    assert len(text) == sum(len(ct.segment(*b[-1])[0]) for b in beginnings) and sum(len(p["nodes"]) for p in packs) == len(beginnings)
    for p in packs:
        assert len(p["leaves"]) <= pack and text[p["start"] : p["start"] + len(p["text"])] == p["text"]
        seen += ["".join(text[s["start"] : s["stop"]] for s in p["attends"][x["node"]]) for x in p["leaves"]]
    assert Counter(seen) == Counter("".join(ct.segment(*t)[0] for t in turns) for turns in by.values())
    got = ct.formatted(d).collect()
    assert Counter((r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in got) == chat_expected(rows)


def test_no_conversations(spark):
    assert ct.formatted(spark.createDataFrame([], ROWS)).count() == 0
