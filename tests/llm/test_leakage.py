import random

import numpy as np

from tidemark.llm import leakage as L
from tidemark.llm import sieve
from tidemark.llm.text import codes, gram_hashes

D, I = "doc_id long, text string, lang string", "item_id long, text string, lang string"


def brute(items, docs):
    out = set()
    for i, t, g in items:
        n = L.RUNS.get(g, L.RUNS["en"])[0]
        s = L.letters(t) if t else ""
        grams = {s[k : k + n] for k in range(len(s) - n + 1)}
        out |= {(i, d) for d, x, _ in docs if x and any(q in L.letters(x) for q in grams)}
    return out


def test_every_shared_run(spark):
    r = random.Random(7)
    en = lambda n: "".join(r.choice("abcdefgh ,.") for _ in range(n))
    zh = lambda n: "".join(r.choice("天地玄黄宇宙洪荒日月盈昃") for _ in range(n))
    items = [(i, en(300), "en") for i in range(8)] + [(i, zh(80), "zh") for i in range(8, 16)] + [(16, "too short", "en"), (17, None, "en"), (18, "", "zh")]
    docs = []
    for d in range(150):
        i, t, g = r.choice(items[:16])
        n = {"en": 50, "zh": 20}[g]
        s = L.letters(t)
        k = r.randint(0, len(s) - n - 3)
        cut = s[k : k + n + r.randint(-2, 3)]
        noise = "".join(x + r.choice(["", "​", "\n", "* ", "_"]) for x in (cut.upper() if r.random() < 0.5 else cut))
        docs.append((d, r.choice([en, zh])(r.randint(0, 200)) + "|" + noise + "|" + en(r.randint(0, 50)), "x"))
    docs += [(200, None, "x"), (201, "", "x"), (202, "a" * 300_000, "x"), (0, docs[0][1], "x")]
    got = L.leaks(spark.createDataFrame(docs, D), "doc_id", "text", spark.createDataFrame(items, I), "item_id", "text", "lang").collect()
    assert {(x["item_id"], x["doc_id"]) for x in got} == brute(items, docs)


def test_whatever_the_bit_table_lets_pass_and_empty(spark, monkeypatch):
    monkeypatch.setattr(sieve, "BITS", 6)  # 64 bits let nearly all pass
    t = [f"passage number {i} with words of its own and a good length to be found again {i * 7919}" for i in range(3)]
    items, docs = spark.createDataFrame([(i, x, "en") for i, x in enumerate(t)], I), spark.createDataFrame([(9, " ".join(t), "x")], D)
    run = lambda a, b: sorted((x["item_id"], x["doc_id"]) for x in L.leaks(a, "doc_id", "text", b, "item_id", "text", "lang").collect())
    assert run(docs, items) == [(0, 9), (1, 9), (2, 9)]
    assert run(docs.limit(0), items) == [] and run(docs, items.limit(0)) == []


def test_winnowing_keeps_the_smallest_of_every_window():
    c = codes("".join(random.Random(1).choice("abc") for _ in range(400)))
    at, h = L.winnow(c, 20, 10)
    all_h, kept = gram_hashes(c, 10), set(at.tolist())
    assert (all_h[at] == h).all()
    for j in range(len(all_h) - 10):
        w = all_h[j : j + 11]
        assert any(i in kept and all_h[i] == w.min() for i in range(j, j + 11))
    assert kept <= {j + int(k) for j in range(len(all_h) - 10) for k in np.flatnonzero(all_h[j : j + 11] == all_h[j : j + 11].min())}
