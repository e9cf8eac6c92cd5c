import random
import re

import numpy as np
from conftest import rows

from mergeloom.llm import leaks
from mergeloom.llm.leaks import leaked, suffix_array, without_leaks


def longest(d, q):
    best, at = 0, 0
    for i in range(len(d)):
        for j in range(len(q)):
            n = 0
            while i + n < len(d) and j + n < len(q) and d[i + n] == q[j + n]:
                n += 1
            if n > best:
                best, at = n, i
    return best, at


def brute(docs, items, least):
    w = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    out = set()
    for d, t in docs:
        for i, q in items:
            if d is not None and i is not None:
                n, at = longest(w(t), w(q))
                if n >= least:
                    out.add((d, i, n, at))
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SHARD_WORDS", 200)
    monkeypatch.setattr(leaks, "ITEM_WORDS", 60)
    rng = random.Random(9)
    word = lambda: rng.choice("ab cd ef gh ij kl".split())
    items = [(i, " ".join(word() for _ in range(25))) for i in range(6)] + [(90, None), (91, ""), (92, "ab"), (None, "ab " * 30), (93, items_like := "ab " * 30)]
    docs = []
    for i in range(60):
        body = [word() if rng.random() < 0.9 else "Zz" for _ in range(rng.randrange(60))]
        if i % 4 == 0:
            q = items[i % 6][1].upper().split()
            body[3:3] = q[rng.randrange(10) : rng.randrange(12, 25)]
        docs.append((i, ", ".join(body)))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, items_like), (103, "ab " * 2000), docs[0]]
    d = spark.createDataFrame(docs, "doc bigint, text string")
    q = spark.createDataFrame(items, "item bigint, text string")
    found = leaked(d, "doc", "text", q, "item", "text", 6)
    assert rows(found) == brute(docs, items, 6)
    clean = {r[0] for r in without_leaks(d, "doc", found).collect()}
    assert clean == {x for x, _ in docs} - {r[0] for r in brute(docs, items, 6)}


def test_empty(spark):
    d, q = spark.createDataFrame([], "doc bigint, text string"), spark.createDataFrame([], "item bigint, text string")
    one = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "doc bigint, text string")
    assert rows(leaked(d, "doc", "text", one.toDF("item", "text"), "item", "text")) == []
    assert rows(leaked(one, "doc", "text", q, "item", "text")) == []


def test_suffix_array():
    rng = random.Random(1)
    for n in (1, 2, 30, 200):
        t = np.array([rng.randrange(3) for _ in range(n - 1)] + [-1])
        assert suffix_array(t, n).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
