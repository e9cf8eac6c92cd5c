import random

import numpy as np
import pytest
from conftest import rows

from mergeloom.llm.spans import Windows, _codes, anchors, shared_share, sharing_classes, sharing_pairs


def windows(text, n):
    return {text[i : i + n] for i in range(len(text or "") - n + 1)} if text else set()


def corpus():
    rng = random.Random(10)
    noise = lambda n: "".join(rng.choice("abcdefgh é𝄞") for _ in range(n))
    notice, short = noise(260), noise(239)
    docs = [(i, noise(rng.randrange(0, 300)) + (notice if i % 5 == 0 else short if i % 5 == 1 else "") + noise(rng.randrange(0, 300))) for i in range(40)]
    exact = noise(240)
    docs += [(50, exact), (51, "x" + exact + "y"), (52, exact[:239] + "#"), (60, "z" * 900), (61, "z" * 300), (62, "z" * 239), (70, None), (71, ""), (None, notice)]
    whole = noise(1500)
    return docs + [(80, whole), (81, whole), (82, whole[:700]), (0, docs[0][1])]


def test_pairs_against_brute_force(spark):
    docs = corpus()
    have = {d: windows(t, 240) for d, t in docs if d is not None}
    want = sorted((a, b) for a in have for b in have if a < b and have[a] & have[b])
    df = spark.createDataFrame(docs, "doc bigint, text string")
    assert rows(sharing_pairs(df, "doc", "text", 240)) == want


def test_classes_give_the_same_pairs(spark):
    df = spark.createDataFrame(corpus(), "doc bigint, text string")
    sets = {}
    for c, d in rows(sharing_classes(df, "doc", "text", 240)):
        sets.setdefault(c, set()).add(d)
    assert sorted({(a, b) for m in sets.values() for a in m for b in m if a < b}) == rows(sharing_pairs(df, "doc", "text", 240))
    assert len(set(map(frozenset, sets.values()))) == len(sets) and min(map(len, sets.values())) > 1


def test_window_hashes_tell_texts_apart():
    rng = random.Random(4)
    text = "".join(rng.choice("ab\U0001d11e") for _ in range(400)) * 2
    for which in (0, 1):
        h = Windows(_codes(text), which).at(np.arange(len(text) - 11), 12)
        assert len(set(h.tolist())) == len({text[i : i + 12] for i in range(len(text) - 11)})
        assert (h[:380] == h[400:780]).all()


def test_shares_against_brute_force(spark):
    docs = corpus()
    text = {d: t or "" for d, t in docs if d is not None}
    have = {d: windows(t, 240) for d, t in text.items()}
    want = []
    for d, t in text.items():
        covered = set()
        others = set().union(*(w for x, w in have.items() if x != d))
        for i in range(len(t) - 239):
            if t[i : i + 240] in others:
                covered |= set(range(i, i + 240))
        level = 0
        for n in (240, 480, 960):
            if any(windows(t, n) & windows(o, n) for x, o in text.items() if x != d):
                level = n
        want.append((d, len(t), len(covered), round(len(covered) / len(t), 4) if t else 0.0, level))
    assert rows(shared_share(spark.createDataFrame(docs, "doc bigint, text string"), "doc", "text", 240)) == sorted(want)


def test_empty(spark):
    df = spark.createDataFrame([], "doc bigint, text string")
    assert rows(sharing_pairs(df, "doc", "text")) == [] and rows(shared_share(df, "doc", "text")) == []


@pytest.mark.parametrize("n", [240, 60])
def test_shared_windows_choose_the_same_anchor(n):
    rng = random.Random(n)
    common = "".join(rng.choice("abc") for _ in range(n + 40))
    a, b = "q" * 77 + common + "rr", "st" * 9 + common + "u" * 50
    x, y = anchors(_codes(a), n), anchors(_codes(b), n)
    for i in range(41):
        assert x[77 + i] - 77 == y[18 + i] - 18 and 0 <= x[77 + i] - 77 - i < n // 2
