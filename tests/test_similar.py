"""Similar texts of large blocks: parts, their cut, and the plans of the queries that meet by a block."""

import os
import random

import pytest
from conftest import rows

import __spark_entry__ as entry
from mergeloom.functions.fuzzy import indel
from mergeloom.operators import similar

DIR = "/root/testdata/sf0.001"


def tables(spark, seed):
    """Two tables with blocks, house numbers and two texts each, some of them missing, most in one block."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde é1") for _ in range(rng.choice((4, 12, 20, 70)))).strip() or "a" for _ in range(20)]
    change = lambda: rng.choice([None, *["".join(c for c in rng.choice(base) if rng.random() > 0.1) or "b"] * 6])
    side = lambda n: [(i, rng.choice("zzzzy") if rng.random() > 0.05 else None, rng.choice(["1", "2", None]), change(), change()) for i in range(n)]
    a, b = side(40), side(150)
    names = "id int, z string, h string, a string, n string"
    return a, b, spark.createDataFrame(a, names), spark.createDataFrame(b, names)


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(similar, "LEFT", 7)
    monkeypatch.setattr(similar, "RIGHT", 30)
    monkeypatch.setattr(similar, "_AT_ONCE", 50)
    monkeypatch.setattr(similar, "_LETTERS_AT_ONCE", 200)


def score(x, y):
    return -1.0 if x is None or y is None else indel(x, y)


def below(plan, node):
    """Of each such node of a plan, the lines below it."""
    lines = plan.split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, x in enumerate(lines):
        if node in x:
            end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(x)), len(lines))
            yield lines[i + 1 : end]


def planned(spark, name):
    return entry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_state_name_92_broadcasts_no_exploded_texts(spark):
    assert not [x for lines in below(planned(spark, "state_name_92"), "BroadcastExchange") for x in lines if "Generate explode" in x and "substring" in x or "piece" in x]


def test_similar_texts_in_small_parts(spark, small_parts):
    from mergeloom.operators.matching import similar_texts

    a, b, left, right = tables(spark, 1)
    want = sorted((i, j) for i, z, _, _, t in a for j, y, _, _, u in b if z and z == y and score(t, u) >= 75)
    assert want and rows(similar_texts(left, right.withColumnRenamed("id", "rid"), "z", "n", "n", "id", "rid", 75).select("id", "rid")) == want


def test_ranked_match_in_small_parts(spark, small_parts):
    from mergeloom.operators.matching import ranked_match

    a, b, left, right = tables(spark, 2)
    for alike in (None, "h"):
        for tiers in ((0, 1), (0, 0)):
            want = []
            for i, z, h, s, t in a:
                met = [x for x in b if z and z == x[1] and (not alike or not h or not x[2] or h == x[2])]
                best = [(tiers[0], -score(s, x[3]), 0, x[0]) for x in met if score(s, x[3]) >= 80]
                best += [(tiers[1], -max(score(t, x[4]), score(t, x[3])), 1, x[0]) for x in met if max(score(t, x[4]), score(t, x[3])) >= 75]
                want += [(i, min(best)[3], ("address", "name")[min(best)[2]], round(-min(best)[1], 4))] if best else []
            tests = [("address", [("a", "a")], 80, tiers[0]), ("name", [("n", "n"), ("n", "a")], 75, tiers[1])]
            assert want and rows(ranked_match(left, right.withColumnRenamed("id", "rid"), ["z"], "id", "rid", tests, alike)) == want


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_street_then_name_forms_no_rows_of_pairs(spark):
    assert "levenshtein" not in planned(spark, "street_then_name")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_door_match_forms_no_rows_of_pairs(spark):
    assert "levenshtein" not in planned(spark, "door_match")


def test_weighed_match_in_small_parts(spark, small_parts):
    from mergeloom.operators.matching import weighed_match

    a, b, left, right = tables(spark, 3)
    want = []
    for i, z, _, s, t in a:
        best = []
        for j, y, _, u, v in b:
            if z and z == y and t and v:
                w = 0.6 * score(s, u) + 0.4 * score(t, v) if score(s, u) >= 80 else score(t, v) if score(t, v) >= 75 else 0
                best += [(-round(w, 4), j)] if w >= 50 else []
        want += [(i, min(best)[1], -min(best)[0])] if best else []
    got = rows(weighed_match(left, right.withColumnRenamed("id", "rid"), ["z"], "id", "rid", ("a", 80, 0.6), ("n", 75, 0.4), 50))
    assert want and got == want


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_weighted_match_forms_no_rows_of_pairs(spark):
    assert "levenshtein" not in planned(spark, "weighted_match")


def test_comparing_many_pairs_looks_up_each_letter_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé \U0001f600xyz") for _ in range(rng.choice((0, 3, 30, 63, 64, 65, 90)))) for _ in range(60)]
    sought, search = [], np.searchsorted
    x, y = similar.Texts(pa.chunked_array([texts[:20], [None, *texts[20:40]]])), similar.Texts(pa.chunked_array([[*texts[40:], None]]))
    i, j = (k.ravel() for k in np.meshgrid(np.flatnonzero(x.n >= 0), np.flatnonzero(y.n >= 0)))
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more, **named: sought.append(np.size(v)) or search(a, v, *more, **named))
    got = similar.ratios(x, y, i, j)
    a, b = [*texts[:20], None, *texts[20:40]], texts[40:]
    assert len(got) == 800 and got.tolist() == [indel(a[p], b[q]) for p, q in zip(i, j)]
    assert sum(sought) <= sum(map(len, texts))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_door_match_finds_telephones_once(spark):
    plan = planned(spark, "door_match")
    assert "practices.parquet" in plan and "phone" not in plan.replace("phone AS how", "")
