import math
import random

import pytest
from conftest import rows

from mergeloom.operators.reconcile import FIRST_POINT, P, count_mismatches, diff_copies, mulmod, rational

SCHEMA = "npi string, name string, rev double, d date, k string, h string, bucket string, a boolean"


def brute(a, b):
    text = lambda x: (x or "").strip(" ") or None
    norm = lambda r: (text(r[1]), r[2], r[3])
    side = lambda t: {k: [norm(r) for r in t if text(r[0]) == k] for k in {text(r[0]) for r in t} - {None}}
    a, b, out = side(a), side(b), set()
    out |= {(k, "missing_in_replica", "") for k in a.keys() - b.keys()} | {(k, "missing_in_source", "") for k in b.keys() - a.keys()}
    cell = lambda r: (r[0], None if r[1] is None else "nan" if math.isnan(r[1]) else round(r[1] * 1e6), r[2])
    for k in a.keys() & b.keys():
        if {cell(r) for r in a[k]} == {cell(r) for r in b[k]}:
            continue
        for x in a[k]:
            for y in b[k]:
                for f, p, q in zip(("name", "rev", "d"), x, y):
                    if f == "rev" and p is not None and q is not None:
                        differs = math.isnan(p) != math.isnan(q) or abs(p - q) > 1e-6
                    else:
                        differs = p != q
                    if differs:
                        out.add((k, "differs", f))
    return sorted(out)


def table(rng, n):
    out = []
    for _ in range(n):
        k = rng.choice([f"n{rng.randrange(n)}", f" n{rng.randrange(n)} ", None, " "] + ["hot"] * 2)
        out.append((k, rng.choice(["x", " x", "X", None, " ", "y"]), rng.choice([1.0, 1.0000000001, 2.5, None, float("nan"), 4e12]), None, "extra", None, "b", True))
    return out


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 300)])
def test_against_brute_force(spark, seed, n):
    rng = random.Random(seed)
    a = table(rng, n)
    b = [r for r in a if rng.random() < 0.9] + table(rng, n // 10) + a[:3] * 3
    rng.shuffle(b)
    found = diff_copies(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "npi", ["name", "rev", "d"])
    assert rows(found) == brute(a, b)


def test_all_different_doubles_the_bound_to_the_whole_bucket(spark):
    a = [(f"k{i}", "x", 1.0, None, "", "", "", True) for i in range(300)]
    b = [(f"k{i}", "y", 1.0, None, "", "", "", True) for i in range(300)]
    found = diff_copies(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "npi", ["name", "rev"], bucket_rows=16, first_bound=4)
    assert rows(found) == sorted((f"k{i}", "differs", "name") for i in range(300))


def test_empty_tables(spark):
    empty, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("k", "x", None, None, "", "", "", True)], SCHEMA)
    assert rows(diff_copies(empty, empty, "npi", ["name"])) == []
    assert rows(diff_copies(one, empty, "npi", ["name"])) == [("k", "missing_in_replica", "")]
    assert rows(diff_copies(empty, one, "npi", ["name"])) == [("k", "missing_in_source", "")]


def test_counts(spark):
    counts = spark.createDataFrame([("t/b1", 2), ("t/b2", 1), ("t/b3", None), ("t/b4", 0), ("t/b5", 3), (None, 3)], "table_name string, rows_synced bigint")
    replica = spark.createDataFrame([("1", "b1"), (" 1", "b1"), ("2", "b1"), ("3", "b2"), ("4", "b2"), (" ", "b4"), (None, "b4")], "npi string, batch string")
    found = count_mismatches(counts, replica, "npi", "batch", "table_name", "rows_synced", "t/")
    assert rows(found) == [("t/b2", "count_mismatch", "rows_synced"), ("t/b5", "count_mismatch", "rows_synced")]


def test_field_arithmetic():
    import numpy as np

    rng = random.Random(3)
    x, y = [rng.randrange(P) for _ in range(500)] + [0, P - 1], [rng.randrange(P) for _ in range(500)] + [P - 1, P - 1]
    assert mulmod(np.array(x, np.uint64), np.array(y, np.uint64)).tolist() == [i * j % P for i, j in zip(x, y)]


@pytest.mark.parametrize("na,nb", [(0, 3), (3, 0), (2, 2), (5, 1), (8, 0), (4, 4)])
def test_rational_recovers_or_refuses(na, nb):
    rng = random.Random(na * 10 + nb)
    both, a, b = ([rng.randrange(1 << 60) for _ in range(n)] for n in (20, na, nb))

    def ratio(points):
        out = []
        for i in range(points):
            z, p, q = FIRST_POINT + i, 1, 1
            for s in both + a:
                p = p * (z - s) % P
            for s in both + b:
                q = q * (z - s) % P
            out.append(p * pow(q, P - 2, P) % P)
        return out

    num, den = rational(ratio(na + nb + 3), na - nb)
    value = lambda poly, x: sum(c * pow(x, i, P) for i, c in enumerate(poly)) % P
    assert len(num) - 1 == na and len(den) - 1 == nb and not any(value(num, s) for s in a) and not any(value(den, s) for s in b)
    assert rational(ratio(na + nb + 2), na - nb) is None or na + nb <= 0
