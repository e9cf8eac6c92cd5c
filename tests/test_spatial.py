import math
import random

from conftest import rows

from mergeloom.operators.pairs import linked_member_pairs, member_pairs
from mergeloom.operators.spatial import near_pairs

SCHEMA = "id string, lat double, lon double, strip int, n string"


def brute(points, radius):
    ok = [(k, a, b) for k, a, b, *_ in points if k is not None and a is not None and b is not None and abs(a) <= 90 and abs(b) <= 180 and not (a == 0 and b == 0)]
    out = set()
    for i, (k, a, b) in enumerate(ok):
        for q, c, d in ok[:i]:
            s = math.sin(math.radians(a - c) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(b - d) / 2) ** 2
            if k != q and 2 * 3958.8 * math.asin(math.sqrt(min(1, s))) <= radius:
                out.add((min(k, q), max(k, q)))
    return sorted(out)


def check(spark, points, radius):
    assert rows(near_pairs(spark.createDataFrame(points, SCHEMA), "id", "lat", "lon", radius)) == brute(points, radius)


def test_cluster_ties_nulls_and_repeats(spark):
    rng = random.Random(5)
    points = [(f"p{i}", 41 + rng.uniform(-0.02, 0.02), -88 + rng.uniform(-0.03, 0.03), 1, "x") for i in range(300)]
    points += [(f"t{i}", 41.0, -88.0, 1, "x") for i in range(40)] + points[:9] + [("p3", 41.0, -88.0, 1, "x")]
    points += [(None, 41.0, -88.0, 1, ""), ("n1", None, 1.0, 1, ""), ("n2", float("nan"), 1.0, 1, ""), ("n3", 0.0, 0.0, 1, ""), ("n4", 91.0, 1.0, 1, ""), ("n5", 41.0, 181.0, 1, ""), ("n6", 0.0, -88.0, 1, "")]
    check(spark, points, 0.25)


def test_meridian_and_poles(spark):
    rng = random.Random(6)
    points = [(f"m{i}", 10 + rng.uniform(-0.01, 0.01), rng.choice([180, -180]) - rng.choice([0, 0.001, 0.003]) * 1.0, 1, "") for i in range(30)]
    points = [(k, a, b if -180 <= b else b + 0.006, s, n) for k, a, b, s, n in points]
    points += [(f"n{i}", 89.99 + rng.uniform(0, 0.01), rng.uniform(-180, 180), 1, "") for i in range(30)]
    points += [(f"s{i}", -89.6 + rng.uniform(-0.3, 0.3), rng.uniform(-180, 180), 1, "") for i in range(60)]
    check(spark, points, 5.0)
    check(spark, points, 0.25)


def test_wide_radius_and_empty(spark):
    rng = random.Random(7)
    check(spark, [(f"w{i}", rng.uniform(-90, 90), rng.uniform(-180, 180), 1, "") for i in range(80)], 900.0)
    check(spark, [], 1.0)


def test_member_pairs_in_chunks(spark):
    m = [(1, f"a{i}") for i in range(23)] + [(2, "a1"), (2, "a2"), (3, "z"), (4, "z"), (4, "y")]
    df = spark.createDataFrame(m, "g int, k string")
    want = {(a, b) for g in (1, 2, 4) for x, a in m for y, b in m if x == y == g and a < b}
    assert set(rows(member_pairs(df, "g", "k", 4))) == want
    links = spark.createDataFrame([(1, 4), (3, 4)], "ga int, gb int")
    cross = {(min(a, b), max(a, b)) for p, q in ((1, 4), (3, 4)) for x, a in m for y, b in m if x == p and y == q and a != b}
    assert set(rows(linked_member_pairs(links, df, "g", "k", 4))) == cross


def test_near_places_and_regions(spark):
    from mergeloom.operators.spatial import containing_regions, near_places

    rng = random.Random(12)
    points = [(f"p{i}", 40 + rng.uniform(-0.1, 0.1), rng.choice([-100, 179.99]) + rng.uniform(-0.1, 0.1)) for i in range(150)] + [("n", None, 1.0), ("z", 0.0, 0.0), ("pole", 89.999, 10.0), (None, 40.0, -100.0)]
    points = [(k, la, lo if lo is None or lo <= 180 else lo - 360) for k, la, lo in points]
    places = [("a", 40.0, -100.0), ("b", 40.02, 179.999), ("c", 39.98, -179.99), ("pole", 89.9995, -150.0), (None, 40.0, -100.0)]
    def far(a, b):
        la, lb, d = math.radians(a[1]), math.radians(b[1]), math.radians(a[2] - b[2])
        return 2 * 3958.8 * math.asin(min(1, math.sqrt(math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(d / 2) ** 2)))
    want = sorted((p[0], q[0]) for p in points for q in places if p[0] and q[0] and p[1] is not None and p[0] != "z" and far(p, q) <= 5)
    df, pl = spark.createDataFrame(points, "k string, la double, lo double"), spark.createDataFrame(places, "c string, la double, lo double")
    assert rows(near_places(df, "k", "la", "lo", pl, "c", "la", "lo", 5).select("k", "c")) == want
    ring = [(39.95, -100.05), (39.95, -99.95), (40.0, -100.0), (40.05, -99.95), (40.05, -100.05)]
    regions = spark.createDataFrame([("r", ring), ("few", ring[:2]), ("none", None), (None, ring)], "id string, ring array<struct<lat:double,lon:double>>")

    def inside(la, lo):
        odd = False
        for (a, x), (b, y) in zip(ring, ring[1:] + ring[:1]):
            if (a > la) != (b > la) and lo < (y - x) * (la - a) / (b - a) + x:
                odd = not odd
        return odd

    want = sorted((k, "r") for k, la, lo in points if k and la is not None and inside(la, lo))
    assert rows(containing_regions(df, "k", "la", "lo", regions, "id", "ring")) == want and len(want) > 5
