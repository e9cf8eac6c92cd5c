import random

from conftest import rows

from mergeloom.llm.groups import group_records, spread_hubs


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        if u is not None and v is not None and u != v:
            parent[find(u)] = find(v)
    members = {}
    for x in list(parent):
        members.setdefault(find(x), []).append(x)
    return sorted((min(m), x) for m in members.values() for x in m)


def test_against_union_find(spark):
    rng = random.Random(8)
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(90)] + [("hub", f"h{i}") for i in range(60)]
    links += [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)] + [("x", "x"), (None, "y"), ("y", None)]
    links += [(v, u) for u, v in links[:20]] + links[:5]
    df = spark.createDataFrame(links, "a string, b string")
    assert rows(group_records(df, "a", "b")) == brute(links)


def test_groups_and_hubs(spark):
    members = [("g", f"m{i}") for i in range(900)] + [("one", "alone"), ("two", "p"), ("two", "q"), (None, "r"), ("two", None), ("two", "p"), ("three", "q"), ("three", "c005")]
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(30)] + [("p", "p")]
    df, groups = spark.createDataFrame(links, "a string, b string"), spark.createDataFrame(members, "gid string, k string")
    first = {}
    pairs = links + [(first.setdefault(g, k), k) for g, k in members if g and k]
    assert rows(group_records(df, "a", "b", groups, "gid", "k")) == brute(pairs)


def test_hubs_are_spread_and_stay_connected(spark):
    one = [("hub", f"m{i}") for i in range(500)] + [("hub", "hub2")] + [("hub2", f"n{i}") for i in range(300)] + [("x", "y")]
    spread = spread_hubs(spark.createDataFrame(one + [(b, a) for a, b in one], "u string, v string"), 50)
    assert spread.groupBy("u").count().agg({"count": "max"}).first()[0] <= 90
    real = {}
    for g, r in brute([tuple(r) for r in spread.collect()]):
        if "\u0001" not in r:
            real.setdefault(g, set()).add(r)
    want = {}
    for g, r in brute(one):
        want.setdefault(g, set()).add(r)
    assert sorted(map(sorted, real.values())) == sorted(map(sorted, want.values()))


def test_empty(spark):
    assert rows(group_records(spark.createDataFrame([], "a string, b string"), "a", "b")) == []
    assert rows(group_records(spark.createDataFrame([("x", "x")], "a string, b string"), "a", "b")) == []
