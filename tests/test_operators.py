import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from mergeloom.functions import address as A
from mergeloom.functions import parse as P
from mergeloom.functions import text as X
from mergeloom.functions.fuzzy import indel, lcs_length, may_reach, ratio, token_sort
from mergeloom.operators.cascade import cascade, fill_rates, invariants, reject_reasons
from mergeloom.operators.graph import clusters_by_key, connected_components, propagate
from mergeloom.operators.matching import band_pairs, fuzzy_match, latest, longest_pattern
from mergeloom.operators.merge import change_events, collapse, insert_if_absent, keep_first, only_in, pull, upsert
from mergeloom.operators.vectors import nearest


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c"))).first()[0]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[-1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_lcs_and_bound(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abé ") for _ in range(rng.randrange(70))), "".join(rng.choice("abé ") for _ in range(rng.randrange(70)))) for _ in range(300)]
    assert all(lcs_length(a, b) == plain_lcs(a, b) for a, b in pairs)
    assert indel("", "") == 100 and indel(None, "a") is None
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("r", ratio("a", "b"))
    assert df.filter((F.col("r") >= 70) & ~may_reach(F.col("a"), F.col("b"), 70)).isEmpty()
    assert one(spark, "  b  a c ", token_sort) == "a b c"


@pytest.mark.parametrize("text,want", [("$1.5 million", 1500000), ("2M-4M", 3000000), ("less than 500K", 250000), ("5M+", 5000000), ("1,250,000", 1250000), ("under $2 million", 1000000), ("none", None), ("", None), (None, None), ("100K to 250K", 175000)])
def test_money(spark, text, want):
    assert one(spark, text, P.money) == want


@pytest.mark.parametrize("text,want", [("2024-01-05", dt.date(2024, 1, 5)), ("1/5/2024", dt.date(2024, 1, 5)), ("20240105", dt.date(2024, 1, 5)), ("Jan 5, 2024", dt.date(2024, 1, 5)), ("soon", None), (None, None)])
def test_dates(spark, text, want):
    assert one(spark, text, P.any_date) == want


def test_scalars(spark):
    assert one(spark, "Illinois", P.state_code) == "IL" and one(spark, " il ", P.state_code) == "IL" and one(spark, "zz", P.state_code) is None
    assert one(spark, "11-1111112", P.ein) is None and one(spark, "36-1482759", P.ein) == "361482759" and one(spark, "123", P.ein) is None
    assert one(spark, "0.25", P.percent) == 25 and one(spark, "40%", P.percent) == 40 and one(spark, "x", P.percent) is None
    assert one(spark, "about 1,200 staff", P.first_integer) == 1200
    assert one(spark, "10 North Elm Street, Suite 5", A.street_key) == "10 N ELM ST" and one(spark, " ", A.street_key) is None
    assert one(spark, "It’s “x”", X.ascii_quotes) == "It's \"x\""
    assert one(spark, "b + a+b", lambda c: X.sorted_set(c, "+")) == "a+b"
    assert one(spark, "See Dr. Ann B. Lee. She left! Ok?", X.sentences) == ["See Dr. Ann B. Lee.", "She left!", "Ok?"]
    assert one(spark, "https://WWW.a.com:80/x", X.host) == "a.com" and one(spark, "a.com", X.host) is None
    assert one(spark, "N/A", lambda c: X.sentinel_null(c, ["n/a"])) is None and one(spark, None, lambda c: X.sentinel_null(c, ["n/a"])) is None


def test_fuzzy_match_ties_and_blocks(spark):
    left = spark.createDataFrame([(1, "z", "10 elm st"), (2, "z", None), (3, None, "10 elm st"), (4, "y", "10 elm st")], "id int, b string, t string")
    right = spark.createDataFrame([("p", "z", "10 elm str"), ("o", "z", "10 elm str"), ("q", "z", "10 elm st"), ("r", "x", "10 elm st")], "rid string, b string, t string")
    assert rows(fuzzy_match(left, right, ["b"], "t", "t", "id", "rid", 85)) == [(1, "q", 100.0)]
    assert rows(fuzzy_match(left, right, ["b"], "t", "t", "id", "rid", 85, first=True).select("id", "rid")) == [(1, "o")]
    assert rows(fuzzy_match(left, right.filter("rid <> 'q'"), ["b"], "t", "t", "id", "rid", 100 * 18 / 19, strict=True)) == []


def test_longest_of_a_large_dictionary(spark):
    texts = spark.createDataFrame([(1, "Big Smile Dental"), (1, "none"), (2, None), (3, "W6001x and Smile"), (4, "ab cd")], "k int, t string")
    pats = spark.createDataFrame([("smile",), ("Smile Dental",), (" ",), (None,), ("cd",), ("ab",)] + [(f"w{i}x",) for i in range(12000)], "p string")
    assert rows(longest_pattern(texts, "t", pats, "p", "k").fillna("-")) == [(1, "-"), (1, "smile dental"), (2, "-"), (3, "w6001x"), (4, "ab")]


def test_patterns_bands_latest(spark):
    texts = spark.createDataFrame([(1, "Big Smile Dental"), (2, "none"), (3, None)], "k int, t string")
    pats = spark.createDataFrame([("smile",), ("Smile Dental",), (" ",), (None,)], "p string")
    assert rows(longest_pattern(texts, "t", pats, "p", "k").fillna("-")) == [(1, "smile dental"), (2, "-"), (3, "-")]
    assert rows(longest_pattern(texts, "t", pats.limit(0), "p", "k").fillna("-")) == [(1, "-"), (2, "-"), (3, "-")]
    d = dt.date(2024, 1, 1)
    e = spark.createDataFrame([(i, "a", d + dt.timedelta(n)) for i, n in enumerate([0, 60, 61, 121, 400, 400])] + [(9, "a", None), (10, None, d)], "id int, b string, d date")
    assert rows(band_pairs(e, ["b"], "d", 60, "id")) == [(0, 1), (1, 2), (2, 3), (4, 5)]
    assert rows(latest(e.filter("b is not null"), ["b"], [F.desc_nulls_last("d"), F.asc("id")]).select("id")) == [(4,)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200), (None, 5), (7, None)] + [(500 + i, 500) for i in range(50)]
    got = dict(connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, **dict.fromkeys(range(500, 550), 500)}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").collect() == []


def test_clusters_and_propagation(spark):
    df = spark.createDataFrame([("1", "k", "z1", None), ("2", " k ", "z2", "A"), ("3", "k", "z2", "B"), ("4", None, "z3", None), ("5", " ", "z3", ""), ("6", "q", "z1", None)], "id string, key string, zip string, lab string")
    assert rows(clusters_by_key(df, F.col("key"), "id", F.col("zip"), 2, 2)) == [("k", 3, 2)]
    assert rows(clusters_by_key(df, F.col("key"), "id", F.col("zip"), 2, 2, 2)) == []
    assert dict(propagate(df, F.col("key"), "lab", "id", [""]).select("id", F.coalesce("lab", F.lit("-"))).collect()) == {"1": "A", "2": "A", "3": "B", "4": "-", "5": "", "6": "-"}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", "unknown"), (2, "b", "pe"), (3, None, None)], "k int, n string, s string")
    new = spark.createDataFrame([(1, None, "ind"), (2, "B", "ind"), (3, "c", "ind"), (4, "d", "ind")], "k int, n string, s string")
    assert rows(upsert(old, new, "k", {"s": ["unknown"]})) == [(1, "a", "ind"), (2, "B", "pe"), (3, "c", "ind"), (4, "d", "ind")]
    assert rows(upsert(old, new.limit(0), "k").fillna("-")) == [(1, "a", "unknown"), (2, "b", "pe"), (3, "-", "-")]
    assert rows(change_events(old, new, "k", ["n", "s"])) == [(1, "s", "unknown", "ind"), (2, "n", "b", "B"), (2, "s", "pe", "ind")]
    add = spark.createDataFrame([(1, "a"), (2, "x"), (3, "x"), (4, None), (5, None)], "i int, n string")
    assert rows(insert_if_absent(old, add, ["n"], [F.asc("i")]).select("i")) == [(2,), (4,), (5,)]
    assert rows(keep_first(add, ["n"], [F.asc("i")]).select("i")) == [(1,), (2,), (4,)]
    assert rows(only_in(new, old, ["k"])) == [(4,)]
    t = spark.createDataFrame([(1, 5), (2, 20), (3, 1), (4, None)], "id int, at int")
    assert rows(pull(t, "id", F.lit(2), "at", F.lit(10)).select("id")) == [(2,), (3,), (4,)]
    g = spark.createDataFrame([("g", 2, None, 5, "x"), ("g", 1, None, 7, "y"), ("g", 3, "n", None, "x")], "g string, o int, f string, m int, s string")
    assert tuple(collapse(g, ["g"], F.col("o"), ["f"], ["m"], ["m"], {"set": "s"}).first()) == ("g", 3, "n", 7, 5, "x,y")


def test_rules_and_checks(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, " ")], "i int, s string")
    r = cascade([(F.col("i") == 1, "one", "is one", 9), (F.col("i") < 3, "few", "below three", 5)], ("many", "else", 0))
    assert [tuple(x[0]) for x in df.orderBy("i").select(r).collect()] == [("one", "is one", 9), ("few", "below three", 5), ("many", "else", 0)]
    assert [x[0] for x in df.orderBy("i").select(reject_reasons({"a": F.col("s").isNull(), "b": F.col("s") == " "})).collect()] == [[], ["a"], ["b"]]
    assert rows(invariants(df, [("p", F.col("i") > 0, 3, 3, "FAIL"), ("q", F.col("s") == "x", None, 0, "WARN")])) == [("p", 3, "PASS"), ("q", 1, "WARN")]
    assert rows(fill_rates(df, ["i", "s"])) == [("i", 3, 1.0), ("s", 1, 0.3333)]
    assert rows(fill_rates(df.limit(0), ["i"])) == [("i", 0, 0.0)]


def test_nearest(spark, monkeypatch):
    from mergeloom.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK_VALUES", 5)
    rng = random.Random(3)
    data = [(i, [rng.uniform(-1, 1) for _ in range(2)]) for i in range(40)] + [(90, None), (91, [0.0, 0.0]), (92, [1.0])]
    df = spark.createDataFrame(data, "i int, v array<float>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5)
    want = set()
    for q, v in data[:40:4]:
        best = sorted((-round(cos(v, w), 3), i) for i, w in data[:40] if i != q)[:3]
        want |= {(q, i) for _, i in best}
    got = {(r.qid, r.hit) for r in nearest(df.filter("i % 4 = 0 and i < 40"), df, "i", "v", 3, digits=3).collect()}
    assert len(got ^ want) <= 2
    assert nearest(df.limit(0), df, "i", "v", 3).collect() == []


def test_similar_texts_against_brute_force(spark):
    from mergeloom.operators.matching import containing_texts, similar_texts

    rng = random.Random(6)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(4, 30))) for _ in range(25)]
    change = lambda t: "".join(c for c in t if rng.random() > 0.04) + rng.choice(["", "x"])
    left, right = [(i, "s", t) for i, t in enumerate(base)] + [(90, None, "a"), (91, "s", None), (92, "s", "")], [(i, rng.choice("ss t").strip() or None, change(t)) for i, t in enumerate(base * 3)]
    for least in (80, 92):
        want = sorted((i, j) for i, b, t in left for j, c, u in right if b and t and u and b == c and indel(t, u) >= least)
        found = similar_texts(spark.createDataFrame(left, "i int, b string, t string"), spark.createDataFrame(right, "j int, b string, u string"), "b", "t", "u", "i", "j", least)
        assert rows(found.select("i", "j")) == want
    a, b = spark.createDataFrame([("abcd",), ("xy",), (None,), ("",)], "t string"), spark.createDataFrame([("bc",), ("abcd",), ("y",), ("",), (None,)], "p string")
    assert rows(containing_texts(a, "t", b, "p")) == [("abcd", "abcd"), ("abcd", "bc"), ("xy", "y")]


def test_ranked_match(spark):
    from mergeloom.operators.matching import ranked_match

    left = spark.createDataFrame([(1, "z", "10 elm st", "smith"), (2, "z", None, "jones dental"), (3, None, "10 elm st", "smith"), (4, "z", "zzz", "qqq")], "id int, b string, a string, n string")
    right = spark.createDataFrame([("p", "z", "10 elm str", "x"), ("q", "z", "99 oak", "smith"), ("r", "z", "7", "jones dental"), ("s", "z", "7", "jones dental")], "rid string, b string, a string, n string")
    got = rows(ranked_match(left, right, ["b"], "id", "rid", [("address", [("a", "a")], 80, 0), ("name", [("n", "n"), ("n", "a")], 75, 1)]).select("id", "rid", "how"))
    assert got == [(1, "p", "address"), (2, "r", "name")]


def test_numbered_batches(spark):
    from mergeloom.operators.ordering import batches, numbered

    df = spark.range(1000, numPartitions=7).selectExpr("id", "pmod(hash(id), 997) k")
    want = sorted((r.k, r.id) for r in df.collect())
    for rows_ in (numbered(df.repartition(5), [F.asc("k"), F.asc("id")]).collect(),):
        assert [(r.k, r.id) for r in sorted(rows_, key=lambda r: r.row_no)] == want and sorted(r.row_no for r in rows_) == list(range(1000))
    assert {r.batch_no for r in batches(df, [F.asc("k")], 300).collect()} == {0, 1, 2, 3}
    assert numbered(df.limit(0), [F.asc("k")]).collect() == []


def test_composite_keys_scopes_and_watermarks(spark):
    from mergeloom.operators import merge as M

    old = spark.createDataFrame([(1, "a", 5, None), (1, "b", 6, 1), (None, "a", 7, 1)], "y int, s string, v int, w int")
    new = spark.createDataFrame([(1, "a", None, 9), (1, "c", 8, 8), (None, "a", 0, 0)], "y int, s string, v int, w int")
    show = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert show(M.upsert(old, new, ["y", "s"])) == sorted([("1", "a", "5", "9"), ("1", "b", "6", "1"), ("None", "a", "7", "1"), ("1", "c", "8", "8"), ("None", "a", "0", "0")])
    scope = spark.createDataFrame([("a",), (None,)], "s string")
    assert show(M.scoped_replace(old.select("y", "s"), new.select("y", "s"), scope, "s")) == [("1", "a"), ("1", "b"), ("None", "a")]
    t = spark.createDataFrame([("p", i) for i in range(10)] + [("q", 5)], "s string, id int")
    store = M.advance(None, M.next_batch(t, None, "s", "id", 4), "s", "id")
    assert rows(store) == [("p", 3), ("q", 5)]
    again = M.next_batch(t, store, "s", "id", 4)
    assert rows(again) == [("p", i) for i in (4, 5, 6, 7)] and rows(M.advance(store, again, "s", "id")) == [("p", 7), ("q", 5)]
    state = M.merge_by_state(spark.createDataFrame([(1, "open"), (2, "held"), (3, None), (4, "open")], "k int, s string"), spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (9, "x")], "k int, s string"), "k", "s", ["open"])
    assert rows(state) == [("inserted", 9, "x"), ("kept", 4, "open"), ("protected", 2, "held"), ("replaced", 1, "x"), ("replaced", 3, "x")]
