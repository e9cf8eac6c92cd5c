import numpy as np
import pytest
from conftest import rows

from mergeloom.llm.catalogue import DENTAL
from mergeloom.llm.linkage import FIELDS, LEVELS, _prepared, candidates, edits, estimate, link, name_score, respell

LEFT = "id string, title string, phone string, address string, zip string, city string, state string, words string"
RIGHT = "npi string, name string, dba string, phone string, address string, zip string, city string, state string, id bigint"
COLS = {c: c for c in ("phone", "address", "zip", "city", "state")}
STEMS = "Kelnan Broxet Quivard Tosmel Hidrane Pelkoth Wexling Jarduin Molvane Sendrick Fintoll Garvath".split()


def tables(spark):
    right, left, want = [], [], set()
    for i, a in enumerate(STEMS):
        for j, b in enumerate(STEMS):
            if i < j:
                n, k = f"{i:02}{j:02}", i * 12 + j
                right.append((f"r{n}", f"{a} & {b} Family Dentistry", None, f"31255{k:05}", f"{100 + k} Elm St", f"6{i:02}0{j % 10}", f"Town{i}", "GA", 1))
                if j % 2:
                    left.append((f"l{n}", f"{b.upper()} and {a} Fam Dental, LLC", f"(312) 55{k // 100:01}-{k:04}" if j % 3 else None, f"{100 + k} Elm Street" if j % 5 else None, f"6{i:02}0{j % 10}", f"TOWN{i}", "GA", ""))
                    want.add((f"l{n}", f"r{n}"))
    left += [("none", "Unknown Dental", None, "999 Oak St", "69999", "Nowhere", "GA", ""), ("blank", " ", " ", None, None, None, None, ""), (None, "x", "", "", "", "", "", "")]
    right += [("rnull", None, " ", None, None, None, None, None, 1), (None, "Kelnan Dental", None, None, None, None, None, None, 1), right[0]]
    return spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), want


def test_finds_the_planted_matches(spark):
    left, right, want = tables(spark)
    found = link(left, {"id": "id", "names": ["title"]} | COLS, right, {"id": "npi", "names": ["name", "dba"]} | COLS, vocabulary=DENTAL)
    got = {(r.left_id, r.right_id) for r in found.collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert all(0.5 <= r.confidence <= 1 for r in found.collect())


def met(spark, firms, names):
    """Indices of the (name, zip, city, state) records that meet the first firm; none has a telephone or an address."""
    lc, rc = {"id": "id", "names": ["title"]} | COLS, {"id": "npi", "names": ["name", "dba"]} | COLS
    right = spark.createDataFrame([(f"r{i:05}", n, None, None, None, z, c, s, 1) for i, (n, z, c, s) in enumerate(firms)], RIGHT)
    left = spark.createDataFrame([(str(i), n, None, None, z, c, s, "") for i, (n, z, c, s) in enumerate(names)], LEFT)
    pairs = candidates(_prepared(left, lc, DENTAL), _prepared(right, rc, DENTAL))
    return {int(r.id_a) for r in pairs.filter("id_b = 'r00000'").collect()}


@pytest.mark.parametrize("firms", [12, 400])
def test_misspelt_names_meet_in_small_tables(spark, firms):
    right = [("Skubbird Dental Studio", "60001", "Elmton", "GA")] + [(f"{STEMS[i % 11 + 1]} {i} Dental Studio", f"7{i:04}", "Faraway", "TX") for i in range(firms)]
    left = [("Skubbrd Dental Studio", None, None, "GA"), ("Skubbrd Dental Care", "60001", None, None), ("Skubbird Dental", None, "Elmton", None), ("Skubbird Dental", None, None, "TX")]
    assert met(spark, right, left) == {0, 1, 2}


def test_common_words_meet_in_their_place(spark):
    brands = "Brightwater Dental", "Quivard Dental", "Fintoll Dental"
    right = [(brands[0], "60001", "Elmton", "GA")] + [(brands[i % 3], f"7{i:04}", "Faraway", "TX") for i in range(6000)]
    left = [("Brightwatr Dental", None, "Elmton", None), ("Brightwater Dental Group", "60001", None, None), ("Brightwatr Dental", None, None, "GA"), ("Brightwater Dental", None, None, "GA")]
    assert met(spark, right, left + [("Quivard Dental", None, "Nowhere", None)]) == {0, 1, 2, 3}


def test_empty(spark):
    left, right, _ = tables(spark)
    cols = ({"id": "id", "names": ["title"]} | COLS, {"id": "npi", "names": ["name", "dba"]} | COLS)
    assert rows(link(left.limit(0), cols[0], right, cols[1])) == []
    assert rows(link(left, cols[0], right.limit(0), cols[1])) == []


def test_estimation_recovers_the_classes():
    rng = np.random.default_rng(1)
    true = {f: (np.array([0.02] * (LEVELS[f] - 2) + [1 - 0.02 * (LEVELS[f] - 2)]), np.array([1 - 0.03 * (LEVELS[f] - 2)] + [0.03] * (LEVELS[f] - 2))) for f in FIELDS}
    counts = {}
    for _ in range(20000):
        c = 0 if rng.random() < 0.2 else 1
        p = tuple(int(rng.choice(LEVELS[f] - 1, p=true[f][c])) if rng.random() < 0.9 else LEVELS[f] - 1 for f in FIELDS)
        counts[p] = counts.get(p, 0) + 1
    share, m, u = estimate(list(counts.items()))
    assert abs(share - 0.2) < 0.02
    assert all(np.abs(m[f] - true[f][0]).max() < 0.03 and np.abs(u[f] - true[f][1]).max() < 0.03 for f in FIELDS)


def test_names_and_edits():
    assert edits("abc", "acb", 2) == 1 and edits("abcdef", "abdef", 1) == 1 and edits("abc", "xyz", 1) == 2
    w = lambda *t: [(x, 8.0 if x[0].isupper() else 1.0) for x in t]
    assert name_score(w("Kelnan", "dental"), w("Kelnan", "dental"), 4.6) == (1, 8)
    assert name_score(w("Kelnan", "dental"), w("Broxet", "dental"), 4.6)[0] < 0.12
    assert name_score([], [], 4.6) == (0, 0)
    known = DENTAL.spelt()
    assert respell("dentstry", known) == "dental" and respell("aestheic", known) == "cosmetic" and respell("kelnan", known) is None and respell("mental", {}) is None


def test_pairs_are_compared_together_and_only_names_nearly_alike_one_by_one(monkeypatch):
    import random

    import pyarrow as pa

    from mergeloom.llm import linkage

    rng = random.Random(6)
    known = ["brightwater", "brihgtwater", "kanzzova", "kanzova", "smile", "smyle", "dental", "ab", "é\U0001f600dental"]
    other = ["".join(rng.choice("bcdfgjklmnpqrstvwxz") for _ in range(12)) for _ in range(60)]

    def name(words):
        return "|".join(f"{v}:{w}:{rng.choice((0.9, 2.5, 4.7, 7.6))}" for v in range(rng.choice((1, 1, 2))) for w in rng.sample(words, rng.randint(1, min(len(words), rng.choice((3, 4, 14)))))) or None

    def batch(n, words):
        pick = {"words": lambda: name(words) if rng.random() > 0.1 else None, "phone": lambda: rng.choice([None, "1", "2"]), "number": lambda: rng.choice(["", None, "5", "6"])}
        pick |= {"dir": lambda: rng.choice(["", "n", "s"]), "street": lambda: rng.choice(["", "oak hill", "oak hil", "elm 5", "elm 6"]), "type": lambda: rng.choice(["", "st"]), "unit": lambda: rng.choice(["", None, "1", "2"])}
        pick |= {"zip": lambda: rng.choice([None, "", "11111", "22222"]), "city": lambda: rng.choice([None, "", "dover", "dovr", "salem"]), "state": lambda: rng.choice([None, "il", "ny"])}
        cols = {f"{f}_{s}": pa.array([pick[f]() for _ in range(n)], pa.string()) for f in linkage._COMPARED for s in "ab"}
        return pa.RecordBatch.from_pydict({"id_a": pa.array(range(n)), "id_b": pa.array(range(n)), **cols})

    def place(za, zb, ca, cb, sa, sb):
        if za and zb and za == zb:
            return 3
        if ca and cb and linkage.one_edit(ca, cb) and (not sa or not sb or sa == sb):
            return 2
        return 1 if sa and sb and sa == sb else 4 if not (za and zb) and not (ca and cb) and not (sa and sb) else 0

    def street(na, nb, da, db, sa, sb, ta, tb, ua, ub):
        if not na or not nb:
            return 5
        alike = (sa == sb or linkage._streets_alike(sa, sb)) and all(not x or not y or x == y for x, y in ((da, db), (ta, tb)))
        return (1 if alike or na == nb else 0) if na != nb or not alike else 3 if not ua or not ub else 4 if ua == ub else 2

    x = batch(1500, known + other[:4])
    of = lambda *fields: zip(*[x.column(f"{f}_{s}").to_pylist() for f in fields for s in "ab"], strict=True)
    want = [[linkage._name_level(linkage._variants(a), linkage._variants(b), 4.6, 7.6) for a, b in of("words")], [2 if not a or not b else int(a == b) for a, b in of("phone")]]
    want += [[street(*r) for r in of("number", "dir", "street", "type", "unit")], [place(*r) for r in of("zip", "city", "state")]]
    got = pa.Table.from_batches(list(linkage._compare(iter([x]), 4.6, 7.6)))
    assert [got[f].to_pylist() for f in linkage.FIELDS] == want and all(len(set(w)) > 2 for w in want)
    assert pa.Table.from_batches(list(linkage._compare(iter([x.slice(0, 0)]), 4.6, 7.6)), schema=got.schema).num_rows == 0

    scored, score = [], linkage.name_score
    monkeypatch.setattr(linkage, "name_score", lambda *z: scored.append(1) or score(*z))
    short = [w for w in other if len(set(w)) > 6]
    y = batch(1500, short)
    y = y.set_column(y.schema.get_field_index("words_a"), "words_a", pa.array([f"0:{a}:7.6|0:dental:0.9" for a in rng.choices(short[:20], k=1500)]))
    y = y.set_column(y.schema.get_field_index("words_b"), "words_b", pa.array([f"0:{a}:7.6|0:dental:0.9" for a in rng.choices(short[20:], k=1500)]))
    list(linkage._compare(iter([y]), 4.6, 7.6))
    assert len(scored) == 0
