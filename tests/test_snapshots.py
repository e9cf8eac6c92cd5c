import datetime as dt
import random

from conftest import rows
from pyspark.sql import functions as F

from mergeloom.operators.snapshots import changed_values, snapshot_changes

D = dt.date
SCHEMA = "npi string, day date, name string, seen date, k string, h string"
FIELDS = {"name": lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))}


def brute(data):
    norm = lambda n: (n or "").strip(" ").lower() or None
    days = sorted({r[1] for r in data if r[1]})
    state = {d: {} for d in days}
    for npi, day, name, seen, *_ in data:
        if day and (npi or "").strip(" "):
            k = npi.strip(" ")
            if k not in state[day] or (seen or D.min) > state[day][k][0]:
                state[day][k] = (seen or D.min, norm(name))
    out = []
    for a, b in zip(days, days[1:]):
        for k in state[a].keys() | state[b].keys():
            kind = "added" if k not in state[a] else "removed" if k not in state[b] else "changed" if state[a][k][1] != state[b][k][1] else None
            if kind:
                out.append((k, b, kind))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(4)
    data = []
    for d in (D(2024, 1, 31), D(2024, 2, 29), D(2024, 5, 31)):
        for i in range(200):
            if rng.random() < 0.8:
                for s in range(rng.randrange(1, 3)):
                    data.append((f"n{i}", d, rng.choice(["a", "A ", "b", None, " "]), rng.choice([None, D(2024, 1, 1) + dt.timedelta(s * 40 + i)]) if s == 0 else D(2025, 1, 1) + dt.timedelta(s), "x", "y"))
    data += [(None, D(2024, 1, 31), "a", None, "", ""), (" ", D(2024, 2, 29), "a", None, "", ""), ("z", None, "a", None, "", "")] + data[:5]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(snapshot_changes(df, "npi", "day", FIELDS, ["seen"])) == brute(data)
    changed = {(r[0], r[1]) for r in changed_values(df, "npi", "day", FIELDS, ["seen"]).collect()}
    assert changed == {(k, d) for k, d, kind in brute(data) if kind == "changed"}


def test_few_deliveries(spark):
    empty = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([("a", D(2024, 1, 1), "x", None, "", "")], SCHEMA)
    for df in (empty, one):
        assert rows(snapshot_changes(df, "npi", "day", FIELDS, ["seen"])) == []
        assert rows(changed_values(df, "npi", "day", FIELDS, ["seen"])) == []


def test_one_delivery_at_a_time_with_an_index_that_stays(spark, tmp_path):
    from mergeloom.operators.snapshots import KeyIndex, take_delivery

    fields, schema = {"v": lambda c: c}, "k string, v string, o int"
    days = [[("a", "1", 1), ("b", "1", 1), ("c", None, 1)], [("a", "1", 1), ("b", "2", 1), ("b", "1", 0), ("d", "9", 1)], [("b", None, 1), ("c", "x", 1), (None, "x", 1)], []]
    found, path = [], None
    for day in days:
        last = KeyIndex(spark, path) if path else None
        changes, now = take_delivery(last, spark.createDataFrame(day, schema), "k", fields, ["o"], str(tmp_path), 5_000_000 if path is None else None)
        found.append(sorted(tuple(r) for r in changes.collect()))
        if last:
            last.drop()
        path = now.path
        now.drop(files=False)
    assert found == [[], [("b", "changed"), ("c", "removed"), ("d", "added")], [("a", "removed"), ("b", "changed"), ("c", "added"), ("d", "removed")], [("b", "removed"), ("c", "removed")]]
    assert len(list(tmp_path.iterdir())) == 1
