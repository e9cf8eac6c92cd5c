import datetime as dt
import random

import pytest
from conftest import rows

from mergeloom.operators.history import value_history

SCHEMA = "id bigint, e string, f string, old string, new string, day date, at timestamp_ntz, pos int, runs string"
D = dt.date


def brute(events):
    by = {}
    for i, e, f, old, new, day, at, *_ in events:
        day = day or (at.date() if at else None)
        if (new or "").strip(" ") and day:
            by.setdefault((e, f.strip(" ").lower() if f is not None else None), []).append((day, at or dt.datetime.min, i, new.strip(" "), (old or "").strip(" ")))
    out = set()
    for (e, f), r in by.items():
        r.sort()
        versions = [(D(1, 1, 1), r[0][4])] if r[0][4] else []
        for day in sorted({x[0] for x in r}):
            value = [x for x in r if x[0] == day][-1][3]
            if not versions or versions[-1][1] != value:
                versions.append((day, value))
        out |= {(e, f, a, b, v) for (a, v), (b, _) in zip(versions, versions[1:] + [(D(9999, 12, 31), "")])}
    return out


def found(spark, events, bits):
    h = value_history(spark.createDataFrame(events, SCHEMA), "e", "f", "old", "new", "day", "at", "id", bits)
    return {tuple(r) for r in h.collect()}


@pytest.mark.parametrize("bits", [1, 6])
def test_against_brute_force(spark, bits):
    rng = random.Random(bits)
    events = []
    for i in range(500):
        day = D(2020, 1, 1) + dt.timedelta(rng.randrange(600))
        events.append((i, rng.choice(["a", "b", "c", None, "hot", "hot"]), rng.choice(["x", " X", "y"]), rng.choice([None, " ", "1", "2"]), rng.choice(["1", "2", " 2 ", "3", None, ""]),
                       rng.choice([day, None]), rng.choice([dt.datetime(2021, 5, rng.randrange(1, 28)), None, dt.datetime(1950, 1, 1)]), 0, ""))
    assert found(spark, events + events[:20], bits) == brute(events + events[:20])


def test_edges(spark):
    at = dt.datetime(2022, 3, 1)
    assert found(spark, [], 6) == set()
    assert found(spark, [(1, "a", "x", "same", "same", D(2022, 1, 1), at, 0, "")], 6) == {("a", "x", D(1, 1, 1), D(9999, 12, 31), "same")}
    assert found(spark, [(1, "a", "x", "", "v", None, None, 0, "")], 6) == set()
    far = [(1, "a", "x", None, "v", D(1900, 1, 1), at, 0, ""), (2, "a", "x", None, "v", D(2999, 1, 1), at, 0, ""), (3, "a", "x", None, "w", D(3500, 1, 1), at, 0, "")]
    assert found(spark, far, 6) == {("a", "x", D(1900, 1, 1), D(3500, 1, 1), "v"), ("a", "x", D(3500, 1, 1), D(9999, 12, 31), "w")}
