"""Deals out of sentences, documents merged, and streams that let go of their state."""

import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from mergeloom.functions import deals as D
from mergeloom.functions import nested as N
from mergeloom.functions import text as X
from mergeloom.streaming import windows as W


@pytest.mark.parametrize(
    "text,want",
    [
        ("Elm Dental Care was acquired by Big Group in May.", "Elm Dental Care"),
        ("Elm Dental Care (Redton, GA) joined Big Group on undisclosed terms.", "Elm Dental Care"),
        ("Big Group has acquired Smith & Lee Orthodontics in Redton, OH.", "Smith & Lee Orthodontics"),
        ("Big Group partnered with Oak Smiles which is located in Austin, TX.", "Oak Smiles"),
        ("Big Group added Several in May.", None),
        ("Big Group acquired Big Group in Redton.", None),
        ("big group acquired elm dental in redton.", None),
        ("", None),
        (None, None),
    ],
)
def test_targets(spark, text, want):
    assert spark.createDataFrame([(text, "Big Group")], "t string, p string").select(D.target(F.col("t"), F.col("p"))).first()[0] == want


def test_other_fields(spark):
    t = "Big Group, backed by Oak Capital, opened 12 offices in Oregon and IN, OR and TX; a partnership of orthodontists."
    row = spark.createDataFrame([(t,)], "t string").select(*[f(F.col("t")).alias(n) for n, f in {"s": D.states, "k": D.kind, "sp": D.specialty, "n": D.locations, "sponsor": D.sponsor, "deal": D.is_deal, "off": D.off_topic}.items()]).first()
    assert tuple(row) == ("OR,TX", "de_novo", "orthodontics", 12, "Oak Capital", True, None)
    empty = spark.createDataFrame([(None,), ("",), ("In 2024 me and in",)], "t string")
    assert [tuple(r) for r in empty.select(D.is_deal(F.col("t")), D.states(F.col("t")), D.locations(F.col("t"))).collect()] == [(False, None, None), (False, "", None), (False, "", None)]


@pytest.mark.parametrize("title,want", [("Q3 2024 roundup", [7, 8, 9]), ("https://a.example/2023/05/x", [5]), ("March 2022 deals", [3]), ("2021 year in review", list(range(1, 13))), ("nothing", []), (None, [])])
def test_months_covered(spark, title, want):
    got = spark.createDataFrame([(title,)], "t string").select(D.months_covered(F.col("t"))).first()[0]
    assert [d.month for d in got] == want


def test_small_functions(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "c string").select(f(F.col("c"))).first()[0]
    assert one("$7,500", D.size_mm) == 7.5 and one("12.5", D.size_mm) == 12.5 and one("-3", D.size_mm) is None and one("x", D.size_mm) is None
    assert one("11.26x", D.multiple) == 11.3 and one("120", D.multiple) is None
    assert one("Dr. Ann Lee-Roy, DDS", X.surname) == "Lee-Roy" and one("Dr. Ann Lee", X.is_person) and not one("Lee Dental DDS", X.is_person)
    assert one(" www.a.com/x", X.http_url) == "https://www.a.com/x" and one("ftp://a.com", X.http_url) is None and one(None, X.http_url) is None
    note = lambda c: X.with_note(c, F.lit(" [m]"), "[m]")
    assert one("a", note) == "a [m]" and one("a [m]", note) == "a [m]" and one(None, note) == " [m]"


def test_documents_merge_in_order(spark):
    docs = [("a", 1, {"n": "x", "l": [1, 2], "d": {"p": 1}}), ("a", 2, {"n": " ", "l": [2, 3], "d": {"q": None}, "z": 0}), ("a", 3, {"d": {"p": 2, "q": 5}})]
    data = [(k, o, json.dumps(d)) for k, o, d in docs] + [("a", 4, "{broken"), ("b", 1, None), (None, 1, "{}"), ("c", 1, "[1]"), ("c", 2, "[1, 2]")]
    got = {r.k: json.loads(r.doc) for r in N.merge_documents(spark.createDataFrame(data, "k string, o int, doc string"), "k", "o", "doc").collect()}
    assert got == {"a": {"n": "x", "l": [1, 2, 3], "d": {"p": 2, "q": 5}, "z": 0}, "c": [1, 2]}
    many = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").alias("o"), F.to_json(F.struct(F.col("id").alias("v"))).alias("doc"))
    assert [json.loads(r.doc) for r in N.merge_documents(many, "k", "o", "doc").collect()] == [{"v": 2999}]


def test_streams_append_and_drop_their_state(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for day in range(6):
        data = [(start + dt.timedelta(days=day, hours=h), "a" if h % 2 else "b") for h in range(24)]
        spark.createDataFrame(data, "ts timestamp_ntz, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = W.event_stream(spark, str(tmp_path / "in"), "*.parquet", "ts timestamp_ntz, kind string", "ts", files=1)
    q = W.tumbling(stream, "ts", "6 hours", ["kind"]).writeStream.format("memory").queryName("six_hours").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) <= 16 and kept[-1] <= 4  # never the windows of all days
    assert spark.table("six_hours").filter("n <> 3").isEmpty() and spark.table("six_hours").count() == 46
