import json

from conftest import rows
from pyspark.sql import functions as F

from mergeloom.functions import nested as N
from mergeloom.sources.paged import PagedJson
from mergeloom.streaming import windows as W


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c"))).first()[0]


def test_lists_and_people(spark):
    assert one(spark, '["a", "b"]', N.json_list) == ["a", "b"]
    assert one(spark, 'x "a" and "b"', N.json_list) == ["a", "b"]
    assert one(spark, None, N.json_list) == [] and one(spark, "{", N.json_list) == []
    got = one(spark, '[{"first":"A","last":" B "},{"first":"A","last":"B"},{"last":""},{"title":"x"}]', N.people)
    assert [tuple(p) for p in got] == [("A", "B", None)]
    assert one(spark, "broken", N.people) == []


def test_slots_and_union(spark):
    df = spark.createDataFrame([("A", "1", " ", None, "A", "1")], "a1 string, b1 string, a2 string, b2 string, a3 string, b3 string")
    s = N.slots([["a1", "b1"], ["a2", "b2"], ["a3", "b3"]], ["a", "b"])
    assert [tuple(x) for x in df.select(s).first()[0]] == [("A", "1")]
    both = spark.range(1).select(N.union_by(F.array(F.struct(F.lit("x").alias("k"), F.lit(1).alias("v"))), F.array(F.struct(F.lit("x").alias("k"), F.lit(2).alias("v")), F.struct(F.lit("y").alias("k"), F.lit(3).alias("v"))), "k"))
    assert [tuple(x) for x in both.first()[0]] == [("x", 1), ("y", 3)]


def test_documents(spark):
    assert one(spark, 'Sure: {"a": {"b": 1}} done', N.document_text) == '{"a": {"b": 1}}'
    assert one(spark, "none", N.document_text) is None
    assert one(spark, '{"a": {"b": 1}}', lambda c: N.path(c, "$.a.b", "int")) == 1 and one(spark, "{", lambda c: N.path(c, "$.a")) is None


def test_paged_source(spark, tmp_path):
    (tmp_path / "p-0.json").write_text(json.dumps([{"id": "1", "x": {"y": 2}}, {"id": "2"}]))
    (tmp_path / "p-2.json").write_text(json.dumps([{"id": "3", "x": None}]))
    spark.dataSource.register(PagedJson)
    df = spark.read.format("paged_json").schema("id string, x string").option("template", f"{tmp_path}/p-{{offset}}.json").option("limit", "2").option("pages", "4").load()
    assert rows(df.fillna("-")) == [("1", '{"y": 2}'), ("2", "-"), ("3", "-")]


def test_stream_keeps_newest_per_key(spark, tmp_path):
    src = tmp_path / "in"
    schema = "k string, t int, v string"
    write = lambda data: spark.createDataFrame(data, schema).write.mode("append").parquet(str(src))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for data in ([("a", 1, "x"), ("b", 5, "y")], [("a", 3, "z"), ("b", 2, "late")]):
        write(data)
        W.upsert_latest(spark.readStream.schema(schema).parquet(str(src)), "k", "t", out, state)
    assert rows(spark.read.parquet(f"{out}/1").select("k", "t", "v")) == [("a", 3, "z"), ("b", 5, "y")]


def test_stream_drops_repeats_and_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    base = spark.sql("select * from values (1, timestamp '2024-01-01 00:00:00'), (1, timestamp '2024-01-01 00:10:00'), (2, timestamp '2024-01-01 00:20:00') as t(k, ts)")
    base.write.parquet(src)
    stream = spark.readStream.schema("k int, ts timestamp").parquet(src)
    assert rows(W.run(W.without_repeats(stream, "ts", ["k"])).select("k")) == [(1,), (2,)]
