import json
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from mergeloom.sources import tables, tabular, web

WANTED = {"name": ["practice name", "business name"], "zip": ["zip code", "postal code"], "phone": ["phone number"], "revenue": ["annual sales volume"]}


def test_headers():
    assert tabular.map_headers(["Zip Code", "Bussiness Name", "Phone Numbr", "Other"], WANTED) == {"zip": "Zip Code", "name": "Bussiness Name", "phone": "Phone Numbr"}
    assert tabular.header_row([["Export of"], ["", ""], ["Business Name", "ZIP"], ["x", "1"]], WANTED) == 2


def test_vendor_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Report 2024\n\nBusiness Name,Zip,Phone number\nCafé Dental,60601,1\n,,\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("﻿ZIP Code,Practice Name\n60602,Zwei\n".encode())
    (tmp_path / "c.csv").write_bytes(b"")
    got = rows(tabular.read_vendor(spark, str(tmp_path), WANTED).select("name", "zip", F.coalesce("phone", F.lit("-"))))
    assert got == [("Café Dental", "60601", "1"), ("Zwei", "60602", "-")]


def test_registry(spark, tmp_path):
    (tmp_path / "r.csv").write_text(" NPI , Tax_1,Tax_2,Postal Code\n1,1223X,,60601-1\n2,99,1223G,60602\n3,99,98,60601\n4,,,\n")
    df = tabular.registry_csv(spark, str(tmp_path / "r.csv"), "Tax", "1223")
    assert rows(df.select("NPI", "first_slot")) == [("1", "1223X"), ("2", "1223G")]
    scope = spark.createDataFrame([("60601",)], "z string")
    assert rows(tabular.registry_csv(spark, str(tmp_path / "r.csv"), "Tax", "1223", scope).select("NPI")) == [("1",)]


def test_json_table_and_long_form(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([["zip", "pop"], ["60601", "12"], ["60602", "-666666666"]]))
    df = tabular.json_table(spark, str(tmp_path / "t.json"), ["-666666666"])
    assert [tuple(r) for r in df.orderBy("zip").collect()] == [("60601", "12"), ("60602", None)]
    assert rows(tabular.long_form(spark.createDataFrame([("a", 1, 2)], "k string, x int, y int"), ["k"], "n", "v")) == [("a", "x", 1), ("a", "y", 2)]


def test_workbook(tmp_path):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>State</t></si><si><r><t>Il</t></r><r><t>linois</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>5</v></c></row></sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>')
    assert tabular.workbook((tmp_path / "w.xlsx").read_bytes()) == {"S": [["State", None, None], ["Illinois", None, "5"], ["Illinois", None, None]]}


HTML = """<h2>Deals</h2><p>One &amp; two</p><table><tr><th>Name<th></tr><tr><th>Name</th><td>x</td></tr></table><a href='/a'>a</a><A HREF="/b#t">b</A>
<script type="application/ld+json">{"@graph":[{"@type":["Dentist"],"name":"N","address":{"streetAddress":"1 Elm St","addressLocality":"T","addressRegion":"GA","postalCode":1},"telephone":"5"},{"dept":[{"@type":"X","address":{}}]}]}</script>
<script type="application/ld+json">{broken</script>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "<p>12 Elm St, Redton, GA 30301 and <td>")], "id int, html string")
    got = web.parsed_pages(pages, "id", "html", web.PLACE_COLUMNS, web.place_rows).collect()
    assert tuple(got[0]) == (1, "Dentist", "N", "1 Elm St", "T", "GA", "1", "5") and tuple(got[1]) == (1, "X", None, None, None, None, None, None) and len(got) == 2
    sections = rows(web.parsed_pages(pages, "id", "html", web.SECTION_COLUMNS, web.section_rows))
    assert (1, "Deals", "One & two") in sections
    assert ("Name", "x") in {(r.header or "Name", r.value) for r in web.parsed_pages(pages, "id", "html", web.TABLE_COLUMNS, web.table_rows).collect()}
    assert pages.filter("id = 1").select(web.links(F.col("html"))).first()[0] == ["/a", "/b"]
    assert pages.filter("id = 4").select(web.us_addresses(F.col("html"))).first()[0] == ["12 Elm St, Redton, GA 30301"]


def test_log(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"src":"a","t":1}\n{"src":"a","t":3}\n{bad\n{"src":"b","t":2}\n')
    log = tables.read_log(spark, str(tmp_path / "l.jsonl"), "src string, t bigint")
    assert rows(log) == [("a", 1), ("a", 3), ("b", 2)]
    assert rows(tables.last_runs(log, "src", "t")) == [("a", 3), ("b", 2)]
    assert rows(tables.keep_newest(log, "t", 2)) == [("a", 3), ("b", 2)]


def test_guarded_replacement(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(100)
    assert tables.replace_table(df, path, floor=10) == 100
    for bad in (spark.range(0), spark.range(5), spark.range(90)):
        with pytest.raises(ValueError):
            tables.replace_table(bad, path, floor=10)
    assert spark.read.parquet(path).count() == 100
    assert tables.replace_table(spark.range(99), path, floor=10) == 99 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "2024-01-05"), (2, "b", "2024-02-01")], "id int, s string, d string")
    tables.export_csv(df, str(tmp_path / "c"), ["s", "id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["s", "id"]
    tables.snapshot(df, str(tmp_path / "p"), "d")
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {"month=2024-01", "month=2024-02"}
    tables.append_log(df, str(tmp_path / "j"))
    tables.append_log(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4


def test_read_only_sql(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert tables.read_only_sql(spark, "with x as (select id, 'drop table' w from three) select * from x order by id").count() == 3
    assert tables.read_only_sql(spark, "select id from three union select 9").count() == 4
    assert tables.read_only_sql(spark, "values (1), (2)").count() == 2 and tables.read_only_sql(spark, "select * from range(20000)").count() == 20000
    assert tables.read_only_sql(spark, "select * from range(20000)", 7).count() == 7
    assert tables.read_only_sql(spark, "select id, (select max(id) from three) m, explode(array(1, 2)) from three where id in (select id from three)").count() == 6
    jvm = "reflect('java.lang.System', 'currentTimeMillis')"
    for bad in (f"select {jvm}", f"with x as (select {jvm} a) select * from x", f"select id from three where id > (select count({jvm}))", f"select java_method('java.lang.System', 'currentTimeMillis')"):
        with pytest.raises(ValueError):
            tables.read_only_sql(spark, bad)
    for bad in ("drop view three", "create table t as select 1", "insert into three values (1)", "set x=1", "cache table three"):
        with pytest.raises(ValueError):
            tables.read_only_sql(spark, bad)
