"""Queries equal their SQL on the smallest test tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, DIR)
    r = c.execute(entry.oracle_sql()[name])
    assert _rows(df.columns, df.collect()) == _rows([x[0] for x in r.description], r.fetchall())


def test_every_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
