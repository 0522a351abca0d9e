"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = entry._QUERIES, entry._SQL


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for x in os.listdir(DATA):
        con.sql(f"CREATE VIEW {x.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{x}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, DATA), db.sql(SQL[name])
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    rows = lambda x: sorted(map(repr, x))
    assert rows(tuple(x[c] for c in order) for x in got.collect()) == rows(want.select(*order).fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "local_ts", "remote_ts"]


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
