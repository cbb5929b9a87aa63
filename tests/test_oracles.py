"""Every query with an oracle, over the smallest tables, against DuckDB."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def canon(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 8) + 0.0)
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    by = sorted(got.columns)
    rows = lambda cols, data: sorted([canon(r[cols.index(c)]) for c in by] for r in data)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_named_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())
