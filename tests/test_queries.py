"""Every registered query against its SQL on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return c


def text(v):
    if v is None or v is pd.NaT:
        return "null"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(text(r[i]) for i in order) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
