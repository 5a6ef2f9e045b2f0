"""Every query with SQL gives DuckDB's rows on the smallest test tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(ROOT):
        con.execute(f"create view {f[:-8]} as select * from '{ROOT}/{f}'")
    return con


def cell(x):
    if x is None or pd.isna(x):
        return "null"
    number = hasattr(x, "__float__") and not isinstance(x, str) and "bool" not in type(x).__name__
    return repr(round(float(x), 6) + 0.0) if number else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    a, b = entry.queries()[name](spark, ROOT).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda df: sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(a) == rows(b)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["query_id", "id", "score", "rank"]
