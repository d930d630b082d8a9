"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if n in entry.queries())
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        v = float(v)
        return None if math.isnan(v) else float(f"{v:.7g}")
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    got = sorted(([plain(v) for v in r] for r in df.collect()), key=str)
    assert got == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "c_custkey"
