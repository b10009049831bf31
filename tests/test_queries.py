"""Every registered query of the core against the SQL, on the smallest tables."""

import glob
import importlib
import math
import os

import duckdb
import pytest

from drawloom.plans.oracle import ORACLE
from drawloom.plans.queries import QUERIES

DATA = os.environ.get("DRAWLOOM_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()))
    if name not in ORACLE:
        assert got
        return
    result = engine.execute(ORACLE[name])
    named = [d[0] for d in result.description]
    assert sorted(named) == columns
    want = sorted(repr(tuple(plain(row[named.index(c)]) for c in columns)) for row in result.fetchall())
    assert got == want


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if DATA.endswith("sf0.001"):
        assert entry.entry(spark).count() > 0
