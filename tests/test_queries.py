"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from seriesmith.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    one = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) + 0.0 if isinstance(v, float) else str(v)
    return sorted((tuple(one(r[k]) for k in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


SLOW = {"eval_means", "eval_pivot", "eval_averages"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    cursor = tables.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(rows, df.columns) == normal(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())
