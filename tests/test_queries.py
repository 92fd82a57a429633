"""Every query with SQL gives the same rows as DuckDB on the smallest tables; the others give rows."""

import glob
import math
import os

import duckdb
import pytest

from foldlog.plans import registry

SF = "/root/testdata/sf0.001"


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(canonical(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    found = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    want = sorted(tuple(canonical(dict(zip(found.columns, r))[c]) for c in columns) for r in found.fetchall())
    assert rows == want


def test_sql_names_are_queries():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
