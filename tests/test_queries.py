"""Every query against its SQL on the smallest tables, except those of the optional subpackage."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tidemark.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    return c


def canonical(v):
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    result = con.sql(SQL[name])
    assert sorted(result.columns) == columns
    rows = lambda found: sorted("|".join(map(canonical, r)) for r in found)
    assert rows(df.select(columns).collect()) == rows(result.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 1
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
