import math

import duckdb
import pytest

import __spark_entry__ as entry
from thalweg.plans import catalog

TABLES = ("supplier", "nation", "events", "lineitem", "part", "region")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    sql = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(sql.columns, sql.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
