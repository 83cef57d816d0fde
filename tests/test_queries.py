"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import math

import duckdb
import pytest

from citeframe import catalog

TABLES = "documents benchmark conversations labels embeddings pages events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def as_rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    other = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert as_rows([tuple(r) for r in df.collect()], df.columns) == as_rows(other.fetchall(), other.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
