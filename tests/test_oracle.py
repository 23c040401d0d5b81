"""Every query that SQL can express, value by value against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime

import duckdb
import pandas as pd
import pytest

from lakequill.plans import catalogue
from lakequill.plans.tables import TABLES

SF = "/root/testdata/sf0.001"
ORACLE = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, datetime.datetime):
        return str(pd.Timestamp(v))
    return v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    relation = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(relation.columns)
    order = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [relation.columns.index(c) for c in order]
    wanted = sorted((tuple(plain(r[k]) for k in at) for r in relation.fetchall()), key=repr)
    assert found == wanted
    for a, b in zip(found[:20], wanted[:20]):
        assert [type(x) for x in a] == [type(x) for x in b]


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) - set(ORACLE) == set()
