"""Every oracle text of the operators against its query, value by value."""

from __future__ import annotations

import duckdb
import pytest

from lakequill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    relation = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(relation.columns)
    found = sorted((tuple(r[c] for c in relation.columns) for r in df.collect()), key=repr)
    assert found == sorted(relation.fetchall(), key=repr)


def test_every_operator_has_a_query():
    assert [name.split("_")[0] for name in queries.queries()] == [f"op{n}" for n in range(1, 11)]
