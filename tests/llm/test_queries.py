"""Queries of the training-data operators that have SQL, over the smallest tables, against DuckDB."""

import duckdb
import pytest

from plait.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", list(ORACLE))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda row: [(v is None, str(v)) for v in row]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=key)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
