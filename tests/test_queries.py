"""Every query that has SQL, over the smallest tables, against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in ORACLE if n.startswith("q_")])
def test_against_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf), duck.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda row: [(v is None, str(v)) for v in row]
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    b = sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=key)
    assert a == b


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("q_") and n not in ORACLE])
def test_others_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_order_is_total_and_stable(spark, sf):
    rows = QUERIES["q_char_order"](spark, sf).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows)))
    keys = [[int(x) for x in r.key.split()] for r in rows]
    assert keys == sorted(keys)


def test_entry(spark):
    assert entry.entry(spark).columns == ["o_orderkey", "k", "n", "inner_sum", "fold_sum", "outer_sum", "value"]


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)
