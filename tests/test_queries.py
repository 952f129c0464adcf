"""Every query with an SQL form against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from codeatlas import queries, queries_sql, table_queries, table_queries_sql
from jobs import queries as jobs

SF = "/root/testdata/sf0.001"
QUERIES = queries.QUERIES | table_queries.QUERIES | jobs.QUERIES
SQL = queries_sql.SQL | table_queries_sql.SQL | jobs.SQL
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    return sorted("|".join(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert norm(df.collect(), df.columns) == norm(want.fetchall(), want.columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
