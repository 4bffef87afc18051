"""Every query of the listing engine against its SQL counterpart in DuckDB."""

import os

import duckdb
import pytest

from hearthframe import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def same(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    want = duck.sql(queries.ORACLE_SQL[name])
    columns, rows = want.columns, want.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert got and same(got, df.columns) == same(rows, columns)
