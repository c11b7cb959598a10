"""Every query against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

from textloom import queries as q

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        name = f.removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, sql, name):
    df = q.queries()[name](spark, DIR)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name not in q.oracle_sql():
        assert got
        return
    columns = ", ".join(df.columns)
    want = sql.sql(f"SELECT {columns} FROM ({q.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
