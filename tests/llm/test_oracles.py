"""Queries of training data that SQL can express against it: names, types and rows."""

import duckdb
import pytest

from cohortlake.llm.queries import llm_oracles, llm_queries

DUCK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {table} as select * from '{small_dir}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_same_rows(spark, duck, small_dir, name):
    df = llm_queries()[name](spark, small_dir)
    expected = duck.sql(llm_oracles()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {c: DUCK_TYPES[t] for c, t in df.dtypes} == types
    places = [expected.columns.index(c) for c in columns]
    want = sorted((tuple(row[i] for i in places) for row in expected.fetchall()), key=str)
    got = sorted((tuple(row) for row in df.select(columns).collect()), key=str)
    assert len(got) == len(want)
    assert got == want
