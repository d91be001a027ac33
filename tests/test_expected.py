"""Every query against its SQL on DuckDB: names, types and rows."""

import duckdb
import pytest

from cohortlake.plans.oracles import oracle_texts
from cohortlake.plans.queries import MATCHED_QUERIES, all_queries
from cohortlake.sources.bindings import BASE_TABLES

DUCK_TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


# Fits with several factors need more rows than the smallest tables have.
LARGER = {"severity_model_equations": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def duck(small_dir):
    def on(folder):
        con = duckdb.connect()
        for table in BASE_TABLES:
            con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
        return con

    return {folder: on(folder) for folder in (small_dir, *LARGER.values())}


def sort_key(row):
    return tuple((value is not None, str(value)) for value in row)


@pytest.mark.parametrize("name", sorted(oracle_texts()))
def test_same_rows(spark, duck, small_dir, name):
    folder = LARGER.get(name, small_dir)
    df = all_queries()[name](spark, folder)
    expected = duck[folder].sql(oracle_texts()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {c: DUCK_TYPES[t] for c, t in df.dtypes} == types
    places = [expected.columns.index(c) for c in columns]
    want = sorted((tuple(row[i] for i in places) for row in expected.fetchall()), key=sort_key)
    got = sorted((tuple(row) for row in df.select(columns).collect()), key=sort_key)
    assert got == want


def test_only_model_fits_lack_sql():
    without = set(all_queries()) - set(oracle_texts())
    assert without == {"propensity_score", *MATCHED_QUERIES}


def test_entry(spark):
    import __spark_entry__ as driver

    df = driver.entry(spark)
    assert "estimate" in df.columns and df.count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
