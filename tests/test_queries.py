"""Every registered query with SQL, against DuckDB on the small tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from check_queries import TABLES, as_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    result = con.execute(contract.oracle_sql()[name])
    want = as_rows([d[0] for d in result.description], result.fetchall())
    assert as_rows(df.columns, df.collect()) == want


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 2
