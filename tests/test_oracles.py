"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from caseflow.sources.tables import TABLES
from check import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, connection, name):
    result = compare(spark, connection, FOLDER, name, oracle_sql().get(name))
    assert result.startswith(("ok", "rows")), result


def test_entry(spark):
    assert entry(spark).count() == spark.read.parquet(f"{FOLDER}/orders.parquet").count()


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
