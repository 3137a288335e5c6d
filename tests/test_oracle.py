"""Every query against its SQL twin in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from plumbspark.plans.table_queries import QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DUCK_TYPES = {"long": "BIGINT", "integer": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason=f"no {FOLDER}")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def normal(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    result = driver.queries()[name](spark, FOLDER)
    columns = sorted(result.columns)
    expected = duck.sql(driver.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {f.name: DUCK_TYPES[f.dataType.typeName()] for f in result.schema} == types
    ours = normal(result.select(*columns).collect())
    theirs = normal(expected.select(", ".join(columns)).fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
    assert ours


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(driver.oracle_sql()) <= set(driver.queries())
