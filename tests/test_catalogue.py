"""Every query of the catalogue against its DuckDB counterpart."""

import os

import duckdb
import pytest

import __spark_entry__
from corpuspack.plans.oracle import ORACLE
from corpuspack.plans.queries import QUERIES

FOLDER = os.environ.get("CORPUSPACK_TEST_DATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in sorted(os.listdir(FOLDER)):
        table = name.removesuffix(".parquet")
        connection.execute(f"create view {table} as select * from read_parquet('{FOLDER}/{name}')")
    return connection


def test_every_query_has_a_counterpart():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted(repr(tuple(v for _, v in sorted(zip(names, row), key=lambda cell: cell[0]))) for row in result.fetchall())
    assert sorted(repr(tuple(row)) for row in df.select(*columns).collect()) == expected
    assert expected


def test_entry_offers_the_catalogue():
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    assert ORACLE.keys() <= __spark_entry__.oracle_sql().keys()


def test_entry_has_a_stable_schema(spark):
    assert __spark_entry__.entry(spark).columns == ["repo", "output", "label", "n_files", "size_bytes", "tokens"]
