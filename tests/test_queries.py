"""Every registered query against its SQL twin on the given tables."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from threadloom.plans import bridge, oracle, registry

QUERIES = entry_module.queries()
ORACLE = entry_module.oracle_sql()
ORACLE_OF_REFERENCE = oracle.ORACLE
ENTRY_ROWS = 77


@pytest.fixture(scope="module")
def tables(data):
    connection = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def _plain(value):
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(ORACLE_OF_REFERENCE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, data, tables, name):
    frame = QUERIES[name](spark, data)
    expected = tables.execute(ORACLE[name])
    columns = [column[0] for column in expected.description]
    assert sorted(frame.columns) == sorted(columns)
    assert _rows(frame.columns, frame.collect()) == _rows(columns, expected.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() == ENTRY_ROWS


def test_every_given_text_is_in_a_row(spark, data):
    given = {r.text for r in spark.read.parquet(f"{data}/conversations.parquet").select("text").collect()}
    posts = {r.postText for r in bridge.posts(spark, data).collect()}
    titles = {r.title for r in bridge.posts(spark, data).collect()}
    found = posts | {r.commentText for r in bridge.comments(spark, data).collect()}
    assert given <= found and titles <= given
