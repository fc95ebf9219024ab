"""Look-ups by key: results, and how much of the table they read."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.sources import key_index

BUCKETS = 4
ROWS = 60_000


def rows_scanned(frame):
    """Rows that the scans of ``frame`` handed on, before any filter on rows."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Keys k0, k1, ... of one row each; users are spread at random over the table."""
    key = F.concat(F.lit("k"), F.sha2(F.col("id").cast("string"), 256))
    user = F.concat(F.lit("u"), F.sha2((F.col("id") * 7919 % ROWS).cast("string"), 256))
    rows = spark.range(ROWS).select(key.alias("key"), user.alias("user"), F.col("id").alias("n"))
    path = str(tmp_path_factory.mktemp("index") / "t")
    # small groups, as a small table would be one group a file otherwise
    key_index.write_by_key(rows, path, "key", ["user"], buckets=BUCKETS, group_bytes=100_000)
    return path, rows


def test_lookup_finds_the_rows_of_its_keys(spark, table):
    path, rows = table
    all_rows = {r.key: tuple(r) for r in rows.collect()}
    wanted = random.Random(3).sample(sorted(all_rows), 25)
    found = key_index.lookup_values(spark, path, rows.schema, "key", [*wanted, "absent", None], BUCKETS)
    assert found.columns == rows.columns
    assert sorted(map(tuple, found.collect())) == sorted(all_rows[k] for k in wanted)


def test_lookup_reads_few_rows(spark, table):
    path, rows = table
    wanted = [r.key for r in rows.filter("n in (5, 50000)").collect()]
    found = key_index.lookup_values(spark, path, rows.schema, "key", wanted, BUCKETS)
    plain = spark.read.schema(rows.schema).parquet(path).filter(F.col("n") >= 0)
    assert rows_scanned(plain) == ROWS
    assert found.count() == 2 and rows_scanned(found) < ROWS / 10


def test_bloom_filters_skip_groups_of_other_columns(spark, table, tmp_path):
    path, rows = table
    present = [r.user for r in rows.filter("n = 77").collect()]
    absent = ["u" + "7" * 64]  # between the least and the largest user of each group
    assert key_index.lookup_other(spark, path, rows.schema, "user", present).count() == 1
    nothing = key_index.lookup_other(spark, path, rows.schema, "user", absent)
    assert nothing.count() == 0
    without = str(tmp_path / "plain")
    key_index.write_by_key(rows, without, "key", (), buckets=BUCKETS, group_bytes=100_000)
    blind = key_index.lookup_other(spark, without, rows.schema, "user", absent)
    assert rows_scanned(nothing) < ROWS / 10 < rows_scanned(blind)


def test_many_keys_are_joined_with_the_same_rows(spark, table):
    path, rows = table
    asked = rows.filter("n % 100 = 3").select("key").union(spark.createDataFrame([(None,), ("x",)], "key string"))
    few = key_index.lookup_keys(path, rows.schema, "key", asked, BUCKETS)
    many = key_index.lookup_keys(path, rows.schema, "key", asked, BUCKETS, most=10)
    assert few.columns == many.columns == rows.columns
    expected = sorted(map(tuple, rows.filter("n % 100 = 3").collect()))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == expected


def test_hot_key_nulls_and_empty_tables(spark, tmp_path):
    hot = [("hot", i) for i in range(4000)] + [(None, 1), ("", 2), ("cold", 3)]
    rows = spark.createDataFrame(hot, "key string, n long")
    path = str(tmp_path / "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if it were large
    try:
        key_index.write_by_key(rows, path, "key", then=["n"], buckets=BUCKETS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = key_index.lookup_values(spark, path, rows.schema, "key", ["hot"], BUCKETS)
    assert found.count() == 4000
    per_file = [r[0] for r in found.groupBy(F.input_file_name()).count().select("count").collect()]
    assert max(per_file) < 4000  # one task does not write all of it
    assert key_index.lookup_values(spark, path, rows.schema, "key", ["", None], BUCKETS).collect() == [("", 2)]
    assert key_index.read_buckets(spark, path, rows.schema).count() == len(hot)
    assert key_index.lookup_values(spark, path, rows.schema, "key", [None], BUCKETS).count() == 0
    empty = str(tmp_path / "empty")
    key_index.write_by_key(rows.limit(0), empty, "key", buckets=BUCKETS)
    assert key_index.lookup_values(spark, empty, rows.schema, "key", ["hot"], BUCKETS).count() == 0
