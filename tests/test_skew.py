import contextlib
import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import quality, skew


def _hot_rows(spark, n=3000):
    """A third of all rows in one group, the rest in many small ones."""
    return spark.range(n).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 97)).alias("g"),
        F.md5(F.col("id").cast("string")).alias("h"),
    )


@pytest.mark.parametrize("floor", [50, 10_000])
def test_positions_equal_brute_force(spark, floor):
    rows = _hot_rows(spark)
    got = skew.with_group_positions(rows, "g", "h", "id", floor).collect()
    groups = {}
    for row in rows.collect():
        groups.setdefault(row.g, []).append((row.h, row.id))
    expected = {
        key: (place, len(members))
        for members in groups.values()
        for place, (_, key) in enumerate(sorted(members), 1)
    }
    assert {row.id: (row.position, row.groupRows) for row in got} == expected


def test_large_groups_are_cut_into_slices(spark):
    rows = _hot_rows(spark)
    plan = skew.with_group_positions(rows, "g", "h", "id", 50)._jdf.queryExecution().toString()
    assert "_slice" in plan
    chunked = skew.chunk_rows(rows, "g", "h", "id", 10, floor=50)
    sizes = chunked.groupBy("g", "chunk").agg(F.count("*").alias("n"), F.max("groupRows").alias("all"))
    # all runs are full but the last of a group
    short = sizes.filter("n < 10 and (chunk + 1) * 10 < all").count()
    assert short == 0 and sizes.agg(F.max("n")).first()[0] == 10


def test_first_per_key_thins_out_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), (1000 - F.col("id")).alias("v"))
    first = skew.first_per_key(rows, ["k"], ["v"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted((r.k, r.v) for r in first.collect()) == sorted(
        (k, min(1000 - i for i in range(1000) if i % 7 == k)) for k in range(7)
    )


def test_left_join_many_equals_left_join(spark):
    left = spark.range(50).select(F.col("id").alias("k"), F.lit("l").alias("a"))
    right = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 90).alias("k"), F.col("id").alias("b")
    )
    got = skew.left_join_many(left, right, "k").collect()
    expected = left.join(right, "k", "left").collect()
    key = lambda r: (r.k, r.b if r.b is not None else -1)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, expected), key=str)
    assert sorted(got, key=key) == sorted(expected, key=key)


@contextlib.contextmanager
def _settings(spark, **values):
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_a_hot_right_key_is_split_over_tasks(spark, tmp_path):
    """A third of all replies answer one comment: the join of their partition is split."""
    left = spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("a"))
    right = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2000).alias("k"),
        F.sha2(F.col("id").cast("string"), 512).alias("b"),
    )
    right.repartition(16).write.parquet(f"{tmp_path}/r")
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    with _settings(spark, **small):
        joined = skew.left_join_many(left, spark.read.parquet(f"{tmp_path}/r"), "k")
        rows = joined.groupBy(F.spark_partition_id().alias("task")).agg(
            F.count_if(F.col("k") == 7).alias("hot"), F.max("b")
        ).collect()
    hot = [row.hot for row in rows if row.hot]
    assert sum(hot) == right.filter("k = 7").count() and len(hot) > 1


def test_left_join_many_shuffles_the_left_side_once(spark, tmp_path):
    spark.range(2000).select(F.col("id").alias("k"), F.lit("wide").alias("a")).write.parquet(f"{tmp_path}/l")
    spark.range(2000).select((F.col("id") % 50).alias("k"), F.lit(1).alias("b")).write.parquet(f"{tmp_path}/r")
    with _settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        left, right = spark.read.parquet(f"{tmp_path}/l"), spark.read.parquet(f"{tmp_path}/r")
        joined = skew.left_join_many(left, right, "k")
        assert len(joined.collect()) == 2000 - 50 + 2000
        final = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ReusedExchange" in final


def test_rate_audit_equals_brute_force(spark):
    random.seed(5)
    # one slot holds a third of all calls inside a single second; ties and exact ends included
    calls = [("0", random.choice([5_000_000, 5_000_001, 5_400_000])) for _ in range(60)]
    calls += [(str(random.randrange(3)), random.randrange(0, 40) * 2_500_000) for _ in range(120)]
    frame = spark.createDataFrame(calls, "slot string, atMicros bigint")
    got = quality.rate_budget_audit(frame, budget=6, window_seconds=10).collect()
    width = 10_000_000
    assert {(r.slot, r.atMicros) for r in got} == set(calls) and len(got) == len(set(calls))
    for row in got:
        inside = [t for s, t in calls if s == row.slot and row.atMicros - width < t <= row.atMicros]
        wait = width - (row.atMicros - min(inside)) + 100_000 if len(inside) > 6 else 0
        assert (row.callsInWindow, row.oldestMicros, row.waitMicros, row.overBudget) == (
            len(inside), min(inside), wait, len(inside) > 6,
        )


def test_rate_audit_spreads_a_slot_over_pieces(spark):
    """One slot, a window as long as all calls: no piece is much above its size, rows as before."""
    random.seed(6)
    calls = sorted({random.randrange(3_600_000_000) for _ in range(6000)})
    frame = spark.createDataFrame([("hot", t) for t in calls], "slot string, atMicros bigint")
    got = quality.rate_budget_audit(frame, budget=100, window_seconds=3600, size=500).collect()
    assert {r.atMicros: (r.callsInWindow, r.oldestMicros) for r in got} == {
        t: (n + 1, calls[0]) for n, t in enumerate(calls)
    }
    pieces = skew.in_pieces(frame, ["slot"], ["atMicros"], 500)
    sizes = [r["count"] for r in pieces.groupBy("piece").count().collect()]
    assert sum(sizes) == 6000 and len(sizes) >= 10 and max(sizes) <= 1000
    short = quality.rate_budget_audit(frame, budget=100, window_seconds=60, size=500).collect()
    for row in random.sample(short, 200):
        inside = [t for t in calls if row.atMicros - 60_000_000 < t <= row.atMicros]
        assert (row.callsInWindow, row.oldestMicros) == (len(inside), inside[0])


def test_rate_audit_of_nothing(spark):
    frame = spark.createDataFrame([], "slot string, atMicros bigint")
    assert quality.rate_budget_audit(frame).collect() == []
