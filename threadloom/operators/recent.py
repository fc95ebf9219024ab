"""Tables in slices of time, so the newest rows are found without reading the others."""

from pyspark.sql import functions as F

SLICE_ROWS = 1_000_000


def write_by_time(rows, path, time, size=SLICE_ROWS):
    """Write ``rows`` in slices of about ``size`` rows, slice 0 the newest, and what each holds.

    Rows of one time are in one slice; those without a time are the oldest.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/landed")
    landed = spark.read.schema(rows.schema).parquet(f"{path}/landed")
    count = max(1, -(-landed.count() // size))
    ranged = landed.repartitionByRange(count, F.col(time).desc_nulls_last())
    sliced = ranged.withColumn("slice", F.spark_partition_id())
    sliced.write.mode("overwrite").partitionBy("slice").parquet(f"{path}/slices")
    written = spark.read.schema(f"{rows.schema.toDDL()}, slice int").parquet(f"{path}/slices")
    held = written.groupBy("slice").agg(F.count("*").alias("rows"))
    held.coalesce(1).write.mode("overwrite").json(f"{path}/held")


def slices_of(spark, path, k):
    """The slices that hold the newest ``k`` rows; reads one row for each slice."""
    held = spark.read.schema("slice int, rows bigint").json(f"{path}/held").orderBy("slice").collect()
    wanted, found = [], 0
    for row in held:
        if found >= k:
            break
        wanted.append(row["slice"])
        found += row["rows"]
    return wanted


def newest(spark, path, schema, time, key, k):
    """The newest ``k`` rows, ties by ``key``: only their slices are opened."""
    folders = [f"{path}/slices/slice={number}" for number in slices_of(spark, path, k)]
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*folders)
    return rows.orderBy(F.col(time).desc_nulls_last(), key).limit(k)
