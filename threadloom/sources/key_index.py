"""Tables laid out for look-ups: buckets of a key's hash, rows sorted by key, bloom filters.

A look-up opens the folders of its keys' buckets. In these the files' own statistics and bloom
filters tell which row groups can hold a key, so the others are not read. Columns in ``others``
have bloom filters too: they are looked up in all buckets, again without reading most groups.
"""

from pyspark.sql import functions as F

BUCKETS = 64
GROUP_BYTES = 16 * 1024 * 1024  # smaller than usual: a look-up reads at least one group
MOST_VALUES = 1_000  # keys handed to the scan as values; more of them are joined
IN_VALUES = 10  # longer lists reach a scan as a range only


def bucket(key, buckets=BUCKETS):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def write_by_key(rows, path, key, others=(), then=(), buckets=BUCKETS, group_bytes=GROUP_BYTES):
    """Write ``rows`` by ``key``, replacing ``path``; rows without a key are kept in bucket null.

    Tasks get ranges of (bucket, key, *then), so a key with very many rows is spread over
    several tasks and files if ``then`` tells its rows apart.
    """
    named = rows.withColumn("bucket", F.when(F.col(key).isNotNull(), bucket(key, buckets)))
    ranged = named.repartitionByRange("bucket", key, *then).sortWithinPartitions("bucket", key)
    writer = ranged.write.mode("overwrite").partitionBy("bucket").option("parquet.block.size", group_bytes)
    for column in (key, *others):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def read_buckets(spark, path, schema, wanted=None):
    """Rows of the buckets ``wanted``, or of all; only their folders are opened."""
    parts = spark.read.schema(f"{schema.toDDL()}, bucket int").parquet(path)
    chosen = parts if wanted is None else parts.filter(F.col("bucket").isin(list(wanted)))
    return chosen.drop("bucket")


def among(column, values):
    """``column`` is one of ``values``, in pieces that a scan compares with its row groups."""
    pieces = [values[i : i + IN_VALUES] for i in range(0, len(values), IN_VALUES)]
    found = F.lit(False)
    for piece in pieces:
        found = found | F.col(column).isin(piece)
    return found


def lookup_values(spark, path, schema, key, values, buckets=BUCKETS):
    """Rows whose ``key`` is in the list ``values``; nulls among them find nothing."""
    known = sorted({value for value in values if value is not None})
    if not known:
        return spark.createDataFrame([], schema)
    asked = spark.createDataFrame([(v,) for v in known], f"`{key}` {schema[key].dataType.simpleString()}")
    wanted = [r[0] for r in asked.select(bucket(key, buckets)).distinct().collect()]
    return read_buckets(spark, path, schema, wanted).filter(among(key, known))


def lookup_keys(path, schema, key, asked, buckets=BUCKETS, most=MOST_VALUES):
    """Rows whose ``key`` is in the frame ``asked``.

    Up to ``most`` different keys are compared in the scan, more are joined with the buckets
    they fall into; the rows found are the same.
    """
    spark = asked.sparkSession
    keys = asked.select(key).dropna().distinct()
    first = [r[0] for r in keys.limit(most + 1).collect()]
    if len(first) <= most:
        return lookup_values(spark, path, schema, key, first, buckets)
    wanted = [r[0] for r in keys.select(bucket(key, buckets)).distinct().collect()]  # at most buckets
    return read_buckets(spark, path, schema, wanted).join(keys, key, "left_semi").select(*schema.fieldNames())


def lookup_other(spark, path, schema, column, values):
    """Rows whose ``column``, one of ``others``, is in the list ``values``."""
    known = sorted({value for value in values if value is not None})
    return read_buckets(spark, path, schema).filter(among(column, known))
