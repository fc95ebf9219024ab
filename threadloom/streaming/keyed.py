"""Tables with a unique key: a base in buckets of the key's hash and a tail of batches.

Each batch appends its rows to the tail, so its cost follows the batch. A merge folds the tail
into the base and rewrites only the buckets that the tail touches; a manifest written last names
the folder of each bucket and the last folded batch of each stream. Readers open the buckets of
the keys they ask for, and the tail's folders of these buckets. Tables stay readable while they
are merged: new versions lie beside the old ones.
"""

import time

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadloom.operators.skew import first_per_key
from threadloom.session import path_exists, remove_path
from threadloom.streaming import commits

REJECT = "key string, value string"
MANIFEST = "bucket int, folder string, query string, batch_id bigint, version bigint"
BUCKETS = 64  # a bucket is rewritten by one task: take as many as keep it to a few 100 MB


class KeyedTable:
    """For each key the row stored first, or stored last with ``newest``.

    ``order`` breaks ties between rows of one batch, the first in order counts. Rows without a
    key are not stored. ``buckets`` must stay as it was when the table was made.
    """

    def __init__(self, path, schema, key, order, buckets=BUCKETS, newest=False):
        self.path, self.key, self.order, self.buckets, self.newest = path, key, order, buckets, newest
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.stored = f"{self.schema.toDDL()}, storedAt bigint, storedBy bigint"

    def bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _first(self, rows, *partition):
        """One row of each key: of the first or last batch, then by order."""
        at = [F.desc(c) if self.newest else F.col(c) for c in ("storedAt", "storedBy")]
        return first_per_key(rows, [*partition, self.key], [*at, *self.order])

    def append(self, rows, batch, now_ms=None):
        """Write the rows of one batch, each key once, to the tail; they count on its commit."""
        at = int(time.time() * 1000) if now_ms is None else now_ms
        when = [F.lit(v).cast("bigint").alias(c) for c, v in (("storedAt", at), ("storedBy", batch.batch_id))]
        fresh = rows.select(*self.schema.fieldNames(), *when)
        first = self._first(fresh.filter(F.col(self.key).isNotNull()))
        named = first.withColumn("bucket", self.bucket())
        named.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(batch.folder("tail"))

    # --- manifest ---------------------------------------------------------------

    def _manifest(self, spark):
        """(version, {bucket: folder}, {query: last folded batch}); at most buckets + streams rows."""
        if not path_exists(spark, f"{self.path}/manifests"):
            return 0, {}, {}
        rows = spark.read.schema(MANIFEST).json(f"{self.path}/manifests")
        last = rows.agg(F.max("version")).first()[0]
        named = rows.filter(F.col("version") == last).collect()
        folders = {r["bucket"]: r["folder"] for r in named if r["bucket"] is not None}
        folded = {r["query"]: r["batch_id"] for r in named if r["query"] is not None}
        return last, folders, folded

    def _waiting(self, spark, folded):
        """Records of the batches not folded in yet: those since the last merge."""
        records = commits.open_records(spark, self.path).collect()
        return [r for r in records if r["batch_id"] > folded.get(r["query"], -1)]

    def _tail(self, spark, waiting):
        """Rows of the tail's folders, with their bucket."""
        places = [f"{self.path}/tail/{commits.place(record)}" for record in waiting]
        return self._tail_of(spark, places)

    def _tail_of(self, spark, places):
        # a batch without good rows has no folder of any bucket
        places = [place for place in places if path_exists(spark, place)]
        schema = f"{self.stored}, bucket int"
        if not places:
            return spark.createDataFrame([], schema)
        parts = spark.read.schema(f"{schema}, {commits.PLACE}").option("basePath", f"{self.path}/tail")
        return parts.parquet(*places).drop(*commits.KEYS)

    def _base(self, spark, folders, wanted):
        found = [f"{self.path}/base/{folders[b]}/bucket={b}" for b in wanted if b in folders]
        if not found:
            return spark.createDataFrame([], self.stored)
        return spark.read.schema(self.stored).parquet(*found)

    # --- reading ----------------------------------------------------------------

    def _read(self, spark, wanted):
        _, folders, folded = self._manifest(spark)
        tail = self._tail(spark, self._waiting(spark, folded)).filter(F.col("bucket").isin(list(wanted)))
        return self._base(spark, folders, wanted).unionByName(tail.drop("bucket"))

    def rows(self, spark):
        """The whole table."""
        return self._first(self._read(spark, range(self.buckets))).drop("storedAt", "storedBy")

    def lookup(self, spark, keys):
        """Rows of the keys in ``keys``; reads only the folders of their buckets."""
        asked = keys.select(self.key).dropna().distinct()
        wanted = [r[0] for r in asked.select(self.bucket()).distinct().collect()]  # at most buckets
        found = self._read(spark, wanted).join(asked, self.key, "left_semi")
        return self._first(found).drop("storedAt", "storedBy")

    def tail_rows(self, spark):
        """What committed batches have brought since the last merge, copies included."""
        _, _, folded = self._manifest(spark)
        return self._tail(spark, self._waiting(spark, folded)).drop("bucket", "storedAt", "storedBy")

    # --- merging ----------------------------------------------------------------

    def merge(self, spark):
        """Fold the tail into the base; returns the buckets that were rewritten."""
        version, folders, folded = self._manifest(spark)
        waiting = self._waiting(spark, folded)
        if not waiting:
            return []
        tail = self._tail(spark, waiting)
        touched = sorted(r[0] for r in tail.select("bucket").distinct().collect())  # at most buckets
        name = f"version={version + 1}"
        if touched:
            base = self._base(spark, folders, touched).withColumn("bucket", self.bucket())
            # one task for a bucket, its rows sorted by key, so row groups can be skipped
            dealt = base.unionByName(tail).repartition(len(touched), "bucket")
            kept = self._first(dealt, "bucket").sortWithinPartitions("bucket", self.key)
            kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/{name}")
        self._before_manifest(spark, version, waiting)
        folders |= dict.fromkeys(touched, name)
        for record in waiting:
            folded[record["query"]] = max(folded.get(record["query"], -1), record["batch_id"])
        rows = [(b, f, None, None, version + 1) for b, f in folders.items()]
        rows += [(None, None, q, b, version + 1) for q, b in folded.items()]
        manifest = spark.createDataFrame(rows, MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").json(f"{self.path}/manifests/{name}")
        return touched

    def _before_manifest(self, spark, version, waiting):
        """What else a merge of the batches ``waiting`` writes before its manifest."""

    def drop_folded(self, spark):
        """Remove what the last manifest no longer needs: folded batches, old versions.

        Records and rejects of folded batches are first put together in one folder. Not while a
        reader that began before the last merge is still at work.
        """
        version, folders, folded = self._manifest(spark)
        records = commits.open_records(spark, self.path)
        old = [r for r in records.collect() if r["batch_id"] <= folded.get(r["query"], -1)]
        if not old:
            return
        named = spark.createDataFrame(old, records.schema)
        rejects = commits.committed_rows(spark, self.path, "rejects", REJECT, named)
        rejects.write.mode("overwrite").json(f"{self.path}/rejected/version={version}")
        named.coalesce(1).write.mode("overwrite").json(f"{self.path}/history/version={version}")
        for record in old:
            for kind in ("commits", "tail", "counts", "rejects", "work"):
                remove_path(spark, f"{self.path}/{kind}/{commits.place(record)}")
        for number in range(1, version):
            remove_path(spark, f"{self.path}/manifests/version={number}")
            remove_path(spark, f"{self.path}/counted/version={number}")
            if f"version={number}" not in folders.values():
                remove_path(spark, f"{self.path}/base/version={number}")

    def rejected(self, spark):
        """Raw messages that could not be stored, of all committed batches."""
        fresh = commits.committed_rows(spark, self.path, "rejects", REJECT, commits.open_records(spark, self.path))
        if not path_exists(spark, f"{self.path}/rejected"):
            return fresh
        return fresh.unionByName(spark.read.schema(REJECT).json(f"{self.path}/rejected").select("key", "value"))


class CountedTable(KeyedTable):
    """A KeyedTable that also keeps the number of its keys for each value of ``group``.

    A batch adds the counts of the keys the table does not have yet, so rows delivered again
    are not counted again; a merge adds up what waiting batches brought. Rows of a key that
    is stored never change their group.
    """

    def __init__(self, path, schema, key, order, group, buckets=BUCKETS):
        super().__init__(path, schema, key, order, buckets)
        self.group = group
        self.counted = f"{self.schema.fields[self.schema.fieldNames().index(group)].name} string, rows bigint"

    def append(self, rows, batch, now_ms=None):
        super().append(rows, batch, now_ms)
        spark = rows.sparkSession
        own = self._tail_of(spark, [batch.folder("tail")]).select(self.key, self.group)
        known = self.lookup(spark, own).select(self.key)
        fresh = own.join(known, self.key, "left_anti")
        counts = fresh.groupBy(F.col(self.group).cast("string").alias(self.group)).agg(F.count("*").alias("rows"))
        counts.write.mode("overwrite").parquet(batch.folder("counts"))

    def _counts(self, spark, version, waiting):
        paths = [f"{self.path}/counted/version={version}"]
        paths += [f"{self.path}/counts/{commits.place(record)}" for record in waiting]
        found = [path for path in paths if path_exists(spark, path)]
        if not found:
            return spark.createDataFrame([], self.counted)
        parts = spark.read.schema(self.counted).parquet(*found)
        return parts.groupBy(self.group).agg(F.sum("rows").alias("rows"))

    def counts(self, spark):
        """(group, rows): stored keys for each group, of all committed batches."""
        version, _, folded = self._manifest(spark)
        return self._counts(spark, version, self._waiting(spark, folded))

    def _before_manifest(self, spark, version, waiting):
        self._counts(spark, version, waiting).write.mode("overwrite").parquet(
            f"{self.path}/counted/version={version + 1}"
        )
