"""Keep key-unique tables up to date from a topic: posts and replies."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from threadloom.streaming import commits
from threadloom.streaming.comments import land, start


def ingest_batch(messages, batch_id, table, decode, rejects, query, now_ms=None, spark=None):
    """Body of one micro-batch: good rows to the table's tail, the others apart, a record last.

    ``decode`` and ``rejects`` share the messages between them: each message is either decoded
    into one row or rejected. Returns the batch's (messages, rejected, stored), or None if an
    earlier attempt has committed it. ``spark`` is as in ``comments.land``.
    """
    key = F.col("key").cast("string") if "key" in messages.columns else F.lit(None).cast("string")
    raw = messages.select(key.alias("key"), F.col("value").cast("string").alias("value"))
    landed = f"{table.path}/work/query={query}/batch_id={batch_id}"
    stored = land(raw, f"{landed}/messages", spark)
    spark = stored.sparkSession
    count, mark = commits.fingerprint(stored, ["key", "value"])
    batch = commits.Batch(spark, table.path, query, batch_id, mark)
    if not count or batch.is_committed():
        return None
    good = decode(stored)
    table.append(good, batch, now_ms)
    bad = Observation()
    apart = rejects(stored).select("key", "value").observe(bad, F.count(F.lit(1)).alias("rows"))
    apart.write.mode("overwrite").json(batch.folder("rejects"))
    counts = count, bad.get["rows"], good.count()
    batch.commit(*counts)
    return counts


def start_table_ingest(messages, table, decode, rejects, checkpoint, trigger=None, merge_every=None):
    """Feed ``table`` (a KeyedTable) from messages with a ``value``, and a ``key`` if they have one.

    The cost of a batch depends on the batch alone, however large the table has grown. Each
    ``merge_every`` batches the tail is merged into the base and what was folded is removed.
    ``commits.committed`` of the table's path has messages, rejected and stored rows of each
    batch, ``table.rejected`` the raw values of what could not be stored.
    """

    spark = messages.sparkSession

    def body(part, batch_id):
        query = commits.query_id(spark, checkpoint)
        ingest_batch(part, batch_id, table, decode, rejects, query, spark=spark)
        if merge_every and batch_id % merge_every == merge_every - 1:
            table.merge(spark)
            table.drop_folded(spark)

    return start(messages, checkpoint, body, trigger)

