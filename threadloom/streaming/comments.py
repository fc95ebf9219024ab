"""The live comment flow: prepare and dedupe in the stream, answer per micro-batch."""

import contextlib
import time

from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.functions.identity import event_time
from threadloom.operators import comments as prep
from threadloom.operators import enrich, inference, packing
from threadloom.operators.state import latest_per_key
from threadloom.sinks.writers import publish, write_json
from threadloom.streaming import commits
from threadloom.streaming.keyed import KeyedTable

# what a batch's input is known by; times may be filled in anew
FINGERPRINT = ["commentId", "postId", "userId", "commentText", "postText"]


def prepare_stream(events, now_ms=None, dedupe_within="1 hour"):
    """Validated, cleaned, deduplicated and projected comment events.

    An id is remembered for ``dedupe_within`` of its arrival, so state stays bounded and copies
    are caught across micro-batches too; the copy that arrives first stays. The watermark knows
    arrival times only, so no comment is ever late, whatever time it bears: a backlog, a null
    time or a client's wrong clock loses nothing. A copy that arrives after longer than
    ``dedupe_within`` counts as new. The source's cap per trigger bounds the rows one hot id
    can bring into a task.
    """
    now = (
        F.lit(now_ms).cast("bigint")
        if now_ms is not None
        else F.unix_millis(F.current_timestamp())
    )
    timed = prep.clean_text(prep.validate(events, prep.REQUIRED_STREAM)).withColumn(
        "timestamp", F.coalesce("timestamp", now)
    )
    unique = (
        timed.withColumn("arrivedAt", F.current_timestamp())
        .withWatermark("arrivedAt", dedupe_within)
        .dropDuplicatesWithinWatermark(["commentId"])
        .drop("arrivedAt")
    )
    filled = prep.fill_defaults(unique, 0).withColumn("processedAt", now)
    return prep.project_stream(
        prep.image_features(filled).withColumns(
            {
                "wordCount": prep.text.word_count(F.col("commentText")),
                "charCount": F.length("commentText"),
            }
        )
    )


def land(part, path, spark=None):
    """Rows of a micro-batch, written once and read back through ``spark``.

    A stateful stream runs in a session of its own without adaptive execution, in which each
    later shuffle of the batch would have all shuffle partitions, however few its rows, and no
    skewed join would be split. Flows pass the session that they were started from.
    """
    part.write.mode("overwrite").parquet(path)
    return (spark or part.sparkSession).read.schema(part.schema).parquet(path)


def answer_batch(
    batch, batch_id, out, provider, provider_version, now_ms, topic=None, floor=None, query="none", seen=None,
    spark=None, **limits
):
    """Body of one micro-batch: store cleaned rows, answer them, store and publish replies.

    ``query`` is the identity of the stream. Cleaned rows and replies are written once and read
    back, so the provider is called once per batch and the file and the topic hold the same
    replies. Errors propagate: Spark repeats the batch, and each write replaces its earlier
    attempt, but for answers already stored of the same input. The commit record comes last; a
    batch that has one is left alone. A batch without survivors writes nothing. Comments that
    ``seen`` (see ``seen_comments``) knows of other batches are left out. ``spark`` is as in
    ``land``.
    """
    landed = f"{out}/work/query={query}/batch_id={batch_id}/prepared"
    keyed = batch.withColumn("postKey", packing.post_key(F.col("postText")))
    prepared = land(keyed, landed, spark)
    spark = prepared.sparkSession
    count, mark = commits.fingerprint(prepared, FINGERPRINT)
    done = commits.Batch(spark, out, query, batch_id, mark)
    if seen:
        known = commits.Batch(spark, seen.path, query, batch_id, mark)
        if not known.is_committed():
            # before the record of what is answered, and again if that was all that was done
            prepared = prepared.join(seen.lookup(spark, prepared).select("commentId"), "commentId", "left_anti")
    if not count:
        return
    if done.is_committed():
        return _remember(seen, known, prepared) if seen else None
    write_json(prepared.drop("postKey").select(*batch.columns), done.folder("cleaned"))
    replies = inference.generate_replies(
        packing.as_items(prepared), provider, path=done.folder("work"), floor=floor, resume=True, **limits
    )
    shaped = enrich.as_stream_replies(replies, prepared, provider_version, now_ms)
    write_json(shaped, done.folder("replies"))
    stored = spark.read.schema(schemas.STREAM_REPLY).json(done.folder("replies"))
    messages = enrich.encode_reply_messages(stored)
    if topic is None:
        publish(messages, "json", done.folder("messages"))
    else:
        publish(messages, **topic)
    done.commit(count, 0, count)
    if seen:
        _remember(seen, known, prepared)


def seen_comments(path, buckets=64):
    """Ids of answered comments, kept for ever: a copy costs a look-up in the bucket of its id.

    Copies within ``dedupe_within`` are caught by the stream's own state; this catches those
    that come later, or after the state was lost with its checkpoint.
    """
    return KeyedTable(path, "commentId string", "commentId", ["commentId"], buckets)


def _remember(seen, known, prepared):
    """Keep the batch's ids, after its answers: a batch repeated in between is not its own copy."""
    if not known.is_committed():
        seen.append(prepared.select("commentId"), known)
        known.commit(0, 0, 0)


@contextlib.contextmanager
def shuffle_partitions(spark, partitions):
    """Streams started inside get so many state partitions, which their checkpoint then keeps.

    Every micro-batch opens all of them, so they should fit what the source's cap lets into a
    batch and not what the stream brings in all. None leaves the session's setting.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, before if partitions is None else partitions)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def start(events, checkpoint, body, trigger=None, output_mode="append"):
    """Run ``body(batch, batch_id)`` per micro-batch with a checkpoint.

    The default trigger works off what is there and ends; pass
    ``{"processingTime": "5 seconds"}`` for a live flow.
    """
    return (
        events.writeStream.foreachBatch(body)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_comment_flow(
    events,
    out,
    checkpoint,
    provider,
    provider_version,
    now_ms=None,
    dedupe_within="1 hour",
    trigger=None,
    topic=None,
    floor=None,
    seen=None,
    state_partitions=None,
    **limits,
):
    """The whole live flow from decoded events to published replies.

    ``commits.committed_rows(spark, out, name, schema)`` reads what it wrote: cleaned, replies
    and, without a topic, messages. A new checkpoint may go on in the same ``out``: its batches
    are told from those of the old one. ``state_partitions`` see ``shuffle_partitions``.
    """
    spark = events.sparkSession

    def body(batch, batch_id):
        stamp = now_ms if now_ms is not None else int(time.time() * 1000)
        query = commits.query_id(spark, checkpoint)
        answer_batch(
            batch, batch_id, out, provider, provider_version, stamp, topic, floor, query, seen, spark, **limits
        )

    with shuffle_partitions(spark, state_partitions):
        return start(prepare_stream(events, now_ms, dedupe_within), checkpoint, body, trigger)


def throughput(events, epoch_ms, width="1 minute"):
    """Events per tumbling window; to be run in update mode.

    There is no watermark, so late events count: the state is one row for each window.
    """
    return (
        events.withColumn("eventTime", event_time(epoch_ms))
        .groupBy(F.window("eventTime", width).alias("window"))
        .agg(F.count("*").alias("events"))
        .select(F.unix_millis(F.col("window.start")).alias("minuteMs"), "events")
    )


def start_throughput(events, epoch_ms, log, checkpoint, width="1 minute", trigger=None):
    """Log every change of a window's count; ``window_counts`` reads the latest of each."""

    def body(part, batch_id):
        part.write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")

    return start(throughput(events, epoch_ms, width), checkpoint, body, trigger, "update")


def window_counts(spark, log):
    """Events per window out of the log of ``start_throughput``, the last windows included."""
    logged = spark.read.schema("minuteMs bigint, events bigint, batch_id bigint").parquet(log)
    return latest_per_key(logged, "minuteMs", ["batch_id"]).drop("batch_id")


def start_lookup_flow(comments, table, out, checkpoint, trigger=None):
    """Give arriving comments the context of their posts; comments without a post go apart.

    Each micro-batch looks its posts up in ``table`` (a KeyedTable) as it is then and opens only
    the folders of their keys, so a batch costs what it holds, however large the table is.
    Adaptive execution splits a hot post.
    """

    spark = comments.sparkSession

    def body(part, batch_id):
        query = commits.query_id(spark, checkpoint)
        batch = land(part, f"{out}/work/query={query}/batch_id={batch_id}/comments", spark)
        count, mark = commits.fingerprint(batch, batch.columns)
        done = commits.Batch(spark, out, query, batch_id, mark)
        if not count or done.is_committed():
            return
        posts = table.lookup(spark, batch)
        write_json(enrich.comment_events(batch, posts), done.folder("events"))
        write_json(enrich.orphan_comments(batch, posts), done.folder("orphans"))
        orphans = spark.read.schema(part.schema).json(done.folder("orphans")).count()
        done.commit(count, orphans, count - orphans)

    return start(comments, checkpoint, body, trigger)
