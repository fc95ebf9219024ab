"""Registered queries: every operator over whole given tables.

Each takes (spark, sf_dir) and returns a DataFrame. Frames that feed several passes are
written once with ``materialize``, as a job would do.
"""

import collections
import hashlib
import time

from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.fixed_values import FEED_SIZE, LIVE_BUFFER_SIZE
from threadloom.functions import identity, prompts, text
from threadloom.functions import replies as parsing
from threadloom.operators import (
    comments as prep,
    enrich,
    inference,
    packing,
    quality,
    recent,
    skew,
    state,
    views,
)
from threadloom.operators.inference import offline_provider
from threadloom.plans import batch, bridge
from threadloom.plans.bridge import NOW_MS, PROVIDER_VERSION
from threadloom.session import materialize, scratch_dir
from threadloom.sinks import writers
from threadloom.sources import json_array, key_index, readers, streams
from threadloom.streaming import comments as live
from threadloom.streaming import commits, tables
from threadloom.streaming.keyed import CountedTable, KeyedTable

QUERIES = {}

AUDIT_SECONDS, AUDIT_BUDGET = 3600, 5
KEY_SLOTS = 3
NEWEST_USERS = 12
STATE_PARTITIONS = 24  # of the live flows, whose batches are at most 16 files of a topic


def query(function):
    QUERIES[function.__name__] = function
    return function


def _jobs(spark, sf):
    return state.latest_per_key(bridge.job_events(spark, sf), "jobId", ["uploadedAt", "event_id"])


def _filled(spark, sf):
    return prep.fill_defaults(bridge.comments(spark, sf), NOW_MS).drop("conv_id", "turn")


def _items(spark, sf):
    """Items stored with their post key, as a job stores them."""
    return materialize(packing.with_post_key(bridge.items(spark, sf)), "items")


def _packed(spark, sf):
    return materialize(packing.pack_calls(_items(spark, sf)), "packed")


def _document_summary(posts):
    size = F.coalesce(F.size("comments"), F.lit(-1))
    return posts.select(
        "postId", "username", "title", "postText", "subreddit", "imageUrl", "imageCaption",
        "timestamp",
        F.when(F.col("comments").isNull(), -1).otherwise(size).alias("comments"),
        F.coalesce(
            F.aggregate(
                "comments",
                F.lit(0),
                lambda total, c: total + F.coalesce(F.length(c["commentText"]), F.lit(0)),
            ),
            F.lit(0),
        ).alias("commentChars"),
    )


# --- sources -----------------------------------------------------------------


@query
def scan_nested_posts(spark, sf):
    path = scratch_dir(spark, "nested")
    writers.write_json(bridge.nested_posts(spark, sf), path)
    return _document_summary(readers.read_nested_posts(spark, path))


@query
def scan_array_posts(spark, sf):
    """Nested posts out of files that each hold JSON arrays on one line, cut at any brace."""
    path = scratch_dir(spark, "arrays")
    posts = bridge.nested_posts(spark, sf).select("postId", F.to_json(F.struct("*")).alias("value"))
    # an upload is one array; arrays of a few hundred posts stand for a larger one
    arrays = posts.groupBy(F.ceil(F.xxhash64("postId") / 2**56)).agg(F.array_join(F.collect_list("value"), " , ").alias("v"))
    arrays.select(F.concat(F.lit("["), "v", F.lit("]"))).write.text(path)
    return _document_summary(json_array.read_array(spark, path, schemas.NESTED_POST))


@query
def decode_events(spark, sf):
    events = bridge.load(spark, sf, "events")
    return events.select(
        "event_id", F.from_json(F.col("props").cast("binary").cast("string"), "k bigint").alias("d")
    ).select("event_id", "d.k")


def _event_rows(spark, sf):
    """Raw comments in the shape of comment events."""
    fields = [c for c in schemas.COMMENT_EVENT.fieldNames() if c != "metadata"]
    return bridge.comments(spark, sf).select(
        *fields, F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("metadata")
    )


def _event_messages(spark, sf):
    """Comment events as JSON, and an undecodable message next to each."""
    good = enrich.encode_comment_events(_event_rows(spark, sf))
    bad = good.select("key", F.substring_index("value", ":", 1).alias("value"))
    return good.unionByName(bad)


def _event_columns(events):
    return events.withColumn("turn", F.col("metadata")["turn"]).drop("metadata")


@query
def decode_comment_events(spark, sf):
    return _event_columns(readers.decode_comment_events(_event_messages(spark, sf)))


def _stream_to_table(spark, frame, label):
    """Run a stream over what is there into a parquet folder and read it."""
    out, checkpoint = scratch_dir(spark, label), scratch_dir(spark, f"{label}-checkpoint")
    run = (
        frame.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    run.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def _write_messages(messages, path, mode="append"):
    messages.select("value").write.mode(mode).text(path)


@query
def stream_comment_source(spark, sf):
    path = scratch_dir(spark, "comment-topic")
    _write_messages(_event_messages(spark, sf), path)
    events = streams.comment_stream(spark, source="text", path=path, maxFilesPerTrigger=4)
    return _stream_to_table(spark, _event_columns(events), "comment-events")


def _posts(spark, sf):
    return bridge.posts(spark, sf).drop("conv_id")


@query
def stream_post_source(spark, sf):
    path = scratch_dir(spark, "post-topic")
    posts = _posts(spark, sf)
    _write_messages(enrich.as_messages(posts, "postId", posts.columns), path)
    events = streams.post_stream(spark, source="text", path=path, maxFilesPerTrigger=4)
    return _stream_to_table(spark, events, "post-events")


def _enriched(spark, sf):
    return enrich.enrich_with_replies(
        bridge.cleaned(spark, sf), bridge.replies_written(spark, sf)
    )


@query
def scan_results_tolerant(spark, sf):
    path = scratch_dir(spark, "results")
    writers.write_json(_enriched(spark, sf), path)
    results = readers.read_results(spark, path)
    # blank and cut-off lines for every result, in files next to the good ones
    cut_off = F.concat(F.lit('{"commentId":"'), "commentId")
    broken = results.select(F.explode(F.array(F.lit(""), F.lit("  "), cut_off)).alias("value"))
    broken.write.mode("append").text(path)
    return readers.read_results(spark, path, glob="*")


@query
def scan_glob_filter(spark, sf):
    path = scratch_dir(spark, "results")
    results = _enriched(spark, sf)
    writers.write_json(results, path)
    results.select(F.to_json(F.struct("commentId", "postId")).alias("value")).write.mode(
        "append"
    ).text(path)
    return readers.read_results(spark, path)


@query
def decode_replies(spark, sf):
    replies = bridge.replies(spark, sf)
    some = lambda n: identity.hash_bucket(F.col("commentId"), n) != 0
    messages = replies.select(
        F.to_json(
            F.struct(
                F.when(some(5), F.col("replyId")).alias("replyId"),
                "commentId",
                F.when(some(6), F.col("postId")).alias("postId"),
                F.when(some(4), F.col("generatedReply")).alias("generatedReply"),
                F.when(some(7), F.col("timestamp")).alias("timestamp"),
            )
        ).alias("value")
    )
    return readers.decode_replies(messages, NOW_MS)


@query
def scan_state_tables(spark, sf):
    root = scratch_dir(spark, "tables")
    state_tables = {
        "users": (bridge.users(spark, sf), "userId", "username", "createdAt"),
        "posts": (_posts(spark, sf), "postId", "userId", "createdAt"),
        "comments": (bridge.comments_table(spark, sf), "commentId", "userId", "createdAt"),
        "replies": (bridge.replies(spark, sf), "replyId", "commentId", "timestamp"),
        "batch_jobs": (_jobs(spark, sf), "jobId", "status", "uploadedAt"),
    }
    rows = None
    for name, (frame, key, label, at) in state_tables.items():
        frame.write.parquet(f"{root}/{name}")
        part = readers.read_table(spark, f"{root}/{name}").select(
            F.lit(name).alias("tableName"),
            F.col(key).alias("key"),
            F.col(label).alias("label"),
            F.col(at).alias("at"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


# --- sinks and state ---------------------------------------------------------


@query
def sink_json_overwrite(spark, sf):
    path = scratch_dir(spark, "cleaned")
    cleaned = bridge.cleaned(spark, sf)
    writers.write_json(cleaned.withColumn("commentText", F.lit("replaced below")), path)
    writers.write_json(cleaned, path)
    return spark.read.schema(schemas.CLEANED_BATCH).json(path)


def _offline_replies(items):
    return items.select("id", parsing.offline_reply(F.col("id")).alias("generated_reply"))


def _generated(spark, sf):
    cleaned = batch.preprocess_events(bridge.comments(spark, sf), NOW_MS)
    replies = _offline_replies(packing.as_items(cleaned)).withColumns(
        {"latency_ms": F.lit(0), "status": F.lit("ok")}
    )
    return enrich.as_stream_replies(replies, cleaned, PROVIDER_VERSION, NOW_MS)


@query
def encode_reply_messages(spark, sf):
    return enrich.encode_reply_messages(_generated(spark, sf))


def _stored_posts(spark, sf):
    """Posts with text: a post without text is never stored."""
    return _posts(spark, sf).filter("postText is not null")


@query
def encode_comment_events(spark, sf):
    return enrich.encode_comment_events(
        enrich.comment_events(bridge.comments_table(spark, sf), _stored_posts(spark, sf))
    )


@query
def insert_or_ignore(spark, sf):
    replies = bridge.replies(spark, sf)
    target = replies.filter(identity.hash_bucket(F.col("commentId"), 2) == 0)
    again = replies.withColumns(
        {"generatedReply": F.upper("generatedReply"), "timestamp": F.col("timestamp") + 1}
    )
    incoming = replies.unionByName(again)
    path = scratch_dir(spark, "replies")
    target.write.parquet(path)
    writers.append_new_rows(spark, incoming, path, "replyId", ["timestamp", "generatedReply"])
    return spark.read.schema(target.schema).parquet(path)


@query
def latest_status_by_key(spark, sf):
    return _jobs(spark, sf)


@query
def export_job_results(spark, sf):
    path = scratch_dir(spark, "export")
    writers.export_job_results(_enriched(spark, sf), path)
    return readers.read_results(spark, path)


@query
def land_raw_posts(spark, sf):
    path = writers.land_raw_posts(
        bridge.nested_posts(spark, sf), scratch_dir(spark, "raw"), "job1"
    )
    return _document_summary(spark.read.schema(schemas.NESTED_POST).parquet(path))


@query
def job_failure_event(spark, sf):
    broken = bridge.job_events(spark, sf).filter("status = 'failed'")
    message = F.concat(F.lit("job broke at event "), F.col("event_id").cast("string"))
    return state.failure_events(broken, message)


@query
def changed_rows(spark, sf):
    events = bridge.job_events(spark, sf)
    first = skew.first_per_key(events, ["jobId"], ["uploadedAt", "event_id"])
    compared = ["status", "totalRecords", "processedRecords"]
    return state.changed_rows(_jobs(spark, sf), first, "jobId", compared)


# --- preparation -------------------------------------------------------------


@query
def explode_comments(spark, sf):
    return prep.explode_comments(bridge.nested_posts(spark, sf))


@query
def validate_batch(spark, sf):
    return prep.validate(bridge.comments(spark, sf), prep.REQUIRED_BATCH)


@query
def validate_stream(spark, sf):
    events = bridge.comments(spark, sf).withColumn(
        "userId", F.when(F.col("turn") % 4 != 3, F.col("userId"))
    )
    return prep.validate(events, prep.REQUIRED_STREAM)


@query
def drop_empty_after_clean(spark, sf):
    return prep.drop_empty_after_clean(prep.validate(bridge.comments(spark, sf)))


@query
def clean_text(spark, sf):
    return prep.clean_text(prep.validate(bridge.comments(spark, sf))).drop("conv_id", "turn")


@query
def null_defaults(spark, sf):
    return _filled(spark, sf)


@query
def dedupe_comments(spark, sf):
    return prep.dedupe_comments(_filled(spark, sf))


@query
def image_features(spark, sf):
    return prep.image_features(_filled(spark, sf)).select(
        "commentId", "imageUrl", "imageCaption", "hasImage", "hasCaption"
    )


@query
def text_features(spark, sf):
    comments = prep.clean_text(prep.validate(bridge.comments(spark, sf)))
    return prep.reply_flag(prep.text_features(comments, NOW_MS)).select(
        "commentId", "wordCount", "charCount", "processedAt", "isReply"
    )


def _featured(spark, sf):
    with_text = _filled(spark, sf).filter("commentText is not null")
    return prep.text_features(prep.image_features(with_text), NOW_MS)


@query
def project_batch(spark, sf):
    return prep.project_batch(_featured(spark, sf))


@query
def project_stream(spark, sf):
    return prep.project_stream(_featured(spark, sf))


@query
def preprocess_batch(spark, sf):
    return batch.preprocess_batch(bridge.nested_posts(spark, sf), NOW_MS)


@query
def preprocess_stream(spark, sf):
    return batch.preprocess_events(bridge.comments(spark, sf), NOW_MS)


@query
def size_partitions(spark, sf):
    events = bridge.load(spark, sf, "events").select("event_id")
    rows = events.count()
    spread = prep.size_partitions(events, rows).groupBy(F.spark_partition_id().alias("part"))
    return spread.agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("rows"), F.count("*").alias("partitions")
    )


# --- joins and views ---------------------------------------------------------


@query
def enrich_with_replies(spark, sf):
    return _enriched(spark, sf)


@query
def reply_metadata_lookup(spark, sf):
    answered = bridge.comments_table(spark, sf).select(
        "commentId", parsing.offline_reply(F.col("commentId")).alias("generatedReply")
    )
    return enrich.with_reply_metadata(answered, bridge.cleaned(spark, sf))


@query
def enrich_comment_with_post(spark, sf):
    return enrich.comment_events(
        bridge.comments_table(spark, sf), _stored_posts(spark, sf)
    ).drop("metadata")


@query
def reject_orphan_comments(spark, sf):
    return enrich.orphan_comments(bridge.comments_table(spark, sf), _stored_posts(spark, sf))


@query
def feed_with_counts(spark, sf):
    return views.feed_with_counts(
        _posts(spark, sf), bridge.comments_table(spark, sf), bridge.replies(spark, sf)
    )


@query
def feed_pruned(spark, sf):
    """The feed out of posts kept in slices of time: only the newest slices are opened."""
    posts, path = _posts(spark, sf), scratch_dir(spark, "posts-by-time")
    recent.write_by_time(posts, path, "createdAt", size=FEED_SIZE)
    newest = recent.newest(spark, path, posts.schema, "createdAt", "postId", FEED_SIZE)
    return views.feed_with_counts(newest, bridge.comments_table(spark, sf), bridge.replies(spark, sf))


@query
def feed_from_state(spark, sf):
    """The feed with counts kept up to date by the comment and reply streams.

    Both topics come in two runs, the second one with all messages again; tables are merged in
    between.
    """
    state_of = {}
    for name, rows, key, time in (
        ("commentCount", bridge.comments_table(spark, sf), "commentId", "createdAt"),
        ("replyCount", bridge.replies(spark, sf), "replyId", "timestamp"),
    ):
        table = CountedTable(scratch_dir(spark, name), rows.schema, key, [time], "postId", buckets=8)
        path, checkpoint = scratch_dir(spark, f"{name}-topic"), scratch_dir(spark, "checkpoint")
        messages = enrich.as_messages(rows, key, rows.columns)
        found = lambda m, of=rows.schema, key=key: readers.decode(m, of).filter(F.col(key).isNotNull())
        bad = lambda m, of=rows.schema, key=key: m.filter(F.from_json("value", of)[key].isNull())
        for delivery in (_half(messages, 0), messages):
            _write_messages(delivery, path)
            _ingest(spark, path, table, (found, bad), checkpoint=checkpoint)
            if not state_of.get(name):
                table.merge(spark)
                table.drop_folded(spark)
            state_of[name] = table
    posts = _posts(spark, sf).orderBy(F.col("createdAt").desc(), "postId").limit(FEED_SIZE)
    for name, table in state_of.items():
        posts = posts.join(table.counts(spark).withColumnRenamed("rows", name), "postId", "left").fillna(0, [name])
    return posts


@query
def counts_per_post(spark, sf):
    return views.counts_per_post(
        _posts(spark, sf).select("postId"),
        bridge.comments_table(spark, sf),
        bridge.replies(spark, sf),
    )


@query
def merge_live_replies(spark, sf):
    replies = bridge.replies(spark, sf)
    live_copy = replies.filter(identity.hash_bucket(F.col("commentId"), 3) == 0).withColumn(
        "generatedReply", F.upper("generatedReply")
    )
    return views.merge_live_replies(live_copy, replies)


@query
def thread_view(spark, sf):
    return views.thread_view(bridge.comments_table(spark, sf), bridge.replies(spark, sf))


@query
def fk_violations(spark, sf):
    return state.fk_violations(
        bridge.users(spark, sf), _stored_posts(spark, sf), bridge.comments_table(spark, sf)
    )


@query
def pk_violations(spark, sf):
    comments = bridge.comments(spark, sf)
    return state.pk_violations(
        [
            (bridge.users(spark, sf), "userId", "users.userId"),
            (bridge.posts(spark, sf), "username", "users.username"),
            (bridge.posts(spark, sf), "postId", "posts.postId"),
            (comments, "commentId", "comments.commentId"),
            (bridge.replies(spark, sf), "replyId", "replies.replyId"),
            (bridge.job_events(spark, sf), "jobId", "batch_jobs.jobId"),
        ]
    )


@query
def lookup_by_key(spark, sf):
    return views.lookup_all(
        _posts(spark, sf), "postId", bridge.replies(spark, sf).select("postId")
    )


@query
def lookup_indexed(spark, sf):
    """The posts that have replies, out of posts laid out by key."""
    posts, path = _posts(spark, sf), scratch_dir(spark, "posts-by-key")
    key_index.write_by_key(posts, path, "postId")
    return key_index.lookup_keys(path, posts.schema, "postId", bridge.replies(spark, sf))


@query
def comments_of_newest_users(spark, sf):
    """All comments of the newest users, out of comments laid out by post."""
    comments, path = bridge.comments_table(spark, sf), scratch_dir(spark, "comments-by-post")
    key_index.write_by_key(comments, path, "postId", ["userId"], then=["commentId"])
    newest = bridge.users(spark, sf).orderBy(F.desc_nulls_last("createdAt"), "userId").limit(NEWEST_USERS)
    values = [r[0] for r in newest.select("userId").collect()]
    return key_index.lookup_other(spark, path, comments.schema, "userId", values)


@query
def valid_usernames(spark, sf):
    return views.valid_usernames(bridge.users(spark, sf))


@query
def stuck_jobs(spark, sf):
    return views.stuck_jobs(_jobs(spark, sf))


@query
def active_jobs(spark, sf):
    return views.active_jobs(_jobs(spark, sf))


@query
def users_by_recency(spark, sf):
    return views.newest_first(bridge.users(spark, sf), "createdAt", "userId")


@query
def jobs_by_recency(spark, sf):
    return views.newest_first(_jobs(spark, sf), "uploadedAt", "jobId")


@query
def latest_replies(spark, sf):
    return views.latest_replies(bridge.replies(spark, sf))


@query
def live_buffer(spark, sf):
    """The most recent replies over all posts that a page keeps."""
    return views.latest_replies(bridge.replies(spark, sf), LIVE_BUFFER_SIZE)


@query
def recent_replies_topk(spark, sf):
    return views.recent_replies_per_post(bridge.replies(spark, sf), 3)


@query
def post_comments(spark, sf):
    return views.in_thread_order(bridge.comments_table(spark, sf), "createdAt", "commentId")


@query
def post_replies(spark, sf):
    return views.in_thread_order(bridge.replies(spark, sf), "timestamp", "replyId")


@query
def platform_stats(spark, sf):
    return views.platform_stats(
        bridge.users(spark, sf),
        _posts(spark, sf),
        bridge.comments_table(spark, sf),
        bridge.replies(spark, sf),
        _jobs(spark, sf),
    )


@query
def job_progress(spark, sf):
    comments = bridge.cleaned(spark, sf).withColumn(
        "jobId", F.concat(F.lit("job"), identity.hash_bucket(F.col("postId"), 5).cast("string"))
    )
    return views.job_progress(comments, bridge.replies(spark, sf), "jobId")


@query
def progress_percent(spark, sf):
    return bridge.job_events(spark, sf).select(
        "event_id",
        "jobId",
        identity.progress_percent(
            F.col("status"), F.col("processedRecords"), F.col("totalRecords")
        ).alias("percent"),
    )


# --- quality and operations --------------------------------------------------


@query
def quality_funnel(spark, sf):
    return quality.quality_funnel(bridge.nested_posts(spark, sf))


def _profile(spark, sf):
    posts = bridge.nested_posts(spark, sf)
    return quality.quality_profile(_posts(spark, sf), prep.explode_comments(posts))


@query
def quality_profile(spark, sf):
    return _profile(spark, sf)


@query
def projected_minutes(spark, sf):
    report = packing.packing_report(_packed(spark, sf))
    return quality.projected_minutes(_profile(spark, sf), report, KEY_SLOTS)


@query
def latency_report(spark, sf):
    return quality.latency_report(bridge.calls_log(spark, sf), "slot")


@query
def slot_stats(spark, sf):
    return quality.slot_stats(bridge.calls_log(spark, sf))


def _event_ms():
    return F.floor(identity.epoch_micros(F.col("ts")) / 1000)


@query
def event_throughput(spark, sf):
    return quality.event_throughput(bridge.load(spark, sf, "events"), _event_ms())


@query
def throughput_per_minute(spark, sf):
    return quality.throughput_per_minute(bridge.load(spark, sf, "events"), _event_ms())


@query
def rate_budget_audit(spark, sf):
    return quality.rate_budget_audit(bridge.calls_log(spark, sf), AUDIT_BUDGET, AUDIT_SECONDS)


@query
def chunk_rows(spark, sf):
    events = bridge.load(spark, sf, "events").select(
        "event_id", "event_type", F.md5(F.col("event_id").cast("string")).alias("rowKey")
    )
    return skew.chunk_rows(events, "event_type", "rowKey", "event_id", 10, floor=100).select(
        "event_id", "event_type", "chunk", "pos", "groupRows"
    )


# --- text functions ----------------------------------------------------------


def _texts(spark, sf):
    """Every text of documents and raw comments."""
    documents = bridge.load(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text"
    )
    return documents.unionByName(
        bridge.comments(spark, sf).select(
            F.col("commentId").alias("id"), F.col("commentText").alias("text")
        )
    )


def _on_texts(name, function):
    def run(spark, sf):
        return _texts(spark, sf).withColumn("text", function(F.col("text")))

    run.__name__ = name
    return query(run)


_on_texts("strip_emoji", text.strip_emoji)
_on_texts("mask_urls", text.mask_urls)
_on_texts("strip_special", text.strip_special)
_on_texts("collapse_whitespace", text.collapse_whitespace)


@query
def clean_documents(spark, sf):
    documents = bridge.load(spark, sf, "documents")
    cleaned = text.clean_body(F.col("text"))
    return documents.filter(text.survives_cleaning(F.col("text"))).select(
        "doc_id", "lang", "source", cleaned.alias("cleaned")
    ).withColumns(
        {"charCount": F.length("cleaned"), "wordCount": text.word_count(F.col("cleaned"))}
    )


@query
def reply_ids(spark, sf):
    return bridge.cleaned(spark, sf).select(
        "commentId", identity.reply_id(F.col("commentId"), PROVIDER_VERSION).alias("replyId")
    )


@query
def event_time(spark, sf):
    return bridge.comments_table(spark, sf).select(
        "commentId",
        F.date_format(identity.event_time(F.col("createdAt")), "yyyy-MM-dd HH:mm:ss").alias("at"),
    )


@query
def relative_age(spark, sf):
    return bridge.load(spark, sf, "events").select(
        "event_id",
        identity.relative_age(
            F.floor(identity.epoch_micros(F.col("ts")) / 1000), 1_706_745_500_000
        ).alias("age"),
    )


@query
def join_comment_list(spark, sf):
    texts = F.transform(
        F.array_sort(F.filter("comments", lambda c: c.isNotNull())), lambda c: c["commentText"]
    )
    return bridge.nested_posts(spark, sf).select(
        "postId",
        "timestamp",
        prompts.join_comments(F.coalesce(texts, F.array().cast("array<string>"))).alias("request"),
    )


# --- packing, calls and replies ----------------------------------------------


@query
def group_by_post_prefix(spark, sf):
    return packing.group_by_post_prefix(bridge.items(spark, sf))


@query
def pack_calls(spark, sf):
    return _packed(spark, sf)


@query
def packing_report(spark, sf):
    return packing.packing_report(_packed(spark, sf))


@query
def assign_slots(spark, sf):
    calls = _packed(spark, sf).select("callId", "kind", "bucket").distinct()
    return packing.assign_slots(materialize(calls, "calls"), KEY_SLOTS)


def _calls(spark, sf):
    return packing.build_calls(_packed(spark, sf))


@query
def prompt_same_post(spark, sf):
    return _calls(spark, sf).filter("kind = 'same_post'").select("callId", "size", "prompt")


@query
def prompt_mixed(spark, sf):
    return _calls(spark, sf).filter("kind = 'mixed_post'").select("callId", "size", "prompt")


@query
def token_budget(spark, sf):
    return _calls(spark, sf).select("callId", "kind", "size", "maxTokens")


@query
def encode_items(spark, sf):
    return inference.encode_items(bridge.items(spark, sf))


@query
def decode_item_replies(spark, sf):
    latency = identity.hash_bucket(F.col("id"), 500)
    bodies = _offline_replies(bridge.items(spark, sf)).select(
        F.to_json(
            F.struct(
                "id",
                "generated_reply",
                F.when(latency % 3 != 0, latency).alias("latency_ms"),
            )
        ).alias("body")
    )
    return inference.decode_item_replies(bodies)


def _model_answers(calls):
    """Raw answers with the shapes models really give: numbered, bare, repeated, blank."""
    shape = identity.hash_bucket(F.col("callId"), 8)
    replies = F.transform("items", lambda i: parsing.offline_reply(i["id"]))
    numbered = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.size("items")),
            lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("] "), replies[n - 1]),
        ),
        "\n",
    )
    raw = (
        F.when(shape < 4, numbered)
        .when(shape == 4, F.array_join(replies, "\n\n"))
        .when(
            shape == 5,
            F.concat(F.lit("[1] "), replies[0], F.lit("\n[1]  again\n[99] nobody [x]\n[2]")),
        )
        .when(shape == 6, F.lit("  \n  "))
        .otherwise(F.concat(F.lit("  sure, here you go: "), replies[0], F.lit("\n")))
    )
    return calls.withColumns({"raw": raw, "ids": F.col("items.id")})


@query
def parse_numbered_replies(spark, sf):
    answers = _model_answers(_calls(spark, sf))
    return answers.select(
        "callId", F.posexplode(parsing.numbered_replies(F.col("raw"))).alias("place", "piece")
    ).select("callId", "place", "piece.number", "piece.reply")


@query
def parse_fallback(spark, sf):
    return inference.parse_answers(_model_answers(_calls(spark, sf))).drop("id")


@query
def attach_parsed_replies(spark, sf):
    packed = _packed(spark, sf)
    parsed = packed.filter(identity.hash_bucket(F.col("id"), 6) != 0).select(
        "id", parsing.offline_reply(F.col("id")).alias("reply")
    )
    return inference.attach_replies(packed.select("callId", "pos", "id"), parsed)


def _call_results(calls):
    """Results of calls, some failed: status, error and latency by the call's hash."""
    fate = identity.hash_bucket(F.col("callId"), 5)
    return _model_answers(calls).select(
        "callId",
        "kind",
        "ids",
        F.when(fate > 1, F.col("raw")).alias("raw"),
        (identity.hash_bucket(F.col("callId"), 900) + 100).alias("latencyMs"),
        F.when(fate == 0, "error").when(fate == 1, "timeout").otherwise("ok").alias("status"),
        F.when(fate == 0, F.concat(F.lit("no answer for call "), "callId", F.lit(", "), "callId"))
        .alias("error"),
    )


@query
def error_replies(spark, sf):
    return inference.error_replies(_call_results(_calls(spark, sf)))


@query
def union_ok_and_error(spark, sf):
    return inference.collect_replies(materialize(_call_results(_calls(spark, sf)), "answers"))


@query
def generate_replies(spark, sf):
    path = scratch_dir(spark, "answers")
    return inference.generate_replies(_items(spark, sf), offline_provider, path=path, rounds=2).drop("latency_ms")


_TRIES = collections.Counter()


def _unreliable_provider(kind, prompt, ids, max_tokens):
    """Fails in three ways, by the first id's hash: for good, by refusal, and twice only."""
    fate = int(hashlib.md5(ids[0].encode()).hexdigest()[:10], 16) % 4
    if fate == 0:
        raise ConnectionError("service unavailable")
    if fate == 1:
        raise inference.Refused("refused: " + prompt)
    _TRIES[ids[0]] += 1
    if fate == 2 and _TRIES[ids[0]] % 3:
        raise RuntimeError("status 503")
    return offline_provider(kind, prompt, ids, max_tokens)


@query
def retry_to_error_rows(spark, sf):
    return inference.generate_replies(
        _items(spark, sf), _unreliable_provider, scratch_dir(spark, "answers"), first_wait=0.0
    ).select("id", "generated_reply", "status")


CALLS_AT_ONCE, FIRST_WAIT = 4, 0.01
CAUSES = ["asked", "timeout", "refused", "ok"]


class _Throttled(Exception):
    retry_after = 0.02


def _slow_provider(kind, prompt, ids, max_tokens):
    """Takes a while; fails by the first id's hash: told to wait, out of time twice, refused."""
    time.sleep(0.002)
    cause = CAUSES[int(hashlib.md5(ids[0].encode()).hexdigest()[:10], 16) % 4]
    _TRIES["slow", ids[0]] += 1
    if cause == "asked" and _TRIES["slow", ids[0]] % 2:
        raise _Throttled("too many calls")
    if cause == "timeout" and _TRIES["slow", ids[0]] % 3:
        raise TimeoutError("no answer")
    if cause == "refused":
        raise inference.Refused("refused")
    return offline_provider(kind, prompt, ids, max_tokens)


@query
def bounded_calls(spark, sf):
    """Calls and attempts by the cause of failures, whether each waited for its cause's time, and
    whether no more than CALLS_AT_ONCE were ever under way together."""
    answers = inference.answer_stored(
        _calls(spark, sf), _slow_provider, scratch_dir(spark, "answers"), concurrency=CALLS_AT_ONCE,
        first_wait=FIRST_WAIT,
    )
    tries = answers.select(F.col("ids")[0].alias("first"), "attempts")
    most = quality.open_calls(tries.select(F.inline("attempts"))).agg(F.max("open")).first()[0]
    cause = F.element_at(F.array(*map(F.lit, CAUSES)), (identity.hash_bucket(F.col("first"), 4) + 1).cast("int"))
    doubled = F.transform(F.sequence(F.lit(1), F.size("attempts")), lambda k: 1000 * FIRST_WAIT * F.pow(F.lit(2.0), k - 1))
    gaps = F.transform(
        F.slice("attempts", 2, F.size("attempts")), lambda a, k: a["startMs"] - F.get("attempts", k)["endMs"]
    )
    least = F.when(F.col("cause") == "asked", F.transform(doubled, lambda _: F.lit(1000 * _Throttled.retry_after)))
    waits = F.zip_with(gaps, F.slice(F.coalesce(least, doubled), 1, F.size(gaps)), lambda gap, wait: gap >= wait - 1)
    judged = tries.withColumn("cause", cause).withColumn("waited", F.forall(waits, lambda ok: ok))
    return judged.groupBy("cause").agg(
        F.count("*").alias("calls"),
        F.sum(F.size("attempts")).alias("attempts"),
        F.every("waited").alias("waited"),
        F.lit(most is None or most <= CALLS_AT_ONCE).alias("bounded"),
    )


@query
def resumed_replies(spark, sf):
    """Replies of a job that broke after its first round and was resumed with other rounds."""
    path, items = scratch_dir(spark, "answers"), _items(spark, sf)

    def breaks(done):
        raise InterruptedError(f"the job ends after {done} items")

    try:
        inference.generate_replies(items, offline_provider, path=path, rounds=4, report=breaks)
    except InterruptedError:
        pass
    again = inference.generate_replies(items, offline_provider, path=path, rounds=1, resume=True)
    return again.drop("latency_ms")


@query
def caption_missing(spark, sf):
    return inference.caption_missing(_posts(spark, sf))


def _caption_provider(image_url, context):
    _TRIES[image_url] += 1
    if _TRIES[image_url] % 2:
        raise RuntimeError("status 503")
    return f"seen at {image_url}"


@query
def caption_by_provider(spark, sf):
    """Captions of a provider that fails once for each image."""
    return inference.caption_missing(_posts(spark, sf), _caption_provider, first_wait=0.0)


def _counted_captions(image_url, context):
    return f"seen at {image_url}"


@query
def captions_once(spark, sf):
    """Calls for each image and context over two jobs: half of the posts, then all, each twice.

    Equal requests are put together in a job, and the second job finds the first one's answers.
    """
    posts, store = _posts(spark, sf), inference.answer_store(scratch_dir(spark, "captions"), buckets=8)
    twice = posts.unionByName(posts.withColumn("postId", F.concat("postId", F.lit("again"))))
    for job, part in enumerate((twice.filter(identity.hash_bucket(F.col("postId"), 2) == 0), twice)):
        batch_of = commits.Batch(spark, store.path, f"job-{job}", 0, "captions")
        captioned = inference.caption_missing(part, _counted_captions, store, batch_of, NOW_MS + job)
        captions = captioned.groupBy("imageUrl").agg(F.max("imageCaption").alias("imageCaption"))
    asked = inference.caption_requests(twice).filter("request is not null").select("request", "imageUrl").distinct()
    made = store.tail_rows(spark).groupBy("request").agg(F.sum("calls").alias("calls"))
    per_image = asked.join(made, "request").groupBy("imageUrl").agg(
        F.count("*").alias("requests"), F.sum("calls").alias("calls")
    )
    return per_image.join(captions, "imageUrl")


@query
def batch_end_to_end(spark, sf):
    """The whole job: nested JSON in, enriched JSON out."""
    source = scratch_dir(spark, "upload")
    writers.write_json(bridge.nested_posts(spark, sf), source)
    out, work = scratch_dir(spark, "out"), scratch_dir(spark, "work")
    return batch.run_job(spark, source, out, work, "job1", offline_provider, now_ms=NOW_MS).drop(
        "inferenceLatencyMs"
    )


# --- streams -----------------------------------------------------------------


POST_MESSAGES = (readers.decode_post_events, readers.rejected_posts)


def _post_table(spark):
    return KeyedTable(scratch_dir(spark, "posts"), schemas.POST_EVENT, "postId", ["createdAt"], buckets=8)


def _ingest(spark, path, table, readers_of, merge_every=None, checkpoint=None):
    """Feed ``table`` from the messages in ``path``, a file a batch."""
    messages = streams.message_stream(spark, source="text", path=path, maxFilesPerTrigger=4)
    checkpoint = checkpoint or scratch_dir(spark, "checkpoint")
    tables.start_table_ingest(messages, table, *readers_of, checkpoint, None, merge_every).awaitTermination()
    return table


def _looked_up(spark, sf):
    """Posts arrive through their topic, then comments look them up in the post table."""
    topic, posts = scratch_dir(spark, "post-topic"), _stored_posts(spark, sf)
    _write_messages(enrich.as_messages(posts, "postId", posts.columns), topic)
    stored = _ingest(spark, topic, _post_table(spark), POST_MESSAGES)
    path, out = scratch_dir(spark, "comments"), scratch_dir(spark, "looked-up")
    table = bridge.comments_table(spark, sf)
    table.write.parquet(path)
    arriving = spark.readStream.schema(table.schema).parquet(path)
    live.start_lookup_flow(arriving, stored, out, scratch_dir(spark, "checkpoint")).awaitTermination()
    return out, table.schema


@query
def stream_enrich_comments(spark, sf):
    """New comments as a stream, joined with the posts ingested so far."""
    out, _ = _looked_up(spark, sf)
    return commits.committed_rows(spark, out, "events", schemas.COMMENT_EVENT).drop("metadata")


@query
def stream_orphans(spark, sf):
    """New comments without a stored post, kept apart."""
    out, schema = _looked_up(spark, sf)
    return commits.committed_rows(spark, out, "orphans", schema)


@query
def rejected_messages(spark, sf):
    """Messages of the post topic that cannot be decoded, next to as many that can."""
    posts = _posts(spark, sf)
    good = enrich.as_messages(posts, "postId", posts.columns)
    bad = good.select("key", F.substring_index("value", ",", 1).alias("value"))
    return readers.undecodable(good.unionByName(bad), schemas.POST_EVENT)


def _half(messages, part):
    return messages.filter(identity.hash_bucket(F.col("key"), 2) == part)


def _run_live(spark, sf, deliveries=None, checkpoints=1, **more):
    """The live flow over all comment events, delivered in one or more runs.

    The runs take turns with so many checkpoints, and all write to the same folder.
    """
    out = scratch_dir(spark, "live")
    places = [(scratch_dir(spark, "topic"), scratch_dir(spark, "checkpoint")) for _ in range(checkpoints)]
    messages = enrich.encode_comment_events(_event_rows(spark, sf))
    for number, delivery in enumerate(deliveries(messages) if deliveries else [messages]):
        topic, checkpoint = places[number % checkpoints]
        _write_messages(delivery, topic)
        events = streams.comment_stream(spark, source="text", path=topic, maxFilesPerTrigger=16)
        run = live.start_comment_flow(
            events, out, checkpoint, offline_provider, PROVIDER_VERSION, now_ms=NOW_MS,
            state_partitions=STATE_PARTITIONS, **more
        )
        run.awaitTermination()
    return out


@query
def stream_sink_cleaned(spark, sf):
    return commits.committed_rows(spark, _run_live(spark, sf), "cleaned", schemas.CLEANED_STREAM)


@query
def stream_sink_replies(spark, sf):
    replies = commits.committed_rows(spark, _run_live(spark, sf), "replies", schemas.STREAM_REPLY)
    return replies.drop("inferenceLatencyMs")


@query
def stream_end_to_end(spark, sf):
    out = _run_live(spark, sf)
    messages = commits.committed_rows(spark, out, "messages", "key string, value string")
    return readers.decode_replies(messages, NOW_MS)


@query
def stream_restart(spark, sf):
    """Half of the events, then a restart with all of them delivered."""
    out = _run_live(spark, sf, lambda messages: [_half(messages, 0), messages])
    return commits.committed_rows(spark, out, "cleaned", schemas.CLEANED_STREAM)


@query
def stream_new_checkpoint(spark, sf):
    """Two streams in turn, each with a checkpoint of its own, in one output folder.

    Their batches have the same numbers; each comment keeps its cleaned row and gets one reply.
    """
    out = _run_live(spark, sf, lambda messages: [_half(messages, 0), _half(messages, 1)], checkpoints=2)
    cleaned = commits.committed_rows(spark, out, "cleaned", schemas.CLEANED_STREAM)
    replies = commits.committed_rows(spark, out, "replies", schemas.STREAM_REPLY)
    counts = replies.groupBy("commentId").agg(F.count("*").alias("replies"), F.max("generatedReply").alias("reply"))
    return cleaned.select("commentId", "postId", "commentText").join(counts, "commentId", "left")


@query
def stream_late_copies(spark, sf):
    """Replies after all events came again to a stream whose state was lost."""
    seen = live.seen_comments(scratch_dir(spark, "seen"), buckets=8)
    out = _run_live(spark, sf, lambda messages: [messages, messages], checkpoints=2, seen=seen)
    return commits.committed_rows(spark, out, "replies", schemas.STREAM_REPLY).drop("inferenceLatencyMs")


@query
def stream_foreach_batch(spark, sf):
    """Rows per event type, counted per micro-batch and summed over the batches."""
    out, checkpoint = scratch_dir(spark, "counts"), scratch_dir(spark, "checkpoint")
    schema = bridge.load(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")

    def body(part, batch_id):
        counts = part.groupBy("event_type").agg(F.count("*").alias("events"))
        writers.write_batch_json(counts, out, batch_id)

    live.start(events, checkpoint, body).awaitTermination()
    counts = spark.read.schema("event_type string, events bigint").json(f"{out}/*")
    return counts.groupBy("event_type").agg(F.sum("events").alias("events"))


REPLY_MESSAGES = (lambda messages: readers.decode_replies(messages, NOW_MS), readers.rejected_replies)


def _reply_table(spark):
    return KeyedTable(scratch_dir(spark, "replies"), schemas.REPLY_EVENT, "replyId", ["timestamp"], buckets=8)


@query
def stream_reply_ingest(spark, sf):
    """The reply topic, every message delivered twice, kept as a table."""
    path = scratch_dir(spark, "reply-topic")
    replies = bridge.replies(spark, sf)
    messages = enrich.as_messages(replies, "replyId", replies.columns)
    for _ in range(2):
        _write_messages(messages, path)
    return _ingest(spark, path, _reply_table(spark), REPLY_MESSAGES).rows(spark)


@query
def stream_post_ingest(spark, sf):
    """The post topic kept as the post table that comments are joined with."""
    path = scratch_dir(spark, "post-topic")
    posts = _posts(spark, sf)
    _write_messages(enrich.as_messages(posts, "postId", posts.columns), path)
    return _ingest(spark, path, _post_table(spark), POST_MESSAGES).rows(spark)


@query
def stream_post_compacted(spark, sf):
    """The post topic in three runs, the table merged after the first two of them.

    The last run brings all posts anew with another title: the rows stored first stay.
    """
    path, checkpoint, table = scratch_dir(spark, "post-topic"), scratch_dir(spark, "checkpoint"), _post_table(spark)
    posts = _posts(spark, sf)
    messages = enrich.as_messages(posts, "postId", posts.columns)
    again = posts.withColumn("title", F.lit("later"))
    for delivery in (_half(messages, 0), _half(messages, 1), enrich.as_messages(again, "postId", again.columns)):
        table.merge(spark)
        table.drop_folded(spark)
        _write_messages(delivery, path)
        _ingest(spark, path, table, POST_MESSAGES, checkpoint=checkpoint)
    return table.rows(spark)


@query
def stream_rejects(spark, sf):
    """Messages, stored and rejected rows of the post and reply topics, each with bad messages.

    Next to each message comes one cut short; next to each post one without its key.
    """
    posts, replies = _posts(spark, sf), bridge.replies(spark, sf)
    topics = [
        ("posts", _post_table(spark), POST_MESSAGES, enrich.as_messages(posts, "postId", posts.columns)),
        ("replies", _reply_table(spark), REPLY_MESSAGES, enrich.as_messages(replies, "replyId", replies.columns)),
    ]
    counts = None
    for name, table, readers_of, good in topics:
        cut = good.select("key", F.substring_index("value", ",", 1).alias("value"))
        nameless = good.select("key", F.regexp_replace("value", '"postId"', '"id"').alias("value"))
        sent = good.unionByName(cut) if name == "replies" else good.unionByName(cut).unionByName(nameless)
        path = scratch_dir(spark, f"{name}-topic")
        _write_messages(sent, path)
        _ingest(spark, path, table, readers_of, merge_every=2)
        found = commits.committed(spark, table.path).agg(
            F.lit(name).alias("topic"),
            *[F.sum(c).alias(c) for c in ("messages", "stored", "rejected")],
            F.lit(table.rejected(spark).count()).cast("bigint").alias("kept"),
        )
        counts = found if counts is None else counts.unionByName(found)
    return counts


@query
def stream_dedupe(spark, sf):
    path = scratch_dir(spark, "topic")
    messages = enrich.encode_comment_events(_event_rows(spark, sf))
    _write_messages(messages, path)
    _write_messages(_half(messages, 1), path)
    events = streams.comment_stream(spark, source="text", path=path, maxFilesPerTrigger=16)
    return _stream_to_table(spark, live.prepare_stream(events, NOW_MS), "deduped")


@query
def stream_throughput(spark, sf):
    schema = bridge.load(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    log, checkpoint = scratch_dir(spark, "windows"), scratch_dir(spark, "checkpoint")
    live.start_throughput(events, _event_ms(), log, checkpoint).awaitTermination()
    return live.window_counts(spark, log)


@query
def stream_late_rows(spark, sf):
    """All comment events, the newest threads delivered first, in several micro-batches."""
    path = scratch_dir(spark, "topic")
    # thread times rise with the number of the post
    number = F.regexp_extract("postId", "[0-9]+", 0).cast("bigint")
    rows = materialize(_event_rows(spark, sf).withColumn("number", number), "events")
    top = rows.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    for part in (3, 2, 1, 0):
        share = F.floor(F.col("number") * 4 / (top + 1)) == part
        _write_messages(enrich.encode_comment_events(rows.filter(share).drop("number")), path)
    events = streams.comment_stream(spark, source="text", path=path, maxFilesPerTrigger=1)
    return _stream_to_table(spark, live.prepare_stream(events, NOW_MS), "late")
