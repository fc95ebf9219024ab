"""Comment-thread tables derived from the given `conversations` and `events` tables.

A conversation is a thread: its first turn is the post, later turns are the comments, so each
given text is in a row. Defects are planted in extra rows (missing texts, emoji, URLs, blank
texts, exact copies) and in the other columns, so that every preparation step has work to do at
any scale.

``THREAD_CTES`` is SQL both Spark and the check engine accept.
"""

from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.functions.identity import epoch_micros, hash_bucket
from threadloom.functions.replies import offline_reply
from threadloom.operators import packing
from threadloom.plans import batch

NOW_MS = 1_704_672_000_000  # 2024-01-08, the clock of all registered queries
PROVIDER_VERSION = "offline-1"

THREAD_CTES = """
fu as (select conv_id, min(turn) as t0 from conversations group by conv_id),
given_posts as (
  select c.conv_id, fu.t0,
    'p' || cast(c.conv_id as string) as postId,
    'user_' || cast(c.conv_id % 50 as string) as userId,
    case when c.conv_id % 9 = 8 then null
         else 'poster_' || cast(c.conv_id % 50 as string) || '!' end as username,
    c.text as title, c.text as postText,
    case when c.conv_id % 11 = 10 then null when c.conv_id % 3 = 0 then ' DataScience '
         when c.conv_id % 3 = 1 then 'Space' else 'ask-science' end as subreddit,
    case when c.conv_id % 3 = 0 then 'https://img.example.com/' || cast(c.conv_id as string)
         when c.conv_id % 3 = 1 then '' else null end as imageUrl,
    case when c.conv_id % 6 = 0 then 'chart ' || cast(c.conv_id as string)
         else null end as imageCaption,
    1704067200000 + c.conv_id * 60000 as ts
  from conversations c join fu on c.conv_id = fu.conv_id and c.turn = fu.t0),
posts as (
  select * from given_posts
  union all
  select conv_id, t0, postId || 'n' as postId, userId, username, title,
    cast(null as string) as postText, subreddit, imageUrl, imageCaption, ts
  from given_posts where conv_id % 20 = 19),
given_comments as (
  select replace(p.postId, 'p', 'c') || '_' || cast(c.turn as string) as commentId,
    p.postId, 'user_' || cast((c.conv_id * 7 + c.turn) % 40 as string) as userId,
    case when (c.conv_id + c.turn) % 7 = 0 then null
         else 'user ' || cast((c.conv_id * 7 + c.turn) % 40 as string) end as username,
    p.title as postTitle, p.postText, c.text as commentText,
    p.imageUrl, p.imageCaption, p.subreddit,
    case when (c.conv_id + c.turn) % 13 = 12 then null else p.ts + c.turn * 1000 end as ts,
    case when c.turn % 5 = 4 then null else cast(c.turn * 3 - 5 as int) end as upvotes,
    case when c.turn % 2 = 0
         then replace(p.postId, 'p', 'c') || '_' || cast(c.turn - 1 as string)
         else null end as parentCommentId,
    c.conv_id, c.turn
  from conversations c join posts p on p.conv_id = c.conv_id and c.turn > p.t0),
raw_comments as (
  select * from given_comments
  union all
  select commentId || 'x' as commentId, postId, userId, username, postTitle, postText,
    case (conv_id * 8 + turn) % 12
      when 0 then commentText || ' 🔥🔥 ¶ so far'
      when 1 then 'read   https://notes.example.org/a?b=1 first: ' || commentText
      when 2 then '   '
      when 3 then ''
      when 4 then '🎈🎈'
      else null end as commentText,
    imageUrl, imageCaption, subreddit, ts, upvotes, parentCommentId, conv_id, turn
  from given_comments where (conv_id * 8 + turn) % 12 < 6),
comments as (
  select * from raw_comments
  union all
  select * from raw_comments where conv_id % 10 = 0)
"""

# A nested document holds the comments of a run of this many turns of one post.
TURNS_PER_DOCUMENT = 50


def load(spark, sf_dir, name):
    """One of the given tables. Times without zone are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _from_threads(spark, sf_dir, select):
    sql = f"with {THREAD_CTES} {select}".replace("from conversations", "from {conversations}")
    return spark.sql(sql, conversations=load(spark, sf_dir, "conversations"))


def comments(spark, sf_dir):
    """Flat comments with post context, before any preparation.

    The exact copies are made by repeating rows, so the threads are derived once.
    """
    once = _from_threads(
        spark,
        sf_dir,
        "select commentId, postId, userId, username, postTitle, postText, commentText, imageUrl, "
        "imageCaption, subreddit, ts as timestamp, upvotes, parentCommentId, conv_id, turn "
        "from raw_comments",
    )
    copies = F.when(F.col("conv_id") % 10 == 0, 2).otherwise(1)
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")


def posts(spark, sf_dir):
    """The posts table: nine columns, missing texts kept as nulls."""
    return _from_threads(
        spark,
        sf_dir,
        "select postId, userId, username, title, postText, subreddit, imageUrl, imageCaption, "
        "ts as createdAt, conv_id from posts",
    )


def nested_posts(spark, sf_dir):
    """Nested post documents, with null arrays and null elements planted.

    A post is spread over several documents, one per run of turns, so no array grows with
    the length of a thread. Every 17th post gets one more document without comments.
    """
    head = posts(spark, sf_dir).select(
        "conv_id", "postId", "userId", "username", "title", "postText", "subreddit", "imageUrl",
        "imageCaption", F.col("createdAt").alias("timestamp"), F.lit(1).alias("upvotes"),
    )
    element = F.struct(
        "commentId", "userId", "username", "commentText", "timestamp", "upvotes", "parentCommentId"
    )
    groups = (
        comments(spark, sf_dir)
        .groupBy("postId", "conv_id", F.floor(F.col("turn") / TURNS_PER_DOCUMENT).alias("document"))
        .agg(F.collect_list(element).alias("comments"))
        .withColumn(
            "comments",
            F.when(
                (F.col("conv_id") % 13 == 0) & (F.col("document") == 0),
                F.array_append("comments", F.lit(None).cast(schemas.NESTED_COMMENT)),
            ).otherwise(F.col("comments")),
        )
    )
    filled = head.join(groups.drop("conv_id"), "postId").select(*schemas.NESTED_POST.fieldNames())
    bare = head.filter("conv_id % 17 = 16").withColumn(
        "comments", F.lit(None).cast(schemas.NESTED_POST["comments"].dataType)
    )
    return filled.unionByName(bare.select(*schemas.NESTED_POST.fieldNames()))


def cleaned(spark, sf_dir):
    return batch.preprocess_comments(comments(spark, sf_dir), NOW_MS)


def items(spark, sf_dir):
    """Surviving comments as the items of calls."""
    return packing.as_items(cleaned(spark, sf_dir))


def comments_table(spark, sf_dir):
    """The comments table: comments with text, one row per id."""
    with_text = comments(spark, sf_dir).filter("commentText is not null")
    return with_text.select(
        "commentId",
        "postId",
        "userId",
        F.coalesce("username", F.lit("anonymous")).alias("username"),
        "commentText",
        F.coalesce("parentCommentId", F.lit("")).alias("parentCommentId"),
        F.coalesce("timestamp", F.lit(NOW_MS)).alias("createdAt"),
    ).distinct()


def users(spark, sf_dir):
    """Users who wrote a comment; some authors of posts are missing."""
    authors = comments(spark, sf_dir).groupBy("userId").agg(F.min("timestamp").alias("createdAt"))
    padded_name = F.concat(F.lit(" "), F.substring("userId", 5, 9))
    return authors.select("userId", padded_name.alias("username"), "createdAt")


def replies(spark, sf_dir):
    """A stored reply per surviving comment, except for about every ninth."""
    return (
        cleaned(spark, sf_dir)
        .filter(hash_bucket(F.col("commentId"), 9) != 0)
        .select(
            F.substring(F.md5("commentId"), 1, 16).alias("replyId"),
            "commentId",
            "postId",
            offline_reply(F.col("commentId")).alias("generatedReply"),
            (F.col("timestamp") + 5000).alias("timestamp"),
        )
    )


def replies_written(spark, sf_dir):
    """Stored replies with the columns the enrichment join takes."""
    return replies(spark, sf_dir).select(
        "commentId",
        "generatedReply",
        F.length("commentId").cast("bigint").alias("inferenceLatencyMs"),
        F.col("timestamp").alias("processedAt"),
    )


def calls_log(spark, sf_dir):
    """The events table as a log of calls: slot, status, items and latency."""
    events = load(spark, sf_dir, "events")
    return events.select(
        "event_id",
        (F.col("user_id") % 3).alias("slot"),
        F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"),
        (F.col("user_id") % 10 + 1).alias("items"),
        F.floor(F.col("value") * 100).alias("latencyMs"),
        epoch_micros(F.col("ts")).alias("atMicros"),
    )


def job_events(spark, sf_dir):
    """The events table as job status events."""
    events = load(spark, sf_dir, "events")
    job = F.col("user_id").cast("string")
    return events.select(
        F.concat(F.lit("job"), job).alias("jobId"),
        F.when(F.col("user_id") % 4 == 0, None)
        .when(F.col("user_id") % 4 == 1, "")
        .otherwise(F.concat(F.lit("app"), job))
        .alias("sparkJobId"),
        F.when(F.col("event_type") == "view", "uploaded")
        .when(F.col("event_type") == "signup", "submitted")
        .when(F.col("event_type") == "click", "inferring")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("completed")
        .alias("status"),
        F.concat(F.lit("/data/raw/bulk/job"), job).alias("inputPath"),
        F.when(F.col("user_id") % 7 == 0, "")
        .otherwise(F.concat(F.lit("/data/output/job"), job))
        .alias("outputPath"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("uploadedAt"),
        F.get_json_object("props", "$.k").cast("bigint").alias("totalRecords"),
        F.floor(F.get_json_object("props", "$.k").cast("bigint") * F.col("event_id") % 100 / 2)
        .alias("processedRecords"),
        "event_id",
    )
