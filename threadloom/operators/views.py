"""Read side: feed, threads, latest rows, jobs and look-ups."""

from pyspark.sql import functions as F

from threadloom import fixed_values as fixed
from threadloom.functions.text import strip_blanks
from threadloom.operators.skew import left_join_many, top_per_key


def counts_per_post(posts, comments, replies):
    """Comment and reply counts of every post, 0 where there are none."""

    def counted(table, name):
        return table.groupBy("postId").agg(F.count("*").alias(name))

    return (
        posts.join(counted(comments, "commentCount"), "postId", "left")
        .join(counted(replies, "replyCount"), "postId", "left")
        .fillna(0, subset=["commentCount", "replyCount"])
    )


def feed_with_counts(posts, comments, replies, size=fixed.FEED_SIZE):
    """Newest posts with their counts.

    The feed is cut to ``size`` posts first. Comments and replies are then filtered by those
    few keys as they are read, so only rows of the feed are ever counted. Spark broadcasts
    the keys by their measured size.
    """
    newest = posts.orderBy(F.col("createdAt").desc(), "postId").limit(size)
    keys = newest.select("postId")
    return counts_per_post(
        newest,
        comments.join(keys, "postId", "left_semi"),
        replies.join(keys, "postId", "left_semi"),
    ).orderBy(F.col("createdAt").desc(), "postId")


def latest_replies(replies, size=fixed.FEED_SIZE):
    return replies.orderBy(F.col("timestamp").desc(), "replyId").limit(size)


def recent_replies_per_post(replies, k=fixed.LIVE_BUFFER_SIZE):
    """The newest ``k`` replies of every post with their rank."""
    return top_per_key(replies, ["postId"], [F.col("timestamp").desc(), F.col("replyId")], k)


def in_thread_order(rows, time, key):
    """All posts' rows, oldest first within a post.

    A range-partitioned sort: the unique key in the order lets Spark split a hot post.
    """
    return rows.orderBy("postId", time, key)


def newest_first(rows, time, key):
    return rows.orderBy(F.col(time).desc(), key)


def merge_live_replies(live, stored):
    """Live replies, then stored replies that are not live; the live copy wins."""
    rest = stored.join(live.select("replyId"), "replyId", "left_anti")
    return live.withColumn("source", F.lit("live")).unionByName(
        rest.withColumn("source", F.lit("stored"))
    )


def thread_view(comments, replies):
    """Comments with the replies under them, one row per reply, sorted as a thread.

    Rows stay flat: a nested array would pull all replies of a hot comment into one row.
    """
    nested = left_join_many(
        comments.select("commentId", "postId", "username", "commentText", "createdAt"),
        replies.select(
            "commentId", "replyId", "generatedReply", F.col("timestamp").alias("repliedAt")
        ),
        "commentId",
    )
    return nested.orderBy("postId", "createdAt", "commentId", "repliedAt", "replyId")


def platform_stats(users, posts, comments, replies, jobs):
    """Row counts of the tables in one row."""
    return users.agg(F.count("*").alias("users")).select(
        "users",
        posts.agg(F.count("*")).scalar().alias("posts"),
        comments.agg(F.count("*")).scalar().alias("comments"),
        replies.agg(F.count("*")).scalar().alias("replies"),
        jobs.agg(F.count("*")).scalar().alias("batchJobs"),
    )


def stuck_jobs(jobs):
    """Jobs to hand in again: never accepted by the engine, with both paths known."""
    known = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    return jobs.filter(
        F.col("status").isin(fixed.RETRY_JOB_STATES)
        & ~known("sparkJobId")
        & known("inputPath")
        & known("outputPath")
    )


def active_jobs(jobs):
    return jobs.filter(F.col("status").isin(fixed.ACTIVE_JOB_STATES))


def lookup(table, key, value):
    """Rows of one key; the filter reaches the scan."""
    return table.filter(F.col(key) == value)


def lookup_all(table, key, wanted):
    """Rows of many keys at once; a key wanted very often is one row before the join."""
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def valid_usernames(users):
    """Users whose name has 2 to 30 characters without blanks at its ends."""
    return users.withColumn("username", strip_blanks(F.col("username"))).filter(
        F.length("username").between(2, 30)
    )


def job_progress(comments, replies, job):
    """Finished and total records per job.

    Replied comment ids are made unique before the join, so each comment counts once.
    """
    done = replies.select("commentId").distinct().withColumn("done", F.lit(1))
    per_job = (
        comments.join(done, "commentId", "left")
        .groupBy(job)
        .agg(
            F.count("*").alias("totalRecords"),
            F.count("done").alias("processedRecords"),
        )
    )
    return per_job.withColumn(
        "fraction", F.round(F.col("processedRecords") / F.col("totalRecords"), 4)
    )
