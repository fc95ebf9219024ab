"""Data quality and operations reports."""

from pyspark.sql import functions as F

from threadloom import fixed_values as fixed
from threadloom.functions.text import strip_blanks
from threadloom.operators.comments import REQUIRED_BATCH, has_text, is_valid
from threadloom.operators.skew import PIECE_ROWS, in_pieces, scan_pieces


def quality_funnel(posts, required=REQUIRED_BATCH):
    """Rows left after each preparation step, in one pass over nested posts.

    Copies are found by counting per comment id, which Spark combines before the shuffle;
    only ids and counts are shuffled. Of the nested comments two fields are read.
    """
    needed = F.arrays_zip("comments.commentId", "comments.commentText")
    flat = posts.select(
        "postId", "postText", F.posexplode_outer(needed).alias("place", "comment")
    ).select(
        F.coalesce(F.col("place") == 0, F.lit(True)).alias("firstOfPost"),
        F.col("comment.commentId").alias("commentId"),
        "postId",
        F.col("comment.commentText").alias("commentText"),
        "postText",
    )
    exploded = F.col("commentId").isNotNull()
    valid = exploded & is_valid(required)
    per_comment = flat.groupBy("commentId").agg(
        F.count_if("firstOfPost").alias("posts"),
        F.count_if(exploded).alias("exploded"),
        F.count_if(valid).alias("valid"),
        F.count_if(valid & F.coalesce(has_text(), F.lit(False))).alias("withText"),
    )
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    return per_comment.agg(
        total("posts"),
        total("exploded"),
        total("valid"),
        total("withText"),
        F.count_if(F.col("withText") > 0).alias("distinctComments"),
    ).withColumn("dropped", F.col("exploded") - F.col("valid"))


def comment_profile(comments):
    """Dirty, empty, duplicate and clean comments of all posts.

    Equal comments of a post are counted as a group before anything else, so many copies
    shrink to one row. The text enters the key as its hash.
    """
    text = F.coalesce("commentText", F.lit(""))
    dirty = F.lit(False)
    for marker in fixed.DIRTY_MARKERS:
        dirty = dirty | F.contains(text, F.lit(marker))
    flagged = comments.withColumns(
        {
            "isDirty": dirty,
            "isEmpty": strip_blanks(text) == "",
            "textHash": F.sha2("commentText", 256),
        }
    )
    groups = flagged.groupBy(
        "postId", "commentId", "userId", "username", "textHash", "timestamp", "upvotes",
        "parentCommentId", "isDirty", "isEmpty",
    ).agg(F.count("*").alias("n"))
    counts = groups.agg(
        F.count("*").alias("totalComments"),
        F.coalesce(F.sum(F.when(F.col("isDirty"), F.col("n"))), F.lit(0)).alias("dirty"),
        F.coalesce(F.sum(F.when(F.col("isEmpty"), F.col("n"))), F.lit(0)).alias("empty"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicates"),
    )
    return counts.withColumns(
        {
            "clean": F.col("totalComments") - F.col("dirty") - F.col("empty"),
            "dirtyPercent": F.round(
                F.col("dirty") / F.greatest("totalComments", F.lit(1)) * 100, 1
            ),
        }
    )


def quality_profile(posts, comments):
    """One row: the comment profile, and the counts of the posts as scalars beside it."""
    image = F.coalesce(F.col("imageUrl"), F.lit("")) != ""

    def count(condition):
        return posts.agg(F.count_if(condition)).scalar()

    return comment_profile(comments).withColumns(
        {
            "posts": count(F.lit(True)),
            "nullPosts": count(F.col("postText").isNull()),
            "postsWithImage": count(image),
        }
    ).withColumn(
        "imagePercent", F.round(F.col("postsWithImage") / F.greatest("posts", F.lit(1)) * 100, 0)
    )


def projected_minutes(profile, calls=None, slots=1):
    """Minutes to answer the non-empty comments at the two call rates, one call each.

    ``calls`` is a one-row frame with the number of packed calls, dealt to ``slots`` keys.
    """
    todo = F.col("totalComments") - F.col("empty")
    plain = profile.select(
        todo.alias("comments"),
        F.round(todo / fixed.CALLS_PER_MINUTE, 2).alias("minutesFree"),
        F.round(todo / fixed.CALLS_PER_MINUTE_PAID, 2).alias("minutesPaid"),
    )
    if calls is None:
        return plain
    packed = calls.select("calls").scalar()
    return plain.withColumns(
        {
            "calls": packed,
            "minutesPacked": F.round(packed / (fixed.CALLS_PER_MINUTE * slots), 2),
        }
    )


def latency_report(calls, key):
    """Calls, items and latency per ``key``; items of a call share its latency equally."""
    share = F.floor(F.col("latencyMs") / F.greatest("items", F.lit(1)))
    return calls.groupBy(key).agg(
        F.count("*").alias("calls"),
        F.sum("items").alias("items"),
        F.sum("latencyMs").alias("totalLatencyMs"),
        F.max("latencyMs").alias("maxLatencyMs"),
        F.max(share).alias("maxPerCommentMs"),
        F.floor(F.sum("latencyMs") / F.greatest(F.sum("items"), F.lit(1))).alias(
            "avgPerCommentMs"
        ),
    )


def slot_stats(calls):
    """Calls and rejected calls per key slot."""
    return calls.groupBy("slot").agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == 429).alias("errors")
    )


def throughput_per_minute(events, epoch_ms):
    return events.groupBy((F.floor(epoch_ms / 60000) * 60000).alias("minuteMs")).agg(
        F.count("*").alias("events")
    )


def event_throughput(events, epoch_ms):
    """Events, elapsed seconds and the average rate over all of them."""
    return events.agg(
        F.count("*").alias("events"),
        ((F.max(epoch_ms) - F.min(epoch_ms)) / 1000).alias("elapsedSeconds"),
    ).select(
        "events",
        F.round("elapsedSeconds", 3).alias("elapsedSeconds"),
        F.round(F.col("events") / F.greatest("elapsedSeconds", F.lit(0.001)), 6).alias(
            "eventsPerSecond"
        ),
    )


def rate_budget_audit(calls, budget=fixed.CALLS_PER_MINUTE, window_seconds=60, size=PIECE_ROWS):
    """Calls of each slot in the trailing window at every instant, and the wait they imply.

    The window is open at its far end: a call exactly ``window_seconds`` old no longer
    counts. Calls are first counted per instant; each count enters at its instant and leaves
    ``window_seconds`` later, so the calls in the window are a running sum, and the oldest of
    them is the next one to leave. Both are scanned in pieces of about ``size`` rows: a sum
    and a first leaving time for each piece, carried to the others. A slot of any size, with a
    window of any length, is spread over its pieces.
    """
    width = int(window_seconds * 1_000_000)
    instants = calls.groupBy("slot", "atMicros").agg(F.count("*").alias("callsAt"))
    # step 0: calls leave the window, 1: calls of this instant
    own = instants.select("slot", "atMicros", F.lit(1).alias("step"), "callsAt")
    leaving = instants.select(
        "slot",
        (F.col("atMicros") + width).alias("atMicros"),
        F.lit(0).alias("step"),
        (-F.col("callsAt")).alias("callsAt"),
    )
    key, order = ["slot"], ["atMicros", "step"]
    pieces = in_pieces(own.unionByName(leaving), key, order, size)
    left = F.when(F.col("step") == 0, F.col("atMicros") - width)
    summed = scan_pieces(
        pieces, key, order, {"inPiece": (F.col("callsAt"), F.sum)}, {"before": (F.col("callsAt"), F.sum)}
    )
    audited = scan_pieces(
        summed, key, order, {"next": (left, F.min)}, {"nextLater": (left, F.min)}, backward=True
    ).filter("step = 1")
    in_window = F.col("inPiece") + F.coalesce("before", F.lit(0))
    audited = audited.withColumns(
        {"callsInWindow": in_window, "oldestMicros": F.coalesce("next", "nextLater")}
    )
    over = F.col("callsInWindow") > budget
    return audited.select(
        "slot",
        "atMicros",
        "callsAt",
        "callsInWindow",
        "oldestMicros",
        over.alias("overBudget"),
        F.when(over, width - (F.col("atMicros") - F.col("oldestMicros")) + 100_000)
        .otherwise(0)
        .alias("waitMicros"),
    )


def open_calls(attempts, size=PIECE_ROWS):
    """How many attempts are under way from each moment on: (atMs, open).

    ``attempts`` has (startMs, endMs). One that ends at the moment another starts is over.
    """
    starts = attempts.select(F.lit("all").alias("of"), F.col("startMs").alias("atMs"), F.lit(1).alias("change"))
    ends = attempts.select(F.lit("all").alias("of"), F.col("endMs").alias("atMs"), F.lit(-1).alias("change"))
    moments = starts.unionByName(ends).groupBy("of", "atMs", "change").agg(F.sum("change").alias("more"))
    order = ["atMs", "change"]
    more = (F.col("more"), F.sum)
    swept = scan_pieces(in_pieces(moments, ["of"], order, size), ["of"], order, {"here": more}, {"before": more})
    return swept.select("atMs", (F.col("here") + F.coalesce("before", F.lit(0))).alias("open"))
