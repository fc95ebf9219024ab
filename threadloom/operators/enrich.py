"""Joins between comments, posts and replies, and the messages built from them."""

from pyspark.sql import functions as F

from threadloom import fixed_values as fixed
from threadloom.functions.identity import reply_id
from threadloom.operators.skew import left_join_many
from threadloom.schemas import ENRICHED


def enrich_with_replies(comments, replies, one_reply_each=False):
    """Every cleaned comment with its replies, or nulls where it has none.

    ``processedAt`` is the reply's. With ``one_reply_each`` the reply side is known to be
    unique per comment and a plain left join is enough.
    """
    left = comments.drop("processedAt")
    right = replies.select("commentId", "generatedReply", "inferenceLatencyMs", "processedAt")
    joined = (
        left.join(right, "commentId", "left")
        if one_reply_each
        else left_join_many(left, right, "commentId")
    )
    return joined.select(*ENRICHED.fieldNames())


def with_reply_metadata(replies, comments):
    """Replies with the post fields of their comment; fixed defaults where it is unknown.

    No size hint: adaptive execution broadcasts the comments only when they are small, and
    splits a hot comment id on the reply side.
    """
    defaults = fixed.UNKNOWN_POST
    known = comments.select("commentId", *defaults, F.lit(True).alias("_known"))
    joined = replies.select(*[c for c in replies.columns if c not in defaults]).join(
        known, "commentId", "left"
    )
    return joined.withColumns(
        {
            name: F.when(F.col("_known"), F.col(name)).otherwise(default)
            for name, default in defaults.items()
        }
    ).drop("_known")


def as_stream_replies(item_replies, comments, provider_version, now_ms):
    """Generated replies in the ten-column streaming form, plus their status."""
    replies = item_replies.select(
        F.col("id").alias("commentId"),
        F.col("generated_reply").alias("generatedReply"),
        F.col("latency_ms").alias("inferenceLatencyMs"),
        "status",
    )
    return with_reply_metadata(replies, comments).select(
        reply_id(F.col("commentId"), provider_version).alias("replyId"),
        "commentId",
        "postId",
        "userId",
        "postText",
        "commentText",
        "generatedReply",
        "subreddit",
        F.col("inferenceLatencyMs").cast("bigint").alias("inferenceLatencyMs"),
        F.lit(now_ms).cast("bigint").alias("generatedAt"),
        "status",
    )


def comment_events(comments, posts):
    """New comments with their post's context, in the shape of a comment event.

    Comments on unknown posts are rejected; see ``orphan_comments``.
    """
    context = posts.select("postId", "postText", "imageUrl", "imageCaption", "subreddit")
    return comments.join(context, "postId").select(
        "commentId",
        "postId",
        "userId",
        "username",
        "postText",
        "commentText",
        "imageUrl",
        "imageCaption",
        "subreddit",
        F.col("createdAt").alias("timestamp"),
        "parentCommentId",
        F.lit(0).alias("upvotes"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


def orphan_comments(comments, posts):
    return comments.join(posts.select("postId"), "postId", "left_anti")


def as_messages(rows, key, columns):
    """Key and JSON value of a message per row, null fields included."""
    return rows.select(
        F.col(key).alias("key"),
        F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"),
    )


def encode_comment_events(events):
    return as_messages(events, "commentId", events.columns)


def encode_reply_messages(replies):
    """Reply messages; only real replies are published, never error texts."""
    real = replies.filter("status = 'ok'") if "status" in replies.columns else replies
    return as_messages(
        real,
        "replyId",
        [
            "replyId",
            "commentId",
            "postId",
            "generatedReply",
            F.col("generatedAt").alias("timestamp"),
        ],
    )
