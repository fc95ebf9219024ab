"""Comment preparation: explode, validate, clean, default, dedupe, derive, project."""

from pyspark.sql import functions as F

from threadloom import fixed_values as fixed
from threadloom.functions import text
from threadloom.operators.skew import first_per_key
from threadloom.schemas import CLEANED_BATCH, CLEANED_STREAM

REQUIRED_BATCH = ("commentId", "postId", "commentText", "postText")
REQUIRED_STREAM = REQUIRED_BATCH + ("userId",)


def explode_comments(posts):
    """One row per comment with its post's context; posts without comments vanish."""
    return posts.select(
        "postId",
        F.col("title").alias("postTitle"),
        "postText",
        "imageUrl",
        "imageCaption",
        "subreddit",
        F.explode("comments").alias("comment"),
    ).select(
        F.col("comment.commentId"),
        "postId",
        F.col("comment.userId"),
        F.col("comment.username"),
        "postTitle",
        "postText",
        F.col("comment.commentText"),
        "imageUrl",
        "imageCaption",
        "subreddit",
        F.col("comment.timestamp"),
        F.col("comment.upvotes"),
        F.col("comment.parentCommentId"),
    ).filter(F.col("commentId").isNotNull())


def is_valid(required):
    """True when every required field is present and not the empty string.

    Plain comparisons, so that as a filter they reach the scan.
    """
    checks = [F.col(name).isNotNull() & (F.col(name) != "") for name in required]
    condition = checks[0]
    for check in checks[1:]:
        condition = condition & check
    return condition


def validate(comments, required=REQUIRED_BATCH):
    return comments.filter(is_valid(required))


CLEANERS = {
    "postText": text.clean_body,
    "commentText": text.clean_body,
    "title": text.clean_title,
    "postTitle": text.clean_title,
    "username": text.clean_name,
    "subreddit": text.clean_label,
}


def has_text(fields=("commentText", "postText")):
    """Whether every given field has something left after cleaning."""
    condition = F.lit(True)
    for name in fields:
        condition = condition & text.survives_cleaning(F.col(name))
    return condition


def drop_empty_after_clean(comments):
    return comments.filter(has_text())


def clean_fields(frame, *names):
    return frame.withColumns({name: CLEANERS[name](F.col(name)) for name in names})


def clean_text(comments):
    """Clean all text fields present and drop rows left without a post or comment text."""
    present = [name for name in CLEANERS if name in comments.columns]
    return clean_fields(drop_empty_after_clean(comments), *present)


def explode_clean_comments(posts):
    """Explode, validate and clean nested posts, giving what ``clean_text`` gives.

    Posts are checked and cleaned before the explode: once per post, not once per comment.
    """
    ready = posts.filter(is_valid(("postId", "postText")) & has_text(("postText",)))
    flat = explode_comments(clean_fields(ready, "postText", "title", "subreddit"))
    valid = flat.filter(is_valid(("commentId", "commentText")) & has_text(("commentText",)))
    return clean_fields(valid, "commentText", "username")


def fill_defaults(comments, now_ms):
    """Replace nulls only: a name that cleaned to the empty string stays empty."""
    defaults = {**fixed.DEFAULTS, "timestamp": now_ms}
    return comments.fillna({k: v for k, v in defaults.items() if k in comments.columns})


def dedupe_comments(comments):
    """One row per comment id: the earliest, then the smallest in column order."""
    others = [c for c in comments.columns if c not in ("commentId", "timestamp")]
    return first_per_key(comments, ["commentId"], ["timestamp", *others])


def image_features(comments):
    """Flags for image and caption, and the placeholder for an image without caption."""
    has_image = F.coalesce(F.col("imageUrl") != "", F.lit(False))
    has_caption = F.coalesce(F.col("imageCaption") != "", F.lit(False))
    return comments.withColumns(
        {
            "hasImage": has_image,
            "hasCaption": has_caption,
            "imageCaption": F.when(has_image & ~has_caption, fixed.CAPTION_PLACEHOLDER).otherwise(
                F.col("imageCaption")
            ),
        }
    )


def text_features(comments, now_ms):
    return comments.withColumns(
        {
            "wordCount": text.word_count(F.col("commentText")),
            "charCount": F.length("commentText"),
            "processedAt": F.lit(now_ms).cast("bigint"),
        }
    )


def reply_flag(comments):
    return comments.withColumn(
        "isReply", F.coalesce(F.col("parentCommentId") != "", F.lit(False))
    )


def project_batch(comments):
    return comments.select(*CLEANED_BATCH.fieldNames())


def project_stream(comments):
    return comments.select(*CLEANED_STREAM.fieldNames())


def size_partitions(frame, rows, target_rows=500):
    """Spread ``rows`` rows evenly over ceil(rows / target_rows) partitions.

    Plain pipelines leave sizing to adaptive execution; this is for handing rows to an
    external service.
    """
    return frame.repartition(max(1, -(-rows // target_rows)))
