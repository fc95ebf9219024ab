"""Packing items into calls of at most ten comments.

Items are (id, post_text, comment_text, image_caption). Items whose posts share their first
200 characters form a group. A group of two or more is cut into calls of its own; items alone
in their group are pooled per request bucket and cut into calls of mixed posts. The bucket is
a hash of the post prefix modulo ceil(items / items per request).
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom import fixed_values as fixed
from threadloom.functions import prompts
from threadloom.functions.identity import hash_point
from threadloom.functions.text import post_prefix
from threadloom.operators.skew import LARGE_GROUP_FLOOR, chunk_rows, with_group_positions


def post_key(text):
    """Stands for the post's 200-character prefix, so shuffles carry a short key."""
    return F.sha2(post_prefix(text), 256)


def as_items(comments):
    """Cleaned comments in the shape the calls take. A stored ``postKey`` is kept."""
    return comments.select(
        F.col("commentId").alias("id"),
        F.col("postText").alias("post_text"),
        F.col("commentText").alias("comment_text"),
        F.col("imageCaption").alias("image_caption"),
        *[name for name in comments.columns if name == "postKey"],
    )


def with_post_key(items):
    """Adds ``postKey`` unless it was stored with the items: then counting the groups reads
    that one column and no texts."""
    if "postKey" in items.columns:
        return items
    return items.withColumn("postKey", post_key(F.col("post_text")))


def group_by_post_prefix(items):
    return with_post_key(items).groupBy("postKey").agg(F.count("*").alias("items"))


def pack_calls(
    items,
    per_call=fixed.COMMENTS_PER_CALL,
    per_request=fixed.ITEMS_PER_REQUEST,
    floor=LARGE_GROUP_FLOOR,
):
    """Assign every item a call: adds ``bucket``, ``kind``, ``callId`` and ``pos``.

    A pool holds single posts only, spread by hash, so no pool outgrows a task. Both branches
    share one shuffle of the numbered items.
    """
    keyed = with_post_key(items).withColumn("itemKey", F.md5("id"))
    buckets = F.ceil(keyed.agg(F.count("*")).scalar() / per_request)
    chunked = chunk_rows(keyed, "postKey", "itemKey", "id", per_call, floor).withColumn(
        "bucket", hash_point(F.col("postKey")) % buckets
    )
    same = chunked.filter("groupRows > 1").withColumns(
        {
            "kind": F.lit("same_post"),
            "callId": F.concat_ws("-", "postKey", F.col("chunk").cast("string")),
        }
    )
    pool = Window.partitionBy("bucket").orderBy("itemKey", "id")
    mixed = (
        chunked.filter("groupRows = 1")
        .withColumn("_place", F.row_number().over(pool) - 1)
        .withColumns(
            {
                "kind": F.lit("mixed_post"),
                "pos": (F.col("_place") % per_call + 1).cast("int"),
                "callId": F.concat_ws(
                    "-",
                    F.lit("mixed"),
                    F.col("bucket").cast("string"),
                    F.floor(F.col("_place") / per_call).cast("string"),
                ),
            }
        )
    )
    columns = [
        "callId", "kind", "bucket", "postKey", "pos", "id", "post_text", "comment_text",
        "image_caption",
    ]
    return same.select(columns).unionByName(mixed.select(columns))


def build_calls(packed):
    """One row per call: its items in order, the prompt and the token budget.

    At most ten items meet in a row. In a same-post call only the first item carries the post.
    """
    carries_post = (F.col("kind") == "mixed_post") | (F.col("pos") == 1)
    slim = packed.withColumns(
        {
            "post_text": F.when(
                carries_post,
                F.when(F.col("kind") == "mixed_post", post_prefix(F.col("post_text"))).otherwise(
                    F.col("post_text")
                ),
            ),
            "image_caption": F.when(carries_post, F.col("image_caption")),
        }
    )
    calls = slim.groupBy("callId", "kind", "bucket").agg(
        F.sort_array(
            F.collect_list(F.struct("pos", "id", "post_text", "comment_text", "image_caption"))
        ).alias("items")
    )
    same_post = F.col("kind") == "same_post"
    return calls.withColumns(
        {
            "size": F.size("items"),
            "prompt": F.when(same_post, prompts.same_post_prompt(F.col("items"))).otherwise(
                prompts.mixed_prompt(F.col("items"))
            ),
            "maxTokens": prompts.token_budget(F.col("kind"), F.size("items")),
        }
    )


def assign_slots(calls, slots, floor=LARGE_GROUP_FLOOR):
    """Deal the calls of each bucket to the key slots in turn.

    Each bucket starts at another slot, so that many short buckets load all slots alike.
    """
    keyed = calls.withColumn("_callKey", F.md5("callId"))
    numbered = with_group_positions(keyed, "bucket", "_callKey", "callId", floor)
    turn = F.col("position") - 1 + F.col("bucket")
    return numbered.withColumn("slot", (turn % slots).cast("int")).drop(
        "_callKey", "position", "groupRows"
    )


def packing_report(packed):
    """Items, post groups, calls, reduction factor and items in mixed calls."""
    per_call = packed.groupBy("callId", "kind").agg(F.count("*").alias("n"))
    groups = group_by_post_prefix(packed).agg(F.count("*")).scalar()
    totals = per_call.agg(
        F.sum("n").alias("items"),
        F.count("*").alias("calls"),
        F.coalesce(F.sum(F.when(F.col("kind") == "mixed_post", F.col("n"))), F.lit(0)).alias(
            "mixedItems"
        ),
        F.max("n").alias("largestCall"),
        F.sum(prompts.token_budget(F.col("kind"), F.col("n"))).alias("tokens"),
    )
    return totals.withColumns(
        {
            "postGroups": groups,
            "itemsPerPost": F.round(F.col("items") / F.greatest(groups, F.lit(1)), 1),
            "itemsPerCall": F.round(F.col("items") / F.greatest("calls", F.lit(1)), 1),
        }
    )
