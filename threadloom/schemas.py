"""Declared schemas. Nothing is inferred at read time.

Fixed values: names, types and order are part of the data contract.
"""

from pyspark.sql import types as T

STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()

NESTED_COMMENT = T.StructType(
    [
        T.StructField("commentId", STRING),
        T.StructField("userId", STRING),
        T.StructField("username", STRING),
        T.StructField("commentText", STRING),
        T.StructField("timestamp", LONG),
        T.StructField("upvotes", INT),
        T.StructField("parentCommentId", STRING),
    ]
)

NESTED_POST = T.StructType(
    [
        T.StructField("postId", STRING),
        T.StructField("userId", STRING),
        T.StructField("username", STRING),
        T.StructField("title", STRING),
        T.StructField("postText", STRING),
        T.StructField("subreddit", STRING),
        T.StructField("imageUrl", STRING),
        T.StructField("imageCaption", STRING),
        T.StructField("timestamp", LONG),
        T.StructField("upvotes", INT),
        T.StructField("comments", T.ArrayType(NESTED_COMMENT, containsNull=True)),
    ]
)

COMMENT_EVENT = T.StructType(
    [
        T.StructField("commentId", STRING),
        T.StructField("postId", STRING),
        T.StructField("userId", STRING),
        T.StructField("username", STRING),
        T.StructField("postText", STRING),
        T.StructField("commentText", STRING),
        T.StructField("imageUrl", STRING),
        T.StructField("imageCaption", STRING),
        T.StructField("subreddit", STRING),
        T.StructField("timestamp", LONG),
        T.StructField("parentCommentId", STRING),
        T.StructField("upvotes", INT),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

POST_EVENT = T.StructType(
    [
        T.StructField("postId", STRING),
        T.StructField("userId", STRING),
        T.StructField("username", STRING),
        T.StructField("title", STRING),
        T.StructField("postText", STRING),
        T.StructField("subreddit", STRING),
        T.StructField("imageUrl", STRING),
        T.StructField("imageCaption", STRING),
        T.StructField("createdAt", LONG),
    ]
)

REPLY_EVENT = T.StructType(
    [
        T.StructField("replyId", STRING),
        T.StructField("commentId", STRING),
        T.StructField("postId", STRING),
        T.StructField("generatedReply", STRING),
        T.StructField("timestamp", LONG),
    ]
)

CLEANED_BATCH = T.StructType(
    [
        T.StructField("commentId", STRING),
        T.StructField("postId", STRING),
        T.StructField("userId", STRING),
        T.StructField("username", STRING),
        T.StructField("postTitle", STRING),
        T.StructField("postText", STRING),
        T.StructField("commentText", STRING),
        T.StructField("imageCaption", STRING),
        T.StructField("subreddit", STRING),
        T.StructField("timestamp", LONG),
        T.StructField("upvotes", INT),
        T.StructField("wordCount", INT),
        T.StructField("charCount", INT),
        T.StructField("processedAt", LONG),
    ]
)

CLEANED_STREAM = T.StructType(
    [
        T.StructField("commentId", STRING),
        T.StructField("postId", STRING),
        T.StructField("userId", STRING),
        T.StructField("username", STRING),
        T.StructField("postText", STRING),
        T.StructField("commentText", STRING),
        T.StructField("imageCaption", STRING),
        T.StructField("subreddit", STRING),
        T.StructField("timestamp", LONG),
        T.StructField("parentCommentId", STRING),
        T.StructField("upvotes", INT),
        T.StructField("wordCount", INT),
        T.StructField("charCount", INT),
        T.StructField("processedAt", LONG),
    ]
)

ENRICHED = T.StructType(
    [
        T.StructField("commentId", STRING),
        T.StructField("postId", STRING),
        T.StructField("userId", STRING),
        T.StructField("username", STRING),
        T.StructField("postTitle", STRING),
        T.StructField("postText", STRING),
        T.StructField("commentText", STRING),
        T.StructField("imageCaption", STRING),
        T.StructField("subreddit", STRING),
        T.StructField("timestamp", LONG),
        T.StructField("generatedReply", STRING),
        T.StructField("inferenceLatencyMs", LONG),
        T.StructField("processedAt", LONG),
    ]
)

STREAM_REPLY = T.StructType(
    [
        T.StructField("replyId", STRING),
        T.StructField("commentId", STRING),
        T.StructField("postId", STRING),
        T.StructField("userId", STRING),
        T.StructField("postText", STRING),
        T.StructField("commentText", STRING),
        T.StructField("generatedReply", STRING),
        T.StructField("subreddit", STRING),
        T.StructField("inferenceLatencyMs", LONG),
        T.StructField("generatedAt", LONG),
        T.StructField("status", STRING),
    ]
)

ITEM_REPLY = T.StructType(
    [
        T.StructField("id", STRING),
        T.StructField("generated_reply", STRING),
        T.StructField("latency_ms", LONG),
    ]
)

JOB_STATUS = T.StructType(
    [
        T.StructField("jobId", STRING),
        T.StructField("status", STRING),
        T.StructField("inputPath", STRING),
        T.StructField("outputPath", STRING),
        T.StructField("totalRecords", LONG),
        T.StructField("processedRecords", LONG),
        T.StructField("startTime", LONG),
        T.StructField("endTime", LONG),
        T.StructField("error", STRING),
    ]
)
