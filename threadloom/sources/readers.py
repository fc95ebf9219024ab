"""Batch sources and the decoding of message values."""

from pyspark.sql import functions as F

from threadloom import schemas


def read_nested_posts(spark, path, multiline=False):
    """Nested posts as JSON, one row per post.

    JSON Lines split across tasks. ``multiline`` reads a file holding one JSON array, which
    Spark must give to a single task per file: use it for uploads only and land them with
    ``land_raw_posts``.
    """
    return spark.read.schema(schemas.NESTED_POST).json(path, multiLine=multiline)


def read_results(spark, path, schema=schemas.ENRICHED, glob="*.json"):
    """All JSON part files of a job. Blank and undecodable lines are left out."""
    return (
        spark.read.schema(schema)
        .option("mode", "DROPMALFORMED")
        .option("pathGlobFilter", glob)
        .json(path)
    )


def read_table(spark, path):
    return spark.read.parquet(path)


def decode(messages, schema, value="value"):
    """Columns out of JSON message values. Bad values give nulls, not errors.

    ``inline`` keeps filters on the columns above the parsing: below it, each would parse anew.
    """
    data = F.from_json(F.col(value).cast("string"), schema)
    return messages.select(F.inline(F.array(data)))


def undecodable(messages, schema, value="value"):
    """Messages none of whose fields can be read, with their raw value."""
    data = F.from_json(F.col(value).cast("string"), schema)
    read = F.coalesce(*[data[f.name].cast("string") for f in schema if not hasattr(f.dataType, "keyType")])
    return messages.filter(read.isNull())


def decode_comment_events(messages, value="value"):
    return decode(messages, schemas.COMMENT_EVENT, value)


def decode_post_events(messages, value="value"):
    """Posts with a key; what has none cannot be stored. See ``rejected_posts``."""
    return decode(messages, schemas.POST_EVENT, value).filter("postId is not null")


def rejected_posts(messages, value="value"):
    """The messages that ``decode_post_events`` leaves out, as they are."""
    read = F.from_json(F.col(value).cast("string"), schemas.POST_EVENT)
    return messages.filter(read["postId"].isNull())


def rejected_replies(messages, value="value"):
    """The messages that ``decode_replies`` leaves out, as they are."""
    return undecodable(messages, schemas.REPLY_EVENT, value)


def decode_replies(messages, now_ms=None, value="value"):
    """Reply messages with their defaults; those of which nothing can be read are left out.

    A missing id becomes a hash of what the message holds, before the clock fills a missing
    time: delivered again, it has the same id.
    """
    now = F.lit(now_ms) if now_ms is not None else F.unix_millis(F.current_timestamp())
    names = schemas.REPLY_EVENT.fieldNames()
    read = decode(messages, schemas.REPLY_EVENT, value).dropna("all", subset=names)
    filled = read.fillna("", subset=["commentId", "postId", "generatedReply"])
    row = F.concat_ws(
        "|", "commentId", "postId", "generatedReply", F.col("timestamp").cast("string")
    )
    return filled.withColumn("replyId", F.coalesce("replyId", F.sha2(row, 256))).withColumn(
        "timestamp", F.coalesce("timestamp", now)
    )
