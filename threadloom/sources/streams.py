"""Stream sources. The format is a parameter: a topic in production, files in tests."""

from threadloom.sources.readers import decode_comment_events, decode_post_events, decode_replies

COMMENTS_TOPIC = "comments_topic"
POSTS_TOPIC = "posts_topic"
REPLIES_TOPIC = "replies_topic"


def topic_options(
    servers, topic, starting="earliest", max_per_trigger=10_000, group=None, **more
):
    """Options of a Kafka source. The connector jar must be on the cluster's class path."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": "false",
        "maxOffsetsPerTrigger": str(max_per_trigger),
        **more,
    }
    if group:
        options["kafka.group.id"] = group
    return options


def message_stream(spark, source="kafka", path=None, **options):
    """Streaming frame with a ``value`` column.

    ``source="text"`` reads files of JSON lines from ``path``; ``maxFilesPerTrigger`` then
    plays the part of ``maxOffsetsPerTrigger``.
    """
    reader = spark.readStream.format(source).options(**options)
    return reader.load(path) if path else reader.load()


def comment_stream(spark, **source):
    return decode_comment_events(message_stream(spark, **source))


def post_stream(spark, **source):
    return decode_post_events(message_stream(spark, **source))


def reply_stream(spark, now_ms=None, **source):
    """Published replies; a live consumer starts at the latest offset (``starting``)."""
    return decode_replies(message_stream(spark, **source), now_ms)
