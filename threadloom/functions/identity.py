"""Stable ids, hash buckets and times."""

from pyspark.sql import functions as F

POINT_BITS = 40


def hash_point(key):
    """Place of a hex digest on a line of 2**40 points, keeping the digest's order."""
    return F.conv(F.substring(key, 1, POINT_BITS // 4), 16, 10).cast("bigint")


def hash_bucket(text, buckets):
    """Bucket of a string, evenly spread and the same in every run."""
    return hash_point(F.md5(text)) % buckets


def reply_id(comment_id, provider_version):
    """One id per (comment, provider version): a repeated publish keeps its id."""
    return F.sha2(F.concat_ws("|", comment_id, F.lit(provider_version)), 256)


def event_time(epoch_ms):
    return F.timestamp_millis(epoch_ms)


def epoch_micros(moment):
    """Microseconds since 1970 of a timestamp read without zone, in the session zone UTC."""
    return F.unix_micros(moment.cast("timestamp"))


def relative_age(epoch_ms, now_ms):
    """``42s ago``, ``5m ago``, ``3h ago`` or ``2d ago``."""
    seconds = F.floor((F.lit(now_ms) - epoch_ms) / 1000)
    label = lambda unit, letter: F.concat(
        F.floor(seconds / unit).cast("string"), F.lit(f"{letter} ago")
    )
    return (
        F.when(seconds < 60, label(1, "s"))
        .when(seconds < 3600, label(60, "m"))
        .when(seconds < 86400, label(3600, "h"))
        .otherwise(label(86400, "d"))
    )


def progress_percent(status, processed, total):
    """100 only when completed; otherwise rounded half up and held at 99."""
    share = F.floor(F.try_divide(F.coalesce(processed, F.lit(0)), total) * 100 + 0.5)
    return (
        F.when(status == "completed", 100)
        .when(total.isNull() | (total == 0), 0)
        .otherwise(F.least(share, F.lit(99)))
        .cast("int")
    )
