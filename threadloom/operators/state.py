"""Tables with keys: conditional inserts, latest state, changes and integrity checks."""

from pyspark.sql import functions as F

from threadloom.operators.skew import first_per_key


def new_rows(incoming, target, key, order):
    """Rows an insert-or-ignore adds: the first per key, unless the target has the key.

    The target is first narrowed to the incoming keys. With few incoming rows Spark then
    broadcasts those and only scans the target's key column, instead of shuffling all of it.
    """
    first = first_per_key(incoming, [key], order)
    known = target.select(key).join(incoming.select(key).distinct(), key, "left_semi")
    return first.join(known, key, "left_anti")


def insert_or_ignore(incoming, target, key, order):
    """Content of the target after the insert."""
    return target.unionByName(new_rows(incoming, target, key, order).select(*target.columns))


def latest_per_key(events, key, order):
    """Current state from appended events: the last event per key in ``order``."""
    return first_per_key(events, [key], [F.col(name).desc() for name in order])


def changed_rows(new, old, key, compared):
    """New rows whose compared columns differ from the stored row of the same key."""
    before = old.select(key, *[F.col(c).alias(f"old_{c}") for c in compared])
    differs = F.lit(False)
    for column in compared:
        differs = differs | ~F.col(column).eqNullSafe(F.col(f"old_{column}"))
    return new.join(before, key).filter(differs)


def missing_references(child, fk, parent, pk, edge):
    """Foreign keys without a parent row and the number of rows that use each.

    The child is counted per key before the join, so a hot key is one row by then.
    """
    used = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("key")).agg(
        F.count("*").alias("rows")
    )
    return used.join(parent.select(F.col(pk).alias("key")), "key", "left_anti").select(
        F.lit(edge).alias("edge"), "key", "rows"
    )


def fk_violations(users, posts, comments):
    return (
        missing_references(comments, "postId", posts, "postId", "comments.postId")
        .unionByName(missing_references(comments, "userId", users, "userId", "comments.userId"))
        .unionByName(missing_references(posts, "userId", users, "userId", "posts.userId"))
    )


def repeated_keys(table, key, name):
    return (
        table.groupBy(F.col(key).alias("key"))
        .agg(F.count("*").alias("rows"))
        .filter("rows > 1")
        .select(F.lit(name).alias("constraint"), "key", "rows")
    )


def pk_violations(tables):
    """Keys held by more than one row. ``tables`` is a list of (frame, key, name)."""
    found = [repeated_keys(*entry) for entry in tables]
    result = found[0]
    for frame in found[1:]:
        result = result.unionByName(frame)
    return result


def failure_events(attempts, message):
    """Failure records of jobs that broke: status, zero counts and the message."""
    return attempts.select(
        "jobId",
        F.lit("failed").alias("status"),
        "inputPath",
        "outputPath",
        F.lit(0).cast("bigint").alias("totalRecords"),
        F.lit(0).cast("bigint").alias("processedRecords"),
        message.alias("error"),
    )


def status_event(
    spark, job_id, status, input_path, output_path, total, processed, start, end, error=None
):
    """One row for the job status table."""
    from threadloom.schemas import JOB_STATUS

    row = (job_id, status, input_path, output_path, total, processed, start, end, error)
    return spark.createDataFrame([row], JOB_STATUS)
