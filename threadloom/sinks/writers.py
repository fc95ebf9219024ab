"""Sinks. Every write replaces its own earlier attempt, so retries leave one copy."""

from threadloom.operators import state


def write_json(frame, path):
    """JSON Lines, overwriting ``path``."""
    frame.write.mode("overwrite").json(path)


def write_batch_json(frame, root, batch_id):
    """Output of one micro-batch; a repeated batch overwrites its own folder."""
    path = f"{root}/batch_id={batch_id}"
    frame.write.mode("overwrite").json(path)
    return path


def land_raw_posts(posts, path, job_id):
    """Raw zone: parsed posts as parquet in the job's own partition folder."""
    target = f"{path}/job_id={job_id}"
    posts.write.mode("overwrite").parquet(target)
    return target


def append_new_rows(spark, incoming, path, key, order):
    """Insert-or-ignore into a parquet table."""
    target = spark.read.parquet(path)
    fresh = state.new_rows(incoming, target, key, order)
    fresh.select(*target.columns).write.mode("append").parquet(path)


def append_status(event, path):
    event.write.mode("append").parquet(path)


def export_job_results(results, path):
    """A job's rows as JSON Lines part files, written in parallel."""
    results.write.mode("overwrite").json(path)


def publish(messages, sink="kafka", path=None, **options):
    """Send key/value messages; ``sink="json"`` with a path stands in for a topic."""
    writer = messages.write.format(sink).options(**options)
    if path:
        writer.mode("overwrite").save(path)
    else:
        writer.save()
