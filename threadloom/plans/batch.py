"""The batch flow from nested posts to enriched output."""

import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.operators import comments as prep
from threadloom.operators import enrich, inference, packing, state
from threadloom.sinks import writers
from threadloom.sources import readers
from threadloom.streaming import commits


def _finish(cleaned, now_ms):
    return (
        cleaned.transform(prep.fill_defaults, now_ms)
        .transform(prep.dedupe_comments)
        .transform(prep.image_features)
        .transform(prep.text_features, now_ms)
    )


def preprocess_comments(comments, now_ms):
    """Flat comments to the 14 cleaned batch columns."""
    cleaned = prep.clean_text(prep.validate(comments, prep.REQUIRED_BATCH))
    return prep.project_batch(_finish(cleaned, now_ms))


def preprocess_batch(posts, now_ms):
    """Nested posts to the 14 cleaned batch columns."""
    return prep.project_batch(_finish(prep.explode_clean_comments(posts), now_ms))


def preprocess_events(events, now_ms):
    """Comment events to the 14 cleaned streaming columns, on a static frame."""
    cleaned = prep.clean_text(prep.validate(events, prep.REQUIRED_STREAM))
    return prep.project_stream(prep.reply_flag(_finish(cleaned, now_ms)))


def run_job(
    spark,
    input_path,
    output_path,
    work_path,
    job_id,
    provider,
    multiline=False,
    now_ms=None,
    floor=None,
    captions=None,
    answers=None,
    **limits,
):
    """Run one job and keep its state as rows in ``work_path/status``.

    Each stage is written once under ``work_path`` and read back: the input is parsed once,
    the provider is called once per call, and a lost executor repeats tasks of one stage. Row
    counts are observed while the stages are written. A multi-line upload, which cannot be
    split, is landed as parquet first. With ``captions``, a provider ``(image_url, context) ->
    str``, posts without a caption for their image get one before they are prepared; ``answers``
    (``inference.answer_store``) keeps captions over jobs, in the job's folder if none is given.
    ``limits`` are those of ``answer_stored``: rounds,
    resume, concurrency, attempts, first_wait. Returns the enriched output.
    """
    started = int(time.time() * 1000)
    now_ms = now_ms if now_ms is not None else started

    def report(status, total=0, processed=0, end=0, error=None):
        event = state.status_event(
            spark, job_id, status, input_path, output_path, total, processed, started, end, error
        )
        writers.append_status(event, f"{work_path}/status")

    def store(frame, label):
        path = f"{work_path}/{label}/job_id={job_id}"
        frame.write.mode("overwrite").parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    def counted(frame, label):
        seen = Observation()
        stored = store(frame.observe(seen, F.count(F.lit(1)).alias("rows")), label)
        return stored, seen.get["rows"]

    try:
        report("processing")
        posts = readers.read_nested_posts(spark, input_path, multiline)
        if multiline:
            raw = writers.land_raw_posts(posts, f"{work_path}/raw", job_id)
            posts = spark.read.schema(schemas.NESTED_POST).parquet(raw)
        if captions:
            kept = answers or inference.answer_store(f"{work_path}/captions")
            named = commits.Batch(spark, kept.path, f"job-{job_id}-{started}", 0, "captions")
            posts = inference.caption_missing(posts, captions, kept, named, started)
        prepared = preprocess_batch(posts, now_ms).withColumn(
            "postKey", packing.post_key(F.col("postText"))
        )
        cleaned, total = counted(prepared, "cleaned")
        report("inferring", total)
        replies, processed = counted(
            inference.generate_replies(
                packing.as_items(cleaned),
                provider,
                f"{work_path}/calls/job_id={job_id}",
                floor,
                report=lambda done: report("inferring", total, done),
                **limits,
            ).select(
                F.col("id").alias("commentId"),
                F.col("generated_reply").alias("generatedReply"),
                F.col("latency_ms").alias("inferenceLatencyMs"),
                F.lit(now_ms).cast("bigint").alias("processedAt"),
                "status",
            ),
            "replies",
        )
        # a resumed job with other input may have as many replies, but not to these comments
        unanswered = cleaned.select("commentId").join(replies, "commentId", "left_anti").count()
        if processed != total or unanswered:
            raise RuntimeError(f"{processed} replies for {total} comments, {unanswered} of them without one")
        writers.write_json(
            enrich.enrich_with_replies(cleaned, replies, one_reply_each=True), output_path
        )
        report("completed", total, processed, int(time.time() * 1000))
    except Exception as error:
        report("failed", end=int(time.time() * 1000), error=str(error))
        raise
    return readers.read_results(spark, output_path)
