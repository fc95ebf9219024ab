"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threadloom.operators.inference import offline_provider  # noqa: E402
from threadloom.plans import batch, bridge  # noqa: E402
from threadloom.plans.registry import QUERIES  # noqa: E402
from threadloom.session import get_session, scratch_dir  # noqa: E402
from threadloom.sinks.writers import write_json  # noqa: E402

HEADLINE = [
    "preprocess_batch",
    "preprocess_stream",
    "clean_documents",
    "dedupe_comments",
    "quality_funnel",
    "quality_profile",
    "pack_calls",
    "prompt_same_post",
    "generate_replies",
    "union_ok_and_error",
    "enrich_with_replies",
    "feed_with_counts",
    "thread_view",
    "insert_or_ignore",
    "latest_status_by_key",
    "rate_budget_audit",
    "recent_replies_topk",
    "live_buffer",
    "job_progress",
    "chunk_rows",
    "throughput_per_minute",
    "decode_events",
    "scan_nested_posts",
    "stream_enrich_comments",
    "stream_dedupe",
    "stream_end_to_end",
]


def timed(action):
    start = time.perf_counter()
    result = action()
    return round(time.perf_counter() - start, 3), result


def run_query(spark, name, sf_dir):
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def run_job(spark, sf_dir):
    """The whole batch job on nested JSON; returns seconds and comments per second."""
    source = scratch_dir(spark, "upload")
    write_json(bridge.nested_posts(spark, sf_dir), source)
    comments = bridge.comments(spark, sf_dir).count()
    out, work = scratch_dir(spark, "out"), scratch_dir(spark, "work")
    seconds, _ = timed(lambda: batch.run_job(spark, source, out, work, "bench", offline_provider))
    return seconds, round(comments / seconds, 1)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    run_query(spark, "preprocess_batch", sf_dir)  # warm up the JVM and the file cache
    seconds = {name: timed(lambda: run_query(spark, name, sf_dir))[0] for name in HEADLINE}
    seconds["batch_job"], rate = run_job(spark, sf_dir)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "batch_job_comments_per_sec": rate,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
