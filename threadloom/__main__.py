"""Run the flows from the command line: ``python -m threadloom batch|stream ...``.

With spark-submit the session settings come from the cluster's configuration.
"""

import argparse
import importlib

from threadloom.plans import batch
from threadloom.session import get_session
from threadloom.sources import streams
from threadloom.streaming import comments


def _provider(name):
    """A provider named ``module:function``."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _arguments(argv):
    parser = argparse.ArgumentParser(prog="threadloom", description=__doc__)
    flows = parser.add_subparsers(dest="flow", required=True)
    job = flows.add_parser("batch", help="nested posts to enriched comments")
    job.add_argument("--input", required=True)
    job.add_argument("--output", required=True)
    job.add_argument("--work", required=True, help="shared folder for stages and status rows")
    job.add_argument("--job-id", required=True)
    job.add_argument("--multiline", action="store_true", help="the input is one JSON array")
    job.add_argument("--rounds", type=int, default=1, help="kept as stored with --resume")
    job.add_argument("--resume", action="store_true")
    live = flows.add_parser("stream", help="comment events to cleaned rows and replies")
    live.add_argument("--output", required=True)
    live.add_argument("--checkpoint", required=True)
    live.add_argument("--servers", help="brokers of the comment topic")
    live.add_argument("--path", help="folder of JSON lines to read instead of a topic")
    live.add_argument("--every", default="5 seconds", help="trigger, or 'once' to stop when done")
    live.add_argument("--dedupe-within", default="1 hour")
    live.add_argument("--provider-version", default="1", help="part of the reply ids")
    live.add_argument("--max-per-trigger", type=int, default=10_000)
    for flow in (job, live):
        flow.add_argument("--provider", required=True, help="module:function of the reply provider")
        flow.add_argument("--concurrency", type=int, help="calls in flight")
        flow.add_argument("--master")
    return parser.parse_args(argv)


def _run_stream(spark, args):
    if args.path:
        source, topic = {"source": "text", "path": args.path}, None
    else:
        source = streams.topic_options(
            args.servers, streams.COMMENTS_TOPIC, max_per_trigger=args.max_per_trigger
        )
        topic = {"kafka.bootstrap.servers": args.servers, "topic": streams.REPLIES_TOPIC}
    trigger = {"availableNow": True} if args.every == "once" else {"processingTime": args.every}
    comments.start_comment_flow(
        streams.comment_stream(spark, **source),
        args.output,
        args.checkpoint,
        provider=_provider(args.provider),
        provider_version=args.provider_version,
        dedupe_within=args.dedupe_within,
        trigger=trigger,
        topic=topic,
        concurrency=args.concurrency,
    ).awaitTermination()


def main(argv=None):
    args = _arguments(argv)
    spark = get_session("threadloom", args.master)
    if args.flow == "stream":
        _run_stream(spark, args)
    else:
        batch.run_job(
            spark, args.input, args.output, args.work, args.job_id, _provider(args.provider),
            args.multiline, rounds=args.rounds, resume=args.resume, concurrency=args.concurrency,
        )


if __name__ == "__main__":
    main()
