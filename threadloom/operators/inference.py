"""Reply generation: the provider hook, retries, parsing and re-attachment.

A provider is a callable ``(kind, prompt, ids, max_tokens) -> str`` that returns the raw
answer of one call; ``prompts.instruction(kind)`` is what it tells its model beforehand. It is the only Python that runs per call; everything around it is
DataFrame work. Every failure is tried again but those with a true attribute ``final``, such as
``Refused``, by which a provider says that asking again is of no use, and wait as long as a
``retry_after`` (seconds) on the exception says. What the last attempt failed of is kept in
``error``, all attempts with their times in ``attempts``.
"""

import hashlib
from functools import partial

import pandas as pd
from pyspark.sql import functions as F

from threadloom import fixed_values as fixed
from threadloom.functions import replies as parsing
from threadloom.functions.identity import POINT_BITS, hash_bucket
from threadloom.operators import packing
from threadloom.operators.calls import run_calls
from threadloom.operators.skew import first_per_key
from threadloom.schemas import ITEM_REPLY
from threadloom.session import is_written
from threadloom.streaming.keyed import KeyedTable

ANSWER = "request string, answer string, calls int"
ASKED = "callId string, kind string, ids array<string>, prompt string, maxTokens int"
# Calls one task makes: what a lost executor can cost, and what spreads a job over a cluster.
CALLS_PER_TASK = 200
RAW_ANSWER = (
    "callId string, kind string, ids array<string>, raw string, latencyMs bigint, "
    "status string, error string, "
    "attempts array<struct<startMs: double, endMs: double, cause: string>>"
)


def offline_provider(kind, prompt, ids, max_tokens):
    """Answers without a model: one fixed reply per comment, picked by its hash."""
    lines = []
    for place, comment_id in enumerate(ids, 1):
        point = int(hashlib.md5(comment_id.encode()).hexdigest()[: POINT_BITS // 4], 16)
        lines.append(f"[{place}] {fixed.OFFLINE_REPLIES[point % len(fixed.OFFLINE_REPLIES)]}")
    return "\n".join(lines)


class Refused(Exception):
    """Raised by a provider for a call that would fail again."""

    final = True


def ask(calls):
    """What a provider is given of each call. The ids travel along, so no join brings them back."""
    return calls.select("callId", "kind", F.col("items.id").alias("ids"), "prompt", "maxTokens")


def outcome(call, attempts):
    """(raw, latencyMs, status, error, attempts) of a call that is over; waits are in the latency."""
    failure, log = call.failure, call.attempts
    status, error = "ok", None
    if failure is not None:
        status = "timeout" if isinstance(failure, TimeoutError) else "error"
        tried = "" if getattr(failure, "final", False) else f"Inference failed after {attempts} retries: "
        error = f"{tried}{failure}"
    latency = int((log[-1][1] - log[0][0]) * 1000)
    raw = None if failure is not None else call.answer or ""
    return raw, latency, status, error, [(1000 * start, 1000 * end, cause) for start, end, cause in log]


def answer_calls(asked, provider, tasks=None, attempts=3, first_wait=1.0, at_once=1):
    """One provider call per row of ``asked``; failures become rows with a status.

    ``tasks`` spreads the calls over that many tasks; without it adaptive execution sizes them
    by bytes. A task has at most ``at_once`` calls in flight; a provider must allow threads if
    that is more than one. Waits follow the cause of a failure, see ``calls.wait_after``, and
    other calls run meanwhile. Using the result twice makes the calls twice.
    """

    def run(batches):
        for batch in batches:
            asks = [
                partial(provider, kind, prompt, list(ids), int(most))
                for kind, prompt, ids, most in zip(batch.kind, batch.prompt, batch.ids, batch.maxTokens)
            ]
            answers = [outcome(call, attempts) for call in run_calls(asks, at_once, attempts, first_wait)]
            results = pd.DataFrame(answers, columns=["raw", "latencyMs", "status", "error", "attempts"])
            yield pd.concat([batch[["callId", "kind", "ids"]], results], axis=1)

    spread = asked.repartition(tasks, "callId") if tasks else asked.repartition("callId")
    return spread.mapInPandas(run, RAW_ANSWER)


def answer_stored(
    calls, provider, path, rounds=1, resume=False, concurrency=None, report=None, **limits
):
    """Answer the calls round by round, writing each round under ``path``; read them back.

    A round has a task for each CALLS_PER_TASK of its calls. ``concurrency`` bounds the calls in
    flight: there are at most so many tasks, and they share what is more. What a broken job can cost is one round. With
    ``resume`` an earlier run over the same input is gone on with: its calls, its number of
    rounds and the rounds it finished are kept. ``report(items)`` is told the number of items
    answered so far after each round.
    """
    spark = calls.sparkSession
    calls_path = f"{path}/calls"
    if not (resume and is_written(spark, calls_path)):
        dealt = ask(calls).withColumns(
            {
                "rounds": F.lit(rounds),
                "round": hash_bucket(F.col("callId"), rounds).cast("int"),
            }
        )
        dealt.write.mode("overwrite").partitionBy("round").parquet(calls_path)
    asked = spark.read.schema(f"{ASKED}, rounds int, round int").parquet(calls_path)
    sizes = {r["round"]: r for r in asked.groupBy("round").agg(
        F.count("*").alias("calls"), F.sum(F.size("ids")).alias("items"), F.max("rounds").alias("rounds")
    ).collect()}  # a row for each round
    stored = max((r["rounds"] for r in sizes.values()), default=rounds)
    folders, done = [], 0
    for number in range(stored):
        folder = f"{path}/answers/round={number}"
        size = sizes.get(number)
        if not (resume and is_written(spark, folder)):
            tasks = max(1, -(-(size["calls"] if size else 0) // CALLS_PER_TASK))
            tasks = min(tasks, concurrency) if concurrency else tasks
            shared = {"at_once": max(1, concurrency // tasks)} if concurrency else {}
            part = asked.filter(F.col("round") == number).drop("round", "rounds")
            answer_calls(part, provider, tasks, **{**shared, **limits}).write.mode("overwrite").parquet(folder)
        folders.append(folder)
        done += size["items"] if size else 0
        if report:
            report(done)
    return spark.read.schema(RAW_ANSWER).parquet(*folders)


def parse_answers(answers, *carried):
    """Reply of every item of every call that has a raw answer: (callId, pos, id, reply)."""
    read = answers.filter(F.col("raw").isNotNull()).withColumns(
        {
            "found": parsing.numbered_replies(F.col("raw")),
            "lines": parsing.answer_lines(F.col("raw")),
        }
    )
    replies = F.transform(
        "ids",
        lambda item, place: F.struct(
            (place + 1).alias("pos"),
            item.alias("id"),
            parsing.reply_at(
                F.col("raw"), F.col("found"), F.col("lines"), place + 1, F.col("kind")
            ).alias("reply"),
        ),
    )
    return read.select("callId", *carried, F.explode(replies).alias("at")).select(
        "callId", *carried, "at.*"
    )


def attach_replies(items, parsed):
    """Every item with the reply of its id, or the fixed text where there is none."""
    return items.join(parsed.select("id", "reply"), "id", "left").withColumn(
        "reply", F.coalesce("reply", F.lit(fixed.REPLY_NOT_FOUND))
    )


def error_replies(answers):
    """One row per item of every failed call, with the text shown in place of a reply."""
    timed_out = F.col("status") == "timeout"
    return answers.filter("status <> 'ok'").select(
        F.explode("ids").alias("id"),
        F.when(timed_out, fixed.TIMED_OUT)
        .otherwise(parsing.error_text(F.col("error")))
        .alias("generated_reply"),
        F.when(timed_out, F.col("latencyMs")).otherwise(F.lit(-1)).cast("bigint").alias(
            "latency_ms"
        ),
        "status",
    )


def collect_replies(answers):
    """Replies of all calls, answered or failed: (id, generated_reply, latency_ms, status).

    The latency of a call is shared by its items with integer division.
    """
    share = F.floor(F.col("latencyMs") / F.greatest(F.size("ids"), F.lit(1)))
    answered = answers.filter("status = 'ok'").withColumn("latency_ms", share)
    read = parse_answers(answered, "latency_ms").select(
        "id", F.col("reply").alias("generated_reply"), "latency_ms", F.lit("ok").alias("status")
    )
    return read.unionByName(error_replies(answers))


def generate_replies(items, provider, path=None, floor=None, **limits):
    """Pack, prompt, call, parse and re-attach: one reply row per item.

    With ``path`` the calls and their answers are stored there, and ``rounds`` and ``resume``
    of ``answer_stored`` apply; without it the caller must use the result only once.
    """
    calls = packing.build_calls(packing.pack_calls(items, **({"floor": floor} if floor else {})))
    if path:
        return collect_replies(answer_stored(calls, provider, path, **limits))
    return collect_replies(answer_calls(ask(calls), provider, **limits))


def caption_requests(posts):
    """``posts`` with ``request``: hash of image and context where a caption is to be made."""
    present = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    needs = present("imageUrl") & ~present("imageCaption")
    named = F.sha2(F.to_json(F.struct(F.lit("caption"), "imageUrl", caption_context())), 256)
    return posts.withColumn("request", F.when(needs, named))


def caption_context():
    filled = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "postText")]
    return F.concat(filled[0], F.lit(" - "), filled[1]).alias("context")


def answer_captions(requests, provider, attempts=3, first_wait=1.0, at_once=1, tasks=None):
    """(request, answer, calls) of each row (request, imageUrl, context); failed ones have a null
    answer. ``calls`` counts the attempts."""

    def run(batches):
        for batch in batches:
            asks = [partial(provider, *pair) for pair in zip(batch.imageUrl, batch.context)]
            made = run_calls(asks, at_once, attempts, first_wait)
            answers = [None if call.failure is not None else call.answer for call in made]
            tries = [len(call.attempts) for call in made]
            yield pd.DataFrame({"request": batch.request, "answer": answers, "calls": tries})

    spread = requests.repartition(tasks, "request") if tasks else requests.repartition("request")
    return spread.mapInPandas(run, ANSWER)


def caption_missing(posts, provider=None, store=None, batch=None, now_ms=None, **limits):
    """Caption posts that have an image and no caption; other posts pass unchanged.

    ``provider`` is ``(image_url, context) -> str``; posts with the same image and context ask
    it once. It is tried as often as a reply's, then the fixed fallback text is taken. With
    ``store`` (a KeyedTable of ANSWER, see ``answer_store``) and ``batch`` (its
    ``commits.Batch``) answers known from earlier jobs are looked up, and new ones are kept;
    failures are not, so a later job tries them again. Without a store the result must be used
    only once, as each use asks anew.
    """
    named = caption_requests(posts)
    if provider is None:
        caption = F.when(F.col("request").isNotNull(), fixed.CAPTION_FALLBACK).otherwise(F.col("imageCaption"))
        return named.withColumn("imageCaption", caption).select(*posts.columns)
    open_ones = named.filter("request is not null").select("request", "imageUrl", caption_context())
    asked = first_per_key(open_ones, ["request"], ["imageUrl"])
    if store is None:
        answers = answer_captions(asked, provider, **limits).select("request", "answer")
    else:
        answers = _stored_answers(asked, provider, store, batch, now_ms, limits)
    # posts without a request stay out of the join: as nulls they would meet in one task
    captioned = named.filter("request is not null").join(answers, "request", "left")
    captioned = captioned.withColumn("imageCaption", F.coalesce("answer", F.lit(fixed.CAPTION_FALLBACK)))
    others = named.filter("request is null")
    return others.select(*posts.columns).unionByName(captioned.select(*posts.columns))


def answer_store(path, buckets=64):
    """Answers by the hash of what was asked, kept over jobs."""
    return KeyedTable(path, ANSWER, "request", ["answer"], buckets)


def _stored_answers(asked, provider, store, batch, now_ms, limits):
    """Answers out of the store; what it lacks is asked for and stored, once for each batch."""
    spark = asked.sparkSession
    if not batch.is_committed():
        known = store.lookup(spark, asked).select("request")
        fresh = answer_captions(asked.join(known, "request", "left_anti"), provider, **limits)
        store.append(fresh.filter("answer is not null"), batch, now_ms)
        batch.commit(0, 0, 0)
    return store.lookup(spark, asked).select("request", "answer")


def encode_items(items):
    """Request body of an item as JSON; absent texts are left out."""
    return items.select(
        "id",
        F.to_json(F.struct("id", "post_text", "comment_text", "image_caption")).alias("body"),
    )


def decode_item_replies(bodies, body="body"):
    """Replies out of JSON bodies; a missing latency counts as 0."""
    parsed = bodies.select(
        F.from_json(body, ITEM_REPLY).alias("r")
    )
    return parsed.select(
        F.col("r.id"),
        F.col("r.generated_reply"),
        F.coalesce("r.latency_ms", F.lit(0)).alias("latency_ms"),
    )
