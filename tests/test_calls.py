"""Calls in flight, waits by cause, and answers kept by what was asked."""

import json
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from threadloom import fixed_values as fixed
from threadloom.functions import prompts
from threadloom.operators import calls, inference, packing, quality
from threadloom.operators.inference import offline_provider
from threadloom.plans import batch
from threadloom.streaming import commits

NOW = 1_704_672_000_000


class Throttled(Exception):
    def __init__(self, seconds):
        super().__init__("status 429")
        self.retry_after = seconds


def most_open(made):
    moments = sorted((t, change) for call in made for start, end, _ in call.attempts for t, change in ((start, 1), (end, -1)))
    now = most = 0
    for _, change in moments:
        now += change
        most = max(most, now)
    return most


def gaps(call):
    return [b[0] - a[1] for a, b in zip(call.attempts, call.attempts[1:], strict=False)]


def flaky(failures, answer="yes", takes=0.0):
    left = list(failures)

    def ask():
        time.sleep(takes)
        if left:
            raise left.pop(0)
        return answer

    return ask


def test_waits_follow_the_cause():
    asks = [
        flaky([Throttled(0.05)]), flaky([TimeoutError(), TimeoutError()]), flaky([RuntimeError("503")]),
        flaky([inference.Refused("no")]), flaky([]), flaky([RuntimeError("a"), RuntimeError("b"), RuntimeError("c")]),
    ]
    made = calls.run_calls(asks, at_once=2, first_wait=0.02)
    assert [call.answer for call in made] == ["yes", "yes", "yes", None, "yes", None]
    assert [[cause for *_, cause in call.attempts] for call in made] == [
        ["asked", "ok"], ["timeout", "timeout", "ok"], ["error", "ok"], ["refused"], ["ok"], ["error"] * 3,
    ]
    assert gaps(made[0])[0] >= 0.05 and gaps(made[1])[0] >= 0.02 and gaps(made[1])[1] >= 0.04
    assert str(made[5].failure) == "c"
    assert calls.wait_after(Throttled(60), 0, 1.0) == 3.0 and calls.wait_after(Throttled(-1), 0, 1.0) == 0
    assert [calls.wait_after(TimeoutError(), k, 1.0) for k in range(3)] == [1.0, 2.0, 4.0]


@pytest.mark.parametrize("at_once", [1, 3, 8])
def test_no_more_calls_in_flight_than_allowed(at_once):
    asks = [flaky([RuntimeError()] if n % 4 == 0 else [], n, takes=0.004) for n in range(40)]
    made = calls.run_calls(asks, at_once, first_wait=0.01)
    assert [call.answer for call in made] == list(range(40))
    assert 1 <= most_open(made) <= at_once
    if at_once > 1:
        assert most_open(made) > 1


def test_others_run_while_a_call_waits():
    asks = [flaky([Throttled(0.3)]), *[flaky([], n, takes=0.01) for n in range(10)]]
    start = time.monotonic()
    made = calls.run_calls(asks, at_once=1)
    assert time.monotonic() - start < 0.6
    # the others were asked during the wait of the first one
    assert all(call.attempts[0][1] < made[0].attempts[1][0] for call in made[1:])


def test_nothing_to_ask():
    assert calls.run_calls([]) == []


def items(spark):
    return spark.range(60).select(
        F.concat(F.lit("c"), "id").alias("id"),
        F.concat(F.lit("post "), F.col("id") % 30).alias("post_text"),
        F.lit("text").alias("comment_text"),
        F.lit("").alias("image_caption"),
    )


def test_stored_answers_keep_their_attempts(spark, tmp_path):
    packed = packing.build_calls(packing.pack_calls(items(spark)))

    def slow(kind, prompt, ids, most):
        time.sleep(0.01)
        return offline_provider(kind, prompt, ids, most)

    answers = inference.answer_stored(packed, slow, str(tmp_path / "calls"), concurrency=3)
    open_now = quality.open_calls(answers.select(F.inline("attempts")), size=7).collect()
    assert max(r.open for r in open_now) in (2, 3) and open_now and min(r.open for r in open_now) == 0
    assert inference.collect_replies(answers).count() == 60


def test_instructions_ask_for_the_form_that_is_read():
    for kind in fixed.TOKEN_BUDGETS:
        assert "[1]" in prompts.instruction(kind) and "[2]" in prompts.instruction(kind)


POST = "postId string, title string, postText string, imageUrl string, imageCaption string"


def test_equal_requests_ask_once_and_failures_are_tried_again(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("")

    def describe(url, context, log=str(log), broken=True):
        with open(log, "a") as lines:
            lines.write(url + "\n")
        if broken and url == "bad":
            raise RuntimeError("status 500")
        return f"{url}: {context}"

    rows = [(f"p{n}", "t", "b", "hot", None) for n in range(50)]
    rows += [("q1", "t", "b", "bad", ""), ("q2", None, None, "one", ""), ("q3", "t", "b", "hot", "own"), ("q4", "t", "b", None, None)]
    posts = spark.createDataFrame(rows, POST)
    store = inference.answer_store(str(tmp_path / "store"), buckets=4)

    def job(number, provider):
        place = commits.Batch(spark, store.path, f"job-{number}", 0, "c")
        frame = inference.caption_missing(posts, provider, store, place, NOW + number, attempts=1)
        return {r.postId: r.imageCaption for r in frame.collect()}

    first = job(0, describe)
    assert {first[f"p{n}"] for n in range(50)} == {"hot: t - b"} and len(first) == 54
    assert first["q1"] == fixed.CAPTION_FALLBACK and first["q2"] == "one:  - " and first["q3"] == "own" and first["q4"] is None
    assert sorted(log.read_text().split()) == ["bad", "hot", "one"]
    store.merge(spark)
    again = job(1, partial(describe, broken=False))
    assert again == {**first, "q1": "bad: t - b"}
    assert sorted(log.read_text().split()) == ["bad", "bad", "hot", "one"]


def test_captions_enter_the_job_before_preparation(spark, tmp_path):
    comment = {"commentId": "c1", "userId": "u", "username": "n", "commentText": "text here", "timestamp": 5, "upvotes": 1}
    post = {"postId": "p1", "title": "t", "postText": "b", "imageUrl": "url", "comments": [comment]}
    other = {**post, "postId": "p2", "imageUrl": None, "comments": [{**comment, "commentId": "c2"}]}
    source = tmp_path / "posts.json"
    source.write_text("\n".join(map(json.dumps, (post, other))))

    def run(job):
        return batch.run_job(
            spark, str(source), str(tmp_path / "out"), str(tmp_path / "work"), job, offline_provider, now_ms=NOW,
            captions=lambda url, context: f"{url} of {context}",
        ).collect()

    for job in ("j1", "j2"):
        assert {r.commentId: r.imageCaption for r in run(job)} == {"c1": "url of t - b", "c2": ""}
