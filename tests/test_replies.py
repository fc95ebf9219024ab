import functools

import pytest
from pyspark.sql import functions as F

from threadloom import fixed_values as fixed
from threadloom.functions import prompts
from threadloom.functions import replies as parsing
from threadloom.operators import enrich, inference, packing

SHAPES = [
    "[1] foo\nbar\n[2] baz [x] q\n[2] again\n",
    "[3]a[1]   [2] b",
    "no markers at all\n\nsecond line",
    "   \n ",
    "[2] only two\n",
    "lead in [1] x [99] far [0] zero [99999999999999999999] huge",
    "[1]\n[2]  b ",
    "q" * 400,
]


HUGE = "lead in [1] x [99] far [0] zero [99999999999999999999] huge"
SHORT = "q" * 150
# replies one, two and three of each shape; a blank answer differs by kind
EXPECTED = [
    ["foo\nbar", "again", "baz [x] q"],
    ["", "b", "a"],
    ["no markers at all", "second line", "no markers at all\n\nsecond line"],
    None,
    ["only two", "only two", "[2] only two"],
    ["x", HUGE, HUGE],
    ["", "b", "[1]\n[2] \u00a0b"],
    ["q" * 400, SHORT, SHORT],
]
BLANK = {"same_post": [""] * 3, "mixed_post": [fixed.NO_REPLY] * 3}


@pytest.mark.parametrize("kind", ["same_post", "mixed_post"])
def test_parsing_equals_plain_reading(spark, kind):
    rows = [(str(i), kind, ["a", "b", "c"], raw) for i, raw in enumerate(SHAPES)]
    answers = spark.createDataFrame(rows, "callId string, kind string, ids array<string>, raw string")
    got = {}
    for row in inference.parse_answers(answers).collect():
        got.setdefault(int(row.callId), {})[row.pos] = row.reply
    for i, raw in enumerate(SHAPES):
        assert [got[i][p] for p in (1, 2, 3)] == (EXPECTED[i] or BLANK[kind]), raw


def test_numbered_pieces_keep_order_and_blanks(spark):
    frame = spark.createDataFrame([("[3]a[1]   [2] b",)], "raw string")
    pieces = frame.select(parsing.numbered_replies(F.col("raw")).alias("p")).first().p
    assert [tuple(p) for p in pieces] == [(3, "a"), (1, ""), (2, "b")]


def _items(spark):
    return spark.range(40).select(
        F.concat(F.lit("c"), "id").alias("id"),
        F.concat(F.lit("post "), F.floor(F.col("id") / 8).cast("string")).alias("post_text"),
        F.lit("text").alias("comment_text"),
        F.lit("").alias("image_caption"),
    )


def _broken_provider(kind, prompt, ids, max_tokens):
    if "post 0" in prompt:
        raise ConnectionError("down")
    if "post 2" in prompt:
        raise inference.Refused("m" * 100)
    if "post 1" in prompt:
        raise TimeoutError
    return inference.offline_provider(kind, prompt, ids, max_tokens)


def test_every_item_gets_one_reply_even_if_calls_fail(spark):
    replies = inference.generate_replies(_items(spark), _broken_provider, first_wait=0.0).collect()
    assert len(replies) == len({r.id for r in replies}) == 40
    by_status = {}
    for reply in replies:
        by_status.setdefault(reply.status, []).append(reply)
    assert {k: len(v) for k, v in by_status.items()} == {"ok": 16, "error": 16, "timeout": 8}
    assert {r.generated_reply for r in by_status["error"]} == {
        "[Error: Inference failed after 3 retries: down]", f"[Error: {'m' * 80}]",
    }
    assert {r.latency_ms for r in by_status["error"]} == {-1}
    assert {r.generated_reply for r in by_status["timeout"]} == {fixed.TIMED_OUT}
    assert {r.generated_reply for r in by_status["ok"]} <= set(fixed.OFFLINE_REPLIES)


def test_offline_provider_equals_its_column_form(spark):
    items = _items(spark)
    called = {r.id: r.generated_reply for r in inference.generate_replies(items, inference.offline_provider).collect()}
    column = items.select("id", parsing.offline_reply(F.col("id")).alias("reply"))
    assert called == {r.id: r.reply for r in column.collect()}


def test_attach_names_missing_replies(spark):
    items = spark.createDataFrame([("a",), ("b",)], "id string")
    parsed = spark.createDataFrame([("a", "hi")], "id string, reply string")
    got = {r.id: r.reply for r in inference.attach_replies(items, parsed).collect()}
    assert got == {"a": "hi", "b": fixed.REPLY_NOT_FOUND}


def test_failed_replies_are_not_published(spark):
    rows = [("r1", "c1", "p", "hi", 5, "ok"), ("r2", "c2", "p", "[Error: x]", 5, "error")]
    replies = spark.createDataFrame(
        rows, "replyId string, commentId string, postId string, generatedReply string, generatedAt long, status string"
    )
    messages = enrich.encode_reply_messages(replies).collect()
    assert [tuple(m) for m in messages] == [
        ("r1", '{"replyId":"r1","commentId":"c1","postId":"p","generatedReply":"hi","timestamp":5}')
    ]


def test_captions(spark):
    rows = [("1", "u", ""), ("2", "u", "own"), ("3", "", ""), ("4", "bad", None)]
    posts = spark.createDataFrame(rows, "postId string, imageUrl string, imageCaption string").withColumns(
        {"title": F.lit("t"), "postText": F.lit("b")}
    )

    def describe(url, context):
        if url == "bad":
            raise RuntimeError
        return f"{url}: {context}"

    got = {r.postId: r.imageCaption for r in inference.caption_missing(posts, describe, first_wait=0.0).collect()}
    assert got == {"1": "u: t - b", "2": "own", "3": "", "4": fixed.CAPTION_FALLBACK}
    assert inference.caption_missing(posts, describe, first_wait=0.0).columns == posts.columns
    plain = {r.postId: r.imageCaption for r in inference.caption_missing(posts).collect()}
    assert plain["1"] == plain["4"] == fixed.CAPTION_FALLBACK


def test_comment_lists(spark):
    frame = spark.createDataFrame([(["a", "b"],), ([],)], "c array<string>")
    got = [r[0] for r in frame.select(prompts.join_comments(F.col("c"))).collect()]
    assert got == ["a | b", "General comment"]


def test_calls_in_flight_are_bounded(spark):
    calls = packing.build_calls(packing.pack_calls(_items(spark)))
    answers = inference.answer_calls(inference.ask(calls), inference.offline_provider, tasks=2)
    assert answers.rdd.getNumPartitions() == 2


def test_resume_keeps_the_rounds_that_were_stored(spark, tmp_path):
    items = _items(spark)
    first = inference.generate_replies(items, inference.offline_provider, path=str(tmp_path), rounds=4).collect()
    seen = []
    again = inference.generate_replies(items, inference.offline_provider, path=str(tmp_path), rounds=1, resume=True, report=seen.append)
    assert sorted(again.collect()) == sorted(first) and len(first) == 40
    assert len(seen) == 4 and seen[-1] == 40


def test_item_json(spark):
    bodies = spark.createDataFrame(
        [('{"id":"a","generated_reply":"x"}',), ('{"id":"b","generated_reply":"y","latency_ms":7}',)], "body string"
    )
    got = sorted(tuple(r) for r in inference.decode_item_replies(bodies).collect())
    assert got == [("a", "x", 0), ("b", "y", 7)]


def test_finished_rounds_are_kept_after_a_breakdown(spark, tmp_path):
    calls = packing.build_calls(packing.pack_calls(_items(spark)))
    log, out = tmp_path / "log", str(tmp_path / "calls")

    def provider(kind, prompt, ids, max_tokens, log=str(log), broken=True):
        if broken and "post 3" in prompt:
            raise SystemExit("the worker dies")
        with open(log, "a") as lines:
            lines.write(ids[0] + "\n")
        return "\n".join(f"[{n}] hi" for n in range(1, len(ids) + 1))

    with pytest.raises(Exception, match="SystemExit|worker"):
        inference.answer_stored(calls, provider, out, rounds=5)
    before = log.read_text().split() if log.exists() else []
    working = functools.partial(provider, broken=False)
    answers = inference.answer_stored(calls, working, out, rounds=5, resume=True)
    assert inference.collect_replies(answers).filter("generated_reply = 'hi'").count() == 40
    asked = log.read_text().split()
    finished = [n for n in range(5) if (tmp_path / "calls" / "answers" / f"round={n}" / "_SUCCESS").exists()]
    assert finished == [0, 1, 2, 3, 4]
    assert len(set(asked)) == 5 and len(asked) <= 5 + len(before)
