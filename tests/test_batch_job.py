import json

import pytest
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.operators import comments as prep
from threadloom.operators import enrich, state
from threadloom.operators.inference import offline_provider
from threadloom.plans import batch
from threadloom.sinks import writers
from threadloom.sources import readers
from threadloom.streaming import commits

NOW = 1_704_672_000_000


def _comment(key, text, **more):
    base = {
        "commentId": key, "userId": "u1", "username": " Ann! ", "commentText": text,
        "timestamp": 5, "upvotes": 1, "parentCommentId": None,
    }
    return {**base, **more}


POSTS = [
    {
        "postId": "p1", "userId": "u", "username": "poster", "title": "T 🔥", "postText": "Hello https://a.b",
        "subreddit": " Data§Science ", "imageUrl": "u", "imageCaption": None, "timestamp": 1, "upvotes": 2,
        "comments": [
            _comment("c1", "first  one 🔥"),
            _comment("c1", "first  one 🔥"),
            _comment("c2", "later copy", timestamp=9),
            _comment("c2", "early copy", timestamp=3),
            _comment("c3", "   "),
            _comment("c4", None),
            _comment("c5", "no user", userId=None, username=None, timestamp=None, upvotes=None),
            _comment(None, "no id"),
            None,
        ],
    },
    {"postId": "p2", "postText": "no comments", "comments": []},
    {"postId": "p3", "postText": "comments missing"},
    {"postId": "p4", "postText": None, "comments": [_comment("c6", "on a post without text")]},
    {"postId": "p5", "postText": "§§", "comments": [_comment("c7", "on a post that cleans to nothing")]},
]


def _write(tmp_path, multiline):
    path = tmp_path / "upload.json"
    text = json.dumps(POSTS, indent=1) if multiline else "\n".join(map(json.dumps, POSTS))
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("multiline", [True, False])
def test_job_end_to_end(spark, tmp_path, multiline):
    source, out, work = _write(tmp_path, multiline), str(tmp_path / "out"), str(tmp_path / "work")
    rows = batch.run_job(spark, source, out, work, "j1", offline_provider, multiline=multiline, now_ms=NOW).collect()
    got = {r.commentId: r for r in rows}
    assert set(got) == {"c1", "c2", "c5"} and len(rows) == 3
    assert got["c2"].commentText == "early copy"
    assert got["c1"].commentText == "first one" and got["c1"].postText == "Hello [URL]"
    assert got["c1"].username == "Ann!" and got["c1"].subreddit == "datascience"
    assert got["c1"].imageCaption == "[Image without caption]" and got["c1"].postTitle == "T"
    assert got["c5"].username == "anonymous" and got["c5"].timestamp == NOW and got["c5"].userId is None
    assert all(r.generatedReply and r.processedAt == NOW for r in rows)
    events = spark.read.schema(schemas.JOB_STATUS).parquet(f"{work}/status")
    assert {e.status for e in events.collect()} == {"processing", "inferring", "completed"}
    done = events.filter("status = 'completed'").first()
    assert (done.totalRecords, done.processedRecords) == (3, 3)


def test_failed_job_leaves_a_record_and_raises(spark, tmp_path):
    work = str(tmp_path / "work")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        batch.run_job(spark, str(tmp_path / "none.json"), str(tmp_path / "out"), work, "j2", offline_provider)
    failed = spark.read.parquet(f"{work}/status").filter("status = 'failed'").first()
    assert (failed.totalRecords, failed.processedRecords) == (0, 0)
    assert "PATH_NOT_FOUND" in failed.error


def test_job_can_be_repeated(spark, tmp_path):
    source, out, work = _write(tmp_path, False), str(tmp_path / "out"), str(tmp_path / "work")
    first = batch.run_job(spark, source, out, work, "j1", offline_provider, now_ms=NOW).drop("inferenceLatencyMs").collect()
    again = batch.run_job(spark, source, out, work, "j1", offline_provider, now_ms=NOW).drop("inferenceLatencyMs").collect()
    assert sorted(first, key=str) == sorted(again, key=str)


def test_provider_is_called_once_per_call(spark, tmp_path):
    source, log = _write(tmp_path, False), tmp_path / "calls.log"

    def provider(kind, prompt, ids, max_tokens, log=str(log)):
        with open(log, "a") as out:
            out.write(",".join(ids) + "\n")
        return "\n".join(f"[{n}] hi" for n in range(1, len(ids) + 1))

    batch.run_job(
        spark, source, str(tmp_path / "out"), str(tmp_path / "work"), "j3", provider=provider
    ).collect()
    assert len(log.read_text().splitlines()) == 1


def test_decoding_of_broken_messages(spark):
    values = [
        "not json", None, '[{"commentId":"z"}]', '{"commentId":"b","timestamp":"x"}',
        '{"commentId":"c","upvotes":3000000000}', '{"commentId":7,"timestamp":1.5}',
    ]
    frame = spark.createDataFrame([(v,) for v in values], "value string").withColumn(
        "value", F.col("value").cast("binary")
    )
    got = readers.decode_comment_events(frame).select("commentId", "timestamp", "upvotes").collect()
    assert [tuple(r) for r in got] == [
        (None, None, None), (None, None, None), (None, None, None), ("b", None, None),
        ("c", None, None), ("7", None, None),
    ]


def test_tolerant_read_of_results(spark, tmp_path):
    folder = tmp_path / "results"
    folder.mkdir()
    (folder / "part-0.json").write_text('{"commentId":"a"}\n\nnot json\n{"commentId":\n{"commentId":"b"}\n')
    (folder / "part-1.txt").write_text('{"commentId":"c"}\n')
    got = readers.read_results(spark, str(folder)).collect()
    assert sorted(r.commentId for r in got) == ["a", "b"]
    assert all(r.generatedReply is None for r in got)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(
        [("c", "p", "text", "post", "u", "x")],
        "commentId string, postId string, commentText string, postText string, userId string, other string",
    ).write.parquet(path)
    frame = prep.validate(spark.read.parquet(path), ("commentText", "postText")).select("commentId")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(commentText)" in plan and "Not(EqualTo(postText,))" in plan
    assert "other" not in plan


def test_no_python_or_repeated_regex_in_the_preparation(spark, tmp_path):
    source = _write(tmp_path, False)
    plan = batch.preprocess_batch(readers.read_nested_posts(spark, source), NOW)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text
    assert not any("Filter" in line and "regexp_replace" in line for line in text.splitlines())


def test_enrichment_both_ways(spark):
    columns = schemas.CLEANED_BATCH
    cleaned = spark.createDataFrame([(k,) + (None,) * 13 for k in "abc"], columns)
    replies = spark.createDataFrame(
        [("a", "x", 1, 2)], "commentId string, generatedReply string, inferenceLatencyMs long, processedAt long"
    )
    for unique in (True, False):
        got = enrich.enrich_with_replies(cleaned, replies, unique).collect()
        assert sorted((r.commentId, r.generatedReply) for r in got) == [("a", "x"), ("b", None), ("c", None)]


def test_insert_or_ignore_keeps_first_and_stored(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "replyId string, generatedReply string, timestamp long"
    spark.createDataFrame([("a", "old", 1)], schema).write.parquet(path)
    incoming = spark.createDataFrame([("a", "new", 0), ("b", "late", 9), ("b", "early", 2)], schema)
    for _ in range(2):
        writers.append_new_rows(spark, incoming, path, "replyId", ["timestamp"])
        got = sorted(tuple(r) for r in spark.read.parquet(path).collect())
        assert got == [("a", "old", 1), ("b", "early", 2)]


def test_changed_rows_treat_nulls_as_values(spark):
    schema = "k string, status string, n long"
    old = spark.createDataFrame([("a", "x", 1), ("b", "x", None), ("c", None, None)], schema)
    new = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", None, None)], schema)
    assert [r.k for r in state.changed_rows(new, old, "k", ["status", "n"]).collect()] == ["b"]


def test_command_line(spark, tmp_path):
    from threadloom import __main__ as command

    source = _write(tmp_path, False)
    command.main(
        ["batch", "--provider", "threadloom.operators.inference:offline_provider", "--input", source, "--output", f"{tmp_path}/out", "--work", f"{tmp_path}/work",
         "--job-id", "j", "--rounds", "2", "--provider", "threadloom.operators.inference:offline_provider"]
    )
    assert readers.read_results(spark, f"{tmp_path}/out").count() == 3
    events = tmp_path / "events"
    events.mkdir()
    event = {"commentId": "c1", "postId": "p", "userId": "u", "postText": "post", "commentText": "text"}
    (events / "a").write_text(json.dumps(event))
    command.main(
        ["stream", "--provider", "threadloom.operators.inference:offline_provider", "--path", str(events), "--output", f"{tmp_path}/live", "--checkpoint",
         f"{tmp_path}/checkpoint", "--every", "once", "--provider",
         "threadloom.operators.inference:offline_provider"]
    )
    assert commits.committed_rows(spark, f"{tmp_path}/live", "replies", schemas.STREAM_REPLY).count() == 1
