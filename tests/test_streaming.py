import json

import pytest
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.operators import inference
from threadloom.plans import batch, bridge, registry
from threadloom.sources import readers, streams
from threadloom.streaming import comments as live
from threadloom.streaming import commits, tables

NOW = bridge.NOW_MS


def _event(key, text="hello there", **more):
    return {
        "commentId": key, "postId": "p1", "userId": "u", "username": "n", "postText": "post",
        "commentText": text, "timestamp": 1_704_067_200_000, "metadata": {}, **more,
    }


def _deliver(folder, name, *events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events))


def _run(spark, tmp_path, **more):
    events = streams.comment_stream(spark, source="text", path=str(tmp_path / "in"), maxFilesPerTrigger=1)
    checkpoint = str(tmp_path / more.pop("checkpoint", "checkpoint"))
    provider = more.pop("provider", inference.offline_provider)
    query = live.start_comment_flow(events, str(tmp_path / "out"), checkpoint, provider, "v", now_ms=NOW, **more)
    query.awaitTermination()


def _read(spark, tmp_path, name, schema):
    return commits.committed_rows(spark, f"{tmp_path}/out", name, schema)


def test_restart_and_redelivery_give_each_comment_once(spark, tmp_path):
    _deliver(tmp_path / "in", "a", _event("c1"), _event("c2"), "not json", _event("c2"))
    _run(spark, tmp_path)
    _deliver(tmp_path / "in", "b", _event("c2"), _event("c3"), _event("c4", userId=None))
    _deliver(tmp_path / "in", "c", _event("c1"), _event("c2"), _event("c5", "🔥"))
    _run(spark, tmp_path)
    cleaned = _read(spark, tmp_path, "cleaned", schemas.CLEANED_STREAM).collect()
    assert sorted(r.commentId for r in cleaned) == ["c1", "c2", "c3"]
    replies = _read(spark, tmp_path, "replies", schemas.STREAM_REPLY).collect()
    messages = _read(spark, tmp_path, "messages", "key string, value string").collect()
    assert {r.replyId for r in replies} == {m.key for m in messages}
    assert {r.generatedReply for r in replies} == {
        json.loads(m.value)["generatedReply"] for m in messages
    }
    # the third file held nothing new: its batch wrote nothing
    assert len(list((tmp_path / "out" / "cleaned").rglob("batch_id=*"))) == 2


def test_errors_stop_the_stream_and_the_batch_is_repeated(spark, tmp_path):
    _deliver(tmp_path / "in", "a", _event("c1"))

    def body(part, batch_id):
        raise RuntimeError("sink is down")

    def events():
        return streams.comment_stream(spark, source="text", path=str(tmp_path / "in"))

    checkpoint = str(tmp_path / "checkpoint")
    with pytest.raises(Exception, match="sink is down"):
        live.start(events(), checkpoint, body).awaitTermination()
    seen = []
    live.start(events(), checkpoint, lambda part, i: seen.append(part.count())).awaitTermination()
    assert seen == [1]


def test_repeated_batch_overwrites_itself(spark, tmp_path):
    row = [("c1", "p", "u", "n", "post", "text", "", "general", 1, "", 0, 1, 4, 1)]
    part = spark.createDataFrame(row, schemas.CLEANED_STREAM)
    for _ in range(2):
        live.answer_batch(part, 0, str(tmp_path / "out"), inference.offline_provider, "v", NOW)
    for name in ("cleaned", "replies", "messages"):
        assert spark.read.json(f"{tmp_path}/out/{name}/*").count() == 1


def test_no_comment_is_late_whatever_its_time(spark, tmp_path):
    hour = 3_600_000
    _deliver(tmp_path / "in", "a", _event("c1", timestamp=NOW + 1000 * hour), _event("c4", timestamp=None))
    _deliver(tmp_path / "in", "b", _event("c2", timestamp=NOW - hour // 2), _event("c1"))
    _deliver(tmp_path / "in", "c", _event("c3", timestamp=NOW - 5 * hour), _event("c4"))
    for name, stamp in (("a", 1), ("b", 2), ("c", 3)):
        import os

        os.utime(tmp_path / "in" / name, (stamp, stamp))
    _run(spark, tmp_path)
    got = _read(spark, tmp_path, "cleaned", schemas.CLEANED_STREAM).collect()
    assert sorted(r.commentId for r in got) == ["c1", "c2", "c3", "c4"]


def test_stream_equals_batch(spark, data):
    streamed = registry.QUERIES["stream_dedupe"](spark, data)
    static = batch.preprocess_events(bridge.comments(spark, data), NOW)
    columns = static.columns
    assert streamed.count() == static.count()
    assert streamed.select(columns).exceptAll(static).count() == 0


def test_topic_options():
    options = streams.topic_options("host:1", streams.COMMENTS_TOPIC, group="g")
    assert options["maxOffsetsPerTrigger"] == "10000" and options["startingOffsets"] == "earliest"
    assert options["failOnDataLoss"] == "false" and options["kafka.group.id"] == "g"


def test_reply_defaults(spark):
    values = ['{"replyId":"r","commentId":"c"}', '{"commentId":"c"}', '{"commentId":"c"}', "not json", None]
    messages = spark.createDataFrame([(v,) for v in values], "value string")
    got = readers.decode_replies(messages, NOW).collect()
    later = readers.decode_replies(messages, NOW + 5).collect()
    assert [r.replyId for r in got] == [r.replyId for r in later] and len(got) == 3
    bad = readers.undecodable(messages, schemas.REPLY_EVENT).collect()
    assert {r.value for r in bad} == {"not json", None}
    assert got[0].replyId == "r" and got[0].postId == "" and got[0].timestamp == NOW
    assert got[1].replyId == got[2].replyId and len(got[1].replyId) == 64


def test_throughput_windows(spark, tmp_path):
    frame = spark.range(600).select((F.col("id") * 1000).alias("t"))
    path = str(tmp_path / "events")
    frame.write.parquet(path)
    events = spark.readStream.schema(frame.schema).parquet(path)
    log = str(tmp_path / "log")
    for _ in range(2):
        run = live.start_throughput(events, F.col("t"), log, str(tmp_path / "checkpoint"))
        run.awaitTermination()
        frame.limit(0).unionByName(spark.createDataFrame([(5,)], "t long")).write.mode("append").parquet(path)
    counts = {r.minuteMs: r.events for r in live.window_counts(spark, log).collect()}
    assert counts == {m * 60_000: 60 + (m == 0) for m in range(10)}


def test_new_checkpoint_goes_on_in_the_same_folder(spark, tmp_path):
    """Its first batch is no repeat of the old stream's first batch."""
    _deliver(tmp_path / "in", "a", _event("c0"), _event("c1"), _event("c2"))
    _run(spark, tmp_path)
    (tmp_path / "in" / "a").rename(tmp_path / "delivered")
    _deliver(tmp_path / "in", "b", _event("c10"), _event("c11"), _event("c12"))
    _run(spark, tmp_path, checkpoint="another")
    for name, schema in (("cleaned", schemas.CLEANED_STREAM), ("replies", schemas.STREAM_REPLY)):
        got = _read(spark, tmp_path, name, schema).collect()
        assert sorted(r.commentId for r in got) == ["c0", "c1", "c10", "c11", "c12", "c2"]
    assert commits.committed(spark, f"{tmp_path}/out").count() == 2


def test_batch_that_broke_is_read_only_when_repeated_and_asks_once(spark, tmp_path, monkeypatch):
    _deliver(tmp_path / "in", "a", _event("c1"), _event("c2"))
    log = tmp_path / "asked"
    log.write_text("")

    def provider(kind, prompt, ids, max_tokens, log=str(log)):
        with open(log, "a") as out:
            out.write("call\n")
        return "\n".join(f"[{n}] hi" for n in range(1, len(ids) + 1))

    def broken(messages, *more, **options):
        raise RuntimeError("topic is down")

    with monkeypatch.context() as patch:
        patch.setattr(live, "publish", broken)
        with pytest.raises(Exception, match="topic is down"):
            _run(spark, tmp_path, provider=provider)
    assert _read(spark, tmp_path, "replies", schemas.STREAM_REPLY).count() == 0
    assert list((tmp_path / "out" / "replies").rglob("*.json"))  # there, but not committed
    _run(spark, tmp_path, provider=provider)
    assert _read(spark, tmp_path, "replies", schemas.STREAM_REPLY).count() == 2
    assert _read(spark, tmp_path, "messages", "key string, value string").count() == 2
    assert log.read_text() == "call\n"


def test_another_input_under_the_same_number_is_another_batch(spark, tmp_path):
    columns = schemas.CLEANED_STREAM
    rows = [(f"c{i}", "p", "u", "n", "post", "text", "", "general", 1, "", 0, 1, 4, 1) for i in range(2)]
    for row in rows:
        part = spark.createDataFrame([row], columns)
        live.answer_batch(part, 0, str(tmp_path / "out"), inference.offline_provider, "v", NOW)
    got = _read(spark, tmp_path, "replies", schemas.STREAM_REPLY).collect()
    assert sorted(r.commentId for r in got) == ["c0", "c1"]


def test_fingerprint_tells_rows_not_their_order(spark):
    rows = [("a", 1), ("b", 2), ("b", 2), (None, None)]
    mark = lambda r: commits.fingerprint(spark.createDataFrame(r, "k string, v int"), ["k", "v"])
    assert mark(rows) == mark(rows[::-1]) and mark(rows)[0] == 4
    assert len({mark(rows)[1], mark(rows[1:])[1], mark([*rows[:-1], ("c", 3)])[1], mark(rows[:1] * 4)[1], mark([])[1]}) == 5


def test_batches_run_adaptively_whatever_the_stream(spark, tmp_path, monkeypatch):
    """A stateful stream's session has adaptive execution off: what follows the landing leaves it."""
    _deliver(tmp_path / "in", "a", _event("c1"))
    adaptive = []

    def publish(messages, *more, **options):
        adaptive.append(messages.sparkSession.conf.get("spark.sql.adaptive.enabled"))

    with monkeypatch.context() as patch:
        patch.setattr(live, "publish", publish)
        _run(spark, tmp_path)
    messages = streams.message_stream(spark, source="text", path=str(tmp_path / "in"))
    unique = messages.dropDuplicates(["value"])

    def decode(stored):
        publish(stored)
        return stored.select(F.col("value").alias("postId"))

    table = registry.KeyedTable(str(tmp_path / "table"), "postId string", "postId", ["postId"], buckets=2)
    rejects = lambda stored: stored.filter("false")
    tables.start_table_ingest(unique, table, decode, rejects, str(tmp_path / "ingest")).awaitTermination()
    assert adaptive == ["true", "true"]


def test_state_partitions_are_the_flows_own(spark, tmp_path):
    _deliver(tmp_path / "in", "a", _event("c1"), _event("c2"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    _run(spark, tmp_path, state_partitions=3)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before != "3"
    state = [f.name for f in (tmp_path / "checkpoint" / "state" / "0").iterdir() if f.name.isdigit()]
    assert len(state) == 3
    assert _read(spark, tmp_path, "replies", schemas.STREAM_REPLY).count() == 2


def test_a_message_is_parsed_once_whatever_is_filtered(spark, capsys):
    values = ['{"commentId":"c"}', "{}", "not json", "", None, '[{"commentId":"d"},{"commentId":"e"}]']
    messages = spark.createDataFrame([(v,) for v in values], "value string")
    decoded = readers.decode_comment_events(messages)
    decoded.filter("commentId <> '' and postId <> '' and userId <> ''").explain()
    assert capsys.readouterr().out.count("from_json") == 1
    whole = messages.select(F.from_json("value", schemas.COMMENT_EVENT).alias("data")).select("data.*")
    assert decoded.schema == whole.schema and decoded.count() == len(values)
    assert [r.asDict() for r in decoded.collect()] == [r.asDict() for r in whole.collect()]
