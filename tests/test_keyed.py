"""Key-unique tables fed from topics: stored rows, merges, look-ups, rejects."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.sources import readers, streams
from threadloom.streaming import commits, tables
from threadloom.streaming.keyed import KeyedTable

NOW = 1_704_672_000_000
ROW = "k string, v string, n long"


def reply(key, text, at=1):
    return json.dumps({"replyId": key, "commentId": "c", "postId": "p", "generatedReply": text, "timestamp": at})


def deliver(folder, name, *messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(messages))


def decode(messages):
    return readers.decode_replies(messages, NOW)


def ingest(spark, tmp_path, table, checkpoint="checkpoint", merge_every=None):
    messages = streams.message_stream(spark, source="text", path=str(tmp_path / "in"), maxFilesPerTrigger=1)
    tables.start_table_ingest(
        messages, table, decode, readers.rejected_replies, str(tmp_path / checkpoint), None, merge_every
    ).awaitTermination()


@pytest.fixture
def table(tmp_path):
    return KeyedTable(str(tmp_path / "table"), schemas.REPLY_EVENT, "replyId", ["timestamp"], buckets=4)


def texts(frame):
    return sorted((r.replyId, r.generatedReply) for r in frame.collect())


def test_the_row_stored_first_stays_through_merges_and_restarts(spark, tmp_path, table):
    deliver(tmp_path / "in", "a", reply("r1", "second", 9), reply("r1", "first", 5), reply("r1", "first", 5))
    ingest(spark, tmp_path, table)
    assert texts(table.rows(spark)) == [("r1", "first")]
    assert table.merge(spark) and table.merge(spark) == []
    deliver(tmp_path / "in", "b", reply("r1", "earlier but stored later", 1), reply("r2", "other", 3))
    ingest(spark, tmp_path, table)
    expected = [("r1", "first"), ("r2", "other")]
    assert texts(table.rows(spark)) == expected  # base and tail
    table.merge(spark)
    table.drop_folded(spark)
    assert texts(table.rows(spark)) == expected  # base alone
    # another stream counts its batches from 0 again, and finds nothing new
    ingest(spark, tmp_path, table, checkpoint="another", merge_every=1)
    assert texts(table.rows(spark)) == expected
    assert not list((tmp_path / "table" / "tail").rglob("*.parquet"))
    assert commits.committed(spark, table.path).count() == 4


def fill(spark, table, number, rows, query="q", newest=0):
    batch = commits.Batch(spark, table.path, query, number, f"m{number}")
    table.append(spark.createDataFrame(rows, ROW), batch, now_ms=NOW + newest)
    batch.commit(len(rows), 0, len(rows))


def test_newest_row_wins_where_asked(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ROW, "k", ["n"], buckets=4, newest=True)
    fill(spark, table, 0, [("a", "old", 1), ("b", "only", 1), (None, "no key", 1)])
    fill(spark, table, 1, [("a", "new", 1)])  # the same moment, a later batch
    table.merge(spark)
    fill(spark, table, 2, [("c", "late", 2), ("c", "first in order", 1)], newest=5)
    expected = [("a", "new"), ("b", "only"), ("c", "first in order")]
    assert sorted((r.k, r.v) for r in table.rows(spark).collect()) == expected
    table.merge(spark)
    assert sorted((r.k, r.v) for r in table.rows(spark).collect()) == expected


def test_a_batch_without_a_record_is_not_there(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ROW, "k", ["n"], buckets=4)
    assert table.rows(spark).collect() == [] and table.merge(spark) == []
    broken = commits.Batch(spark, table.path, "q", 0, "m")
    table.append(spark.createDataFrame([("a", "x", 1)], ROW), broken)
    assert table.rows(spark).collect() == [] and table.merge(spark) == []
    broken.commit(1, 0, 1)
    assert table.rows(spark).count() == 1


def test_look_ups_and_merges_touch_what_their_keys_need(spark, tmp_path):
    """Files read follow the keys asked for, files written the buckets of the tail."""
    table = KeyedTable(str(tmp_path / "t"), ROW, "k", ["n"], buckets=32)
    fill(spark, table, 0, [(f"k{i}", "v", i) for i in range(2000)])
    table.merge(spark)
    before = {str(p) for p in (tmp_path / "t" / "base").rglob("*.parquet")}
    assert len(before) == 32
    keys = spark.createDataFrame([("k1",), ("k7",), ("none",), (None,)], "k string")
    found = table.lookup(spark, keys)
    assert sorted(r.k for r in found.collect()) == ["k1", "k7"]
    assert len(found.inputFiles()) <= 3
    fill(spark, table, 1, [("k1", "again", 0), ("new", "v", 1)])
    assert len(table.lookup(spark, keys).inputFiles()) <= 3 + 2
    touched = table.merge(spark)
    written = {str(p) for p in (tmp_path / "t" / "base").rglob("*.parquet")} - before
    assert 1 <= len(touched) <= 2 and len(written) == len(touched)
    assert table.rows(spark).count() == 2001
    assert table.lookup(spark, keys).filter("v = 'again'").count() == 0


def test_good_and_rejected_make_all_messages(spark, tmp_path, table):
    deliver(tmp_path / "in", "a", reply("r1", "x"), "not json", reply("r2", "y"), reply("r1", "x"), "[1]")
    deliver(tmp_path / "in", "b", "not json", '{"other": 1}')
    ingest(spark, tmp_path, table, merge_every=1)
    records = commits.committed(spark, table.path).collect()
    assert len(records) == 2
    assert all(r.messages == r.rejected + r.stored for r in records)
    assert sorted(r.value for r in table.rejected(spark).collect()) == ["[1]", "not json", "not json", '{"other": 1}']
    assert table.rows(spark).count() == 2


def test_posts_without_a_key_are_rejected(spark):
    values = ['{"postId":"p","title":"t"}', '{"title":"no key"}', "x", None, '{"postId":null}']
    messages = spark.createDataFrame([(v,) for v in values], "value string")
    good = readers.decode_post_events(messages).count()
    apart = [r.value for r in readers.rejected_posts(messages).collect()]
    assert good == 1 and apart == values[1:]
    replies = spark.createDataFrame([(v,) for v in [reply("r", "x"), "x", None]], "value string")
    assert readers.rejected_replies(replies).count() + decode(replies).count() == 3


def test_hot_bucket_rows_are_thinned_before_they_meet(spark, tmp_path):
    """Copies of one key leave each map task once."""
    table = KeyedTable(str(tmp_path / "t"), ROW, "k", ["n"], buckets=4)
    rows = spark.range(20_000, numPartitions=8).select(
        F.lit("hot").alias("k"), F.lit("v").alias("v"), F.col("id").alias("n")
    )
    batch = commits.Batch(spark, table.path, "q", 0, "m")
    table.append(rows, batch, now_ms=NOW)
    batch.commit(20_000, 0, 1)
    assert [tuple(r) for r in table.rows(spark).collect()] == [("hot", "v", 0)]
