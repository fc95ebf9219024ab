"""JSON arrays in many tasks, slices of time, kept counts, late copies."""

import json
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.operators import inference, recent
from threadloom.plans import bridge
from threadloom.sources import json_array, readers, streams
from threadloom.streaming import comments as live
from threadloom.streaming import commits
from threadloom.streaming.keyed import CountedTable

NOW = bridge.NOW_MS
TRICKY = ['plain', 'a } brace {', 'quote \" and } more', 'back \\ slash', 'ends in slash \\', '\\" } {', '[ ] , ', '', 'é😀}', 'line\nbreak } "x"']


@contextmanager
def settings(spark, **values):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def documents(count):
    rng = random.Random(count)
    return [
        {"id": i, "text": rng.choice(TRICKY) + rng.choice(TRICKY), "in": [{"k": rng.choice(TRICKY)}] * rng.randint(0, 3), "o": {}}
        for i in range(count)
    ]


def read_ids(spark, path, size=50):
    rows = json_array.read_array(spark, path, "id long, text string, in array<struct<k:string>>", size).collect()
    return sorted((r.id, r.text, [x.k for x in r["in"]]) for r in rows)


def expected(rows):
    return sorted((r["id"], r["text"], [x["k"] for x in r["in"]]) for r in rows)


@pytest.mark.parametrize("indent", [None, 2])
def test_array_in_one_file_is_read_in_many_blocks(spark, tmp_path, indent):
    rows = documents(400)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "posts.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=indent is None), "utf-8")
    with settings(spark, **{"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "100"}):
        blocks = spark.read.option("lineSep", "}").text(str(tmp_path / "a")).rdd.getNumPartitions()
        assert blocks > 10
        assert read_ids(spark, str(tmp_path / "a")) == expected(rows)


def test_odd_arrays(spark, tmp_path):
    rows = documents(30)
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / "1").write_text("[]")
    (folder / "2").write_text("")
    (folder / "3").write_text(json.dumps(rows[:10]) + "\n" + json.dumps(rows[10:20]))
    (folder / "4").write_text("  [ 1, null, \"text } {\", " + json.dumps(rows[20]) + " , [] ] ")
    (folder / "5").write_text("\n".join(map(json.dumps, rows[21:])))  # JSON Lines are read too
    assert read_ids(spark, str(folder), 7) == expected(rows)


def test_nested_posts_equal_the_reader_of_whole_files(spark, data, tmp_path):
    posts = bridge.nested_posts(spark, data).toJSON().collect()
    (tmp_path / "posts.json").write_text("[" + ",\n".join(posts) + "]")
    whole = readers.read_nested_posts(spark, str(tmp_path / "posts.json"), multiline=True)
    cut = json_array.read_array(spark, str(tmp_path / "posts.json"), schemas.NESTED_POST)
    assert cut.count() == len(posts) and cut.exceptAll(whole).count() == 0


def test_only_the_newest_slices_are_opened(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{i}", rng.choice([None, *range(300)])) for i in range(5000)]
    frame = spark.createDataFrame(rows, "key string, at long").repartition(6)
    path = str(tmp_path / "t")
    recent.write_by_time(frame, path, "at", size=250)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for k in (1, 100, 700, 6000):
        found = recent.newest(spark, path, frame.schema, "at", "key", k)
        assert [tuple(r) for r in found.collect()] == order[:k]
        slices = recent.slices_of(spark, path, k)
        assert slices == list(range(len(slices)))
        if k <= 100:
            assert len(slices) <= 2 and len({f.split("slice=")[1][:3] for f in found.inputFiles()}) <= 2
    empty = frame.limit(0)
    recent.write_by_time(empty, str(tmp_path / "e"), "at")
    assert recent.newest(spark, str(tmp_path / "e"), frame.schema, "at", "key", 5).collect() == []


def test_counts_stay_exact_through_copies_repeats_and_merges(spark, tmp_path):
    table = CountedTable(str(tmp_path / "t"), "k string, g string, n long", "k", ["n"], "g", buckets=4)
    rng = random.Random(2)
    known = {}

    def check():
        counts = {r.g: r.rows for r in table.counts(spark).collect()}
        want = {}
        for group in known.values():
            want[group] = want.get(group, 0) + 1
        assert counts == want

    check()
    for number in range(6):
        rows = [(f"k{rng.randrange(60)}", None, 1) for _ in range(40)]
        rows = [(k, known.get(k, "hot" if int(k[1:]) % 3 else None), n) for k, _, n in rows]
        for k, g, _ in rows:
            known.setdefault(k, g)
        frame = spark.createDataFrame(rows, table.schema)
        for attempt in range(2):  # broken before its record, then repeated
            batch = commits.Batch(spark, table.path, "q", number, "m")
            table.append(frame, batch, NOW + number)
            if attempt == 0 and number:
                known_before = {r.g: r.rows for r in table.counts(spark).collect()}
                assert sum(known_before.values()) <= len(known)
        batch.commit(len(rows), 0, len(rows))
        check()
        if number % 2:
            table.merge(spark)
            check()
            table.drop_folded(spark)
            check()


def test_late_copies_are_answered_once(spark, tmp_path, monkeypatch):
    """Copies that come after the state was lost; and a break between the two records."""
    folder = tmp_path / "in"
    folder.mkdir()
    event = {"postId": "p", "userId": "u", "postText": "post", "commentText": "text"}
    (folder / "a").write_text("\n".join(json.dumps({**event, "commentId": c}) for c in ("c1", "c2")))
    seen, out = live.seen_comments(str(tmp_path / "seen"), buckets=4), str(tmp_path / "out")

    def run(checkpoint):
        events = streams.comment_stream(spark, source="text", path=str(folder), maxFilesPerTrigger=1)
        live.start_comment_flow(
            events, out, str(tmp_path / checkpoint), inference.offline_provider, "v", now_ms=NOW, seen=seen
        ).awaitTermination()

    def ids():
        replies = commits.committed_rows(spark, out, "replies", schemas.STREAM_REPLY)
        return sorted(r.commentId for r in replies.collect())

    def broken(*more):
        raise RuntimeError("the driver dies")

    with monkeypatch.context() as patch:
        patch.setattr(live, "_remember", broken)
        with pytest.raises(Exception, match="the driver dies"):
            run("one")
    assert ids() == ["c1", "c2"] and seen.rows(spark).count() == 0
    run("one")
    assert ids() == ["c1", "c2"] and seen.rows(spark).count() == 2
    (folder / "b").write_text("\n".join(json.dumps({**event, "commentId": c}) for c in ("c2", "c3")))
    run("two")
    assert ids() == ["c1", "c2", "c3"]
    seen.merge(spark)
    run("three")
    assert ids() == ["c1", "c2", "c3"] and seen.rows(spark).count() == 3
    assert spark.read.json(f"{out}/cleaned").filter(F.col("commentId") == "c2").count() == 1
