import math

from pyspark.sql import functions as F

from threadloom import fixed_values as fixed
from threadloom.functions import identity
from threadloom.operators import comments as prep
from threadloom.operators import quality, views
from threadloom.schemas import NESTED_POST


def test_progress_rounds_half_up_and_stops_at_99(spark):
    rows = [("completed", 0, 0), ("x", 5, 0), ("x", 5, None), ("x", None, 10), ("x", 10, 10), ("x", 1, 8), ("x", 1, 200)]
    frame = spark.createDataFrame(rows, "s string, p long, t long")
    got = frame.select(identity.progress_percent(F.col("s"), F.col("p"), F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [100, 0, 0, 0, 99, 13, math.floor(0.5 + 0.5)]


def test_age_labels(spark):
    now = 10_000_000_000
    ages = {0: "0s ago", 59_999: "59s ago", 60_000: "1m ago", 3_599_999: "59m ago", 3_600_000: "1h ago",
            86_399_999: "23h ago", 86_400_000: "1d ago", 1_000_000_000: "11d ago"}
    frame = spark.createDataFrame([(now - a,) for a in ages], "t long")
    got = [r[0] for r in frame.select(identity.relative_age(F.col("t"), now)).collect()]
    assert got == list(ages.values())


def test_usernames(spark):
    names = ["a", " b ", "ab", "\tabc\n", "x" * 30, "y" * 31, "  "]
    frame = spark.createDataFrame([(n,) for n in names], "username string")
    got = [r.username for r in views.valid_usernames(frame).collect()]
    assert got == ["ab", "abc", "x" * 30]


def _replies(spark, rows):
    return spark.createDataFrame(
        rows, "replyId string, commentId string, postId string, generatedReply string, timestamp long"
    )


def test_live_copy_wins(spark):
    live = _replies(spark, [("1", "c", "p", "live", 1)])
    stored = _replies(spark, [("1", "c", "p", "old", 1), ("2", "c", "p", "kept", 2)])
    got = [(r.replyId, r.generatedReply, r.source) for r in views.merge_live_replies(live, stored).collect()]
    assert got == [("1", "live", "live"), ("2", "kept", "stored")]


def test_feed_counts_only_its_posts(spark):
    posts = spark.range(300).select(F.concat(F.lit("p"), "id").alias("postId"), F.col("id").alias("createdAt"))
    comments = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "p299").otherwise(F.concat(F.lit("p"), F.col("id") % 290)).alias("postId")
    )
    feed = views.feed_with_counts(posts, comments, comments.limit(0)).collect()
    assert [r.postId for r in feed] == [f"p{i}" for i in range(299, 199, -1)]
    assert feed[0].commentCount == 1000 and feed[0].replyCount == 0
    assert feed[1].commentCount == 0


def test_thread_keeps_every_reply_of_a_hot_comment(spark):
    comments = spark.createDataFrame(
        [("c1", "p", "u", "t", 1), ("c2", "p", "u", "t", 2)],
        "commentId string, postId string, username string, commentText string, createdAt long",
    )
    replies = _replies(spark, [(f"r{i:04}", "c1", "p", "x", i) for i in range(500)])
    got = views.thread_view(comments, replies).collect()
    assert [r.replyId for r in got] == [f"r{i:04}" for i in range(500)] + [None]


def test_lists_come_in_their_order(spark):
    rows = [(f"r{i:02}", "c1", f"p{i % 3}", "x", (i * 7) % 10 // 2) for i in range(20)]
    replies = _replies(spark, rows).repartition(4)
    newest = sorted(rows, key=lambda r: (-r[4], r[0]))
    assert [r.replyId for r in views.latest_replies(replies, 6).collect()] == [r[0] for r in newest[:6]]
    assert [r.replyId for r in views.newest_first(replies, "timestamp", "replyId").collect()] == [r[0] for r in newest]
    thread = sorted(rows, key=lambda r: (r[2], r[4], r[0]))
    assert [r.replyId for r in views.in_thread_order(replies, "timestamp", "replyId").collect()] == [r[0] for r in thread]
    ranked = views.recent_replies_per_post(replies, 2).collect()
    best = {post: [r[0] for r in newest if r[2] == post][:2] for post in ("p0", "p1", "p2")}
    assert sorted(r.replyId for r in ranked) == sorted(sum(best.values(), []))


def test_lookups(spark):
    posts = spark.createDataFrame([("a",), ("b",)], "postId string")
    assert views.lookup(posts, "postId", "b").count() == 1
    wanted = spark.createDataFrame([("a",), ("a",), ("z",)], "postId string")
    assert [r.postId for r in views.lookup_all(posts, "postId", wanted).collect()] == ["a"]


def test_job_selections(spark):
    rows = [
        ("1", "uploaded", None, "i", "o"), ("2", "submitted", "", "i", "o"), ("3", "uploaded", "s", "i", "o"),
        ("4", "uploaded", None, "", "o"), ("5", "inferring", None, "i", "o"), ("6", "completed", None, "i", "o"),
    ]
    jobs = spark.createDataFrame(
        rows, "jobId string, status string, sparkJobId string, inputPath string, outputPath string"
    )
    assert [r.jobId for r in views.stuck_jobs(jobs).collect()] == ["1", "2"]
    assert [r.jobId for r in views.active_jobs(jobs).collect()] == ["1", "2", "3", "4", "5"]


def _posts(spark):
    comment = lambda key, text: (key, "u", "n", text, 1, 1, None)
    head = lambda key, body, image: (key, "u", "n", "t", body, "s", image, None, 1, 1)
    return spark.createDataFrame(
        [
            head("p1", "body", "u") + ([comment("a", "so 🔥"), comment("a", "so 🔥"), comment("b", " \t")],),
            head("p2", None, None) + ([comment("c", "NULL here"), comment("d", "fine"), None],),
            head("p3", "body", "") + (None,),
        ],
        NESTED_POST,
    )


def test_profile_counts_groups_members_and_shares(spark):
    posts = _posts(spark)
    row = quality.quality_profile(posts, prep.explode_comments(posts)).first()
    assert (row.posts, row.nullPosts, row.postsWithImage, row.imagePercent) == (3, 1, 1, 33)
    assert (row.totalComments, row.dirty, row.empty, row.duplicates, row.clean) == (4, 3, 1, 2, 0)
    assert row.dirtyPercent == 75.0


def test_funnel_is_one_pass(spark):
    funnel = quality.quality_funnel(_posts(spark))
    plan = funnel._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1
    assert funnel.first().asDict() == {
        "posts": 3, "exploded": 5, "valid": 3, "withText": 2, "distinctComments": 1, "dropped": 2,
    }


def test_defaults_replace_nulls_only(spark):
    frame = spark.createDataFrame([("", None, None)], "username string, subreddit string, timestamp long")
    assert tuple(prep.fill_defaults(frame, 9).first()) == ("", fixed.DEFAULTS["subreddit"], 9)


def test_partition_sizes(spark):
    frame = spark.range(1201)
    assert prep.size_partitions(frame, 1201).rdd.getNumPartitions() == 3
    assert prep.size_partitions(frame, 0).rdd.getNumPartitions() == 1
