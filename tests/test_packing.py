import hashlib
import math

import pytest
from pyspark.sql import functions as F

from threadloom.operators import packing


def _items(spark, n=1200):
    """A hot post with a third of all items, small posts, single posts, long prefixes."""
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("c"), i).alias("id"),
        F.when(i % 3 == 0, F.concat(F.repeat(F.lit("x"), F.lit(200)), i.cast("string")))
        .when(i % 3 == 1, F.concat(F.lit("post "), F.floor(i / 40).cast("string")))
        .otherwise(F.concat(F.lit("single "), i.cast("string")))
        .alias("post_text"),
        F.concat(F.lit("text "), i).alias("comment_text"),
        F.when(i % 2 == 0, "").otherwise("cap").alias("image_caption"),
    )


def _brute_force(items):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    buckets = math.ceil(len(items) / 50)
    groups = {}
    for item in items:
        groups.setdefault(sha(item.post_text[:200]), []).append(item.id)
    calls, pools = {}, {}
    for key, ids in groups.items():
        ids.sort(key=lambda i: (md5(i), i))
        if len(ids) > 1:
            for place, item in enumerate(ids):
                calls[item] = (f"{key}-{place // 10}", place % 10 + 1)
        else:
            pools.setdefault(int(key[:10], 16) % buckets, []).extend(ids)
    for bucket, ids in pools.items():
        for place, item in enumerate(sorted(ids, key=lambda i: (md5(i), i))):
            calls[item] = (f"mixed-{bucket}-{place // 10}", place % 10 + 1)
    return calls


@pytest.mark.parametrize("floor", [30, 100_000])
def test_packing_equals_brute_force(spark, floor):
    items = _items(spark)
    packed = packing.pack_calls(items, floor=floor).collect()
    assert {r.id: (r.callId, r.pos) for r in packed} == _brute_force(items.collect())
    assert len(packed) == 1200


def test_calls_hold_at_most_ten_and_prompts_number_them(spark):
    calls = packing.build_calls(packing.pack_calls(_items(spark))).collect()
    assert max(c["size"] for c in calls) == 10
    assert sum(c["size"] for c in calls) == 1200
    for call in calls:
        assert [i.pos for i in call["items"]] == list(range(1, call["size"] + 1))
        assert all(f"\n[{n}] " in call.prompt for n in range(1, call["size"] + 1))


def test_prompt_texts(spark):
    rows = [
        ("a", "same post", "one", "cap"),
        ("b", "same post", "two", ""),
        ("c", "p" * 250, "z" * 400, "i" * 120),
    ]
    items = spark.createDataFrame(rows, "id string, post_text string, comment_text string, image_caption string")
    calls = {c.kind: c for c in packing.build_calls(packing.pack_calls(items)).collect()}
    same, mixed = calls["same_post"], calls["mixed_post"]
    first, second = [i.comment_text for i in same["items"]]
    caption = "\n(image: cap)" if first == "one" else ""
    assert same.prompt == (
        f"Post: same post{caption}\n\nComments to reply to:\n[1] {first}\n[2] {second}"
        "\n\nReply to each comment above (use [1], [2], etc.):"
    )
    assert mixed.prompt == (
        "Reply to each of the following post+comment pairs:\n"
        f"\n[1] Post: {'p' * 200} (image: {'i' * 100})\n    Comment: {'z' * 300}"
        "\n\nReply to each item above (use [1], [2], etc.):"
    )
    assert (same.maxTokens, mixed.maxTokens) == (210, 180)


def test_slots_are_dealt_in_turn_even_in_a_hot_bucket(spark):
    calls = spark.range(900).select(
        F.concat(F.lit("call"), "id").alias("callId"), F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("bucket")
    )
    dealt = packing.assign_slots(calls, 3, floor=40)
    counts = dealt.filter("bucket = 0").groupBy("slot").count().collect()
    assert sorted(c["count"] for c in counts) == [200, 200, 200]


def test_report(spark):
    report = packing.packing_report(packing.pack_calls(_items(spark))).first()
    assert report["items"] == 1200 and report.largestCall == 10
    assert report.postGroups == 1 + 30 + 400
