"""Conversation repair, nearest neighbours and fill-in-middle against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import fim, nearest, queries, repair

CONVERSATION = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>"
DOCUMENT = "doc_id long, text string"


# --- 11: repair -------------------------------------------------------------------

STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def as_name(value):
    return " " if value is None else str(value)


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv] += []
        kind = zlib.crc32(f"{as_name(conv)}:{as_name(turn)}".encode()) % 20
        role, text = as_name(role), as_name(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        role = "user" if kind == 4 else role
        if kind:
            out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2]))
    return {conv: sorted(found, key=order) for conv, found in out.items()}


def cheapest(rows, kinds):
    """Row by row: the least (cost, audit) and its lines for each last initial."""

    def with_inserts(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    after = STEP[state].get(role[0])
                    found = cost + 3, audit + "I", [*lines, f"{role}:"]
                    if after and (after not in best or found < best[after]):
                        best[after] = found
        return best

    best = with_inserts({"": (0, "", [])})
    for (_, role, text), kind in zip(rows, kinds, strict=True):
        found = defaultdict(list)
        for state, (cost, audit, lines) in best.items():
            found[state].append((cost + 4, audit + "D", lines))
            if kind in ("blank", "duplicate"):
                continue
            paid = cost + 3 * (kind == "truncated")
            if role[:1] in STEP[state]:
                found[STEP[state][role[:1]]].append((paid, audit + "K", [*lines, f"{role}:{text}"]))
            for new in ("user", "assistant"):
                if new[0] in STEP[state]:
                    found[new[0]].append((paid + 3, audit + "R", [*lines, f"{new}:{text}"]))
        best = with_inserts({state: min(each) for state, each in found.items()})
    return min(best[state] for state in ("", "a") if state in best)


def repaired(rows):
    out = {}
    for conv, found in damaged(rows).items():
        kinds, seen = [], set()
        for _, role, text in found:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            again = (role, text) in seen
            seen.add((role, text))
            kinds.append(
                "blank" if not body else "duplicate" if again else "" if body[-1] in ".!?" else "truncated"
            )
        turns = {turn for turn, _, _ in found if turn is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:], strict=False)]
        cost, audit, lines = cheapest(found, kinds)
        out[conv] = (
            gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def talk(seed=5):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    texts = ["hi.", "what? ", "no end", " ", None, "", "x!\n", "same.", "same.", " "]
    return [
        (conv, rng.choice([turn, turn, turn, None, turn + 2]), rng.choice(roles), rng.choice(texts))
        for conv in [*range(150), None]
        for turn in range(rng.randint(1, 12))
    ]


def reports(frame):
    return {row[0]: tuple(row[1:]) for row in repair.repair(frame).collect()}


def test_repair_equals_row_by_row(spark):
    rows = talk()
    rng = random.Random(6)
    # one conversation over many runs and tasks, with copies
    rows += [
        (999, turn // 2, rng.choice(["user", "assistant"]), f"text {rng.randrange(300)}.")
        for turn in range(900)
    ]
    frame = spark.createDataFrame(rows, CONVERSATION).repartition(5)
    assert reports(frame) == repaired(rows)


def test_repair_of_all_given_conversations(spark, data):
    given = spark.read.parquet(f"{data}/conversations.parquet")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    found = {row[0]: tuple(row[1:]) for row in queries.op11_repair(spark, data).collect()}
    assert found == repaired(rows)


def test_spans_put_together_equal_one_span():
    rng = random.Random(9)
    for _ in range(60):
        rows = [
            (rng.choice("suat"), rng.choice(["", "", "truncated", "blank", "duplicate"]))
            for _ in range(rng.randint(2, 14))
        ]
        whole = repair.spans(rows, 0)
        cut = rng.randrange(1, len(rows))
        prefix = repair.joined([(0, ""), None, None, None], [repair.spans(rows[:cut], s) for s in range(4)])
        assert repair.joined(prefix, [repair.spans(rows[cut:], s) for s in range(4)]) == whole


def test_small_runs_give_the_same_report(spark):
    frame = spark.createDataFrame(talk(8), CONVERSATION)
    once = sorted(map(repr, repair.report(frame).collect()))
    assert sorted(map(repr, repair.report(frame, run_rows=2).collect())) == once


def test_repaired_lines(spark):
    rows = repair.damage(spark.createDataFrame([], CONVERSATION))
    rows = spark.createDataFrame(
        [(1, 0, "system", "s."), (1, 1, "tool", "hello."), (1, 2, "assistant", "yes."), (1, 3, "user", "so?")],
        rows.schema,
    )
    found = repair.report(rows)
    lines = [r["new_role"] + ":" + r["new_text"] for r in repair.repaired(found, rows).orderBy("position").collect()]
    assert found.first()["audit"] == "KRKKI"
    assert lines == ["system:s.", "user:hello.", "assistant:yes.", "user:so?", "assistant:"]


def test_repair_of_odd_tables(spark):
    empty = spark.createDataFrame([], CONVERSATION)
    assert reports(empty) == {}
    rows = talk(3)[:40]
    clashing = spark.createDataFrame(rows, CONVERSATION).select(
        "*", *[F.lit("x").alias(c) for c in ("copies", "kind", "mark", "fault", "piece", "report", "audit", "cost")]
    )
    assert reports(clashing) == repaired(rows)
    long = [(1, 0, "user", "long " * 200_000 + "."), (1, 1, "assistant", "é" * 100_000 + "!")]
    assert reports(spark.createDataFrame(long, CONVERSATION)) == repaired(long)
    dropped = [(c, 0, "user", "x.") for c in range(100) if not zlib.crc32(f"{c}:0".encode()) % 20]
    nothing = hashlib.sha256(b"").hexdigest()
    found = reports(spark.createDataFrame(dropped, CONVERSATION))
    assert dropped and set(found.values()) == {(0, 0, 0, 0, 0, 0, "", nothing)}


# --- 12: nearest neighbours -------------------------------------------------------


def brute(rows, query_ids, k):
    """The k nearest of each query, by sums in the order of the components."""
    out = {}
    for q, vector in rows:
        if q in query_ids:
            near = [(-float((np.array(vector) * np.array(other)).sum()), i) for i, other in rows if i != q]
            out[q] = [(i, -score) for score, i in sorted(near)[:k]]
    return out


def neighbours(frame):
    out = defaultdict(list)
    for row in frame.orderBy("query_id", "rank").collect():
        out[row["query_id"]].append((row["vec_id"], row["score"]))
        assert row["rank"] == len(out[row["query_id"]])
    return dict(out)


def test_recall_on_all_given_vectors(spark):
    """On the larger tables too, against all products."""
    for sf, least in (("sf0.01", 0.99), ("sf0.1", 0.95)):
        path = f"/root/testdata/{sf}"
        rows = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
        vectors = np.stack(rows.embedding).astype(float)
        ids = rows.vec_id.to_numpy()
        asked = np.flatnonzero(ids % 20 == 0)
        found = neighbours(queries.op12_nearest(spark, path))
        hits = 0
        for at in asked:
            scores = vectors @ vectors[at]
            scores[at] = -np.inf
            best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
            hits += len(best & {i for i, _ in found[ids[at]]})
            assert len(found[ids[at]]) == 20
            for i, score in found[ids[at]]:
                assert score == pytest.approx(scores[ids == i][0], abs=1e-12)
        assert hits >= least * 20 * len(asked)


@pytest.fixture
def small_lists(monkeypatch):
    monkeypatch.setattr(nearest, "LIST_ROWS", 32)
    monkeypatch.setattr(nearest, "BLOCK_VALUES", 64 * 8)


def test_recall_with_many_lists_groups_and_blocks(spark, small_lists):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 3
    vectors = (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 8))).astype(np.float32)
    vectors[::3] *= 5  # lengths differ: products, not angles
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(4)
    index = nearest.fit(nearest.usable(frame))
    assert len(index.centroids.points) >= 32 and len(index.blocks) > 8
    asked = frame.filter("vec_id % 20 = 0")
    found = neighbours(nearest.search(frame, asked, 10))
    expected = brute(rows, set(range(0, 1500, 20)), 10)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in best}) for q, best in expected.items())
    assert hits >= 0.9 * 10 * len(expected)
    blocks = nearest.placed(nearest.usable(frame).withColumnRenamed("vec_id", "id"), index)
    sizes = blocks.groupBy("grp", "block").count().agg(F.max("count")).first()[0]
    assert sizes <= 8 * 64  # no task holds much more than its share


def test_lists_are_balanced_and_graph_finds_the_nearest():
    rng = np.random.default_rng(7)
    points = rng.normal(size=(4000, 12)).astype(np.float32)
    parts = nearest.halved(points, 64)
    assert {len(part) for part in parts} <= {62, 63}
    centroids = nearest.Centroids(np.stack([points[p].mean(axis=0) for p in parts]), neighbours=8)
    apart = nearest.squared(points[:600], centroids.points)
    found = centroids.search(points[:600], 1.2)
    assert (found.argmin(axis=1) == apart.argmin(axis=1)).mean() > 0.97
    near = apart <= apart.min(axis=1, keepdims=True) * 1.2**2
    assert (centroids.read(points[:600], 1.2) & near).sum() > 0.95 * near.sum()
    stored = centroids.stored(points[:600], 1.1, 3)
    assert stored.sum(axis=1).min() >= 1 and 1 < stored.sum(axis=1).mean() <= 3


def test_equal_vectors_and_ties(spark, small_lists):
    """A third of all rows is one vector: of it the smallest ids are found, whole and in order."""
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 0.0]) for i in range(0, 900, 3)]
    rows += [(i, rng.normal(size=3).round(1).tolist()) for i in range(900) if i % 3]
    frame = spark.createDataFrame(rows, VECTORS)
    hot = neighbours(nearest.search(frame, frame.filter("vec_id in (0, 30, 600)"), 20))
    for query in (0, 30, 600):
        same = [i for i, score in hot[query] if score == 5.0]
        assert len(hot[query]) == 20 and len(same) > 5
        assert same == [i for i in range(0, 900, 3) if i != query][: len(same)]
        assert all(score > 5.0 for i, score in hot[query][: 20 - len(same)])


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
           (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0])]
    good = [(20, [1.0, 0.0]), (21, [1.0, 0.0]), (21, [1.0, 0.0]), (22, [0.5, 1.0]), (23, [-2.0, 0.0]), (23, [3.0, 0.0])]
    frame = spark.createDataFrame(odd + good, VECTORS).withColumns(
        {c: F.lit("x") for c in ("id", "rank", "score", "grp", "block", "lists", "query", "place")}
    )
    found = neighbours(nearest.search(frame, frame, 20))
    # one id with two vectors: the nearest of them counts; repeated rows count once
    assert found[20] == [(23, 3.0), (21, 1.0), (22, 0.5)]
    assert set(found) == {20, 21, 22, 23}
    assert found[22] == [(23, 1.5), (20, 0.5), (21, 0.5)]
    empty = frame.limit(0)
    assert nearest.search(empty, empty, 20).collect() == []
    assert nearest.search(frame, empty, 20).collect() == []
    alone = frame.filter("vec_id = 20")
    assert nearest.search(alone, alone, 20).collect() == []


# --- 13: fill-in-middle -----------------------------------------------------------


def test_rank_index_is_exact_and_bounded():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("aZ b.é\n7") for _ in range(rng.randint(0, 3000)))
        ends = fim.boundaries(text)
        assert ends.tolist() == [0] + [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]
        for bound in (1, 3, 127):
            index = fim.RankIndex(ends, bound)
            assert (index.offsets(np.arange(len(ends))) == ends).all()
            assert np.abs(index.rest).max() <= bound
            if bound == 127 and len(ends) > 1000:
                assert len(index.slopes) < len(ends) / 100  # pieces, not a table


def plain_form(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_forms_equal_plain_version_and_are_restored(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("aB <>PSM.é😀\n") for _ in range(rng.randint(0, 60)))) for i in range(500)]
    rows += [(None, "no id here"), (501, None), (502, ""), (503, "one <S> mark"), (504, "word " * 100_000),
             (505, "<P"), (506, "x" * 300_000), (507, "漢字" * 50_000), (5, rows[5][1])]
    frame = spark.createDataFrame(rows, DOCUMENT).select(
        "*", *[F.lit("x").alias(c) for c in ("n", "Form", "output", "middle_chars", "other", "_fim")]
    )
    found = fim.transform(frame).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    assert found.columns[:4] == ["doc_id", "text", "other", "_fim"]
    got = sorted(repr((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in found.collect())
    assert got == sorted(repr((i, t, *plain_form(i, t))) for i, t in rows)
    assert found.filter("not (back <=> coalesce(text, ''))").count() == 0
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}


def test_no_documents(spark):
    assert fim.transform(spark.createDataFrame([], DOCUMENT)).collect() == []
