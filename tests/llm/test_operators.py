"""Each operator against a brute-force version, a round trip or held-out accuracy."""

import base64
import gzip
import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import (
    chunks,
    decontaminate,
    language,
    mixing,
    near_dup,
    outliers,
    quality,
    queries,
    statistics,
    toxicity,
    url_filter,
    warc,
)
from threadloom.session import scratch_dir


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def held_out(doc_id, modulus=5):
    return zlib.crc32(str(doc_id).encode()) % modulus


# --- 1: URL filter ------------------------------------------------------------


def glob_regex(glob):
    parts = re.split(r"(\*+|\?)", glob)
    table = {"?": "[^/]", "*": "[^/]*"}
    return "".join(table.get(p, ".*" if p.startswith("**") else re.escape(p)) for p in parts)


def test_automaton_equals_regex():
    rng = random.Random(3)
    letters = "ab/.é"
    globs = ["".join(rng.choice(letters + "*?*") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    urls = ["".join(rng.choice(letters + "x") for _ in range(rng.randint(0, 25))) for _ in range(400)]
    hits = url_filter.Automaton.of(globs).matches(urls)
    assert url_filter.Automaton.of(globs).step.shape[1] > 1  # more than one word of bits
    for i, glob in enumerate(globs):
        pattern = re.compile(glob_regex(glob), re.DOTALL)
        assert [bool(pattern.fullmatch(u)) for u in urls] == hits[:, i].tolist(), glob


def test_host_rules(spark):
    rows = [
        (1, "http://WWW.Example.com/en/1?x", "www.example.com/en/", "allow"),
        (2, "https://a.example.com/en/1", "example.com/en/", "block"),
        (3, "https://notexample.com/en/", "com/", "allow"),
        (4, "https://x.com", None, "allow"),
        (5, "https://x.org/y.example.com/en/", None, "allow"),
        (6, "https://casino.example.org/en/", None, "block"),
        (7, "https://x.org/casino/", None, "allow"),
        (8, None, None, "allow"),
        (9, "no url", None, "allow"),
        (10, "https://a.net/fr/" + "x" * 100_000, "net/fr/", "block"),
    ]
    pages = spark.createDataFrame([(i, u, "") for i, u, _, _ in rows], "page_id long, url string, html string")
    found = url_filter.filter_urls(pages, queries.URL_RULES, queries.URL_GLOBS).collect()
    assert {(r.page_id, r.rule, r.verdict) for r in found} == {(i, rule, v) for i, _, rule, v in rows}
    assert {r.host for r in found if r.page_id in (8, 9)} == {""}


# --- 2: decontamination -------------------------------------------------------


def brute_matches(text, items, size=10):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    own = split(text)
    hit, found = set(), set()
    for item, body in items:
        w = split(body)
        width = min(size, len(w))
        if not width:
            continue
        for i in range(len(w) - width + 1):
            for j in range(len(own) - width + 1):
                if own[j : j + width] == w[i : i + width]:
                    hit |= set(range(j, j + width))
                    found.add(str(item))
    return len(own), sorted(hit), sorted(found)


@pytest.mark.parametrize("block", [10**9, 200])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, rng.choice([0, 3, 10, 25]), 8))) for i in range(12)] + [(99, None)]
    texts = [None, "", "é!" * 50]
    for _ in range(30):
        base = words(rng, 60, 8)
        text = rng.choice([" ", ", ", "\n"]).join(base).upper()
        texts.append(text + "É " + (items[rng.randrange(12)][1] or ""))
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for row in decontaminate.match_benchmark(documents, benchmark).collect():
        n, hit, found = brute_matches(texts[row.doc_id], items)
        assert (row.n_words, row.words, row["items"]) == (n, hit, found)
        inside = [
            w for s in row.spans for w in decontaminate.words_of(texts[row.doc_id][s.start : s.end].encode())
        ]
        own = decontaminate.words_of((texts[row.doc_id] or "").encode())
        assert inside == [own[i] for i in hit]
    marked = decontaminate.mark_rows(documents, benchmark, "hits").collect()
    assert {r.doc_id: r.hits for r in marked} == {
        i: len(brute_matches(t, items)[1]) for i, t in enumerate(texts)
    }


def test_windows_of_many_items_share_no_lists():
    rng = random.Random(21)
    common = " ".join(words(rng, 15, 10_000))
    items = [(f"i{k}", f"{' '.join(words(rng, 12, 10_000))} {common}") for k in range(30)] + [("i3", common)]
    matcher = decontaminate.Matcher(items)
    assert matcher.match(common.upper().encode())[2] == {f"i{k}" for k in range(30)}
    for item, text in items[:30]:
        n, hit, found = matcher.match(text.encode())
        assert (n, len(hit)) == (27, 27) and item in found
        alone = text.rsplit(" ", 15)[0]
        assert matcher.match(alone.encode())[2] == {item}
    assert matcher.match(b"nothing known " * 20) == (40, pytest.approx([]), set())


def test_more_words_than_characters():
    """Where numbers of words run out, another automaton takes the windows that follow."""
    rng = random.Random(24)
    items = [(f"i{k}", " ".join(words(rng, 25, 60))) for k in range(12)]
    several = decontaminate.Matcher(items, size=4, most=20)
    assert len(several.parts) > 2 and len(decontaminate.Matcher(items, size=4).parts) == 1
    for _ in range(30):
        text = " ".join([*words(rng, 30, 60), *rng.choice(items)[1].split()[5:15], *words(rng, 9, 60)])
        n, hit, found = several.match(text.encode())
        assert (n, hit.tolist(), sorted(found)) == brute_matches(text, items, 4)


def test_automaton_is_small():
    """Memory of a benchmark of 300,000 characters, carried on to a full block."""
    code = (
        "import random, resource, sys\n"
        "from threadloom.llm import decontaminate\n"
        "rng = random.Random(22)\n"
        "text = lambda: ' '.join(f'{rng.randrange(10**6):06d}' for _ in range(100))\n"
        "items = [(i, text()) for i in range(430)]\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "matcher = decontaminate.Matcher(items)\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)\n"
    )
    kilobytes = int(subprocess.run([sys.executable, "-c", code], capture_output=True, check=True).stdout)
    assert kilobytes * 1024 / 300_000 * decontaminate.BLOCK_CHARS < 1e9


# --- 3: toxicity ----------------------------------------------------------------


def test_machine_learns_pairs():
    """Insult and group alone are harmless, together they are not: no sum of weights fits."""
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for _ in range(3000):
        insult, group = rng.random(2) < 0.5
        terms = {100, *rng.integers(1000, 1040, 3)} | ({1} if insult else {3}) | ({2} if group else {4})
        texts.append(np.array(sorted(terms)))
        labels.append(int(insult == group))
    labels = np.array(labels)
    machine = toxicity.fit_machine(
        texts[:2000], labels[:2000], np.ones(2000), steps=400, rate=0.03, least_spread=0.0
    )
    right = [(machine.score(t) >= 0.5) == bool(y) for t, y in zip(texts[2000:], labels[2000:], strict=True)]
    assert np.mean(right) > 0.95


def test_production_machine_learns_pairs():
    """As above with the production settings, and with many neutral words around."""
    for fillers, vocabulary in ((3, 40), (30, 400)):
        rng = np.random.default_rng(1)
        texts, labels = [], []
        for _ in range(3000):
            insult, group = rng.random(2) < 0.5
            own = rng.integers(1000, 1000 + vocabulary, fillers)
            texts.append(np.array(sorted({100, *own} | ({1} if insult else {3}) | ({2} if group else {4}))))
            labels.append(int(insult == group))
        labels = np.array(labels)
        machine = toxicity.fit_machine(texts[:2000], labels[:2000], np.ones(2000))
        right = [(machine.score(t) >= 0.5) == bool(y) for t, y in zip(texts[2000:], labels[2000:], strict=True)]
        assert np.mean(right) > 0.95


def test_pairs_counted_in_tasks_are_the_same(spark):
    rng = np.random.default_rng(4)
    texts = [np.unique(rng.integers(0, 300, 40)) for _ in range(600)]
    labels = np.array([int(5 in t and 9 in t) for t in texts])
    able = np.arange(300)
    known = np.array([100, 101])
    left, weights = labels - labels.mean(), rng.random(600) + 0.5
    alone = toxicity.paired_terms(texts, left, weights, labels.mean(), known, able)
    dealt = toxicity.paired_terms(texts, left, weights, labels.mean(), known, able, spark)
    assert alone.tolist() and sorted(alone.tolist()) == sorted(dealt.tolist()) and {5, 9} <= set(alone.tolist())


def test_toxic_texts_are_found_and_clean_ones_left_alone(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.QUERIES["op3_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    test = found.filter("held_out").toPandas()
    assert test.predicted[test.toxic == 1].mean() >= 0.85
    assert test.predicted[test.toxic == 0].mean() <= 0.01


def test_pair_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    rows = np.full(toxicity.BUCKETS, -1, np.int32)
    rows[:6] = range(6)
    machine = toxicity.Machine(rows, rng.normal(size=6), rng.normal(size=(6, 3)), 0.3)
    terms = np.array([0, 2, 3, 5, 77])
    pairs = sum(machine.factor[i] @ machine.factor[j] for i, j in combinations([0, 2, 3, 5], 2))
    margin = 0.3 + machine.weight[[0, 2, 3, 5]].sum() + pairs
    assert machine.score(terms) == pytest.approx(1 / (1 + np.exp(-margin)))


@pytest.mark.parametrize(
    ("name", "label", "least"), [("op3_toxicity", "toxic", 0.95), ("op4_quality_classifier", "quality", 0.97)]
)
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    found = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert all(found.held_out == [held_out(i) == 0 for i in found.doc_id])
    test = found[found.held_out]
    assert (test.predicted == test[label]).mean() >= least
    assert found.score.between(0, 1).all()


# --- 4: quality -------------------------------------------------------------------


def test_trees_walk_like_recursion():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(500, 4))
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 2] > 0)).astype(int)
    trees = quality.fit_trees(rows, labels, np.ones(500), trees=20, depth=3)

    def walk(tree, row, node=0):
        inner = trees.feature.shape[1]
        if node >= inner:
            return trees.leaf[tree, node - inner]
        right = row[trees.feature[tree, node]] > trees.threshold[tree, node]
        return walk(tree, row, 2 * node + 1 + right)

    expected = [trees.base + sum(walk(t, row) for t in range(20)) for row in rows]
    assert np.allclose(trees.margins(rows), expected)
    assert ((trees.scores(rows) > 0.5) == labels).mean() > 0.95


# --- 5: substring dedup -------------------------------------------------------------


def test_gear_hash_is_local():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 200).astype(np.uint8)
    slow = []
    for i in range(len(data)):
        last = data[max(0, i - chunks.WINDOW + 1) : i + 1][::-1]
        slow.append(sum(int(chunks.GEAR[b]) << k for k, b in enumerate(last)) % 2**32)
    assert chunks.gear_hashes(data).tolist() == slow


@pytest.mark.parametrize("raw", [b"", b" ", b"a", b"word " * 500, "é".encode() * 700, b"x" * 5000, b"\n a  b\t"])
def test_chunks_cover_the_text(raw):
    ends, counts = chunks.chunk_ends(raw)
    assert ends == sorted(set(ends)) and (not raw or ends[-1] == len(raw))
    pieces = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    assert b"".join(pieces) == raw and all(len(p) <= chunks.MOST_BYTES for p in pieces)
    raw.decode() and [p.decode() for p in pieces]
    assert sum(counts) >= len(raw.split())


def test_chunks_resist_insertions():
    rng = random.Random(6)
    shared = " ".join(words(rng, 300, 10_000)).encode()
    first, _ = chunks.chunk_digests(shared)
    second, _ = chunks.chunk_digests(" ".join(words(rng, 37, 10_000)).encode() + b" " + shared)
    assert len(set(first) & set(second)) >= 0.9 * len(first)


def test_passages_stay_once(spark):
    rng = random.Random(7)
    passages = [" ".join(words(rng, 60, 100_000)) for _ in range(20)]
    rows, planted = [], {}
    for i in range(200):
        own = [words(rng, 80, 100_000), words(rng, 40, 100_000)]
        if i % 2:
            planted[i] = i % 20 // 2
            rows.append((i, " ".join(own[0]) + "\n" + passages[planted[i]] + "\n" + " ".join(own[1])))
        else:
            rows.append((i, " ".join(own[0] + own[1])))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in chunks.dedupe_substrings(documents).collect()}
    assert len(found) == 200
    for i, text in rows:
        row = found[i]
        if i not in planted or i == min(k for k, v in planted.items() if v == planted[i]):
            assert row.text == text and not row.removed_spans
        else:
            assert passages[planted[i]] not in row.text and row.removed_words >= chunks.LEAST_WORDS
            gone = [text[s.start : s.end] for s in row.removed_spans]
            assert "".join(gone).strip() in text.replace("\n", "\n")
            assert len(row.text) + sum(map(len, gone)) == len(text)
            assert row.removed_words <= 60 + 2 * 8


def test_chains_cover_every_run():
    rng = random.Random(14)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 3, 6, 19, 25]) for _ in range(rng.randrange(12))]
        first, last, _ = chunks.chains_of(sizes)
        chains = list(zip(first.tolist(), last.tolist(), strict=True))
        assert len(set(chains)) == len(chains)
        assert all(sum(sizes[a : b + 1]) >= chunks.LEAST_WORDS for a, b in chains)
        for a, b in combinations(range(len(sizes) + 1), 2):
            inside = [set(range(i, j + 1)) for i, j in chains if a <= i and j < b]
            covered = set().union(*inside)
            # blank chunks at the ends of a run may stay
            bare = {k for k in range(a, b) if not sum(sizes[a : k + 1]) or not sum(sizes[k:b])}
            assert covered >= (set(range(a, b)) - bare if sum(sizes[a:b]) >= chunks.LEAST_WORDS else set())


def test_frequent_phrases_stay(spark):
    """Chunks that come from many earlier documents are no passage."""
    rng = random.Random(15)
    phrases = [" ".join(words(rng, 7, 100_000)) for _ in range(60)]
    rows = [(i, " ".join(rng.sample(phrases, 30))) for i in range(150)]
    passage = " ".join(words(rng, 60, 100_000))
    rows += [(i, " ".join([*rng.sample(phrases, 8), passage, *rng.sample(phrases, 8)])) for i in (200, 201)]
    found = {r.doc_id: r for r in chunks.dedupe_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        earlier = [f" {t} " for k, t in rows if k < i]
        for s in found[i].removed_spans:
            assert any(" " + text[s.start : s.end].strip() + " " in t for t in earlier), text[s.start : s.end]
        assert i == 201 or found[i].removed_words < 80
    assert passage in found[200].text and passage not in found[201].text


def brute_cuts(texts):
    """What is left of each text (id, text): chains of chunks that an earlier text holds go."""
    held, left = {}, {}
    for key, text in sorted(texts):
        raw = text.encode()
        own, sizes = chunks.chunk_digests(raw)
        ends = [0, *chunks.chunk_ends(raw)[0]]
        own, gone, mine = own.tolist(), set(), set()
        for a in range(len(own)):
            # the shortest chains from a on and up to a
            for b in range(a, len(own)):
                if sum(sizes[a : b + 1]) >= chunks.LEAST_WORDS:
                    mine.add((a, b))
                    break
            for b in range(a, -1, -1):
                if sum(sizes[b : a + 1]) >= chunks.LEAST_WORDS:
                    mine.add((b, a))
                    break
        for a, b in mine:
            if tuple(own[a : b + 1]) in held:
                gone |= set(range(a, b + 1))
        for a, b in mine:
            held.setdefault(tuple(own[a : b + 1]), key)
        left[key] = b"".join(raw[ends[i] : ends[i + 1]] for i in range(len(own)) if i not in gone).decode()
    return left


def chinese(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))


def test_cuts_equal_brute_force(spark):
    rng = random.Random(18)
    shared = [" ".join(words(rng, 70, 100_000)) for _ in range(4)] + [chinese(rng, 200) for _ in range(3)]
    texts = []
    for i in range(120):
        parts = [" ".join(words(rng, 40, 100_000)) if rng.random() < 0.7 else chinese(rng, 90) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(shared))
        texts.append((i, rng.choice(["", " ", "\n"]).join(parts)))
    found = chunks.dedupe_substrings(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in found} == brute_cuts(texts)


def test_text_without_blanks_is_deduplicated(spark):
    rng = random.Random(19)
    passage = chinese(rng, 400)
    texts = [(i, chinese(rng, 300 + 7 * i) + passage + chinese(rng, 200)) for i in range(4)]
    texts.append((9, chinese(rng, 3000)))
    assert len(chunks.chains_of(chunks.chunk_digests(texts[-1][1].encode())[1])[0]) > 100
    found = {r.doc_id: r for r in chunks.dedupe_substrings(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, text in texts:
        if i in (0, 9):
            assert found[i].text == text
        else:
            assert sum(s.end - s.start for s in found[i].removed_spans) > 320
            assert text[: 300 + 7 * i] in found[i].text and text[-190:] in found[i].text


# --- 6: mixing ------------------------------------------------------------------


def test_rates_solve_the_least_squares(spark):
    rng = np.random.default_rng(8)
    chances = rng.dirichlet([0.5, 0.3, 0.2], 400)
    tokens = rng.integers(0, 900, 400)
    scored = spark.createDataFrame(
        [(i, int(t), c.tolist()) for i, (t, c) in enumerate(zip(tokens, chances, strict=True))],
        "doc_id long, n_tokens long, chances array<double>",
    )
    for target in ([0.2, 0.3, 0.5], [0.02, 0.03, 0.95]):
        rows = mixing.fit_rates(scored, target).orderBy("doc_id").collect()
        rate = np.array([r.rate for r in rows])
        assert (rate >= 0).all()
        reached = (tokens * rate) @ chances / tokens.sum()
        # what plain numpy reaches after very many steps is no nearer
        moments = (chances * tokens[:, None]).T @ chances / tokens.sum()
        metric = np.linalg.inv(moments + mixing.RIDGE * np.trace(moments) / 3 * np.eye(3))
        best = np.ones(400)
        for _ in range(5000):
            left = (tokens * best) @ chances / tokens.sum() - target
            best = np.maximum(0, best - chances @ (metric @ left))
        left, mine = (tokens * best) @ chances / tokens.sum() - target, reached - target
        assert mine @ metric @ mine <= left @ metric @ left + 1e-4
        gradients, passes, told = mixing.fit_gradients(scored, target)
        assert np.allclose(told, mine, atol=1e-9) and passes < 30
        assert np.abs(mine).max() <= 1e-4  # both can be reached
        # at rest: a step along the gradient moves no rate
        slope = mixing.PULLS[-1] * metric_of(moments) @ gradients - mine
        assert np.abs(slope).max() <= 1e-6


def metric_of(moments):
    return moments + mixing.RIDGE * np.trace(moments) / len(moments) * np.eye(len(moments))


def test_rates_of_targets_out_of_reach(spark):
    """Ends at the nearest point, which plain steps approach from above, and says so."""
    rng = np.random.default_rng(3)
    chances, tokens = rng.dirichlet([8, 0.3, 0.6, 0.05], 500), rng.integers(0, 900, 500)
    scored = spark.createDataFrame(
        [(i, int(t), c.tolist()) for i, (t, c) in enumerate(zip(tokens, chances, strict=True))],
        "doc_id long, n_tokens long, chances array<double>",
    )
    target = np.array([0.05, 0.05, 0.05, 0.85])
    _, passes, left = mixing.fit_gradients(scored, target)
    moments = (chances * tokens[:, None]).T @ chances / tokens.sum()
    metric, best = np.linalg.inv(metric_of(moments)), np.ones(500)
    for _ in range(20000):
        plain = (tokens * best) @ chances / tokens.sum() - target
        best = np.maximum(0, best - chances @ (metric @ plain))
    assert passes < 60 and np.abs(left).max() > 0.01
    assert left @ metric @ left <= plain @ metric @ plain * (1 + 1e-6)


def test_mixing_reaches_targets(spark):
    found = queries.QUERIES["op6_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    chances = np.array(found.chances.tolist())
    assert np.allclose(chances.sum(axis=1), 1) and (found.rate >= 0).all()
    reached = (found.n_tokens.values * found.rate.values) @ chances / found.n_tokens.sum()
    assert np.abs(reached - list(mixing.TARGETS.values())).max() < 1e-3
    assert (abs(found.copies - found.rate) <= 1).all()


# --- 7: WARC --------------------------------------------------------------------


def test_chunked_framing():
    for payload in (b"", b"x", b"0\r\n\r\n" * 3000, bytes(range(256)) * 40):
        assert warc.unchunked(warc.chunked(payload, 100)) == payload
    assert warc.unchunked(b"5\r\nabc") is None and warc.unchunked(b"zz\r\n") is None


def test_archive_round_trip(spark):
    rng = random.Random(9)
    bodies = [None, "", "short", "é" * 60, "WARC/1.1\r\n\r\n" * 20, "x" * 100_000, " ".join(words(rng, 30_000))]
    pages = [(i, f"http://a.b/{i} é\r\n", body) for i, body in enumerate(bodies)]
    pages += [(20, None, bodies[6]), (21, "u", bodies[6]), (22, "u", "short"), (None, "u", bodies[3])]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = scratch_dir(spark, "warc")
    warc.write_archive(frame, path, segment=1000)
    found = warc.read_archive(spark, path).collect()
    assert len(found) == len(pages) and all(r.intact for r in found)
    by_id = {r.page_id: r for r in found}
    for key, _, body in pages:
        row, raw = by_id[None if key is None else str(key)], (body or "").encode()
        assert row.payload_length == len(raw)
        assert row.payload_digest == hashlib.sha256(raw).hexdigest()
        if row.record_type == "response":
            assert bytes(row.payload) == raw
    assert {k: r.refers_to for k, r in by_id.items() if r.refers_to} == {"20": "6", "21": "6", None: "3"}


def test_lost_segments_are_found(spark):
    path, broken = scratch_dir(spark, "warc"), scratch_dir(spark, "warc")
    frame = spark.createDataFrame([(1, "u", "x" * 5000), (2, "u", "y")], "page_id long, url string, html string")
    warc.write_archive(frame, path, segment=1000)
    content = b"".join(
        zlib.decompress(r.content, 47) for r in spark.read.format("binaryFile").load(path).collect()
    )
    records = list(warc.parse_file(content))
    kept = [r for r in records if r[0].get("warc-segment-number") != "3"]
    lines = [
        "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in f.items())]) + "\r\n\r\n" + block.decode()
        for f, block in kept
    ]
    spark.createDataFrame([(x,) for x in lines], "r string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(broken)
    found = {r.page_id: r for r in warc.read_archive(spark, broken).collect()}
    assert not found["1"].intact and found["1"].payload is None
    assert found["2"].intact and bytes(found["2"].payload) == b"y"


def archive(spark, content):
    path = f"{scratch_dir(spark, 'warc')}"
    os.makedirs(path)
    with open(f"{path}/part.warc", "wb") as file:
        file.write(content)
    return warc.read_archive(spark, path).collect()


def foreign(kind, number, block, **fields):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{number}>", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items())]
    lines.append(f"Content-Length: {len(block)}")
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def answer(body):
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body


def test_archives_of_other_writers(spark):
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"one").digest()).decode()
    records = [
        foreign("warcinfo", 0, b"software: x\r\n"),
        foreign("request", 1, b"GET / HTTP/1.1\r\n\r\n", WARC_Target_URI="http://a/"),
        foreign("response", 2, answer(b"one"), WARC_Target_URI="http://a/", WARC_Payload_Digest=digest),
        foreign("response", 3, answer(b"two"), WARC_Target_URI="http://b/", WARC_Payload_Digest=digest),
        foreign("revisit", 4, b"", WARC_Target_URI="http://c/", WARC_Refers_To_Target_URI="http://a/"),
        foreign("metadata", 5, b"x" * 50),
    ]
    for content in (b"".join(records), b"".join(map(gzip.compress, records))):
        found = {r.url: r for r in archive(spark, content)}
        assert sorted(found) == ["http://a/", "http://b/", "http://c/"]
        assert bytes(found["http://a/"].payload) == b"one" and found["http://a/"].intact
        assert bytes(found["http://b/"].payload) == b"two" and not found["http://b/"].intact
        assert (found["http://c/"].record_type, found["http://c/"].refers_to_uri) == ("revisit", "http://a/")


def test_damaged_archives(spark):
    good = [foreign("response", i, answer(b"body %d" % i), WARC_Target_URI=f"http://{i}/") for i in range(4)]
    whole = b"".join(good)
    damaged = {
        "cut in a block": (whole[:-20], {"0", "1", "2"}, 1),
        "cut in a head": (b"".join(good[:3]) + good[3][:40], {"0", "1", "2"}, 1),
        "no length": (good[0] + good[1].replace(b"Content-Length", b"Content-Size") + good[2], {"0", "2"}, 1),
        "wrong length": (good[0] + good[1].replace(b"Length: ", b"Length: 9") + good[2], {"0", "2"}, 1),
        "no id": (good[0] + good[1].replace(b"Record-ID", b"Record") + good[2], {"0", "2"}, 1),
        "rubbish": (b"\x00rubbish\r\n\r\n" + whole, {"0", "1", "2", "3"}, 1),
        "empty": (b"", set(), 0),
        "cut gzip": (b"".join(map(gzip.compress, good))[:-30], {"0", "1", "2"}, 1),
    }
    for name, (content, pages, broken) in damaged.items():
        found = archive(spark, content)
        assert {r.url[7:-1] for r in found if r.intact} == pages, name
        rest = [r for r in found if not r.intact]
        assert [(r.record_type, r.payload) for r in rest] == [("damaged", None)] * broken, name


# --- 8: quality rules -------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
    )


def test_counts():
    rng = random.Random(10)
    texts = ["", " \n", "a", "a b", "a a a a", "a b c a b c", "é#| x y z", "l\nl\n \nl\r\n"]
    texts += [rng.choice(" \n").join(words(rng, rng.randrange(200), 5)) for _ in range(100)]
    for text in texts:
        s = statistics.Summary(text.encode())
        assert (s.words, s.word_chars, s.symbols, s.dup_lines, s.repeats) == brute_counts(text), text


def test_chi_square():
    assert outliers.chi_square_share(11.0705, 5) == pytest.approx(0.95, abs=1e-5)
    assert outliers.chi_square_point(0.05, 5) == pytest.approx(11.0705, abs=1e-3)


def test_estimate_is_the_one_of_numpy(spark):
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(600, outliers.P)) * [1, 0.5, 0.02, 0.1, 0.1] + [6, 5, 0.1, 0.2, 0.1]
    rows[:90] += 5
    frame = spark.createDataFrame(
        [("c", *r.tolist()) for r in rows], "cell string, " + ", ".join(f"x{i} double" for i in range(outliers.P))
    )
    (row,) = outliers.estimate(frame).collect()
    mean, w = np.array(row.centre), np.array(row.w).reshape(outliers.P, outliers.P)
    # a further step of plain numpy, with the same bins, stays where the estimate is
    far = ((rows - mean) @ w.T) ** 2 @ np.ones(outliers.P)
    bins = np.floor(np.log2(np.maximum(far, 1e-9)) * outliers.BINS_PER_OCTAVE)
    edge = next(b for b in sorted(set(bins)) if (bins <= b).sum() >= outliers.CORE * len(rows))
    core = rows[bins <= edge]
    assert np.allclose(core.mean(axis=0), mean, atol=0.05)
    assert not (bins[:90] <= edge).any()  # the planted outliers are outside
    limit = outliers.chi_square_point(1e-6, outliers.P)
    assert (far[:90] > limit).all() and (far[90:] > limit).mean() < 0.01


@pytest.mark.parametrize("copies", [True, False])
def test_much_junk_of_one_kind_is_rejected(spark, copies):
    rng = np.random.default_rng(17)
    cells, shares = [], {"c35": 0.35, "c40": 0.40, "c45": 0.45}
    for name, share in shares.items():
        rows = rng.normal(size=(1000, outliers.P)) * [1, 0.5, 0.05, 0.1, 0.1] + [6, 5, 0.1, 0.2, 0.1]
        junk = int(1000 * share)
        rows[:junk] = rows[0] if copies else rows[:junk]
        rows[:junk, 2] += 2
        cells += [(name, i < junk, *r.tolist()) for i, r in enumerate(rows)]
    schema = "cell string, junk boolean, " + ", ".join(f"x{i} double" for i in range(outliers.P))
    frame = spark.createDataFrame(cells, schema)
    found = outliers.refined(frame, outliers.estimate(frame))
    limit = outliers.chi_square_point(outliers.TAIL, outliers.P)
    judged = frame.join(found, "cell").withColumn("far", outliers._distance() > limit).toPandas()
    assert judged[judged.junk].far.all() and judged[~judged.junk].far.mean() < 0.01


def test_rules_keep_clean_and_reject_noise(spark, data):
    found = queries.QUERIES["op8_quality_rules"](spark, data).join(
        spark.read.parquet(f"{data}/documents.parquet"), "doc_id"
    ).collect()
    for row in found:
        counts = brute_counts(row.text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert row.base_failed == failed and not (failed and row.kept)
        if not failed and counts[2] > 0.1 * counts[1]:
            assert not row.kept
        if not failed and counts[2] == counts[3] == counts[4] == 0:
            assert row.kept, row.text[:200]


# --- 9: near duplicates -----------------------------------------------------------


def brute_components(texts, size, percent):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {k: (len(sets[k]), find(k)) for k in texts}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, size, percent):
    rng = random.Random(12)
    texts, key = {1000: None, 1001: "", 1002: "a", 1003: "A", 1004: "a b", 1005: "b a"}, 0
    for _ in range(25):
        base = words(rng, rng.choice([6, 12, 30, 120]), 60)
        for _ in range(rng.randrange(12)):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                own[rng.randrange(len(own))] = f"n{rng.randrange(50)}"
            key += 1
            texts[(key * 7919) % 1000 + 2000 * (key % 3)] = rng.choice([" ", "\n"]).join(own).title()
            base = own if rng.random() < 0.3 else base  # chains
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {
        r.doc_id: (r.n_shingles, r.component_id)
        for r in near_dup.group_documents(rows, percent=percent, size=size).collect()
    }
    assert found == brute_components(texts, size, percent)
    stay = {r.doc_id for r in near_dup.keep_one(rows, percent=percent, size=size).collect()}
    assert stay == {k for k, (_, root) in found.items() if k == root}


def test_truncated_copies_are_linked(spark):
    """Copies whose sets are 80 to 85 % of the whole: the size filter has to follow the limit."""
    rng = random.Random(13)
    texts = {}
    for i in range(20):
        base = words(rng, 204, 100_000)  # 200 shingles of five words
        texts[10 * i] = " ".join(base)
        texts[10 * i + 1] = " ".join(base[: 4 + 162 + i % 8])
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {
        r.doc_id: (r.n_shingles, r.component_id)
        for r in near_dup.group_documents(rows, percent=80, size=5).collect()
    }
    assert found == brute_components(texts, 5, 80)
    assert {r.doc_id for r in near_dup.keep_one(rows).collect()} == {10 * i for i in range(20)}


def test_strays_of_a_hot_list_meet_all_members(spark):
    """A list of one component and an outsider forms pairs by strays, not by members squared."""
    rng = np.random.default_rng(23)
    rows = [(7, d, 100, 1 if d else 0) for d in range(3000)]
    rows += [(8, d, 100 + d % 40, d % 3) for d in range(60)]
    lists = spark.createDataFrame(rows, "token long, doc long, n long, component long")
    sketch = [int(x) for x in rng.integers(0, 2**62, near_dup.SKETCH_BITS // 64)]
    classes = spark.createDataFrame([(d, sketch) for d in range(3000)], "doc long, sketch array<long>")
    found = near_dup.rest_pairs(lists, classes, 85)
    expected = {(0, d) for d in range(1, 3000)}
    for a, b in combinations(range(60), 2):
        low, high = sorted((100 + a % 40, 100 + b % 40))
        if a % 3 != b % 3 and 100 * low >= 85 * high:
            expected.add((a, b))
    assert {(r.a, r.b) for r in found.collect()} == expected and found.count() == len(expected)


def test_size_bands_hold_all_similar_sizes(spark):
    for percent in (80, 85, 100):
        sizes = spark.range(1, 2500).select(F.col("id").alias("n"), near_dup.size_band(F.col("id"), percent).alias("band"))
        band = {r.n: r.band for r in sizes.collect()}
        assert all(band[-(-percent * n // 100)] >= band[n] - 1 for n in band)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (200, 100), (200, 300), (7, 7)]
    random.Random(1).shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in near_dup.components(frame).collect()}
    assert roots == {i: 0 for i in range(1, 61)} | {101: 100, 200: 100, 300: 100}


# --- 10: language -----------------------------------------------------------------


def brute_bits(samples, text):
    """Code length by the definition, with dictionaries and exclusion."""
    alphabet = {b for s in samples.values() for raw in s for b in raw}
    out = {}
    for name, raws in samples.items():
        counts = {}
        for raw in raws:
            padded = language.PAD + raw
            for i in range(language.ORDER, len(padded)):
                for k in range(language.ORDER + 1):
                    counts.setdefault(padded[i - k : i], Counter())[padded[i]] += 1

        def chance(context, byte, counts=counts):
            here = counts.get(context)
            lower = (lambda b: chance(context[1:], b)) if context else (lambda b: 1 / (len(alphabet) + 1))
            if not here:
                return lower(byte)
            total, kinds = sum(here.values()), len(here)
            if byte in here:
                return here[byte] / (total + kinds)
            return kinds / (total + kinds) * lower(byte) / max(1 - sum(lower(b) for b in here), 1e-6)

        padded = language.PAD + text
        out[name] = sum(
            -np.log2(chance(padded[i - language.ORDER : i], padded[i])) for i in range(language.ORDER, len(padded))
        )
    return out


def test_code_lengths_are_exact(monkeypatch):
    monkeypatch.setattr(language, "PIECE", 7)  # texts are coded in pieces
    samples = {"x": [b"banana band", b"ban"], "y": [b"cabana cab", b"abc abc"]}
    counts = {}
    for name, raws in samples.items():
        grams = np.concatenate([language.grams_of(raw) for raw in raws])
        counts[name] = np.unique(grams, return_counts=True)
    trees = language.Trees(counts)
    for text in (b"banana", b"cab band zzz abc banana", b"q", b"a"):
        expected = brute_bits(samples, text)
        assert trees.code_lengths([text, b"", text])[2] == pytest.approx([expected["x"], expected["y"]], rel=1e-4)


def test_languages(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.QUERIES["op10_language_id"](spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet"), "doc_id"
    ).toPandas()
    test = found[found.held_out]
    assert (test.held_out == [held_out(i, 4) == 2 for i in test.doc_id]).all()
    assert (test.lang == test.lang_pred).mean() > 0.97


def test_no_letters_no_language(spark):
    rows = [(i, "ab cd efg " * 5, "l1") for i in range(20)] + [(100, None, "l1"), (101, "12 !?", "l1"), (102, "", None)]
    found = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {100, 101, 102}
    empty = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify(empty).collect()] == ["und"]


def test_decontamination_digest(spark):
    frame = spark.createDataFrame([(["10", "9"],), ([],)], "items array<string>")
    found = [r[0] for r in frame.select(decontaminate.item_digest(F.col("items"))).collect()]
    assert found == [hashlib.sha256(b"10,9").hexdigest(), hashlib.sha256(b"").hexdigest()]
