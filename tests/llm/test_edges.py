"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import (
    chunks,
    decontaminate,
    language,
    mixing,
    near_dup,
    outliers,
    quality,
    toxicity,
    url_filter,
    warc,
)
from threadloom.session import scratch_dir

CLASHES = [
    "score", "_score", "rate", "copies", "chances", "n_tokens", "label", "token", "tag", "_tag",
    "_doc", "doc", "digest", "places", "_places", "_rest", "removed_spans", "buckets", "stats",
    "n_words", "words", "items", "spans", "_hits", "_part", "host", "path", "rule", "kept",
    "component_id", "cell", "distance", "x0", "lang_pred", "held_out", "first", "_rank", "n",
]
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def long_text():
    rng = random.Random(1)
    return " ".join(f"long{rng.randrange(10**6)}" for _ in range(30_000)) + "é" * 5000


def document_rows():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(70)) for _ in range(12)]
    rows = [(i, t, "l1", "s1", len(t)) for i, t in enumerate(texts)]
    rows += [
        (100, None, "l1", "s1", 0),
        (101, "", None, None, None),
        (102, " \n\t ", "l1", None, 4),
        (103, "!?", "l2", "s1", 2),
        (104, long_text(), "l2", "s1", 10),
        (None, texts[0], "l1", "s1", 5),
        (None, None, None, None, None),
        (200, texts[3], "l1", "s1", 5),  # tie with 3
        (300, texts[4], "l1", "s1", 5),
        (300, texts[4], "l1", "s1", 5),  # repeated row
        (301, texts[5], "l1", "s1", 5),
        (301, texts[6], "l1", "s1", 5),  # one id, two texts
    ]
    return rows


def with_clashes(frame):
    return frame.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def tables(spark):
    labels = [(i, i % 2, 1 - i % 2) for i in range(12)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (5, None, None), (999, 1, 0)]
    benchmark = [(1, "nothing of this kind is in any of the other texts at all"), (2, None), (None, ""), (2, "w"), (2, "w")]
    return {
        "documents": with_clashes(spark.createDataFrame(document_rows(), DOCUMENT)).cache(),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": with_clashes(spark.createDataFrame(benchmark, "item_id long, text string")),
    }


def emptied(tables):
    return {name: frame.limit(0) for name, frame in tables.items()}


def _toxicity(t):
    return toxicity.classify(t["documents"], t["labels"])


def _quality(t):
    return quality.classify(t["documents"], t["labels"])


def _matches(t):
    return decontaminate.match_benchmark(t["documents"], t["benchmark"])


def _chunks(t):
    return chunks.dedupe_substrings(t["documents"])


def _mixing(t):
    return mixing.mix(t["documents"], mixing.quality_domains(t["labels"]), mixing.TARGETS)


def _outliers(t):
    return outliers.judge(t["documents"])


def _language(t):
    return language.identify(t["documents"])


def _near(t):
    return near_dup.group_documents(t["documents"])


BY_ROW = [_toxicity, _quality, _matches, _chunks, _mixing, _outliers, _language]


@pytest.mark.parametrize("operator", BY_ROW, ids=lambda f: f.__name__)
def test_a_row_for_each_row(tables, operator):
    rows = operator(tables).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in document_rows())
    alike = [tuple(sorted(str(v) for v in r.asDict().values())) for r in rows if r.doc_id == 300]
    assert alike[0] == alike[1]


@pytest.mark.parametrize("operator", [*BY_ROW, _near], ids=lambda f: f.__name__)
def test_empty_tables(tables, operator):
    assert operator(emptied(tables)).collect() == []


@pytest.mark.parametrize("operator", [_toxicity, _quality], ids=lambda f: f.__name__)
def test_scores_without_labels(tables, operator):
    rows = operator(tables | {"labels": tables["labels"].limit(0)}).collect()
    assert {r.score for r in rows} == {0.5}
    assert {r.held_out for r in rows if r.doc_id is None} == {False}


def test_results_for_missing_texts(tables):
    by_id = {r.doc_id: r for r in _matches(tables).collect()}
    assert [by_id[i].n_words for i in (100, 101, 102, 103)] == [0, 0, 0, 0]
    by_id = {r.doc_id: r for r in _outliers(tables).collect()}
    assert all(by_id[i].base_failed and not by_id[i].kept for i in (100, 101, 102, 103))
    assert by_id[104].n_words == 30_000
    by_id = {r.doc_id: r for r in _language(tables).collect()}
    assert {by_id[i].lang_pred for i in (100, 101, 102, 103)} == {"und"}
    by_id = {r.doc_id: r for r in _mixing(tables).collect()}
    assert [by_id[i].n_tokens for i in (100, 101, 102, 104)] == [0, 0, 0, 30_000]


def test_mixing_without_labels(tables):
    rows = mixing.mix(
        tables["documents"], mixing.quality_domains(tables["labels"].limit(0)), mixing.TARGETS
    ).collect()
    assert all(abs(c - 0.25) < 1e-9 for r in rows for c in r.chances)


def test_near_duplicates_of_odd_rows(tables):
    rows = _near(tables).collect()
    ids = [r.doc_id for r in rows]
    assert sorted(i for i in ids if i is not None) == sorted({r[0] for r in document_rows() if r[0] is not None})
    assert ids.count(None) == 2 and all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[200].component_id == 3 and not by_id[200].kept
    assert all(by_id[i].component_id == i and by_id[i].n_shingles == 0 for i in (100, 101, 102))


def test_passages_of_rows_without_id_come_first(tables):
    rows = _chunks(tables).collect()
    first = document_rows()[0][1]
    assert [r.text for r in rows if r.doc_id is None and r.text] == [first]
    (copy,) = [r for r in rows if r.doc_id == 0]
    assert copy.text == "" and copy.removed_words == 70
    assert [r.text for r in rows if r.doc_id in (100, 101, 102)].count(None) == 1
    texts = [r.text for r in rows if r.doc_id == 300]
    assert texts == ["", ""]  # both rows of a later document, copies of 4


def test_pages(spark):
    pages = [(1, "http://a.com/x", None), (1, "http://a.com/x", None), (None, None, ""), (2, "", "x" * 200_000)]
    frame = with_clashes(spark.createDataFrame(pages, "page_id long, url string, html string"))
    rows = url_filter.filter_urls(frame, {"com/": "allow"}, {}).collect()
    assert sorted((str(r.page_id), r.host, str(r.rule)) for r in rows) == sorted(
        [("1", "a.com", "com/"), ("1", "a.com", "com/"), ("2", "", "None"), ("None", "", "None")]
    )
    path = scratch_dir(spark, "warc")
    warc.write_archive(frame, path)
    found = warc.read_archive(spark, path).collect()
    assert sorted((str(r.page_id), r.payload_length, r.intact) for r in found) == sorted(
        [("1", 0, True), ("1", 0, True), ("2", 200_000, True), ("None", 0, True)]
    )
    assert url_filter.filter_urls(frame.limit(0), {}, {}).collect() == []
    path = scratch_dir(spark, "warc")
    warc.write_archive(frame.limit(0), path)
    assert warc.read_archive(spark, path).collect() == []


@pytest.fixture(scope="module")
def sf_dir(spark, tables):
    path = scratch_dir(spark, "edges")
    for name, frame in tables.items():
        frame.write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("rows", ["all", "none"])
@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_any_rows(spark, tables, sf_dir, stage, rows):
    name, function = stage
    docs = tables["documents"] if rows == "all" else tables["documents"].limit(0)
    found = function(spark, docs, sf_dir)
    if name != "mixing_to_targets":
        assert found.columns == docs.columns
    kept = found.collect()
    assert len(kept) <= (len(document_rows()) if rows == "all" else 0)
    if name == "minhash_near_dup" and rows == "all":
        ids = [r.doc_id for r in kept]
        assert ids.count(300) == 0 and ids.count(4) == 1 and ids.count(None) == 2 and 200 not in ids
        assert {100, 101, 102, 103, 104} <= set(ids)


def planted_rows():
    """(documents, benchmark, what should become of them)."""
    rng = random.Random(3)

    def prose(n):
        return " ".join(f"t{rng.randrange(10**5)}" for _ in range(n))

    passage, item = prose(60), prose(30)
    rows, gone, cut = [], set(), set()
    for i in range(60):
        rows.append((i, prose(120)))
    rows += [(100, rows[1][1]), (101, rows[2][1] + " tail"), (102, rows[2][1])]
    gone |= {100, 101, 102}
    rows += [(200 + i, f"{prose(80)} {passage} {prose(30)}") for i in range(5)]
    cut |= {201, 202, 203, 204}
    rows.append((300, f"{prose(50)} {item.upper()} {prose(40)}"))
    gone.add(300)
    return rows, [(1, item)], gone, cut, passage


def test_pipeline_equals_brute_force(spark):
    rows, items, gone, cut, passage = planted_rows()
    path = scratch_dir(spark, "planted")
    documents = spark.createDataFrame([(i, t, "l", "s", len(t)) for i, t in rows], DOCUMENT)
    documents.write.parquet(f"{path}/documents.parquet")
    # labels that reject nothing: the other stages are what is compared
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs, given = documents, {i: t for i, t in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path).cache()
        left = {r.doc_id: r.text for r in docs.collect()}
        if name == "substring_dedup":
            assert {i for i in left if left[i] != given[i]} == cut
            assert sum(passage in t for t in left.values()) == 1
            lengths = {r.doc_id: r.n_chars for r in docs.collect()}
            assert lengths == {i: len(t) for i, t in left.items()}
    assert set(left) == set(given) - gone
    mixed = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in mixed} == set(left)
    words = {r.doc_id: r.n_tokens for r in mixed}
    assert words == {i: len(re.split(r"\s+", t.strip())) for i, t in left.items()}
