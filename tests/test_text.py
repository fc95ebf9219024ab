import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom import fixed_values as fixed
from threadloom.functions import text

CASES = [
    ("the lake froze 🧊🧊 overnight ☃️ #cold", "the lake froze overnight #cold", 5),
    ("notes are at https://notes.example.org/a?b=1 since noon", "notes are at [URL] since noon", 6),
    ("wide     gaps   \t here", "wide gaps here", 3),
    ("<b>bold</b> and a few signs: ¶°µ¿", "<b>bold</b> and a few signs:", 5),
    ("two 🐌 snails, www.example.org/snails", "two snails, [URL]", 3),
    ("second 🥈", "second", 1),
    ("a", "a", 1),
    ("ok", "ok", 1),
    ("www.example.com/spam", "[URL]", 1),
    ("a b", "ab", 1),
    ("HTTP://X.com", "HTTP://X.com", 1),
    ("back\\slash [b] {c} `d` ~|", "back\\slash [b] {c} `d` ~|", 5),
    ("v\x0bt", "v t", 2),
    ("ht🔥tp://joined.example", "[URL]", 1),
    ("ww§w.x", "www.x", 1),
    ("a ^ b", "a b", 2),
]
EMPTY = ["   ", "  \t  \n  ", "", "🏆🏆", "§ é", "^"]


def test_clean_body_on_known_cases(spark):
    rows = spark.createDataFrame([(raw, clean, n) for raw, clean, n in CASES], "raw string, c string, n int")
    got = rows.select(
        "raw", "c", "n",
        text.clean_body(F.col("raw")).alias("clean"),
        text.word_count(text.clean_body(F.col("raw"))).alias("words"),
        text.survives_cleaning(F.col("raw")).alias("kept"),
    ).collect()
    for row in got:
        assert (row.clean, row.words, row.kept) == (row.c, row.n, True), row.raw


def test_texts_that_clean_to_nothing(spark):
    rows = spark.createDataFrame([(raw,) for raw in EMPTY], "raw string")
    got = rows.select(
        text.clean_body(F.col("raw")).alias("clean"), text.survives_cleaning(F.col("raw")).alias("kept")
    ).collect()
    assert all(row.clean == "" and not row.kept for row in got)


def test_other_fields(spark):
    row = spark.createDataFrame([(" Data-Science🔥 ", "t  https://x.y\t")], "label string, title string")
    got = row.select(text.clean_label(F.col("label")), text.clean_title(F.col("title"))).first()
    assert tuple(got) == ("data-science", "t  https://x.y\t")


def test_listed_class_equals_the_negated_one(spark):
    codes = spark.range(1, 0x110000).filter("id < 55296 or id > 57343")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32")
    wrong = codes.select(char.alias("c")).filter(
        F.col("c").rlike("^" + text.characters_outside(fixed.KEPT_CHARACTERS) + "$")
        != F.col("c").rlike(f"^[^{fixed.KEPT_CHARACTERS}\\s]$")
    )
    assert wrong.count() == 0


def test_guards_do_not_change_results(spark, data):
    """Guarded steps equal the plain patterns on all documents and on a mix of pieces."""
    pieces = ["a", " ", "🔥", "é", "—", "www.", "w", "http", "://", "s", "^", "\t", "‍", "[", "."]
    mixes = spark.range(20000).select(
        F.concat(
            *[
                F.element_at(
                    F.array(*[F.lit(p) for p in pieces]),
                    (F.abs(F.xxhash64("id", F.lit(i))) % len(pieces) + 1).cast("int"),
                )
                for i in range(8)
            ]
        ).alias("t")
    )
    texts = mixes.unionByName(spark.read.parquet(f"{data}/documents.parquet").select(F.col("text").alias("t")))
    plain = F.regexp_replace("t", fixed.EMOJI, "")
    plain = F.regexp_replace(plain, fixed.URL, fixed.URL_MARK)
    plain = F.regexp_replace(plain, f"[^{fixed.KEPT_CHARACTERS}\\s]", "")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    checked = texts.select(
        plain.alias("plain"), text.clean_body(F.col("t")).alias("fast"),
        text.survives_cleaning(F.col("t")).alias("kept"),
    )
    assert checked.filter("plain <> fast or kept <> (length(plain) > 0)").count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_cleaned_text_is_plain(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    allowed = re.compile(f"^[{fixed.KEPT_CHARACTERS} ]*$")
    for row in rows.select(text.clean_body(F.col("t")).alias("c")).collect():
        assert allowed.match(row.c) and "  " not in row.c and row.c == row.c.strip()


@pytest.mark.parametrize("raw", ["  x ", " x ", "\x85x\x1f", "\n\tx　"])
def test_strip_blanks_equals_python(spark, raw):
    row = spark.createDataFrame([(raw,)], "t string").select(text.strip_blanks(F.col("t")).alias("s")).first()
    assert row.s == raw.strip()
