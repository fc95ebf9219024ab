"""The corpus pipeline: documents pass through the stages in order.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, in the columns of documents;
the last one adds to each document, without its text, how often it is to be used.
"""

from pyspark.sql import functions as F

from threadloom.llm import chunks, decontaminate, mixing, near_dup, quality
from threadloom.llm.common import table, unused
from threadloom.session import materialize


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier does not reject; it learns from labels of ``docs``."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def minhash_near_dup(spark, docs, sf_dir):
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return near_dup.keep_one(docs)


def substring_dedup(spark, docs, sf_dir):
    """Passages kept in their first document only; ``n_chars`` is counted anew.

    A document goes if a passage was cut out of it and no word is left.
    """
    cut = chunks.dedupe_substrings(docs)
    words = F.length(F.trim(F.translate("text", "\t\n\v\f\r", "     "))) > 0
    left = cut.filter((F.size("removed_spans") == 0) | words)
    if "n_chars" in docs.columns:
        length = F.length("text").cast("bigint")
        left = left.withColumn("n_chars", F.when(F.size("removed_spans") > 0, length).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold no window of a benchmark item."""
    hits = unused(docs, "_hits")
    found = decontaminate.mark_rows(docs, table(spark, sf_dir, "benchmark"), hits)
    return found.filter(F.col(hits) == 0).drop(hits)


def mixing_to_targets(spark, docs, sf_dir):
    """Rate and copies of each document for the target weights of quality and toxicity."""
    labelled = mixing.quality_domains(table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labelled, mixing.TARGETS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dup", minhash_near_dup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_to_targets", mixing_to_targets),
]

# Fitted models, hashes and components: tests compare with brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over the whole table of documents, each stored before the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
