"""Toxicity: a factorization machine over hashed terms.

Terms are the distinct words of a text and their first 4, 5 and 6 bytes. The machine adds a weight
for each term and, for each pair of terms in a text, the product of their factor vectors, so a
pair can weigh more than its parts. Fitted on a bounded sample of labels, MOST_LABELS of each
value; its size is bounded by BUCKETS. Terms are selected by what they tell alone or in a pair.
"""

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from threadloom.llm.common import (
    ALNUM,
    bounded_labels,
    crc_remainder,
    encoded,
    gathered,
    map_rows,
    sigmoid,
)

MOST_LABELS = 6_000
THRESHOLD = 0.5
BUCKETS = 1 << 18
LEAST_TEXTS = 5  # texts of the sample that a bucket must occur in
CHANCE = 0.01  # of taking any pair for telling that is not
FACTORS = 8
PREFIXES = (4, 5, 6)  # bytes
PAIR_TASKS = 96


def terms_of(raw):
    """Sorted distinct buckets of a text."""
    low = raw.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")
    words = set(low.translate(ALNUM).split())
    terms = set(words)
    for size in PREFIXES:
        terms |= {word[:size] + b"*" for word in words if len(word) > size}
    return np.unique(np.fromiter(map(crc32, terms), np.int64, len(terms)) % BUCKETS)


@dataclass
class Machine:
    """``rows`` gives a bucket's row in ``weight`` and ``factor``, or -1 for an unused bucket."""

    rows: np.ndarray
    weight: np.ndarray
    factor: np.ndarray
    base: float

    def score(self, buckets):
        rows = self.rows[buckets]
        rows = rows[rows >= 0]
        v = self.factor[rows]
        pairs = 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(sigmoid(self.base + self.weight[rows].sum(dtype=np.float64) + pairs))


class Pairs:
    """The sample's terms by text and by term, to count the pairs that a term is in."""

    def __init__(self, texts, left, weights, mean, known, able):
        self.mean, self.least = mean, np.log(max(len(able), 2) ** 2 / CHANCE)
        self.needed = self.least / -np.log(min(mean, 1 - mean))  # texts that a telling pair has at least
        flat = np.concatenate(texts).astype(np.int32) if texts else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
        able = able[np.bincount(flat, weights[owner], BUCKETS)[able] >= self.needed]
        known = np.isin(able, known)
        self.able = able[np.argsort(known, kind="stable")]  # known ones last
        self.unknown = int((~known).sum())
        place = np.full(BUCKETS, -1, np.int32)
        place[self.able] = np.arange(len(self.able))
        cells = place[flat]
        owner, cells = owner[cells >= 0], cells[cells >= 0]
        order = np.lexsort((cells, owner))
        self.owner, self.cells = owner[order], cells[order]
        self.ends = np.cumsum(np.bincount(self.owner, minlength=len(texts)))
        self.weights, self.left = weights, weights * left

    def telling(self, start, step):
        """Rows of ``able`` in a telling pair with one of the unknown terms start, start + step, ...

        A pair tells if the texts that hold both its terms leave more unexplained than chance
        does among all pairs, by the Chernoff bound of a sum of labels.
        """
        width, mean = len(self.able), self.mean
        tells = np.zeros(width, bool)
        by_term = np.argsort(self.cells, kind="stable").astype(np.int32)
        first = np.searchsorted(self.cells[by_term], np.arange(width + 1))
        for term in range(start, self.unknown, step):
            # each pair once: the places after the term's own in every text that holds it
            spots = by_term[first[term] : first[term + 1]]
            docs, begin = self.owner[spots], spots + 1
            sizes = self.ends[docs] - begin
            others = self.cells[np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            heavy = np.bincount(others, np.repeat(self.weights[docs], sizes), width)
            near = np.flatnonzero(heavy >= self.needed)
            surplus = np.bincount(others, np.repeat(self.left[docs], sizes), width)[near]
            share = np.clip(mean + surplus / heavy[near], 1e-9, 1 - 1e-9)
            apart = share * np.log(share / mean) + (1 - share) * np.log((1 - share) / (1 - mean))
            found = near[heavy[near] * apart >= self.least]
            tells[found] = True
            tells[term] |= len(found) > 0
        return np.flatnonzero(tells)


def paired_terms(texts, left, weights, mean, known, able, spark=None):
    """Terms among ``able`` but not ``known`` that tell in a pair, whatever they tell alone.

    ``left`` is what the known terms leave unexplained of each label. With ``spark`` the terms
    are dealt to PAIR_TASKS tasks, which count the pairs over the sample, a broadcast of
    bounded rows; only telling terms come back.
    """
    pairs = Pairs(texts, left, weights, mean, known, able)
    if spark is None:
        return pairs.able[pairs.telling(0, 1)]
    shared = spark.sparkContext.broadcast(pairs)

    def count(batches):
        for batch in batches:
            for start in batch.column("id").to_pylist():
                found = pa.array(shared.value.telling(start, PAIR_TASKS), pa.int32())
                yield pa.RecordBatch.from_arrays([found], names=["place"])

    places = spark.range(0, PAIR_TASKS, 1, PAIR_TASKS).mapInArrow(count, "place int").distinct()
    rows = np.sort(gathered(places)["place"].to_numpy())  # at most BUCKETS
    shared.destroy()
    return pairs.able[rows]


def fit_machine(texts, labels, weights, steps=400, rate=0.03, ridge=4.0, least_spread=2.5, seed=7, spark=None):
    """Full-batch descent with momentum; each term's step is scaled by how often it occurs.

    ``texts`` are arrays of buckets. Left out are terms in fewer than LEAST_TEXTS texts and
    those spread over both labels as chance would have it, up to ``least_spread`` deviations,
    unless a pair that they are in tells what the other terms do not. ``spark`` counts pairs.
    """
    flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    found = np.bincount(flat, minlength=BUCKETS)
    mean = np.clip((weights * labels).sum() / max(weights.sum(), 1e-9), 1e-3, 1 - 1e-3)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    heavy = np.bincount(flat, weights[owner], BUCKETS)
    surplus = np.bincount(flat, (weights * labels)[owner], BUCKETS) - mean * heavy
    spread = np.sqrt(np.maximum(heavy * mean * (1 - mean), 1e-9))
    del flat, owner
    able = np.flatnonzero(found >= LEAST_TEXTS)
    used = able[np.abs(surplus[able]) >= least_spread * spread[able]]
    if len(used) < len(able):
        alone = descend(texts, labels, weights, used, mean, steps, rate, ridge, seed)
        left = labels - np.array([alone.score(t) for t in texts])
        used = np.union1d(used, paired_terms(texts, left, weights, mean, used, able, spark))
    return descend(texts, labels, weights, used, mean, steps, rate, ridge, seed)


def descend(texts, labels, weights, used, mean, steps, rate, ridge, seed):
    """The machine over the terms ``used``, from weights of zero and small random factors."""
    flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    rows = np.full(BUCKETS, -1, np.int32)
    rows[used] = np.arange(len(used))
    cells = rows[flat]
    doc = owner[cells >= 0]
    cells = cells[cells >= 0]
    del flat, owner
    n, width = len(texts), len(used)
    base = float(np.log(mean / (1 - mean)))
    weight = np.zeros(width)
    factor = np.random.default_rng(seed).normal(0, 0.01, (width, FACTORS))
    share = np.bincount(cells, weights[doc], width) * mean * (1 - mean) + ridge
    push_w, push_v, push_b = np.zeros(width), np.zeros((width, FACTORS)), 0.0
    for _ in range(steps):
        sums = np.stack([np.bincount(doc, factor[cells, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(doc, (factor**2).sum(axis=1)[cells], n)
        margin = base + np.bincount(doc, weight[cells], n) + 0.5 * ((sums**2).sum(axis=1) - squares)
        error = weights * (labels - sigmoid(margin))
        own = error[doc]
        slope = np.bincount(cells, own, width)
        push_w = 0.9 * push_w + rate * (slope - ridge * 0.1 * weight) / share
        for f in range(FACTORS):
            pull = np.bincount(cells, own * sums[doc, f], width) - slope * factor[:, f]
            push_v[:, f] = 0.9 * push_v[:, f] + 0.2 * rate * (pull - ridge * factor[:, f]) / share
        np.clip(push_v, -0.05, 0.05, out=push_v)
        push_b = 0.9 * push_b + rate * error.sum() / max(weights.sum() * mean * (1 - mean), 1e-9)
        weight, factor, base = weight + push_w, factor + push_v, base + push_b
    return Machine(rows, weight.astype(np.float32), factor.astype(np.float32), base)


def fit_toxicity(documents, labels, label="toxic", most=MOST_LABELS):
    """The machine fitted on at most ``most`` documents of each label.

    Without any usable label every text scores 0.5.
    """
    sizes, ids = bounded_labels(documents, labels, label, most)
    texts = documents.select(F.col("doc_id").alias("_doc"), "text")
    # at most 2 * most rows
    chosen = texts.join(F.broadcast(ids), texts["_doc"] == ids["doc_id"]).select("doc_id", "text", "label")
    found = gathered(
        map_rows(
            chosen, lambda c: [[terms_of(raw).astype(np.int32) for raw in encoded(c["text"])]], "terms array<int>"
        )
        .drop("text")
        .orderBy("doc_id")
    )
    if not found.num_rows:
        return Machine(np.full(BUCKETS, -1, np.int32), np.zeros(0), np.zeros((0, FACTORS)), 0.0)
    marks = found["label"].to_numpy()
    terms = found["terms"].combine_chunks()
    ends = terms.offsets.to_numpy()
    flat = terms.values.to_numpy()
    weights = np.array([sizes.get(int(m), 1) / max(1, (marks == m).sum()) for m in marks])
    texts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return fit_machine(texts, marks, weights * len(marks) / weights.sum(), spark=documents.sparkSession)


def score_toxicity(documents, machine):
    """(doc_id, text, score) for each row; null texts score as empty ones."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def scores(columns):
        return [[shared.value.score(terms_of(raw)) for raw in encoded(columns["text"])]]

    return map_rows(documents.select("doc_id", "text"), scores, "score double")


def classify(documents, labels, threshold=THRESHOLD):
    """(doc_id, held_out, score, predicted) for each row of ``documents``.

    Fitted on labels of documents that are not held out; text is the only input of a score.
    Null and empty texts are scored too. Repeated rows repeat. A null doc_id is not held out,
    and nothing is learned from it. Further columns are ignored, whatever their names.
    """
    scored = score_toxicity(documents, fit_toxicity(documents, labels))
    return scored.select(
        "doc_id",
        F.coalesce(crc_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
