"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete binary trees laid out in arrays, so a batch walks all trees level by level
with numpy. Fitted on a bounded sample of labels, MOST_LABELS of each value.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import statistics as st
from threadloom.llm.common import (
    bounded_labels,
    crc_remainder,
    encoded,
    gathered,
    map_rows,
    sigmoid,
    unused,
)

MOST_LABELS = 10_000
THRESHOLD = 0.3
FEATURES = 11


def features_of(raw):
    """The statistics of one text as FEATURES numbers; all are finite, for an empty text too."""
    s = st.Summary(raw)
    size, words, lines = max(1, len(raw)), max(1, s.words), max(1, s.lines)
    letters = max(1, int(s.counts[st.LOWER] + s.counts[st.UPPER]))
    return (
        np.log1p(s.words),
        s.word_chars / words,
        s.symbols / size,
        int(s.counts[st.UPPER]) / letters,
        int(s.counts[st.DIGIT]) / size,
        int(s.counts[st.PUNCT]) / size,
        s.distinct / words,
        s.repeats / words,
        s.doubled / words,
        s.dup_lines / lines,
        np.log1p(s.words / lines),
    )


def feature_rows(texts):
    rows = [features_of(raw) for raw in encoded(texts)]
    return np.array(rows, np.float64).reshape(-1, FEATURES)


@dataclass
class Trees:
    """``feature`` and ``threshold`` by (tree, inner node), ``leaf`` by (tree, leaf)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margins(self, rows):
        trees = np.arange(len(self.feature))
        at = np.zeros((len(rows), len(trees)), np.int64)
        inner = self.feature.shape[1]
        each = np.arange(len(rows))[:, None]
        while inner and at.size and at.flat[0] < inner:
            right = rows[each, self.feature[trees, at]] > self.threshold[trees, at]
            at = 2 * at + 1 + right
        return self.base + self.leaf[trees, at - inner].sum(axis=1)

    def scores(self, rows):
        return sigmoid(self.margins(rows))


def fit_trees(rows, labels, weights, trees=80, depth=4, rate=0.15, bins=64, ridge=2.0, least=4.0):
    """Boost on the logistic loss; splits are searched on quantile histograms of each column."""
    edges = [
        np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in rows.T
    ]
    binned = np.stack(
        [np.searchsorted(e, column, side="left") for e, column in zip(edges, rows.T, strict=True)], axis=1
    )
    total = weights.sum()
    mean = np.clip((weights * labels).sum() / total, 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(len(rows), base)
    inner, leaves, width = 2**depth - 1, 2**depth, rows.shape[1]
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    for tree in range(trees):
        chance = sigmoid(margin)
        gradient, curve = weights * (labels - chance), weights * chance * (1 - chance)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            gain = np.zeros(nodes)
            picked = np.full((nodes, 2), -1)
            for column in range(width):
                cell = node * (bins + 1) + binned[:, column]
                shape = (nodes, bins + 1)
                g = np.bincount(cell, gradient, nodes * (bins + 1)).reshape(shape).cumsum(axis=1)
                h = np.bincount(cell, curve, nodes * (bins + 1)).reshape(shape).cumsum(axis=1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                better = (
                    g**2 / (h + ridge)
                    + (g_all - g) ** 2 / (h_all - h + ridge)
                    - g_all**2 / (h_all + ridge)
                )
                better[(h < least) | (h_all - h < least)] = 0
                better[:, len(edges[column]) :] = 0
                cut = better.argmax(axis=1)
                value = better[np.arange(nodes), cut]
                won = value > gain + 1e-9
                gain[won] = value[won]
                picked[won] = np.stack([np.full(nodes, column), cut], axis=1)[won]
            for i, (column, cut) in enumerate(picked):
                if column >= 0:
                    feature[tree, first + i] = column
                    threshold[tree, first + i] = edges[column][cut]
            own = first + node
            node = 2 * node + (rows[np.arange(len(rows)), feature[tree, own]] > threshold[tree, own])
        g, h = np.bincount(node, gradient, leaves), np.bincount(node, curve, leaves)
        leaf[tree] = rate * g / (h + ridge)
        margin += leaf[tree, node]
    return Trees(feature, threshold, leaf, base)


def fit_quality(documents, labels, label="quality", most=MOST_LABELS):
    """Trees fitted on at most ``most`` documents of each label, weighted back to their shares.

    Without any usable label every text scores 0.5; with one value only, near that value.
    """
    sizes, ids = bounded_labels(documents, labels, label, most)
    texts = documents.select(F.col("doc_id").alias("_doc"), "text")
    # at most 2 * most rows
    chosen = texts.join(F.broadcast(ids), texts["_doc"] == ids["doc_id"]).select("text", "label")
    names = [f"f{i}" for i in range(FEATURES)]
    found = gathered(
        map_rows(
            chosen, lambda c: list(feature_rows(c["text"]).T), ", ".join(f"{n} double" for n in names), ["text"]
        )
    )
    if not found.num_rows:
        return Trees(np.zeros((1, 0), np.int64), np.zeros((1, 0)), np.zeros((1, 1)), 0.0)
    rows = np.stack([found[n].to_numpy() for n in names], axis=1)
    marks = found["label"].to_numpy()
    order = np.lexsort((*rows.T, marks))  # the fit does not depend on the order of rows
    rows, marks = rows[order], marks[order]
    weights = np.array([sizes.get(int(m), 1) / max(1, (marks == m).sum()) for m in marks])
    return fit_trees(rows, marks, weights * len(marks) / weights.sum())


def score_quality(documents, trees, name="score"):
    """Every row of ``documents`` with the chance of label 1 as ``name``; null texts as empty.

    Other columns are handed through.
    """
    shared = documents.sparkSession.sparkContext.broadcast(trees)
    return map_rows(
        documents, lambda c: [shared.value.scores(feature_rows(c["text"]))], f"{name} double"
    )


def classify(documents, labels, threshold=THRESHOLD):
    """(doc_id, held_out, score, predicted) for each row of ``documents``.

    Fitted on labels of documents that are not held out; text is the only input of a score.
    Null and empty texts are scored too. Repeated rows repeat. A null doc_id is not held out,
    and nothing is learned from it.
    """
    trees = fit_quality(documents, labels)
    scored = score_quality(documents.select("doc_id", "text"), trees)
    return scored.select(
        "doc_id",
        F.coalesce(crc_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(documents, labels, threshold=THRESHOLD):
    """The rows of ``documents`` that the classifier does not reject, columns as they were."""
    name = unused(documents, "_score")
    scored = score_quality(documents, fit_quality(documents, labels), name)
    return scored.filter(F.col(name) >= threshold).drop(name)
