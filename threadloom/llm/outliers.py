"""Quality rules: base limits, then robust multivariate outliers per language and source.

Each document that passes the base limits becomes a vector of transformed statistics. The
minimum-covariance-determinant estimate of a cell (language, source) starts at the shortest halves
of its statistics and is improved by concentration steps until no determinant shrinks: keep the
rows nearest to the centre, (n + P + 1) / 2 of the cell, and estimate centre and covariance from
them. They are estimated once more from all rows that are near by this. Distances are
counted in fine bins of their logarithm and moments are summed by bin, so that one grouping of
the whole table makes a step for all cells at once, however large a cell is.
"""

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.llm import statistics as st
from threadloom.llm.common import encoded, map_rows
from threadloom.session import materialize

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated 3-word windows

# Smaller cells of a language are put together: an estimate needs rows.
LEAST_ROWS = 200
CORE = 0.5  # the most that junk may nearly reach without moving the estimates
NEAR = 0.975  # share of normal rows that the last estimates are made of
LEAST_GAIN = 1e-6  # of the determinant's logarithm
QUANTILES = 101  # of a statistic; its shortest half is found among them
BINS_PER_OCTAVE = 32
TAIL = 1e-8  # chance that a clean document is rejected, under normal statistics

# (name, transformed statistic, least standard deviation that counts)
STATISTICS = [
    ("x0", "ln(1 + n_words)", 1.0),
    ("x1", "word_chars / n_words", 0.5),
    ("x2", "sqrt(n_symbols / word_chars)", 0.03),
    ("x3", "n_dup_lines / n_lines", 0.05),
    ("x4", "n_repeat_words / n_words", 0.05),
]
P = len(STATISTICS)
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


def count_statistics(documents):
    """The rows (doc_id, lang, source) of ``documents`` with COUNTS of the whole text."""

    def counts(columns):
        found = [st.Summary(raw) for raw in encoded(columns["text"])]
        return (
            [s.words for s in found],
            [s.word_chars for s in found],
            [s.symbols for s in found],
            [s.dup_lines for s in found],
            [s.repeats for s in found],
            [s.lines for s in found],
        )

    return map_rows(documents.select("doc_id", "lang", "source", "text"), counts, COUNTS, ["text"])


def chi_square_share(x, degrees):
    """Share of a chi-square distribution at or below ``x``."""
    a, x = degrees / 2, x / 2
    term = total = 1 / a
    for i in range(1, 2000):
        term *= x / (a + i)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a))) if x > 0 else 0.0


def chi_square_point(tail, degrees):
    """The value that a chi-square variable exceeds with chance ``tail``."""
    low, high = 0.0, 500.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - chi_square_share(middle, degrees) > tail else (low, middle)
    return high


def core_factor(core=CORE):
    """What makes the covariance of the nearest share of normal rows that of all rows."""
    point = chi_square_point(1 - core, P)
    return core / chi_square_share(point, P + 2)


def _whitening(covariance):
    """Lower-triangular W with |W (x - centre)| the Mahalanobis distance, least scales added."""
    least = np.diag([scale**2 for _, _, scale in STATISTICS])
    return np.linalg.inv(np.linalg.cholesky(covariance + least))


def _estimates(columns, core=CORE):
    """(centre, w, spread) of each cell from its number of rows, sums and sums of products;
    ``spread`` is the logarithm of the covariance's determinant."""
    n = np.maximum(np.array(columns["n"].to_pylist(), float), 1.0)
    sums = np.array([columns[f"s{i}"].to_pylist() for i in range(P)], float).T
    centre = sums / n[:, None]
    factor = core_factor(core)
    weights, spreads = [], []
    for row in range(len(n)):
        cov = np.zeros((P, P))
        for i in range(P):
            for j in range(i + 1):
                value = columns[f"q{i}{j}"][row].as_py() / n[row] - centre[row, i] * centre[row, j]
                cov[i, j] = cov[j, i] = value
        # rounding can leave a small negative eigenvalue
        values, vectors = np.linalg.eigh(cov * factor)
        cov = (vectors * np.maximum(values, 0)) @ vectors.T
        whitening = _whitening(cov)
        weights.append(whitening.ravel().tolist())
        spreads.append(float(-2 * np.log(np.diag(whitening)).sum()))
    return centre.tolist(), weights, spreads


def _starts(columns):
    """(centre, w, spread) of each cell from the shortest half of each statistic."""
    centre, weights, half = [], [], QUANTILES // 2
    for row in range(len(columns["cell"])):
        points = np.array([columns[f"p{i}"][row].as_py() for i in range(P)])
        lengths = points[:, half:] - points[:, : QUANTILES - half]
        first = lengths.argmin(axis=1)
        low, high = points[range(P), first], points[range(P), first + half]
        centre.append(((low + high) / 2).tolist())
        weights.append(_whitening(np.diag(((high - low) / 1.349) ** 2)).ravel().tolist())
    return centre, weights, [math.inf] * len(centre)


def _distance():
    """Squared Mahalanobis distance as an expression over x0.., centre and w."""
    terms = []
    for i in range(P):
        inner = " + ".join(f"w[{i * P + j}] * (x{j} - centre[{j}])" for j in range(i + 1))
        terms.append(f"pow({inner}, 2)")
    return F.expr(" + ".join(terms))


def with_cells(rows):
    """``rows`` with ``cell``: their language and source, or the language for small sources.

    Null languages and sources are cells of their own.
    """
    key = F.to_json(F.struct("lang", "source"))
    sizes = rows.groupBy(key.alias("_key")).agg(F.count("*").alias("_rows"))
    large = sizes.filter(F.col("_rows") >= LEAST_ROWS).select("_key")
    pooled = F.to_json(F.struct("lang", F.lit(True).alias("pooled")))
    known = rows.withColumn("_own", key)
    joined = known.join(large, known["_own"] == large["_key"], "left")
    return joined.withColumn("cell", F.coalesce("_key", pooled)).drop("_own", "_key")


FIT = "centre array<double>, w array<double>, spread double"


def _moments(share):
    """Sums by name of rows that count ``share`` each."""
    moments = {"n": F.sum(share)}
    moments |= {f"s{i}": F.sum(share * F.col(f"x{i}")) for i in range(P)}
    products = {f"q{i}{j}": F.col(f"x{i}") * F.col(f"x{j}") for i in range(P) for j in range(i + 1)}
    return moments | {name: F.sum(share * product) for name, product in products.items()}


def concentrated(rows, cells, core=CORE):
    """(cell, centre, w, spread) of the ``core`` of each of ``cells`` that is nearest by them."""
    octave = F.log2(F.greatest(F.col("d"), F.lit(1e-9)))
    moments = _moments(F.lit(1.0))
    by_bin = (
        rows.join(cells, "cell")
        .withColumn("d", _distance())
        .withColumn("bin", F.floor(octave * BINS_PER_OCTAVE))
        .groupBy("cell", "bin")
        .agg(*[moment.alias(name) for name, moment in moments.items()])
    )
    # a few hundred bins a cell: keep the nearest, and of the last one the part that is needed
    whole = Window.partitionBy("cell")
    before = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    nearest = by_bin.withColumn("nearer", F.coalesce(F.sum("n").over(before), F.lit(0.0)))
    nearest = nearest.withColumn("wanted", core * (F.sum("n").over(whole) + P + 1) - F.col("nearer"))
    part = F.least(F.lit(1.0), F.col("wanted") / F.col("n"))
    summed = nearest.filter("wanted > 0").groupBy("cell").agg(
        *[F.sum(part * F.col(name)).alias(name) for name in moments]
    )
    return map_rows(summed, _estimates, FIT).select("cell", "centre", "w", "spread")


def estimate(rows, core=CORE):
    """(cell, centre, w) of the robust estimates; ``rows`` has cell and x0.. and is stored.

    A cell is done when a step shrinks its determinant no more, which must happen: it falls by
    LEAST_GAIN in each other step and has a lower bound.
    """
    points = [i / (QUANTILES - 1) for i in range(QUANTILES)]
    points = [F.percentile_approx(name, points, 1000).alias(f"p{i}") for i, (name, _, _) in enumerate(STATISTICS)]
    starts = map_rows(rows.groupBy("cell").agg(*points), _starts, FIT)
    cells = starts.select("cell", "centre", "w", "spread", F.lit(True).alias("moved"))
    cells = materialize(cells, "cells")
    while not cells.filter("moved").isEmpty():
        moved = cells.filter("moved").select("cell", "centre", "w")
        new = concentrated(rows, moved, core)
        new = new.select("cell", *[F.col(c).alias(f"new_{c}") for c in ("centre", "w", "spread")])
        shrunk = F.coalesce(F.col("new_spread") < F.col("spread") - LEAST_GAIN, F.lit(False))
        both = cells.drop("moved").join(new, "cell", "left").withColumn("moved", shrunk)
        latest = [F.when(F.col("moved"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("centre", "w", "spread")]
        cells = materialize(both.select("cell", *latest, "moved"), "cells")
    return cells.select("cell", "centre", "w")


def refined(rows, cells, near=NEAR):
    """(cell, centre, w) from all rows that are as near by ``cells`` as the share ``near`` of
    normal rows."""
    limit = chi_square_point(1 - near, P)
    within = rows.join(cells, "cell").withColumn("d", _distance()).filter(F.col("d") <= limit)
    summed = within.groupBy("cell").agg(*[m.alias(name) for name, m in _moments(F.lit(1.0)).items()])
    found = map_rows(summed, lambda columns: _estimates(columns, near), FIT)
    return materialize(found.select("cell", "centre", "w"), "cells")


def judge(documents, tail=TAIL):
    """Counts, base_failed, distance and kept for each row of ``documents``.

    Words are runs of characters other than ASCII whitespace. A null or empty text has no words
    and fails. ``distance`` is the squared robust distance from the row's cell, null for rows
    that fail the base limits; they take no part in the estimates. Rows with a null lang or
    source have cells of their own. Repeated rows repeat and count each time. Further columns
    are ignored, whatever their names. ``tail`` is the chance that a row is rejected if all are
    normal; the limit is the same in tables of any size. ``cell`` names the language and source
    whose estimates were used, or the language with ``pooled`` where the source is small; it is
    null for rows that fail the base limits. Very long texts count whole; rows at the limit are
    kept.
    """
    counted = count_statistics(documents)
    counted = counted.withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS)
        | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
    )
    stored = materialize(counted, "statistics")
    passed = stored.filter(~F.col("base_failed"))
    vectors = with_cells(passed).withColumns({name: F.expr(text) for name, text, _ in STATISTICS})
    vectors = materialize(vectors, "vectors")
    cells = refined(vectors, estimate(vectors))
    judged = vectors.join(cells, "cell").withColumn("distance", _distance())
    limit = chi_square_point(tail, P)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*columns, "cell", "distance", (F.col("distance") <= limit).alias("kept")).unionByName(
        stored.filter("base_failed").select(
            *columns,
            F.lit(None).cast("string").alias("cell"),
            F.lit(None).cast("double").alias("distance"),
            F.lit(False).alias("kept"),
        )
    )
