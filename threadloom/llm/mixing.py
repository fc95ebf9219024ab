"""Mixing to target weights by soft membership, in DataFrame functions only.

A classifier counted on the labelled table gives each document the chances of the domains: log
odds of its hashed words and three statistics go through a linear discriminant. Nonnegative
rates (how often to use a document) are then fitted by projected gradient least squares, so that
the expected tokens of each domain, summed over all documents, match the target weights.
Gradients are summed up and the sum is projected, so a document's rate follows from its chances
and one number a domain, and each step is one aggregation of a few sums over stored rows.
"""

import logging

import numpy as np
from pyspark.sql import functions as F

from threadloom.session import materialize

LOG = logging.getLogger(__name__)
BUCKETS = 1 << 15  # of hashed words, a power of 2: bounds the model
PREFIX = 4  # characters of a word that are a word of their own
# All ASCII but digits and a-z, one by one: Java looks up single characters in a table, ranges in turn.
BREAK = "[" + "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isdigit() and not chr(i).islower()) + "]+"
SYMBOL_RUN, CAPITAL_RUN = "[#*$%&|<>]+", "[A-Z]{3,}"
MOST_LABELS = 10_000  # documents of each domain that are learned from
PRIOR = 4.0  # documents that each count starts from, at the corpus mean
# A bucket counts if some domain's share is so many deviations and so large a factor off.
LEAST_SPREAD, LEAST_LIFT = 6.0, 1.2
MOST_ODDS = 8.0
STATISTICS = 3
TOLERANCE = 1e-6  # of all tokens
PULLS, LEAST_LENGTH = [10.0**-i for i in range(1, 8)], 1e-10
RIDGE = 1e-3  # of the mean second moment: domains that no document tells apart stay so

TARGETS = {"good_clean": 0.86, "good_toxic": 0.03, "poor_clean": 0.10, "poor_toxic": 0.01}


def bound(value, use):
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def words_of(text):
    """Lower-cased words: runs of ASCII letters and digits and of all beyond ASCII."""
    return F.array_remove(F.split(F.lower(text), BREAK), "")


def buckets_of(distinct):
    """Buckets of the distinct words and of their first characters; some may repeat."""

    def bucket(*parts):
        return F.xxhash64(*parts).bitwiseAND(F.lit(BUCKETS - 1))

    prefixes = F.transform(distinct, lambda w: bucket(F.lit(PREFIX), F.substring(w, 1, PREFIX)))
    return F.concat(F.transform(distinct, lambda w: bucket(w)), prefixes)


def statistics_of(text, words, distinct):
    """Runs of symbols and of capitals for each word, and how far repetition exceeds what
    length explains."""
    size = F.greatest(F.size(words).cast("double"), F.lit(0.5))
    fresh = F.greatest(F.size(distinct).cast("double"), F.lit(0.5))

    def share(pattern):
        return F.least(F.lit(1.0), F.sqrt(F.regexp_count(text, F.lit(pattern)) / size))

    return F.array(
        share(SYMBOL_RUN), share(CAPITAL_RUN), F.log(fresh / size) + 0.12 * F.log(size + 1)
    )


def described(documents, *others):
    """``others`` of ``documents`` with n_tokens, buckets and stats of the text; null as empty.

    Columns in steps: compiled code makes each once, a lambda around them would be interpreted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = documents.select(*others, text.alias("_text"), words_of(text).alias("_words"))
    own = [c for c in words.columns if c not in ("_text", "_words")]
    return words.withColumn("_distinct", F.array_distinct("_words")).select(
        *own,
        F.size("_words").cast("bigint").alias("n_tokens"),
        buckets_of(F.col("_distinct")).alias("buckets"),
        statistics_of(F.col("_text"), F.col("_words"), F.col("_distinct")).alias("stats"),
    )


def constant(values, kind):
    """An array of numbers as one literal; Spark parses it once, while it plans."""
    return F.split(F.lit(",".join(f"{v:.9g}" for v in values)), ",").cast(f"array<{kind}>")


def with_inputs(texts, odds):
    """``texts`` with the discriminant's inputs ``x`` instead of buckets and stats: clipped log
    odds of the words against domain 0, statistics.

    Only buckets with odds are looked up; a text has few of them.
    """
    others = [c for c in texts.columns if c not in ("buckets", "stats")]
    telling = np.flatnonzero((odds != 0).any(axis=0))
    if not len(telling):
        return texts.select(*others, F.concat(F.array(*[F.lit(0.0) for _ in odds]), "stats").alias("x"))
    names = constant(telling, "bigint")
    found = texts.select(*others, "stats", F.array_intersect("buckets", names).alias("_found"))

    def odd(table):
        values = constant(table[telling], "double")

        def add(total, bucket):
            place = (F.array_position(names, bucket) - 1).cast("int")
            return total + F.get(values, place)

        total = F.aggregate("_found", F.lit(0.0), add)
        return F.greatest(F.lit(-MOST_ODDS), F.least(F.lit(MOST_ODDS), total))

    return found.select(*others, F.concat(F.array(*[odd(table) for table in odds]), "stats").alias("x"))


def fit_domains(documents, labelled, domains, most=MOST_LABELS):
    """(odds, slopes, offsets) of the classifier, from at most ``most`` texts of each domain.

    ``labelled`` has (doc_id, domain); rows of other domains are ignored, a repeated doc_id
    counts once for each of its domains. Texts are chosen by hash of the id and used as a
    whole. The model's size depends on BUCKETS and domains only.
    """
    known = labelled.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
    known = known.select("doc_id", "domain").distinct()
    known = materialize(known.join(documents.select("doc_id"), "doc_id", "left_semi"), "labelled")
    found = {row["domain"]: row["count"] for row in known.groupBy("domain").count().collect()}
    sizes = np.array([found.get(domain, 0) for domain in domains], float)
    chosen = None
    for domain in domains:
        part = known.filter(F.col("domain") == domain).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most ``most`` rows of each domain
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = materialize(described(texts, "domain"), "labelled")
    known_sizes, total_known = sizes, sizes.sum()
    sizes = np.minimum(sizes, most)
    counts = np.zeros((len(domains), BUCKETS))
    found = texts.select("domain", F.explode(F.array_distinct("buckets")).alias("bucket")).groupBy("domain", "bucket")
    for row in found.count().collect():  # at most domains x BUCKETS
        counts[domains.index(row["domain"]), row["bucket"]] = row["count"]
    total = sizes.sum()
    expected = sizes[:, None] * (counts.sum(axis=0) + 0.5) / (total + 1)
    ratios = np.log((counts + PRIOR) / (expected + PRIOR))
    telling = np.abs(counts - expected) >= LEAST_SPREAD * np.sqrt(expected + 1)
    ratios[:, ~(telling & (np.abs(ratios) >= LEAST_LIFT)).any(axis=0)] = 0
    odds = ratios[1:] - ratios[0]
    width = len(odds) + STATISTICS
    x = [F.col("x")[i] for i in range(width)]
    rows = with_inputs(texts.drop("n_tokens"), odds)
    sums = rows.groupBy("domain").agg(
        F.count("*").cast("double"),
        *[F.sum(x[i]) for i in range(width)],
        *[F.sum(x[i] * x[j]) for i in range(width) for j in range(width)],
    )
    centre, spread = np.zeros((len(domains), width)), np.zeros((width, width))
    for row in sums.collect():
        at, values = domains.index(row["domain"]), np.array(row[1:], float)
        n, values = values[0], values[1:]
        centre[at] = values[:width] / n
        spread += values[width:].reshape(width, width) - n * np.outer(centre[at], centre[at])
    inverse = np.linalg.pinv(spread / max(total, 1) + 1e-6 * np.eye(width))
    slopes = centre @ inverse
    priors = np.log((known_sizes + 0.5) / (total_known + 0.5 * len(domains)))
    return odds, slopes, priors - 0.5 * (slopes * centre).sum(axis=1)


def with_chances(documents, model):
    """``n_tokens`` and ``chances`` (one for each domain, summing to 1) instead of ``text``."""
    odds, slopes, offsets = model
    others = [c for c in documents.columns if c not in ("text", "n_tokens", "chances")]

    def scores(x):
        return F.array(
            *[
                F.lit(float(offset)) + sum(x[i] * float(s) for i, s in enumerate(slope))
                for slope, offset in zip(slopes, offsets, strict=True)
            ]
        )

    def shares(parts):
        return bound(
            F.aggregate(parts, F.lit(0.0), lambda s, c: s + c),
            lambda total: F.transform(parts, lambda c: c / total),
        )

    def chances(values):
        raised = bound(
            F.array_max(values), lambda top: F.transform(values, lambda s: F.exp(s - top))
        )
        return bound(raised, shares)

    texts = with_inputs(described(documents, F.struct(*others).alias("others")), odds)
    return texts.select("others.*", "n_tokens", bound(scores(F.col("x")), chances).alias("chances"))


def projected(chances, gradients):
    """The rate after gradients that sum up to ``gradients``: 1 less their share, cut off at 0."""
    moved = sum(chances[i] * float(g) for i, g in enumerate(gradients))
    return F.greatest(F.lit(0.0), 1.0 - moved)


def fit_gradients(scored, weights, tolerance=TOLERANCE):
    """(gradients, passes, left): summed gradients, passes over the rows, distance by domain.

    Minimises the squared distance of the domains' tokens from ``weights``, in the metric of the
    documents' second moments, plus a pull times the squared distance of the rates from 1, which
    makes the rates unique; the last of PULLS counts, the stronger ones lead to it. Gradients are
    summed up first and projected then, so a rate is known from a document's chances and one
    number a domain, and a step is one aggregation. A step is the gradient in the metric of the
    documents whose rate is above 0, shortened until the summed objective falls. This ends,
    whatever the targets, with the gradient at 0.
    """
    size = len(weights)
    every = range(size)
    pairs = [(i, j) for i in every for j in every if i <= j]
    tokens, chances = F.col("n_tokens").cast("double"), [F.col("chances")[i] for i in every]

    def moments(values):
        out = np.zeros((size, size))
        for (i, j), value in zip(pairs, values, strict=True):
            out[i, j] = out[j, i] = value or 0.0
        return out

    first = [F.sum(tokens * chances[i] * chances[j]) for i, j in pairs]
    *products, total = scored.agg(*first, F.sum(tokens)).first()
    if not total:
        return np.zeros(size), 1, np.zeros(size)
    target = np.array(weights, float) / sum(weights)
    whole = moments(products) / total
    metric = whole + RIDGE * np.trace(whole) / size * np.eye(size)
    passes = 1

    def at(gradients):
        nonlocal passes
        passes += 1
        rate = projected(chances, gradients)
        rows = scored.select(
            tokens.alias("t"), rate.alias("r"), *[c.alias(f"c{i}") for i, c in enumerate(chances)]
        )
        weight, free = F.col("t") * F.col("r"), F.when(F.col("r") > 0, F.col("t"))
        sums = [F.sum(weight * F.col(f"c{i}")) for i in every] + [F.sum(weight * F.col("r"))]
        sums += [F.sum(free * F.col(f"c{i}") * F.col(f"c{j}")) for i, j in pairs]
        values = rows.agg(*sums).first()
        left = np.array(values[:size], float) / total - target
        value = values[size] / total / 2 + target @ gradients
        return left, value, moments(values[size + 1 :]) / total

    def objective(found, gradients, pull):
        return found[1] + pull / 2 * gradients @ metric @ gradients

    def shortened(gradients, found, slope, step, pull):
        value, length = objective(found, gradients, pull), 1.0
        while True:
            moved = gradients - length * step
            found = at(moved)
            # sums are exact to a few parts in 1e15 only
            least = value - 1e-4 * length * (slope @ step) + 1e-13 * abs(value)
            if objective(found, moved, pull) <= least or length < LEAST_LENGTH:
                return moved, found, length
            length /= 4

    gradients = np.zeros(size)
    found = at(gradients)
    for pull in PULLS:
        length = 1.0
        while length >= LEAST_LENGTH:
            slope = pull * metric @ gradients - found[0]
            if np.abs(slope).max() <= (tolerance if pull == PULLS[-1] else 10 * tolerance):
                break
            step = np.linalg.solve(found[2] + pull * metric, slope)
            gradients, found, length = shortened(gradients, found, slope, step, pull)
    return gradients, passes, found[0]


def fit_rates(scored, weights, tolerance=TOLERANCE):
    """``scored`` with the ``rate`` that takes the domains' tokens to ``weights`` of all tokens.

    Targets out of reach are said in the log, with the distance that is left.
    """
    gradients, passes, left = fit_gradients(scored, weights, tolerance)
    if np.abs(left).max() > 100 * tolerance:
        LOG.warning("targets out of reach: %d passes, distance left %s", passes, np.round(left, 6).tolist())
    chances = [F.col("chances")[i] for i in range(len(weights))]
    return scored.withColumn("rate", projected(chances, gradients))


def mix(documents, labelled, targets):
    """Each row of ``documents``, without its text, with ``n_tokens``, ``chances``, ``rate``
    and ``copies``.

    ``targets`` maps domains to weights; ``chances`` are in its order. The rates are the
    nonnegative ones for which expected tokens come nearest to the targets. ``copies`` turns
    the rate into a whole number, rounded up or down by the hash of the doc_id. Null and empty
    texts have no tokens and the rate their chances give them. Without labels all chances are
    equal, without tokens all rates are 1. Repeated rows repeat. Further columns are handed
    through; those named like an added one are replaced.
    """
    domains = list(targets)
    documents = documents.drop("rate", "copies")
    model = fit_domains(documents, labelled, domains)
    scored = materialize(with_chances(documents, model), "chances")
    rated = fit_rates(scored, [targets[d] for d in domains])
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    return rated.withColumn("copies", F.floor(F.col("rate") + share))


def quality_domains(labels):
    """(doc_id, domain) of the labels table: quality and toxicity together."""
    quality = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    toxic = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    named = labels.select("doc_id", quality.alias("q"), toxic.alias("t")).dropna(subset=["q", "t"])
    return named.select("doc_id", F.concat_ws("_", "q", "t").alias("domain"))
