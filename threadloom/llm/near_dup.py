"""Near duplicates by an inverted join over signature coordinates.

A document's set of word shingles gets a MinHash signature of COORDINATES values. Documents are
posted under each (coordinate, value) pair, and two are compared if they agree in at least
``agree`` coordinates. Prefix merging: of two such documents, the COORDINATES - agree + 1 rarest
pairs of each share one, so only those are posted. Skip merging: equal sets are put together
first; each list is matched with its most central document, its hub, which links most members
of a family of copies. Members of a list in different components that remain are compared only
if their parity sketches leave room for a link: a bit of a sketch tells whether an odd number of
a set's shingles fall on it, so two sketches differ in at most as many bits as the sets differ
in shingles, and no link is lost. Every link is confirmed on full sets.
"""

from math import comb, log

import numpy as np
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.llm.common import LOWER, UPPER, encoded, map_rows, unused
from threadloom.session import materialize

SHINGLE_WORDS = 3
LEAST_PERCENT = 85
COORDINATES = 64
SKETCH_BITS = 1024
MISSED = 1e-6  # chance of a pair just similar enough to agree in too few coordinates

_RANDOM = np.random.default_rng(9)
FACTORS = _RANDOM.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
OFFSETS = _RANDOM.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
SPREAD = np.uint32(0x9E3779B1)
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def least_agreeing(percent=LEAST_PERCENT):
    """The most coordinates that a pair of this similarity misses with chance MISSED at most."""
    share, below = percent / 100, 0.0
    for agree in range(COORDINATES + 1):
        below += comb(COORDINATES, agree) * share**agree * (1 - share) ** (COORDINATES - agree)
        if below > MISSED:
            return agree
    return COORDINATES


def shingles_of(raw, size=SHINGLE_WORDS):
    """Sorted distinct 64-bit hashes of the word shingles of a text whose A-Z are lower case.

    Words are runs of bytes other than ASCII whitespace. Fewer words than ``size``, but not
    none, are one shingle.
    """
    words = raw.split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = len(words) - size + 1
    mixed = np.zeros(last, np.uint64)
    for i in range(size):
        mixed = (mixed ^ hashes[i : i + last]) * MIX[0]
        mixed ^= mixed >> np.uint64(29)
    mixed = np.sort(mixed * MIX[1])
    return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def signature_of(shingles):
    """The least value of each of COORDINATES random functions over the shingles, in 32 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for start in range(0, len(folded), 1024):
        part = FACTORS[:, None] * folded[start : start + 1024]
        part += OFFSETS[:, None]
        part ^= part >> np.uint32(16)
        part *= SPREAD
        np.minimum(least, part.min(axis=1), out=least)
    return least.view(np.int32)


def sketch_of(shingles):
    """SKETCH_BITS parities as 64-bit numbers: which of them an odd number of shingles set."""
    counts = np.bincount((shingles % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def lowered(texts):
    """Texts of an Arrow array as bytes, A-Z as lower case, null as empty."""
    return [raw.translate(LOWERED) for raw in encoded(texts)]


def tag_of(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sign(documents, size=SHINGLE_WORDS):
    """(doc_id, tag, n_shingles, set_hash, signature, sketch) for each row; ``tag`` is a hash
    of the text, a null text has no shingles."""

    def signed(columns):
        sets = [shingles_of(raw, size) for raw in lowered(columns["text"])]
        return (
            [len(s) for s in sets],
            [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
            [signature_of(s) for s in sets],
            [sketch_of(s) for s in sets],
        )

    rows = documents.select("doc_id", "text", tag_of(F.col("text")).alias("tag"))
    added = "n_shingles bigint, set_hash binary, signature array<int>, sketch array<bigint>"
    return map_rows(rows, signed, added, without=["text"])


def linked_sizes(a, b, percent):
    """Whether sets of these sizes can be similar enough."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def postings(classes, percent=LEAST_PERCENT):
    """(token, doc, n, weight): the rarest tokens of each class that some other class shares.

    Sets that can be similar to no other set are left out, and so are classes without enough
    tokens that others share. Of a document's tokens those held by no other come first in the
    order of rarity and need no list. ``weight`` is the number of places of all its tokens:
    central members of a family have the most.
    """
    agree = least_agreeing(percent)
    able = classes.filter(f"100 * n >= {percent} * (n + 1)")
    tokens = able.select("doc", "n", F.posexplode("signature").alias("coordinate", "value"))
    tokens = tokens.select(
        (F.shiftleft(F.col("coordinate").cast("bigint"), 32) + F.col("value")).alias("token"), "doc", "n"
    )
    held = tokens.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    own = Window.partitionBy("doc")  # COORDINATES rows at most
    ranked = (
        tokens.join(held, "token")
        .withColumn("rank", F.row_number().over(own.orderBy("held", "token")))
        .withColumn("tokens", F.count("*").over(own))
        .withColumn("weight", F.sum("held").over(own))
    )
    return ranked.filter(F.col("rank") <= F.col("tokens") - (agree - 1)).select(
        "token", "doc", "n", "weight"
    )


def hubs_of(lists):
    """(token, hub, hub_n) of each list with two members or more: the one with most weight."""
    heaviest = F.max(F.struct("weight", "doc", "n")).alias("top")
    tops = lists.groupBy("token").agg(heaviest, F.count("*").alias("members")).filter("members > 1")
    return tops.select("token", F.col("top.doc").alias("hub"), F.col("top.n").alias("hub_n"))


def hub_pairs(lists, hubs, percent=LEAST_PERCENT):
    """Distinct (a, b): a hub and a member of its lists that may be similar by size."""
    return (
        lists.join(hubs, "token")
        .filter("doc <> hub")
        .filter(linked_sizes("n", "hub_n", percent))
        .select(F.col("hub").alias("a"), F.col("doc").alias("b"))
        .distinct()
    )


def room_for_link(a_sketch, b_sketch, a_n, b_n, percent=LEAST_PERCENT):
    """Whether sets of these sketches and sizes can be similar enough: similar sets differ in
    (100 - percent) / (100 + percent) of their summed sizes at most."""
    words = SKETCH_BITS // 64
    apart = " + ".join(f"bit_count({a_sketch}[{i}] ^ {b_sketch}[{i}])" for i in range(words))
    return f"(100 + {percent}) * ({apart}) <= (100 - {percent}) * ({a_n} + {b_n})"


def size_band(n, percent):
    """Bands of set sizes: sets that can be similar enough are at most one band apart."""
    width = 1.001 * max(log(100 / percent), 1e-6)
    return F.floor(F.log(n) / F.lit(width))


def rest_pairs(lists, classes, percent=LEAST_PERCENT):
    """Distinct (a, b) of a list's members in different components that may still be linked.

    Of two such members one at least is a stray, outside the list's largest component. Strays
    are joined with the members whose size is a band apart at most, so a list costs its strays
    times its members, and no pair inside the largest component is formed.
    """
    spread = lists.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    )
    mixed = lists.join(spread.filter("low < high").select("token"), "token", "left_semi")
    mixed = mixed.join(classes.select("doc", "sketch"), "doc").withColumn("band", size_band(F.col("n"), percent))
    mixed = materialize(mixed.select("token", "doc", "n", "component", "sketch", "band"), "mixed")
    parts = mixed.groupBy("token", "component").agg(F.count("*").alias("members"))
    largest = parts.groupBy("token").agg(F.max(F.struct("members", "component"))["component"].alias("main"))
    strays = mixed.join(largest, "token").filter("component <> main").drop("main")
    near = F.explode(F.array(*[F.col("band") + step for step in (-1, 0, 1)]))
    strays = strays.withColumn("band", near)
    other = mixed.select(*[F.col(c).alias(c if c in ("token", "band") else f"other_{c}") for c in mixed.columns])
    return (
        strays.join(other, ["token", "band"])
        .filter("component <> other_component")
        .filter(linked_sizes("n", "other_n", percent))
        .filter(room_for_link("sketch", "other_sketch", "n", "other_n", percent))
        .select(F.least("doc", "other_doc").alias("a"), F.greatest("doc", "other_doc").alias("b"))
        .distinct()
    )


def agreeing(pairs, classes, percent=LEAST_PERCENT):
    """The pairs whose signatures agree in as many coordinates as similar sets would, and whose
    sketches leave room for a link."""
    held = classes.select("doc", "n", "signature", "sketch")
    first = held.select(*[F.col(c).alias("a" if c == "doc" else f"a_{c}") for c in held.columns])
    second = held.select(*[F.col(c).alias("b" if c == "doc" else f"b_{c}") for c in held.columns])
    both = pairs.join(first, "a").join(second, "b")
    equal = F.size(
        F.filter(F.zip_with("a_signature", "b_signature", lambda x, y: x == y), lambda same: same)
    )
    possible = both.filter(room_for_link("a_sketch", "b_sketch", "a_n", "b_n", percent))
    return possible.filter(equal >= least_agreeing(percent)).select("a", "b")


def compare(pairs, texts, size=SHINGLE_WORDS):
    """``pairs`` with ``inter`` and ``total`` of the full shingle sets."""

    def sets(columns):
        held = {}

        def cached(ids, raws):
            for key, raw in zip(ids.to_pylist(), raws, strict=True):
                if key not in held:
                    held[key] = shingles_of(raw, size)
                yield held[key]

        both = zip(
            cached(columns["a"], lowered(columns["ta"])), cached(columns["b"], lowered(columns["tb"])), strict=True
        )
        inter, total = [], []
        for x, y in both:
            same = len(np.intersect1d(x, y, assume_unique=True))
            inter.append(same)
            total.append(len(x) + len(y) - same)
        return inter, total

    both = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b"
    )
    return map_rows(both, sets, "inter bigint, total bigint", without=["ta", "tb"])


def linked(compared, percent=LEAST_PERCENT):
    return compared.filter(f"100 * inter >= {percent} * total").select("a", "b")


def components(edges):
    """(node, root) of each node of the undirected ``edges`` (a, b); the root is the smallest.

    Large-star and small-star steps in turn until nothing changes; each result is stored.
    """
    forward = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    stars, state = materialize(forward.distinct(), "stars"), None
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a")
        stars = materialize(
            small.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(least.select("a", F.col("low").alias("b")))
            .distinct(),
            "stars",
        )
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def with_components(lists, links):
    """``lists`` with the ``component`` of each document under ``links``."""
    roots = components(links).select(F.col("node").alias("doc"), "root")
    return lists.join(roots, "doc", "left").withColumn("component", F.coalesce("root", "doc")).drop("root")


def link_classes(classes, documents, percent=LEAST_PERCENT, size=SHINGLE_WORDS):
    """Confirmed links (a, b) between classes that keep all components whole.

    A pair of similar sets is either returned or inside a component of returned links.
    """
    lists = materialize(postings(classes, percent), "postings")
    wanted = classes.select("doc", "tag").join(lists.select("doc"), "doc", "left_semi")
    texts = documents.select(F.col("doc_id").alias("doc"), "text", tag_of(F.col("text")).alias("tag"))
    texts = texts.join(wanted, ["doc", "tag"], "left_semi")
    texts = materialize(texts.drop("tag"), "texts")
    first = agreeing(hub_pairs(lists, hubs_of(lists), percent), classes, percent)
    links = materialize(linked(compare(first, texts, size), percent), "links")
    rest = rest_pairs(with_components(lists, links), classes, percent)
    rest = materialize(agreeing(rest, classes, percent), "pairs")
    return links.union(materialize(linked(compare(rest, texts, size), percent), "links"))


def group_rows(documents, percent=LEAST_PERCENT, size=SHINGLE_WORDS):
    """As ``group_documents``, with ``tag``, a hash of the text that stands for the document."""
    signed = materialize(sign(documents, size), "signatures")
    known = signed.filter("doc_id is not null")
    first = Window.partitionBy("doc_id").orderBy("set_hash", "tag")
    known = known.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    known = materialize(known, "documents")
    full = known.filter("n_shingles > 0")
    smallest = full.groupBy("set_hash").agg(F.min("doc_id").alias("class"))
    classes = full.join(smallest.select(F.col("class").alias("doc_id")), "doc_id", "left_semi").select(
        F.col("doc_id").alias("doc"), "tag", F.col("n_shingles").alias("n"), "signature", "sketch"
    )
    classes = materialize(classes, "classes")
    roots = components(link_classes(classes, documents, percent, size))
    members = full.join(smallest, "set_hash").select("doc_id", "tag", "n_shingles", "class")
    placed = members.join(roots, members["class"] == roots["node"], "left").select(
        "doc_id", "tag", "n_shingles", F.coalesce("root", "class").alias("component_id")
    )
    own = F.col("doc_id").alias("component_id")
    alone = known.filter("n_shingles = 0").select("doc_id", "tag", "n_shingles", own)
    nameless = signed.filter("doc_id is null").select("doc_id", "tag", "n_shingles", own)
    every = placed.unionByName(alone).unionByName(nameless)
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def group_documents(documents, percent=LEAST_PERCENT, size=SHINGLE_WORDS):
    """(doc_id, n_shingles, component_id, kept) for each document.

    Documents whose shingle sets have 100 * intersection >= percent * union are linked;
    ``component_id`` is the smallest doc_id of all that are linked over any number of steps,
    and ``kept`` marks it. Null and empty texts are linked with nothing. Rows that repeat a
    doc_id are one document; if their texts differ, the one with the smallest set hash counts.
    Rows without an id come back once for each, linked with nothing, kept, component_id null.
    Further columns are ignored, whatever their names.
    """
    return group_rows(documents, percent, size).drop("tag")


def keep_one(documents, percent=80, size=5):
    """The rows of ``documents`` that stay when one of each group does, columns as they were.

    Of rows that repeat a doc_id one stays; rows without an id all stay.
    """
    tag = unused(documents, "_tag")
    kept = group_rows(documents, percent, size).filter("kept and doc_id is not null")
    kept = kept.select("doc_id", F.col("tag").alias(tag))
    tagged = documents.withColumn(tag, tag_of(F.col("text")))
    chosen = tagged.join(kept, ["doc_id", tag], "left_semi").dropDuplicates(["doc_id", tag])
    nameless = tagged.filter("doc_id is null")
    return chosen.unionByName(nameless).drop(tag)
