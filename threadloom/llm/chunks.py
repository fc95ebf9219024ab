"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; where it has CUT_BITS zero bits at the start of a
word, a chunk ends. Where no blank is near, as in scripts written without them, the starts of
characters beyond ASCII take the place of word starts, and two such characters count as a word. A cut depends on the last WINDOW bytes only, so a shared passage is cut
alike in every document soon after its start, whatever stands before it. Compared are chains of
consecutive chunks, by digest: from each chunk on, and back from each chunk, the shortest chain of
LEAST_WORDS words. A chain that also occurs in a document with a smaller id is a copy, and copies
are removed; the smallest document keeps the passage. Any run of chunks with LEAST_WORDS words that
one earlier document holds in the same order is covered by such chains.
"""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from threadloom.llm.common import encoded, map_rows, unused
from threadloom.session import materialize

WINDOW = 16  # bytes the gear hash reaches back
CUT_SHIFT, CUT_MASK = 13, 3  # bits of the hash that must be zero: one word start in four
LEAST_BYTES, MOST_BYTES = 12, 256
NEAR_BYTES = 48  # the last blank is farther away: text without blanks
DENSE_MASK = 7  # one character in eight there
DENSE_WORD = 2  # characters there that count as a word
LEAST_WORDS = 20  # of a run that is removed; passages lose up to a chunk at either end

NO_ID = -(1 << 63)
TAG_BITS = 16  # of a chain's place: number of a chunk, tag of the text, whether it is the first
CHAIN = np.uint64(0x9E3779B97F4A7C13)  # odd, 3 modulo 4
BACK = np.uint64(pow(int(CHAIN), -1, 1 << 64))

GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
BLANKS = bytes(32 if b in b" \t\n\v\f\r" else b for b in range(256))


def gear_hashes(data):
    """The gear hash after each byte: the sum of the last WINDOW bytes' numbers, each shifted
    left by its distance."""
    out = GEAR[data]
    reach = 1
    while reach < WINDOW:
        out[reach:] += out[:-reach] << np.uint32(reach)
        reach *= 2
    return out


def chunk_ends(raw):
    """(ends of the chunks, words in each) of a text in bytes."""
    if not raw:
        return [], []
    blank = raw.translate(BLANKS)
    data = np.frombuffer(blank, np.uint8)
    space = data == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1  # of words, but one at 0
    hashes = gear_hashes(data)
    cuts = starts[(hashes[starts - 1] >> np.uint32(CUT_SHIFT)) & np.uint32(CUT_MASK) == 0]
    dense = dense_starts(data, space)
    if len(dense):
        more = dense[(hashes[dense - 1] >> np.uint32(CUT_SHIFT)) & np.uint32(DENSE_MASK) == 0]
        cuts = np.union1d(cuts, more)
    ends, last = [], 0
    for cut in [*cuts.tolist(), len(raw)]:
        while cut - last > MOST_BYTES:
            last = _forced(raw, starts, last)
            ends.append(last)
        if cut - last >= LEAST_BYTES or cut == len(raw) and cut > last:
            ends.append(cut)
            last = cut
    heads = np.concatenate(([0], starts)) if not space[0] else starts
    words = np.diff(np.concatenate(([0], np.searchsorted(heads, ends, side="left"))))
    if len(dense):
        words += np.diff(np.concatenate(([0], np.searchsorted(dense, ends, side="left")))) // DENSE_WORD
    return ends, words.tolist()


def dense_starts(data, space):
    """Starts of characters beyond ASCII whose last blank is more than NEAR_BYTES before."""
    blanks = np.flatnonzero(space)
    gaps = np.diff(np.concatenate(([-1], blanks, [len(data)])))
    if gaps.max() <= NEAR_BYTES:
        return blanks[:0]
    starts = np.flatnonzero(data >= 0xC0)
    last = np.concatenate(([-1], blanks))[np.searchsorted(blanks, starts)]
    return starts[starts - last > NEAR_BYTES]


def _forced(raw, starts, last):
    """The last word start within MOST_BYTES, else the last start of a character."""
    place = int(np.searchsorted(starts, last + MOST_BYTES, side="right")) - 1
    if place >= 0 and starts[place] > last:
        return int(starts[place])
    end = last + MOST_BYTES
    while end > last + 1 and raw[end] & 0xC0 == 0x80:
        end -= 1
    return end


def chunk_digests(raw):
    """(digests, words) of a text's chunks; whitespace at a chunk's end does not count."""
    ends, words = chunk_ends(raw)
    blank = raw.translate(BLANKS)
    digests = [
        xxhash.xxh3_64_intdigest(blank[a:b].rstrip()) for a, b in zip([0, *ends], ends, strict=False)
    ]
    return np.array(digests, np.uint64).view(np.int64), words


def text_tag(raw):
    return xxhash.xxh32_intdigest(raw) & ((1 << TAG_BITS) - 1)


def chains_of(words, least=LEAST_WORDS):
    """(first, last, forward) of the chains of chunks with these numbers of words.

    Forward ones are the shortest with ``least`` words from a chunk on, the others the shortest
    that end with a chunk, unless they are among the forward ones.
    """
    sums = np.concatenate(([0], np.cumsum(np.array(words, np.int64))))
    number = np.arange(len(words))
    last = np.searchsorted(sums, sums[:-1] + least, side="left") - 1
    first = np.searchsorted(sums, sums[1:] - least, side="right") - 1
    ahead = last < len(words)
    back = first >= 0
    back[back] = last[first[back]] != number[back]
    forward = np.repeat([True, False], [ahead.sum(), back.sum()])
    return (
        np.concatenate((number[ahead], first[back])),
        np.concatenate((last[ahead], number[back])),
        forward,
    )


def chain_digests(digests, first, last):
    """A digest of each chain: a polynomial over the digests of its chunks, modulo 2^64."""
    own = digests.view(np.uint64)
    powers = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(own), CHAIN, np.uint64))))
    inverse = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(own), BACK, np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * powers[:-1], dtype=np.uint64)))
    return ((sums[last + 1] - sums[first]) * inverse[first]).view(np.int64)


def chain_table(documents):
    """(digest, doc, place) of each chain; ``place`` holds the number of its first chunk, or of
    its last if it is not a forward one, and the text's tag.

    Texts are cut once: their chains are stored, a row for each text, and read from there.
    """

    def cut(columns):
        tags, digests, numbers = [], [], []
        for raw in encoded(columns["text"]):
            own, words = chunk_digests(raw)
            first, last, forward = chains_of(words)
            tags.append(text_tag(raw))
            digests.append(chain_digests(own, first, last))
            numbers.append((np.where(forward, first, last).astype(np.int32) << 1) | forward)
        return tags, digests, numbers

    rows = documents.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), "text"
    )
    added = "tag int, digests array<bigint>, numbers array<int>"
    stored = materialize(map_rows(rows, cut, added, without=["text"]), "chains")
    chains = stored.select("doc", "tag", F.explode(F.arrays_zip("digests", "numbers")).alias("c"))
    number = F.col("c.numbers").cast("bigint")
    place = F.shiftleft(F.shiftright(number, 1), TAG_BITS + 1) + F.shiftleft("tag", 1) + number % 2
    return chains.select(F.col("c.digests").alias("digest"), "doc", place.alias("place"))


def copied_chains(chains):
    """The chains that also occur in a document with a smaller id: (doc, place).

    Digests are put together before the shuffle, so a hot one leaves a task as one row; the
    join is an inner one, whose hot digests adaptive execution splits.
    """
    shared = (
        chains.groupBy("digest")
        .agg(F.min("doc").alias("first"), F.count("*").alias("held"))
        .filter("held > 1")
        .select("digest", "first")
    )
    return chains.join(shared, "digest").filter("doc > first").select("doc", "place")


def runs_of(places, tag, words):
    """Runs (first chunk, last chunk) that the copied chains of a text cover."""
    places = np.array(places, np.int64)
    mine = places[(places >> 1) & ((1 << TAG_BITS) - 1) == tag]
    copied = set(zip((mine >> (TAG_BITS + 1)).tolist(), (mine & 1).tolist(), strict=True))
    edges = np.zeros(len(words) + 1, np.int64)
    for first, last, forward in zip(*map(np.ndarray.tolist, chains_of(words)), strict=True):
        if (first if forward else last, int(forward)) in copied:
            edges[first] += 1
            edges[last + 1] -= 1
    inside = np.concatenate(([0], (np.cumsum(edges) > 0).astype(np.int8)))
    turns = np.flatnonzero(np.diff(inside))
    return [(int(a), int(b) - 1) for a, b in zip(turns[::2], turns[1::2], strict=True)]


def without_runs(raw, places):
    """(rest of the text, removed byte ranges)."""
    if not places:
        return raw, []
    ends, words = chunk_ends(raw)
    runs = runs_of(places, text_tag(raw), words)
    if not runs:
        return raw, []
    ends = [0, *ends]
    ranges = [(ends[a], ends[b + 1]) for a, b in runs]
    kept, at = [], 0
    for start, end in ranges:
        kept.append(raw[at:start])
        at = end
    return b"".join(kept) + raw[at:], ranges


def dedupe_substrings(documents):
    """Every row of ``documents`` with shared passages cut out of ``text``.

    Added are ``removed_spans``, the removed character ranges of the given text in order, and
    ``removed_words``, counted by blanks. Rows with one doc_id count as one document, rows without an id as one
    that comes first; repeats inside one document stay. A null text stays null, a text that is
    all copies becomes empty. Other columns are handed through; if ``removed_spans`` or
    ``removed_words`` is among them, it is replaced.
    """
    documents = documents.drop("removed_spans", "removed_words")
    copies = (
        copied_chains(chain_table(documents))
        .groupBy("doc")
        .agg(F.collect_list("place").alias("places"))  # bounded by the length of the document
    )
    key, places = unused(documents, "_doc"), unused(documents, "_places")
    keyed = documents.withColumn(key, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)))
    joined = keyed.join(copies.select(F.col("doc").alias(key), F.col("places").alias(places)), key, "left")
    order = documents.columns
    texts = unused(documents, "_rest")

    def cut(columns):
        rest, spans, words = [], [], []
        known = columns[places].to_pylist()
        for text, raw, own in zip(columns["text"], encoded(columns["text"]), known, strict=True):
            left, ranges = without_runs(raw, own)
            rest.append(text.as_py() if not ranges else left.decode("utf-8", "surrogatepass"))
            before = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))) if ranges else []
            spans.append([{"start": int(before[a]), "end": int(before[b])} for a, b in ranges])
            words.append(sum(len(raw[a:b].split()) for a, b in ranges))
        return rest, spans, words

    cut_rows = map_rows(
        joined, cut, f"{texts} string, removed_spans array<struct<start:int,end:int>>, removed_words bigint"
    )
    columns = [F.col(texts).alias("text") if c == "text" else F.col(c) for c in order]
    return cut_rows.select(*columns, "removed_spans", "removed_words")
