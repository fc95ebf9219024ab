"""Benchmark decontamination with one Aho-Corasick automaton over word windows.

Texts are normalised byte by byte (A-Z lower-cased, other ASCII but digits and letters
blanked), so a byte offset means the same place in the normalised and the original text. The
automaton reads numbers of words, written as DIGITS characters each: a node looks through its
edges one by one, so a node for every word that may come next would be slow, and characters of
the words themselves would make twice the nodes.
"""

import uuid
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadloom.llm.common import ALNUM, arrow_schema, encoded, map_rows, rows_of, unused
from threadloom.session import materialize

WINDOW = 10
# Benchmark text of one automaton, about 200 bytes a character. A larger benchmark is cut into
# blocks by item, each broadcast and matched on its own, so what a worker holds never outgrows this.
BLOCK_CHARS = 4_000_000
DIGITS, BASE = 3, 128  # each digit has characters of its own, so words are found whole
MOST_WORDS = BASE**DIGITS - 1  # one automaton more beyond these
UNKNOWN = "\0" * DIGITS

FIELDS = "n_words bigint, spans array<struct<start:int,end:int>>, words array<int>, items array<string>"


def words_of(raw):
    return raw.translate(ALNUM).split()


def windows_of(words, size=WINDOW):
    """Windows of ``size`` words; fewer words, but not none, are one window."""
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def _digits(number):
    return "".join([chr(1 + BASE * i + number // BASE**i % BASE) for i in range(DIGITS)])


class Matcher:
    """All windows of (item, text) pairs in an automaton over words, each written as the digits
    of its number; a word that no item has is UNKNOWN."""

    def __init__(self, items, size=WINDOW, most=MOST_WORDS):
        self.owners = []  # (words of a window, its items): one for an item's own windows
        self.parts = []  # (digits of each word, automaton)
        shared = set()  # places of windows that several items have, each its own
        for item, text in items:
            mine = -1
            for window in windows_of(words_of((text or "").encode()), size):
                if not self.parts or len(self.parts[-1][0]) + len(window) > most:
                    self.parts.append(({}, ahocorasick.Automaton(ahocorasick.STORE_INTS)))
                digits, automaton = self.parts[-1]
                for word in window:
                    if word not in digits:
                        digits[word] = _digits(len(digits))
                key = "".join([digits[word] for word in window])
                place = automaton.get(key, -1)
                if place < 0:
                    if mine < 0:
                        mine = self._place(len(window), {item})
                    automaton.add_word(key, mine)
                elif place in shared:
                    self.owners[place][1].add(item)
                elif item not in self.owners[place][1]:
                    both = self._place(len(window), self.owners[place][1] | {item})
                    shared.add(both)
                    automaton.add_word(key, both)
        for _, automaton in self.parts:
            automaton.make_automaton()

    def _place(self, size, items):
        self.owners.append((size, items))
        return len(self.owners) - 1

    def match(self, raw):
        """(number of words, numbers of hit words, items) of a text."""
        words = words_of(raw)
        found = []
        for digits, automaton in self.parts:
            found += automaton.iter("".join(map(digits.get, words, repeat(UNKNOWN))))
        if not found:
            return len(words), np.zeros(0, np.int64), set()
        edge = np.zeros(len(words) + 1, np.int64)
        items = set()
        for last, place in found:
            size, own = self.owners[place]
            stop = (last + 1) // DIGITS
            edge[stop - size] += 1
            edge[stop] -= 1
            items |= own
        return len(words), np.flatnonzero(np.cumsum(edge[:-1]) > 0), items


_HELD = {}


def _matcher(name, block, size):
    """The Matcher of the broadcast ``block``, built once in each Python worker. Only the latest
    is held."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Matcher(block.value, size)
    return _HELD[name]


def word_spans(raw, numbers):
    """Character offsets in the original text of each run of the numbered words."""
    if not len(numbers):
        return []
    solid = np.frombuffer(raw.translate(ALNUM), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    runs = np.split(numbers, np.flatnonzero(np.diff(numbers) > 1) + 1)
    # characters before a byte: bytes that do not continue a character
    before = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[starts[r[0]]]), int(before[ends[r[-1]]])) for r in runs]


def _blocks(benchmark):
    """Items on the driver, block by block: (item, text) pairs of about BLOCK_CHARS."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text"
    ).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_CHARS))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        yield [(row["item"], row["text"]) for row in part.collect()], block == blocks - 1


def _matched(rows, block, size):
    """``rows`` (doc_id, text[, words, items of earlier blocks]) with FIELDS added or renewed."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    schema = StructType(rows.select("doc_id", "text").schema.fields + StructType.fromDDL(FIELDS).fields)
    arrow, name = arrow_schema(schema), uuid.uuid4().hex

    def run(batches):
        matcher = _matcher(name, shared, size)
        for batch in rows_of(batches):
            raws = encoded(batch.column("text"))
            found = [matcher.match(raw) for raw in raws]
            if "words" in batch.schema.names:
                earlier = zip(
                    batch.column("words").to_pylist(), batch.column("items").to_pylist(), strict=True
                )
                found = [
                    (n, np.union1d(hit, np.array(w, np.int64)), own | set(i))
                    for (n, hit, own), (w, i) in zip(found, earlier, strict=True)
                ]
            spans = [
                [{"start": a, "end": b} for a, b in word_spans(raw, hit)]
                for raw, (_, hit, _) in zip(raws, found, strict=True)
            ]
            values = (
                [f[0] for f in found],
                spans,
                [f[1] for f in found],
                [sorted(f[2]) for f in found],
            )
            new = [
                pa.array(v, type=field.type)
                for v, field in zip(values, list(arrow)[2:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), *new], schema=arrow
            )

    return rows.mapInArrow(run, schema)


def match_benchmark(documents, benchmark, size=WINDOW):
    """(doc_id, text, n_words, spans, words, items) for each row of ``documents``.

    ``spans`` are character ranges of the original text whose words are hit, ``words`` the
    numbers of those words, ``items`` the sorted ids of items with a window in the text. A null
    or empty text has no words; a null benchmark text has no windows; an item without an id
    counts as the item ''. Repeated rows repeat in the result, repeated items count once.
    Further columns are ignored, whatever their names. A benchmark of several blocks passes
    over the texts once for each block; the result in between is stored.
    """
    rows = documents.select("doc_id", "text")
    for block, last in _blocks(benchmark):
        rows = _matched(rows, block, size)
        if not last:
            rows = materialize(rows, "decontaminate")
    return rows


def mark_rows(documents, benchmark, name, size=WINDOW):
    """Every row of ``documents`` with the number of words it shares with benchmark windows as
    ``name``; summed over the blocks of a large benchmark. A null or empty text shares none,
    repeated rows repeat, very long texts are read whole. Other columns are handed through."""
    rows = documents.withColumn(name, F.lit(0).cast("bigint"))
    part = unused(rows, "_part")
    for block, last in _blocks(benchmark):
        shared = rows.sparkSession.sparkContext.broadcast(block)
        built = uuid.uuid4().hex

        def count(columns, shared=shared, built=built):
            matcher = _matcher(built, shared, size)
            return [[len(matcher.match(raw)[1]) for raw in encoded(columns["text"])]]

        rows = map_rows(rows, count, f"{part} bigint")
        rows = rows.withColumn(name, F.col(name) + F.col(part)).drop(part)
        if not last:
            rows = materialize(rows, "decontaminate")
    return rows


def item_digest(items):
    """Lowercase hex SHA-256 of the sorted ids, comma-joined."""
    return F.sha2(F.concat_ws(",", items).cast("binary"), 256)
