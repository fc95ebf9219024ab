"""Statistics of one text, from its bytes and whitespace-separated words."""

from collections import defaultdict
from itertools import count

import numpy as np

SYMBOLS = b"#*$%&|<>"

# classes of bytes that are counted
LOWER, UPPER, DIGIT, SPACE, SYMBOL, PUNCT, START, CONTINUED = range(8)


def _classes():
    out = np.full(256, PUNCT, np.int64)
    out[97:123], out[65:91], out[48:58] = LOWER, UPPER, DIGIT
    out[list(b" \t\n\v\f\r")] = SPACE
    out[list(SYMBOLS)] = SYMBOL
    out[128:192], out[192:] = CONTINUED, START
    return out


CLASSES = _classes()


def repeated_words(ids):
    """Words inside 3-word windows that occur twice or more; ``ids`` number the words."""
    n = len(ids) - 2
    if n < 2:
        return 0
    kinds = int(ids.max()) + 1
    pairs = ids[:-1] * kinds + ids[1:]
    if kinds >= 2_000_000:  # the product of three would not fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * kinds + ids[2:]
    ordered = np.sort(keys)
    same = ordered[1:] == ordered[:-1]
    if not same.any():  # of most texts
        return 0
    order = np.argsort(keys, kind="stable")
    twin = np.zeros(n, bool)
    twin[1:] |= same
    twin[:-1] |= same
    at = order[twin]
    hit = np.zeros(n + 2, bool)
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def duplicate_lines(raw):
    """(lines with a word, those of them equal to an earlier line)."""
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines), len(lines) - len(set(lines))


def word_ids(words):
    """Each word's number in order of first occurrence, and the number of distinct words."""
    seen = defaultdict(count().__next__)
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words)), len(seen)


class Summary:
    """Counts of one text; a null text counts as empty."""

    __slots__ = ("counts", "distinct", "doubled", "dup_lines", "lines", "repeats", "words")

    def __init__(self, raw):
        bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        self.counts = np.bincount(CLASSES, bytes_of, 8).astype(np.int64)
        words = raw.split()
        ids, self.distinct = word_ids(words)
        self.words = len(words)
        self.repeats = repeated_words(ids)
        self.doubled = int((np.diff(ids) == 0).sum()) if len(ids) > 1 else 0
        self.lines, self.dup_lines = duplicate_lines(raw)

    @property
    def word_chars(self):
        return int(self.counts.sum() - self.counts[CONTINUED] - self.counts[SPACE])

    @property
    def symbols(self):
        return int(self.counts[SYMBOL])
