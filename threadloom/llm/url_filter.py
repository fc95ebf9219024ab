"""URL filter: glob rules packed into multiword Shift-And masks.

Every rule is a glob over the canonical URL ``.host/path``: ``?`` stands for one character but
``/``, ``*`` for any run of characters but ``/``, ``**`` for any run at all. All globs advance
together, one bit per position of a glob, over all URLs of a batch at once.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm.common import UPPER, LOWER, map_rows

SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url):
    """Host (A-Z lower-cased) and path of a URL column; both empty for null or without ://."""
    host = F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)
    return host, F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def host_rule_glob(rule):
    """The glob of a rule ``host/path``: the host, all subdomains, paths that start so."""
    return f"*.{rule}**"


def parse_glob(glob):
    """(start gap, [(character or None for ?, gap after it)]); a gap is 0, 1 (*) or 2 (**)."""
    start, tokens, i = 0, [], 0
    while i < len(glob):
        if glob[i] == "*":
            gap = 2 if glob[i : i + 2] == "**" else 1
            i += gap
            if tokens:
                tokens[-1] = (tokens[-1][0], max(tokens[-1][1], gap))
            else:
                start = max(start, gap)
            continue
        tokens.append((None if glob[i] == "?" else glob[i], 0))
        i += 1
    return start, tokens


@dataclass
class Automaton:
    """Shift-And masks of all globs; class 0 is any character in no glob, class 1 is ``/``."""

    classes: dict
    step: np.ndarray  # (class, word): positions reached by reading the class
    stay: np.ndarray  # (class, word): positions kept while reading the class
    first: np.ndarray  # (word): positions held before any character
    last: list  # the final bit of each glob

    @classmethod
    def of(cls, globs):
        parsed = [parse_glob(glob) for glob in globs]
        symbols = sorted({c for _, tokens in parsed for c, _ in tokens if c not in (None, "/")})
        classes = {"/": 1} | {c: i + 2 for i, c in enumerate(symbols)}
        bits = sum(len(tokens) + 1 for _, tokens in parsed)
        words = -(-bits // 64) or 1
        step = np.zeros((len(classes) + 1, words), np.uint64)
        stay, first, last, bit = np.zeros_like(step), np.zeros(words, np.uint64), [], 0

        def mark(table, kinds):
            table[kinds, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

        every = np.arange(len(classes) + 1)
        no_slash = every[every != 1]
        gaps = (every[:0], no_slash, every)
        for start, tokens in parsed:
            first[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
            mark(stay, gaps[start])
            for symbol, gap in tokens:
                bit += 1
                mark(step, no_slash if symbol is None else [classes[symbol]])
                mark(stay, gaps[gap])
            last.append(bit)
            bit += 1
        return cls(classes, step, stay, first, last)

    def matches(self, urls):
        """(url, glob) booleans for a list of strings, read whole.

        URLs are taken longest first, so those that have ended drop off the end.
        """
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        flat = np.frombuffer(
            "".join(urls[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32
        )
        kinds = np.zeros(len(flat), np.int64)
        for symbol, kind in self.classes.items():
            kinds[flat == ord(symbol)] = kind
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
        state = np.tile(self.first, (len(urls), 1))
        top, one = np.uint64(63), np.uint64(1)
        active, longest = len(urls), int(sizes[0]) if len(sizes) else 0
        for at in range(longest):
            while active and sizes[active - 1] <= at:
                active -= 1
            kind = kinds[starts[:active] + at]
            now = state[:active]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:active] = (moved & self.step[kind]) | (now & self.stay[kind])
        out = np.zeros((len(urls), len(self.last)), bool)
        for i, bit in enumerate(self.last):
            out[order, i] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one
        return out


def filter_urls(frame, rules, globs, default="allow"):
    """(page_id, host, path, rule, verdict) for each row of (page_id, url).

    ``rules`` maps ``host/path`` rules to a verdict, the longest that fits wins. Where none
    fits, ``globs`` decide: any matching ``block`` glob blocks, else any ``allow`` glob allows,
    else ``default``. A null or broken URL has an empty host and path and fits no rule. Ties
    between rules of one length go to the alphabetically first. Rows repeat as they come;
    further columns of ``frame`` are ignored, whatever their names.
    """
    ordered = sorted(rules, key=lambda rule: (-len(rule), rule))
    texts = [host_rule_glob(rule) for rule in ordered] + list(globs)
    verdicts = [rules[rule] for rule in ordered]
    kinds = np.array(list(globs.values()), dtype=object)
    built = []

    def judge(columns):
        if not built:
            built.append(Automaton.of(texts))
        urls = [f".{h}{p}" for h, p in zip(columns["host"].to_pylist(), columns["path"].to_pylist(), strict=True)]
        hit = built[0].matches(urls)
        fits, method = hit[:, : len(ordered)], hit[:, len(ordered) :]
        best = np.where(fits.any(axis=1), fits.argmax(axis=1) if ordered else 0, -1)
        rule = [ordered[i] if i >= 0 else None for i in best]
        blocked = method[:, kinds == "block"].any(axis=1)
        allowed = method[:, kinds == "allow"].any(axis=1)
        other = np.where(blocked, "block", np.where(allowed, "allow", default))
        return rule, [verdicts[i] if i >= 0 else str(o) for i, o in zip(best, other, strict=True)]

    host, path = host_and_path(F.col("url"))
    slim = frame.select("page_id", host.alias("host"), path.alias("path"))
    return map_rows(slim, judge, "rule string, verdict string")
