"""Fill-in-middle: documents cut at token boundaries that a learned rank index finds.

A document's boundary offsets rise with their rank. Straight pieces are fitted to them, none of
which is off by more than a bound; what is left of each boundary is one small stored number. A
cut at a rank is predicted by its piece and put right by the stored rest, so it is exact. Which
ranks are cut, and in which order the parts are written, follows from a hash of the document id.
"""

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm.common import map_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MOST_OFF = 127  # characters a piece may be off: what is left fits a byte
WINDOW = 512  # boundaries a piece is tried on first
SEED = 1
PLAIN_FROM, SUFFIX_FIRST = 90, 20  # percent


def boundaries(text):
    """Offsets 0, then the end of each token of ``[A-Za-z]+|[^A-Za-z]``, in code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes | 0x20
    letter = (low >= ord("a")) & (low <= ord("z")) & (codes < 128)
    if not len(codes):
        return np.zeros(1, np.int64)
    inside = letter[:-1] & letter[1:]
    return np.concatenate([[0], np.flatnonzero(~inside) + 1, [len(codes)]])


class RankIndex:
    """Offsets by rank: straight pieces and what they leave."""

    def __init__(self, offsets, most_off=MOST_OFF):
        starts, slopes, start, last = [0], [], 0, len(offsets) - 1
        while start < last:
            end, slope = _piece(offsets, start, most_off)
            slopes.append(slope)
            starts.append(end)
            start = end
        self.starts = np.array(starts[:-1] or [0])
        self.slopes = np.array(slopes or [0.0])
        self.bases = offsets[self.starts]
        kind = np.int8 if most_off < 128 else np.int64
        self.rest = (offsets - self.predicted(np.arange(len(offsets)))).astype(kind)

    def predicted(self, ranks):
        piece = np.searchsorted(self.starts, ranks, side="right") - 1
        steps = (ranks - self.starts[piece]) * self.slopes[piece]
        return self.bases[piece] + np.rint(steps).astype(np.int64)

    def offsets(self, ranks):
        """The exact offsets of ``ranks``."""
        ranks = np.asarray(ranks)
        return self.predicted(ranks) + self.rest[ranks]


def _piece(offsets, start, most_off):
    """(end, slope) of the longest straight piece from ``start``.

    The slopes that keep all boundaries so far within ``most_off`` form an interval, which
    narrows with each; the piece ends before the boundary that empties it. Half a character is
    kept for rounding.
    """
    width, off = WINDOW, most_off - 0.5
    while True:
        rise = offsets[start + 1 : start + 1 + width] - offsets[start]
        steps = np.arange(1, len(rise) + 1)
        low = np.maximum.accumulate((rise - off) / steps)
        high = np.minimum.accumulate((rise + off) / steps)
        empty = low > high
        fits = int(empty.argmax()) if empty.any() else len(rise)
        if fits < len(rise) or start + 1 + width >= len(offsets):
            return start + fits, (low[fits - 1] + high[fits - 1]) / 2
        width *= 2


def draws(doc_id, seed=SEED):
    """The first four 8-digit groups of the SHA-256 of ``seed:doc_id`` as numbers."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(name, 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(documents, seed=SEED, plain_from=PLAIN_FROM, suffix_first=SUFFIX_FIRST, most_off=MOST_OFF):
    """``documents`` with ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` (code
    points) and ``output``.

    Two draws of the id give the ranks at which prefix and middle end. ``form`` is ``plain``
    (the text as it is; the counts are null) for empty texts, texts that hold a mark, and ids
    whose third draw modulo 100 is ``plain_from`` or more; else ``spm`` (suffix first) if the
    fourth draw modulo 100 is below ``suffix_first``, else ``psm``. A null text is an empty one,
    a null id is drawn as an empty one. Texts are handled whole, however long; equal ids are cut
    at the same ranks; repeated rows repeat. Other columns stay, those named like an added one
    are replaced.
    """
    added = {"n", "form", "prefix_chars", "middle_chars", "output"}
    kept = [c for c in documents.columns if c.lower() not in added]
    text, first = "_fim_text", "_fim_draws"
    drawn = F.array(*draws(F.col("doc_id"), seed))
    rows = documents.select(*kept, F.coalesce("text", F.lit("")).alias(text), drawn.alias(first))

    def cut(columns):
        out = []
        for whole, (h1, h2, h3, h4) in zip(
            columns[text].to_pylist(), columns[first].to_pylist(), strict=True
        ):
            ends = boundaries(whole)
            n = len(ends) - 1
            marked = PREFIX in whole or SUFFIX in whole or MIDDLE in whole
            if not whole or marked or h3 % 100 >= plain_from:
                out.append((n, "plain", None, None, whole))
                continue
            ranks = sorted((h1 % (n + 1), h2 % (n + 1)))
            start, end = RankIndex(ends, most_off).offsets(ranks).tolist()
            form = "spm" if h4 % 100 < suffix_first else "psm"
            parts = whole[:start], whole[start:end], whole[end:]
            out.append((n, form, start, end - start, written(form, *parts)))
        return list(zip(*out, strict=True))

    schema = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return map_rows(rows, cut, schema).drop(text, first)


def written(form, prefix, middle, suffix):
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output, form):
    """The text, rebuilt from ``output`` and ``form`` (columns).

    Parts hold no mark, and no mark can begin in a part and end in the next one, so the first
    place of each mark is the one that was written.
    """

    def parts(head, second):
        body = F.substr(output, F.lit(len(head) + 1))
        first = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(first) + len(second) + 1)
        following = F.substring_index(rest, MIDDLE, 1)
        middle = F.substr(rest, F.length(following) + len(MIDDLE) + 1)
        return first, following, middle

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
