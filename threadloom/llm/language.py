"""Language ID by partial matching: code lengths under per-language byte context trees.

A text is normalised byte by byte: letters lower-cased, other ASCII blanked. Each language has
the counts of bytes after contexts of 0 to ORDER bytes, frozen after training. A byte seen in
its longest context costs -log2(c / (t + d)) bits there, for c of t bytes and d distinct ones;
a byte not seen pays the escape d / (t + d) and goes on to the next shorter context, where the
bytes seen in the longer one are excluded. Below order 0 all bytes of the alphabet are alike.
The language with the shortest code wins.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from threadloom.llm.common import LETTER, crc_remainder, gathered, map_rows, rows_of, word_table
from threadloom.operators.skew import top_per_key

ORDER = 3
MOST_IDS = 1_000_000  # ids of sampled texts that are broadcast
MOST_TEXTS = 500  # texts learned from, for each language
PIECE = 1 << 20  # bytes coded at once
LETTERS = np.frombuffer(word_table(lambda b: b >= 128 or 97 <= b <= 122), np.uint8)
PAD = b" " * ORDER


def normalised(text):
    return text.encode("utf-8", "surrogatepass").translate(LETTERS.tobytes())


def grams_of(raw):
    """All runs of ORDER + 1 bytes as numbers, one for each byte, blanks before the first."""
    data = np.frombuffer(PAD + raw, np.uint8).astype(np.uint32)
    key = np.zeros(len(raw), np.uint32)
    for i in range(ORDER + 1):
        key = (key << np.uint32(8)) | data[i : i + len(raw)]
    return key


def sample_texts(documents, modulus=4, left_out=2, most=MOST_TEXTS):
    """(lang, text): at most ``most`` texts of each language, chosen by hash of the id.

    Texts of ids with crc32 mod 4 = 2 are left out, and rows whose id, lang or text is null.
    """
    usable = documents.select("doc_id", "lang", "text").filter(
        (crc_remainder(F.col("doc_id"), modulus) != left_out)
        & F.col("lang").isNotNull()
        & F.col("text").isNotNull()
    )
    # ids are taken by least hash: of a language of n rows some 2 * most lie below this share
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)  # 53 bits, exact as a double
    counts = usable.groupBy("lang").agg(F.count("*").alias("_n"))
    languages = counts.count()
    few = languages * most <= MOST_IDS
    counts = F.broadcast(counts) if few else counts
    share = (2 * most + 64) / F.col("_n")
    near = usable.select("doc_id", "lang").join(counts, "lang").filter(hashed < share * 2.0**53)
    ids = top_per_key(near.select("doc_id", "lang").distinct(), ["lang"], [hashed, F.col("doc_id")], most)
    ids = ids.select("doc_id", F.col("lang").alias("_lang"))
    # ``most`` ids of each language: broadcast, the texts of all others need not be shuffled
    joined = usable.join(F.broadcast(ids) if few else ids, "doc_id").filter(F.col("lang") == F.col("_lang"))
    return joined.select("lang", "text")


def count_grams(texts):
    """(lang, gram, n) over whole texts; each task adds up what it read before the shuffle."""

    def run(batches):
        held = {}
        for batch in rows_of(batches):
            langs, raws = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                own = [grams_of(normalised(t)) for one, t in zip(langs, raws, strict=True) if one == lang]
                keys, counts = np.unique(np.concatenate(own), return_counts=True)
                if lang in held:
                    keys = np.concatenate((held[lang][0], keys))
                    counts = np.concatenate((held[lang][1], counts))
                    keys, back = np.unique(keys, return_inverse=True)
                    counts = np.bincount(back, counts).astype(np.int64)
                held[lang] = (keys, counts)
        for lang, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(counts)],
                names=["lang", "gram", "n"],
            )

    return texts.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")
    )


@dataclass
class Level:
    """One context length: seen (context, byte) keys and seen contexts, sorted, with a row of
    bits for each language; ``escapes`` are the bits paid by bytes of that context not seen."""

    keys: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


class Trees:
    """Frozen statistics of all languages, as tables of bits per level.

    ``counts`` maps a language to (grams, counts). Level k holds every (k bytes, next byte) seen
    in any language; for a language that has not seen it, the bits of escaping and coding below.
    """

    def __init__(self, counts):
        self.languages = sorted(counts)
        self.levels = []
        if not counts:
            return
        every = [np.asarray(counts[one][0], np.uint64) for one in self.languages]
        alphabet = np.unique(np.concatenate([g & np.uint64(255) for g in every]))
        self.size = len(alphabet) + 1  # one more for bytes never seen
        for order in range(ORDER + 1):
            mask = np.uint64((1 << (8 * (order + 1))) - 1)
            own = []
            for one, grams in zip(self.languages, every, strict=True):
                keys, back = np.unique(grams & mask, return_inverse=True)
                own.append((keys, np.bincount(back, np.asarray(counts[one][1], float))))
            self.levels.append(self._level(order, own))

    def _level(self, order, own):
        union = np.unique(np.concatenate([keys for keys, _ in own]))
        contexts, context_of = np.unique(union >> np.uint64(8), return_inverse=True)
        lower = self._bits_below(order, union)
        bits = np.zeros((len(union), len(own)))
        escapes = np.zeros((len(contexts), len(own)))
        for column, (keys, counts) in enumerate(own):
            at = np.searchsorted(union, keys)
            place = context_of[at]
            total = np.bincount(place, counts, len(contexts))
            kinds = np.bincount(place, minlength=len(contexts)).astype(float)
            seen = np.zeros(len(union), bool)
            seen[at] = True
            # chance that the shorter context gives to the bytes not excluded
            taken = np.bincount(context_of[seen], 2.0 ** -lower[seen, column], len(contexts))
            left = np.maximum(1.0 - taken, 1e-6)
            known = total > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                pay = np.log2(total + kinds) - np.log2(kinds) + np.log2(left)
            escapes[:, column] = np.where(known, pay, 0.0)  # an unseen context costs nothing
            bits[:, column] = escapes[context_of, column] + lower[:, column]
            bits[at, column] = np.log2((total + kinds)[place]) - np.log2(counts)
        return Level(union, bits.astype(np.float32), contexts, escapes.astype(np.float32))

    def _bits_below(self, order, keys):
        """Bits of the last byte of ``keys`` in the context one shorter."""
        if order == 0:
            return np.full((len(keys), len(self.languages)), np.log2(self.size))
        short = keys & np.uint64((1 << (8 * order)) - 1)
        return self.bits(short, order - 1)

    def bits(self, keys, order=ORDER):
        """(key, language) code lengths of the last byte of each key after the bytes before."""
        level = self.levels[order]
        at = np.searchsorted(level.keys, keys)
        at[at == len(level.keys)] = 0
        out = level.bits[at]
        missing = np.flatnonzero(level.keys[at] != keys)
        if len(missing):
            lost = keys[missing]
            below = self._bits_below(order, lost)
            context = lost >> np.uint64(8)
            place = np.searchsorted(level.contexts, context)
            place[place == len(level.contexts)] = 0
            pay = np.where(
                (level.contexts[place] == context)[:, None], level.escapes[place], np.float32(0)
            )
            out[missing] = below + pay
        return out

    def code_lengths(self, raws):
        """(text, language) bits of whole normalised texts."""
        out = np.zeros((len(raws), len(self.languages)))
        held, owners, size = [], [], 0
        for i, raw in enumerate(raws):
            for start in range(0, len(raw), PIECE):
                before = raw[max(0, start - ORDER) : start].rjust(ORDER)
                piece = before + raw[start : start + PIECE]
                held.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= PIECE:
                    self._add(out, held, owners)
                    held, owners, size = [], [], 0
        if held:
            self._add(out, held, owners)
        return out

    def _add(self, out, pieces, owners):
        """Add the bits of pieces, each led by ORDER bytes of context, to their owners."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        key = np.zeros(len(data) - ORDER, np.uint32)
        for i in range(ORDER + 1):
            key = (key << np.uint32(8)) | data[i : i + len(key)]
        # equal grams of the batch are coded once
        grams, back = np.unique(key, return_inverse=True)
        bits = self.bits(grams.astype(np.uint64))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        ends = starts + sizes - ORDER
        for column in range(bits.shape[1]):
            # grams across two pieces fall outside of every (start, end)
            sums = np.concatenate(([0.0], np.cumsum(bits[back, column], dtype=np.float64)))
            np.add.at(out[:, column], owners, sums[ends] - sums[starts])


def fit_languages(documents, most=MOST_TEXTS):
    """Trees of all languages of ``documents``, from a bounded sample of each."""
    found = gathered(count_grams(sample_texts(documents, most=most)))
    langs = found["lang"].to_numpy(zero_copy_only=False)
    grams, counts = found["gram"].to_numpy(), found["n"].to_numpy()
    return Trees({one: (grams[langs == one], counts[langs == one]) for one in set(langs)})


def identify(documents, most=MOST_TEXTS):
    """(doc_id, held_out, lang_pred, score) for each row of ``documents``.

    ``score`` is the chance of the winner if all languages are equally likely beforehand and
    a byte's evidence is worth its bits. A null text or one without a letter gives ``und`` and
    0, so does a corpus without any usable language. Ties go to the alphabetically first
    language. Repeated rows repeat. A null doc_id is not held out, and nothing is learned from
    it. Further columns are ignored, whatever their names.
    """
    trees = fit_languages(documents, most)
    shared = documents.sparkSession.sparkContext.broadcast(trees)

    def judge(columns):
        texts = [t if t is not None and LETTER.search(t) else None for t in columns["text"].to_pylist()]
        languages = shared.value.languages
        if not languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        bits = shared.value.code_lengths([b"" if t is None else normalised(t) for t in texts])
        best = bits.argmin(axis=1)
        chance = 1.0 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        names = ["und" if t is None else languages[b] for t, b in zip(texts, best, strict=True)]
        return names, [0.0 if t is None else float(c) for t, c in zip(texts, chance, strict=True)]

    scored = map_rows(documents.select("doc_id", "text"), judge, "lang_pred string, score double")
    return scored.select(
        "doc_id",
        F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )
