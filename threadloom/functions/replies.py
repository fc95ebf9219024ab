"""Reading numbered replies out of a raw model answer."""

from pyspark.sql import functions as F

from threadloom import fixed_values as fixed
from threadloom.functions.identity import hash_bucket
from threadloom.functions.text import strip_blanks


def numbered_replies(raw):
    """All ``[n] text`` pieces in order, as an array of (number, reply)."""
    numbers = F.regexp_extract_all(raw, F.lit(r"\[(\d+)\]"), F.lit(1))
    pieces = F.split(raw, r"\[\d+\]", -1)
    return F.zip_with(
        numbers,
        F.slice(pieces, F.lit(2), F.size(numbers)),
        lambda number, piece: F.struct(
            number.try_cast("bigint").alias("number"), strip_blanks(piece).alias("reply")
        ),
    )


def answer_lines(raw):
    """Non-blank lines with a leading ``[n]`` removed."""
    bare = F.transform(
        F.split(strip_blanks(raw), "\n"),
        lambda line: strip_blanks(F.regexp_replace(strip_blanks(line), r"^\[\d+\]\s*", "")),
    )
    return F.filter(bare, lambda line: line != "")


def fallback_reply(raw, lines, pos, kind):
    """Stand-in for an item the answer does not number."""
    start = F.substring(strip_blanks(raw), 1, fixed.RAW_PREFIX_CHARS)
    return F.coalesce(
        F.try_element_at(lines, pos),
        F.when((kind == "mixed_post") & (start == ""), fixed.NO_REPLY).otherwise(start),
    )


def reply_at(raw, found, lines, pos, kind):
    """Reply of position ``pos``: the last piece with its number, else the fallback."""
    own = F.filter(found, lambda piece: piece["number"] == pos)
    return F.when(F.size(own) > 0, F.try_element_at(own, F.lit(-1))["reply"]).otherwise(
        fallback_reply(raw, lines, pos, kind)
    )


def error_text(message):
    return F.concat(
        F.lit("[Error: "), F.substring(message, 1, fixed.ERROR_PREFIX_CHARS), F.lit("]")
    )


def offline_reply(comment_id):
    """Fixed reply picked by the comment's hash."""
    replies = F.array(*[F.lit(text) for text in fixed.OFFLINE_REPLIES])
    return F.element_at(
        replies, (hash_bucket(comment_id, len(fixed.OFFLINE_REPLIES)) + 1).cast("int")
    )
