"""Prompt text, token budgets and single-item requests."""

from pyspark.sql import functions as F

from threadloom import fixed_values as fixed


def _when_present(text, *parts):
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(*parts)).otherwise("")


def same_post_prompt(items):
    """Prompt of a call whose items share one post; the first item carries the post."""
    first = items[0]
    return F.concat(
        F.lit("Post: "),
        first["post_text"],
        _when_present(
            first["image_caption"], F.lit("\n(image: "), first["image_caption"], F.lit(")")
        ),
        F.lit("\n\nComments to reply to:"),
        F.array_join(
            F.transform(
                items,
                lambda item: F.concat(
                    F.lit("\n["), item["pos"].cast("string"), F.lit("] "), item["comment_text"]
                ),
            ),
            "",
        ),
        F.lit(fixed.SAME_POST_TAIL),
    )


def mixed_prompt(items):
    """Prompt of a call whose items come from different posts; the texts are shortened."""

    def entry(item):
        caption = F.substring(item["image_caption"], 1, fixed.CAPTION_PREFIX_CHARS)
        return F.concat(
            F.lit("\n["),
            item["pos"].cast("string"),
            F.lit("] Post: "),
            F.substring(item["post_text"], 1, fixed.POST_PREFIX_CHARS),
            _when_present(caption, F.lit(" (image: "), caption, F.lit(")")),
            F.lit("\n    Comment: "),
            F.substring(item["comment_text"], 1, fixed.COMMENT_PREFIX_CHARS),
        )

    return F.concat(
        F.lit(fixed.MIXED_HEAD),
        F.array_join(F.transform(items, entry), ""),
        F.lit(fixed.MIXED_TAIL),
    )


def token_budget(kind, size):
    def budget(name):
        per_comment, base, ceiling = fixed.TOKEN_BUDGETS[name]
        return F.least(size * per_comment + base, F.lit(ceiling))

    return F.when(kind == "same_post", budget("same_post")).otherwise(budget("mixed_post"))


def join_comments(comments):
    return F.when(F.size(comments) > 0, F.array_join(comments, " | ")).otherwise(
        fixed.NO_COMMENTS
    )


def instruction(kind):
    """What a model is told before the prompt of a call: to answer in the form that is read back."""
    return fixed.INSTRUCTIONS[kind]
