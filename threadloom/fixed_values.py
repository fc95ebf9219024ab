"""Patterns, texts and limits that results depend on.

Fixed values: every constant in this module is part of the data contract.
Changing one changes query results.
"""

# --- text cleaning -----------------------------------------------------------
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{FE00}-\x{FE0F}\x{1F900}-\x{1F9FF}"
    r"\x{200D}\x{20E3}\x{E0020}-\x{E007F}]+"
)
URL = r"(https?://\S+|www\.\S+)"
URL_MARK = "[URL]"
# Characters that survive cleaning, as the inside of a regex class, without whitespace.
KEPT_CHARACTERS = r"""a-zA-Z0-9.,!?'"@#$%&*()\-_+=;:<>/\\\[\]{}|~`"""
# What counts as blank at the ends of a string: ASCII controls, NEL, Unicode separators.
BLANK_CHARACTERS = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"

# --- defaults for missing fields ---------------------------------------------
DEFAULTS = {
    "imageUrl": "",
    "imageCaption": "",
    "parentCommentId": "",
    "username": "anonymous",
    "subreddit": "general",
    "upvotes": 0,
}
CAPTION_PLACEHOLDER = "[Image without caption]"
CAPTION_FALLBACK = "[Image attached to post]"
UNKNOWN_POST = {
    "postId": "unknown",
    "userId": "unknown",
    "postText": "",
    "commentText": "",
    "imageCaption": "",
    "subreddit": "general",
}

# --- packing and prompts -----------------------------------------------------
POST_PREFIX_CHARS = 200
CAPTION_PREFIX_CHARS = 100
COMMENT_PREFIX_CHARS = 300
COMMENTS_PER_CALL = 10
ITEMS_PER_REQUEST = 50
CALLS_PER_MINUTE = 28
CALLS_PER_MINUTE_PAID = 60
SAME_POST_TAIL = "\n\nReply to each comment above (use [1], [2], etc.):"
MIXED_HEAD = "Reply to each of the following post+comment pairs:\n"
MIXED_TAIL = "\n\nReply to each item above (use [1], [2], etc.):"
# What a model is told before the prompt of a call, by the kind of call.
INSTRUCTIONS = {
    "same_post": (
        "You take part in an online discussion. Below are one post and numbered comments on it. "
        "Answer every comment on its own, in one or two short, informal sentences. Start each answer on a "
        "new line with the comment's number in brackets: [1] first answer, [2] second answer, and so on."
    ),
    "mixed_post": (
        "You take part in an online discussion. Below are numbered pairs of a post and a comment on it. "
        "Answer every comment on its own, in one or two short, informal sentences. Start each answer on a "
        "new line with the pair's number in brackets: [1] first answer, [2] second answer, and so on."
    ),
}
# kind: (tokens per comment, base, ceiling)
TOKEN_BUDGETS = {"same_post": (80, 50, 1024), "mixed_post": (80, 100, 2048)}

# --- replies -----------------------------------------------------------------
RAW_PREFIX_CHARS = 150
ERROR_PREFIX_CHARS = 80
NO_REPLY = "[no reply generated]"
REPLY_NOT_FOUND = "[Error: reply not found in LLM output]"
TIMED_OUT = "[Reply generation timed out]"
NO_COMMENTS = "General comment"
# Answers of the offline provider, by the hash of the comment.
OFFLINE_REPLIES = [
    "Offline answer one: noted.",
    "Offline answer two: agreed in part.",
    "Offline answer three: this needs a source.",
    "Offline answer four: could you say more?",
    "Offline answer five: a fair summary.",
    "Offline answer six: that depends on the case.",
    "Offline answer seven: seen before, same result.",
    "Offline answer eight: no opinion.",
]

# --- quality profile and jobs ------------------------------------------------
DIRTY_MARKERS = ["🔥", "😍", "<script>", "http://", "NULL", "🚀", "💰", "💀"]
ACTIVE_JOB_STATES = ["uploading", "uploaded", "submitted", "processing", "inferring"]
RETRY_JOB_STATES = ["uploaded", "submitted"]
FEED_SIZE = 100
LIVE_BUFFER_SIZE = 200
