"""SQL twins of the registered queries, for the check engine (DuckDB)."""

from threadloom import fixed_values as fixed
from threadloom.plans.bridge import NOW_MS, PROVIDER_VERSION, THREAD_CTES, TURNS_PER_DOCUMENT
from threadloom.plans.registry import AUDIT_BUDGET, AUDIT_SECONDS, KEY_SLOTS, NEWEST_USERS
from threadloom.schemas import COMMENT_EVENT


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


# The check engine's \s lacks the vertical tab.
_SPACE = r"[\s\x0B]"
_EMOJI = _quoted(fixed.EMOJI)
_URL = _quoted(fixed.URL.replace(r"\S", r"[^\s\x0B]"))
_SPECIAL = _quoted(f"[^{fixed.KEPT_CHARACTERS}" + r"\s\x0B]")
_BLANK = fixed.BLANK_CHARACTERS
_BLANK_ENDS = _quoted(f"^[{_BLANK}]+|[{_BLANK}]+$")


def _emoji(c):
    return f"regexp_replace({c}, {_EMOJI}, '', 'g')"


def _urls(c):
    return f"regexp_replace({c}, {_URL}, '{fixed.URL_MARK}', 'g')"


def _special(c):
    return f"regexp_replace({c}, {_SPECIAL}, '', 'g')"


def _collapse(c):
    return f"trim(regexp_replace({c}, '{_SPACE}+', ' ', 'g'))"


def _body(c):
    return _collapse(_special(_urls(_emoji(c))))


def _strip(c):
    return f"regexp_replace({c}, {_BLANK_ENDS}, '', 'g')"


def _words(c):
    return f"len(string_split_regex({c}, '{_SPACE}+'))"


def _point(hex_text):
    return f"cast('0x' || substr({hex_text}, 1, 10) as bigint)"


def _bucket(text, n):
    return f"({_point(f'md5({text})')} % {n})"


def _offline(c):
    replies = ", ".join(_quoted(r) for r in fixed.OFFLINE_REPLIES)
    return f"([{replies}])[{_bucket(c, len(fixed.OFFLINE_REPLIES))} + 1]"


def _present(c):
    return f"coalesce({c}, '') <> ''"


def _defaults(now):
    d = fixed.DEFAULTS
    return f"""
    coalesce(imageUrl, '{d["imageUrl"]}') as imageUrl,
    coalesce(imageCaption, '{d["imageCaption"]}') as imageCaption,
    coalesce(parentCommentId, '{d["parentCommentId"]}') as parentCommentId,
    coalesce(username, '{d["username"]}') as username,
    coalesce(subreddit, '{d["subreddit"]}') as subreddit,
    coalesce(upvotes, {d["upvotes"]}) as upvotes,
    coalesce("timestamp", {now}) as "timestamp"
    """


_CLEANED = f"""
  commentId, postId, userId, trim({_special("username")}) as username,
  trim({_special(_emoji("postTitle"))}) as postTitle, {_body("postText")} as postText,
  {_body("commentText")} as commentText, imageUrl, imageCaption,
  lower(trim({_special("subreddit")})) as subreddit, "timestamp", upvotes, parentCommentId
"""

_KEY_ORDER = ", ".join(
    f"{c} nulls first"
    for c in (
        '"timestamp" postId userId username postTitle postText commentText imageUrl '
        "imageCaption subreddit upvotes parentCommentId"
    ).split()
)

_FEATURES = f"""
  case when imageUrl <> '' and imageCaption = '' then '{fixed.CAPTION_PLACEHOLDER}'
       else imageCaption end as imageCaption,
  subreddit, "timestamp", cast(upvotes as int) as upvotes,
  {_words("commentText")} as wordCount, length(commentText) as charCount,
  cast({NOW_MS} as bigint) as processedAt
"""

_DIRTY = " or ".join(f"contains(coalesce(commentText, ''), '{m}')" for m in fixed.DIRTY_MARKERS)
_SAME = fixed.TOKEN_BUDGETS["same_post"]
_MIXED = fixed.TOKEN_BUDGETS["mixed_post"]


def _budget(kind, size):
    return (
        f"case when {kind} = 'same_post' then least({size} * {_SAME[0]} + {_SAME[1]}, {_SAME[2]}) "
        f"else least({size} * {_MIXED[0]} + {_MIXED[1]}, {_MIXED[2]}) end"
    )


_CTES = f"""
with {THREAD_CTES},
raw as (
  select commentId, postId, userId, username, postTitle, postText, commentText, imageUrl,
    imageCaption, subreddit, ts as "timestamp", upvotes, parentCommentId, conv_id, turn
  from comments),
valid as (
  select * from raw where {_present("commentId")} and {_present("postId")}
    and {_present("commentText")} and {_present("postText")}),
texts_clean as (
  select * from (select {_CLEANED} from valid)
  where length(commentText) > 0 and length(postText) > 0),
filled as (
  select commentId, postId, userId, postTitle, postText, commentText, {_defaults(NOW_MS)}
  from texts_clean),
raw_filled as (
  select commentId, postId, userId, postTitle, postText, commentText, {_defaults(NOW_MS)}
  from raw),
deduped as (
  select * exclude (place) from (
    select *, row_number() over (partition by commentId order by {_KEY_ORDER}) as place
    from filled) where place = 1),
clean as (
  select commentId, postId, userId, username, postTitle, postText, commentText, {_FEATURES}
  from deduped),
clean_live as (
  select commentId, postId, userId, username, postText, commentText, parentCommentId, {_FEATURES}
  from deduped),
posts_table as (
  select postId, userId, username, title, postText, subreddit, imageUrl, imageCaption,
    ts as createdAt from posts),
stored_posts as (select * from posts_table where postText is not null),
comments_table as (
  select distinct commentId, postId, userId, coalesce(username, 'anonymous') as username,
    commentText, coalesce(parentCommentId, '') as parentCommentId,
    coalesce("timestamp", {NOW_MS}) as createdAt
  from raw where commentText is not null),
users as (
  select userId, ' ' || substr(userId, 5, 9) as username, min("timestamp") as createdAt
  from raw group by userId),
replies as (
  select substr(md5(commentId), 1, 16) as replyId, commentId, postId,
    {_offline("commentId")} as generatedReply, "timestamp" + 5000 as "timestamp"
  from clean where {_bucket("commentId", 9)} <> 0),
documents_of_posts as (
  select postId, turn // {TURNS_PER_DOCUMENT} as document, count(*) as n,
    cast(sum(coalesce(length(commentText), 0)) as bigint) as chars
  from raw group by 1, 2),
calls_log as (
  select event_id, user_id % 3 as slot,
    case when event_type = 'error' then 429 else 200 end as status, user_id % 10 + 1 as items,
    cast(floor(value * 100) as bigint) as latencyMs, epoch_us(ts) as atMicros from events),
job_events as (
  select 'job' || user_id as jobId,
    case when user_id % 4 = 0 then null when user_id % 4 = 1 then ''
         else 'app' || user_id end as sparkJobId,
    case event_type when 'view' then 'uploaded' when 'signup' then 'submitted'
      when 'click' then 'inferring' when 'error' then 'failed' else 'completed' end as status,
    '/data/raw/bulk/job' || user_id as inputPath,
    case when user_id % 7 = 0 then '' else '/data/output/job' || user_id end as outputPath,
    epoch_us(ts) // 1000 as uploadedAt,
    cast(json_extract_string(props, '$.k') as bigint) as totalRecords,
    cast(floor(cast(json_extract_string(props, '$.k') as bigint) * event_id % 100 / 2) as bigint)
      as processedRecords, event_id
  from events),
jobs as (
  select * exclude (place) from (
    select *, row_number() over (
      partition by jobId order by uploadedAt desc, event_id desc) as place
    from job_events) where place = 1),
first_jobs as (
  select * exclude (place) from (
    select *, row_number() over (partition by jobId order by uploadedAt, event_id) as place
    from job_events) where place = 1),
items as (
  select commentId as id, postText as post_text, commentText as comment_text,
    imageCaption as image_caption from clean),
keyed as (
  select *, sha256(substr(post_text, 1, {fixed.POST_PREFIX_CHARS})) as postKey, md5(id) as itemKey
  from items),
numbered as (
  select *, row_number() over (partition by postKey order by itemKey, id) as position,
    count(*) over (partition by postKey) as groupRows,
    {_point("postKey")} % (
      select cast(ceil(count(*) / {fixed.ITEMS_PER_REQUEST}.0) as bigint) from items) as bucket
  from keyed),
pooled as (
  select *, row_number() over (partition by bucket order by itemKey, id) - 1 as place
  from numbered where groupRows = 1),
packed as (
  select postKey || '-' || ((position - 1) // {fixed.COMMENTS_PER_CALL}) as callId,
    'same_post' as kind, bucket, postKey, (position - 1) % {fixed.COMMENTS_PER_CALL} + 1 as pos,
    id, post_text, comment_text, image_caption
  from numbered where groupRows > 1
  union all
  select 'mixed-' || bucket || '-' || (place // {fixed.COMMENTS_PER_CALL}), 'mixed_post',
    bucket, postKey, place % {fixed.COMMENTS_PER_CALL} + 1, id, post_text, comment_text, image_caption
  from pooled),
calls as (
  select callId, kind, bucket, count(*) as size, min_by(id, pos) as first_id,
    min_by(post_text, pos) as post_text, min_by(image_caption, pos) as image_caption,
    string_agg(chr(10) || '[' || pos || '] ' || comment_text, '' order by pos) as lines,
    string_agg(chr(10) || '[' || pos || '] Post: '
      || substr(post_text, 1, {fixed.POST_PREFIX_CHARS})
      || case when image_caption <> '' then ' (image: '
           || substr(image_caption, 1, {fixed.CAPTION_PREFIX_CHARS}) || ')' else '' end
      || chr(10) || '    Comment: ' || substr(comment_text, 1, {fixed.COMMENT_PREFIX_CHARS}),
      '' order by pos) as pairs,
    string_agg('[' || pos || '] ' || {_offline("id")}, chr(10) order by pos) as numbered_answer,
    string_agg({_offline("id")}, chr(10) || chr(10) order by pos) as bare_answer
  from packed group by callId, kind, bucket),
prompts as (
  select callId, kind, size, first_id, case when kind = 'same_post' then 'Post: ' || post_text
      || case when image_caption <> '' then chr(10) || '(image: ' || image_caption || ')'
           else '' end
      || chr(10) || chr(10) || 'Comments to reply to:' || lines
      || {_quoted(fixed.SAME_POST_TAIL)}
    else {_quoted(fixed.MIXED_HEAD)} || pairs || {_quoted(fixed.MIXED_TAIL)} end as prompt
  from calls),
answers as (
  select *, case {_bucket("callId", 8)}
      when 4 then bare_answer
      when 5 then '[1] ' || {_offline("first_id")} || chr(10) || '[1]  again' || chr(10)
        || '[99] nobody [x]' || chr(10) || '[2]'
      when 6 then '  ' || chr(10) || '  '
      when 7 then '  sure, here you go: ' || {_offline("first_id")} || chr(10)
      else numbered_answer end as raw
  from calls),
pieces as (
  select callId, kind, raw, unnest(range(len(numbers))) as place,
    unnest(numbers) as number, unnest(bodies) as body
  from (select callId, kind, raw, regexp_extract_all(raw, '\\[(\\d+)\\]', 1) as numbers,
          (string_split_regex(raw, '\\[\\d+\\]'))[2:] as bodies from answers)),
read_pieces as (
  select callId, place, try_cast(number as bigint) as number, {_strip("body")} as reply
  from pieces),
last_pieces as (
  select callId, number, max_by(reply, place) as reply from read_pieces group by 1, 2),
answer_lines as (
  select callId, row_number() over (partition by callId order by nr) as pos, line
  from (
    select callId, nr, {_strip(f"regexp_replace({_strip('line')}, '^\\[\\d+\\]{_SPACE}*', '')")}
      as line
    from (
      select callId, unnest(lines) as line, unnest(range(len(lines))) as nr
      from (select callId, string_split({_strip("raw")}, chr(10)) as lines from answers)))
  where line <> ''),
parsed as (
  select p.callId, p.pos, coalesce(l.reply, a.line,
    case when p.kind = 'mixed_post' and {_strip("c.raw")} = '' then '{fixed.NO_REPLY}'
         else substr({_strip("c.raw")}, 1, {fixed.RAW_PREFIX_CHARS}) end) as reply
  from packed p join answers c on c.callId = p.callId
  left join last_pieces l on l.callId = p.callId and l.number = p.pos
  left join answer_lines a on a.callId = p.callId and a.pos = p.pos),
results as (
  select callId, {_bucket("callId", 900)} + 100 as latencyMs, size,
    case {_bucket("callId", 5)} when 0 then 'error' when 1 then 'timeout' else 'ok' end as status,
    'no answer for call ' || callId || ', ' || callId as error
  from calls),
failed_replies as (
  select p.id,
    case when r.status = 'timeout' then '{fixed.TIMED_OUT}'
         else '[Error: ' || substr(r.error, 1, {fixed.ERROR_PREFIX_CHARS}) || ']' end
      as generated_reply,
    case when r.status = 'timeout' then r.latencyMs else -1 end as latency_ms, r.status
  from packed p join results r on r.callId = p.callId where r.status <> 'ok'),
enriched as (
  select c.commentId, c.postId, c.userId, c.username, c.postTitle, c.postText, c.commentText,
    c.imageCaption, c.subreddit, c."timestamp", r.generatedReply,
    length(r.commentId) as inferenceLatencyMs, r."timestamp" as processedAt
  from clean c left join replies r on r.commentId = c.commentId),
generated as (
  select sha256(commentId || '|{PROVIDER_VERSION}') as replyId, commentId, postId, userId,
    postText, commentText, {_offline("commentId")} as generatedReply, subreddit,
    cast({NOW_MS} as bigint) as generatedAt, 'ok' as status
  from clean_live),
comment_events as (
  select c.commentId, c.postId, c.userId, c.username, p.postText, c.commentText, p.imageUrl,
    p.imageCaption, p.subreddit, c.createdAt as "timestamp", c.parentCommentId, 0 as upvotes
  from comments_table c join stored_posts p on p.postId = c.postId),
post_profile as (
  select count(*) as posts, count(*) filter (postText is null) as nullPosts,
    count(*) filter ({_present("imageUrl")}) as postsWithImage from posts),
comment_groups as (
  select commentText, count(*) as n from raw
  group by postId, commentId, userId, username, commentText, "timestamp", upvotes,
    parentCommentId),
comment_flags as (
  select n, {_DIRTY} as isDirty, {_strip("coalesce(commentText, '')")} = '' as isEmpty
  from comment_groups),
comment_profile as (
  select count(*) as totalComments,
    cast(coalesce(sum(n) filter (isDirty), 0) as bigint) as dirty,
    cast(coalesce(sum(n) filter (isEmpty), 0) as bigint) as empty,
    cast(coalesce(sum(n) filter (n > 1), 0) as bigint) as duplicates
  from comment_flags),
per_call as (select callId, kind, count(*) as n from packed group by callId, kind),
pack_report as (
  select cast(sum(n) as bigint) as items, count(*) as calls,
    cast(coalesce(sum(n) filter (kind = 'mixed_post'), 0) as bigint) as mixedItems,
    max(n) as largestCall, cast(sum({_budget("kind", "n")}) as bigint) as tokens,
    (select count(distinct postKey) from keyed) as postGroups
  from per_call),
all_texts as (
  select 'd' || doc_id as id, text from documents
  union all select commentId, commentText from raw),
live_replies as (
  select replyId, commentId, postId, upper(generatedReply) as generatedReply, "timestamp"
  from replies where {_bucket("commentId", 3)} = 0)
"""

_RAW_COLUMNS = """commentId, postId, userId, username, postTitle, postText, commentText, imageUrl,
  imageCaption, subreddit, "timestamp", upvotes, parentCommentId"""
_EVENT_FIELDS = [c for c in COMMENT_EVENT.fieldNames() if c != "metadata"]
_EVENT_COLUMNS = ", ".join(f'"{c}"' for c in _EVENT_FIELDS)
_NO_EVENT = ", ".join(["null"] * 13)


def _json(*fields):
    """A compact JSON object with null fields kept."""
    parts = [
        f"'\"{name}\":' || coalesce(to_json({value})::varchar, 'null')" for name, value in fields
    ]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


_DECODED_EVENTS = f"""
  select {_EVENT_COLUMNS}, cast(turn as varchar) as turn from raw
  union all select {_NO_EVENT} from raw"""

_DOCUMENTS = f"""
  select p.postId, p.username, p.title, p.postText, p.subreddit, p.imageUrl, p.imageCaption,
    p.ts as "timestamp",
    d.n + case when p.conv_id % 13 = 0 and d.document = 0 then 1 else 0 end as comments,
    d.chars as commentChars
  from posts p join documents_of_posts d on d.postId = p.postId
  union all
  select postId, username, title, postText, subreddit, imageUrl, imageCaption, ts, -1, 0
  from posts where conv_id % 17 = 16"""

_DECODED_REPLIES = f"""
  select coalesce(replyId, sha256(commentId || '|' || postId || '|' || generatedReply
      || coalesce('|' || "timestamp", ''))) as replyId, commentId, postId, generatedReply,
    coalesce("timestamp", {NOW_MS}) as "timestamp"
  from (
    select case when {_bucket("commentId", 5)} <> 0 then replyId end as replyId, commentId,
      case when {_bucket("commentId", 6)} <> 0 then postId else '' end as postId,
      case when {_bucket("commentId", 4)} <> 0 then generatedReply else '' end as generatedReply,
      case when {_bucket("commentId", 7)} <> 0 then "timestamp" end as "timestamp"
    from replies)"""

_PROJECTED = "from (select * from raw_filled where commentText is not null)"

_JOIN_LIST = f"""
  select p.postId, p.ts as "timestamp", coalesce(d.request, '') as request
  from posts p join (
    select postId, turn // {TURNS_PER_DOCUMENT} as document,
      string_agg(commentText, ' | ' order by commentId) as request
    from raw group by 1, 2) d on d.postId = p.postId
  union all
  select postId, ts, '{fixed.NO_COMMENTS}' from posts where conv_id % 17 = 16"""

_MINUTE = "((epoch_us(ts) // 1000) // 60000) * 60000"
_WIDTH = AUDIT_SECONDS * 1_000_000

_SELECTS = {
    "scan_nested_posts": _DOCUMENTS,
    "scan_array_posts": _DOCUMENTS,
    "land_raw_posts": _DOCUMENTS,
    "decode_events": """
      select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events""",
    "decode_comment_events": _DECODED_EVENTS,
    "stream_comment_source": _DECODED_EVENTS,
    "stream_post_source": "select * from posts_table",
    "scan_results_tolerant": "select * from enriched",
    "scan_glob_filter": "select * from enriched",
    "export_job_results": "select * from enriched",
    "enrich_with_replies": "select * from enriched",
    "decode_replies": _DECODED_REPLIES,
    "scan_state_tables": """
      select 'users' as tableName, userId as key, username as label, createdAt as at from users
      union all select 'posts', postId, userId, createdAt from posts_table
      union all select 'comments', commentId, userId, createdAt from comments_table
      union all select 'replies', replyId, commentId, "timestamp" from replies
      union all select 'batch_jobs', jobId, status, uploadedAt from jobs""",
    "sink_json_overwrite": "select * from clean",
    "encode_reply_messages": "select replyId as key, "
    + _json(
        ("replyId", "replyId"),
        ("commentId", "commentId"),
        ("postId", "postId"),
        ("generatedReply", "generatedReply"),
        ("timestamp", "generatedAt"),
    )
    + " as value from generated",
    # the message ends with the metadata map, which is empty for new comments
    "encode_comment_events": "select commentId as key, "
    "left(body, -1) || ',\"metadata\":{}}' as value from (select commentId, "
    + _json(*[(c, f'"{c}"') for c in _EVENT_FIELDS])
    + " as body from comment_events)",
    "insert_or_ignore": "select * from replies",
    "stream_reply_ingest": "select * from replies",
    "stream_post_ingest": "select * from posts_table",
    "stream_post_compacted": "select * from posts_table",
    "stream_rejects": """
      select 'posts' as topic, 3 * count(*) as messages, count(*) as stored,
        2 * count(*) as rejected, 2 * count(*) as kept from posts_table
      union all
      select 'replies', 2 * count(*), count(*), count(*), count(*) from replies""",
    "stream_new_checkpoint": """
      select c.commentId, c.postId, c.commentText, cast(1 as bigint) as replies, g.generatedReply as reply
      from clean_live c join generated g on g.commentId = c.commentId""",
    "latest_status_by_key": "select * from jobs",
    "job_failure_event": """
      select jobId, 'failed' as status, inputPath, outputPath, 0 as totalRecords,
        0 as processedRecords, 'job broke at event ' || event_id as error
      from job_events where status = 'failed'""",
    "changed_rows": """
      select j.*, f.status as old_status, f.totalRecords as old_totalRecords,
        f.processedRecords as old_processedRecords
      from jobs j join first_jobs f on f.jobId = j.jobId
      where j.status is distinct from f.status
        or j.totalRecords is distinct from f.totalRecords
        or j.processedRecords is distinct from f.processedRecords""",
    "explode_comments": f"select {_RAW_COLUMNS} from raw",
    "validate_batch": "select * from valid",
    "validate_stream": """
      select commentId, postId, userId, username, postTitle, postText, commentText, imageUrl,
        imageCaption, subreddit, "timestamp", upvotes, parentCommentId, conv_id, turn
      from valid where turn % 4 <> 3""",
    "drop_empty_after_clean": f"""
      select * from valid
      where length({_body("commentText")}) > 0 and length({_body("postText")}) > 0""",
    "clean_text": "select * from texts_clean",
    "null_defaults": "select * from raw_filled",
    "dedupe_comments": f"""
      select * exclude (place) from (
        select *, row_number() over (partition by commentId order by {_KEY_ORDER}) as place
        from raw_filled) where place = 1""",
    "image_features": f"""
      select commentId, imageUrl,
        case when imageUrl <> '' and imageCaption = '' then '{fixed.CAPTION_PLACEHOLDER}'
             else imageCaption end as imageCaption,
        imageUrl <> '' as hasImage, imageCaption <> '' as hasCaption from raw_filled""",
    "text_features": f"""
      select commentId, {_words("commentText")} as wordCount, length(commentText) as charCount,
        cast({NOW_MS} as bigint) as processedAt, coalesce(parentCommentId, '') <> '' as isReply
      from texts_clean""",
    "project_batch": f"""
      select commentId, postId, userId, username, postTitle, postText, commentText, {_FEATURES}
      {_PROJECTED}""",
    "project_stream": f"""
      select commentId, postId, userId, username, postText, commentText, parentCommentId,
        {_FEATURES} {_PROJECTED}""",
    "preprocess_batch": "select * from clean",
    "preprocess_stream": "select * from clean_live",
    "stream_sink_cleaned": "select * from clean_live",
    "stream_restart": "select * from clean_live",
    "stream_dedupe": "select * from clean_live",
    "stream_sink_replies": "select * from generated",
    "stream_late_copies": "select * from generated",
    "stream_end_to_end": """
      select replyId, commentId, postId, generatedReply, generatedAt as "timestamp"
      from generated""",
    "stream_foreach_batch": "select event_type, count(*) as events from events group by 1",
    "stream_throughput": f"""
      select {_MINUTE} as minuteMs, count(*) as events from events group by 1""",
    "stream_late_rows": "select * from clean_live",
    "stream_orphans": """
      select * from comments_table where postId not in (select postId from stored_posts)""",
    "rejected_messages": """
      select postId as key, '{"postId":"' || postId || '"' as value from posts_table""",
    "live_buffer": f"""
      select * from replies order by "timestamp" desc, replyId limit {fixed.LIVE_BUFFER_SIZE}""",
    "resumed_replies": f"""
      select id, {_offline("id")} as generated_reply, 'ok' as status from items""",
    "captions_once": """
      select imageUrl, count(distinct coalesce(title, '') || ' - ' || coalesce(postText, '')) as requests,
        cast(count(distinct coalesce(title, '') || ' - ' || coalesce(postText, '')) as bigint) as calls,
        'seen at ' || imageUrl as imageCaption
      from posts_table where coalesce(imageUrl, '') <> '' and coalesce(imageCaption, '') = ''
      group by imageUrl""",
    "caption_by_provider": """
      select * replace (case when coalesce(imageUrl, '') <> '' and coalesce(imageCaption, '') = ''
        then 'seen at ' || imageUrl else imageCaption end as imageCaption) from posts_table""",
    "size_partitions": """
      select count(*) as rows, cast(ceil(count(*) / 500.0) as bigint) as partitions
      from events""",
    "reply_metadata_lookup": f"""
      select c.commentId, {_offline("c.commentId")} as generatedReply,
        coalesce(m.postId, 'unknown') as postId, coalesce(m.userId, 'unknown') as userId,
        coalesce(m.postText, '') as postText, coalesce(m.commentText, '') as commentText,
        coalesce(m.imageCaption, '') as imageCaption, coalesce(m.subreddit, 'general') as subreddit
      from comments_table c left join clean m on m.commentId = c.commentId""",
    "enrich_comment_with_post": "select * from comment_events",
    "stream_enrich_comments": "select * from comment_events",
    "batch_end_to_end": f"""
      select commentId, postId, userId, username, postTitle, postText, commentText, imageCaption,
        subreddit, "timestamp", {_offline("commentId")} as generatedReply, processedAt
      from clean""",
    "reject_orphan_comments": """
      select * from comments_table where postId not in (select postId from stored_posts)""",
    "feed_with_counts": f"""
      select p.*,
        (select count(*) from comments_table c where c.postId = p.postId) as commentCount,
        (select count(*) from replies r where r.postId = p.postId) as replyCount
      from posts_table p order by p.createdAt desc, p.postId limit {fixed.FEED_SIZE}""",
    "feed_pruned": f"""
      select p.*,
        (select count(*) from comments_table c where c.postId = p.postId) as commentCount,
        (select count(*) from replies r where r.postId = p.postId) as replyCount
      from posts_table p order by p.createdAt desc, p.postId limit {fixed.FEED_SIZE}""",
    "feed_from_state": f"""
      select p.*,
        (select count(*) from comments_table c where c.postId = p.postId) as commentCount,
        (select count(*) from replies r where r.postId = p.postId) as replyCount
      from posts_table p order by p.createdAt desc, p.postId limit {fixed.FEED_SIZE}""",
    "counts_per_post": """
      select p.postId,
        (select count(*) from comments_table c where c.postId = p.postId) as commentCount,
        (select count(*) from replies r where r.postId = p.postId) as replyCount
      from posts_table p""",
    "merge_live_replies": """
      select *, 'live' as source from live_replies
      union all
      select *, 'stored' from replies
      where replyId not in (select replyId from live_replies)""",
    "thread_view": """
      select c.commentId, c.postId, c.username, c.commentText, c.createdAt, r.replyId,
        r.generatedReply, r."timestamp" as repliedAt
      from comments_table c left join replies r on r.commentId = c.commentId""",
    "fk_violations": """
      select 'comments.postId' as edge, postId as key, count(*) as rows from comments_table
      where postId not in (select postId from stored_posts) group by 2
      union all
      select 'comments.userId', userId, count(*) from comments_table
      where userId not in (select userId from users) group by 2
      union all
      select 'posts.userId', userId, count(*) from stored_posts
      where userId not in (select userId from users) group by 2""",
    "pk_violations": """
      select 'users.userId' as "constraint", userId as key, count(*) as rows from users
      group by 2 having count(*) > 1
      union all select 'users.username', username, count(*) from posts_table
      group by 2 having count(*) > 1
      union all select 'posts.postId', postId, count(*) from posts_table
      group by 2 having count(*) > 1
      union all select 'comments.commentId', commentId, count(*) from raw
      group by 2 having count(*) > 1
      union all select 'replies.replyId', replyId, count(*) from replies
      group by 2 having count(*) > 1
      union all select 'batch_jobs.jobId', jobId, count(*) from job_events
      group by 2 having count(*) > 1""",
    "lookup_by_key": "select * from posts_table where postId in (select postId from replies)",
    "lookup_indexed": "select * from posts_table where postId in (select postId from replies)",
    "comments_of_newest_users": f"""
      select * from comments_table where userId in (
        select userId from users order by createdAt desc nulls last, userId limit {NEWEST_USERS})""",
    "valid_usernames": f"""
      select * from (
        select userId, createdAt, {_strip("username")} as username from users)
      where length(username) between 2 and 30""",
    "stuck_jobs": """
      select * from jobs where status in ('uploaded', 'submitted')
        and (sparkJobId is null or sparkJobId = '') and inputPath <> '' and outputPath <> ''""",
    "active_jobs": f"""
      select * from jobs
      where status in ({", ".join(_quoted(s) for s in fixed.ACTIVE_JOB_STATES)})""",
    "users_by_recency": "select * from users order by createdAt desc",
    "jobs_by_recency": "select * from jobs order by uploadedAt desc",
    "latest_replies": f"""
      select * from replies order by "timestamp" desc, replyId limit {fixed.FEED_SIZE}""",
    "recent_replies_topk": """
      select * from (
        select *, row_number() over (
          partition by postId order by "timestamp" desc, replyId) as rank
        from replies) where rank <= 3""",
    "post_comments": "select * from comments_table",
    "post_replies": "select * from replies",
    "platform_stats": """
      select (select count(*) from users) as users, (select count(*) from posts_table) as posts,
        (select count(*) from comments_table) as comments,
        (select count(*) from replies) as replies, (select count(*) from jobs) as batchJobs""",
    "job_progress": f"""
      select 'job' || {_bucket("c.postId", 5)} as jobId, count(*) as totalRecords,
        count(r.commentId) as processedRecords,
        round(count(r.commentId) / count(*), 4) as fraction
      from clean c left join replies r on r.commentId = c.commentId group by 1""",
    "progress_percent": """
      select event_id, jobId, cast(case when status = 'completed' then 100
        when totalRecords is null or totalRecords = 0 then 0
        else least(floor(processedRecords / totalRecords * 100 + 0.5), 99) end as int) as percent
      from job_events""",
    "quality_funnel": f"""
      select (select count(*) from ({_DOCUMENTS})) as posts,
        (select count(*) from raw) as exploded, (select count(*) from valid) as valid,
        (select count(*) from texts_clean) as withText,
        (select count(*) from clean) as distinctComments,
        (select count(*) from raw) - (select count(*) from valid) as dropped""",
    "quality_profile": """
      select p.*, c.*, totalComments - dirty - empty as clean,
        round(dirty / greatest(totalComments, 1) * 100, 1) as dirtyPercent,
        round(postsWithImage / greatest(posts, 1) * 100, 0) as imagePercent
      from post_profile p, comment_profile c""",
    "projected_minutes": f"""
      select totalComments - empty as comments,
        round((totalComments - empty) / {fixed.CALLS_PER_MINUTE}, 2) as minutesFree,
        round((totalComments - empty) / {fixed.CALLS_PER_MINUTE_PAID}, 2) as minutesPaid,
        calls, round(calls / {fixed.CALLS_PER_MINUTE * KEY_SLOTS}, 2) as minutesPacked
      from comment_profile, pack_report""",
    "packing_report": """
      select *, round(items / greatest(postGroups, 1), 1) as itemsPerPost,
        round(items / greatest(calls, 1), 1) as itemsPerCall from pack_report""",
    "latency_report": """
      select slot, count(*) as calls, cast(sum(items) as bigint) as items,
        cast(sum(latencyMs) as bigint) as totalLatencyMs, max(latencyMs) as maxLatencyMs,
        max(latencyMs // items) as maxPerCommentMs,
        cast(sum(latencyMs) // sum(items) as bigint) as avgPerCommentMs
      from calls_log group by slot""",
    "slot_stats": """
      select slot, count(*) as calls, count(*) filter (status = 429) as errors
      from calls_log group by slot""",
    "event_throughput": """
      select events, round(elapsed, 3) as elapsedSeconds,
        round(events / greatest(elapsed, 0.001), 6) as eventsPerSecond
      from (
        select count(*) as events,
          (max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) / 1000 as elapsed
        from events)""",
    "throughput_per_minute": f"""
      select {_MINUTE} as minuteMs, count(*) as events from events group by 1""",
    "rate_budget_audit": f"""
      select slot, atMicros, callsAt, callsInWindow, oldestMicros,
        callsInWindow > {AUDIT_BUDGET} as overBudget,
        case when callsInWindow > {AUDIT_BUDGET}
             then {_WIDTH} - (atMicros - oldestMicros) + 100000 else 0 end as waitMicros
      from (
        select slot, atMicros, callsAt,
          cast(sum(callsAt) over w as bigint) as callsInWindow,
          min(atMicros) over w as oldestMicros
        from (select slot, atMicros, count(*) as callsAt from calls_log group by 1, 2)
        window w as (partition by slot order by atMicros
          range between {_WIDTH - 1} preceding and current row))""",
    "chunk_rows": """
      select event_id, event_type, (place - 1) // 10 as chunk, (place - 1) % 10 + 1 as pos,
        groupRows
      from (
        select event_id, event_type, row_number() over (partition by event_type
            order by md5(cast(event_id as varchar)), event_id) as place,
          count(*) over (partition by event_type) as groupRows
        from events)""",
    "strip_emoji": f"select id, {_emoji('text')} as text from all_texts",
    "mask_urls": f"select id, {_urls('text')} as text from all_texts",
    "strip_special": f"select id, {_special('text')} as text from all_texts",
    "collapse_whitespace": f"select id, {_collapse('text')} as text from all_texts",
    "clean_documents": f"""
      select doc_id, lang, source, cleaned, length(cleaned) as charCount,
        {_words("cleaned")} as wordCount
      from (select doc_id, lang, source, {_body("text")} as cleaned from documents)
      where length(cleaned) > 0""",
    "reply_ids": f"""
      select commentId, sha256(commentId || '|{PROVIDER_VERSION}') as replyId from clean""",
    "event_time": """
      select commentId, strftime(make_timestamp(createdAt * 1000), '%Y-%m-%d %H:%M:%S') as at
      from comments_table""",
    "relative_age": """
      select event_id, case when s < 60 then s || 's ago' when s < 3600 then (s // 60) || 'm ago'
        when s < 86400 then (s // 3600) || 'h ago' else (s // 86400) || 'd ago' end as age
      from (select event_id,
              cast(floor((1706745500000 - epoch_us(ts) // 1000) / 1000) as bigint) as s
            from events)""",
    "join_comment_list": _JOIN_LIST,
    "group_by_post_prefix": "select postKey, count(*) as items from keyed group by 1",
    "pack_calls": "select * from packed",
    "assign_slots": f"""
      select callId, kind, bucket, (row_number() over (
        partition by bucket order by md5(callId), callId) - 1 + bucket) % {KEY_SLOTS} as slot
      from calls""",
    "prompt_same_post": "select callId, size, prompt from prompts where kind = 'same_post'",
    "prompt_mixed": "select callId, size, prompt from prompts where kind = 'mixed_post'",
    "token_budget": f"select callId, kind, size, {_budget('kind', 'size')} as maxTokens from calls",
    "encode_items": "select id, "
    + _json(*[(c, c) for c in ("id", "post_text", "comment_text", "image_caption")])
    + " as body from items",
    "decode_item_replies": f"""
      select id, {_offline("id")} as generated_reply,
        case when {_bucket("id", 500)} % 3 <> 0 then {_bucket("id", 500)} else 0 end as latency_ms
      from items""",
    "bounded_calls": f"""
      select cause, count(*) as calls, cast(sum(attempts) as bigint) as attempts, true as waited, true as bounded
      from (select case {_bucket("first_id", 4)} when 0 then 'asked' when 1 then 'timeout'
              when 2 then 'refused' else 'ok' end as cause,
            case {_bucket("first_id", 4)} when 0 then 2 when 1 then 3 else 1 end as attempts from calls)
      group by 1""",
    "generate_replies": f"""
      select id, {_offline("id")} as generated_reply, 'ok' as status from items""",
    "retry_to_error_rows": f"""
      select p.id, case {_bucket("c.first_id", 4)}
          when 0 then '[Error: Inference failed after 3 retries: service unavailable]'
          when 1 then '[Error: '
            || substr('refused: ' || c.prompt, 1, {fixed.ERROR_PREFIX_CHARS}) || ']'
          else {_offline("p.id")} end as generated_reply,
        case when {_bucket("c.first_id", 4)} < 2 then 'error' else 'ok' end as status
      from packed p join prompts c on c.callId = p.callId""",
    "parse_numbered_replies": "select callId, place, number, reply from read_pieces",
    "parse_fallback": "select callId, pos, reply from parsed",
    "attach_parsed_replies": f"""
      select callId, pos, id, case when {_bucket("id", 6)} <> 0 then {_offline("id")}
        else '{fixed.REPLY_NOT_FOUND}' end as reply from packed""",
    "error_replies": "select * from failed_replies",
    "union_ok_and_error": """
      select p.id, a.reply as generated_reply, r.latencyMs // r.size as latency_ms, r.status
      from packed p join results r on r.callId = p.callId and r.status = 'ok'
      join parsed a on a.callId = p.callId and a.pos = p.pos
      union all select * from failed_replies""",
    "caption_missing": f"""
      select * replace (case when {_present("imageUrl")} and not ({_present("imageCaption")})
        then '{fixed.CAPTION_FALLBACK}' else imageCaption end as imageCaption)
      from posts_table""",
}

ORACLE = {name: f"{_CTES}\n{select}" for name, select in _SELECTS.items()}
