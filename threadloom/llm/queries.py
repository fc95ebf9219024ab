"""Registered queries of the operators and their SQL twins."""

from pyspark.sql import functions as F

from threadloom.llm import (
    chunks,
    decontaminate,
    fim,
    language,
    mixing,
    near_dup,
    nearest,
    outliers,
    quality,
    repair,
    toxicity,
    url_filter,
    warc,
)
from threadloom.llm.common import table
from threadloom.session import scratch_dir

QUERIES, ORACLE = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# --- 1: URL filter ------------------------------------------------------------

URL_RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}
URL_GLOBS = {
    "*casino**": "block",
    "*free-bets**": "block",
    "*cheap-pills**": "block",
    "*ads-track**": "block",
    "**/wp-login.*": "block",
    "**/tag/?*/page/**": "block",
}


@query
def op1_url_filter(spark, sf):
    return url_filter.filter_urls(table(spark, sf, "pages"), URL_RULES, URL_GLOBS)


ORACLE["op1_url_filter"] = r"""
with split as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
ruled as (
  select *, case
    when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/')
      then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/')
      then 'example.com/en/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/'
    end as rule
  from split)
select page_id, host, path, rule,
  case
    when rule in ('com/', 'www.example.com/en/') then 'allow'
    when rule is not null then 'block'
    when regexp_matches(host, 'casino|free-bets|cheap-pills|ads-track') then 'block'
    when regexp_matches(path, '(?s)/wp-login\.[^/]*$') then 'block'
    when regexp_matches(path, '(?s)/tag/[^/]+/page/') then 'block'
    else 'allow' end as verdict
from ruled
"""


# --- 2: benchmark decontamination ---------------------------------------------


@query
def op2_decontaminate(spark, sf):
    found = decontaminate.match_benchmark(
        table(spark, sf, "documents"), table(spark, sf, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        F.size("words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        decontaminate.item_digest(F.col("items")).alias("items_sha256"),
        (F.size("words") > 0).alias("contaminated"),
    )


ORACLE["op2_decontaminate"] = r"""
with doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
windows as (
  select distinct item_id, size, array_to_string(words[i:i + size - 1], ' ') as gram
  from (select item_id, words, least(10, len(words)) as size,
    unnest(range(1, len(words) - least(10, len(words)) + 2)) as i
    from item_words where len(words) > 0)),
grams as (
  select doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') as gram
  from (select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as i
    from doc_words cross join (select distinct size from windows) where len(words) >= size)),
hits as (
  select doc_id, item_id, i, g.size from grams g join windows w on g.gram = w.gram and g.size = w.size),
hit_words as (
  select doc_id, count(distinct pos) as n_hit
  from (select doc_id, unnest(range(i, i + size)) as pos from hits) group by doc_id),
hit_items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, cast(len(d.words) as bigint) as n_words,
  cast(coalesce(w.n_hit, 0) as bigint) as n_hit, cast(coalesce(i.n_items, 0) as bigint) as n_items,
  sha256(coalesce(i.ids, '')) as items_sha256, coalesce(w.n_hit, 0) > 0 as contaminated
from doc_words d left join hit_words w on w.doc_id = d.doc_id
  left join hit_items i on i.doc_id = d.doc_id
"""


# --- 3, 4: classifiers ---------------------------------------------------------


@query
def op3_toxicity(spark, sf):
    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op4_quality_classifier(spark, sf):
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


# --- 10: language --------------------------------------------------------------


@query
def op10_language_id(spark, sf):
    return language.identify(table(spark, sf, "documents"))


# --- 7: WARC --------------------------------------------------------------------


@query
def op7_warc(spark, sf):
    path = scratch_dir(spark, "warc")
    warc.write_archive(table(spark, sf, "pages"), path)
    return warc.read_archive(spark, path).select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
        "intact",
    )


ORACLE["op7_warc"] = """
with hashed as (
  select page_id, octet_length(encode(coalesce(html, ''))) as size,
    sha256(coalesce(html, '')) as digest from pages),
firsts as (select digest, min(page_id) as first from hashed where size >= 100 group by digest)
select page_id, cast(size as bigint) as payload_bytes, hashed.digest as payload_digest,
  case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to, true as intact
from hashed left join firsts on firsts.digest = hashed.digest and size >= 100
"""


# --- 8: quality rules -----------------------------------------------------------


@query
def op8_quality_rules(spark, sf):
    return outliers.judge(table(spark, sf, "documents"))


# --- 5: substring dedup ---------------------------------------------------------


@query
def op5_substring_dedup(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return chunks.dedupe_substrings(documents)


# --- 9: near duplicates ---------------------------------------------------------


@query
def op9_near_dup(spark, sf):
    return near_dup.group_documents(table(spark, sf, "documents"))


# --- 6: mixing ------------------------------------------------------------------


@query
def op6_mixing(spark, sf):
    labelled = mixing.quality_domains(table(spark, sf, "labels"))
    return mixing.mix(table(spark, sf, "documents"), labelled, mixing.TARGETS)


ORACLE["op9_near_dup"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id
  having 100 * count(*) >= 85 * ((select n from sizes where doc_id = a.doc_id)
    + (select n from sizes where doc_id = b.doc_id) - count(*))),
both_ways as (select a, b from links union select b, a from links),
reach(doc, node) as (
  select a, b from both_ways
  union select reach.doc, both_ways.b from reach join both_ways on reach.node = both_ways.a),
roots as (select doc, min(node) as low from reach group by doc)
select w.doc_id, cast(coalesce(sizes.n, 0) as bigint) as n_shingles,
  coalesce(least(roots.low, w.doc_id), w.doc_id) as component_id,
  coalesce(least(roots.low, w.doc_id), w.doc_id) = w.doc_id as kept
from words w left join sizes on sizes.doc_id = w.doc_id left join roots on roots.doc = w.doc_id
"""


# --- 11: conversation structure repair --------------------------------------------


@query
def op11_repair(spark, sf):
    return repair.repair(table(spark, sf, "conversations"))


# --- 12: nearest neighbours --------------------------------------------------------


@query
def op12_nearest(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return nearest.search(vectors, vectors.filter("vec_id % 20 = 0"), 20)


# --- 13: fill-in-middle ------------------------------------------------------------


@query
def op13_fill_in_middle(spark, sf):
    formed = fim.transform(table(spark, sf, "documents").select("doc_id", "text"))
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE["op13_fill_in_middle"] = r"""
with units as (
  select doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
    sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (
  select *, len(u) as n,
    cast(cast('0x' || h[1:8] as bigint) % (len(u) + 1) as bigint) as a,
    cast(cast('0x' || h[9:16] as bigint) % (len(u) + 1) as bigint) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
        or cast('0x' || h[17:24] as bigint) % 100 >= 90 then 'plain'
      when cast('0x' || h[25:32] as bigint) % 100 < 20 then 'spm' else 'psm' end as form
  from units),
parts as (
  select doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') as p,
    array_to_string(u[least(a, b) + 1:greatest(a, b)], '') as m,
    array_to_string(u[greatest(a, b) + 1:], '') as s
  from drawn)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""
