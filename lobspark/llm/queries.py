"""The queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.llm import (
    chat_format,
    jaccard_join,
    line_dedup,
    lm_scoring,
    mixing,
    quality,
    sentencepiece_codec,
    sharding,
    topk_search,
    url_filters,
)
from lobspark.llm.common import documents


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_scoring.score_texts(docs, held_out)


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated host list for pages, made by rule: a stand-in for a published list.

    A quarter of the hosts is listed for 90 days, and for another quarter the parent
    domain is listed without end.
    """
    hosts = pages.select(url_filters.host(F.col("url")).alias("host")).where("host is not null").distinct()
    draw = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 8), 16, 10).cast("long")
    hosts = hosts.withColumn("draw", draw)
    start = (F.col("draw") / 4).cast("long") % 200
    row = lambda domain, at, action, reason: F.struct(
        domain.alias("domain"), at.alias("at"), F.lit(action).alias("action"), F.lit(reason).alias("reason")
    )
    own = F.array(row(F.col("host"), start, "add", "host"), row(F.col("host"), start + 90, "remove", "host"))
    above = F.array(row(F.regexp_replace("host", r"^[^.]*\.", ""), start, "add", "domain"))
    made = F.when(F.col("draw") % 4 == 0, own).when((F.col("draw") % 4 == 1) & (F.size(F.split("host", r"\.")) > 2), above)
    return hosts.select(F.explode(made).alias("x")).select("x.*")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.col("page_id") % 365)
    judged = url_filters.evaluate(captures, list_entries(pages))
    return judged.select("page_id", "host", "fetched_at", "blocked", "blocked_by", "reason")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(documents(spark, sf_dir))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "line_chars", "kept_chars",
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar(documents(spark, sf_dir), n=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    formatted = chat_format.format_conversations(turns.union(own))
    return chat_format.digests(formatted).drop("mask_chars")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), n_shards=24)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.round_trip(documents(spark, sf_dir).select("doc_id", "text"))
    return coded.select("doc_id", "n_tokens", "ids", "exact")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(documents(spark, sf_dir))
    clean = F.md5(F.coalesce("clean_text", F.lit("")).cast("binary"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "removed_chars", clean.alias("clean_md5"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_search.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_url_filters, op3_mixing, op4_quality_rules, op5_jaccard_join, op6_chat_format,
        op7_sharding, op8_sentencepiece, op9_line_dedup, op10_topk_search,
    )
}

_RUN = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce({{}}, ''), '{_RUN}'), lambda w: w <> '')"
_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_ENDS = ", ".join("'" + c.replace("'", "''") + "'" for c in quality.TERMINAL)
#: Written for this SQL by hand, without a look at the operator's patterns.
_PROSE_TOO = ["cookies", "cookie policy", "cookie settings", "javascript", "privacy policy", "terms of use", "terms of service", "click here", "sign up", "sign in", "log in", "subscribe", "newsletter", "powered by"]
_TWO = " + ".join(f"regexp_matches({{0}}, '\\b{x}\\b')::int" for x in _PROSE_TOO)
_FURNITURE = (
    "regexp_matches({0}, '\\b(all rights reserved|lorem ipsum|powered by wordpress)\\b')"
    " or len(regexp_extract_all(' ' || {0} || ' ', '\\s[|»]\\s')) > 1 or " + f"{_TWO} > 1"
    " or regexp_full_match({0}, '(home|menu|next|previous|back to top|share|login|log in)\\s*([|>»].*)?')"
)

ORACLE = {
    "op2_url_filters": r"""
with hosted as (
  select page_id, page_id % 365 as fetched_at, nullif(regexp_replace(lower(regexp_extract(url,
    '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '') as host from pages),
drawn as (select host, ('0x' || md5(host)[1:8])::bigint as draw from (select distinct host from hosted where host is not null)),
made as (
  select host as domain, (draw // 4) % 200 as a, (draw // 4) % 200 + 90 as b, 'host' as reason from drawn where draw % 4 = 0
  union all
  select regexp_replace(host, '^[^.]*\.', ''), (draw // 4) % 200, null, 'domain' from drawn
  where draw % 4 = 1 and len(string_split(host, '.')) > 2),
events as (select domain, a as day, 0 as closes, reason from made union all select domain, b, 1, reason from made where b is not null),
dated as (select domain, day, max(closes) as closes, min(reason) as reason from events group by all),
turned as (select *, lag(closes) over (partition by domain order by day) as was from dated),
kept as (select * from turned where was is null or was <> closes),
spans as (select *, lead(day) over (partition by domain order by day) as until from kept),
valid as (select domain, day, until, reason from spans where closes = 0),
looked as (
  select h.page_id, v.domain, v.reason, row_number() over (partition by h.page_id order by length(v.domain) desc) as r
  from hosted h join valid v on (h.host = v.domain or (contains(v.domain, '.') and suffix(h.host, '.' || v.domain)))
    and h.fetched_at >= v.day and (v.until is null or h.fetched_at < v.until))
select h.page_id, h.host, h.fetched_at, l.domain is not null as blocked, l.domain as blocked_by, l.reason
from hosted h left join looked l on l.page_id = h.page_id and l.r = 1
""",
    "op4_quality_rules": f"""
with d as (
  select doc_id, row_number() over () as id, coalesce(text, '') as text, {_WORDS.format('text')} as w,
    string_split(coalesce(text, ''), chr(10)) as ls from documents),
wins as (select id, i, array_to_string(w[i:i + 7], ' ') as g from (select id, w, unnest(range(1, len(w) - 6)) as i from d)),
twice as (select id, i from (select id, i, count(*) over (partition by id, g) as n from wins) where n > 1),
steps as (select id, least(8, coalesce(lead(i) over (partition by id order by i) - i, 8)) as s from twice),
rep as (select id, sum(s)::bigint as n_repeat_words from steps group by id),
m as (
  select d.id, doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(list_filter(ls, lambda x: {_TRIM.format('x')} <> ''))
      - len(list_distinct(list_filter(ls, lambda x: {_TRIM.format('x')} <> ''))))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words,
    length(array_to_string(ls, ''))::bigint as line_chars,
    length(array_to_string(list_filter(ls, lambda x: {_TRIM.format('x')} = '' or (
      {_TRIM.format('x')}[-1] in ({_ENDS})
      and not (length({_TRIM.format('x')}) < 200 and ({_FURNITURE.format("lower(" + _TRIM.format('x') + ")")})))), ''))::bigint as kept_chars
  from d left join rep on rep.id = d.id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not (100 * (line_chars - kept_chars) > 50 * line_chars) as kept,
  line_chars, kept_chars
from m
""",
    "op5_jaccard_join": f"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_RUN}'), lambda w: w <> '') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
edges as (select a, b from link union select b, a from link),
reach(a, b) as (select doc_id, doc_id from d union select r.a, e.b from reach r join edges e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(b) from reach where reach.a = d.doc_id) as component_id
from d left join n on n.doc_id = d.doc_id
""",
    "op6_chat_format": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, lag(role) over w as before, lead(role) over w as after, row_number() over w as r from t window w as (partition by conv_id order by turn nulls first, role, text)),
e as (select *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') as safe,
  replace(replace(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') as safe_role from o)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by r)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by r) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(safe) + case when before = role then 7 else 17 + length(safe_role) end + case when after = role then 0 else 7 end)::bigint as formatted_chars
from e group by conv_id
""",
    "op9_line_dedup": r"""
with d as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
u as (select distinct doc_id, text, ls from d),
l as (select doc_id, text, i, ls[i] as line, len(string_split(ls[i], ' ')) >= 50 as long, ('0x' || md5(ls[i])[1:8])::bigint as h
  from (select *, unnest(range(1, len(ls) + 1)) as i from u)),
b as (select *, lag(h, 2, 0) over w as h2, lag(h) over w as h1, lag(long) over w as long1 from l window w as (partition by doc_id, text order by i)),
s as (select *, case when i = 1 or (h2 * 31 + h1) % 3 = 0 or long or long1 then 1 else 0 end as starts from b),
c as (select *, sum(starts) over (partition by doc_id, text order by i) as chunk from s),
p as (select doc_id, text, chunk, string_agg(line, chr(10) order by i) as body, count(*) as n,
    count(*) filter (trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') >= 2 or bool_or(long) as fit
  from c group by 1, 2, 3),
k as (select *, row_number() over (partition by body order by doc_id, chunk) as r from p where fit),
left_over as (select p.doc_id, p.text, string_agg(p.body, chr(10) order by p.chunk) filter (k.r is null or k.r = 1) as clean,
    coalesce(sum(p.n) filter (k.r > 1), 0) as gone
  from p left join k on k.doc_id = p.doc_id and k.text = p.text and k.chunk = p.chunk group by 1, 2)
select d.doc_id, coalesce(len(d.ls), 0)::bigint as n_lines, coalesce(gone, 0)::bigint as n_removed_lines,
  coalesce(length(d.text) - length(coalesce(clean, '')), 0)::bigint as removed_chars, md5(coalesce(clean, '')) as clean_md5
from d left join left_over o on o.doc_id = d.doc_id and o.text = d.text
""",
    "op10_topk_search": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
""",
}
