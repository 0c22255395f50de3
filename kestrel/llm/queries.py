"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import (
    collocations, decontam, langid, linededup, maxscore, pieces, pitmanyor, quality, revisit, simhash, spans, toxicity, whitening)

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line with words: its class, the class's links, and whether the line goes."""
    return linededup.remove_marks(table(spark, sf_dir, "documents")).drop("rid")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), k=4, bits=4)


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures derived from ``pages``: the page number is the time, a digest of it the kind and the validators."""
    page = F.col("page_id")
    revisited = F.substring(F.md5(page.cast("string").cast("binary")), 1, 1).isin("0", "1", "2", "3", "4")
    etag = F.when(page % 5 != 0, F.concat(F.when(page % 2 == 0, "W/").otherwise(""), F.substring(F.md5((page % 3).cast("string").cast("binary")), 1, 8)))
    day = F.when((page % 5 == 0) | (page % 7 == 0), F.concat(F.lit("day "), (page % 4).cast("string")))
    headers = F.create_map(
        F.lit("ETag"), etag, F.lit("Last-Modified"), day, F.lit("Cache-Control"), F.concat(F.lit("max-age="), (page % 100).cast("string")),
        F.lit("Content-Length"), F.when(revisited, "0").otherwise(F.length("html").cast("string")))
    captures = table(spark, sf_dir, "pages").select(
        page.alias("record_id"), F.regexp_replace("url", "[0-9]{2}([?#.].*)?$", "$1").alias("url"), page.alias("ts"),
        F.when(revisited, "revisit").otherwise("response").alias("kind"), headers.alias("headers"))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return revisit.resolve(captures).withColumn("headers", F.array_join(lines, "\n"))


OP5_SQL = r"""
with base as (
  select page_id, page_id p, length(html) n, regexp_replace(url, '[0-9]{2}([?#.].*)?$', '\1') url,
         substr(md5(page_id::varchar), 1, 1) in ('0', '1', '2', '3', '4') revisited from pages),
parts as (
  select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i') rest from base),
keyed as (
  select page_id, revisited,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^.*@', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') as bare,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
      lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) as kept,
    case when p % 5 <> 0 then case when p % 2 = 0 then 'W/' else '' end || substr(md5((p % 3)::varchar), 1, 8) end as etag,
    case when p % 5 = 0 or p % 7 = 0 then 'day ' || (p % 4) end as day,
    'max-age=' || (p % 100) as cache, case when revisited then '0' else n::varchar end as size from parts),
rows as (
  select *, bare || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as url_key,
    case when not revisited then {'id': page_id, 'etag': etag, 'day': day, 'cache': cache, 'size': size} end as full_one from keyed),
found as (
  select *, last_value(full_one ignore nulls) over (partition by url_key order by page_id rows between unbounded preceding and 1 preceding) as t from rows),
judged as (
  select page_id, url_key, t.id as target_id, t, etag, day, cache, size,
    case when t is null then 'missing'
         when t.etag is not null and etag is not null then case when regexp_replace(t.etag, '^W/', '') = regexp_replace(etag, '^W/', '') then 'resolved' else 'changed' end
         when t.day is not null and day is not null then case when t.day = day then 'resolved' else 'changed' end
         else 'unchecked' end as outcome from found where revisited),
merged as (
  select *, outcome in ('resolved', 'unchecked') as m from judged)
select page_id as record_id, url_key, target_id, outcome,
  concat_ws(chr(10), 'cache-control: ' || cache, 'content-length: ' || case when m then t.size else size end,
    'etag: ' || case when m then coalesce(etag, t.etag) else etag end,
    'last-modified: ' || case when m then coalesce(day, t.day) else day end) as headers
from merged
"""


def op6_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose sentences."""
    cut = spans.remove_repeats(table(spark, sf_dir, "documents"), span=None).where(F.size("removed") > 0)
    return cut.select("doc_id", "n_sentences", "removed", "first_docs", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), every=50, top=5)


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item found in it."""
    found = decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", toxicity.crc_mod("doc_id", 3) == 1)
    return toxicity.score(docs, table(spark, sf_dir, "labels"), keep=("doc_id", "held_out"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^ \t]+') as w from p),
g as (
  select lang, 1 as size, unnest(w) as phrase from w
  union all select lang, 2, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda x: x[1] || ' ' || x[2])) from w where len(w) >= 2
  union all select lang, 3, unnest(list_transform(list_zip(w[1:len(w) - 2], w[2:len(w) - 1], w[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3])) from w where len(w) >= 3),
f as (select lang, size, phrase, count(*) as f from g group by all),
t as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
c as (select *, string_split(phrase, ' ') as w from f where size > 1 and f >= 10),
long as (
  select lang, phrase, max(f) as f from (
    select lang, w[1] || ' ' || w[2] as phrase, f from c where size = 3 union all select lang, w[2] || ' ' || w[3], f from c where size = 3) group by all),
k as (
  select c.lang, c.phrase, c.f as a, unnest(case when size = 2 then [{'k': 1, 'x': w[1], 'y': w[2]}] else [{'k': 1, 'x': w[1], 'y': w[2] || ' ' || w[3]}, {'k': 2, 'x': w[1] || ' ' || w[2], 'y': w[3]}] end, recursive := true)
  from c left join long using (lang, phrase) where long.f is null or 100 * long.f < 50 * c.f),
s as (
  select k.lang, k.phrase, k.a, k.k, l.f as l, r.f as r, ((1000000::hugeint * k.a * k.a) // (l.f::hugeint * r.f))::bigint as score
  from k join f l on l.lang = k.lang and l.phrase = k.x join f r on r.lang = k.lang and r.phrase = k.y),
o as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from o join t using (lang)
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("level", "failed")


OP12_SQL = r"""
with d as (select doc_id, lang, source, row_number() over () as i, coalesce(text, '') as t from documents),
m as (
  select *, regexp_extract_all(t, '[^ \t\n\v\f\r]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) as l from d),
g as (select i, unnest(range(1, len(w) - 1)) as p, unnest(list_zip(w[1:len(w) - 2], w[2:len(w) - 1], w[3:])) as x from m where len(w) >= 3),
r as (select i, p, count(*) over (partition by i, x) as k from g),
s as (select i, sum(least(3, coalesce(q - p, 3))) as n from (select i, p, lead(p) over (partition by i order by p) as q from r where k > 1) group by i),
c as (
  select doc_id, lang, source, m.i, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
    len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(s.n, 0)::bigint as n_repeat_words from m left join s using (i)),
b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    case when word_chars > 0 then 1000 * n_symbols // word_chars else 0 end as symbol_rate, case when n_lines > 0 then 1000 * n_dup_lines // n_lines else 0 end as dup_line_rate,
    case when n_words > 0 then 1000 * n_repeat_words // n_words else 0 end as repeat_rate, case when n_words > 0 then 1000 * word_chars // n_words else 0 end as word_length from c),
v as (
  select i, lang, source, unnest([{'rate': 'symbol_rate', 'v': symbol_rate, 'least': 25, 'low': false}, {'rate': 'dup_line_rate', 'v': dup_line_rate, 'least': 100, 'low': false},
    {'rate': 'repeat_rate', 'v': repeat_rate, 'least': 100, 'low': false}, {'rate': 'word_length', 'v': word_length, 'least': 500, 'low': true}], recursive := true) from b where not base_failed),
k as (select lang, source, rate, least, low, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) as bucket from v),
lv as (select lang, source, 2 as level, * exclude (lang, source) from k union all select lang, null, 1, * exclude (lang, source) from k union all select null, null, 0, * exclude (lang, source) from k),
h as (select lang, source, level, rate, least, low, bucket, count(*) as n from lv group by all),
u as (select *, sum(n) over (partition by lang, source, level, rate) as total, sum(n) over (partition by lang, source, level, rate order by bucket) as seen from h),
q as (
  select lang, source, level, rate, least, low, max(total) as total, min(bucket) filter (100 * seen >= 10 * total) as lo,
    min(bucket) filter (100 * seen >= 50 * total) as mid, min(bucket) filter (100 * seen >= 90 * total) as hi from u group by all),
f as (select lang, source, level, rate, hi + 3 * greatest(hi - mid, least) as hi, case when low then lo - 3 * greatest(mid - lo, least) else -1 end as lo from q where total >= 100),
e as (
  select v.i, v.rate, v.v, f.lo, f.hi, f.level, row_number() over (partition by v.i, v.rate order by f.level desc) as o from (
    select i, lang, source, unnest([{'rate': 'symbol_rate', 'v': symbol_rate}, {'rate': 'dup_line_rate', 'v': dup_line_rate}, {'rate': 'repeat_rate', 'v': repeat_rate}, {'rate': 'word_length', 'v': word_length}], recursive := true) from b) v
  join f on f.rate = v.rate and (f.level = 0 or f.lang is not distinct from v.lang and (f.level = 1 or f.source is not distinct from v.source))),
z as (select i, max(level) as level, bool_or(v > hi or v < lo) as failed from e where o = 1 group by i)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, symbol_rate, dup_line_rate, repeat_rate, word_length, base_failed,
  not base_failed and not coalesce(failed, false) as kept from b left join z using (i)
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


OP2_SQL = r"""
with l as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no, unnest(string_split(text, chr(10))) as line from documents),
s as (
  select doc_id, line_no, line, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[\t\x0b\x0c\r ]'), lambda w: w <> ''))) as ws from l),
c as (
  select line, any_value(ws) as ws, min((doc_id, line_no)) as f, row_number() over (order by line) as c from s where len(ws) > 0 group by line),
t as (select c, len(ws) as n, unnest(ws) as w from c),
d as (select w, count(*) as k from t group by w),
p as (select c, n, w, row_number() over (partition by c order by k, w) as at from t join d using (w)),
x as (
  select distinct a.c as p, b.c as q from p a join p b using (w)
  where a.at <= a.n - ceil(0.8 * a.n - 1e-9) + 1 and b.at <= b.n - ceil(0.8 * b.n - 1e-9) + 1 and a.c < b.c
    and a.n >= 0.8 * b.n - 1e-9 and b.n >= 0.8 * a.n - 1e-9),
y as (
  select p, q, a.f as fa, b.f as fb, len(list_intersect(a.ws, b.ws)) as o, len(a.ws) + len(b.ws) as n
  from x join c a on a.c = p join c b on b.c = q),
e as (
  select p as c, fb < fa as late from y where o >= 0.8 * (n - o) - 1e-9 union all
  select q, fa < fb from y where o >= 0.8 * (n - o) - 1e-9),
g as (select c, count(*) as n_links, bool_or(late) as late from e group by c)
select s.doc_id, s.line_no::int as line_no, c.f[1] as class_doc, c.f[2]::int as class_line, coalesce(g.n_links, 0)::bigint as n_links,
  coalesce(g.late, false) or (s.doc_id, s.line_no) <> c.f as removed
from s join c on s.line = c.line left join g on g.c = c.c where len(s.ws) > 0
"""

QUERIES = {f.__name__: f for f in (
    op1_pitman_yor, op2_line_dedup, op3_language_id, op4_simhash, op5_revisits, op6_span_dedup,
    op7_sentencepiece, op8_maxscore, op9_decontamination, op10_toxicity, op11_collocations, op12_quality_rules, op13_whitening)}
SQL = {"op2_line_dedup": OP2_SQL, "op5_revisits": OP5_SQL, "op8_maxscore": OP8_SQL, "op11_collocations": OP11_SQL, "op12_quality_rules": OP12_SQL}
