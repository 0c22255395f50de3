"""Queries: posting ingest, cleaning and model-input assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.codebook import DISPLAY_NAMES
from kestrel.functions import text as T
from kestrel.operators import postings as P
from kestrel.plans import fixtures as X
from kestrel.plans.catalogue import query
from kestrel.plans.sqlparts import DETAIL, POST

PARAM_LABELS = ["Thương hiệu", "Loại", "Kích thước"]
VOCAB_K = 1000
PAD_LEN = 64


@query("valid_posters", f"""WITH {DETAIL}
SELECT id, user_id FROM det WHERE user_id IS NOT NULL AND user_id <> 0""")
def valid_posters_q(spark, sf):
    return P.valid_posters(X.part_details(spark, sf)).select("id", "user_id")


@query("phone_normalise", f"""WITH {DETAIL}
SELECT id, replace(replace('0' || coalesce(phone, 'nan'), '0nan', ''), '.0', '') AS phone FROM det""")
def phone_normalise_q(spark, sf):
    d = X.part_details(spark, sf)
    return d.select("id", T.phone_normalise("phone").alias("phone"))


@query("params_to_columns", f"""WITH {DETAIL}
SELECT id, p_brand AS "Thương hiệu", CASE WHEN id % 3 = 0 THEN p_name ELSE p_type END AS "Loại",
       CAST(p_size AS VARCHAR) AS "Kích thước" FROM det""")
def params_to_columns_q(spark, sf):
    d = X.part_details(spark, sf).select("id", "parameters")
    return P.params_to_columns(d, "parameters", PARAM_LABELS)


@query("params_discovered", f"""WITH {DETAIL}
SELECT id, CAST(p_size AS VARCHAR) AS "Kích thước", CASE WHEN id % 3 = 0 THEN p_name ELSE p_type END AS "Loại",
       p_brand AS "Thương hiệu" FROM det""")
def params_discovered_q(spark, sf):
    d = X.part_details(spark, sf).select("id", "parameters")
    return P.params_to_columns(d, "parameters")


_SAL = """m AS (SELECT id, price_display,
  regexp_extract_all(price_display, '\\d{1,3}(?:\\.\\d{3})*') AS a FROM det),
s AS (SELECT id, price_display,
  CASE WHEN price_display = 'Thỏa thuận' THEN NULL WHEN len(a) = 2 THEN a[1]
       WHEN contains(price_display, 'Từ') THEN a[1] END AS min_salary,
  CASE WHEN price_display = 'Thỏa thuận' THEN NULL WHEN len(a) = 2 THEN a[2]
       WHEN contains(price_display, 'Từ') THEN NULL WHEN contains(price_display, 'Đến') THEN a[1] END AS max_salary
  FROM m)"""


@query("salary_range", f"""WITH {DETAIL}, {_SAL}
SELECT id, price_display, min_salary, max_salary,
       CAST(replace(min_salary, '.', '') AS BIGINT) AS min_amount,
       CAST(replace(max_salary, '.', '') AS BIGINT) AS max_amount FROM s""")
def salary_range_q(spark, sf):
    d = X.part_details(spark, sf).select("id", "price_display")
    return P.with_salary(d)


@query("posting_with_poster", f"""WITH {DETAIL}
SELECT d.id, d.user_id, d.title, s.s_name AS poster_name, n.n_name AS poster_location
FROM det d LEFT JOIN supplier s ON d.user_id = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
WHERE d.user_id IS NOT NULL AND d.user_id <> 0""")
def posting_with_poster_q(spark, sf):
    d = P.valid_posters(X.part_details(spark, sf)).select("id", "user_id", "title")
    j = P.posting_with_poster(d, X.posters(spark, sf).select("id", "name", "location"))
    return j.select("id", "user_id", "title", "poster_name", "poster_location")


@query("crawled_layout", f"""WITH {DETAIL}
SELECT d.user_id, d.title AS "Tiêu đề", d.phone AS "Số điện thoại liên lạc", s.s_suppkey AS "ID người đăng", s.s_name AS "Tên người đăng",
       '0' || s.s_suppkey AS "Số điện thoại người đăng", 'user/' || s.s_suppkey AS "URL người đăng", d.id
FROM det d LEFT JOIN supplier s ON d.user_id = s.s_suppkey""")
def crawled_layout_q(spark, sf):
    """Posting details with a six-column profile of their poster, named by position and laid out in groups."""
    key = F.col("id").cast("string")
    profile = X.posters(spark, sf).select("id", "name", F.concat(F.lit("0"), key).alias("phone"), F.concat(F.lit("user/"), key).alias("url"),
                                          F.col("location").alias("created"), F.col("balance").alias("ad"), F.lit(1).alias("total"))
    return P.crawled_layout(X.part_details(spark, sf), profile, keep=["user_id"])


@query("null_policy", f"""WITH {POST}
SELECT recruitment_id, label, explanation FROM post2 WHERE explanation IS NOT NULL""")
def null_policy_q(spark, sf):
    return P.null_policy(X.postings(spark, sf), "train").select("recruitment_id", "label", "explanation")


@query("null_policy_fill", f"""WITH {POST}
SELECT recruitment_id, coalesce(explanation, '') AS explanation FROM post2""")
def null_policy_fill_q(spark, sf):
    return P.null_policy(X.postings(spark, sf), "predict").select("recruitment_id", "explanation")


@query("posting_layout", f"""WITH {POST}
SELECT recruitment_id, title AS "Tiêu đề", body AS "Mô tả", company_name AS "Tên công ty",
       vacancy AS "Số lượng tuyển dụng" FROM post""")
def posting_layout_q(spark, sf):
    p = X.postings(spark, sf)
    return P.posting_layout(p, drop=["label", "explanation", "not_there"], keep=["recruitment_id"])


_ASM = """'[CLS]' || ' Tiêu đề: ' || coalesce(replace(title, '<br />', ' '), 'nan') || ' [SEP] '
  || ' Mô tả: ' || coalesce(replace(body, '<br />', ' '), 'nan') || ' [SEP] '
  || ' Tên công ty: ' || coalesce(replace(company_name, '<br />', ' '), 'nan') || ' [SEP] '
  || ' Số lượng tuyển dụng: ' || coalesce(CAST(vacancy AS VARCHAR), 'nan') || ' [SEP] '"""


@query("assemble_text", f"""WITH {POST}
SELECT recruitment_id, {_ASM} AS text FROM post""")
def assemble_text_q(spark, sf):
    p = X.postings(spark, sf)
    lay = P.posting_layout(p, drop=["label", "explanation"], keep=["recruitment_id"])
    cols = [DISPLAY_NAMES[c] for c in ("title", "body", "company_name", "vacancy")]
    return lay.select("recruitment_id", P.assemble_text(lay, cols).alias("text"))


_OFF = """'[CLS] ' || 'tiêu đề: ' || coalesce(title, 'nan') || ' [SEP] '
  || 'ngành nghề: ' || coalesce(company_name, 'nan') || ' [SEP] '
  || 'mô tả: ' || coalesce(body, 'nan') || ' [SEP] '
  || 'kinh nghiệm: ' || coalesce(CAST(vacancy AS VARCHAR), 'nan') || ' [SEP]'"""
_OFF_COLS = ["title", "company_name", "body", "vacancy"]


@query("assemble_text_offline", f"""WITH {POST}
SELECT recruitment_id, {_OFF} AS text FROM post""")
def assemble_text_offline_q(spark, sf):
    p = X.postings(spark, sf)
    return p.select("recruitment_id", P.assemble_text_offline(_OFF_COLS).alias("text"))


@query("special_tokens", f"""WITH {POST}
SELECT recruitment_id, replace(replace({_OFF}, '[CLS]', '<s>'), '[SEP]', '</s>') AS roberta,
       replace({_OFF}, '[CLS]', '') AS no_cls FROM post""")
def special_tokens_q(spark, sf):
    p = X.postings(spark, sf)
    t = P.assemble_text_offline(_OFF_COLS)
    return p.select("recruitment_id", T.special_tokens(t, "roberta").alias("roberta"),
                    T.special_tokens(t, "no_cls").alias("no_cls"))


_TOK = ("list_filter(regexp_split_to_array(body, '" + r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
        r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+" + "'), lambda x: x <> '')")
_VOCAB = f"""vocab AS (
  SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS id
  FROM (SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({_TOK}) AS token FROM post)
        GROUP BY token ORDER BY n DESC, token LIMIT {VOCAB_K}))"""


@query("vocab_topk", f"""WITH {POST}, {_VOCAB}
SELECT token, n, id FROM vocab""")
def vocab_topk_q(spark, sf):
    return P.vocab_topk(X.postings(spark, sf), "body", VOCAB_K)


@query("pad_tokens", f"""WITH {POST}, {_VOCAB},
t AS (SELECT recruitment_id, ({_TOK})[1:{PAD_LEN}] AS toks FROM post),
u AS (SELECT recruitment_id, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS pos FROM t),
ids AS (SELECT u.recruitment_id, list(coalesce(v.id, 1) ORDER BY u.pos) AS ids
        FROM u LEFT JOIN vocab v ON u.token = v.token GROUP BY u.recruitment_id),
a AS (SELECT t.recruitment_id, coalesce(ids.ids, []) AS ids FROM t LEFT JOIN ids USING (recruitment_id))
SELECT recruitment_id, array_to_string(list_resize(ids, {PAD_LEN}, 0), ',') AS input_ids,
       array_to_string(list_resize(list_transform(ids, lambda x: 1), {PAD_LEN}, 0), ',') AS attention_mask
FROM a""")
def pad_tokens_q(spark, sf):
    p = X.postings(spark, sf)
    vocab = P.vocab_topk(p, "body", VOCAB_K)
    out = P.pad_tokens(p, "body", vocab, PAD_LEN, "recruitment_id")
    return out.select("recruitment_id", F.array_join("input_ids", ",").alias("input_ids"),
                      F.array_join("attention_mask", ",").alias("attention_mask"))


# fixed values for the SQL: the markup-significant and the most common named
# entities, and &#39; (the given pages hold no others)
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "amp": "&",
            "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122",
            "middot": "\u00b7", "bull": "\u2022", "hellip": "\u2026", "ndash": "\u2013",
            "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c",
            "rdquo": "\u201d", "laquo": "\u00ab", "raquo": "\u00bb", "euro": "\u20ac",
            "deg": "\u00b0", "times": "\u00d7"}
# of those, the names HTML also accepts without the closing semicolon
LEGACY_NAMES = ["amp", "lt", "gt", "quot", "nbsp", "copy", "reg", "middot", "laquo", "raquo", "deg", "times"]

# boundary mark the SQL leaves where markup was removed (a private-use character)
BOUNDARY = "\ue000"


def entity_rules() -> list[tuple[str, str]]:
    """``(prefix after '&', replacement)`` in matching order: with ';' first, longest first."""
    semi = sorted(((f"{n};", ch) for n, ch in ENTITIES.items()), key=lambda r: -len(r[0]))
    bare = sorted(((n, ENTITIES[n]) for n in LEGACY_NAMES), key=lambda r: -len(r[0]))
    return semi + bare + [("#39", "'")]


_HTML_CHAIN = r"""regexp_replace(regexp_replace(regexp_replace({x}, '[\t\n]', ' ', 'g'),
  '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', '{b}', 'g'),
  '<[A-Za-z/!?][^>]*>', '{b}', 'g')"""


def _unescape_sql(x: str) -> str:
    """One left-to-right entity pass, the SQL twin of ``functions.text._unescape``."""
    def q(v):
        return v.replace("'", "''")
    cases = " ".join(f"WHEN starts_with(p, '{q(pre)}') THEN '{q(ch)}' || substr(p, {len(pre) + 1})"
                     for pre, ch in entity_rules())
    return (f"list_first(string_split({x}, '&')) || array_to_string(list_transform("
            f"string_split({x}, '&')[2:], lambda p: CASE {cases} ELSE '&' || p END), '')")


def _html_ctes(src: str, key: str, col: str) -> str:
    """CTEs h0 (tags removed), h1, h2 (two entity passes) over ``src``."""
    return (f"h0 AS (SELECT {key}, {_HTML_CHAIN.format(x=col, b=BOUNDARY)} AS x FROM {src}),\n"
            f"h1 AS (SELECT {key}, replace({_unescape_sql('x')}, '{BOUNDARY}', '') AS x FROM h0),\n"
            f"h2 AS (SELECT {key}, {_unescape_sql('x')} AS x FROM h1)")


@query("html_to_text", f"""WITH {_html_ctes("pages", "page_id", "html")}
SELECT page_id, x AS text FROM h2""")
def html_to_text_q(spark, sf):
    pg = X.table(spark, sf, "pages")
    return pg.select("page_id", T.html_to_text("html").alias("text"))


@query("html_to_text_exact", r"""SELECT doc_id, regexp_replace(text, '[\t\n]', ' ', 'g') AS text FROM documents""")
def html_to_text_exact_q(spark, sf):
    """Every whole text, written as a page with references and awkward markup, comes back as it was."""
    c = F.replace(F.col("text"), F.lit("&"), F.lit("&amp;amp;"))
    for char, ref in (("<", "&lt;"), ("q", "&#113;"), ("Q", "&#x51;"), ("é", "&eacute;"), ("à", "&#xe0"), ("ç", "&ccedil;"),
                      ("ü", "&#252;"), ("ö", "&ouml;"), ("ñ", "&#XF1;"), ("ß", "&szlig;"), ("€", "&#128;"), ("\u00a0", "&nbsp;")):
        c = F.replace(c, F.lit(char), F.lit(ref if ref.endswith(";") else f"{ref}<i></i>"))
    c = F.replace(c, F.lit("\n"), F.lit("<br title='>' alt=\"a > 'b'\"/>\n"))
    page = F.concat(F.lit("<!doctype html><p title=\"a>b\" data-x='<i>'>"), c, F.lit("</p><script>if (a<b) '>'</script><!-- > -->"))
    return X.table(spark, sf, "documents").select("doc_id", page.alias("html")).select("doc_id", T.html_to_text("html").alias("text"))


@query("url_id", """SELECT page_id, starts_with(url, 'https://') AS is_site,
  CASE WHEN starts_with(url, 'https://') AND regexp_extract(url, '/(\\d+)(?:[?#].*)?$', 1) <> ''
       THEN regexp_extract(url, '/(\\d+)(?:[?#].*)?$', 1) END AS posting_id FROM pages""")
def url_id_q(spark, sf):
    pg = X.table(spark, sf, "pages")
    pattern = r"/(\d+)(?:[?#].*)?$"
    return pg.select("page_id", F.startswith("url", F.lit("https://")).alias("is_site"),
                     T.url_posting_id("url", "https://", pattern).alias("posting_id"))


@query("model_input", f"""WITH {POST}, asm AS (SELECT recruitment_id, {_ASM} AS a FROM post),
{_html_ctes("asm", "recruitment_id", "a")}
SELECT recruitment_id, x AS input_data FROM h2""")
def model_input_q(spark, sf):
    """The model input of one posting: assembled fields, then HTML to text (P10-P12 together)."""
    p = X.postings(spark, sf)
    lay = P.posting_layout(p, drop=["label", "explanation"], keep=["recruitment_id"])
    cols = [DISPLAY_NAMES[c] for c in ("title", "body", "company_name", "vacancy")]
    return lay.select("recruitment_id", T.html_to_text(P.assemble_text(lay, cols)).alias("input_data"))
