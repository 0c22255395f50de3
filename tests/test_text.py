"""Cleaning and assembly functions on literal frames covering the edge cases."""

import html
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from kestrel.functions import labels as L
from kestrel.functions import text as T
from kestrel.operators import postings as P


def one(spark, value, expr, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("y")).first()["y"]


class _TextOnly(HTMLParser):
    """Collects text nodes; script/style content, comments and declarations are skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._skip += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self._skip:
            self._skip -= 1

    def handle_data(self, data):
        if not self._skip:
            self.parts.append(data)


def exact(s):
    """Text of one page by the standard library's parser."""
    if s is None:
        return None
    p = _TextOnly()
    p.feed(s.replace("\t", " ").replace("\n", " "))
    p.close()
    return html.unescape("".join(p.parts))


def test_salary_forms(spark):
    rows = [("Thỏa thuận",), ("7.000.000 - 9.000.000 VNĐ",), ("Từ 7.000.000",), ("Đến 12.000.000",),
            ("Từ khoảng",), ("Liên hệ",), ("Từ 1.000.000 đến 2.000.000 hoặc 3.000.000",)]
    df = P.with_salary(spark.createDataFrame(rows, "price_display string"))
    got = [(r["min_salary"], r["max_salary"], r["min_amount"], r["max_amount"]) for r in df.collect()]
    assert got == [(None, None, None, None), ("7.000.000", "9.000.000", 7000000, 9000000),
                   ("7.000.000", None, 7000000, None), (None, "12.000.000", None, 12000000),
                   (None, None, None, None), (None, None, None, None),
                   ("1.000.000", None, 1000000, None)]


def test_phone_normalise(spark):
    assert one(spark, "912345678.0", T.phone_normalise) == "0912345678"
    assert one(spark, None, T.phone_normalise) == ""
    assert one(spark, "nan", T.phone_normalise) == ""


def test_params_last_duplicate_wins(spark):
    df = spark.createDataFrame(
        [(1, [("a", "1"), ("b", "2"), ("a", "3")]), (2, [("b", "x")])],
        "id int, parameters array<struct<label:string,value:string>>")
    r = {x["id"]: (x["a"], x["b"]) for x in P.params_to_columns(df).collect()}
    assert r == {1: ("3", "2"), 2: (None, "x")}


def test_html_to_text_native_and_exact(spark):
    page = ("<p>Lương <b>cao</b> &amp; ổn định</p><XXX>< 1 năm<script>var a='<p>';</script>"
            "<style>p{}</style><!-- c --> &amp;lt;tag&amp;gt;\tend")
    native = one(spark, page, T.html_to_text)
    assert native == "Lương cao & ổn định< 1 năm <tag> end"
    assert exact(page) == native
    assert exact("a&#233;b&nbsp;c") == "aéb c"


def test_valid_posters_and_url(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 7)], "id int, user_id long")
    assert [r["id"] for r in P.valid_posters(df).collect()] == [3]
    url = "https://site.example/viec-lam/ke-toan-id12345"
    assert one(spark, url, lambda c: T.url_posting_id(c, "https://site.example/")) == "12345"
    assert one(spark, "https://other/x-id1", lambda c: T.url_posting_id(c, "https://site.example/")) is None


def test_assemble_forms(spark):
    df = spark.createDataFrame([("A<br />B", None, 3)], "t string, b string, n long")
    online = df.select(P.assemble_text(df, ["t", "b"]).alias("x")).first()["x"]
    assert online == "[CLS] t: A B [SEP]  b: nan [SEP] "
    off = df.select(P.assemble_text_offline(["t", "b", "n"]).alias("x")).first()["x"]
    assert off == "[CLS] tiêu đề: A<br />B [SEP] ngành nghề: nan [SEP] mô tả: 3 [SEP]"
    with_prev = df.select(P.assemble_text_offline(["t"], extra=F.lit("prev")).alias("x")).first()["x"]
    assert with_prev == "[CLS] tiêu đề: A<br />B [SEP] prev"
    assert one(spark, off, lambda c: T.special_tokens(c, "roberta")).startswith("<s> tiêu đề")
    assert one(spark, off, lambda c: T.special_tokens(c, "no_cls")).startswith(" tiêu đề")


def test_layout_and_null_policy(spark):
    df = spark.createDataFrame([(1, "t", "b", None)], "id int, title string, body string, explanation string")
    lay = P.posting_layout(df, drop=["explanation", "missing"], keep=["id"])
    assert lay.columns == ["id", "Tiêu đề", "Mô tả"]
    assert P.null_policy(df, "train").count() == 0
    assert P.null_policy(df, "predict").first()["explanation"] == ""


def test_vocab_and_padding(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, "b a d d d"), (3, "")], "id int, text string")
    vocab = P.vocab_topk(df, "text", 2)
    assert [(r["token"], r["id"]) for r in vocab.orderBy("id").collect()] == [("a", 2), ("d", 3)]
    out = {r["id"]: (r["input_ids"], r["attention_mask"]) for r in P.pad_tokens(df, "text", vocab, 4, "id").collect()}
    assert out[1] == ([2, 1, 2, 1], [1, 1, 1, 1])
    assert out[2] == ([1, 2, 3, 3], [1, 1, 1, 1])
    assert out[3] == ([0, 0, 0, 0], [0, 0, 0, 0])


def test_padding_of_odd_texts(spark):
    df = spark.createDataFrame([(1, " \t a\u00a0b  a d c "), (2, None), (3, " \n"), (4, "a " * 5000)], "id int, text string")
    vocab = spark.createDataFrame([("a", 2), ("d", 3)], "token string, id int")
    out = {r["id"]: (r["input_ids"], r["attention_mask"]) for r in P.pad_tokens(df, "text", vocab, 3, "id").collect()}
    assert out == {1: ([2, 1, 2], [1, 1, 1]), 2: ([0] * 3, [0] * 3), 3: ([0] * 3, [0] * 3), 4: ([2] * 3, [1] * 3)}


def test_parameters_as_a_map(spark):
    df = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3"), (None, "4")],), ([],), (None,)],
                               "parameters array<struct<label:string,value:string>>")
    assert [r["m"] for r in df.select(P.params_map().alias("m")).collect()] == [{"b": "2", "a": "3"}, {}, None]


def test_labels_and_verbalise(spark):
    df = spark.createDataFrame([(2, [0, 1, 2, 3])], "l int, a array<int>")
    r = df.select(L.label_decode("l").alias("n"), L.label_encode(F.lit("warning")).alias("c"),
                  L.verbalise("l", "a").alias("v")).first()
    assert r["n"] == "seeding" and r["c"] == 1
    assert r["v"] == ("khía cạnh tiêu đề: trung tính [SEP] khía cạnh mô tả: tích cực [SEP] "
                      "khía cạnh công ty: tiêu cực [SEP] khía cạnh khác: không đề cập [SEP] "
                      "nhãn chung: có yếu tố thu hút [SEP]")


def test_response_text_roundtrip(spark):
    from kestrel.sources import messages as MS
    df = spark.createDataFrame([("cid-1", 42, 1, [0, 3, 2, 1])], "c string, i long, p int, a array<int>")
    text = df.select(MS.format_response("c", "i", "p", "a").alias("t")).first()["t"]
    assert text == '<cid-1>42: "1 - [0, 3, 2, 1]"'
    r = df.select(MS.parse_response(MS.format_response("c", "i", "p", "a")).alias("r")).first()["r"]
    assert (r["correlation_id"], r["id"], r["cls"], r["acsa"]) == ("cid-1", "42", 1, [0, 3, 2, 1])


def test_html_native_equals_exact_on_pages(spark):
    pg = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pg.select("html", T.html_to_text("html").alias("text")).collect()
    assert len(rows) > 200 and all(r["text"] == (None if r["html"] is None else exact(r["html"])) for r in rows)


def test_entities_single_left_to_right_pass(spark):
    for s in ["a &amp;lt; b", "x&ampTo y", "&copy 2024 &middot; z", "&amp;amp;", "& lone &unknown; &#39;q"]:
        assert one(spark, s, T.html_to_text) == exact(s), s


def test_tokens_split_like_python(spark):
    s = "a b\tc d　e\x0bf  g\n"
    got = spark.createDataFrame([(s,)], "x string").select(T.tokens("x").alias("t")).first()["t"]
    assert got == s.split()


def test_rouge_tokens_like_default_scorer(spark):
    import re
    s = "Lương CAO, 7.000.000 VNĐ / tháng -- OK2go"
    exp = [t for t in re.sub(r"[^a-z0-9]+", " ", s.lower()).split() if re.match(r"^[a-z0-9]+$", t)]
    got = spark.createDataFrame([(s,)], "x string").select(T.rouge_tokens("x").alias("t")).first()["t"]
    assert got == exp


def test_tokens_all_python_whitespace(spark):
    import sys
    ws = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())
    s = "a" + ws + "b" + ws.join("cde")
    got = spark.createDataFrame([(s,)], "x string").select(T.tokens("x").alias("t")).first()["t"]
    assert got == s.split()


@pytest.mark.parametrize("s", ["", "   ", "a", " a", "a ", "  a  b  ", "\n\na\tb\n", None])
def test_tokens_edges(spark, s):
    got = spark.createDataFrame([(s,)], "x string").select(T.tokens("x").alias("t")).first()["t"]
    assert got == (None if s is None else s.split())


def test_posting_with_poster_drops_profile_noise(spark):
    detail = spark.createDataFrame([(1, 10, "a"), (2, 99, "b")], "id long, user_id long, title string")
    poster = spark.createDataFrame([(10, "Ann", "x", 5)], "id long, name string, image_url string, reputation int")
    rows = {r["id"]: r for r in P.posting_with_poster(detail, poster).collect()}
    assert "poster_image_url" not in rows[1].asDict() and "poster_reputation" not in rows[1].asDict()
    assert rows[1]["poster_name"] == "Ann" and rows[2]["poster_name"] is None


def test_csv_roundtrip_multiline_and_quotes(spark, scratch):
    from kestrel.sources.tables import read_postings, write_csv
    df = spark.createDataFrame([(1, 'line one\nline "two"', None), (2, "a,b", "")],
                               "recruitment_id long, body string, title string")
    write_csv(df, f"{scratch}/csv")
    back = {r["recruitment_id"]: r for r in read_postings(spark, f"{scratch}/csv", df.schema).collect()}
    assert back[1]["body"] == 'line one\nline "two"' and back[1]["title"] is None
    assert back[2]["body"] == "a,b"


def test_params_discovered_labels(spark):
    df = spark.createDataFrame([(1, [("x", "1")]), (2, [("y", "2"), ("x", "3")])],
                               "id int, parameters array<struct<label:string,value:string>>")
    out = P.params_to_columns(df)
    assert out.columns == ["id", "x", "y"]
    assert {r["id"]: (r["x"], r["y"]) for r in out.collect()} == {1: ("1", None), 2: ("3", "2")}


def test_removed_markup_does_not_join_text(spark):
    for s in ["&#39<style>p{}</style>;", "&amp</p>; ", "<<<!-- c -->b<p>", "x&lt<br/>;y"]:
        assert one(spark, s, T.html_to_text) == exact(s), s


def test_pad_tokens_keeps_the_rows_of_repeated_keys(spark):
    vocab = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "token string, id int")
    rows = [(1, "a b"), (1, "c"), (1, "a b"), (None, "b x"), (2, None), (2, "")]
    got = P.pad_tokens(spark.createDataFrame(rows, "id int, text string").repartition(3), "text", vocab, 3, "id").collect()
    assert sorted((r["id"] or 0, r["input_ids"], r["attention_mask"]) for r in got) == [
        (0, [3, 1, 0], [1, 1, 0]), (1, [2, 3, 0], [1, 1, 0]), (1, [2, 3, 0], [1, 1, 0]), (1, [4, 0, 0], [1, 0, 0]),
        (2, [0, 0, 0], [0, 0, 0]), (2, [0, 0, 0], [0, 0, 0])]


def test_crawled_layout_names_poster_columns_by_position(spark):
    detail = spark.createDataFrame([(1, 7, "t", "b", "0x"), (2, 8, "u", None, None), (3, None, "v", "w", "y")],
                                   "id int, user_id int, title string, body string, submisson_expired string")
    profile = spark.createDataFrame([(7, "n", "p", "l", "d", 3, 99)], "id int, a string, b string, c string, d string, e int, total int")
    out = P.crawled_layout(detail, profile).orderBy("id")
    assert out.columns == ["Tiêu đề", "Mô tả", "ID người đăng", "Tên người đăng", "Số điện thoại người đăng", "URL người đăng", "submisson_expired", "id"]
    assert [tuple(r) for r in out.collect()] == [("t", "b", 7, "n", "p", "l", "0x", 1), ("u", None, None, None, None, None, None, 2),
                                                 ("v", "w", None, None, None, None, "y", 3)]
    short = P.crawled_layout(detail, profile.select("id", "a"))  # another number of columns: no names by position
    assert short.columns == ["Tiêu đề", "Mô tả", "submisson_expired", "id"] and short.count() == 3


def test_html_like_the_standard_parser(spark):
    """Generated pages: quoted '>', raw text, comments, every kind of reference, private-use characters."""
    import random
    from html.entities import html5
    rng, names = random.Random(11), sorted(html5)
    numbers = [0, 1, 9, 11, 13, 31, 38, 60, 127, 128, 129, 150, 159, 160, 233, 0x111, 0x1EBF, 0xD800, 0xFDD0, 0xFEFF, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**12]
    parts = ["text ", "\ue000", "Công ty", "< 1", "\n", "\t", ";", "x", "&", "&#", "&#x", "&;", "&unknown;", "&amp;lt;", "&ampamp;", "<br/>", "<!-- a > b -->", "<!doctype html>",
             '<a title="x>y" b=c>', "<a title='>\"' >", "</a>", "<script x='>'>a < b && '<p>'</script>", "<style>p > a {}</style>", "<img alt = \"a>b\">", "<p hidden>"]
    pages = ["C&ocirc;ng ty &#273;&#7865;p", '<a title="x>y">z</a>', "a\ue000b", "", "&notit; &notin; &NotEqualTilde; &nGt; &fjlig;", "&#0065;&#x000041 &#X1F600;z"]
    pages += ["".join(f"&{n} " for n in names[i:i + 100]) for i in range(0, len(names), 100)] + ["".join(f"&{n}" for n in names[::7])]
    pages += [f"&#{n}{e}|&#x{n:x}{e}|&#X{n:X}{e}" for n in numbers for e in (";", " ", "<i>")]
    for _ in range(300):
        some = [rng.choice([rng.choice(parts), f"&{rng.choice(names)}", f"&#{rng.choice(numbers)};", f"&#x{rng.choice(numbers):x}"]) for _ in range(rng.randrange(1, 12))]
        pages.append("".join(some) + " end")
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    bad = [(pages[r["i"]], r["text"], exact(pages[r["i"]])) for r in df.select("i", T.html_to_text("html").alias("text")).collect()
           if r["text"] != exact(pages[r["i"]])]
    assert not bad, (len(bad), bad[:5])
    assert one(spark, None, T.html_to_text) is None


def test_html_of_long_attributes_and_many_references(spark):
    """Nothing recurses or is searched again and again."""
    page = '<a href="' + "x>" * 200_000 + '">a</a>' + "<b " + "k=v " * 50_000 + ">" + "&eacute;&#233;" * 50_000
    assert one(spark, page, T.html_to_text) == "a" + "é" * 100_000
