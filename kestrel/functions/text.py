"""Text column expressions: HTML to text, phone numbers, URLs, special tokens, salary.

All of them are native functions. HTML references are those of the standard
library's table (``html.entities.html5``), looked up inside the row.
"""

from __future__ import annotations

import json
import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrel.codebook import (POSTING_ID_PATTERN, SALARY_AMOUNT_PATTERN, SALARY_FROM,
                              SALARY_NEGOTIABLE, SALARY_TO, TOKEN_PROFILES)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- HTML -------------------------------------------------------------------

# markup, one alternative each: comments, raw text elements, start tags (a quoted
# attribute value may hold '>'), end tags and declarations. Repetitions are
# possessive, so long attributes neither backtrack nor recurse.
_ATTRIBUTES = r"""(?:[^>=]++|=[\s=]*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
_MARKUP = (rf"(?is)<!--.*?--\s*>|<script\b{_ATTRIBUTES}.*?</script\s*>|<style\b{_ATTRIBUTES}.*?</style\s*>"
           rf"|<[a-z]{_ATTRIBUTES}|<[/!?][^>]*+>")
# what may be a reference after '&': decimal, hexadecimal, named
_REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# names that HTML also accepts without the closing semicolon, longest first
_BARE = "^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
_SLOTS = 256  # the names are spread over so many small maps, as a map is searched entry by entry


def _named(name: Column) -> Column:
    """The characters of a named reference (with its semicolon, if it has one), else null."""
    slots: list[dict[str, str]] = [{} for _ in range(_SLOTS)]
    for n, chars in html5.items():
        slots[zlib.crc32(n.encode()) % _SLOTS][n] = chars
    maps = F.from_json(F.lit(json.dumps(slots, ensure_ascii=False)), "array<map<string,string>>")
    return F.try_element_at(F.get(maps, (F.crc32(name.cast("binary")) % _SLOTS).cast("int")), name)


def _code(ref: Column) -> Column:
    """Code point of a numeric reference; beyond Unicode for very long numbers."""
    digits = F.regexp_replace(ref, "^#[xX]?0*|;$", "")
    n = F.when(F.lower(F.substring(ref, 2, 1)) == "x", F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))
    return F.when(F.length(digits) > 8, F.lit(0x110000)).otherwise(F.coalesce(n.cast("int"), F.lit(0)))


def _character(n: Column) -> Column:
    """Text of a numeric reference: code page 1252 for 0x80-0x9F, U+FFFD outside Unicode, none for noncharacters."""
    c1 = F.array(*[F.lit(bytes([i]).decode("cp1252", "ignore") or chr(i)) for i in range(0x80, 0xA0)])
    none = (n.between(1, 8) | (n == 0x0B) | n.between(0x0E, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF)
            | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    # a byte order mark in front, so that one in the text is not taken for it
    char = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(n), 8, "0"))), "UTF-32")
    return (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd"))
             .when(n.between(0x80, 0x9F), F.get(c1, n - 0x80)).when(none, F.lit("")).otherwise(char))


def unescape(c: Column) -> Column:
    """Named and numeric references to characters, in one left-to-right pass that re-reads nothing.

    The text is split at '&' once; what follows each is looked at once for a
    reference, then for the longest name that needs no semicolon.
    """
    found = F.transform(F.split(c, "&", -1), lambda p, i: F.struct(
        p.alias("p"), F.when(i > 0, F.regexp_extract(p, _REFERENCE, 0)).alias("ref")))
    read = F.transform(found, lambda s: F.struct(
        s["p"].alias("p"), s["ref"].alias("ref"), F.when(F.startswith(s["ref"], F.lit("#")), _code(s["ref"])).alias("code"),
        F.when(s["ref"] != "", _named(s["ref"])).alias("whole"), F.regexp_extract(s["ref"], _BARE, 0).alias("bare")))

    def text(s: Column) -> Column:
        rest = lambda matched: F.substring(s["p"], F.length(matched) + 1, F.lit(1 << 30))
        return (F.when(s["ref"].isNull(), s["p"])
                 .when(s["code"].isNotNull(), F.concat(_character(s["code"]), rest(s["ref"])))
                 .when(s["whole"].isNotNull(), F.concat(s["whole"], rest(s["ref"])))
                 .when(s["bare"] != "", F.concat(_named(s["bare"]), rest(s["bare"])))
                 .otherwise(F.concat(F.lit("&"), s["p"])))

    return F.array_join(F.transform(read, text), "")


def html_to_text(col) -> Column:
    """Tabs/newlines -> space, drop markup, scripts, styles and comments, unescape twice.

    ``<`` followed by a space (``< 1 year``) is text and stays; ``<XXX>``
    placeholders look like tags and are removed, as an HTML parser does. The
    text is split at its markup and each piece unescaped by itself (as a
    parser does), so text on both sides never merges into a new tag or
    reference; the second pass runs over the joined text. Null gives null.
    """
    pieces = F.split(F.regexp_replace(_col(col), r"[\t\n]", " "), _MARKUP, -1)
    return unescape(F.array_join(F.transform(pieces, unescape), ""))


# --- fields -----------------------------------------------------------------

def br_to_space(col) -> Column:
    return F.replace(_col(col), F.lit("<br />"), F.lit(" "))


def phone_normalise(col) -> Column:
    """``'0' + text``, then remove ``0nan`` and every ``.0``; null -> ``''``."""
    c = F.concat(F.lit("0"), F.coalesce(_col(col), F.lit("nan")))
    return F.replace(F.replace(c, F.lit("0nan"), F.lit("")), F.lit(".0"), F.lit(""))


def url_posting_id(url, prefix: str, pattern: str = POSTING_ID_PATTERN) -> Column:
    """Posting id from the URL when it starts the site prefix, else null."""
    u = _col(url)
    m = F.regexp_extract(u, pattern, 1)
    return F.when(F.startswith(u, F.lit(prefix)) & (m != ""), m)


def special_tokens(col, profile: str) -> Column:
    """Swap the special tokens for an encoder family (``bert``, ``roberta``, ``no_cls``)."""
    c = _col(col)
    for old, new in TOKEN_PROFILES[profile].items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def salary_range(col) -> tuple[Column, Column]:
    """(min, max) salary text from the display text.

    Negotiable -> both null; exactly two amounts -> min, max; otherwise
    ``Từ`` -> min = first amount, ``Đến`` -> max = first amount; else null.
    """
    c = _col(col)
    amounts = F.regexp_extract_all(c, F.lit(SALARY_AMOUNT_PATTERN), 0)
    first = F.get(amounts, 0)
    neg = c == F.lit(SALARY_NEGOTIABLE)
    two = F.size(amounts) == 2
    lo = (F.when(neg, F.lit(None)).when(two, first)
           .when(F.contains(c, F.lit(SALARY_FROM)), first))
    hi = (F.when(neg, F.lit(None)).when(two, F.get(amounts, 1))
           .when(F.contains(c, F.lit(SALARY_FROM)), F.lit(None))
           .when(F.contains(c, F.lit(SALARY_TO)), first))
    return lo.cast("string"), hi.cast("string")


def amount_number(col) -> Column:
    """Dotted amount text (``7.000.000``) -> bigint."""
    return F.replace(_col(col), F.lit("."), F.lit("")).cast("long")


# the characters Python's ``str.split()`` treats as whitespace: Unicode White_Space
# plus the four separators U+001C..U+001F (the (?U) class is as fast as a plain \s)
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def rouge_tokens(col) -> Column:
    """Tokens as the common ROUGE scorer's default tokenizer makes them.

    Lower case, every run of characters outside ``a-z0-9`` becomes a space,
    then split; accented letters are dropped, as that tokenizer does.
    """
    c = F.regexp_replace(F.lower(_col(col)), r"[^a-z0-9]+", " ")
    return _drop_empty_ends(F.split(c, " "))


def _drop_empty_ends(a: Column) -> Column:
    """Drop the empty pieces a split leaves for leading/trailing separators.

    A ``filter`` evaluates the split once and tests each piece; conditional
    forms that reference the split several times would re-run it per branch
    wherever the projection is not code-generated.
    """
    return F.filter(a, lambda x: x != "")


def tokens(col) -> Column:
    """Whitespace tokens of a whole text, split as Python's ``str.split()`` does."""
    return _drop_empty_ends(F.split(_col(col), WHITESPACE))
