"""Quality rules with thresholds taken from mergeable quantile sketches.

Fixed cutoffs stay for the two base rules only (too few words, too much
repetition). The other rules compare a document's rates with fences that its
own language and source set: a sketch of every rate is kept per (lang,
source), merged per language and over all rows, and a document is judged by
the narrowest of these that holds enough documents.

The sketch is a histogram with buckets of a fixed relative width: a value
below ``2 ** BITS`` is its own bucket, a larger one keeps its first ``BITS``
binary digits, so a quantile is below the exact one by less than
``2 ** (1 - BITS)`` of it. Two sketches merge by adding counts, in any order,
which makes the verdicts the same for any partitioning. A sketch has at most
``2 ** (BITS - 1)`` buckets for each power of two, whatever it counts.

Everything is DataFrame functions; the text is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import stored, unused

#: binary digits that a bucket keeps
BITS = 7
#: documents that a sketch needs before it sets fences
ENOUGH = 100
#: the quantiles a fence starts from: its own end, and the middle
HIGH, MIDDLE = 0.9, 0.5
#: a fence stands this many spreads outside its quantile
SPREADS = 3
#: rate -> (least spread, whether very small values go as well); rates are per thousand
RATES = {"symbol_rate": (25, False), "dup_line_rate": (100, False), "repeat_rate": (100, False), "word_length": (500, True)}
#: base rules
MIN_WORDS, MAX_REPEAT = 50, 50

SPACE = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "#*$%&|<>"


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), lang: str = "lang", source: str = "source") -> DataFrame:
    """The columns ``keep``, lang and source, and the counts of every text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_lines`` (lines with a word), ``n_dup_lines`` (of these, equal to an
    earlier one) and ``n_repeat_words`` (words inside three-word windows that
    the text holds twice or more). A null or empty text has none of them.
    Windows are told apart by 64-bit hashes within one text. Columns of
    ``keep`` come first, named ``k_0``, ``k_1``, ... so that no name clashes.
    """
    held = [F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*held, F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), text.alias("text"))
    base = [f"k_{i}" for i in range(len(keep))] + ["lang", "source"]
    bare = F.regexp_replace("text", SPACE, " ")
    rows = rows.select(*base, "text", F.trim(bare).alias("bare"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    rows = rows.select(
        *base, F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", " ")).alias("words"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("bare", " ", "")).cast("long").alias("word_chars"), lines.alias("lines"))
    n = F.size("words")
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    rows = rows.select(
        *base, n.cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(at, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))).alias("grams"))
    # windows beside an equal one, where a text has any
    rows = rows.select(*base, *counts, F.when(
        F.size(F.array_distinct("grams")) < F.size("grams"),
        F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("pairs"))
    twice = F.transform("pairs", lambda x, j: F.when(
        (x["g"] == F.get("pairs", j - 1)["g"]) | (x["g"] == F.get("pairs", j + 1)["g"]), x["i"]))
    rows = rows.select(*base, *counts, F.sort_array(F.filter(twice, lambda x: x.isNotNull())).alias("starts"))
    # a window covers three words, or those up to the next one
    covered = F.aggregate(
        F.transform("starts", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("starts", j + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(*base, *counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def bucket(value: Column) -> Column:
    """The lower end of the sketch bucket of a whole number >= 0."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def _rates() -> list[Column]:
    """The rates of a measured document, whole numbers per thousand."""
    part = lambda a, b: F.when(F.col(b) > 0, F.expr(f"1000 * {a} div {b}")).otherwise(F.lit(0).cast("long"))
    return [part("n_symbols", "word_chars").alias("symbol_rate"), part("n_dup_lines", "n_lines").alias("dup_line_rate"),
            part("n_repeat_words", "n_words").alias("repeat_rate"), part("word_chars", "n_words").alias("word_length")]


def sketch(rows: DataFrame) -> DataFrame:
    """Sketches of the rates per (lang, source): lang, source, rate, bucket, n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bucket(F.col(r)).alias("bucket")) for r in RATES]))
    return rows.select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.rate", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches merged over everything but ``by``."""
    return sketches.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, *by: str) -> DataFrame:
    """Per group and rate: documents, the low, middle and high quantile."""
    w = Window.partitionBy(*by, "rate")
    run = sketches.withColumns({"total": F.sum("n").over(w), "seen": F.sum("n").over(w.orderBy("bucket"))})
    # the first bucket that reaches ceil(q * total) documents, in whole numbers
    at = lambda q: F.min(F.when(F.col("seen") * 100 >= F.col("total") * round(100 * q), F.col("bucket")))
    return run.groupBy(*by, "rate").agg(F.max("total").alias("total"), at(1 - HIGH).alias("low"), at(MIDDLE).alias("middle"), at(HIGH).alias("high"))


def fences(sketches: DataFrame, *by: str) -> DataFrame:
    """Per group with enough documents: a column ``<rate>_lo`` and ``<rate>_hi`` for every rate."""
    q = quantiles(sketches, *by).where(F.col("total") >= ENOUGH)
    least = F.coalesce(*[F.when(F.col("rate") == r, F.lit(s)) for r, (s, _) in RATES.items()])
    low = F.coalesce(*[F.when(F.col("rate") == r, F.lit(b)) for r, (_, b) in RATES.items()])
    q = q.select(*by, "rate", (F.col("high") + SPREADS * F.greatest(F.col("high") - F.col("middle"), least)).alias("hi"),
                 F.when(low, F.col("low") - SPREADS * F.greatest(F.col("middle") - F.col("low"), least)).otherwise(-1).alias("lo"))
    of = lambda r, c: F.max(F.when(F.col("rate") == r, F.col(c))).alias(f"{r}_{c}")
    return q.groupBy(*by).agg(*[of(r, c) for r in RATES for c in ("lo", "hi")])


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), lang: str = "lang", source: str = "source") -> DataFrame:
    """The columns ``keep`` with the counts of ``measure``, the rates, ``base_failed``, ``failed`` and ``kept``.

    ``base_failed``: under ``MIN_WORDS`` words, or more than ``MAX_REPEAT`` %
    of the words in repeated windows. The sketches count the other documents.
    ``failed`` lists the rates outside their fence, ``level`` names the sketch
    that set it (``source``, ``lang``, ``all``; ``none`` if even all documents
    are under ``ENOUGH``, and then no rate fails). A null language or source
    is a group of its own. One row per input row, repeated rows included; an
    empty table gives no rows. A column of ``keep`` whose name is taken by a
    result comes out under that name with ``_`` behind it.
    """
    rows = stored(measure(docs, keep, lang, source), "quality").withColumns(
        {"base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))})
    rates = {r: c for r, c in zip(RATES, _rates(), strict=True)}
    rows = rows.withColumns(rates)
    own = stored(sketch(rows.where(~F.col("base_failed"))), "quality-sketch")
    by_lang = merge(own, "lang")
    every = fences(merge(by_lang)).first()  # one row, or none
    edges = [f"{r}_{c}" for r in RATES for c in ("lo", "hi")]
    a = fences(own, "lang", "source").select(F.col("lang").alias("a_lang"), F.col("source").alias("a_source"), *[F.col(c).alias(f"a_{c}") for c in edges])
    b = fences(by_lang, "lang").select(F.col("lang").alias("b_lang"), *[F.col(c).alias(f"b_{c}") for c in edges])
    # a fence row per (lang, source) that occurs, so that documents meet one small table
    groups = own.select("lang", "source").distinct()
    groups = (groups.join(a, F.col("lang").eqNullSafe(F.col("a_lang")) & F.col("source").eqNullSafe(F.col("a_source")), "left")
              .join(b, F.col("lang").eqNullSafe(F.col("b_lang")), "left"))
    first = edges[0]
    level = F.when(F.col(f"a_{first}").isNotNull(), "source").when(F.col(f"b_{first}").isNotNull(), "lang").otherwise("all" if every else "none")
    groups = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), level.alias("level"),
                           *[F.coalesce(f"a_{x}", f"b_{x}", F.lit(every[x] if every else None).cast("long")).alias(x) for x in edges])
    joined = rows.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    failed = F.filter(F.array(*[F.when((F.col(r) > F.col(f"{r}_hi")) | (F.col(r) < F.col(f"{r}_lo")), F.lit(r)) for r in RATES]), lambda x: x.isNotNull())
    results = {"n_words": F.col("n_words"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"), "n_dup_lines": F.col("n_dup_lines"),
               "n_repeat_words": F.col("n_repeat_words"), **{r: F.col(r) for r in RATES}, "base_failed": F.col("base_failed"),
               "level": F.coalesce("level", F.lit("none")), "failed": failed, "kept": ~F.col("base_failed") & (F.size(failed) == 0)}
    taken = docs.sparkSession.createDataFrame([], ", ".join(f"{r} int" for r in results))
    return joined.select(*[F.col(f"k_{i}").alias(unused(taken, c)) for i, c in enumerate(keep)], *[c.alias(k) for k, c in results.items()])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    columns = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text"), F.col("lang"), F.col("source"))
    return judge(held, keep=("row",)).where("kept").select("row.*")
