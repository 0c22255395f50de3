"""Posting ingest and model-input assembly.

All of it is row-local (no shuffle) except the vocabulary count, which is
one partially-aggregated ``groupBy(token)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.codebook import (CLS_TOKEN, CRAWLED_GROUPS, CRAWLED_NAMES, DISPLAY_NAMES, LAYOUT_GROUPS, OFFLINE_FIELD_NAMES, POSTER_DROP, POSTER_NAMES,
                              SEP_TOKEN)
from kestrel.functions.text import WHITESPACE, amount_number, br_to_space, salary_range, tokens


def valid_posters(df: DataFrame, col: str = "user_id") -> DataFrame:
    """Drop rows without a poster id (null or 0)."""
    return df.where(F.col(col).isNotNull() & (F.col(col) != 0))


def dedup_last(entries) -> Column:
    """Keep, per label, the last ``{label, value}`` entry of the list."""
    e = F.col(entries) if isinstance(entries, str) else entries
    return F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e) - i - 1),
                                               lambda y: y["label"] == x["label"]))


def param_labels(df: DataFrame, col: str = "parameters") -> list[str]:
    """Distinct parameter labels, found by one distributed distinct pass.

    They become column names, so they belong to the schema; for an open set
    of labels use ``params_map``.
    """
    labels = df.select(F.explode(F.col(col)["label"]).alias("l")).where("l is not null").distinct()
    return sorted(r["l"] for r in labels.collect())


def params_map(col: str = "parameters") -> Column:
    """``[{label, value}]`` as a map, for any number of labels; the last duplicate wins."""
    # an entry without a label names nothing
    return F.map_from_entries(dedup_last(F.filter(F.col(col), lambda e: e["label"].isNotNull())))


def params_to_columns(df: DataFrame, col: str = "parameters", labels: list[str] | None = None) -> DataFrame:
    """``[{label, value}]`` -> one column per label; the last duplicate wins."""
    labels = labels if labels is not None else param_labels(df, col)
    m = params_map(col)
    return df.select(*[c for c in df.columns if c != col],
                     *[F.element_at(m, F.lit(lab)).alias(lab) for lab in labels])


def with_salary(df: DataFrame, col: str = "price_display") -> DataFrame:
    """Add ``min_salary``/``max_salary`` (text) and their numeric forms."""
    lo, hi = salary_range(col)
    out = df.withColumn("min_salary", lo).withColumn("max_salary", hi)
    return (out.withColumn("min_amount", amount_number("min_salary"))
               .withColumn("max_amount", amount_number("max_salary")))


def null_policy(df: DataFrame, mode: str, col: str = "explanation") -> DataFrame:
    """``train``: drop rows with a null ``col``; ``predict``: fill it with ``''``."""
    if mode == "train":
        return df.na.drop(subset=[col])
    if mode == "predict":
        return df.na.fill("", subset=[col])
    raise ValueError(mode)


def posting_layout(df: DataFrame, drop: list[str] = (), keep: list[str] = (),
                   groups: list[list[str]] = LAYOUT_GROUPS,
                   names: dict[str, str] = DISPLAY_NAMES) -> DataFrame:
    """Drop columns (missing ones ignored), order by group, rename for display."""
    d = df.drop(*[c for c in drop if c in df.columns])
    order = [c for g in groups for c in g if c in d.columns]
    out = d.select(*keep, *order)
    return out.withColumnsRenamed({c: names[c] for c in order if c in names})


def assemble_text(df: DataFrame, cols: list[str], input_token: str = CLS_TOKEN,
                  sep: str = SEP_TOKEN) -> Column:
    """``[CLS] name: value [SEP]  name: value [SEP] `` (column name as the name).

    ``<br />`` inside a value becomes a space; null prints as ``nan``.
    """
    parts = [F.lit(input_token)]
    for c in cols:
        v = F.coalesce(br_to_space(F.col(f"`{c}`").cast("string")), F.lit("nan"))
        parts += [F.lit(f" {c}: "), v, F.lit(f" {sep} ")]
    return F.concat(*parts)


def assemble_text_offline(cols: list[str], names: list[str] = OFFLINE_FIELD_NAMES,
                          extra: Column | None = None) -> Column:
    """``[CLS] name: value [SEP] ...`` with names by position.

    Without ``extra`` the trailing space is trimmed (label and aspect tasks);
    with it the previous-task text is appended (explanation task).
    """
    parts = [F.lit(f"{CLS_TOKEN} ")]
    for i, c in enumerate(cols):
        parts += [F.lit(f"{names[i]}: "), F.coalesce(F.col(c).cast("string"), F.lit("nan")),
                  F.lit(f" {SEP_TOKEN} ")]
    text = F.concat(*parts)
    if extra is None:
        # the text always ends in "[SEP] ": drop that final space
        return F.regexp_replace(text, " $", "")
    return F.concat(text, extra)


def vocab_topk(df: DataFrame, col: str, k: int, first_id: int = 2) -> DataFrame:
    """The ``k`` most frequent whitespace tokens with ids from ``first_id``.

    0 is kept for padding and 1 for unknown tokens. Ties: token ascending.
    """
    counts = df.select(F.explode(tokens(col)).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), F.col("token")).limit(k)
    w = Window.orderBy(F.col("n").desc(), F.col("token"))  # k rows after the limit
    return top.withColumn("id", (F.row_number().over(w) + first_id - 1).cast("int"))


def pad_tokens(df: DataFrame, col: str, vocab: DataFrame, length: int, key: str) -> DataFrame:
    """Token ids truncated/padded to ``length`` plus the attention mask, a row per input row.

    Only the first ``length`` tokens are cut off the text. They are joined
    with the vocabulary (AQE picks the side by its measured size) and put
    back together per row, in groups of at most ``length``. Null and empty
    texts are all padding. Rows are numbered where they lie, so repeated keys
    keep their own rows; give an input whose rows may change places between
    two computations as a written table or a checkpoint.
    """
    # one piece may be empty in front, one holds the rest of the text
    head = F.slice(F.filter(F.split(F.col(col), WHITESPACE, length + 2), lambda t: t != ""), 1, length)
    rows = df.select(F.col(key).alias("_key"), head.alias("_head"), F.monotonically_increasing_id().alias("_row"))
    toks = rows.select("_key", "_row", F.posexplode_outer("_head").alias("_pos", "_tok"))
    known = vocab.select(F.col("token").alias("_tok"), F.col("id").alias("_vid"))
    entry = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_vid", F.lit(1)).alias("i")))
    base = toks.join(known, "_tok", "left").groupBy("_row").agg(
        F.first("_key").alias(key), F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["i"]).alias("_ids"))
    pad = F.array_repeat(F.lit(0), F.lit(length) - F.size("_ids"))
    return base.select(key, F.concat("_ids", pad).alias("input_ids"),
                       F.concat(F.array_repeat(F.lit(1), F.size("_ids")), pad).alias("attention_mask"))


def posting_with_poster(detail: DataFrame, poster: DataFrame, on_detail: str = "user_id",
                        on_poster: str = "id", prefix: str = "poster_") -> DataFrame:
    """Each posting with its poster's columns (left join; AQE picks broadcast by size).

    Profile columns that are not poster data are dropped first (missing ones ignored).
    """
    poster = poster.drop(*[c for c in POSTER_DROP if c in poster.columns])
    p = poster.select(*[F.col(c).alias(prefix + c) for c in poster.columns])
    return detail.join(p, detail[on_detail] == p[prefix + on_poster], "left")


def rename_positional(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns renamed by position; a table with another number of columns stays as it is."""
    return df.toDF(*names) if len(df.columns) == len(names) else df


def crawled_layout(detail: DataFrame, poster: DataFrame, on_detail: str = "user_id", on_poster: str = "id",
                   keep: list[str] = ()) -> DataFrame:
    """A crawled posting with its poster in the display layout: title, body, company, poster and other columns.

    Profile columns that are not poster data go, the others are named by
    position (a profile with another number of columns keeps its names, with
    ``poster_`` in front, and then fills no poster column). Left join by the
    poster's id; only columns of the layout come out, those that exist, behind
    ``keep``.
    """
    poster = poster.drop(*[c for c in POSTER_DROP if c in poster.columns])
    named = rename_positional(poster, POSTER_NAMES)
    if named is poster:
        named = poster.toDF(*[f"poster_{c}" for c in poster.columns])
    key = named.columns[poster.columns.index(on_poster)]
    joined = detail.join(named, detail[on_detail] == named[f"`{key}`"], "left")
    return posting_layout(joined, keep=keep, groups=CRAWLED_GROUPS, names=CRAWLED_NAMES)
