"""Stand-in inputs derived from the driver tables.

The driver ships generic tables; each function here derives, with plain
DataFrame expressions, the record shape one operator family consumes
(class scores, aspect codes, an evaluation registry, postings, messages).
Every derivation reads whole tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.functions.arrays import argmax_class, argmax_per_group, scores_slice
from kestrel.functions.text import tokens

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


# --- scores ---------------------------------------------------------------

def cls_rows(spark, sf_dir) -> DataFrame:
    """``vec_id, t, scores, p``: 10 class scores = embedding[1..10], truth = label."""
    e = table(spark, sf_dir, "embeddings")
    s = scores_slice("embedding", 1, 10)
    return e.select("vec_id", F.col("label").alias("t"), s.alias("scores")) \
            .withColumn("p", argmax_class("scores"))


def aspect_rows(spark, sf_dir) -> DataFrame:
    """Per row: 4 aspect codes (truth and arg-max) and a 3-class label.

    Aspect i scores = embedding[4i+1 .. 4i+4], truth = (label + i) mod 4;
    label scores = embedding[17..19], truth = label mod 3.
    """
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        F.array(*[((F.col("label") + i) % 4) for i in range(4)]).alias("t_aspects"),
        argmax_per_group(scores_slice("embedding", 1, 16), 4, 4).alias("p_aspects"),
        (F.col("label") % 3).alias("t_label"),
        argmax_class(scores_slice("embedding", 17, 3)).alias("p_label"),
        scores_slice("embedding", 1, 16).alias("aspect_scores"),
        scores_slice("embedding", 17, 3).alias("label_scores"),
    )


def vector_rows(spark, sf_dir) -> DataFrame:
    """``vec_id, embedding`` with the codes of both tasks: class = label, label task = label mod 3, aspect i = (label + i) mod 4."""
    c = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", c.cast("int").alias("t_class"), (c % 3).cast("int").alias("t_label"),
        F.array(*[((c + i) % 4).cast("int") for i in range(4)]).alias("t_aspects"))


# --- evaluation registry ---------------------------------------------------

def registry(spark, sf_dir) -> DataFrame:
    """One evaluation record per day of ``events``.

    version = day number (1 = first day), avg_f1 = round(mean value, 6),
    acc = round(share of purchases, 6); ``key`` orders the records.
    """
    ev = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), "value", "event_type")
    # values carry cents: exact decimal means, rounded half-up at 6 decimals
    days = ev.groupBy("d").agg(
        F.round(F.avg(F.col("value").cast("decimal(20,2)")), 6).cast("double").alias("avg_f1"),
        F.round(F.avg(F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("decimal(20,2)")), 6)
         .cast("double").alias("acc"))
    # one row per day: a window over the whole (tiny) day table is fine here
    d0 = F.min("d").over(Window.partitionBy())
    reg = days.select(
        (F.datediff("d", d0) + 1).cast("int").alias("version"),
        F.lit("cls").alias("task"), "acc", "avg_f1")
    reg = reg.withColumn("key", F.col("version").cast("long"))
    # one row per day, read by several branches of a query: derive it once
    from kestrel.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return reg.checkpoint(eager=True)


def artefacts(reg: DataFrame) -> DataFrame:
    """Saved model artefacts: every version except multiples of 7."""
    return reg.where(F.col("version") % 7 != 0).select("task", "version")


# --- postings --------------------------------------------------------------

def postings(spark, sf_dir) -> DataFrame:
    """Labelled postings: ``documents`` left join ``labels``.

    title = lang, company_name = source, body = text; the label is coded
    from (toxic, quality) and missing labels stay null.
    """
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    label = (F.when(F.col("quality").isNull(), F.lit(None).cast("int"))
              .when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0))
    return j.select(
        F.col("doc_id").alias("recruitment_id"),
        F.col("lang").alias("title"), F.col("text").alias("body"),
        F.col("source").alias("company_name"), F.col("n_chars").alias("vacancy"),
        label.alias("label"),
        F.when(label.isNotNull(), F.concat(F.lit("label "), label.cast("string"))).alias("explanation"))


def part_details(spark, sf_dir) -> DataFrame:
    """Raw posting details derived from ``part``.

    price_display takes one of four salary forms by p_partkey mod 4;
    phone is float-like text (null every 11th key); user_id is null every
    13th key and 0 when p_partkey mod 89 = 0; parameters is a label/value
    list with a duplicated label every 3rd key.
    """
    p = table(spark, sf_dir, "part")
    a1 = F.concat(F.col("p_size").cast("string"), F.lit(".000.000"))
    a2 = F.concat((F.col("p_size") + 5).cast("string"), F.lit(".000.000"))
    k = F.col("p_partkey")
    price = (F.when(k % 4 == 0, F.lit("Thỏa thuận"))
              .when(k % 4 == 1, F.concat(a1, F.lit(" - "), a2, F.lit(" VNĐ")))
              .when(k % 4 == 2, F.concat(F.lit("Từ "), a1))
              .otherwise(F.concat(F.lit("Đến "), a2)))
    phone = F.when(k % 11 == 0, F.lit(None).cast("string")) \
             .otherwise(F.concat((k * 7919 + 100000000).cast("string"), F.lit(".0")))
    user = F.when(k % 13 == 0, F.lit(None).cast("long")).otherwise(k % 89)
    base = F.array(
        F.struct(F.lit("Thương hiệu").alias("label"), F.col("p_brand").alias("value")),
        F.struct(F.lit("Loại").alias("label"), F.col("p_type").alias("value")),
        F.struct(F.lit("Kích thước").alias("label"), F.col("p_size").cast("string").alias("value")))
    dup = F.array(F.struct(F.lit("Loại").alias("label"), F.col("p_name").alias("value")))
    params = F.when(k % 3 == 0, F.concat(base, dup)).otherwise(base)
    return p.select(k.alias("id"), user.alias("user_id"), F.col("p_name").alias("title"),
                    price.alias("price_display"), phone.alias("phone"), params.alias("parameters"))


def posters(spark, sf_dir) -> DataFrame:
    """Poster profiles: ``supplier`` with its nation name as location."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.col("n_name").alias("location"), F.col("s_acctbal").alias("balance"))


# --- requests and responses ------------------------------------------------

def requests(spark, sf_dir) -> DataFrame:
    """One request per event: correlation id = event_id, sent at ``ts`` (UTC)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("correlation_id"),
                     F.col("ts").cast("timestamp").alias("sent_at"),
                     F.col("event_type").alias("config"), "user_id")


def responses(spark, sf_dir) -> DataFrame:
    """Answers for events whose id is not a multiple of 10, after round(value*1000) ms."""
    ev = table(spark, sf_dir, "events").where(F.col("event_id") % 10 != 0)
    delay_ms = F.round(F.col("value") * 1000).cast("long")
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + delay_ms * 1000)
    return ev.select(F.col("event_id").alias("correlation_id"), at.alias("answered_at"))


# --- text pairs ----------------------------------------------------------

def text_pairs(spark, sf_dir) -> DataFrame:
    """Reference = whitespace tokens of a turn; candidate = same without every 7th."""
    c = table(spark, sf_dir, "conversations")
    toks = tokens("text")
    ref = c.select("conv_id", "turn", toks.alias("ref"))
    cand = F.filter(F.col("ref"), lambda x, i: (i + 1) % 7 != 0)
    return ref.select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"),
                      cand.alias("cand"), "ref")
