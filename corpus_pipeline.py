"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import decontam, linededup, pieces, simhash, toxicity
from kestrel.llm.common import scratch_path
from kestrel.llm.queries import VOCABULARY, table

#: no SQL for classifiers, XXH64 fingerprints or piece encoding: tests/llm compares with brute force
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict toxic."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), keep=tuple(docs.columns))
    return scored.where(F.col(scored.columns[-1]) == 0).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without repeated lines; n_chars follows the text."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: 4-word shingles, 4 bits."""
    return simhash.keep_first(docs, k=4, bits=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    found = decontam.find_items(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip."""
    return pieces.encode(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
