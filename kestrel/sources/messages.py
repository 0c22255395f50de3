"""Keyed JSON messages: producers, parsers, correlation ids, response text.

Messages are ``(key string, value string)`` rows, the shape of a Kafka
record; the same frames are written with ``df.write`` / ``writeStream``
to Kafka when its connector is on the classpath, or to files otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

REQUEST_SCHEMA = StructType([StructField("id", StringType()), StructField("data", StringType())])
RESPONSE_SCHEMA = "id string, prediction int, acsa string, data string"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_correlation_id(df: DataFrame, cols: list[str], name: str = "correlation_id") -> DataFrame:
    """Repeatable correlation id: SHA-256 of the ``-``-joined columns."""
    return df.withColumn(name, F.sha2(F.concat_ws("-", *[F.col(c).cast("string") for c in cols]), 256))


def to_messages(df: DataFrame, key: str, cols: dict[str, Column] | list[str]) -> DataFrame:
    """``(key, value)`` rows with the value as compact JSON of ``cols``."""
    if isinstance(cols, dict):
        fields = [c.alias(n) for n, c in cols.items()]
    else:
        fields = [F.col(c) for c in cols]
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def parse_messages(df: DataFrame, schema=REQUEST_SCHEMA) -> DataFrame:
    """Bytes or text ``key``/``value`` -> ``key`` plus the value's fields."""
    j = df.select(F.col("key").cast("string").alias("key"),
                  F.from_json(F.col("value").cast("string"), schema).alias("j"))
    return j.select("key", "j.*")


def parse_json(df: DataFrame, col: str, schema) -> DataFrame:
    """Parse a JSON text column into typed columns (missing fields -> null)."""
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.from_json(F.col(col), schema).alias("_j")).select(*keep, "_j.*")


def list_text(arr) -> Column:
    """Python-style list text of an int array: ``[1, 2, 3, 0]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(_col(arr), lambda x: x.cast("string")), ", "),
                    F.lit("]"))


def parse_list_text(col) -> Column:
    """``[1, 2, 3, 0]`` -> ``array<int>``."""
    return F.from_json(_col(col), "array<int>")


def format_response(cid, id_, cls, acsa) -> Column:
    """``<cid>id: "cls - [a, b, c, d]"`` (the answer text sent to the client)."""
    return F.concat(F.lit("<"), _col(cid), F.lit(">"), _col(id_).cast("string"), F.lit(': "'),
                    _col(cls).cast("string"), F.lit(" - "), list_text(acsa), F.lit('"'))


def parse_response(col) -> Column:
    """Inverse of :func:`format_response`: struct of correlation id, id, class, aspects.

    Positions follow the client: id between ``>`` and the first ``:``, class
    between the first ``"`` and `` -``, aspects between ``[`` and ``]``.
    """
    c = _col(col)
    cid = F.regexp_extract(c, r"^[^<]*<([^>]*)>", 1)
    id_ = F.regexp_extract(c, r"^[^>]*>([^:]*):", 1)
    cls = F.regexp_extract(c, r'^[^"]*"(.*?) -', 1).cast("int")
    acsa = F.transform(F.split(F.regexp_extract(c, r"\[([^\]]*)\]", 1), ","), lambda x: F.trim(x).cast("int"))
    return F.struct(cid.alias("correlation_id"), id_.alias("id"), cls.alias("cls"), acsa.alias("acsa"))


def read_requests(spark: SparkSession, fmt: str, options: dict, schema: str = "key string, value string",
                  path: str | None = None) -> DataFrame:
    """Streaming source of keyed request messages.

    ``fmt='kafka'`` uses the Kafka connector (``options`` as for
    ``readStream.format('kafka')``); file formats read ``path`` with the
    given schema. Returns ``key, id, data``.
    """
    r = spark.readStream.format(fmt).options(**options)
    if fmt != "kafka":
        r = r.schema(schema)
    raw = r.load(path) if path else r.load()
    return parse_messages(raw)


def write_responses(df: DataFrame, fmt: str, options: dict, checkpoint: str, path: str | None = None,
                    trigger: dict | None = None):
    """Start a streaming sink of ``(key, value)`` response messages."""
    w = df.writeStream.format(fmt).options(**options).option("checkpointLocation", checkpoint) \
          .outputMode("append")
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start(path) if path else w.start()


def report_to_training(reports: DataFrame, prediction: str = "prediction", acsa: str = "acsa",
                       data: str = "data") -> DataFrame:
    """User reports -> training records ``input_data, prediction, acsa``.

    A report carries the five corrected codes ``[label, a1, a2, a3, a4]``;
    the training record keeps the four aspects as list text and the label as
    text, and renames ``data`` to ``input_data``. Works on batch and
    streaming frames alike (a projection).
    """
    return reports.select(F.col(data).alias("input_data"), F.col(prediction).cast("string").alias("prediction"),
                          list_text(F.slice(F.col(acsa), 2, 4)).alias("acsa"))


def training_pool(train: DataFrame, reports: DataFrame) -> DataFrame:
    """Labelled rows plus user reports, with the report source marked (stream or batch)."""
    return (train.select("input_data", "prediction", "acsa", F.lit("train").alias("source"))
                 .unionByName(report_to_training(reports).withColumn("source", F.lit("report"))))
