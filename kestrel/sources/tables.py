"""Tables: parquet read/append, CSV postings, registry seeding, the model store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kestrel.session import ensure_checkpoint_dir

# fixed values: the header of the raw labelled posting CSV, in its order; all text except the key
POSTING_CSV_SCHEMA = StructType(
    [StructField("recruitment_id", LongType())]
    + [StructField(c, StringType()) for c in (
        "title_aspect", "desc_aspect", "company_aspect", "other_aspect", "label", "explanation",
        "title", "job_type", "body", "experience", "education", "certification", "benefit",
        "company_name", "location", "phone", "contact_name", "vacancy", "contact_type",
        "salary_type", "min_salary", "max_salary", "gender", "min_age", "max_age")])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint directory (never a machine-local temp dir)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at ``path``; errors of the store are raised."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows to a parquet table (evaluation records, latencies, reports)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_postings(spark: SparkSession, path: str, schema: StructType = POSTING_CSV_SCHEMA) -> DataFrame:
    """Quoted CSV with multi-line text fields, read with a declared schema."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
                 .option("quote", '"').option("escape", '"').csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, quoting and escaping that round-trips multi-line text and spaces at its ends."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .option("quoteAll", True).csv(path))


def seed_registry(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Evaluation records from JSON (extended-JSON ``_id.$oid``).

    ``multi_line=True``: each file holds one object or a list of objects;
    ``False``: JSON lines.
    """
    raw = spark.read.option("multiLine", multi_line).json(path)
    cols = [c for c in raw.columns if c != "_id"]
    oid = F.col("_id.$oid") if "_id" in raw.columns else F.lit(None).cast("string")
    return raw.select(oid.alias("oid"), *cols)


def to_training_records(df: DataFrame, text: str, label: str, aspects: str) -> DataFrame:
    """``input_data, prediction, acsa`` records with labels packed as text."""
    from kestrel.sources.messages import list_text
    return df.select(F.col(text).alias("input_data"), F.col(label).cast("string").alias("prediction"),
                     list_text(aspects).alias("acsa"))


# --- model store ----------------------------------------------------------------

def save_weights(weights: DataFrame, path: str, task: str, version: int) -> None:
    """Write a weight table under ``task=…/version=…`` (that partition is replaced)."""
    out = weights.withColumn("task", F.lit(task)).withColumn("version", F.lit(int(version)))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("task", "version").parquet(path))


def save_weights_many(weights: DataFrame, path: str, task: str) -> None:
    """Write weight tables of several versions (a ``version`` column) in one job."""
    out = weights.withColumn("task", F.lit(task)).withColumn("version", F.col("version").cast("int"))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("task", "version").parquet(path))


def load_weights(spark: SparkSession, path: str, task: str, version: int) -> DataFrame:
    """Read one stored version (partition-pruned)."""
    w = spark.read.parquet(path)
    return w.where((F.col("task") == task) & (F.col("version") == int(version))).drop("task", "version")


def stored_versions(spark: SparkSession, path: str) -> DataFrame:
    """``(task, version)`` of every stored artefact."""
    return spark.read.parquet(path).select("task", "version").distinct()
