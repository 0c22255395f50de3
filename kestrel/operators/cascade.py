"""The cascade from stored weights (M5): one model set, one Arrow pass, a written output table.

Every task's heads (label: one, aspects: four) are loaded from the model store
at a named version. All of them score a row in the same Arrow function: one
matrix product over the stacked heads. The predictions are verbalised and
appended to the offline text, which is the explanation task's input, and the
table is written as CSV and read back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from kestrel.codebook import ASPECT_OUTPUTS, OFFLINE_FIELD_NAMES
from kestrel.functions.arrays import as_doubles
from kestrel.functions.labels import verbalise
from kestrel.operators.heads import usable_vectors, weights_arrays
from kestrel.operators.postings import assemble_text_offline
from kestrel.sources.tables import load_weights, read_postings, write_csv

Models = dict[str, tuple[np.ndarray, np.ndarray]]


def load_models(spark: SparkSession, store: str, versions: dict[str, int]) -> Models:
    """The weights of several tasks, each at its version; a task without that artefact raises."""
    return {task: weights_arrays(load_weights(spark, store, task, v)) for task, v in versions.items()}


def score_tasks(df: DataFrame, vec: str, models: Models, out: str = "tasks") -> DataFrame:
    """Add the struct ``out`` with an ``array<int>`` of arg-max codes (one per head) for every task.

    The heads of all tasks are one stacked matrix, so a batch costs one
    product. A vector that is null, of another length, or holds a null has
    null predictions; equal scores give the smaller code.
    """
    heads = [(task, w[h], b[h]) for task, (w, b) in models.items() for h in range(w.shape[0])]
    weights, bias = np.vstack([w for _, w, _ in heads]), np.concatenate([b for _, _, b in heads])
    ends = np.cumsum([len(b) for _, _, b in heads])
    d = weights.shape[1]

    def predict(v: pd.Series) -> pd.DataFrame:
        ok, x = usable_vectors(v, d)
        codes = {task: [None] * len(v) for task in models}
        if ok.any():
            scores = x @ weights.T + bias
            best = [s.argmax(axis=1) for s in np.split(scores, ends[:-1], axis=1)]
            for task in models:
                own = np.stack([p for p, (t, _, _) in zip(best, heads, strict=True) if t == task], axis=1).astype(np.int32)
                for i, r in zip(np.flatnonzero(ok), own, strict=True):
                    codes[task][i] = r
        return pd.DataFrame(codes)

    kind = StructType([StructField(t, ArrayType(IntegerType())) for t in models])
    return df.withColumn(out, F.pandas_udf(predict, kind)(as_doubles(vec)))


def cascade_from_models(df: DataFrame, key: str, vec: str, cols: list[str], models: Models, names: list[str] = OFFLINE_FIELD_NAMES,
                        label_task: str = "cls", aspect_task: str = "acsa") -> DataFrame:
    """``key``, the predicted label and aspects, ``pre_tasks`` and the explanation task's ``text``.

    ``cols`` fill the offline text in the order of ``names``; ``pre_tasks`` is
    appended to it. A row without a usable vector keeps its text with nothing
    appended; its predictions and ``pre_tasks`` are null.
    """
    held = [F.col(c).alias(f"c_{i}") for i, c in enumerate(cols)]
    rows = score_tasks(df.select(F.col(key).alias("k"), *held, F.col(vec).alias("v")), "v", models)
    rows = rows.select("k", *[f"c_{i}" for i in range(len(cols))], F.get(f"tasks.{label_task}", F.lit(0)).alias("predicted_label"),
                       *[F.get(f"tasks.{aspect_task}", F.lit(i)).alias(c) for i, c in enumerate(ASPECT_OUTPUTS)])
    rows = rows.withColumn("pre_tasks", verbalise("predicted_label", F.array(*ASPECT_OUTPUTS)))
    text = assemble_text_offline([f"c_{i}" for i in range(len(cols))], names, extra=F.coalesce("pre_tasks", F.lit("")))
    return rows.select(F.col("k").alias(key), "predicted_label", *ASPECT_OUTPUTS, "pre_tasks", text.alias("text"))


def run_cascade(df: DataFrame, key: str, vec: str, cols: list[str], store: str, versions: dict[str, int], out_path: str,
                names: list[str] = OFFLINE_FIELD_NAMES) -> DataFrame:
    """The whole cascade: load the model set, score, write the output table and read it back."""
    spark = df.sparkSession
    result = cascade_from_models(df, key, vec, cols, load_models(spark, store, versions), names)
    write_csv(result, out_path)
    return read_postings(spark, out_path, result.schema)
