"""Streaming scoring (R1, S1, S2): request messages in, keyed JSON responses out.

One stateless plan: parse the message, score with the head in an
Arrow-batched function, format the response. No ``collect`` per micro-batch; the sink is
any streaming format (Kafka when its connector is present, files otherwise).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.arrays import argmax_class, argmax_per_group, with_fallback
from kestrel.operators.cascade import score_tasks
from kestrel.operators.heads import head_scores
from kestrel.sources.messages import list_text


Weights = tuple[np.ndarray, np.ndarray]


def score_requests(requests: DataFrame, w: np.ndarray | None, b: np.ndarray | None,
                   aspect_scores=None, aspects: Weights | None = None) -> DataFrame:
    """``key, id, data`` -> ``key, value`` responses ``{id, prediction, acsa, data}``.

    ``data`` holds the model input vector as JSON. A missing label head
    answers -1; missing aspect heads answer ``[-1, -1, -1, -1]``. Aspects come
    from the weights ``aspects`` (a head per aspect; with a label head both
    score in one Arrow pass) or from given scores (``aspect_scores``). A vector
    that no head can score has both fallbacks.
    """
    # parse the vector once; both heads read the parsed column
    parsed = requests.withColumn("_vec", F.from_json(F.col("data"), "array<double>"))
    vec = F.col("_vec")
    if aspects is not None:
        models = {"acsa": aspects} | ({"cls": (w, b)} if w is not None else {})
        parsed = score_tasks(parsed, "_vec", models, "_tasks")
        label = F.get("_tasks.cls", F.lit(0)) if w is not None else F.lit(None).cast("int")
        return _responses(parsed, label, F.col("_tasks.acsa"))
    pred: Column = argmax_class(head_scores(vec, w, b)) if w is not None else F.lit(None).cast("int")
    acsa = argmax_per_group(aspect_scores(vec), 4, 4) if aspect_scores is not None \
        else F.lit(None).cast("array<int>")
    return _responses(parsed, pred, acsa)


def _responses(parsed: DataFrame, pred: Column, acsa: Column) -> DataFrame:
    out = parsed.select("key", "id", "data", with_fallback(pred).alias("prediction"),
                        with_fallback(acsa, 4).alias("acsa"))
    value = F.to_json(F.struct("id", "prediction", list_text("acsa").alias("acsa"), "data"))
    return out.select(F.col("key").cast("string"), value.alias("value"))


def champion_scorer(registry_path: str, store_path: str, sink_path: str, task: str = "cls",
                    aspect_scores=None, aspect_task: str | None = None):
    """``foreachBatch`` scorer that serves the current champions of both tasks.

    At the start of every micro-batch it reads the registry and the stored
    artefacts (both one row per version), picks for each task the best version
    that has an artefact, loads its weights and scores the batch; ``version``
    and ``aspect_version`` say which served (null: none, the fallback answers). Responses go to the
    sink partition of that micro-batch, replaced on a replay, so a repeated
    micro-batch does not answer twice.
    """
    from kestrel.operators.heads import weights_arrays
    from kestrel.operators.registry import best_servable_version
    from kestrel.sources.tables import load_weights, stored_versions

    def champion(spark, name: str | None) -> tuple[int | None, Weights | None]:
        if name is None:
            return None, None
        reg = spark.read.parquet(registry_path).where(F.col("task") == name)
        best = best_servable_version(reg, stored_versions(spark, store_path)).first()
        if best is None:
            return None, None
        version = int(best["version"])
        return version, weights_arrays(load_weights(spark, store_path, name, version))

    def run(batch: DataFrame, batch_id: int) -> None:
        version, label = champion(batch.sparkSession, task)
        aspect_version, aspects = champion(batch.sparkSession, aspect_task)
        out = score_requests(batch, *(label or (None, None)), aspect_scores, aspects).withColumn("version", F.lit(version).cast("int"))
        if aspect_task is not None:
            out = out.withColumn("aspect_version", F.lit(aspect_version).cast("int"))
        (out.withColumn("_mb", F.lit(int(batch_id))).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("_mb").parquet(sink_path))

    return run
