"""Online learning driven by the trigger stream (R2-R7 together).

``stage_and_cut`` hands every micro-batch's new ledger rows to a
:class:`StreamingLearner`, which trains one step per trigger, small ones in blocks; the learner's
store keeps weights and records on shared storage, so a restarted stream goes
on from the stored champion and newest version. Triggers come in order, so a
replayed micro-batch finds its triggers at or below the newest record's and
skips them; no list of past triggers is kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.online import OnlineLearner, RunStore
from kestrel.streaming.triggers import triggered


class StreamingLearner:
    """``on_trigger`` callback of :func:`kestrel.streaming.triggers.stream_trigger`."""

    def __init__(self, spark: SparkSession, key: str, vec: str, label: str, dev: DataFrame, n_classes: int,
                 strategy: str, m: int, staging: str, ledger: str, registry: str, store: str,
                 start: tuple[np.ndarray, np.ndarray], task: str = "cls", epochs: int = 1, lr: float = 0.5,
                 method: str = "gd", n_heads: int | None = None):
        self.key, self.staging, self.ledger = key, staging, ledger
        self.store = RunStore(spark, registry, store, task)
        self.learner = OnlineLearner(vec, label, dev, n_classes, strategy, m, epochs, lr, method, task, n_heads, store=self.store)
        if not self.store.resume(self.learner):
            self.learner.start(*start)

    def __call__(self, spark: SparkSession, new_ledger: DataFrame) -> None:
        new = new_ledger.where(F.col("trigger_id") > self.learner.newest["trigger_id"]).agg(
            F.min("trigger_id").alias("lo"), F.max("trigger_id").alias("hi"), F.max("n").alias("n")).first()
        if new["lo"] is None:
            return
        staged = triggered(spark, self.staging).withColumnRenamed("_trigger", "_batch").drop("_mb")
        rows_of = lambda first, last: staged.where(f"_batch between {first} and {last}")
        sizes: dict[int, int] = {}  # rows of the batches looked at
        for t in range(new["lo"], new["hi"] + 1):
            first, last = self.learner.batches(t)
            if t not in self.learner.ahead:
                self.learner.look_ahead(rows_of, t, new["hi"], new["n"])
                until = max([last, *self.learner.ahead])
                sizes = {r["_batch"]: r["count"] for r in rows_of(first, until).groupBy("_batch").count().collect()}
            missing = [i for i in range(first, last + 1) if i not in sizes]
            if missing:  # a replay's batches before those of this block
                sizes |= {r["_batch"]: r["count"] for r in rows_of(missing[0], missing[-1]).groupBy("_batch").count().collect()}
            self.learner.step(rows_of(first, last), t, sum(sizes.get(i, 0) for i in range(first, last + 1)))

    def registry_frame(self, spark: SparkSession) -> DataFrame:
        return self.store.records()
