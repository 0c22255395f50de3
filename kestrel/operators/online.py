"""Online learning over N-row triggers with three strategies, for both tasks.

* ``continue``: every trigger trains from the previous trigger's weights;
* ``champion``: every trigger trains from the best registered version;
* ``replay``: as ``champion``, and every M-th trigger trains on the last M
  batches (N*M rows) instead of its own N.

The label task has one head, the aspect task one per aspect (its metrics are
means over the aspects). The rows are numbered once and written by batch, so
a trigger's rows are exactly those of its ledger entry, tied keys included.
After training, the heads are evaluated on the dev set (one pass, count
table), the weights are saved under the next version, and then the evaluation
record is written, which names them: a version without a record does not
exist, and a step cut off in between is done again. The loop over triggers is
sequential by nature: each starts from the previous outcome.

Small triggers are worked off in blocks: one job trains a block, one pass over
the dev set evaluates all its models, one write keeps them. ``continue`` trains
a block as one chain, since its evaluations decide nothing. With the other
strategies all triggers up to the next better version start from the same
champion, so a block trains each of them from it; a better version ends the
block, and the triggers behind it are trained again from that version. The
records are those of one trigger after the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import heads as H
from kestrel.operators import metrics as M
from kestrel.operators.sequence import trigger_batches
from kestrel.sources.tables import append_rows, load_weights, path_exists, remove_path, save_weights_many, scratch_path

RECORD_SCHEMA = ("version int, task string, pretrained string, classifier string, split string, trigger_id long, kind string, "
                 "rows long, start_version int, acc double, avg_pre double, avg_recall double, avg_f1 double, artefact string")

#: batches in one folder of the numbered rows
BATCHES_A_FOLDER = 256


def evaluate_many(dev: DataFrame, vec: str, label: str, models: list[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
    """:func:`evaluate` of several models of one shape by one pass over the rows."""
    heads, _, d = models[0][0].shape
    rows = H.training_rows(dev, vec, label, None, d, heads if heads > 1 else None)
    # a bounded table in a fixed order: equal counts give equal means to the last bit
    counts = H.pair_counts(rows, models).coalesce(1).sortWithinPartitions("model", "aspect", "t", "p")
    found = M.aspect_mean(M.cls_metrics(counts, by=["model", "aspect"]), by="model").collect()
    per = {r["model"]: {"acc": r["acc"], "avg_pre": r["precision"], "avg_recall": r["recall"], "avg_f1": r["f1"]} for r in found}
    return [per.get(i, dict.fromkeys(("acc", "avg_pre", "avg_recall", "avg_f1"))) for i in range(len(models))]


def evaluate(dev: DataFrame, vec: str, label: str, w: np.ndarray, b: np.ndarray) -> dict:
    """Accuracy and macro precision/recall/F1 on labelled rows; several heads: the mean over them.

    Rows without a usable vector and labels that are null take no part.
    """
    return evaluate_many(dev, vec, label, [(w, b)])[0]


class RunStore:
    """Weights and evaluation records of one run on shared storage, visible together.

    Weights are written first, under ``task=.../version=...``; the record, which
    names them in ``artefact``, last. Readers go by the records.
    """

    def __init__(self, spark: SparkSession, registry: str, store: str, task: str):
        self.spark, self.registry, self.store, self.task = spark, registry, store, task

    def named(self, rec: dict) -> dict:
        return rec | {"artefact": f"task={self.task}/version={rec['version']}"}

    def put(self, recs: list[dict], models: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Write the weights of the records (none if ``models`` is empty), then the records in one file."""
        if models:
            rows = [(r["version"], h, c, float(b[h, c]), w[h, c].tolist()) for r, (w, b) in zip(recs, models) for h in range(len(w)) for c in range(w.shape[1])]
            save_weights_many(self.spark.createDataFrame(rows, "version int, head int, cls int, bias double, w array<double>"), self.store, self.task)
        append_rows(self.spark.createDataFrame([tuple(r[c] for c in OnlineLearner.FIELDS) for r in recs], RECORD_SCHEMA).coalesce(1), self.registry)

    def records(self) -> DataFrame:
        rows = self.spark.read.schema(RECORD_SCHEMA).parquet(self.registry) if path_exists(self.spark, self.registry) \
            else self.spark.createDataFrame([], RECORD_SCHEMA)
        return rows.where(F.col("task") == self.task)

    def resume(self, learner: OnlineLearner) -> bool:
        """Give the learner the newest record and the champion of the store; false if there is none."""
        dev = self.records().where(F.col("split") == "dev")
        newest = dev.orderBy(F.desc("version")).limit(1).collect()
        if not newest:
            return False
        best = dev.orderBy(F.desc_nulls_last("avg_f1"), "version").limit(1).collect()
        pair = {r["version"]: r.asDict() for r in (*best, *newest)}
        learner.restore(list(pair.values()), lambda v: H.weights_arrays(load_weights(self.spark, self.store, self.task, v)))
        return True


class OnlineLearner:
    """State of one run: the newest record, the champion, and the weights that can still seed a trigger."""

    FIELDS = ("version", "task", "pretrained", "classifier", "split", "trigger_id", "kind", "rows", "start_version",
              "acc", "avg_pre", "avg_recall", "avg_f1", "artefact")

    def __init__(self, vec: str, label: str, dev: DataFrame, n_classes: int, strategy: str, m: int,
                 epochs: int = 1, lr: float = 0.5, method: str = "gd", task: str = "cls", n_heads: int | None = None,
                 pretrained: str = "given vectors", classifier: str = "linear", store: RunStore | None = None):
        if strategy not in ("continue", "champion", "replay"):
            raise ValueError(strategy)
        self.vec, self.label, self.dev, self.k, self.n_heads = vec, label, dev, n_classes, n_heads
        self.strategy, self.m, self.epochs, self.lr, self.method = strategy, m, epochs, lr, method
        self.names = {"task": task, "pretrained": pretrained, "classifier": classifier}
        self.store = store
        self.newest: dict | None = None
        self.champion: dict | None = None
        self.models: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.ahead: dict[int, tuple[tuple, dict]] = {}  # trigger -> model and figures, if no better version comes before
        self.pending: list[tuple[dict, tuple]] = []  # steps of this block, not written yet

    def start(self, w0: np.ndarray, b0: np.ndarray) -> dict:
        """Register version 1 (the start model)."""
        rec = dict(version=1, **self.names, split="dev", trigger_id=0, kind="start", rows=0, start_version=None, artefact=None,
                   **evaluate(self.dev, self.vec, self.label, w0, b0))
        return self._add(rec, (w0, b0))

    def restore(self, records: list[dict], weights) -> None:
        """Continue from the newest record and the champion; ``weights(version)`` loads a version."""
        self.newest = max(records, key=lambda r: r["version"])
        self.champion = max(records, key=self._rank)
        self.models = {v: weights(v) for v in {self.champion["version"], self.newest["version"]}}

    @staticmethod
    def _rank(rec: dict) -> tuple:
        f1 = rec["avg_f1"]
        return f1 is not None, f1 or 0.0, -rec["version"]

    def base_version(self) -> int:
        return (self.newest if self.strategy == "continue" else self.champion)["version"]

    def batches(self, trigger_id: int) -> tuple[int, int]:
        """The first and the last batch that a trigger trains on."""
        again = self.strategy == "replay" and trigger_id % self.m == 0
        return (trigger_id - self.m + 1 if again else trigger_id), trigger_id

    def ahead_at_most(self, n: int) -> int:
        """How many triggers of ``n`` rows one job may train now; 0: a trigger's rows are too many for one task.

        At most half of what is done already, which is all that a cut-off run
        repeats, and few triggers behind a new champion, which may soon have a better one.
        """
        w, b = self.models[self.base_version()]
        again = self.m - 1 if self.strategy == "replay" else 0
        fit = min(H.BLOCK_VALUES // max(1, n * w.shape[2]) - again, H.BLOCK_VALUES // max(1, w.size + b.size), H.BLOCK_VALUES // (b.size * b.shape[1]))
        if self.method != "gd" or fit < 1:
            return 0
        now = self.newest["version"]
        grown = now // 2 if self.strategy == "continue" else min(now // 2, 2 * (now - self.champion["version"]))
        return max(1, min(H.BLOCK_STEPS, fit, grown))

    def look_ahead(self, rows_of: Callable[[int, int], DataFrame], trigger_id: int, last: int, n: int) -> None:
        """Train and evaluate the next triggers up to ``last`` together, unless ``trigger_id`` is done so already.

        ``rows_of(first, last)`` are the rows of these batches, with ``_batch``; a batch has ``n`` rows.
        """
        if trigger_id in self.ahead:
            return
        self.ahead.clear()
        todo = [(t, *self.batches(t)) for t in range(trigger_id, min(last, trigger_id + self.ahead_at_most(n) - 1) + 1)]
        if not todo:
            return
        w, b = self.models[self.base_version()]
        part = rows_of(min(first for _, first, _ in todo), todo[-1][2])
        rows = H.training_rows(part, self.vec, self.label, self.k, w.shape[2], self.n_heads, keep=("_batch",))
        models = H.block_models(rows, "_batch", w, b, todo, self.strategy == "continue", self.epochs, self.lr)
        figures = evaluate_many(self.dev, self.vec, self.label, list(models.values()))
        self.ahead = {t: (model, f) for (t, model), f in zip(models.items(), figures)}

    def step(self, rows_df: DataFrame, trigger_id: int, rows: int) -> tuple[dict, tuple]:
        """Train on one trigger's rows from the base weights, evaluate, save and register; as looked ahead, if it was."""
        base = self.base_version()
        if trigger_id in self.ahead:
            (w, b), figures = self.ahead.pop(trigger_id)
        else:
            self.ahead.clear()
            w, b = H.train_heads(rows_df, self.vec, self.label, self.k, epochs=self.epochs, lr=self.lr, n_heads=self.n_heads,
                                 init=self.models[base], method=self.method, seed=trigger_id)
            figures = evaluate(self.dev, self.vec, self.label, w, b)
        kind = "replay" if self.strategy == "replay" and trigger_id % self.m == 0 else "own"
        rec = dict(version=self.newest["version"] + 1, **self.names, split="dev", trigger_id=trigger_id, kind=kind, rows=rows,
                   start_version=base, artefact=None, **figures)
        return self._add(rec, (w, b)), (w, b)

    def test(self, test: DataFrame) -> dict:
        """Evaluate the champion on the test split: a record of its version, no new one."""
        w, b = self.models[self.champion["version"]]
        rec = self.champion | {"split": "test"} | evaluate(test, self.vec, self.label, w, b)
        if self.store:
            rec = self.store.named(rec)
            self.store.put([rec], [])
        return rec

    def _add(self, rec: dict, wb) -> dict:
        if self.store:
            rec = self.store.named(rec)
        self.newest = rec
        self.models[rec["version"]] = wb
        if self.champion is None or self._rank(rec) > self._rank(self.champion):
            self.champion = rec
            if self.strategy != "continue":
                self.ahead.clear()  # what follows starts from this version
        # only the champion and the newest weights can seed a later trigger
        keep = {self.champion["version"], rec["version"]}
        self.models = {v: x for v, x in self.models.items() if v in keep}
        if self.store:
            self.pending.append((rec, wb))
            if not self.ahead:  # the block ends here
                recs, models = zip(*self.pending)
                self.store.put(list(recs), list(models))
                self.pending = []
        return rec


def number_batches(train: DataFrame, key: str, n: int, path: str) -> int:
    """Write the rows of all full batches with their ``batch_id``; returns the number of batches."""
    rows = trigger_batches(train, key, n)
    folder = F.floor((F.col("batch_id") - 1) / BATCHES_A_FOLDER)
    (rows.select(*train.columns, F.col("batch_id").alias("_batch"), folder.alias("_folder"))
     .write.partitionBy("_folder").parquet(path))
    last = train.sparkSession.read.schema(rows.select(*train.columns).schema.add("_batch", "long").add("_folder", "long")).parquet(path)
    return last.agg(F.max("_batch")).first()[0] or 0


def online_learn(train: DataFrame, key: str, vec: str, label: str, dev: DataFrame, n_classes: int,
                 strategy: str, n: int, m: int, epochs: int = 1, lr: float = 0.5,
                 start: tuple[np.ndarray, np.ndarray] | None = None, method: str = "gd", task: str = "cls",
                 n_heads: int | None = None, test: DataFrame | None = None, registry: str | None = None,
                 store: str | None = None) -> DataFrame:
    """Run the strategy over all full triggers of a table; returns the evaluation records.

    Records and weights go to ``registry`` and ``store`` (new folders of the
    shared scratch folder if not given). A run whose records are there goes on
    behind the last one. ``test`` adds the champion's record on that split.
    """
    spark, run = train.sparkSession, uuid.uuid4().hex
    records = RunStore(spark, registry or scratch_path(spark, f"online-{run}/registry"), store or scratch_path(spark, f"online-{run}/store"), task)
    learner = OnlineLearner(vec, label, dev, n_classes, strategy, m, epochs, lr, method, task, n_heads, store=records)
    if not records.resume(learner):
        heads = n_heads or 1
        d = H.dimensions(train, vec) or 0
        learner.start(*(start if start is not None else (np.zeros((heads, n_classes, d)), np.zeros((heads, n_classes)))))
    path = scratch_path(spark, f"online-{run}/batches")
    rows = train.select(*dict.fromkeys([key, vec, label]))
    try:
        batches = number_batches(rows, key, n, path)
        stored = spark.read.parquet(path) if batches else None

        def rows_of(first: int, last: int) -> DataFrame:
            folders = f"_folder between {(first - 1) // BATCHES_A_FOLDER} and {(last - 1) // BATCHES_A_FOLDER}"
            return stored.where(f"{folders} and _batch between {first} and {last}")

        for t in range(learner.newest["trigger_id"] + 1, batches + 1):
            learner.look_ahead(rows_of, t, batches, n)
            first, last = learner.batches(t)
            learner.step(rows_of(first, last), t, n * (last - first + 1))
    finally:
        remove_path(spark, path)
    if test is not None:
        learner.test(test)
    return records.records()
