"""Trainable linear heads over given vectors, batch scoring and the cascade.

Training is distributed softmax regression: for every step each partition
computes its gradient with numpy inside ``mapInPandas`` and emits it as
``(head, index, value)`` rows; a ``groupBy`` sums them (the shuffle carries
partitions x model-size rows), the driver takes the summed gradient
(model-size, independent of data) and updates the weights, which the next
step ships in the task closure. A step is all rows (gradient descent) or one
numbered mini-batch (Adam), so the partitioning never changes the model. Small
steps follow one another inside one task, a bounded block of them per job.
Warm starts take any earlier weights. Rows that cannot train are left out and
counted (:func:`left_out`). Scoring is an Arrow-batched function with one
matrix product per batch; the weights travel with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from kestrel.codebook import ASPECT_OUTPUTS
from kestrel.functions.arrays import argmax_class, as_doubles, linear_scores, log_softmax
from kestrel.functions.labels import verbalise


# --- weights as a DataFrame ---------------------------------------------------

def weights_frame(spark, w: np.ndarray, b: np.ndarray) -> DataFrame:
    """``(head, cls, bias, w array<double>)`` rows from arrays of shape (H, k, d), (H, k)."""
    rows = [(h, c, float(b[h, c]), [float(x) for x in w[h, c]])
            for h in range(w.shape[0]) for c in range(w.shape[1])]
    return spark.createDataFrame(rows, "head int, cls int, bias double, w array<double>")


def weights_arrays(weights: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Collect a weight frame (bounded: heads x classes rows) into numpy arrays."""
    rows = weights.orderBy("head", "cls").collect()
    if not rows:
        raise ValueError("empty weight table")
    heads = max(r["head"] for r in rows) + 1
    k = max(r["cls"] for r in rows) + 1
    d = len(rows[0]["w"])
    w = np.zeros((heads, k, d))
    b = np.zeros((heads, k))
    for r in rows:
        w[r["head"], r["cls"]] = r["w"]
        b[r["head"], r["cls"]] = r["bias"]
    return w, b


def _labels(label: str, n_classes: int | None, multi: bool) -> Column:
    """One code per head; null where a head has no label or no class of that code."""
    fine = lambda y: F.when((y >= 0) & (F.lit(True) if n_classes is None else y < n_classes), y)
    y = F.col(label)
    return F.transform(y.cast("array<int>"), fine) if multi else F.array(fine(y.cast("int")))


def _finite(vec: str) -> Column:
    x = as_doubles(vec)
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def dimensions(df: DataFrame, vec: str) -> int | None:
    """The commonest length of the usable vectors (of equally common ones the longest)."""
    r = df.where(_finite(vec)).groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return r["d"] if r else None


def training_rows(df: DataFrame, vec: str, label: str, n_classes: int | None, d: int, n_heads: int | None = None,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """``x array<double>, y array<int>`` of the rows that can train, and the columns ``keep``.

    A row needs a finite vector of ``d`` entries and a label for one head at
    least; a head without a label (null, or no class of that code) skips it.
    """
    multi = n_heads is not None
    rows = df.where(_finite(vec) & (F.size(vec) == d)).select(as_doubles(vec).alias("x"), _labels(label, n_classes, multi).alias("y"), *keep)
    return rows.where(F.col("y").isNotNull() & (F.size("y") == (n_heads or 1)) & F.exists("y", lambda v: v.isNotNull()))


def left_out(df: DataFrame, vec: str, label: str, n_classes: int, d: int, n_heads: int | None = None) -> DataFrame:
    """What training leaves out, counted: ``rows, no_vector, no_label, labels, missing_labels``."""
    heads = n_heads or 1
    y = _labels(label, n_classes, n_heads is not None)
    y = F.when(F.size(y) == heads, y)
    known = F.coalesce(F.size(F.filter(y, lambda v: v.isNotNull())), F.lit(0))
    ok = F.coalesce(_finite(vec) & (F.size(vec) == d), F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    return df.select(ok.alias("ok"), known.alias("known")).agg(
        F.count(F.lit(1)).alias("rows"), count(~F.col("ok")).alias("no_vector"), count(F.col("ok") & (F.col("known") == 0)).alias("no_label"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("known"))), F.lit(0)).alias("labels"),
        F.coalesce(F.sum(F.when(F.col("ok") & (F.col("known") > 0), heads - F.col("known"))), F.lit(0)).alias("missing_labels"))


def centroid_weights(df: DataFrame, vec: str, label: str, n_heads: int | None = None) -> DataFrame:
    """A fixed head whose class rows are the class centroids (bias 0).

    One Arrow pass sums the vectors of each class per task; the sums that meet
    in the shuffle are tasks x heads x classes rows. ``label`` is a code, or an
    array with a code per head. Rows that cannot train are left out.
    """
    d = dimensions(df, vec)

    def add_up(batches):
        sums: dict[tuple[int, int], list] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            x, ys = _matrices(pdf)
            for h in range(ys.shape[1]):
                for c in np.unique(ys[:, h][ys[:, h] >= 0]):
                    of = ys[:, h] == c
                    old = sums.setdefault((h, int(c)), [0, np.zeros(x.shape[1])])
                    old[0] += int(of.sum())
                    old[1] += x[of].sum(axis=0)
        yield pd.DataFrame([(h, c, n, s.tolist()) for (h, c), (n, s) in sums.items()], columns=["head", "cls", "n", "s"])

    rows = training_rows(df, vec, label, None, d or 0, n_heads)
    parts = rows.mapInPandas(add_up, "head int, cls int, n long, s array<double>")
    per = (parts.select("head", "cls", "n", F.posexplode("s").alias("dim", "v")).groupBy("head", "cls", "dim")
           .agg((F.sum("v") / F.sum("n")).alias("v")))
    w = F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"])
    return per.groupBy("head", "cls").agg(w.alias("w")).select("head", "cls", F.lit(0.0).alias("bias"), "w")


# --- training -------------------------------------------------------------------

def _matrices(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and codes of a batch of :func:`training_rows`; -1 where a head has no label."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["x"]])
    ys = np.stack([np.asarray([-1 if c is None or c != c else c for c in v], dtype=np.int64) for v in pdf["y"]])
    return x, ys


def _arrays(batch: pa.RecordBatch, heads: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_matrices` of an Arrow batch with rows, whose ``y`` has ``heads`` entries."""
    x, y = batch.column("x").flatten(), batch.column("y").flatten()
    return x.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), y.fill_null(-1).to_numpy(zero_copy_only=False).reshape(-1, heads)


def _add_gradient(total: np.ndarray, every: np.ndarray, ys: np.ndarray, w: np.ndarray, b: np.ndarray) -> None:
    """Add the summed gradient, loss, hits and labelled rows of every head to ``total``."""
    for h in range(len(w)):
        known = ys[:, h] >= 0
        x, y = every[known], ys[known, h]
        if not len(x):
            continue
        z = x @ w[h].T + b[h]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        at = np.arange(len(y))
        loss = -np.log(np.maximum(p[at, y], 1e-300)).sum()
        hits = (p.argmax(axis=1) == y).sum()
        p[at, y] -= 1.0
        total[h] += np.concatenate([(p.T @ x).ravel(), p.sum(axis=0), [loss, hits, len(y)]])


def _gradient_rows(w: np.ndarray, b: np.ndarray):
    """Per task: summed gradient, loss, hits and labelled rows of every head."""
    H, k, d = w.shape

    def run(batches):
        total = np.zeros((H, k * d + k + 3))
        for pdf in batches:
            if not pdf.empty:
                _add_gradient(total, *_matrices(pdf), w, b)
        yield pd.DataFrame({"head": np.repeat(np.arange(H, dtype=np.int32), total.shape[1]),
                            "idx": np.tile(np.arange(total.shape[1], dtype=np.int32), H), "v": total.ravel()})

    return run


def _gradient(rows: DataFrame, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums of :func:`_gradient_rows` over all rows: an array of heads x (model + 3)."""
    H, k, d = w.shape
    total = np.zeros((H, k * d + k + 3))
    summed = rows.mapInPandas(_gradient_rows(w, b), "head int, idx int, v double").groupBy("head", "idx").agg(F.sum("v").alias("v"))
    for r in summed.collect():  # model-size rows
        total[r["head"], r["idx"]] = r["v"]
    return total


def _descend(w: np.ndarray, b: np.ndarray, got: np.ndarray, lr: float) -> None:
    """One step of gradient descent in place, along the mean of the sums ``got``."""
    H, k, d = w.shape
    for h in range(H):
        n = got[h, -1]
        if n:
            w[h] -= lr * got[h, :k * d].reshape(k, d) / n
            b[h] -= lr * got[h, k * d:-3] / n


def _adam_step(w: np.ndarray, b: np.ndarray, state: dict, got: np.ndarray, lr: float) -> None:
    """One step of Adam in place, along the mean of the sums ``got``; ``state`` keeps the moments and the step count."""
    H, k, d = w.shape
    b1, b2, eps = 0.9, 0.999, 1e-8
    state["t"] += 1
    for h in range(H):
        n = got[h, -1]
        g = got[h, :-3] / n if n else np.zeros(k * d + k)
        state["m"][h] = b1 * state["m"][h] + (1 - b1) * g
        state["v"][h] = b2 * state["v"][h] + (1 - b2) * g * g
        move = lr * (state["m"][h] / (1 - b1 ** state["t"])) / (np.sqrt(state["v"][h] / (1 - b2 ** state["t"])) + eps)
        w[h] -= move[:k * d].reshape(k, d)
        b[h] -= move[k * d:]


#: steps that follow one another in one task at most, and the numbers that its rows (or its models) may have
BLOCK_STEPS, BLOCK_VALUES = 64, 1 << 22
#: folders that a numbered epoch is cut into if a single step is too large for a task
STEP_BLOCKS = 64


def _in_order(batches: Iterator[pa.RecordBatch], by: str, heads: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Vectors, codes and ``by`` of a bounded block of rows, ordered by ``by``; None if there are none."""
    parts = [(*_arrays(x, heads), x.column(by).to_numpy(zero_copy_only=False)) for x in batches if x.num_rows]
    if not parts:
        return None
    x, ys, of = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(of, kind="stable")
    return x[order], ys[order], of[order]


def block_models(rows: DataFrame, by: str, w: np.ndarray, b: np.ndarray, steps: list[tuple[int, int, int]], chained: bool,
                 epochs: int, lr: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The model after gradient descent on the rows of each step ``(name, first, last)``: those with ``by`` from first to last.

    ``chained``: a step starts from the one before, else each from ``(w, b)``.
    ``rows`` are a bounded block of :func:`training_rows` with ``by``, whose
    steps one task takes; use :data:`BLOCK_VALUES`.
    """
    H, k, d = w.shape

    def run(batches):
        block = _in_order(batches, by, H)
        if block is None:
            return
        x, ys, of = block
        v, c = w.copy(), b.copy()
        for name, first, last in steps:
            if not chained:
                v, c = w.copy(), b.copy()
            lo, hi = np.searchsorted(of, [first, last + 1])
            for _ in range(epochs):
                total = np.zeros((H, k * d + k + 3))
                _add_gradient(total, x[lo:hi], ys[lo:hi], v, c)
                _descend(v, c, total, lr)
            yield pa.RecordBatch.from_pydict({"name": pa.array([name], pa.int64()), "model": pa.array([np.concatenate([v.ravel(), c.ravel()])], pa.list_(pa.float64()))})

    got = {r["name"]: np.array(r["model"]) for r in rows.repartition(1).mapInArrow(run, "name long, model array<double>").collect()}
    # without a row that can train, no step moves
    return {name: (got[name][:w.size].reshape(w.shape), got[name][w.size:].reshape(b.shape)) if got else (w.copy(), b.copy()) for name, _, _ in steps}


def _numbered_steps(rows: DataFrame, batch: int, seed: int, path: str, together: int) -> tuple[int, int]:
    """Write the rows with their step (seeded MD5 order of the content, ``batch`` rows a step), ``together`` steps in a folder.

    Returns the steps and the steps in a folder (chosen if ``together`` is 0).
    Equal rows are interchangeable, so the steps hold the same rows however
    the input is partitioned.
    """
    from kestrel.operators.sequence import number_rows
    content = F.concat_ws("|", F.lit(str(seed)), F.to_json(F.struct("x", "y")))
    numbered = number_rows(rows.withColumn("_h", F.md5(content)), ["_h"])
    step = F.floor((F.col("rn") - 1) / batch).cast("long")
    steps = F.ceil(F.col("total") / batch).cast("long")
    per = F.lit(together) if together else F.ceil(steps / STEP_BLOCKS)
    numbered.select("x", "y", step.alias("step"), steps.alias("steps"), F.floor(step / per).cast("int").alias("block")).write.partitionBy("block").parquet(path)
    last = rows.sparkSession.read.parquet(path).select("steps").first()
    last = last["steps"] if last else 0
    return last, together or max(1, -(-last // STEP_BLOCKS))


def _adam_block(block: DataFrame, w: np.ndarray, b: np.ndarray, state: dict, lr: float, totals: np.ndarray) -> None:
    """The steps of one folder in place, one after the other in one task."""
    H, k, d = w.shape
    size = (w.size, b.size, b.size + w.size, b.size + w.size, totals.size)

    def run(batches):
        rows = _in_order(batches, "step", H)
        if rows is None:
            return
        x, ys, of = rows
        v, c, stats = w.copy(), b.copy(), np.zeros((H, 3))
        now = {"t": state["t"], "m": state["m"].copy(), "v": state["v"].copy()}
        cuts = [*np.flatnonzero(np.diff(of, prepend=of[0] - 1)), len(of)]
        for lo, hi in zip(cuts, cuts[1:]):
            got = np.zeros((H, k * d + k + 3))
            _add_gradient(got, x[lo:hi], ys[lo:hi], v, c)
            stats += got[:, -3:]
            _adam_step(v, c, now, got, lr)
        flat = np.concatenate([z.ravel() for z in (v, c, now["m"], now["v"], stats)])
        yield pa.RecordBatch.from_pydict({"t": pa.array([now["t"]], pa.int64()), "v": pa.array([flat], pa.list_(pa.float64()))})

    r = block.select("x", "y", "step").repartition(1).mapInArrow(run, "t long, v array<double>").first()
    new = np.split(np.array(r["v"]), np.cumsum(size)[:-1])
    w[:], b[:] = new[0].reshape(w.shape), new[1].reshape(b.shape)
    state.update(t=r["t"], m=new[2].reshape(H, -1), v=new[3].reshape(H, -1))
    totals += new[4].reshape(H, 3)


def _adam_epoch(rows: DataFrame, w: np.ndarray, b: np.ndarray, state: dict, lr: float, batch: int, seed: int) -> np.ndarray:
    """One epoch of mini-batch Adam in place; returns loss, hits, rows per head.

    ``state`` keeps the moments and the step count over epochs. Small steps
    follow one another in one task, up to :data:`BLOCK_STEPS` of them a job;
    a step too large for that is one summed gradient over all tasks.
    """
    from kestrel.sources.tables import remove_path, scratch_path
    spark, (H, k, d) = rows.sparkSession, w.shape
    path = scratch_path(spark, f"adam-{uuid.uuid4().hex}")
    totals = np.zeros((H, 3))
    together = min(BLOCK_STEPS, BLOCK_VALUES // max(1, batch * d))
    try:
        steps, per = _numbered_steps(rows, batch, seed, path, together)
        for i in range(0, steps, per):
            block = spark.read.schema("x array<double>, y array<int>, step long").parquet(f"{path}/block={i // per}")
            if together:
                _adam_block(block, w, b, state, lr, totals)
                continue
            for step in range(i, min(i + per, steps)):
                got = _gradient(block.where(F.col("step") == step).select("x", "y"), w, b)
                totals += got[:, -3:]
                _adam_step(w, b, state, got, lr)
    finally:
        remove_path(spark, path)
    return totals


def train_heads(df: DataFrame, vec: str, label: str, n_classes: int, epochs: int = 5, lr: float = 0.5,
                init: tuple[np.ndarray, np.ndarray] | None = None, n_heads: int | None = None,
                history: list | None = None, method: str = "gd", batch_size: int = 32,
                seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Train softmax-regression heads; returns the new ``(w, b)``.

    ``method="gd"``: full-batch gradient descent, one pass per epoch.
    ``method="adam"``: mini-batches of ``batch_size`` rows in a seeded order
    of every epoch, one summed gradient and one Adam step each, moments kept
    over epochs (as the original trains; use a small ``lr`` such as 1e-3).
    Steps follow one another: small ones run in blocks, one task a block, so
    on large data a large ``batch_size`` uses more of the cluster.
    Both give the same model for any partitioning, up to the rounding of sums.
    ``label`` is an int column (one head) or an int array column with
    ``n_heads`` entries (one head per entry, e.g. the four aspects; their
    losses add up). ``init`` warm-starts from earlier ``(w, b)``. Rows and
    labels that cannot train are left out. Per-epoch
    ``(epoch, head, loss, acc, n)`` go to ``history``.
    """
    if method not in ("gd", "adam"):
        raise ValueError(method)
    H = n_heads or 1
    d = init[0].shape[2] if init is not None else dimensions(df, vec)
    if d is None:
        raise ValueError("no training rows")
    w, b = (init[0].copy(), init[1].copy()) if init is not None else (np.zeros((H, n_classes, d)), np.zeros((H, n_classes)))
    rows = training_rows(df, vec, label, n_classes, d, n_heads)
    state = {"t": 0, "m": np.zeros((H, n_classes * d + n_classes)), "v": np.zeros((H, n_classes * d + n_classes))}
    keep = method == "gd" and epochs > 1  # one pass needs no copy
    if keep:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for e in range(epochs):
            if method == "adam":
                stats = _adam_epoch(rows, w, b, state, lr, batch_size, seed + e)
            else:
                got = _gradient(rows, w, b)
                stats = got[:, -3:]
                _descend(w, b, got, lr)
            if history is not None:
                history += [(e + 1, h, float(loss / n), float(hits / n), int(n)) for h, (loss, hits, n) in enumerate(stats) if n]
    finally:
        if keep:
            rows.unpersist()
    return w, b


# --- scoring ----------------------------------------------------------------------

def pair_counts(rows: DataFrame, models: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``(model, aspect, t, p, n)``: the true and predicted classes of every head by every model, in one pass.

    ``rows`` are :func:`training_rows`; a head without a label skips the row,
    the first index wins ties. A task emits at most models x heads x classes^2 rows.
    """
    heads, k, _ = models[0][0].shape

    def run(batches):
        counts: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            every, ys = _arrays(batch, heads)
            for h in range(heads):
                known = ys[:, h] >= 0
                x = every[known]
                codes, at = np.unique(ys[known, h], return_inverse=True)
                for c in codes:
                    counts.setdefault((h, int(c)), np.zeros((len(models), k), dtype=np.int64))
                for i, (w, b) in enumerate(models):
                    p = np.argmax(x @ w[h].T + b[h], axis=1)
                    for c, n in zip(codes, np.bincount(at * k + p, minlength=len(codes) * k).reshape(-1, k)):
                        counts[h, int(c)][i] += n
        out = [(i, h, c, p, int(n[i, p])) for (h, c), n in counts.items() for i, p in zip(*(z.tolist() for z in np.nonzero(n)))]
        kinds = {"model": pa.int32(), "aspect": pa.int32(), "t": pa.int32(), "p": pa.int32(), "n": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds.values())], names=list(kinds))

    parts = rows.mapInArrow(run, "model int, aspect int, t int, p int, n long")
    return parts.groupBy("model", "aspect", "t", "p").agg(F.sum("n").alias("n"))


def _place(ok: np.ndarray, rows) -> pd.Series:
    """Rows back at the usable positions; other vectors give null."""
    if ok.all():
        return pd.Series(list(rows))
    out = [None] * len(ok)
    for i, r in zip(np.flatnonzero(ok), rows):
        out[i] = r
    return pd.Series(out, dtype=object)


def usable_vectors(v: pd.Series, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can be scored (not null, ``d`` entries, none of them null), and those as a matrix."""
    ok = np.array([x is not None and len(x) == d and not np.isnan(np.asarray(x, dtype=np.float64)).any() for x in v], dtype=bool)
    if not ok.any():
        return ok, np.zeros((0, 0))
    return ok, np.stack([np.asarray(x, dtype=np.float64) for x in v[ok]])


def head_scores(vec, w: np.ndarray, b: np.ndarray, head: int = 0, engine: str = "arrow") -> Column:
    """Class scores ``W @ vec + b`` of one head.

    ``arrow`` (default): an Arrow-batched pandas UDF doing one matrix
    product per batch. ``native``: literal weights in higher-order array
    functions. Measured on 600k rows x 64 dims x 10 classes (local[8]):
    native 6-8 s, arrow 1.4 s, because higher-order functions run
    interpreted row by row while the batch product runs in BLAS.
    """
    if engine == "native":
        return linear_scores(vec, w[head].tolist(), b[head].tolist())
    wh, bh = w[head], b[head]  # they travel with the function

    def scores(v: pd.Series) -> pd.Series:
        ok, x = usable_vectors(v, wh.shape[1])
        return _place(ok, x @ wh.T + bh if ok.any() else [])

    return F.pandas_udf(scores, ArrayType(DoubleType()))(as_doubles(vec))


def head_predictions(vec, w: np.ndarray, b: np.ndarray) -> Column:
    """Arg-max class of every head (``array<int>``, first index wins ties) in one pass."""
    def preds(v: pd.Series) -> pd.Series:
        ok, x = usable_vectors(v, w.shape[2])
        if not ok.any():
            return _place(ok, [])
        p = np.stack([np.argmax(x @ w[h].T + b[h], axis=1) for h in range(w.shape[0])], axis=1)
        return _place(ok, p.astype(np.int32))

    return F.pandas_udf(preds, ArrayType(IntegerType()))(as_doubles(vec))


def score_batch(df: DataFrame, vec: str, w: np.ndarray, b: np.ndarray, prefix: str = "",
                engine: str = "arrow") -> DataFrame:
    """Add per-head scores, log-probabilities and the arg-max prediction.

    One head: ``scores``, ``logp``, ``pred`` (int). Several heads:
    ``pred`` is an int array with one prediction per head.
    """
    H = w.shape[0]
    if H == 1:
        out = df.withColumn(prefix + "scores", head_scores(vec, w, b, engine=engine))
        out = out.withColumn(prefix + "logp", log_softmax(prefix + "scores"))
        return out.withColumn(prefix + "pred", argmax_class(prefix + "scores"))
    if engine == "native":
        preds = F.when(F.col(vec).isNotNull(),
                       F.array(*[argmax_class(head_scores(vec, w, b, h, engine)) for h in range(H)]))
    else:
        preds = head_predictions(vec, w, b)
    return df.withColumn(prefix + "pred", preds)


# --- cascade --------------------------------------------------------------------------

def task1_output(df: DataFrame, key: str, label_scores: str) -> DataFrame:
    """Label task output: ``key, predicted_label``."""
    return df.select(key, argmax_class(label_scores).alias("predicted_label"))


def task2_output(df: DataFrame, key: str, aspect_scores: str, n_aspects: int = 4, width: int = 4) -> DataFrame:
    """Aspect task output: one predicted code per aspect column."""
    s = as_doubles(aspect_scores)
    return df.select(key, *[argmax_class(F.slice(s, i * width + 1, width)).alias(ASPECT_OUTPUTS[i])
                            for i in range(n_aspects)])


def join_task_outputs(t1: DataFrame, t2: DataFrame, key: str) -> DataFrame:
    """Align the two task outputs by row id (never by position)."""
    return t1.join(t2, key, "inner")


def cascade(df: DataFrame, key: str, label_scores: str, aspect_scores: str, n_aspects: int = 4,
            width: int = 4) -> DataFrame:
    """Label task, aspect task and the verbalised context for the explanation task.

    When both score sets live on the same rows the two task outputs are one
    projection (one scan, no shuffle); outputs produced separately are
    aligned with :func:`join_task_outputs` instead.
    """
    s = as_doubles(aspect_scores)
    out = df.select(key, argmax_class(label_scores).alias("predicted_label"),
                    *[argmax_class(F.slice(s, i * width + 1, width)).alias(ASPECT_OUTPUTS[i])
                      for i in range(n_aspects)])
    return out.withColumn("pre_tasks", verbalise("predicted_label", F.array(*ASPECT_OUTPUTS[:n_aspects])))
