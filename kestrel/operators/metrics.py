"""Classification and multi-aspect metrics.

Every metric is derived from one small count table ``(by..., t, p, n)``:
the only data-sized step is ``groupBy(by, t, p).count()``, which Spark
pre-aggregates on the map side, so the shuffle carries at most
``groups x classes^2`` rows however large or skewed the input is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.codebook import EPS
from kestrel.functions.arrays import mismatches


def _by(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def count_table(df: DataFrame, t: str, p: str, by=None) -> DataFrame:
    """``(by..., t, p, n)``: one row per observed (true, predicted) pair."""
    keys = _by(by)
    return (df.groupBy(*keys, F.col(t).alias("t"), F.col(p).alias("p"))
              .agg(F.count(F.lit(1)).alias("n")))


def aspect_long(df: DataFrame, t: str, p: str, id_col: str | None = None) -> DataFrame:
    """Arrays of per-aspect codes -> one row per (row, aspect) with ``aspect, t, p``."""
    keep = [id_col] if id_col else []
    z = df.select(*keep, F.posexplode(F.arrays_zip(F.col(t).alias("t"), F.col(p).alias("p"))))
    return z.select(*keep, F.col("pos").cast("int").alias("aspect"),
                    F.col("col.t").alias("t"), F.col("col.p").alias("p"))


def per_class_metrics(counts: DataFrame, by=None) -> DataFrame:
    """Precision, recall, F1 and support per class.

    Classes are the union of true and predicted codes; an empty denominator
    gives 0. Each count row contributes to its true class (support, and tp
    when correct) and to its predicted class (predicted count); no join.
    """
    keys = _by(by)
    contrib = counts.select(*keys, F.explode(F.array(
        F.struct(F.col("t").alias("cls"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )).alias("c")).select(*keys, "c.*")
    agg = contrib.groupBy(*keys, "cls").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"))
    return agg.select(
        *keys, "cls", "tp", "support", "predicted",
        F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0).alias("precision"),
        F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0).alias("recall"),
        F.when(F.col("support") + F.col("predicted") > 0,
               2.0 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0).alias("f1"),
    )


def cls_metrics(counts: DataFrame, by=None, average: str = "macro") -> DataFrame:
    """Accuracy plus averaged precision/recall/F1 (``macro``, ``micro``, ``weighted``)."""
    keys = _by(by)
    pc = per_class_metrics(counts, by)
    acc = (F.sum("tp") / F.sum("support")).alias("acc")
    if average == "macro":
        return pc.groupBy(*keys).agg(acc, F.avg("precision").alias("precision"),
                                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    if average == "micro":
        return pc.groupBy(*keys).agg(
            acc, (F.sum("tp") / F.sum("predicted")).alias("precision"),
            (F.sum("tp") / F.sum("support")).alias("recall"),
            (2.0 * F.sum("tp") / (F.sum("support") + F.sum("predicted"))).alias("f1"))
    if average == "weighted":
        w = F.sum("support")
        return pc.groupBy(*keys).agg(
            acc, (F.sum(F.col("precision") * F.col("support")) / w).alias("precision"),
            (F.sum(F.col("recall") * F.col("support")) / w).alias("recall"),
            (F.sum(F.col("f1") * F.col("support")) / w).alias("f1"))
    raise ValueError(f"unknown average {average!r}")


def confusion_matrix(counts: DataFrame, codes: list[int], by=None, prefix: str = "p") -> DataFrame:
    """A row per true class and a column per predicted one, zeros filled.

    Every code of the list has its row and column in each group, also one
    that is never true or never predicted; codes outside the list raise.
    """
    keys = _by(by)
    stray = ~F.col("t").isin(*codes) | ~F.col("p").isin(*codes)
    counts = counts.withColumn("n", F.when(stray, F.raise_error(F.lit("a class is not in the list of codes")).cast("long")).otherwise(F.col("n")))
    groups = counts.select(*keys).distinct() if keys else counts.sparkSession.range(1).select()
    kind = {f.name: f.dataType for f in counts.schema}
    zero = groups.select(*keys, F.explode(F.array(*[F.lit(c).cast(kind["t"]) for c in codes])).alias("t"),
                         F.lit(codes[0]).cast(kind["p"]).alias("p"), F.lit(0).cast("long").alias("n"))
    counts = counts.select(*keys, "t", "p", "n").unionByName(zero)
    out = counts.groupBy(*keys, "t").pivot("p", codes).agg(F.sum("n")).na.fill(0)
    return out.select(*keys, "t", *[F.col(str(c)).cast("long").alias(f"{prefix}{c}") for c in codes])


def aspect_metrics(df: DataFrame, t: str, p: str, average: str = "macro") -> DataFrame:
    """Per-aspect metrics (``aspect`` column) from per-row code arrays."""
    counts = count_table(aspect_long(df, t, p), "t", "p", by="aspect")
    return cls_metrics(counts, by="aspect", average=average)


def aspect_mean(per_aspect: DataFrame, by=None) -> DataFrame:
    """Unweighted mean of per-aspect metrics over the aspects."""
    return per_aspect.groupBy(*_by(by)).agg(*[F.avg(c).alias(c) for c in ("acc", "precision", "recall", "f1")])


def aspect_tp_fp_fn(counts: DataFrame, n_aspects: int = 4, n_classes: int = 4) -> DataFrame:
    """TP, FP, FN for a fixed grid of aspects x classes; absent cells are 0.

    ``counts`` is ``(aspect, t, p, n)``. The zero grid is a literal of
    ``n_aspects * n_classes`` rows unioned in, so no join is needed.
    """
    spark = counts.sparkSession
    contrib = counts.select("aspect", F.explode(F.array(
        F.struct(F.col("t").alias("cls"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("fp"),
                 F.when(F.col("t") != F.col("p"), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("tp"),
                 F.when(F.col("t") != F.col("p"), F.col("n")).otherwise(0).alias("fp"),
                 F.lit(0).cast("long").alias("fn")),
    )).alias("c")).select("aspect", "c.*")
    grid = spark.createDataFrame(
        [(a, c, 0, 0, 0) for a in range(n_aspects) for c in range(n_classes)],
        "aspect int, cls int, tp long, fp long, fn long")
    inside = contrib.where(F.col("cls").between(0, n_classes - 1)
                           & F.col("aspect").between(0, n_aspects - 1))
    return (inside.unionByName(grid).groupBy("aspect", "cls")
                  .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))


def smoothed_metrics(tpfpfn: DataFrame, eps: float = EPS) -> DataFrame:
    """Epsilon-smoothed accuracy, precision, recall, F1 per cell, rounded to 6.

    An absent class (tp = fp = fn = 0) scores 1.0; F1 is built from the
    rounded precision and recall.
    """
    e = F.lit(eps)
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    prec = F.round((tp + e) / (tp + fp + e), 6)
    rec = F.round((tp + e) / (tp + fn + e), 6)
    return tpfpfn.select(
        "aspect", "cls", "tp", "fp", "fn",
        F.round((tp + e) / (tp + fp + fn + e), 6).alias("acc"),
        prec.alias("precision"), rec.alias("recall"),
        F.round(2 * prec * rec / (prec + rec + e), 6).alias("f1"))


def aspect_rollup(smoothed: DataFrame) -> DataFrame:
    """Per-aspect means of the smoothed class metrics plus an ``Overall`` row.

    Every aspect has the same number of classes, so the grand mean of the
    rollup equals the mean of the aspect means. Means are exact (decimal) and
    rounded half-up to the 6 decimals of the inputs.
    """
    # the inputs have 6 decimals: average them exactly and round half-up at 6
    r = smoothed.rollup("aspect").agg(*[
        F.round(F.avg(F.col(c).cast("decimal(20,6)")), 6).cast("double").alias(c)
        for c in ("acc", "precision", "recall", "f1")])
    return r.select(F.coalesce(F.col("aspect").cast("string"), F.lit("Overall")).alias("aspect"),
                    "acc", "precision", "recall", "f1")


def multilabel_losses(df: DataFrame, t: str, p: str) -> DataFrame:
    """Hamming loss, 0/1 loss and exact match ratio over per-row code arrays."""
    rows = df.select(mismatches(t, p).alias("m"), F.size(t).alias("k"))
    return rows.agg(
        (F.sum("m") / F.sum("k")).alias("hamming_loss"),
        F.avg(F.when(F.col("m") > 0, 1.0).otherwise(0.0)).alias("zero_one_loss"),
        F.avg(F.when(F.col("m") == 0, 1.0).otherwise(0.0)).alias("exact_match"))


def multilabel_example(df: DataFrame, t: str, p: str) -> DataFrame:
    """Example-based accuracy (Jaccard), precision, recall, F1 over 0/1 indicator arrays.

    Rows with an empty denominator add 0 and still count. Jaccard is
    undefined (null) when some row has neither true nor predicted labels.
    """
    def s(arr):
        return F.aggregate(arr, F.lit(0), lambda a, v: a + v)
    both = s(F.zip_with(F.col(t), F.col(p), lambda x, y: x * y))
    either = s(F.zip_with(F.col(t), F.col(p), lambda x, y: F.greatest(x, y)))
    rows = df.select(both.alias("i"), either.alias("u"), s(F.col(t)).alias("st"), s(F.col(p)).alias("sp"))
    n = F.count(F.lit(1))
    return rows.agg(
        F.when(F.sum(F.when(F.col("u") == 0, 1).otherwise(0)) > 0, F.lit(None).cast("double"))
         .otherwise(F.sum(F.when(F.col("u") > 0, F.col("i") / F.col("u"))) / n).alias("accuracy"),
        (F.sum(F.when(F.col("sp") > 0, F.col("i") / F.col("sp")).otherwise(0.0)) / n).alias("precision"),
        (F.sum(F.when(F.col("st") > 0, F.col("i") / F.col("st")).otherwise(0.0)) / n).alias("recall"),
        (F.sum(F.when(F.col("st") + F.col("sp") > 0, 2.0 * F.col("i") / (F.col("st") + F.col("sp")))
               .otherwise(0.0)) / n).alias("f1"))


def epoch_stats(df: DataFrame, epoch: str, loss: str, correct: str, per_row: int = 1) -> DataFrame:
    """Loss and accuracy per epoch plus the running mean of the epoch losses.

    ``per_row`` is the number of judged cells per row (4 for the aspects).
    The running mean runs over the epoch table (one row per epoch).
    """
    per_epoch = df.groupBy(epoch).agg(
        F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"),
        (F.sum(F.col(correct).cast("long")) / (F.count(F.lit(1)) * per_row)).alias("acc"))
    w = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_epoch.withColumn("running_loss", F.avg("loss").over(w))


def round_cols(df: DataFrame, digits: int = 6, cols: list[str] | None = None) -> DataFrame:
    """Round every double column (or the given ones) to ``digits``."""
    names = cols or [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])
