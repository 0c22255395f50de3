"""Global row numbering, N-row triggers, replay triggers and mini-batches.

A global ``row_number()`` over an unpartitioned window runs in one task. Here
numbering is done in distributed passes instead:

1. write the rows, so that the plan above them runs once: range partitioning
   reads its input twice, to sample and to shuffle;
2. range-partition the written rows on the order key and sort inside each
   partition; tag each row with ``monotonically_increasing_id`` (partition
   index in the upper bits, position inside the partition in the lower 33
   bits) and checkpoint, so partition ids stay fixed for the next pass and a
   lost executor does not renumber anything; the files of step 1 then go;
3. count rows per partition (one row per partition), turn the counts into
   offsets, broadcast that table (its size is the partition count) and add
   offset + position.

Running maxima go the same way: a maximum per partition, carried into the
partitions behind it. Rows of equal order have no fixed order among them;
name further order columns where that matters.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import ensure_checkpoint_dir
from kestrel.sources.tables import remove_path, scratch_path

_LOW = (1 << 33) - 1


def _cols(cols) -> list[Column]:
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _in_order(df: DataFrame, order, partitions: int | None, written: bool) -> DataFrame:
    """The rows checkpointed in ranges of ``order``, with ``_mid``: partition number and place in it."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys, rows, path = _cols(order), df, None  # names, or expressions over names
    if not written:
        path = scratch_path(spark, f"in-order-{uuid.uuid4().hex}")
        df.write.parquet(path)
        rows = spark.read.schema(df.schema).parquet(path)
    # without a count, the session's shuffle partitions, which AQE merges by size
    spread = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    out = (spread.sortWithinPartitions(*keys)
           .withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True))
    if path:
        remove_path(spark, path)
    return out


def number_rows(df: DataFrame, order, partitions: int | None = None,
                rn: str = "rn", total: str | None = "total", written: bool = False) -> DataFrame:
    """Add a 1-based global row number ``rn`` in ``order`` (and the row ``total``).

    ``written``: the rows are a plain read of a table, which may be read twice.
    """
    ranged = _in_order(df, order, partitions, written)
    pid = F.shiftright(F.col("_mid"), 33)
    sizes = ranged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: an unpartitioned window here is bounded by their number
    w = Window.orderBy("_pid")
    offsets = sizes.select(
        "_pid",
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"))
    out = ranged.join(F.broadcast(offsets), pid == F.col("_pid"))
    out = out.withColumn(rn, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW)) + 1)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_mid", "_pid", "_off", "_total")


def running_max(df: DataFrame, order, value: Column, out: str, keys: list[str], inclusive: bool,
                partitions: int | None = None) -> DataFrame:
    """Add ``out``: the maximum of ``value`` over the earlier rows of the same ``keys`` (and this one if ``inclusive``).

    A distributed prefix scan: one group of ``keys`` spreads over the range
    partitions. The maxima of the partitions (a row per partition and group in
    it) are carried forward; null values count for nothing.
    """
    ranged = _in_order(df, [*keys, *_cols(order)], partitions, False).withColumns(
        {"_pid": F.shiftright("_mid", 33), "_v": value})
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # what earlier partitions carry into one stands in front of its rows
    carried = (ranged.groupBy(*keys, "_pid").agg(F.max("_v").alias("_v"))
               .select(*keys, "_pid", F.max("_v").over(before).alias("_v"), F.lit(-1).cast("long").alias("_mid")))
    upto = Window.partitionBy(*keys, "_pid").orderBy("_mid").rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    rows = ranged.unionByName(carried, allowMissingColumns=True)
    return rows.withColumn(out, F.max("_v").over(upto)).where(F.col("_mid") >= 0).select(*df.columns, out)


def trigger_batches(df: DataFrame, key, n: int, keep_partial: bool = False, written: bool = False) -> DataFrame:
    """Consecutive groups of ``n`` rows in key order: ``batch_id`` (1-based).

    Only full groups are emitted unless ``keep_partial``; the remainder waits
    for the next trigger.
    """
    numbered = number_rows(df, key, written=written)
    out = numbered.withColumn("batch_id", (F.floor((F.col("rn") - 1) / n) + 1).cast("long"))
    if not keep_partial:
        out = out.where(F.col("rn") <= F.floor(F.col("total") / n) * n)
    return out


def trigger_replay(df: DataFrame, key, n: int, m: int) -> DataFrame:
    """Replay cadence over full N-row batches.

    Trigger ``t`` (1-based) trains on batch ``t``; when ``t`` is a multiple
    of ``m`` it trains on batches ``t-m+1 .. t`` instead. A row of batch
    ``b`` therefore belongs to trigger ``b`` and, when ``b`` is not itself a
    replay trigger, to the next replay trigger ``ceil(b/m)*m`` if that one
    fires. Rows are listed per trigger by an ``explode`` of at most two ids:
    no join, no copy on disk.
    """
    b = trigger_batches(df, key, n)
    nfull = F.floor(F.col("total") / n)
    replay_of = ((F.floor((F.col("batch_id") - 1) / m) + 1) * m).cast("long")
    triggers = F.when(F.col("batch_id") % m == 0, F.array(F.col("batch_id"))) \
        .when(replay_of <= nfull, F.array(F.col("batch_id"), replay_of)) \
        .otherwise(F.array(F.col("batch_id")))
    out = b.withColumn("trigger_id", F.explode(triggers))
    return out.withColumn("kind", F.when(F.col("trigger_id") % m == 0, "replay").otherwise("own"))


def seeded_hash(id_col: str, seed: int) -> Column:
    """Repeatable pseudo-random order key of a row: ``md5("<seed>:<id>")``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def mini_batches(df: DataFrame, id_col: str, size: int, seed: int) -> DataFrame:
    """Seeded shuffle into mini-batches of ``size`` (the short last batch is kept).

    The shuffle order is the MD5 of ``"<seed>:<id>"`` (hex text), ties broken
    by the id: a portable hash, so any engine can reproduce the order.
    """
    keyed = df.withColumn("_h", seeded_hash(id_col, seed))
    numbered = number_rows(keyed, [F.col("_h"), F.col(id_col)])
    return numbered.withColumn("batch_id", (F.floor((F.col("rn") - 1) / size) + 1).cast("long")) \
                   .drop("_h")


def key_range(df: DataFrame, key: str, lo, hi, ordered: bool = True) -> DataFrame:
    """Rows with ``lo < key <= hi`` (either bound may be None), in key order.

    Plain comparisons on the key are pushed to the parquet scan.
    """
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(key) > F.lit(lo))
    if hi is not None:
        cond = cond & (F.col(key) <= F.lit(hi))
    out = df.where(cond)
    return out.orderBy(key) if ordered else out
