"""N-row triggers over a growing stream.

``foreachBatch`` stages each micro-batch and cuts its rows, with those that
earlier micro-batches left over, into full N-row triggers in key order; the
remainder waits in a table of its own, bounded by N rows, so what a micro-batch
reads does not grow with the stream's past. Every row keeps the number of its
trigger, so late keys and tied keys are triggered once like any other. All
writes are keyed by the micro-batch id and replace that folder, so a
micro-batch that Spark replays after a failure rewrites the same rows instead
of adding them twice (exactly-once effect). Restarting with the same checkpoint resumes where the
ledger ends.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from kestrel.operators.sequence import trigger_batches
from kestrel.sources.tables import path_exists, remove_path
from kestrel.streaming.pacing import TURN

LEDGER_SCHEMA = StructType([
    StructField("trigger_id", LongType()), StructField("lo", LongType()), StructField("hi", LongType()),
    StructField("n", LongType()), StructField("kind", StringType()), StructField("_mb", IntegerType())])


def init_ledger(spark: SparkSession, path: str) -> None:
    """Create an empty ledger table (no-op when it exists)."""
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").partitionBy("_mb").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows, one per trigger (a replayed micro-batch never duplicates one)."""
    return spark.read.schema(LEDGER_SCHEMA).parquet(path).dropDuplicates(["trigger_id"])


def _write(df: DataFrame, path: str, mb: int) -> None:
    """Replace what micro-batch ``mb`` has written; no other folder is listed."""
    df.write.mode("overwrite").parquet(f"{path}/_mb={mb}")


def _read(spark: SparkSession, path: str, mb: int, schema: StructType | None = None) -> DataFrame:
    """What micro-batch ``mb`` has written; with its ``schema``, no file is opened for it."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/_mb={mb}")


def cut_path(staging: str) -> str:
    """The rows of triggers, with ``_trigger``, by the micro-batch that cut them."""
    return staging.rstrip("/") + "-cut"


def wait_path(staging: str) -> str:
    """The rows that wait for their trigger: what the last micro-batches left over."""
    return staging.rstrip("/") + "-wait"


def state_path(staging: str) -> str:
    """One row per micro-batch still needed: its number and the newest trigger (``last``)."""
    return staging.rstrip("/") + "-state"


def triggered(spark: SparkSession, staging: str) -> DataFrame:
    """Rows of all triggers, one row per staged row, with ``_trigger``."""
    return spark.read.parquet(cut_path(staging))


def waiting(spark: SparkSession, staging: str) -> DataFrame | None:
    """Rows that no trigger has yet; None before the first micro-batch."""
    if not path_exists(spark, state_path(staging)):
        return None
    newest = spark.read.parquet(state_path(staging)).agg(F.max("_mb")).first()[0]
    return _read(spark, wait_path(staging), newest)


def _state_before(spark: SparkSession, staging: str, mb: int) -> tuple[tuple[int, int] | None, int | None]:
    """(micro-batch, newest trigger) of the last one before ``mb``, and the newest micro-batch; None if there is none.

    Only the last few are kept, so this reads a bounded number of rows.
    """
    if not path_exists(spark, state_path(staging)):
        return None, None
    earlier = F.when(F.col("_mb") < mb, F.struct("_mb", "last"))
    r = (spark.read.schema("last long, _mb int").parquet(state_path(staging))
         .agg(F.max(earlier).alias("s"), F.max("_mb").alias("newest")).first())
    return (None if r["s"] is None else (r["s"]["_mb"], r["s"]["last"])), r["newest"]


#: rows of a micro-batch, with those that wait, that one task sorts at most
ONE_TASK = 1 << 16
#: arrivals that one task cuts in turn at most
BLOCK_ARRIVALS = 64


def _sortable(schema: StructType) -> bool:
    return not any(kind in f.dataType.simpleString() for f in schema for kind in ("map<", "variant"))


def block_size(schema: StructType, rows: int, n: int) -> int:
    """How many arrivals of ``rows`` rows one task may cut in turn, with fewer than ``n`` that wait."""
    return max(1, min(BLOCK_ARRIVALS, (ONE_TASK - n) // rows)) if _sortable(schema) else 1


def _numbered(pool: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """The rows with ``rn`` and ``batch_id``, the same each time they are read (up to rows equal in all columns)."""
    in_turn = TURN in pool.columns
    if total > ONE_TASK or not _sortable(pool.schema):
        if in_turn:
            raise ValueError(f"a block of {total} rows: one task cuts {ONE_TASK} sortable ones in turn")
        return trigger_batches(pool, key, n, keep_partial=True, written=True)
    one = pool.coalesce(1).sortWithinPartitions(key, *[c for c in pool.columns if c not in (key, TURN)])
    numbered = one.withColumn("rn", F.monotonically_increasing_id() + 1)  # a single partition: no gaps
    if in_turn:
        numbered = _in_turn(numbered, n)
    return numbered.withColumn("batch_id", (F.floor((F.col("rn") - 1) / n) + 1).cast("long"))


def _in_turn(numbered: DataFrame, n: int) -> DataFrame:
    """``rn`` becomes the place in which a row is cut, if ``TURN`` after ``TURN`` is: what one leaves over waits for the next.

    Whole triggers are taken at every turn, so their rows follow one another
    without gaps; the rows that still wait come last. For one task's rows.
    """
    columns = [c for c in numbered.columns if c not in (TURN, "rn")]
    row = F.struct("rn", F.struct(*columns).alias("row"))
    arrivals = (numbered.groupBy(TURN).agg(F.collect_list(row).alias("rows"))
                .agg(F.sort_array(F.collect_list(F.struct(TURN, "rows"))).alias("arrivals")))  # null first: rows that waited
    none = F.array().cast(arrivals.schema["arrivals"].dataType.elementType["rows"].dataType)

    def turn(so_far, arrival):
        pool = F.array(F.sort_array(F.concat(so_far["rest"], arrival["rows"])))
        whole = lambda p: F.size(p) - F.size(p) % n
        cut = lambda p: F.struct(F.concat(so_far["cut"], F.slice(p, 1, whole(p))).alias("cut"), F.slice(p, whole(p) + 1, n).alias("rest"))
        return F.transform(pool, cut)[0]  # an array of one pool: it is sorted once

    order = F.aggregate("arrivals", F.struct(none.alias("cut"), none.alias("rest")), turn, lambda end: F.concat(end["cut"], end["rest"]))
    return arrivals.select(F.posexplode(order).alias("_place", "_row")).select("_row.row.*", (F.col("_place") + 1).cast("long").alias("rn"))


def _together(spark: SparkSession, *jobs: Callable[[], None]) -> None:
    """Run independent jobs at the same time."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for job in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]:
            job.result()


def stage_and_cut(key: str, staging: str, ledger: str, n: int, m: int,
                  on_trigger: Callable[[SparkSession, DataFrame], None] | None = None):
    """The ``foreachBatch`` function: cut the arriving and the waiting rows into full triggers.

    A micro-batch reads its own rows and those that the one before left
    waiting (fewer than ``n``), never what earlier triggers took. The state
    row is written last: a micro-batch cut off before it starts again from the
    state before. Waiting rows and states older than the last one are removed;
    one that the state has gone past is not cut again. Numbers may have gaps.

    A block of arrivals (rows with ``TURN``, at most :func:`block_size` arrivals)
    gives the triggers of one arrival after the other.
    """

    done: dict[int, int] = {}  # the state that the last call has written

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, mb = batch.sparkSession, int(batch_id)
        follows = any(earlier < mb for earlier in done)
        before, newest = (*done.items(), None) if follows else _state_before(spark, staging, mb)
        if newest is not None and newest > mb:
            return  # the stream stopped in a later block of the same micro-batch
        done.clear()
        last = before[1] if before else 0
        _write(batch, staging, mb)
        pool = _read(spark, staging, mb, batch.schema)
        if before:
            waits = StructType([f for f in batch.schema if f.name != TURN])
            pool = pool.unionByName(_read(spark, wait_path(staging), before[0], waits if follows else None), allowMissingColumns=TURN in pool.columns)
        columns, total = [c for c in pool.columns if c != TURN], pool.count()
        newest = last + total // n
        cut = _numbered(pool, key, n, total)
        whole = F.col("rn") <= total // n * n
        taken = cut.where(whole).select(*columns, (F.col("batch_id") + F.lit(last)).cast("long").alias("_trigger"))
        new = (taken.groupBy(F.col("_trigger").alias("trigger_id"))
               .agg(F.min(key).cast("long").alias("lo"), F.max(key).cast("long").alias("hi"), F.count(F.lit(1)).alias("n"))
               .withColumn("kind", F.when(F.col("trigger_id") % m == 0, "replay").otherwise("own")))
        _together(spark, lambda: _write(taken, cut_path(staging), mb), lambda: _write(cut.where(~whole).select(*columns), wait_path(staging), mb),
                  lambda: _write(new, ledger, mb))
        if on_trigger is not None:
            on_trigger(spark, _read(spark, ledger, mb))
        _write(spark.range(0, 1, 1, 1).select(F.lit(newest).cast("long").alias("last")), state_path(staging), mb)
        done[mb] = newest
        if before:  # this micro-batch may be replayed, the one before it no more
            for path in (wait_path(staging), state_path(staging)):
                _remove_before(spark, path, before[0])

    return run


def _remove_before(spark: SparkSession, path: str, mb: int) -> None:
    """Remove the folders of micro-batches before ``mb``; there are a few at most."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    for s in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root):
        name = s.getPath().getName()
        if name.startswith("_mb=") and int(name[4:]) < mb:
            remove_path(spark, f"{path}/{name}")


def stream_trigger(stream: DataFrame, key: str, staging: str, ledger: str, checkpoint: str,
                   n: int, m: int, trigger: dict | None = None, on_trigger=None):
    """Start the trigger stream; returns the running query."""
    init_ledger(stream.sparkSession, ledger)
    return (stream.writeStream.foreachBatch(stage_and_cut(key, staging, ledger, n, m, on_trigger))
                  .option("checkpointLocation", checkpoint)
                  .trigger(**(trigger or {"availableNow": True})).start())
