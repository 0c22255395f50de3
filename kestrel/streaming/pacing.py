"""Paced loading (R7): a stored table arrives at a fixed rate, in a given order.

The rows are numbered in arrival order and written once, so a file holds one
range of numbers. A rate source counts the seconds that have passed, and with
them the arrivals that are due; a micro-batch reads just the row groups of
their numbers (pushed comparisons on the number). The clock waits neither for
the work nor for a stopped stream: arrivals that came due meanwhile are handed
on together, in blocks.
Numbers follow from the source's offsets, so a replayed or restarted
micro-batch gets the same rows in the same blocks again.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kestrel.operators.sequence import number_rows

ARRIVAL = "_arrival"
#: in a block, the number (from 0) of the arrival that a row came with
TURN = "_turn"


def write_arrivals(df: DataFrame, order, path: str) -> None:
    """Write ``df`` with its arrival number (from 1, in ``order``)."""
    number_rows(df, order, rn=ARRIVAL, total=None).write.parquet(path)


def start_paced(spark: SparkSession, path: str, rows: int, every: str, run: Callable[[DataFrame, int], None],
                checkpoint: str, at_once: int = 1) -> tuple[StreamingQuery, threading.Event]:
    """Hand ``rows`` more rows of ``path`` to ``run`` every ``every`` (a duration such as ``10 seconds``).

    ``run`` gets an arrival and its number. With ``at_once``, it gets up to so
    many that are due in a block, with ``TURN``, and the number of the first;
    the source counts whole seconds, so what comes due within one is handed on
    at its end. A replayed micro-batch hands on all its blocks again, in order.

    Returns the query and an event that is set once all rows have been handed
    on and their micro-batches committed. Every run from one checkpoint needs
    the same ``rows``, ``every`` and ``at_once``; an empty table is done at once.
    """
    table = spark.read.parquet(path)
    last = table.agg(F.max(ARRIVAL)).first()[0] or 0
    arrivals = -(-last // rows)
    pace = spark.sql(f"SELECT unix_millis(timestamp_millis(0) + CAST('{every}' AS INTERVAL))").first()[0]
    done = threading.Event()

    def due(seconds: int) -> int:
        return min(seconds * 1000 // max(pace, 1), arrivals)

    def each(batch: DataFrame, batch_id: int) -> None:
        passed = batch.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
        if passed["lo"] is None:
            return
        first, until = due(passed["lo"]), due(passed["hi"] + 1)
        if first == arrivals:
            done.set()
        for at in range(first, until, at_once):
            now = F.col(ARRIVAL).between(at * rows + 1, min(at + at_once, until) * rows)
            found = batch.sparkSession.read.schema(table.schema).parquet(path).where(now)
            if at_once > 1:
                found = found.withColumn(TURN, F.floor((F.col(ARRIVAL) - 1) / rows))
            run(found.drop(ARRIVAL), at)

    seconds = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    query = (seconds.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
             .trigger(processingTime=every).start())
    return query, done


def run_paced(spark: SparkSession, path: str, rows: int, every: str, run: Callable[[DataFrame, int], None], checkpoint: str,
              at_once: int = 1) -> None:
    """As :func:`start_paced`, until every row has arrived."""
    query, done = start_paced(spark, path, rows, every, run, checkpoint, at_once)
    try:
        while not done.wait(0.05):
            if not query.isActive:
                raise RuntimeError(f"the paced stream ended early: {query.exception()}")
    finally:
        query.stop()
