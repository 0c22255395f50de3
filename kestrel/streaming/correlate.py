"""Streaming correlation of requests and responses (R8, J3 on streams).

A stream-stream inner join on the correlation id with event-time
watermarks on both sides and a bound on the answer time, so Spark can drop
join state once a request can no longer be answered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.latency import seconds_between


def stream_correlate(req: DataFrame, resp: DataFrame, key: str = "correlation_id",
                     sent: str = "sent_at", answered: str = "answered_at",
                     max_wait: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Latency rows ``(key, ..., latency)`` from two streams.

    Both time columns must be ``timestamp`` (not ``timestamp_ntz``).
    """
    r = req.withWatermark(sent, lateness).alias("q")
    s = resp.withWatermark(answered, lateness).withColumnRenamed(key, "_k").alias("s")
    cond = (F.col(f"q.{key}") == F.col("s._k")) & \
        (F.col(f"s.{answered}") >= F.col(f"q.{sent}")) & \
        (F.col(f"s.{answered}") <= F.col(f"q.{sent}") + F.expr(f"INTERVAL {max_wait}"))
    j = r.join(s, cond, "inner").drop("_k")
    return j.withColumn("latency", seconds_between(sent, answered))
