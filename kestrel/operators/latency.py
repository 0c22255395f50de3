"""Request/response correlation and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seconds_between(start, end) -> Column:
    """``end - start`` in seconds (double, microsecond resolution)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return (F.unix_micros(e) - F.unix_micros(s)) / 1e6


def correlate(req: DataFrame, resp: DataFrame, key: str = "correlation_id",
              sent: str = "sent_at", answered: str = "answered_at") -> DataFrame:
    """Requests matched with their responses on the correlation key, with ``latency``.

    Unanswered requests drop out (inner join). Both sides are data-sized,
    so this is a shuffle join on the key; AQE splits a skewed key.
    """
    j = req.join(resp, key, "inner")
    return j.withColumn("latency", seconds_between(sent, answered))


def latency_stats(df: DataFrame, by: str = "config", value: str = "latency",
                  quantiles=(0.25, 0.5, 0.75, 0.95), resolution: float = 1e-6) -> DataFrame:
    """Mean, min, max and exact (linearly interpolated) quantiles per group.

    Latencies are integers of ``resolution`` seconds, by default the
    microsecond that timestamps have, and are counted per ``(group, unit)`` first, a partial aggregate; the exact
    percentile then runs over distinct values with their frequencies, so its
    state per group is bounded by the number of distinct latencies, not by
    the row count. Sums are integer, so the mean does not depend on the
    order in which partitions are combined.
    """
    per_second = int(round(1 / resolution))
    q = df.select(by, F.round(F.col(value) * per_second).cast("long").alias("u"))
    counts = q.groupBy(by, "u").agg(F.count(F.lit(1)).alias("f"))
    v = F.col("u") / F.lit(float(per_second))
    pct = F.percentile(v, F.array(*[F.lit(x) for x in quantiles]), F.col("f"))
    agg = counts.groupBy(by).agg(
        F.sum("f").alias("n"), F.sum(F.col("u") * F.col("f")).alias("_s"),
        F.min("u").alias("_min"), F.max("u").alias("_max"), pct.alias("_q"))
    names = [f"p{int(round(x * 100))}" for x in quantiles]
    return agg.select(by, "n", (F.col("_s") / F.col("n") / F.lit(float(per_second))).alias("avg"),
                      (F.col("_min") / F.lit(float(per_second))).alias("min"),
                      (F.col("_max") / F.lit(float(per_second))).alias("max"),
                      *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])
