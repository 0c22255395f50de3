"""Distributed numbering, triggers, replay cadence, mini-batches, key ranges."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrel.operators import sequence as S


def keys_frame(spark, n, seed=1):
    keys = random.Random(seed).sample(range(10 * n), n)
    return spark.createDataFrame([(k, k * 2) for k in keys], "k long, v long").repartition(5)


def test_number_rows_matches_row_number(spark):
    df = keys_frame(spark, 997)
    got = {r["k"]: (r["rn"], r["total"]) for r in S.number_rows(df, "k", partitions=7).collect()}
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy("k"))).collect()
    assert len(got) == 997
    for r in ref:
        assert got[r["k"]] == (r["rn"], 997)


def test_trigger_batches_keeps_only_full_groups(spark):
    df = keys_frame(spark, 300)
    out = S.trigger_batches(df, "k", 128)
    assert out.count() == 256
    sizes = {r["batch_id"]: r["count"] for r in out.groupBy("batch_id").count().collect()}
    assert sizes == {1: 128, 2: 128}
    partial = S.trigger_batches(df, "k", 128, keep_partial=True)
    assert partial.where("batch_id = 3").count() == 44


def test_trigger_replay_membership(spark):
    n, m = 10, 4
    df = keys_frame(spark, 95)            # 9 full batches, 5 rows wait
    rows = S.trigger_replay(df, "k", n, m).collect()
    by_trigger = {}
    for r in rows:
        by_trigger.setdefault(r["trigger_id"], set()).add(r["batch_id"])
    assert set(by_trigger) == set(range(1, 10))
    for t, batches in by_trigger.items():
        if t % m == 0:
            assert batches == set(range(t - m + 1, t + 1))
        else:
            assert batches == {t}
    assert all(r["kind"] == ("replay" if r["trigger_id"] % m == 0 else "own") for r in rows)


def test_mini_batches_keep_short_last(spark):
    df = keys_frame(spark, 70)
    out = S.mini_batches(df, "k", 32, seed=7)
    sizes = sorted(r["count"] for r in out.groupBy("batch_id").count().collect())
    assert sizes == [6, 32, 32]
    again = {r["k"]: r["batch_id"] for r in S.mini_batches(df, "k", 32, seed=7).collect()}
    assert again == {r["k"]: r["batch_id"] for r in out.collect()}


def test_key_range_bounds(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "k long")
    assert [r["k"] for r in S.key_range(df, "k", 3, 6).collect()] == [4, 5, 6]
    assert [r["k"] for r in S.key_range(df, "k", None, 1).collect()] == [0, 1]


def test_numbering_runs_the_plan_above_it_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(k):
        calls.add(1)
        return k

    df = spark.range(500).repartition(4).select(counted("id").alias("k"))
    for partitions in (None, 6):
        calls.value = 0
        assert S.number_rows(df, F.col("k").desc(), partitions).agg(F.sum("rn")).first()[0] == 500 * 501 // 2
        assert calls.value == 500


def test_running_max_spreads_one_group(spark):
    """One task name over several partitions; null values and null groups; structs."""
    rng = random.Random(5)
    rows = [(t, k, rng.choice([None, *range(100)])) for t, n in (("a", 400), ("b", 3), (None, 40)) for k in rng.sample(range(9999), n)]
    df = spark.createDataFrame(rows, "task string, k long, v long").repartition(3)
    for inclusive in (False, True):
        out = S.running_max(df, "k", F.col("v"), "top", ["task"], inclusive, partitions=7)
        got = {(r["task"], r["k"]): r["top"] for r in out.collect()}
        assert len(got) == len(rows)
        for t, k, _ in rows:
            upto = [v for u, j, v in rows if u == t and v is not None and (j < k or inclusive and j == k)]
            assert got[t, k] == (max(upto) if upto else None)
    pair = S.running_max(df, "k", F.struct("v", "k"), "top", ["task"], True, partitions=7)
    assert pair.where("top.v < v").count() == 0 and pair.count() == len(rows)
    assert S.running_max(df.limit(0), "k", F.col("v"), "top", [], True).count() == 0
