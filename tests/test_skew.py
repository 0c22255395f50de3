"""Hot keys: one key holds a third of the rows. Results stay whole and the
data-sized aggregations combine on the map side before the shuffle."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import metrics as M
from kestrel.operators import registry as G
from kestrel.operators import textmetrics as TM
from kestrel.operators.latency import latency_stats


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def hot(spark):
    # key 7 holds 1/3 of 3000 rows
    rows = [(7 if i % 3 == 0 else i, i, float(i % 97), i % 5) for i in range(3000)]
    return spark.createDataFrame(rows, "k long, o long, v double, c int").repartition(6)


def test_count_table_combines_map_side(spark, hot):
    counts = M.count_table(hot.withColumn("p", F.col("c")), "c", "p")
    assert "partial_count" in plan(counts)
    assert {r["n"] for r in counts.collect()} == {600}


def test_upsert_hot_key(spark, hot):
    out = G.upsert_latest(hot.where("o < 1500"), hot.where("o >= 1500"), "k", "o")
    assert "partial_max_by" in plan(out)
    r = {x["k"]: x["o"] for x in out.collect()}
    assert r[7] == 2997 and len(r) == 2000


def test_latency_quantiles_on_hot_group(spark, hot):
    df = hot.select(F.when(F.col("k") == 7, "hot").otherwise("cold").alias("config"),
                    (F.col("v") / 10).alias("latency"))
    stats = {r["config"]: r for r in latency_stats(df).collect()}
    hot_vals = np.array([float(i % 97) / 10 for i in range(3000) if i % 3 == 0 or i == 7])
    assert stats["hot"]["n"] == 1001
    assert stats["hot"]["p50"] == pytest.approx(np.quantile(hot_vals, 0.5))
    assert stats["hot"]["p95"] == pytest.approx(np.quantile(hot_vals, 0.95))


def test_hot_pair_greedy_match_is_blocked(spark):
    rnd = np.random.default_rng(3)
    rows = [(0, i % 2, i, [float(x) for x in rnd.normal(size=3)]) for i in range(60)]   # the hot pair
    rows += [(p, i % 2, 1000 * p + i, [float(x) for x in rnd.normal(size=3)]) for p in range(1, 6) for i in range(6)]
    df = spark.createDataFrame(rows, "pair_id long, side int, tid long, vec array<double>")
    whole = {r["pair_id"]: r["f1"] for r in TM.greedy_match(df, token_id="tid").collect()}
    blocked = {r["pair_id"]: r["f1"] for r in TM.greedy_match(df, token_id="tid", block=8).collect()}
    assert blocked == pytest.approx(whole)


def test_ngram_counts_combine_map_side(spark):
    pairs = spark.createDataFrame([("hot", ["a"] * 500, ["a"] * 400), ("x", ["b", "c"], ["b"])],
                                  "pair_id string, cand array<string>, ref array<string>")
    p = TM.ngram_precision(pairs)
    assert "partial_sum" in plan(p)
    r = {x["n"]: x for x in p.collect()}
    assert r[1]["matches"] == 401 and r[1]["possible"] == 502
