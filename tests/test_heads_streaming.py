"""Heads, scoring, online strategies and the streaming jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import heads as H
from kestrel.operators.online import online_learn
from kestrel.streaming.triggers import read_ledger, stream_trigger


def blobs(spark, n=240, d=6, k=3, seed=0):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(scale=4, size=(k, d))
    rows = []
    for i in range(n):
        y = i % k
        rows.append((i, [float(x) for x in centers[y] + rnd.normal(size=d)], y))
    return spark.createDataFrame(rows, "id long, vec array<double>, y int")


def test_train_heads_learns_and_warm_starts(spark):
    df = blobs(spark)
    hist = []
    w, b = H.train_heads(df, "vec", "y", 3, epochs=8, lr=0.5, history=hist)
    assert hist[-1][2] < hist[0][2]            # loss went down
    scored = H.score_batch(df, "vec", w, b)
    acc = scored.select(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0]
    assert acc > 0.9
    hist2 = []
    H.train_heads(df, "vec", "y", 3, epochs=1, lr=0.5, init=(w, b), history=hist2)
    assert hist2[0][2] == pytest.approx(hist[-1][2], rel=0.5)


def test_score_batch_matches_numpy(spark):
    df = blobs(spark, n=30)
    rnd = np.random.default_rng(1)
    w, b = rnd.normal(size=(1, 3, 6)), rnd.normal(size=(1, 3))
    rows = H.score_batch(df, "vec", w, b).collect()
    for r in rows:
        s = w[0] @ np.asarray(r["vec"]) + b[0]
        assert r["pred"] == int(np.argmax(s))
        lp = s - s.max() - np.log(np.exp(s - s.max()).sum())
        assert r["logp"] == pytest.approx(list(lp))


def test_multi_head_training(spark):
    df = blobs(spark).withColumn("ys", F.array(F.col("y"), (F.col("y") + 1) % 3))
    hist = []
    w, b = H.train_heads(df, "vec", "ys", 3, epochs=3, n_heads=2, history=hist)
    assert w.shape == (2, 3, 6) and {h for _, h, *_ in hist} == {0, 1}


def test_cascade_output(spark):
    df = spark.createDataFrame([(1, [0.1, 0.9, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0, 4.0])],
                               "id long, ls array<double>, asp array<double>")
    r = H.cascade(df, "id", "ls", "asp").first()
    assert (r["predicted_label"], r["predicted_title"], r["predicted_desc"], r["predicted_comp"],
            r["predicted_other"]) == (1, 0, 1, 2, 3)
    assert r["pre_tasks"].endswith("nhãn chung: cảnh báo [SEP]")


@pytest.mark.parametrize("strategy", ["continue", "champion", "replay"])
def test_online_strategies(spark, strategy):
    df = blobs(spark, n=100)
    reg = online_learn(df, "id", "vec", "y", df, 3, strategy, n=20, m=2, epochs=1).orderBy("version").collect()
    assert [r["version"] for r in reg] == list(range(1, 7))
    if strategy == "continue":
        assert [r["start_version"] for r in reg[1:]] == [1, 2, 3, 4, 5]
    if strategy == "replay":
        assert [r["rows"] for r in reg[1:]] == [20, 40, 20, 40, 20]
    else:
        assert all(r["rows"] == 20 for r in reg[1:])


def test_stream_trigger_restart_and_replay_idempotent(spark, scratch):
    src = f"{scratch}/src"
    data = spark.createDataFrame([(i, float(i)) for i in range(1, 301)], "k long, v double")
    schema = data.schema

    def run():
        s = spark.readStream.schema(schema).parquet(src)
        q = stream_trigger(s, "k", f"{scratch}/stage", f"{scratch}/ledger", f"{scratch}/ckpt", 50, 4)
        q.awaitTermination()
        assert q.exception() is None

    data.where("k <= 120").write.mode("append").parquet(src)
    run()
    assert sorted(r["hi"] for r in read_ledger(spark, f"{scratch}/ledger").collect()) == [50, 100]
    run()                                       # nothing new: no new trigger
    assert read_ledger(spark, f"{scratch}/ledger").count() == 2
    data.where("k > 120").write.mode("append").parquet(src)
    run()                                       # remainder 101..120 carried over
    led = sorted((r["trigger_id"], r["lo"], r["hi"], r["n"], r["kind"])
                 for r in read_ledger(spark, f"{scratch}/ledger").collect())
    assert led == [(1, 1, 50, 50, "own"), (2, 51, 100, 50, "own"), (3, 101, 150, 50, "own"),
                   (4, 151, 200, 50, "replay"), (5, 201, 250, 50, "own"), (6, 251, 300, 50, "own")]


def test_score_engines_agree_and_nulls(spark):
    df = blobs(spark, n=40).union(spark.createDataFrame([(999, None, 0)], "id long, vec array<double>, y int"))
    rnd = np.random.default_rng(2)
    w, b = rnd.normal(size=(1, 3, 6)), rnd.normal(size=(1, 3))
    a = {r["id"]: r["pred"] for r in H.score_batch(df, "vec", w, b, engine="arrow").collect()}
    n = {r["id"]: r["pred"] for r in H.score_batch(df, "vec", w, b, engine="native").collect()}
    assert a == n and a[999] is None
    w2, b2 = rnd.normal(size=(2, 3, 6)), rnd.normal(size=(2, 3))
    a2 = {r["id"]: r["pred"] for r in H.score_batch(df, "vec", w2, b2).collect()}
    n2 = {r["id"]: r["pred"] for r in H.score_batch(df, "vec", w2, b2, engine="native").collect()}
    assert a2 == n2


def test_streaming_learner_equals_batch(spark, scratch):
    from kestrel.streaming.online import StreamingLearner
    df = blobs(spark, n=100)
    start = (np.zeros((1, 3, 6)), np.zeros((1, 3)))
    batch = {r["version"]: r for r in online_learn(df, "id", "vec", "y", df, 3, "replay", n=20, m=2,
                                                   start=start).collect()}

    def run():
        learner = StreamingLearner(spark, "id", "vec", "y", df, 3, "replay", 2, f"{scratch}/stage",
                                   f"{scratch}/ledger", f"{scratch}/reg", f"{scratch}/store", start)
        s = spark.readStream.schema(df.schema).parquet(f"{scratch}/src")
        q = stream_trigger(s, "id", f"{scratch}/stage", f"{scratch}/ledger", f"{scratch}/ckpt", 20, 2,
                           on_trigger=learner)
        q.awaitTermination()
        assert q.exception() is None
        return learner

    df.where("id < 45").write.mode("append").parquet(f"{scratch}/src")
    run()
    df.where("id >= 45").write.mode("append").parquet(f"{scratch}/src")
    learner = run()                       # restarted: restores champion and newest weights
    stream = {r["version"]: r for r in learner.registry_frame(spark).collect()}
    assert sorted(stream) == sorted(batch)
    for v in batch:
        a, b = stream[v], batch[v]
        assert (a["trigger_id"], a["kind"], a["rows"], a["start_version"]) == \
               (b["trigger_id"], b["kind"], b["rows"], b["start_version"])
        assert a["avg_f1"] == pytest.approx(b["avg_f1"], abs=1e-9)


def test_replayed_micro_batch_is_idempotent(spark, scratch):
    from kestrel.streaming.triggers import init_ledger, stage_and_cut
    init_ledger(spark, f"{scratch}/ledger")
    run = stage_and_cut("k", f"{scratch}/stage", f"{scratch}/ledger", 10, 2)
    b0 = spark.createDataFrame([(i,) for i in range(1, 26)], "k long")
    b1 = spark.createDataFrame([(i,) for i in range(26, 41)], "k long")
    run(b0, 0)
    run(b1, 1)
    first = sorted(tuple(r) for r in read_ledger(spark, f"{scratch}/ledger").collect())
    run(b1, 1)                                  # Spark replays micro-batch 1 after a failure
    again = sorted(tuple(r) for r in read_ledger(spark, f"{scratch}/ledger").collect())
    assert first == again
    assert [(r[0], r[1], r[2]) for r in first] == [(1, 1, 10), (2, 11, 20), (3, 21, 30), (4, 31, 40)]
    assert spark.read.parquet(f"{scratch}/stage").count() == 40


def test_stream_correlate_drops_answers_past_the_bound(spark, scratch):
    import datetime as dt
    from kestrel.streaming.correlate import stream_correlate
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    req = spark.createDataFrame([(1, t0, "a"), (2, t0, "a"), (3, t0, "b")],
                                "correlation_id long, sent_at timestamp, config string")
    resp = spark.createDataFrame([(1, t0 + dt.timedelta(seconds=1.5)), (2, t0 + dt.timedelta(hours=2))],
                                 "correlation_id long, answered_at timestamp")
    req.write.parquet(f"{scratch}/req")
    resp.write.parquet(f"{scratch}/resp")
    rs = spark.readStream.schema(req.schema).parquet(f"{scratch}/req")
    ss = spark.readStream.schema(resp.schema).parquet(f"{scratch}/resp")
    q = (stream_correlate(rs, ss, max_wait="1 hour").writeStream.format("parquet")
         .option("checkpointLocation", f"{scratch}/ckpt").trigger(availableNow=True).start(f"{scratch}/out"))
    q.awaitTermination()
    rows = spark.read.parquet(f"{scratch}/out").collect()
    assert [(r["correlation_id"], r["latency"]) for r in rows] == [(1, 1.5)]


def test_registry_seed_object_and_list(spark, scratch):
    import json
    import os
    from kestrel.sources.tables import seed_registry
    d = scratch.replace("file:", "")
    os.makedirs(d, exist_ok=True)
    one = {"_id": {"$oid": "65a1"}, "version": 1, "task": "cls", "acc": 0.5, "avg_f1": 0.4}
    many = [{"_id": {"$oid": "65a2"}, "version": 1, "task": "acsa", "acc": 0.3, "avg_f1": 0.2},
            {"_id": {"$oid": "65a3"}, "version": 2, "task": "acsa", "acc": 0.35, "avg_f1": 0.25}]
    with open(f"{d}/a.json", "w") as f:
        json.dump(one, f, indent=2)
    with open(f"{d}/b.json", "w") as f:
        json.dump(many, f, indent=2)
    rows = sorted((r["oid"], r["task"], r["version"]) for r in seed_registry(spark, d).collect())
    assert rows == [("65a1", "cls", 1), ("65a2", "acsa", 1), ("65a3", "acsa", 2)]


def test_train_heads_local_adam(spark):
    df = blobs(spark, n=300).repartition(3)
    hist = []
    w, b = H.train_heads(df, "vec", "y", 3, epochs=4, lr=0.05, method="adam", batch_size=32, history=hist)
    acc = H.score_batch(df, "vec", w, b).select(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0]
    assert acc > 0.9 and hist[-1][2] < hist[0][2]
    again, _ = H.train_heads(df, "vec", "y", 3, epochs=4, lr=0.05, method="adam", batch_size=32)
    assert np.allclose(again, w)          # seeded: the same mini-batches every run


def test_training_pool_on_streams(spark, scratch):
    from kestrel.sources.messages import training_pool
    train = spark.createDataFrame([("t1", "0", "[0, 1, 2, 3]")], "input_data string, prediction string, acsa string")
    reports = spark.createDataFrame([("9", 2, [2, 3, 3, 0, 1], "report", "t2")],
                                    "id string, prediction int, acsa array<int>, type string, data string")
    train.write.parquet(f"{scratch}/train")
    reports.write.parquet(f"{scratch}/reports")
    ts = spark.readStream.schema(train.schema).parquet(f"{scratch}/train")
    rs = spark.readStream.schema(reports.schema).parquet(f"{scratch}/reports")
    q = (training_pool(ts, rs).writeStream.format("parquet").option("checkpointLocation", f"{scratch}/ckpt")
         .trigger(availableNow=True).start(f"{scratch}/pool"))
    q.awaitTermination()
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{scratch}/pool").collect())
    assert rows == [("t1", "0", "[0, 1, 2, 3]", "train"), ("t2", "2", "[3, 3, 0, 1]", "report")]
