"""Small steps and triggers are worked off in blocks, with the results of one after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import heads as H
from kestrel.operators import online as O
from kestrel.streaming import triggers as T

D, K = 5, 4


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(K, D))
    return [(i, (centres[i % K] + 1.5 * rng.normal(size=D)).tolist(), i % K, [i % K, (i // 3) % K]) for i in range(96)]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, vec array<double>, y int, ys array<int>").repartition(3)


def descended(w, b, x, ys, lr):
    w, b = w.copy(), b.copy()
    for h in range(len(w)):
        z = x @ w[h].T + b[h]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(x)), ys[:, h]] -= 1
        w[h] -= lr * p.T @ x / len(x)
        b[h] -= lr * p.mean(axis=0)
    return w, b


def mean_f1(w, b, x, ys):
    out = []
    for h in range(len(w)):
        p, t = (x @ w[h].T + b[h]).argmax(axis=1), ys[:, h]
        seen = [c for c in range(K) if (p == c).any() or (t == c).any()]
        out.append(np.mean([2 * ((p == c) & (t == c)).sum() / ((p == c).sum() + (t == c).sum()) for c in seen]))
    return float(np.mean(out))


def one_by_one(rows, label, heads, strategy, n, m, lr):
    """(trigger, rows, start version, F1) of every version, in plain numpy."""
    x = np.array([r[1] for r in rows])
    ys = np.array([[r[2]] if label == "y" else r[3] for r in rows])
    model = np.zeros((heads, K, D)), np.zeros((heads, K))
    models, out = [model], [(0, 0, None, mean_f1(*model, x, ys))]
    for t in range(1, len(x) // n + 1):
        lo = (t - m) * n if strategy == "replay" and t % m == 0 else (t - 1) * n
        best = max(range(len(out)), key=lambda v: (out[v][3], -v))
        base = len(out) - 1 if strategy == "continue" else best
        models.append(descended(*models[base], x[lo:t * n], ys[lo:t * n], lr))
        out.append((t, t * n - lo, base + 1, mean_f1(*models[-1], x, ys)))
    return out


@pytest.mark.parametrize(("strategy", "label", "heads"), [("continue", "ys", 2), ("champion", "y", None), ("replay", "ys", 2)])
def test_small_triggers_share_jobs_and_give_the_records_of_one_by_one(spark, rows, monkeypatch, strategy, label, heads):
    df, writes, append = table(spark, rows), [], O.append_rows
    monkeypatch.setattr(O, "append_rows", lambda frame, path: (writes.append(path), append(frame, path)))
    # a low rate, so that better versions come now and then
    got = O.online_learn(df, "id", "vec", label, df, K, strategy, n=4, m=3, lr=0.02, n_heads=heads).orderBy("version").collect()
    want = one_by_one(rows, label, heads or 1, strategy, 4, 3, 0.02)
    assert [(r["trigger_id"], r["rows"], r["start_version"]) for r in got] == [w[:3] for w in want] and len(got) == 25
    assert np.allclose([r["avg_f1"] for r in got], [w[3] for w in want], atol=1e-9)
    assert len(writes) < 25  # one by one: 25


def test_triggers_too_large_for_a_task_are_trained_by_all(spark, rows, monkeypatch):
    df, calls, train = table(spark, rows), [], H.train_heads
    run = lambda: O.online_learn(df, "id", "vec", "y", df, K, "replay", n=32, m=2).orderBy("version").collect()
    whole = run()
    monkeypatch.setattr(H, "BLOCK_VALUES", 32 * D)
    monkeypatch.setattr(H, "train_heads", lambda *a, **b: (calls.append(1), train(*a, **b))[1])
    apart = run()
    assert len(calls) == 3 and [tuple(r)[:9] for r in apart] == [tuple(r)[:9] for r in whole]
    assert np.allclose([r["avg_f1"] for r in apart], [r["avg_f1"] for r in whole], atol=1e-9)


def test_adam_takes_small_steps_in_blocks(spark, rows, monkeypatch):
    df, calls, gradient = table(spark, rows), [], H._gradient
    monkeypatch.setattr(H, "_gradient", lambda *a: (calls.append(1), gradient(*a))[1])
    run = lambda h: H.train_heads(df, "vec", "ys", K, epochs=2, lr=0.05, n_heads=2, method="adam", batch_size=16, history=h)
    histories = [], [], []
    models = [run(histories[0])]
    assert not calls  # a job for each of the 12 steps before
    monkeypatch.setattr(H, "BLOCK_STEPS", 4)
    models.append(run(histories[1]))
    monkeypatch.setattr(H, "BLOCK_VALUES", 1)
    models.append(run(histories[2]))
    assert len(calls) == 12
    for (w, b), h in zip(models[1:], histories[1:]):
        assert np.allclose(w, models[0][0], atol=1e-10) and np.allclose(b, models[0][1], atol=1e-10)
        assert np.allclose(h, histories[0], atol=1e-9) and len(h) == 4


def test_small_and_large_micro_batches_are_cut_alike(spark, scratch, monkeypatch):
    arrivals = [[(k, f"{mb}-{i}", [i]) for i, k in enumerate((7, 3, 3, 9, 1, 3, 8, None, 5, 3, 2)[:11 - mb])] for mb in range(4)]

    def cut(at):
        stage, ledger = f"{scratch}/{at}/stage", f"{scratch}/{at}/ledger"
        T.init_ledger(spark, ledger)
        run = T.stage_and_cut("k", stage, ledger, 4, 2)
        for mb, found in enumerate(arrivals):
            if mb == 2:
                run = T.stage_and_cut("k", stage, ledger, 4, 2)  # restarted
            run(spark.createDataFrame(found, "k long, v string, a array<int>").repartition(3), mb)
        taken = T.triggered(spark, stage).collect()
        names = [r["v"] for r in taken] + [r["v"] for r in T.waiting(spark, stage).collect()]
        assert sorted(names) == sorted(v for found in arrivals for _, v, _ in found)
        return sorted(map(tuple, T.read_ledger(spark, ledger).select("trigger_id", "lo", "hi", "n", "kind").collect())), sorted((r["_trigger"], r["k"] or 0) for r in taken)

    numbered = []
    monkeypatch.setattr(T, "trigger_batches", lambda *a, f=T.trigger_batches, **b: (numbered.append(1), f(*a, **b))[1])
    small = cut("small")
    assert not numbered  # a few small jobs a micro-batch, no numbering by all tasks
    monkeypatch.setattr(T, "ONE_TASK", 1)
    assert cut("large") == small and len(numbered) == 4 and len(small[0]) == 9


def test_the_stream_learns_in_blocks_as_the_table_does(spark, rows, scratch, monkeypatch):
    from kestrel.streaming.online import StreamingLearner
    df, start = table(spark, rows), (np.zeros((1, K, D)), np.zeros((1, K)))
    args = ("id", "vec", "y", df, K, "replay")
    whole = O.online_learn(*(df, *args), n=4, m=3, lr=0.02, start=start).orderBy("version").collect()
    writes, append = [], O.append_rows
    monkeypatch.setattr(O, "append_rows", lambda frame, path: (writes.append(path), append(frame, path)))
    T.init_ledger(spark, f"{scratch}/ledger")
    for mb, part in enumerate((df.where("id < 42"), df.where("id >= 42"))):  # 10 triggers, then 14 with 2 rows that waited
        learner = StreamingLearner(spark, *args, 3, f"{scratch}/stage", f"{scratch}/ledger", f"{scratch}/reg", f"{scratch}/store", start, lr=0.02)
        T.stage_and_cut("id", f"{scratch}/stage", f"{scratch}/ledger", 4, 3, learner)(part, mb)
    got = learner.registry_frame(spark).orderBy("version").collect()
    assert [tuple(r)[:9] for r in got] == [tuple(r)[:9] for r in whole] and len(got) == 25
    assert np.allclose([r["avg_f1"] for r in got], [r["avg_f1"] for r in whole], atol=1e-9)
    assert len(writes) < 25


def cut_one_by_one(arrivals, n, m):
    """Ledger rows, keys with their trigger and keys that wait, if every arrival is cut as it comes; in plain Python."""
    ledger, taken, rest = [], [], []
    for keys in arrivals:
        pool = sorted([*rest, *keys], key=lambda k: (k is not None, k or 0))
        whole = len(pool) // n * n
        for i in range(0, whole, n):
            t, found = len(ledger) + 1, [k for k in pool[i:i + n] if k is not None]
            ledger.append((t, min(found, default=None), max(found, default=None), n, "replay" if t % m == 0 else "own"))
            taken += [(t, k) for k in pool[i:i + n]]
        rest = pool[whole:]
    return ledger, taken, rest


def cut_as_found(spark, stage, ledger):
    found = T.read_ledger(spark, ledger).select("trigger_id", "lo", "hi", "n", "kind").collect()
    return sorted(map(tuple, found)), [(r["_trigger"], r["k"]) for r in T.triggered(spark, stage).collect()], [r["k"] for r in T.waiting(spark, stage).collect()]


def alike(got, want):
    order = lambda row: str(row)
    return got[0] == want[0] and sorted(got[1], key=order) == sorted(want[1], key=order) and sorted(got[2], key=order) == sorted(want[2], key=order)


def test_arrivals_of_a_block_are_cut_one_after_the_other(spark, scratch, monkeypatch):
    rng = np.random.default_rng(3)
    # late, tied and null keys; arrivals with fewer rows than a trigger, and with many
    arrivals = [[None if k == 0 else int(k) for k in rng.integers(0, 30, size)] for size in (11, 2, 1, 17, 9, 3, 23, 4, 5, 12)]
    stage, ledger = f"{scratch}/stage", f"{scratch}/ledger"
    T.init_ledger(spark, ledger)
    numbered = []
    monkeypatch.setattr(T, "trigger_batches", lambda *a, **b: numbered.append(1))
    run = T.stage_and_cut("k", stage, ledger, 4, 3)
    for first, until in ((0, 5), (5, 9), (9, 10)):
        rows = [(k, f"{t}-{i}", [i], t) for t in range(first, until) for i, k in enumerate(arrivals[t])]
        block = spark.createDataFrame(rows, "k long, v string, a array<int>, _turn long").repartition(3)
        run(block, first)
        if first == 5:
            run(block, first)  # replayed
            run = T.stage_and_cut("k", stage, ledger, 4, 3)  # restarted
            run(block.limit(0), 0)  # gone past: nothing is written again
    assert alike(cut_as_found(spark, stage, ledger), cut_one_by_one(arrivals, 4, 3)) and not numbered
    names = [r["v"] for r in T.triggered(spark, stage).collect()] + [r["v"] for r in T.waiting(spark, stage).collect()]
    assert sorted(names) == sorted(f"{t}-{i}" for t, keys in enumerate(arrivals) for i in range(len(keys)))
    assert T.triggered(spark, stage).columns == ["k", "v", "a", "_trigger", "_mb"]


def test_a_block_is_bounded(spark):
    schema = spark.range(1).schema
    assert T.block_size(schema, 2000, 128) * 2000 + 128 <= T.ONE_TASK and T.block_size(schema, 2000, 128) > 1
    assert T.block_size(schema, 1, 128) == T.BLOCK_ARRIVALS and T.block_size(schema, 10 * T.ONE_TASK, 128) == 1
    assert T.block_size(spark.sql("SELECT map(1, 2) AS m").schema, 10, 128) == 1  # no order among maps
    rows = spark.range(20).withColumn("_turn", F.col("id") % 2).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    with pytest.raises(ValueError, match="one task"):
        T._numbered(rows, "id", 4, 20)


@pytest.mark.parametrize("lost_at", ["before", "after"])
def test_a_paced_stream_stopped_between_blocks_loses_no_row(spark, scratch, lost_at):
    from kestrel.streaming.pacing import run_paced, start_paced, write_arrivals
    df = spark.createDataFrame([(i, i * 37 % 50) for i in range(100)], "id long, k long")
    write_arrivals(df, "id", f"{scratch}/src")
    T.init_ledger(spark, f"{scratch}/ledger")
    seen = []

    def cutting(fails):
        cut = T.stage_and_cut("k", f"{scratch}/stage", f"{scratch}/ledger", 6, 2)

        def run(block, at):
            seen.append((at, block.select("_turn").distinct().count()))
            if fails and at == 8 and lost_at == "before":
                raise RuntimeError("lost")
            cut(block, at)
            if fails and at == 8:
                raise RuntimeError("lost")
        return run

    # 13 arrivals of 8 rows, all due within a second: four blocks of one micro-batch
    query, done = start_paced(spark, f"{scratch}/src", 8, "20 milliseconds", cutting(True), f"{scratch}/ckpt", 4)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    assert not done.is_set()
    run_paced(spark, f"{scratch}/src", 8, "20 milliseconds", cutting(False), f"{scratch}/ckpt", 4)
    assert seen == [(0, 4), (4, 4), (8, 4)] + [(0, 4), (4, 4), (8, 4), (12, 1)]
    keys = [i * 37 % 50 for i in range(100)]
    assert alike(cut_as_found(spark, f"{scratch}/stage", f"{scratch}/ledger"), cut_one_by_one([keys[i:i + 8] for i in range(0, 100, 8)], 6, 2))


def test_the_paced_query_cuts_together_what_is_due_and_not_before(spark, scratch, monkeypatch):
    import hashlib
    import time
    from kestrel.plans import q_streaming as Q
    rows = [(i, i * i % 97) for i in range(17 * Q.PACE // 2)]  # the last arrival is half a one
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{scratch}/orders.parquet")
    calls, stage_and_cut, run_paced = [], Q.stage_and_cut, Q.run_paced

    def counted(*a):
        run = stage_and_cut(*a)
        return lambda batch, at: (calls.append((time.monotonic(), at)), run(batch, at))

    monkeypatch.setattr(Q, "stage_and_cut", counted)
    monkeypatch.setattr(Q, "run_paced", lambda *a, **b: (calls.append((time.monotonic(), 0)), run_paced(*a, **b)))
    got = sorted(map(tuple, Q.stream_paced_q(spark, scratch).collect()))
    begun, blocks = calls[0][0], calls[1:]
    keys = [k for i, k in sorted(rows, key=lambda r: (hashlib.md5(f"{Q.PACE_SEED}:{r[0]}".encode()).hexdigest(), r[0]))]
    assert got == cut_one_by_one([keys[i:i + Q.PACE] for i in range(0, len(keys), Q.PACE)], Q.N, Q.M)[0]
    assert len(blocks) <= 4  # a call for each of the 9 arrivals before
    assert all(at * 0.2 <= when - begun for when, at in blocks) and blocks[-1][0] - begun >= 9 * 0.2
