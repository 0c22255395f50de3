"""Training, online learning of both tasks and the stored cascade, against plain numpy."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import cascade as C
from kestrel.operators import heads as H
from kestrel.operators import online as O
from kestrel.sources.tables import load_weights, save_weights

SCHEMA = "id long, vec array<double>, y int, ys array<int>"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(scale=2, size=(4, 5))
    return [(i, (centres[i % 4] + rng.normal(size=5)).tolist(), i % 4, [i % 4, (i + 1) % 4, (i // 2) % 4, 3]) for i in range(120)]


BAD = [(200, None, 1, [1, 1, 1, 1]), (201, [1.0, None, 0.0, 0.0, 0.0], 1, [1, 1, 1, 1]), (202, [float("nan")] * 5, 1, [1, 1, 1, 1]), (203, [], 1, [1, 1, 1, 1]),
       (204, [1.0, 2.0], 1, [1, 1, 1, 1]), (205, [1.0] * 5, None, None), (206, [2.0] * 5, 9, [None] * 4), (207, [0.5] * 5, -1, [1, None, 7, 2]), (208, [0.5] * 5, 2, [1, 2])]


def probabilities(w, b, x):
    z = x @ w.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def gradient(w, b, rows):
    """rows: (x, y) of one head."""
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    p = probabilities(w, b, x)
    p[np.arange(len(y)), y] -= 1
    return p.T @ x / len(y), p.mean(axis=0)


def test_rows_that_cannot_train_are_left_out_and_counted(spark, rows):
    df = spark.createDataFrame(rows + BAD, SCHEMA)
    assert tuple(H.left_out(df, "vec", "y", 4, 5).first()) == (129, 5, 3, 121, 0)
    assert tuple(H.left_out(df, "vec", "ys", 4, 5, 4).first()) == (129, 5, 3, 482, 2)
    assert H.dimensions(df, "vec") == 5
    w, b = H.train_heads(df, "vec", "y", 4, epochs=1, lr=1.0)
    g, gb = gradient(np.zeros((4, 5)), np.zeros(4), [(r[1], r[2]) for r in rows] + [([0.5] * 5, 2)])
    assert np.allclose(w[0], -g) and np.allclose(b[0], -gb)
    hist = []
    w, b = H.train_heads(df, "vec", "ys", 4, epochs=1, lr=1.0, n_heads=4, history=hist)
    for h, extra in enumerate(([([0.5] * 5, 1)], [], [], [([0.5] * 5, 2)])):
        g, gb = gradient(np.zeros((4, 5)), np.zeros(4), [(r[1], r[3][h]) for r in rows] + extra)
        assert np.allclose(w[h], -g) and np.allclose(b[h], -gb)
    assert [n for *_, n in hist] == [121, 120, 120, 121]
    with pytest.raises(ValueError):
        H.train_heads(df.where("vec is null"), "vec", "y", 4)


def test_centroids_of_every_head(spark, rows):
    df = spark.createDataFrame(rows + BAD[:6], SCHEMA).repartition(5)
    w, b = H.weights_arrays(H.centroid_weights(df, "vec", "ys", 4))
    assert not b.any()
    for h in range(3):
        for c in range(4):
            assert np.allclose(w[h, c], np.mean([r[1] for r in rows if r[3][h] == c], axis=0))


def brute_adam(order, w, b, lr, batch, state):
    for i in range(0, len(order), batch):
        g, gb = gradient(w, b, order[i:i + batch])
        flat = np.concatenate([g.ravel(), gb])
        state["t"] += 1
        state["m"] = 0.9 * state["m"] + 0.1 * flat
        state["v"] = 0.999 * state["v"] + 0.001 * flat * flat
        move = lr * (state["m"] / (1 - 0.9 ** state["t"])) / (np.sqrt(state["v"] / (1 - 0.999 ** state["t"])) + 1e-8)
        w, b = w - move[:w.size].reshape(w.shape), b - move[w.size:]
    return w, b


def test_adam_is_the_same_for_any_partitioning(spark, rows):
    df = spark.createDataFrame(rows + rows[:7] + BAD, SCHEMA)
    got = [H.train_heads(df.repartition(k), "vec", "y", 4, epochs=2, lr=0.05, method="adam", batch_size=32, seed=11) for k in (1, 7)]
    assert np.allclose(got[0][0], got[1][0], atol=1e-10) and np.allclose(got[0][1], got[1][1], atol=1e-10)
    used = H.training_rows(df, "vec", "y", 4, 5)
    w, b, state = np.zeros((4, 5)), np.zeros(4), {"t": 0, "m": 0.0, "v": 0.0}
    for epoch in range(2):  # the moments go on
        order = used.orderBy(F.md5(F.concat_ws("|", F.lit(str(11 + epoch)), F.to_json(F.struct("x", "y"))))).collect()
        w, b = brute_adam([(r["x"], r["y"][0]) for r in order], w, b, 0.05, 32, state)
    assert state["t"] == 8 and np.allclose(got[0][0][0], w, atol=1e-9) and np.allclose(got[0][1][0], b, atol=1e-9)


def test_tied_keys_train_the_rows_of_their_trigger(spark, rows, monkeypatch):
    keys = [1, 2, 3, 4, 4, 4, 5, 6, 6, 6, 6, 7, None]
    df = spark.createDataFrame([(k, *rows[i][1:]) for i, k in enumerate(keys)], SCHEMA)
    seen, step = [], O.OnlineLearner.step

    def counted(self, part, t, n):
        seen.append((t, part.count(), n))
        return step(self, part, t, n)

    monkeypatch.setattr(O.OnlineLearner, "step", counted)
    reg = O.online_learn(df, "id", "vec", "y", df, 4, "replay", n=4, m=2).orderBy("version").collect()
    assert seen == [(1, 4, 4), (2, 8, 8), (3, 4, 4)] and [r["rows"] for r in reg] == [0, 4, 8, 4]


@pytest.mark.parametrize(("task", "label", "heads"), [("cls", "y", None), ("acsa", "ys", 4)])
def test_a_run_cut_off_between_weights_and_record_goes_on(spark, rows, scratch, monkeypatch, task, label, heads):
    df = spark.createDataFrame(rows + BAD, SCHEMA)
    run = lambda at: O.online_learn(df, "id", "vec", label, df, 4, "replay", n=25, m=2, task=task, n_heads=heads, test=df.where("id < 50"),
                                    registry=f"{scratch}/{at}/registry", store=f"{scratch}/{at}/store")
    whole = sorted(run("whole").collect(), key=lambda r: (r["split"], r["version"]))
    append, calls = O.append_rows, []

    def cut(frame, path):
        calls.append(path)
        if len(calls) == 4:  # the weights of version 4 are there, its record is not
            raise RuntimeError("lost driver")
        append(frame, path)

    monkeypatch.setattr(O, "append_rows", cut)
    with pytest.raises(RuntimeError, match="lost driver"):
        run("cut")
    store = O.RunStore(spark, f"{scratch}/cut/registry", f"{scratch}/cut/store", task)
    assert sorted(r["version"] for r in store.records().collect()) == [1, 2, 3]
    assert load_weights(spark, f"{scratch}/cut/store", task, 4).count() > 0
    again = sorted(run("cut").collect(), key=lambda r: (r["split"], r["version"]))
    drop = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert [drop(r) for r in again] == [drop(r) for r in whole]
    assert Counter(r["split"] for r in whole) == {"dev": 6, "test": 1} and {r["task"] for r in whole} == {task}
    best = max((r for r in whole if r["split"] == "dev"), key=lambda r: (r["avg_f1"], -r["version"]))
    assert whole[-1]["version"] == best["version"] and whole[-1]["artefact"] == f"task={task}/version={best['version']}"


def test_aspect_metrics_are_means_over_labelled_rows(spark, rows):
    df = spark.createDataFrame(rows + BAD, SCHEMA)
    rng = np.random.default_rng(1)
    w, b = rng.normal(size=(4, 4, 5)), rng.normal(size=(4, 4))
    got = O.evaluate(df, "vec", "ys", w, b)
    used = [(r[1], r[3]) for r in rows] + [([0.5] * 5, [1, None, 7, 2])]
    f1, acc = [], []
    for h in range(4):
        pairs = [(y[h], int(np.argmax(w[h] @ np.array(x) + b[h]))) for x, y in used if y[h] is not None]
        acc.append(np.mean([t == p for t, p in pairs]))
        each = []
        for c in {t for t, _ in pairs} | {p for _, p in pairs}:
            tp, s, n = sum(t == p == c for t, p in pairs), sum(t == c for t, _ in pairs), sum(p == c for _, p in pairs)
            each.append(2 * tp / (s + n))
        f1.append(np.mean(each))
    assert got["acc"] == pytest.approx(np.mean(acc)) and got["avg_f1"] == pytest.approx(np.mean(f1))


def test_cascade_from_the_store(spark, rows, scratch):
    rng = np.random.default_rng(2)
    models = {"cls": (rng.normal(size=(1, 3, 5)), rng.normal(size=(1, 3))), "acsa": (rng.normal(size=(4, 4, 5)), rng.normal(size=(4, 4)))}
    for task, wb in models.items():
        save_weights(H.weights_frame(spark, *wb), f"{scratch}/store", task, 7)
    loaded = C.load_models(spark, f"{scratch}/store", {"cls": 7, "acsa": 7})
    assert all(np.array_equal(a, b) for t in models for a, b in zip(models[t], loaded[t], strict=True))
    text = ['plain', 'two\nlines, "quoted"', None, ""]
    df = spark.createDataFrame([(r[0], r[1], text[i % 4]) for i, r in enumerate(rows[:40] + BAD[:5])], "id long, vec array<double>, c_0 string")
    got = {r["id"]: r for r in C.run_cascade(df, "id", "vec", ["c_0"], f"{scratch}/store", {"cls": 7, "acsa": 7}, f"{scratch}/out").collect()}
    assert len(got) == 45
    book = ["trung tính", "tích cực", "tiêu cực", "không đề cập"]
    for i, r in enumerate(rows[:40]):
        x = np.array(r[1])
        label = int(np.argmax(models["cls"][0][0] @ x + models["cls"][1][0]))
        aspects = [int(np.argmax(models["acsa"][0][h] @ x + models["acsa"][1][h])) for h in range(4)]
        g = got[r[0]]
        assert g["predicted_label"] == label and [g[c] for c in ("predicted_title", "predicted_desc", "predicted_comp", "predicted_other")] == aspects
        assert g["pre_tasks"].startswith(f"khía cạnh tiêu đề: {book[aspects[0]]} [SEP] ")
        value = "nan" if text[i % 4] is None else text[i % 4]
        assert g["text"] == f"[CLS] tiêu đề: {value} [SEP] {g['pre_tasks']}"
    for i in range(200, 205):
        assert got[i]["predicted_label"] is None and got[i]["pre_tasks"] is None and got[i]["text"].endswith(" [SEP] ")
    with pytest.raises(ValueError):
        C.load_models(spark, f"{scratch}/store", {"cls": 8})
    plan = C.cascade_from_models(df, "id", "vec", ["c_0"], loaded)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_requests_are_scored_by_both_champions(spark, rows, scratch):
    """A micro-batch reads the store anew; a task without a servable version answers with its fallback."""
    import json

    from kestrel.streaming.scoring import champion_scorer
    rng = np.random.default_rng(6)
    models = {v: {"cls": (rng.normal(size=(1, 3, 5)), np.zeros((1, 3))), "acsa": (rng.normal(size=(4, 4, 5)), np.zeros((4, 4)))} for v in (1, 2, 3)}
    save = lambda t, v: save_weights(H.weights_frame(spark, *models[v][t]), f"{scratch}/store", t, v)
    save("cls", 1)
    reg = [("cls", 1, 0.2), ("cls", 2, 0.9), ("acsa", 1, 0.5), ("acsa", 3, 0.4)]
    spark.createDataFrame(reg, "task string, version int, avg_f1 double").write.parquet(f"{scratch}/registry")
    vectors = [r[1] for r in rows[:6]] + [None, [1.0, 2.0]]
    batch = spark.createDataFrame([(str(i), str(i), json.dumps(v)) for i, v in enumerate(vectors)], "key string, id string, data string")
    run = champion_scorer(f"{scratch}/registry", f"{scratch}/store", f"{scratch}/out", aspect_task="acsa")

    def answers(mb, cls, acsa):
        run(batch, mb)
        out = spark.read.parquet(f"{scratch}/out").where(F.col("_mb") == mb).collect()
        assert len(out) == 8 and {(r["version"], r["aspect_version"]) for r in out} == {(cls, acsa)}
        for r in out:
            v, x = json.loads(r["value"]), vectors[int(r["key"])]
            usable = x is not None and len(x) == 5
            label = int(np.argmax(models[cls]["cls"][0][0] @ np.array(x))) if usable else -1
            aspects = [int(np.argmax(models[acsa]["acsa"][0][h] @ np.array(x))) for h in range(4)] if usable and acsa else [-1] * 4
            assert (v["prediction"], json.loads(v["acsa"])) == (label, aspects)

    answers(0, 1, None)
    save("cls", 2)
    save("acsa", 3)
    answers(1, 2, 3)
    save("acsa", 1)
    answers(2, 2, 1)
