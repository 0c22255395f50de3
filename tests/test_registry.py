"""Registry operators: ties, first record, replay split, pruning, early stop, upsert."""

from kestrel.operators import registry as G


def reg(spark, f1s):
    return spark.createDataFrame([(i + 1, "cls", float(f), i + 1) for i, f in enumerate(f1s)],
                                 "version int, task string, avg_f1 double, key long")


def test_best_so_far_first_never(spark):
    r = {x["version"]: x["is_update"] for x in G.best_so_far(reg(spark, [0.5, 0.4, 0.6, 0.6, 0.7])).collect()}
    assert r == {1: False, 2: False, 3: True, 4: False, 5: True}


def test_champion_ties_lowest_version(spark):
    r = {x["version"]: x["champion"] for x in G.champion_timeline(reg(spark, [0.5, 0.7, 0.7, 0.6])).collect()}
    assert r == {1: 1, 2: 2, 3: 2, 4: 2}
    assert G.best_version(reg(spark, [0.5, 0.7, 0.7])).first()["version"] == 2


def test_replay_updates_and_sets(spark):
    f1 = [0.1, 0.2, 0.15, 0.3, 0.4, 0.35, 0.36, 0.37, 0.5]
    r = {x["version"]: x for x in G.replay_updates(reg(spark, f1), 4).collect()}
    assert [v for v in r if r[v]["is_replay"]] == [5, 9]
    assert r[5]["replay_update"] and r[9]["replay_update"] and r[4]["ordinary_update"]
    sets = {(x["kind"], x["version"]) for x in G.version_sets(reg(spark, f1), 4).collect()}
    assert ("replay_update", 5) in sets and ("ordinary_update", 2) in sets
    assert not any(k == "replay_no_update" for k, _ in sets)


def test_prune_and_servable(spark):
    r = reg(spark, [0.1, 0.9, 0.5])
    art = spark.createDataFrame([("cls", 1), ("cls", 3)], "task string, version int")
    kept, removed = G.registry_prune(r, art)
    assert sorted(x["version"] for x in kept.collect()) == [1, 3]
    assert [x["version"] for x in removed.collect()] == [2]
    assert G.best_servable_version(r, art).first()["version"] == 3
    empty = spark.createDataFrame([], "task string, version int")
    assert G.best_servable_version(r, empty).count() == 0


def test_history_and_next_version(spark):
    h = G.registry_history(reg(spark, [0.1, 0.2, 0.3])).first()
    assert (h["records"], h["newest_version"], h["oldest_version"], h["next_version"]) == (3, 3, 1, 4)


def test_early_stop(spark):
    losses = [1.0, 0.8, 0.9, 0.85, 0.95, 0.81, 0.82, 0.7]
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(losses)], "epoch int, loss double")
    r = {x["epoch"]: x for x in G.early_stop(df, patience=5).collect()}
    assert [e for e in r if r[e]["improved"]] == [1, 2, 8]
    assert r[7]["since_best"] == 5 and r[7]["stop"]
    assert sum(1 for e in r if r[e]["stop"]) == 1


def test_upsert_latest_and_delete(spark):
    base = spark.createDataFrame([(1, 10, "a"), (2, 11, "b")], "k int, o int, v string")
    ch = spark.createDataFrame([(1, 12, "c"), (3, 13, "d"), (2, 9, "old")], "k int, o int, v string")
    r = {x["k"]: x["v"] for x in G.upsert_latest(base, ch, "k", "o").collect()}
    assert r == {1: "c", 2: "b", 3: "d"}
    gone = spark.createDataFrame([(2,)], "k int")
    assert sorted(x["k"] for x in G.delete_keys(base, gone, "k").collect()) == [1]


def test_latest_epoch_and_sample(spark):
    names = spark.createDataFrame([("model_1.pt",), ("model_12.pt",), ("model_acsa_3.pt",), ("junk",)], "name string")
    r = {x["prefix"]: x["latest_epoch"] for x in G.latest_epoch(names).collect()}
    assert r == {"model": 12, "model_acsa": 3}
    assert G.latest_epoch(names, prefix="model_acsa").first()["latest_epoch"] == 3
    assert G.latest_epoch(names, prefix="model").first()["latest_epoch"] == 12
    assert G.latest_epoch(names, prefix="none").first()["latest_epoch"] == 0
    df = spark.createDataFrame([(i,) for i in range(50)], "id long")
    a = G.sample_example(df, "id", 3).collect()
    assert a == G.sample_example(df, "id", 3).collect() and len(a) == 1


def test_champion_and_best_per_task(spark):
    rows = [(1, "cls", 0.5, 1), (2, "cls", 0.6, 2), (1, "acsa", 0.3, 3), (2, "acsa", 0.2, 4), (3, "cls", 0.55, 5)]
    r = spark.createDataFrame(rows, "version int, task string, avg_f1 double, key long")
    champ = {(x["task"], x["version"]): x["champion"] for x in G.champion_timeline(r).collect()}
    assert champ == {("cls", 1): 1, ("cls", 2): 2, ("cls", 3): 2, ("acsa", 1): 1, ("acsa", 2): 1}
    best = {x["task"]: x["version"] for x in G.best_version(r).collect()}
    assert best == {"cls": 2, "acsa": 1}
    hist = {x["task"]: (x["records"], x["next_version"]) for x in G.registry_history(r).collect()}
    assert hist == {"cls": (3, 4), "acsa": (2, 3)}
