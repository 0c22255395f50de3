"""No row lost, no cell missing: late and tied keys, empty sides, absent classes, ties, null labels."""

import pytest
from pyspark.sql import functions as F

from kestrel.operators import heads, latency, metrics, postings, registry, textmetrics
from kestrel.sources import tables
from kestrel.streaming.triggers import read_ledger, stage_and_cut, init_ledger, stream_trigger, triggered, waiting


def test_late_and_tied_keys_are_triggered_once(spark, scratch):
    stage, ledger = f"{scratch}/stage", f"{scratch}/ledger"
    init_ledger(spark, ledger)
    run = stage_and_cut("k", stage, ledger, 5, 2)
    arrivals = [[(10 * i, f"a{i}") for i in range(1, 12)] + [(50, "tie1"), (50, "tie2")], [(50, "tie3"), (1, "late1"), (2, "late2"), (500, "z")], [(3, "late3")] * 1]
    for mb, rows in enumerate(arrivals):
        run(spark.createDataFrame(rows, "k long, v string"), mb)
        if mb == 1:
            run(spark.createDataFrame(rows, "k long, v string"), mb)  # replayed
    done = triggered(spark, stage).groupBy("_trigger").agg(F.count("*").alias("n")).collect()
    left = waiting(spark, stage)
    names = [r["v"] for r in triggered(spark, stage).collect()] + [r["v"] for r in left.collect()]
    assert sorted(names) == sorted(v for rows in arrivals for _, v in rows)
    assert all(r["n"] == 5 for r in done) and left.count() < 5
    assert sorted(r["trigger_id"] for r in read_ledger(spark, ledger).collect()) == sorted(r["_trigger"] for r in done)


def test_paced_stream_of_unsorted_files_loses_no_row(spark, scratch):
    keys = [(i * 37) % 60 for i in range(60)] + [7, 7, 7, 3]
    for i in range(0, len(keys), 8):
        spark.createDataFrame([(k,) for k in keys[i:i + 8]], "k long").coalesce(1).write.mode("append").parquet(f"{scratch}/src")
    src = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(f"{scratch}/src")
    stream_trigger(src, "k", f"{scratch}/stage", f"{scratch}/ledger", f"{scratch}/ckpt", 10, 3).awaitTermination()
    got = [r["k"] for r in triggered(spark, f"{scratch}/stage").collect()] + [r["k"] for r in waiting(spark, f"{scratch}/stage").collect()]
    assert sorted(got) == sorted(keys) and read_ledger(spark, f"{scratch}/ledger").agg(F.sum("n")).first()[0] == 60


def test_posting_csv_by_the_default_schema(spark, scratch):
    header = [f.name for f in tables.POSTING_CSV_SCHEMA]
    assert header[21:24] == ["min_salary", "max_salary", "gender"]
    row = {**dict.fromkeys(header, "x"), "recruitment_id": "5", "min_salary": "7.000.000", "max_salary": "9.000.000", "gender": "Nữ"}
    spark.createDataFrame([tuple(row[h] for h in header)], header).coalesce(1).write.option("header", True).csv(f"{scratch}/csv")
    r = tables.read_postings(spark, f"{scratch}/csv").first()
    assert (r["recruitment_id"], r["min_salary"], r["max_salary"], r["gender"]) == (5, "7.000.000", "9.000.000", "Nữ")


def test_latencies_keep_microseconds(spark):
    df = spark.createDataFrame([("a", x) for x in (0.9143217, 0.914765, 0.915211)], "config string, latency double")
    r = latency.latency_stats(df).first()
    assert (r["min"], r["p50"], r["max"]) == pytest.approx((0.914322, 0.914765, 0.915211), abs=1e-9)


def test_confusion_matrix_has_every_class(spark):
    counts = spark.createDataFrame([(0, 1, 3), (0, 0, 2)], "t int, p int, n long")
    got = {r["t"]: (r["p0"], r["p1"], r["p2"]) for r in metrics.confusion_matrix(counts, [0, 1, 2]).collect()}
    assert got == {0: (2, 3, 0), 1: (0, 0, 0), 2: (0, 0, 0)}
    with pytest.raises(Exception, match="not in the list"):
        metrics.confusion_matrix(counts, [0]).collect()


def test_pairs_with_an_empty_side_match_nothing(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 1, [0.0, 1.0])], "pair_id int, side int, vec array<double>")
    got = {r["pair_id"]: (r["precision"], r["recall"], r["f1"]) for r in textmetrics.greedy_match(df).collect()}
    assert got == {1: pytest.approx((1, 1, 1)), 2: (0, 0, 0), 3: (0, 0, 0)}


def test_changes_win_ties(spark):
    old, new = (spark.createDataFrame([(1, 5, v)], "k int, ord int, v string") for v in ("old", "new"))
    assert registry.upsert_latest(old, new, "k", "ord").first()["v"] == "new"
    assert registry.upsert_latest(new, old, "k", "ord").first()["v"] == "old"


def test_null_labels(spark):
    df = spark.createDataFrame([(1, [("a", "1"), (None, "2")])], "id int, parameters array<struct<label:string,value:string>>")
    assert postings.params_to_columns(df).first().asDict() == {"id": 1, "a": "1"}
    rows = spark.createDataFrame([([1.0, 0.0], 0), ([0.0, 1.0], 1), ([1.0, 1.0], None)], "v array<double>, y int")
    w, b = heads.train_heads(rows, "v", "y", 2, epochs=1)
    w2, b2 = heads.train_heads(rows.where("y is not null"), "v", "y", 2, epochs=1)
    assert (w == w2).all() and (b == b2).all()


def test_an_unreadable_registry_raises(spark, scratch):
    from kestrel.sources.tables import path_exists
    assert not path_exists(spark, f"{scratch}/none")
    spark.range(1).write.parquet(f"{scratch}/some")
    assert path_exists(spark, f"{scratch}/some")


def test_a_micro_batch_reads_the_waiting_rows_only(spark, scratch):
    """What is kept to go on does not grow with the stream's past."""
    import os
    stage, ledger = f"{scratch}/stage", f"{scratch}/ledger"
    init_ledger(spark, ledger)
    run = stage_and_cut("k", stage, ledger, 4, 2)
    for mb in range(8):
        run(spark.createDataFrame([(10 * mb + i,) for i in range(3)], "k long").coalesce(1), mb)
        if mb >= 2:
            for kept in ("wait", "state"):
                folder = f"{stage}-{kept}".removeprefix("file:")
                assert sorted(os.listdir(folder)) == [f"_mb={mb - 1}", f"_mb={mb}"]
        assert waiting(spark, stage).count() == (3 * mb + 3) % 4
    run(spark.createDataFrame([], "k long"), 8)  # nothing arrives
    assert triggered(spark, stage).count() == 24 and waiting(spark, stage).count() == 0
    assert sorted((r["trigger_id"], r["n"], r["kind"]) for r in read_ledger(spark, ledger).collect()) == [
        (t, 4, "replay" if t % 2 == 0 else "own") for t in range(1, 7)]


def test_paced_loading_goes_on_after_a_stop(spark, scratch):
    from kestrel.streaming.pacing import run_paced, start_paced, write_arrivals
    df = spark.createDataFrame([(i, i % 7) for i in range(50)], "id long, k long").repartition(4)
    write_arrivals(df, [F.col("k").desc(), "id"], f"{scratch}/src")
    order = [r["id"] for r in df.orderBy(F.col("k").desc(), "id").collect()]
    seen = {}

    def keep(batch, mb):
        seen.setdefault(mb, []).append(sorted(r["id"] for r in batch.collect()))
        if mb == 2 and len(seen[2]) == 1:
            raise RuntimeError("lost")

    query, done = start_paced(spark, f"{scratch}/src", 8, "50 milliseconds", keep, f"{scratch}/ckpt")
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    assert not done.is_set()
    run_paced(spark, f"{scratch}/src", 8, "50 milliseconds", keep, f"{scratch}/ckpt")
    assert seen[2][0] == seen[2][1]  # the same rows again
    assert [seen[mb][-1] for mb in sorted(seen)] == [sorted(order[i:i + 8]) for i in range(0, 50, 8)]
    write_arrivals(df.limit(0), "id", f"{scratch}/none")
    run_paced(spark, f"{scratch}/none", 8, "50 milliseconds", keep, f"{scratch}/ckpt0")
