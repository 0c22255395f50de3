"""Classification metrics against plain-Python re-computation, edge cases included."""

import math

import pytest
from hypothesis import given, settings, strategies as st

from kestrel.operators import metrics as M


def py_macro(t, p):
    classes = sorted(set(t) | set(p))
    prec, rec, f1 = [], [], []
    for c in classes:
        tp = sum(1 for a, b in zip(t, p) if a == c and b == c)
        sup = sum(1 for a in t if a == c)
        pr = sum(1 for b in p if b == c)
        prec.append(tp / pr if pr else 0.0)
        rec.append(tp / sup if sup else 0.0)
        f1.append(2 * tp / (sup + pr) if sup + pr else 0.0)
    acc = sum(1 for a, b in zip(t, p) if a == b) / len(t)
    return acc, sum(prec) / len(classes), sum(rec) / len(classes), sum(f1) / len(classes)


def frame(spark, t, p):
    return spark.createDataFrame(list(zip(t, p)), "t int, p int")


def test_macro_with_absent_and_extra_classes(spark):
    # class 3 is only predicted, class 2 never predicted
    t = [0, 0, 1, 1, 2, 2]
    p = [0, 1, 1, 3, 0, 1]
    r = M.cls_metrics(M.count_table(frame(spark, t, p), "t", "p")).first()
    exp = py_macro(t, p)
    assert r["acc"] == pytest.approx(exp[0])
    assert (r["precision"], r["recall"], r["f1"]) == pytest.approx(exp[1:])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=40))
def test_macro_property(spark, pairs):
    t, p = [a for a, _ in pairs], [b for _, b in pairs]
    r = M.cls_metrics(M.count_table(frame(spark, t, p), "t", "p")).first()
    exp = py_macro(t, p)
    assert (r["acc"], r["precision"], r["recall"], r["f1"]) == pytest.approx(exp)


def test_micro_equals_accuracy_and_weighted(spark):
    t = [0, 0, 1, 2, 2, 2]
    p = [0, 1, 1, 2, 0, 2]
    c = M.count_table(frame(spark, t, p), "t", "p")
    mi = M.cls_metrics(c, average="micro").first()
    assert mi["precision"] == pytest.approx(mi["acc"]) and mi["f1"] == pytest.approx(mi["acc"])
    pc = {r["cls"]: r for r in M.per_class_metrics(c).collect()}
    w = M.cls_metrics(c, average="weighted").first()
    exp = sum(pc[k]["f1"] * pc[k]["support"] for k in pc) / len(t)
    assert w["f1"] == pytest.approx(exp)


def test_confusion_matrix_fills_zeros(spark):
    c = M.count_table(frame(spark, [0, 1, 1], [1, 1, 1]), "t", "p")
    rows = {r["t"]: r for r in M.confusion_matrix(c, [0, 1, 2]).collect()}
    assert (rows[0]["p0"], rows[0]["p1"], rows[0]["p2"]) == (0, 1, 0)
    assert (rows[1]["p0"], rows[1]["p1"], rows[1]["p2"]) == (0, 2, 0)


def test_smoothed_absent_class_scores_one(spark):
    df = spark.createDataFrame([([0, 0, 0, 0], [0, 0, 0, 0]), ([1, 0, 0, 0], [0, 0, 0, 0])],
                               "t array<int>, p array<int>")
    counts = M.count_table(M.aspect_long(df, "t", "p"), "t", "p", by="aspect")
    sm = {(r["aspect"], r["cls"]): r for r in M.smoothed_metrics(M.aspect_tp_fp_fn(counts)).collect()}
    assert len(sm) == 16
    absent = sm[(1, 3)]
    assert (absent["acc"], absent["precision"], absent["recall"], absent["f1"]) == (1.0, 1.0, 1.0, 1.0)
    a0c1 = sm[(0, 1)]   # tp 0, fn 1
    assert a0c1["recall"] == 0.0 and a0c1["precision"] == 1.0
    roll = {r["aspect"]: r for r in M.aspect_rollup(M.smoothed_metrics(M.aspect_tp_fp_fn(counts))).collect()}
    assert set(roll) == {"0", "1", "2", "3", "Overall"}
    assert roll["Overall"]["f1"] == pytest.approx(sum(roll[str(a)]["f1"] for a in range(4)) / 4)


def test_multilabel_example_empty_rows(spark):
    df = spark.createDataFrame([([1, 0, 1], [1, 1, 0]), ([0, 0, 0], [0, 1, 0])], "t array<int>, p array<int>")
    r = M.multilabel_example(df, "t", "p").first()
    # row 1: i=1, st=2, sp=2; row 2: i=0, st=0, sp=1
    assert r["recall"] == pytest.approx((1 / 2 + 0) / 2)
    assert r["precision"] == pytest.approx((1 / 2 + 0) / 2)
    assert r["f1"] == pytest.approx((2 / 4 + 0) / 2)
    assert r["accuracy"] == pytest.approx((1 / 3 + 0) / 2)
    both_empty = spark.createDataFrame([([0, 0], [0, 0]), ([1, 0], [1, 0])], "t array<int>, p array<int>")
    assert M.multilabel_example(both_empty, "t", "p").first()["accuracy"] is None


def test_multilabel_losses(spark):
    df = spark.createDataFrame([([0, 1, 2, 3], [0, 1, 2, 3]), ([0, 1, 2, 3], [1, 1, 2, 0])],
                               "t array<int>, p array<int>")
    r = M.multilabel_losses(df, "t", "p").first()
    assert r["hamming_loss"] == pytest.approx(2 / 8)
    assert r["zero_one_loss"] == pytest.approx(0.5)
    assert r["exact_match"] == pytest.approx(0.5)


def test_epoch_stats_running_mean(spark):
    df = spark.createDataFrame([(1, 2.0, 1), (1, 4.0, 0), (2, 1.0, 1)], "epoch int, loss double, correct int")
    rows = {r["epoch"]: r for r in M.epoch_stats(df, "epoch", "loss", "correct").collect()}
    assert rows[1]["loss"] == 3.0 and rows[1]["acc"] == 0.5
    assert rows[2]["running_loss"] == pytest.approx(2.0)
    assert not math.isnan(rows[2]["acc"])
