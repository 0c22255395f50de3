"""Queries: class scores, classification and multi-aspect metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions.arrays import cross_entropy, log_softmax
from kestrel.operators import metrics as M
from kestrel.plans import fixtures as X
from kestrel.plans.catalogue import query
from kestrel.plans.sqlparts import ASP, CLS

R = M.round_cols


@query("argmax_class", f"""WITH {CLS}
SELECT vec_id, t AS true_label, p AS pred_label FROM cls""")
def argmax_class_q(spark, sf):
    return X.cls_rows(spark, sf).select("vec_id", F.col("t").alias("true_label"),
                                        F.col("p").alias("pred_label"))


@query("log_softmax", f"""WITH {CLS},
l AS (SELECT vec_id, s, list_max(s) + ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) AS lse
      FROM cls)
SELECT vec_id, CAST(unnest(generate_series(0, len(s) - 1)) AS INTEGER) AS cls,
       unnest(list_transform(s, lambda x: round(x - lse, 6))) AS logp
FROM l""")
def log_softmax_q(spark, sf):
    c = X.cls_rows(spark, sf)
    return c.select("vec_id", F.posexplode(log_softmax("scores")).alias("cls", "logp")) \
            .select("vec_id", F.col("cls").cast("int"), F.round("logp", 6).alias("logp"))


@query("cross_entropy", f"""WITH {CLS},
l AS (SELECT t, s, list_max(s) + ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) AS lse
      FROM cls)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(lse - s[t + 1]), 6) AS loss FROM l""")
def cross_entropy_q(spark, sf):
    c = X.cls_rows(spark, sf)
    ce = c.select(cross_entropy(log_softmax("scores"), "t").alias("ce"))
    return ce.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ce"), 6).alias("loss"))


_PER_CLASS_SQL = """classes AS (SELECT {keys} t AS cls FROM {src} UNION SELECT {keys} p FROM {src}),
tp AS (SELECT {keys} t AS cls, count(*) AS n FROM {src} WHERE t = p GROUP BY {keys} t),
sup AS (SELECT {keys} t AS cls, count(*) AS n FROM {src} GROUP BY {keys} t),
prd AS (SELECT {keys} p AS cls, count(*) AS n FROM {src} GROUP BY {keys} p),
pc AS (
  SELECT {ckeys} c.cls, CAST(coalesce(tp.n, 0) AS BIGINT) AS tp, CAST(coalesce(sup.n, 0) AS BIGINT) AS support,
         CAST(coalesce(prd.n, 0) AS BIGINT) AS predicted
  FROM classes c LEFT JOIN tp USING ({using}) LEFT JOIN sup USING ({using}) LEFT JOIN prd USING ({using})),
pcm AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
            CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
            CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END AS f1
  FROM pc)"""

CLS_PC = CLS + ",\n" + _PER_CLASS_SQL.format(src="cls", keys="", ckeys="", using="cls")


@query("per_class_metrics", f"""WITH {CLS_PC}
SELECT cls, tp, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM pcm""")
def per_class_metrics_q(spark, sf):
    counts = M.count_table(X.cls_rows(spark, sf), "t", "p")
    return R(M.per_class_metrics(counts))


@query("cls_metrics", f"""WITH {CLS_PC}
SELECT round(sum(tp) / sum(support), 6) AS acc, round(avg(precision), 6) AS precision,
       round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM pcm""")
def cls_metrics_q(spark, sf):
    counts = M.count_table(X.cls_rows(spark, sf), "t", "p")
    return R(M.cls_metrics(counts, average="macro"))


@query("confusion_matrix", f"""WITH {CLS}
SELECT t, {", ".join(f"CAST(count(*) FILTER (WHERE p = {c}) AS BIGINT) AS p{c}" for c in range(10))}
FROM cls GROUP BY t""")
def confusion_matrix_q(spark, sf):
    counts = M.count_table(X.cls_rows(spark, sf), "t", "p")
    return M.confusion_matrix(counts, list(range(10)))


# --- aspects ---------------------------------------------------------------

ASP_PC = ASP + ",\n" + _PER_CLASS_SQL.format(src="asp_long", keys="aspect,", ckeys="aspect,",
                                             using="aspect, cls")


def _aspect_avg_sql(kind: str) -> str:
    if kind == "macro":
        per = """SELECT aspect, sum(tp) / sum(support) AS acc, avg(precision) AS precision,
                 avg(recall) AS recall, avg(f1) AS f1 FROM pcm GROUP BY aspect"""
    elif kind == "micro":
        per = """SELECT aspect, sum(tp) / sum(support) AS acc, sum(tp) / sum(predicted) AS precision,
                 sum(tp) / sum(support) AS recall, 2.0 * sum(tp) / (sum(support) + sum(predicted)) AS f1
                 FROM pcm GROUP BY aspect"""
    else:
        per = """SELECT aspect, sum(tp) / sum(support) AS acc,
                 sum(precision * support) / sum(support) AS precision,
                 sum(recall * support) / sum(support) AS recall,
                 sum(f1 * support) / sum(support) AS f1 FROM pcm GROUP BY aspect"""
    return f"""WITH {ASP_PC}, per AS ({per})
SELECT round(avg(acc), 6) AS acc, round(avg(precision), 6) AS precision,
       round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM per"""


def _aspect_avg(spark, sf, kind):
    a = X.aspect_rows(spark, sf)
    return R(M.aspect_mean(M.aspect_metrics(a, "t_aspects", "p_aspects", average=kind)))


@query("aspect_metrics_macro", _aspect_avg_sql("macro"))
def aspect_metrics_macro_q(spark, sf):
    return _aspect_avg(spark, sf, "macro")


@query("aspect_metrics_micro", _aspect_avg_sql("micro"))
def aspect_metrics_micro_q(spark, sf):
    return _aspect_avg(spark, sf, "micro")


@query("aspect_metrics_weighted", _aspect_avg_sql("weighted"))
def aspect_metrics_weighted_q(spark, sf):
    return _aspect_avg(spark, sf, "weighted")


@query("aspect_metrics_by_aspect", f"""WITH {ASP_PC}
SELECT aspect, round(sum(tp) / sum(support), 6) AS acc, round(avg(precision), 6) AS precision,
       round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM pcm GROUP BY aspect""")
def aspect_metrics_by_aspect_q(spark, sf):
    a = X.aspect_rows(spark, sf)
    return R(M.aspect_metrics(a, "t_aspects", "p_aspects"))


@query("aspect_confusion", f"""WITH {ASP}
SELECT aspect, t, {", ".join(f"CAST(count(*) FILTER (WHERE p = {c}) AS BIGINT) AS p{c}" for c in range(4))}
FROM asp_long GROUP BY aspect, t""")
def aspect_confusion_q(spark, sf):
    a = M.aspect_long(X.aspect_rows(spark, sf), "t_aspects", "p_aspects")
    return M.confusion_matrix(M.count_table(a, "t", "p", by="aspect"), list(range(4)), by="aspect")


_TPFPFN_SQL = ASP + """,
grid AS (SELECT CAST(a AS INTEGER) AS aspect, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS cls FROM range(0, 4) r(a)),
tff AS (
  SELECT g.aspect, g.cls,
    CAST(count(x.vec_id) FILTER (WHERE x.t = g.cls AND x.p = g.cls) AS BIGINT) AS tp,
    CAST(count(x.vec_id) FILTER (WHERE x.t <> g.cls AND x.p = g.cls) AS BIGINT) AS fp,
    CAST(count(x.vec_id) FILTER (WHERE x.t = g.cls AND x.p <> g.cls) AS BIGINT) AS fn
  FROM grid g LEFT JOIN asp_long x ON x.aspect = g.aspect GROUP BY g.aspect, g.cls),
sm AS (
  SELECT aspect, cls, tp, fp, fn,
    round((tp + 2.220446049250313e-16) / (tp + fp + fn + 2.220446049250313e-16), 6) AS acc,
    round((tp + 2.220446049250313e-16) / (tp + fp + 2.220446049250313e-16), 6) AS precision,
    round((tp + 2.220446049250313e-16) / (tp + fn + 2.220446049250313e-16), 6) AS recall
  FROM tff),
sm2 AS (SELECT *, round(2 * precision * recall / (precision + recall + 2.220446049250313e-16), 6) AS f1 FROM sm)"""


# exact half-up mean of 6-decimal values, in integer micro-units
_MEAN6 = ("((2 * sum(CAST(round({c} * 1000000) AS BIGINT)) + count(*)) // (2 * count(*))) / 1000000.0")


def _tpfpfn(spark, sf):
    a = M.aspect_long(X.aspect_rows(spark, sf), "t_aspects", "p_aspects")
    return M.aspect_tp_fp_fn(M.count_table(a, "t", "p", by="aspect"))


@query("aspect_tp_fp_fn", f"""WITH {_TPFPFN_SQL}
SELECT aspect, cls, tp, fp, fn FROM tff""")
def aspect_tp_fp_fn_q(spark, sf):
    return _tpfpfn(spark, sf)


@query("smoothed_metrics", f"""WITH {_TPFPFN_SQL}
SELECT aspect, cls, tp, fp, fn, acc, precision, recall, f1 FROM sm2""")
def smoothed_metrics_q(spark, sf):
    return M.smoothed_metrics(_tpfpfn(spark, sf))


@query("aspect_rollup", f"""WITH {_TPFPFN_SQL}
SELECT CAST(aspect AS VARCHAR) AS aspect, {_MEAN6.format(c="acc")} AS acc, {_MEAN6.format(c="precision")} AS precision,
       {_MEAN6.format(c="recall")} AS recall, {_MEAN6.format(c="f1")} AS f1 FROM sm2 GROUP BY aspect
UNION ALL
SELECT 'Overall', {_MEAN6.format(c="acc")}, {_MEAN6.format(c="precision")}, {_MEAN6.format(c="recall")},
       {_MEAN6.format(c="f1")} FROM sm2""")
def aspect_rollup_q(spark, sf):
    return R(M.aspect_rollup(M.smoothed_metrics(_tpfpfn(spark, sf))))


@query("multilabel_losses", f"""WITH {ASP},
m AS (SELECT vec_id, list_sum(list_transform(range(1, 5), lambda i: CASE WHEN t_aspects[i] = p_aspects[i]
        THEN 0 ELSE 1 END)) AS mism FROM asp)
SELECT round(sum(mism) / (count(*) * 4), 6) AS hamming_loss,
       round(avg(CASE WHEN mism > 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_one_loss,
       round(avg(CASE WHEN mism = 0 THEN 1.0 ELSE 0.0 END), 6) AS exact_match FROM m""")
def multilabel_losses_q(spark, sf):
    return R(M.multilabel_losses(X.aspect_rows(spark, sf), "t_aspects", "p_aspects"))


@query("multilabel_example", f"""WITH {ASP},
ind AS (SELECT vec_id, list_transform(t_aspects, lambda x: CASE WHEN x <> 3 THEN 1 ELSE 0 END) AS ti,
               list_transform(p_aspects, lambda x: CASE WHEN x <> 3 THEN 1 ELSE 0 END) AS pi FROM asp),
r AS (SELECT list_sum(list_transform(range(1, 5), lambda i: ti[i] * pi[i])) AS i,
             list_sum(list_transform(range(1, 5), lambda i: greatest(ti[i], pi[i]))) AS u,
             list_sum(ti) AS st, list_sum(pi) AS sp FROM ind)
SELECT CASE WHEN count(*) FILTER (WHERE u = 0) > 0 THEN NULL ELSE round(sum(i / u) / count(*), 6) END AS accuracy,
       round(sum(CASE WHEN sp > 0 THEN i / sp ELSE 0 END) / count(*), 6) AS precision,
       round(sum(CASE WHEN st > 0 THEN i / st ELSE 0 END) / count(*), 6) AS recall,
       round(sum(CASE WHEN st + sp > 0 THEN 2.0 * i / (st + sp) ELSE 0 END) / count(*), 6) AS f1
FROM r""")
def multilabel_example_q(spark, sf):
    a = X.aspect_rows(spark, sf)
    ind = a.select(F.transform("t_aspects", lambda x: F.when(x != 3, 1).otherwise(0)).alias("ti"),
                   F.transform("p_aspects", lambda x: F.when(x != 3, 1).otherwise(0)).alias("pi"))
    return R(M.multilabel_example(ind, "ti", "pi"))


@query("epoch_stats", """WITH ev AS (
  SELECT (date_diff('day', min(CAST(ts AS DATE)) OVER (), CAST(ts AS DATE)) + 1) % 5 AS epoch,
         value, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS correct FROM events),
pe AS (SELECT CAST(epoch AS INTEGER) AS epoch, CAST(count(*) AS BIGINT) AS n, avg(value) AS loss,
              sum(correct) / count(*) AS acc FROM ev GROUP BY epoch)
SELECT epoch, n, round(loss, 6) AS loss, round(acc, 6) AS acc,
       round(avg(loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_loss
FROM pe""")
def epoch_stats_q(spark, sf):
    ev = X.table(spark, sf, "events")
    day = F.to_date("ts")
    first = ev.agg(F.min(F.to_date("ts")).alias("d0"))
    # the first day is one value: pass it as a literal instead of joining it in
    d0 = first.first()["d0"]
    rows = ev.select(((F.datediff(day, F.lit(d0)) + 1) % 5).cast("int").alias("epoch"),
                     F.col("value").alias("loss"),
                     (F.col("event_type") == "purchase").cast("int").alias("correct"))
    return R(M.epoch_stats(rows, "epoch", "loss", "correct"))

