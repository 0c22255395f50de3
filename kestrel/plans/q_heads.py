"""Queries: heads, batch scoring, evaluation records, the cascade, stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kestrel.codebook import EPOCHS, OFFLINE_FIELD_NAMES, TRIGGER_ROWS
from kestrel.operators import heads as H
from kestrel.operators import metrics as M
from kestrel.operators.metrics import round_cols as R
from kestrel.plans import fixtures as X
from kestrel.plans.catalogue import query
from kestrel.plans.q_messages import VERB_SQL
from kestrel.plans.sqlparts import ASP, POST, REG, STORED, history_sql
from kestrel.sources import tables as TB


@query("cascade", f"""WITH {ASP},
c AS (SELECT vec_id, p_label AS predicted_label, p_aspects[1] AS predicted_title, p_aspects[2] AS predicted_desc,
             p_aspects[3] AS predicted_comp, p_aspects[4] AS predicted_other, p_label, p_aspects FROM asp)
SELECT vec_id, predicted_label, predicted_title, predicted_desc, predicted_comp, predicted_other,
       {VERB_SQL} AS pre_tasks FROM c""")
def cascade_q(spark, sf):
    return H.cascade(X.aspect_rows(spark, sf), "vec_id", "label_scores", "aspect_scores")


_CENT = """emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
cent AS (SELECT cls, list(m ORDER BY dim) AS c FROM (
           SELECT label AS cls, dim, avg(x) AS m FROM (
             SELECT label, unnest(generate_series(0, len(e) - 1)) AS dim, unnest(e) AS x FROM emb)
           GROUP BY label, dim) GROUP BY cls),
cl AS (SELECT list(c ORDER BY cls) AS cs, list(cls ORDER BY cls) AS ks FROM cent),
s0 AS (SELECT vec_id, label AS t, list_transform((SELECT cs FROM cl), lambda cc: list_inner_product(e, cc)) AS s
       FROM emb),
sc AS (SELECT vec_id, t, (SELECT ks FROM cl)[list_position(s, list_max(s))] AS p, list_max(s) AS best FROM s0)"""


def _centroid_scored(spark, sf):
    e = X.table(spark, sf, "embeddings")
    w, b = H.weights_arrays(H.centroid_weights(e, "embedding", "label"))
    return H.score_batch(e, "embedding", w, b)


@query("score_batch", f"""WITH {_CENT}
SELECT vec_id, CAST(p AS INTEGER) AS pred, round(best, 6) AS best_score FROM sc""")
def score_batch_q(spark, sf):
    s = _centroid_scored(spark, sf)
    return s.select("vec_id", "pred", F.round(F.array_max("scores"), 6).alias("best_score"))


@query("evaluate_and_register", f"""WITH {_CENT}, {REG},
classes AS (SELECT t AS cls FROM sc UNION SELECT p FROM sc),
tpc AS (SELECT t AS cls, count(*) AS n FROM sc WHERE t = p GROUP BY t),
supc AS (SELECT t AS cls, count(*) AS n FROM sc GROUP BY t),
prdc AS (SELECT p AS cls, count(*) AS n FROM sc GROUP BY p),
pc AS (SELECT c.cls, coalesce(tpc.n, 0) AS tp, coalesce(supc.n, 0) AS support, coalesce(prdc.n, 0) AS predicted
       FROM classes c LEFT JOIN tpc USING (cls) LEFT JOIN supc USING (cls) LEFT JOIN prdc USING (cls)),
m AS (SELECT sum(tp) / sum(support) AS acc,
             avg(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END) AS avg_pre,
             avg(CASE WHEN support > 0 THEN tp / support ELSE 0 END) AS avg_recall,
             avg(CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END) AS avg_f1
      FROM pc)
SELECT (SELECT max(version) + 1 FROM reg) AS version, 'cls' AS task, round(acc, 6) AS acc,
       round(avg_pre, 6) AS avg_pre, round(avg_recall, 6) AS avg_recall, round(avg_f1, 6) AS avg_f1 FROM m""")
def evaluate_and_register_q(spark, sf):
    s = _centroid_scored(spark, sf)
    met = M.cls_metrics(M.count_table(s, "label", "pred"))
    # the registry has one row per trigger: its next version is a single number
    nxt = X.registry(spark, sf).agg(F.max("version")).first()[0] + 1
    rec = met.select(F.lit(int(nxt)).alias("version"), F.lit("cls").alias("task"), "acc",
                     F.col("precision").alias("avg_pre"), F.col("recall").alias("avg_recall"),
                     F.col("f1").alias("avg_f1"))
    return R(rec)


def _history_frame(spark, hist):
    return spark.createDataFrame(hist, "epoch int, head int, loss double, acc double, n long")


@query("train_head", history_sql(1, 10, EPOCHS, 0.5))
def train_head_q(spark, sf):
    e = X.table(spark, sf, "embeddings")
    hist: list = []
    H.train_heads(e, "embedding", "label", 10, epochs=EPOCHS, lr=0.5, history=hist)
    return R(_history_frame(spark, hist))


@query("train_head_adam")
def train_head_adam_q(spark, sf):
    """Mini-batch Adam (lr 1e-3 as configured originally, batches of a trigger's rows), a summed gradient per step."""
    e = X.table(spark, sf, "embeddings")
    hist: list = []
    H.train_heads(e, "embedding", "label", 10, epochs=EPOCHS, lr=1e-3, method="adam", batch_size=TRIGGER_ROWS,
                  history=hist)
    return R(_history_frame(spark, hist))


@query("train_aspect_heads", history_sql(4, 4, EPOCHS, 0.5))
def train_aspect_heads_q(spark, sf):
    hist: list = []
    H.train_heads(X.vector_rows(spark, sf), "embedding", "t_aspects", 4, epochs=EPOCHS, lr=0.5, n_heads=4, history=hist)
    return R(_history_frame(spark, hist))


@query("cascade_stored", f"""WITH {STORED}, c AS (
  SELECT vec_id, p_label, p_aspects, d.lang, d.source, d.text FROM scored s LEFT JOIN documents d ON d.doc_id = s.vec_id)
SELECT vec_id, p_label AS predicted_label, p_aspects[1] AS predicted_title, p_aspects[2] AS predicted_desc, p_aspects[3] AS predicted_comp,
       p_aspects[4] AS predicted_other, {VERB_SQL} AS pre_tasks,
       '[CLS] {OFFLINE_FIELD_NAMES[0]}: ' || coalesce(lang, 'nan') || ' [SEP] {OFFLINE_FIELD_NAMES[1]}: ' || coalesce(source, 'nan')
         || ' [SEP] {OFFLINE_FIELD_NAMES[2]}: ' || coalesce(text, 'nan') || ' [SEP] ' || ({VERB_SQL}) AS text FROM c""")
def cascade_stored_q(spark, sf):
    """Both tasks' heads stored as version 1, loaded, scored in one pass, verbalised, written and read back."""
    from kestrel.operators.cascade import run_cascade
    e = X.vector_rows(spark, sf)
    base = TB.scratch_path(spark, f"cascade-{uuid.uuid4().hex}")
    TB.save_weights(H.centroid_weights(e, "embedding", "t_label"), f"{base}/store", "cls", 1)
    TB.save_weights(H.centroid_weights(e, "embedding", "t_aspects", 4), f"{base}/store", "acsa", 1)
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source", "text")
    rows = e.select("vec_id", "embedding").join(docs, "vec_id", "left")
    return run_cascade(rows, "vec_id", "embedding", ["lang", "source", "text"], f"{base}/store", {"cls": 1, "acsa": 1}, f"{base}/out")


@query("model_store", """SELECT 0 AS head, label AS cls, CAST(0.0 AS DOUBLE) AS bias, CAST(max(len(embedding)) AS INTEGER) AS dims
FROM embeddings GROUP BY label""")
def model_store_q(spark, sf):
    e = X.table(spark, sf, "embeddings")
    path = TB.scratch_path(spark, f"model_store-{uuid.uuid4().hex}")
    TB.save_weights(H.centroid_weights(e, "embedding", "label"), path, "cls", 1)
    back = TB.load_weights(spark, path, "cls", 1)
    return back.select("head", "cls", "bias", F.size("w").alias("dims"))


@query("csv_roundtrip", f"""WITH {POST}
SELECT recruitment_id, title, body, company_name FROM post""")
def csv_roundtrip_q(spark, sf):
    p = X.postings(spark, sf).select("recruitment_id", "title", "body", "company_name")
    path = TB.scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    TB.write_csv(p, path)
    return TB.read_postings(spark, path, p.schema)


@query("registry_seed", f"""WITH {REG}
SELECT md5(CAST(version AS VARCHAR)) AS oid, acc, avg_f1, task, version FROM reg""")
def registry_seed_q(spark, sf):
    reg = X.registry(spark, sf)
    docs = reg.select(F.to_json(F.struct(
        F.struct(F.md5(F.col("version").cast("string")).alias("$oid")).alias("_id"),
        "version", "task", "acc", "avg_f1")).alias("value"))
    path = TB.scratch_path(spark, f"registry-seed-{uuid.uuid4().hex}")
    docs.write.text(path)
    return TB.seed_registry(spark, path, multi_line=False).select("oid", "acc", "avg_f1", "task", F.col("version").cast("int"))



@query("registry_append", f"""WITH {_CENT}, {REG},
classes AS (SELECT t AS cls FROM sc UNION SELECT p FROM sc),
tpc AS (SELECT t AS cls, count(*) AS n FROM sc WHERE t = p GROUP BY t),
supc AS (SELECT t AS cls, count(*) AS n FROM sc GROUP BY t),
prdc AS (SELECT p AS cls, count(*) AS n FROM sc GROUP BY p),
pc AS (SELECT c.cls, coalesce(tpc.n, 0) AS tp, coalesce(supc.n, 0) AS support, coalesce(prdc.n, 0) AS predicted
       FROM classes c LEFT JOIN tpc USING (cls) LEFT JOIN supc USING (cls) LEFT JOIN prdc USING (cls)),
m AS (SELECT sum(tp) / sum(support) AS acc,
             avg(CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END) AS avg_f1
      FROM pc)
SELECT version, task, acc, avg_f1, key FROM reg
UNION ALL
SELECT (SELECT max(version) + 1 FROM reg), 'cls', round(acc, 6), round(avg_f1, 6),
       CAST((SELECT max(version) + 1 FROM reg) AS BIGINT) FROM m""")
def registry_append_q(spark, sf):
    reg = X.registry(spark, sf)
    path = TB.scratch_path(spark, f"registry-{uuid.uuid4().hex}")
    reg.write.parquet(path)
    rec = evaluate_and_register_q(spark, sf).select(
        "version", "task", "acc", "avg_f1", F.col("version").cast("long").alias("key"))
    TB.append_rows(rec, path)
    return TB.read_table(spark, path).select("version", "task", "acc", "avg_f1", "key")


@query("fallback_prediction", f"""WITH {ASP}
SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE p_label END AS prediction,
       '[-1, -1, -1, -1]' AS acsa FROM asp""")
def fallback_prediction_q(spark, sf):
    from kestrel.functions.arrays import argmax_class, with_fallback
    from kestrel.sources.messages import list_text
    a = X.aspect_rows(spark, sf)
    # the label head fails on every 10th request; the aspect head is not deployed
    label = F.when(F.col("vec_id") % 10 != 0, argmax_class("label_scores"))
    aspects = F.lit(None).cast("array<int>")
    return a.select("vec_id", with_fallback(label).alias("prediction"),
                    list_text(with_fallback(aspects, 4)).alias("acsa"))
