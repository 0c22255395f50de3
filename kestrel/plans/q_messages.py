"""Queries: messages, correlation, latency, label books and task joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import labels as L
from kestrel.functions.arrays import one_hot, one_hot_matrix
from kestrel.operators import latency as LT
from kestrel.operators.metrics import round_cols as R
from kestrel.plans import fixtures as X
from kestrel.plans.catalogue import query
from kestrel.plans.sqlparts import ASP, POST, REQRESP
from kestrel.sources import messages as MS

_CID_SQL = "sha256(CAST(event_id AS VARCHAR) || '-' || CAST(user_id AS VARCHAR))"


@query("with_correlation_id", f"""SELECT event_id, {_CID_SQL} AS correlation_id FROM events""")
def with_correlation_id_q(spark, sf):
    ev = X.table(spark, sf, "events")
    return MS.with_correlation_id(ev, ["event_id", "user_id"]).select("event_id", "correlation_id")


@query("request_json", f"""SELECT {_CID_SQL} AS key,
  CAST(to_json({{'id': CAST(event_id AS VARCHAR), 'data': props}}) AS VARCHAR) AS value FROM events""")
def request_json_q(spark, sf):
    ev = MS.with_correlation_id(X.table(spark, sf, "events"), ["event_id", "user_id"])
    return MS.to_messages(ev, "correlation_id", {"id": F.col("event_id").cast("string"), "data": F.col("props")})


@query("parse_request", """SELECT sha256(CAST(event_id AS VARCHAR) || '-' || CAST(user_id AS VARCHAR)) AS key,
  CAST(event_id AS VARCHAR) AS id, props AS data FROM events""")
def parse_request_q(spark, sf):
    msgs = request_json_q(spark, sf)
    return MS.parse_messages(msgs)


@query("parse_props", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def parse_props_q(spark, sf):
    ev = X.table(spark, sf, "events").select("event_id", "props")
    return MS.parse_json(ev, "props", "k int")


_ACSA_SQL = "'[' || array_to_string(p_aspects, ', ') || ']'"


@query("response_json", f"""WITH {ASP}
SELECT sha256(CAST(vec_id AS VARCHAR)) AS key,
  CAST(to_json({{'id': CAST(vec_id AS VARCHAR), 'prediction': p_label, 'acsa': {_ACSA_SQL},
            'data': 'vec ' || CAST(vec_id AS VARCHAR)}}) AS VARCHAR) AS value FROM asp""")
def response_json_q(spark, sf):
    a = X.aspect_rows(spark, sf)
    a = a.withColumn("cid", F.sha2(F.col("vec_id").cast("string"), 256))
    return MS.to_messages(a, "cid", {
        "id": F.col("vec_id").cast("string"), "prediction": F.col("p_label"),
        "acsa": MS.list_text("p_aspects"),
        "data": F.concat(F.lit("vec "), F.col("vec_id").cast("string"))})


@query("response_parse", f"""WITH {ASP}
SELECT sha256(CAST(vec_id AS VARCHAR)) AS correlation_id, CAST(vec_id AS VARCHAR) AS id, p_label AS cls,
       array_to_string(p_aspects, ',') AS acsa FROM asp""")
def response_parse_q(spark, sf):
    a = X.aspect_rows(spark, sf)
    text = MS.format_response(F.sha2(F.col("vec_id").cast("string"), 256), "vec_id", "p_label", "p_aspects")
    p = a.select(MS.parse_response(text).alias("r")).select("r.*")
    return p.select("correlation_id", "id", "cls", F.array_join("acsa", ",").alias("acsa"))


@query("training_records", f"""WITH {ASP}
SELECT 'vec ' || CAST(vec_id AS VARCHAR) AS input_data, CAST(t_label AS VARCHAR) AS prediction,
       '[' || array_to_string(t_aspects, ', ') || ']' AS acsa, array_to_string(t_aspects, ',') AS acsa_parsed
FROM asp""")
def training_records_q(spark, sf):
    from kestrel.sources.tables import to_training_records
    a = X.aspect_rows(spark, sf).withColumn("text", F.concat(F.lit("vec "), F.col("vec_id").cast("string")))
    rec = to_training_records(a, "text", "t_label", "t_aspects")
    return rec.withColumn("acsa_parsed", F.array_join(MS.parse_list_text("acsa"), ","))


@query("report_to_training", f"""WITH {ASP},
tr AS (SELECT 'vec ' || CAST(vec_id AS VARCHAR) AS input_data, CAST(t_label AS VARCHAR) AS prediction,
              '[' || array_to_string(t_aspects, ', ') || ']' AS acsa, 'train' AS source FROM asp),
rp AS (SELECT 'vec ' || CAST(vec_id AS VARCHAR) AS input_data, CAST(t_label AS VARCHAR) AS prediction,
              '[' || array_to_string(t_aspects, ', ') || ']' AS acsa, 'report' AS source
       FROM asp WHERE p_label <> t_label)
SELECT * FROM tr UNION ALL SELECT * FROM rp""")
def report_to_training_q(spark, sf):
    a = X.aspect_rows(spark, sf)
    train = a.select(F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("input_data"),
                     F.col("t_label").cast("string").alias("prediction"), MS.list_text("t_aspects").alias("acsa"))
    # a user report: the corrected 5-element list [label, a1..a4] for a wrong prediction
    reports = a.where(F.col("p_label") != F.col("t_label")).select(
        F.col("vec_id").cast("string").alias("id"), F.col("t_label").alias("prediction"),
        F.concat(F.array(F.col("t_label")), F.col("t_aspects")).alias("acsa"),
        F.lit("report").alias("type"),
        F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("data"))
    return MS.training_pool(train, reports)


@query("correlate_latency", f"""WITH {REQRESP}
SELECT req.correlation_id, config, round(date_diff('microsecond', sent_at, answered_at) / 1e6, 6) AS latency
FROM req JOIN resp ON req.correlation_id = resp.correlation_id""")
def correlate_latency_q(spark, sf):
    j = LT.correlate(X.requests(spark, sf), X.responses(spark, sf))
    return R(j.select("correlation_id", "config", "latency"))


@query("latency_stats", f"""WITH {REQRESP},
l AS (SELECT config, date_diff('microsecond', sent_at, answered_at) / 1e6 AS latency
      FROM req JOIN resp ON req.correlation_id = resp.correlation_id)
SELECT config, CAST(count(*) AS BIGINT) AS n, round(avg(latency), 6) AS avg, round(min(latency), 6) AS min,
       round(max(latency), 6) AS max, round(quantile_cont(latency, 0.25), 6) AS p25,
       round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.75), 6) AS p75,
       round(quantile_cont(latency, 0.95), 6) AS p95 FROM l GROUP BY config""")
def latency_stats_q(spark, sf):
    j = LT.correlate(X.requests(spark, sf), X.responses(spark, sf))
    return R(LT.latency_stats(j, "config", "latency"))


@query("label_decode", f"""WITH {POST}
SELECT recruitment_id, label,
  CASE label WHEN 0 THEN 'clean' WHEN 1 THEN 'warning' WHEN 2 THEN 'seeding' END AS name,
  CASE label WHEN 0 THEN 'rõ ràng' WHEN 1 THEN 'cảnh báo' WHEN 2 THEN 'có yếu tố thu hút' END AS name_vi,
  label AS code_back FROM post""")
def label_decode_q(spark, sf):
    p = X.postings(spark, sf)
    d = p.select("recruitment_id", "label", L.label_decode("label").alias("name"),
                 L.label_decode("label", "label_vi").alias("name_vi"))
    return d.withColumn("code_back", L.label_encode("name"))


@query("one_hot", f"""WITH {ASP}
SELECT vec_id, array_to_string(list_transform(range(0, 3), lambda i: CASE WHEN i = t_label THEN 1.0 ELSE 0.0 END), ',')
         AS label_onehot,
       array_to_string(list_transform(t_aspects, lambda c: array_to_string(
         list_transform(range(0, 4), lambda i: CASE WHEN i = c THEN 1.0 ELSE 0.0 END), ',')), ';') AS aspects_onehot
FROM asp""")
def one_hot_q(spark, sf):
    a = X.aspect_rows(spark, sf)
    txt = lambda arr: F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")
    return a.select("vec_id", txt(one_hot("t_label", 3)).alias("label_onehot"),
                    F.array_join(F.transform(one_hot_matrix("t_aspects", 4), txt), ";").alias("aspects_onehot"))


def _asp_vi(x: str) -> str:
    return (f"CASE {x} WHEN 0 THEN 'trung tính' WHEN 1 THEN 'tích cực' WHEN 2 THEN 'tiêu cực' "
            f"WHEN 3 THEN 'không đề cập' END")


def _lab_vi(x: str) -> str:
    return f"CASE {x} WHEN 0 THEN 'rõ ràng' WHEN 1 THEN 'cảnh báo' WHEN 2 THEN 'có yếu tố thu hút' END"


VERB_SQL = ("'khía cạnh tiêu đề: ' || " + _asp_vi("p_aspects[1]") + " || ' [SEP] ' || "
            "'khía cạnh mô tả: ' || " + _asp_vi("p_aspects[2]") + " || ' [SEP] ' || "
            "'khía cạnh công ty: ' || " + _asp_vi("p_aspects[3]") + " || ' [SEP] ' || "
            "'khía cạnh khác: ' || " + _asp_vi("p_aspects[4]") + " || ' [SEP] ' || "
            "'nhãn chung: ' || " + _lab_vi("p_label") + " || ' [SEP]'")


@query("verbalise", f"""WITH {ASP}
SELECT vec_id, {VERB_SQL} AS pre_tasks FROM asp""")
def verbalise_q(spark, sf):
    a = X.aspect_rows(spark, sf)
    return a.select("vec_id", L.verbalise("p_label", "p_aspects").alias("pre_tasks"))


@query("join_task_outputs", f"""WITH {ASP}
SELECT vec_id, p_label AS predicted_label, p_aspects[1] AS predicted_title, p_aspects[2] AS predicted_desc,
       p_aspects[3] AS predicted_comp, p_aspects[4] AS predicted_other FROM asp""")
def join_task_outputs_q(spark, sf):
    from kestrel.operators.heads import join_task_outputs, task1_output, task2_output
    a = X.aspect_rows(spark, sf)
    return join_task_outputs(task1_output(a, "vec_id", "label_scores"), task2_output(a, "vec_id", "aspect_scores"),
                             "vec_id")
