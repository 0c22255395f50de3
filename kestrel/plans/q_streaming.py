"""Queries: streaming scoring, trigger ledger with restart, stream correlation, online strategies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kestrel.codebook import REPLAY_EVERY, TRIGGER_ROWS
from kestrel.functions.arrays import as_doubles
from kestrel.operators import heads as H
from kestrel.operators.metrics import round_cols as R
from kestrel.operators.online import online_learn
from kestrel.operators.sequence import seeded_hash
from kestrel.plans import fixtures as X
from kestrel.plans.catalogue import query
from kestrel.plans.q_heads import _CENT
from kestrel.plans.sqlparts import ASP, ORD, REG, REQRESP, STORED, online_sql
from kestrel.sources import messages as MS
from kestrel.sources.tables import scratch_path
from kestrel.streaming.correlate import stream_correlate
from kestrel.streaming.pacing import run_paced, write_arrivals
from kestrel.streaming.scoring import score_requests
from kestrel.streaming.triggers import block_size, init_ledger, read_ledger, stage_and_cut, stream_trigger

N, M = TRIGGER_ROWS, REPLAY_EVERY


def _await(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


@query("stream_score", f"""WITH {_CENT}, {ASP}
SELECT sha256(CAST(sc.vec_id AS VARCHAR)) AS key, CAST(sc.vec_id AS VARCHAR) AS id, CAST(sc.p AS INTEGER) AS prediction,
       '[' || array_to_string(asp.p_aspects, ', ') || ']' AS acsa
FROM sc JOIN asp ON sc.vec_id = asp.vec_id""")
def stream_score_q(spark, sf):
    e = X.table(spark, sf, "embeddings")
    base = scratch_path(spark, f"stream-score-{uuid.uuid4().hex}")
    reqs = MS.to_messages(e.withColumn("cid", F.sha2(F.col("vec_id").cast("string"), 256)), "cid", {
        "id": F.col("vec_id").cast("string"), "data": F.to_json(as_doubles("embedding"))})
    reqs.write.parquet(f"{base}/requests")
    # the model: class centroids (classes x dims values)
    w, b = H.weights_arrays(H.centroid_weights(e, "embedding", "label"))
    stream = MS.read_requests(spark, "parquet", {"maxFilesPerTrigger": "2"}, path=f"{base}/requests")
    out = score_requests(stream, w, b, aspect_scores=lambda v: F.slice(v, 1, 16))
    _await(MS.write_responses(out, "parquet", {}, f"{base}/ckpt", path=f"{base}/responses"))
    resp = spark.read.parquet(f"{base}/responses")
    parsed = MS.parse_messages(resp, MS.RESPONSE_SCHEMA)
    return parsed.select("key", "id", "prediction", "acsa")


@query("stream_trigger", f"""WITH {ORD}
SELECT CAST((rn - 1) // {N} + 1 AS BIGINT) AS trigger_id, min(o_orderkey) AS lo, max(o_orderkey) AS hi,
       CAST(count(*) AS BIGINT) AS n,
       CASE WHEN ((rn - 1) // {N} + 1) % {M} = 0 THEN 'replay' ELSE 'own' END AS kind
FROM ord WHERE rn <= (total // {N}) * {N} GROUP BY 1, 5""")
def stream_trigger_q(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    base = scratch_path(spark, f"stream-trigger-{uuid.uuid4().hex}")
    bounds = o.agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).first()
    split = (bounds["lo"] + bounds["hi"]) // 2
    schema = o.schema

    def run():
        # files of one write carry no arrival order among themselves: take each arrival whole
        src = spark.readStream.schema(schema).parquet(f"{base}/src")
        _await(stream_trigger(src, "o_orderkey", f"{base}/staging", f"{base}/ledger", f"{base}/ckpt", N, M))

    # first arrivals, one run; then the rest arrives and the stream restarts from its checkpoint
    o.where(F.col("o_orderkey") <= split).write.mode("append").parquet(f"{base}/src")
    run()
    o.where(F.col("o_orderkey") > split).write.mode("append").parquet(f"{base}/src")
    run()
    return read_ledger(spark, f"{base}/ledger").select("trigger_id", "lo", "hi", "n", "kind")


#: rows of one arrival in ``stream_paced``, and the order they come in
PACE, PACE_SEED = 2000, 7


@query("stream_paced", f"""WITH RECURSIVE arrival AS (
  SELECT o_custkey, (row_number() OVER (ORDER BY md5('{PACE_SEED}:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) // {PACE} AS mb FROM orders),
per AS (SELECT mb, list(o_custkey) AS keys FROM arrival GROUP BY mb),
run AS (
  SELECT CAST(-1 AS BIGINT) AS mb, CAST([] AS BIGINT[]) AS cut, CAST([] AS BIGINT[]) AS rest, CAST(0 AS BIGINT) AS before
  UNION ALL
  SELECT mb, pool[1:(len(pool) // {N}) * {N}], pool[(len(pool) // {N}) * {N} + 1:], before
  FROM (SELECT per.mb, list_sort(list_concat(rest, CAST(keys AS BIGINT[]))) AS pool, CAST(before + len(cut) // {N} AS BIGINT) AS before
        FROM run JOIN per ON per.mb = run.mb + 1)),
trig AS (SELECT cut, before, unnest(range(1, len(cut) // {N} + 1)) AS i FROM run)
SELECT CAST(before + i AS BIGINT) AS trigger_id, cut[(i - 1) * {N} + 1] AS lo, cut[i * {N}] AS hi, CAST({N} AS BIGINT) AS n,
       CASE WHEN (before + i) % {M} = 0 THEN 'replay' ELSE 'own' END AS kind FROM trig""")
def stream_paced_q(spark, sf):
    """Paced loading: orders arrive out of key order, many with equal keys, and are cut into triggers as they come."""
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    base = scratch_path(spark, f"stream-paced-{uuid.uuid4().hex}")
    write_arrivals(o, [seeded_hash("o_orderkey", PACE_SEED), "o_orderkey"], f"{base}/src")
    init_ledger(spark, f"{base}/ledger")
    run_paced(spark, f"{base}/src", PACE, "200 milliseconds",
              stage_and_cut("o_custkey", f"{base}/staging", f"{base}/ledger", N, M), f"{base}/ckpt",
              at_once=block_size(o.schema, PACE, N))
    return read_ledger(spark, f"{base}/ledger").select("trigger_id", "lo", "hi", "n", "kind")


@query("stream_correlate", f"""WITH {REQRESP}
SELECT req.correlation_id, config, round(date_diff('microsecond', sent_at, answered_at) / 1e6, 6) AS latency
FROM req JOIN resp ON req.correlation_id = resp.correlation_id
WHERE answered_at >= sent_at AND answered_at <= sent_at + INTERVAL 1 HOUR""")
def stream_correlate_q(spark, sf):
    base = scratch_path(spark, f"stream-correlate-{uuid.uuid4().hex}")
    req, resp = X.requests(spark, sf), X.responses(spark, sf)
    req.write.parquet(f"{base}/req")
    resp.write.parquet(f"{base}/resp")
    rs = spark.readStream.schema(req.schema).parquet(f"{base}/req")
    ss = spark.readStream.schema(resp.schema).parquet(f"{base}/resp")
    j = stream_correlate(rs, ss, max_wait="1 hour").select("correlation_id", "config", "latency")
    q = (j.writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt")
          .outputMode("append").trigger(availableNow=True).start(f"{base}/out"))
    _await(q)
    return R(spark.read.parquet(f"{base}/out"))


def online_run(spark, sf, task: str, strategy: str):
    """All full triggers of ``embeddings`` for one task, from the class centroids, evaluated on the whole table."""
    e = X.vector_rows(spark, sf).select("vec_id", "embedding", "t_class", "t_aspects")
    label, k, heads = ("t_class", 10, None) if task == "cls" else ("t_aspects", 4, 4)
    start = H.weights_arrays(H.centroid_weights(e, "embedding", label, heads))
    reg = online_learn(e, "vec_id", "embedding", label, e, k, strategy, N, M, epochs=1, lr=0.5, start=start, task=task, n_heads=heads)
    return R(reg)


def _register_online(task: str, strategy: str, name: str) -> None:
    heads, k = (1, 10) if task == "cls" else (4, 4)

    @query(name, online_sql(task, strategy, N, M, 0.5, heads, k))
    def run(spark, sf):
        return online_run(spark, sf, task, strategy)


for _strategy in ("continue", "champion", "replay"):
    _register_online("cls", _strategy, f"online_{_strategy}")
    _register_online("acsa", _strategy, f"online_aspects_{_strategy}")


@query("stream_online", online_sql("cls", "replay", N, M, 0.5, 1, 10))
def stream_online_q(spark, sf):
    """Replay strategy driven by the trigger stream, with a restart between two arrivals."""
    from kestrel.streaming.online import StreamingLearner
    e = X.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    base = scratch_path(spark, f"stream-online-{uuid.uuid4().hex}")
    start = H.weights_arrays(H.centroid_weights(e, "embedding", "label"))
    bounds = e.agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi")).first()
    split = (bounds["lo"] + bounds["hi"]) // 2

    def run():
        learner = StreamingLearner(spark, "vec_id", "embedding", "label", e, 10, "replay", M,
                                   f"{base}/staging", f"{base}/ledger", f"{base}/registry", f"{base}/store", start)
        src = spark.readStream.schema(e.schema).parquet(f"{base}/src")
        _await(stream_trigger(src, "vec_id", f"{base}/staging", f"{base}/ledger", f"{base}/ckpt", N, M,
                              on_trigger=learner))
        return learner

    e.where(F.col("vec_id") <= split).write.mode("append").parquet(f"{base}/src")
    run()
    e.where(F.col("vec_id") > split).write.mode("append").parquet(f"{base}/src")
    learner = run()
    return R(learner.registry_frame(spark))


@query("stream_score_champion", f"""WITH {_CENT}, {STORED}, {REG.replace("art AS", "art0 AS")},
best AS (SELECT version FROM reg WHERE version % 7 <> 0 ORDER BY avg_f1 DESC, version ASC LIMIT 1),
best_aspects AS (SELECT version FROM reg WHERE version % 7 <> 0 ORDER BY acc DESC, version ASC LIMIT 1)
SELECT sha256(CAST(sc.vec_id AS VARCHAR)) AS key, CAST(sc.vec_id AS VARCHAR) AS id, CAST(sc.p AS INTEGER) AS prediction,
       '[' || array_to_string(scored.p_aspects, ', ') || ']' AS acsa, (SELECT version FROM best) AS version, (SELECT version FROM best_aspects) AS aspect_version
FROM sc JOIN scored ON sc.vec_id = scored.vec_id""")
def stream_score_champion_q(spark, sf):
    """Requests scored by the best servable version of each task, re-read every micro-batch (R1 + R9).

    The aspect task's records take the other figure of the day as their F1, so
    its champion is another version.
    """
    from kestrel.sources.tables import save_weights_many
    from kestrel.streaming.scoring import champion_scorer
    e = X.vector_rows(spark, sf)
    base = scratch_path(spark, f"stream-champion-{uuid.uuid4().hex}")
    reg = X.registry(spark, sf)
    both = reg.unionByName(reg.withColumns({"task": F.lit("acsa"), "avg_f1": F.col("acc")}))
    both.write.parquet(f"{base}/registry")
    # artefacts of every version except multiples of 7; each holds the centroid heads
    # one row per registry version: a short list of literals
    versions = [r["version"] for r in X.artefacts(reg).select("version").collect()]
    of = F.explode(F.array(*[F.lit(v) for v in versions]))
    save_weights_many(H.centroid_weights(e, "embedding", "t_class").withColumn("version", of), f"{base}/store", "cls")
    save_weights_many(H.centroid_weights(e, "embedding", "t_aspects", 4).withColumn("version", of), f"{base}/store", "acsa")
    reqs = MS.to_messages(e.withColumn("cid", F.sha2(F.col("vec_id").cast("string"), 256)), "cid", {
        "id": F.col("vec_id").cast("string"), "data": F.to_json(as_doubles("embedding"))})
    reqs.write.parquet(f"{base}/requests")
    stream = MS.read_requests(spark, "parquet", {"maxFilesPerTrigger": "2"}, path=f"{base}/requests")
    q = (stream.writeStream.foreachBatch(champion_scorer(f"{base}/registry", f"{base}/store", f"{base}/out", aspect_task="acsa"))
               .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    _await(q)
    out = spark.read.parquet(f"{base}/out")
    parsed = out.select("key", "version", "aspect_version", F.from_json("value", MS.RESPONSE_SCHEMA).alias("v"))
    return parsed.select("key", "v.id", "v.prediction", "v.acsa", "version", "aspect_version")
