"""Queries: registry, champion and early stopping."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.codebook import EARLY_STOP_PATIENCE, REPLAY_EVERY
from kestrel.operators import registry as G
from kestrel.plans import fixtures as X
from kestrel.plans.catalogue import query
from kestrel.plans.sqlparts import PAIRS, REG

M = REPLAY_EVERY

_UPD = "coalesce(avg_f1 > max(avg_f1) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)"


@query("best_so_far", f"""WITH {REG}
SELECT version, avg_f1, {_UPD} AS is_update FROM reg""")
def best_so_far_q(spark, sf):
    return G.best_so_far(X.registry(spark, sf)).select("version", "avg_f1", "is_update")


@query("replay_updates", f"""WITH {REG},
u AS (SELECT version, {_UPD} AS is_update, version > 1 AND (version - 1) % {M} = 0 AS is_replay FROM reg)
SELECT version, is_update, is_replay, is_update AND is_replay AS replay_update,
       is_update AND NOT is_replay AS ordinary_update FROM u""")
def replay_updates_q(spark, sf):
    r = G.replay_updates(X.registry(spark, sf), M)
    return r.select("version", "is_update", "is_replay", "replay_update", "ordinary_update")


@query("version_sets", f"""WITH {REG},
u AS (SELECT task, version, {_UPD} AS is_update, version > 1 AND (version - 1) % {M} = 0 AS is_replay FROM reg),
upd AS (SELECT task, version FROM u WHERE is_update),
rep AS (SELECT task, version FROM u WHERE is_replay)
SELECT task, version, 'replay_update' AS kind FROM (SELECT * FROM upd INTERSECT SELECT * FROM rep)
UNION ALL SELECT task, version, 'ordinary_update' FROM (SELECT * FROM upd EXCEPT SELECT * FROM rep)
UNION ALL SELECT task, version, 'replay_no_update' FROM (SELECT * FROM rep EXCEPT SELECT * FROM upd)""")
def version_sets_q(spark, sf):
    return G.version_sets(X.registry(spark, sf), M)


@query("champion_timeline", f"""WITH {REG}
SELECT version, avg_f1, arg_max(version, (avg_f1, -version)) OVER (
  ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS champion FROM reg""")
def champion_timeline_q(spark, sf):
    return G.champion_timeline(X.registry(spark, sf)).select("version", "avg_f1", "champion")


@query("best_version", f"""WITH {REG}
SELECT version, task, acc, avg_f1, key FROM reg ORDER BY avg_f1 DESC, version ASC LIMIT 1""")
def best_version_q(spark, sf):
    return G.best_version(X.registry(spark, sf))


@query("registry_history", f"""WITH {REG}
SELECT task, CAST(count(*) AS BIGINT) AS records, arg_max(version, key) AS newest_version,
       arg_min(version, key) AS oldest_version, arg_max(version, key) + 1 AS next_version
FROM reg GROUP BY task""")
def registry_history_q(spark, sf):
    return G.registry_history(X.registry(spark, sf))


@query("registry_prune", f"""WITH {REG}
SELECT version, avg_f1, version IN (SELECT version FROM art) AS kept FROM reg""")
def registry_prune_q(spark, sf):
    reg = X.registry(spark, sf)
    kept, removed = G.registry_prune(reg, X.artefacts(reg))
    return kept.select("version", "avg_f1", F.lit(True).alias("kept")).unionByName(
        removed.select("version", "avg_f1", F.lit(False).alias("kept")))


@query("best_servable_version", f"""WITH {REG}
SELECT version, task, acc, avg_f1, key FROM reg WHERE version IN (SELECT version FROM art)
ORDER BY avg_f1 DESC, version ASC LIMIT 1""")
def best_servable_version_q(spark, sf):
    reg = X.registry(spark, sf)
    return G.best_servable_version(reg, X.artefacts(reg))


@query("upsert_latest", """WITH u AS (
  SELECT user_id, event_id, event_type, value FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-16'
  UNION ALL
  SELECT user_id, event_id, event_type, value FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-16')
SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
       arg_max(value, event_id) AS value FROM u GROUP BY user_id""")
def upsert_latest_q(spark, sf):
    ev = X.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value",
                                             F.to_date("ts").alias("d"))
    cut = F.lit("2024-01-16").cast("date")
    base = ev.where(F.col("d") < cut).drop("d")
    changes = ev.where(F.col("d") >= cut).drop("d")
    return G.upsert_latest(base, changes, "user_id", "event_id")


@query("delete_keys", """SELECT event_id, user_id FROM events
WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 10 = 0)""")
def delete_keys_q(spark, sf):
    ev = X.table(spark, sf, "events").select("event_id", "user_id")
    # keys to clear: requests that never got an answer (see fixtures.responses)
    answered = X.responses(spark, sf).select(F.col("correlation_id").alias("event_id"))
    unanswered = ev.select("event_id").join(answered, "event_id", "left_anti")
    return G.delete_keys(ev, unanswered, "event_id")


@query("early_stop", f"""WITH {REG},
e AS (SELECT version AS epoch, avg_f1 AS loss,
        coalesce(avg_f1 < min(avg_f1) OVER (ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
          AS improved FROM reg),
s AS (SELECT *, CAST(epoch - max(CASE WHEN improved THEN epoch END) OVER (
        ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS since_best FROM e)
SELECT epoch, loss, improved, since_best,
       coalesce(epoch = min(CASE WHEN since_best >= {EARLY_STOP_PATIENCE} THEN epoch END) OVER (), false) AS stop
FROM s""")
def early_stop_q(spark, sf):
    reg = X.registry(spark, sf).select(F.col("version").alias("epoch"), F.col("avg_f1").alias("loss"))
    return G.early_stop(reg, patience=EARLY_STOP_PATIENCE)


@query("latest_epoch", """SELECT regexp_extract(name, '^(.*)_(\\d+)\\.[^.]+$', 1) AS prefix,
       max(CAST(regexp_extract(name, '^(.*)_(\\d+)\\.[^.]+$', 2) AS BIGINT)) AS latest_epoch
FROM (SELECT lower(replace(p_type, ' ', '_')) || '_' || CAST(p_size AS VARCHAR) || '.pt' AS name FROM part)
WHERE regexp_extract(name, '^(.*)_(\\d+)\\.[^.]+$', 2) <> '' GROUP BY 1""")
def latest_epoch_q(spark, sf):
    p = X.table(spark, sf, "part")
    names = p.select(F.concat(F.lower(F.regexp_replace("p_type", " ", "_")), F.lit("_"),
                              F.col("p_size").cast("string"), F.lit(".pt")).alias("name"))
    return G.latest_epoch(names)


@query("sample_example", f"""WITH {PAIRS}
SELECT pair_id, array_to_string(cand, ' ') AS prediction, array_to_string(ref, ' ') AS reference FROM pairs
ORDER BY md5('42:' || pair_id), pair_id LIMIT 1""")
def sample_example_q(spark, sf):
    pairs = X.text_pairs(spark, sf).select("pair_id", F.array_join("cand", " ").alias("prediction"),
                                          F.array_join("ref", " ").alias("reference"))
    return G.sample_example(pairs, "pair_id", seed=42)

