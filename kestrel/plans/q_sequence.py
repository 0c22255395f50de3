"""Queries: triggers, replay, mini-batches and key-range scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.codebook import MINI_BATCH, REPLAY_EVERY, TRIGGER_ROWS
from kestrel.operators import sequence as S
from kestrel.plans import fixtures as X
from kestrel.plans.catalogue import query
from kestrel.plans.sqlparts import ORD

N, M = TRIGGER_ROWS, REPLAY_EVERY


@query("trigger_batches", f"""WITH {ORD}
SELECT o_orderkey, rn, CAST((rn - 1) // {N} + 1 AS BIGINT) AS batch_id FROM ord
WHERE rn <= (total // {N}) * {N}""")
def trigger_batches_q(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey")
    return S.trigger_batches(o, "o_orderkey", N).select("o_orderkey", "rn", "batch_id")


@query("trigger_replay", f"""WITH {ORD},
b AS (SELECT o_orderkey, CAST((rn - 1) // {N} + 1 AS BIGINT) AS batch_id, total // {N} AS nfull
      FROM ord WHERE rn <= (total // {N}) * {N}),
t AS (SELECT o_orderkey, batch_id, batch_id AS trigger_id FROM b
      UNION ALL
      SELECT o_orderkey, batch_id, ((batch_id - 1) // {M} + 1) * {M} FROM b
      WHERE batch_id % {M} <> 0 AND ((batch_id - 1) // {M} + 1) * {M} <= nfull)
SELECT trigger_id, o_orderkey, batch_id,
       CASE WHEN trigger_id % {M} = 0 THEN 'replay' ELSE 'own' END AS kind FROM t""")
def trigger_replay_q(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey")
    return S.trigger_replay(o, "o_orderkey", N, M).select("trigger_id", "o_orderkey", "batch_id", "kind")


@query("mini_batches", f"""SELECT o_orderkey, rn, CAST((rn - 1) // {MINI_BATCH} + 1 AS BIGINT) AS batch_id FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn
  FROM orders)""")
def mini_batches_q(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey")
    return S.mini_batches(o, "o_orderkey", MINI_BATCH, seed=42).select("o_orderkey", "rn", "batch_id")


@query("key_range_scan", f"""WITH {ORD}
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderkey > (SELECT o_orderkey FROM ord WHERE rn = {N})
  AND o_orderkey <= (SELECT max(o_orderkey) FROM orders)""")
def key_range_scan_q(spark, sf):
    o = X.table(spark, sf, "orders")
    # ledger position after the first trigger, and the newest key: two scalars
    lo = o.select("o_orderkey").orderBy("o_orderkey").limit(N).agg(F.max("o_orderkey")).first()[0]
    hi = o.agg(F.max("o_orderkey")).first()[0]
    return S.key_range(o, "o_orderkey", lo, hi).select("o_orderkey", "o_custkey", "o_totalprice")
