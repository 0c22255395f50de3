"""Exact top-k inner products by MaxScore over shards of postings.

Vectors are integer: floor(256 x) of each component. A dimension is a term.
Inside a shard the contribution q_j x_j of a term lies between two bounds;
measured from the lower one it is a non-negative impact, and the shard's
candidates with an impact above 0 form the term's postings. Terms ordered by
impact bound split at the running threshold: candidates that occur in
non-essential terms only cannot reach the top k. Essential postings are
traversed, the other terms are probed while a candidate stays competitive.
The shards' best are merged into the exact result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 5
SHARD = 2048  # candidates in a shard
BLOCK = 1024  # queries that meet a shard together
PROBED = 8  # terms probed between two cuts


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): integer vectors; rows with a null id, vector or component, or a non-finite one, are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(
        "x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.select(F.col("vec_id").cast("long"), F.col("embedding"), x.alias("x")).where(usable)
            .select("vec_id", F.transform("x", lambda c: F.floor(c * 256).cast("long")).alias("v")))


def padded(rows: pd.Series) -> np.ndarray:
    """Integer matrix of the vectors; shorter ones end in zeros."""
    sizes = rows.map(len).to_numpy()
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        return np.stack(rows.to_list()).astype(np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


class Shard:
    """Candidates with postings per term."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.high, self.low = self.x.max(axis=0), self.x.min(axis=0)
        self.columns = np.ascontiguousarray(self.x.T)
        self.above, self.below = self.columns > self.low[:, None], self.columns < self.high[:, None]

    def search(self, query: int, q: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best, equal scores by smaller id."""
        a, b = q * self.low, q * self.high
        base, impact = int(np.minimum(a, b).sum()), np.abs(b - a)
        own = self.ids == query
        seeds = np.flatnonzero(~own)[:4 * top]
        if not len(seeds):
            return self.ids[:0], self.ids[:0]
        first = np.sort(self.x[seeds] @ q)[::-1]
        need = int(first[top - 1]) if len(first) >= top else None
        terms = np.argsort(-impact, kind="stable")
        left = np.append(np.cumsum(impact[terms][::-1])[::-1], 0)  # bound of the terms from here on
        # non-essential: the terms behind the split cannot lift a candidate to the threshold
        split = len(terms) if need is None else int(np.argmax(base + left < need)) if (base + left < need).any() else len(terms)
        essential = terms[:split]
        occurs = ~own
        if split < len(terms):
            hit = np.zeros(len(own), bool)
            for j in essential:
                hit |= self.above[j] if q[j] > 0 else self.below[j] if q[j] < 0 else False
                if hit.all():
                    break
            occurs &= hit
        alive = np.flatnonzero(occurs)
        low = np.minimum(a, b)
        score = q[essential[:PROBED]] @ self.columns[essential[:PROBED]][:, alive]
        done = len(essential[:PROBED])
        while True:
            if need is not None:
                rest = int(left[done]) + int(low[terms[done:]].sum())
                stay = score + rest >= need
                alive, score = alive[stay], score[stay]
            if done >= len(terms):
                break
            part = terms[done:done + PROBED]
            score = score + q[part] @ self.columns[part][:, alive]
            done += len(part)
            if need is not None and len(score) >= top:
                need = max(need, int(np.partition(score, -top)[-top]) + int(low[terms[done:]].sum()))
        order = np.lexsort((self.ids[alive], -score))[:top]
        return self.ids[alive][order], score[order]


def top_k(vectors: DataFrame, every: int = 50, top: int = TOP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` best candidates of every row whose vec_id is divisible by ``every``.

    Candidates are all rows but those with the query's own id; fewer give
    fewer results. Ties go to the smaller id. Vectors that are null or hold
    null or non-finite components take no part; shorter vectors count as
    ending in zeros. Rows with equal ids are candidates each; queries with
    equal ids are one query (the first vector in value order).
    """
    rows = quantised(vectors)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q"),
                    F.max(F.size("v")).alias("d")).first()
    shards, blocks = max(1, -(-size["n"] // shard)), max(1, -(-size["q"] // block))
    width = size["d"] or 0
    # every block of queries meets every shard once
    held = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")

    def fit(x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, width - x.shape[1])))

    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            own = Shard(candidates["vec_id"].to_numpy(), fit(padded(candidates["v"])))
            for query, q in zip(queries["vec_id"].tolist(), fit(padded(queries["v"]))):
                ids, scores = own.search(query, q, top)
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    best = held.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInPandas(
        search, "query_id long, vec_id long, score long")
    order = F.struct((-F.col("score")).alias("s"), F.col("vec_id"))
    # the shards' best of a query: top * shards rows at most
    merged = best.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(order)), 1, top).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
