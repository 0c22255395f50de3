"""Generation metrics: corpus BLEU, ROUGE-N, ROUGE-L, greedy embedding match.

Inputs are pairs ``(pair_id, cand tokens, ref tokens)``, one per row. Clipped
n-gram matches are counted inside the row: an Arrow function numbers the
tokens of a batch, packs them to n-gram numbers order by order and intersects
the two multisets of every row at once. Nothing but matches and totals leaves
it, so per-pair scores need no shuffle and corpus scores one of a row per
order and task. ROUGE-L needs a longest common subsequence per pair; it runs
bit-parallel over blocks of the reference, whole texts included.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def clipped_matches(cand: pa.Array, ref: pa.Array, orders: list[int]) -> np.ndarray:
    """Rows x orders: how many n-grams of ``cand`` meet one of ``ref``, each at most as often as it occurs there.

    Exact: n-grams are compared by numbers that stand for their tokens. A
    null array is empty; null tokens equal each other.
    """
    rows = len(cand)
    values, lengths = [], []
    for side in (cand, ref):
        lengths.append(np.asarray(pc.fill_null(pc.list_value_length(side), 0), dtype=np.int64))
        values.append(side.flatten())
    every = pa.concat_arrays(values).dictionary_encode(null_encoding="encode").indices
    token = np.asarray(every, dtype=np.int64)
    base = int(token.max(initial=0)) + 1
    length = np.concatenate(lengths)
    row = np.repeat(np.concatenate([np.arange(rows)] * 2), length)
    is_ref = np.repeat(np.arange(2 * rows) >= rows, length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(token))  # tokens up to the end of the side
    out, gram = np.zeros((rows, len(orders)), dtype=np.int64), token
    for n in range(1, max(orders) + 1):
        if n > 1:
            gram = np.unique(gram, return_inverse=True)[1] * base  # number of the (n-1)-gram, then its next token
            gram[:len(gram) - n + 1] += token[n - 1:]
        if n in orders:
            whole = left >= n
            kind = np.unique(gram[whole], return_inverse=True)[1]
            key, at = np.unique(row[whole] * (int(kind.max(initial=0)) + 1) + kind, return_inverse=True)
            counts = [np.bincount(at[s], minlength=len(key)) for s in (~is_ref[whole], is_ref[whole])]
            of = np.zeros(len(key), dtype=np.int64)
            of[at] = row[whole]
            out[:, orders.index(n)] = np.bincount(of, weights=np.minimum(*counts), minlength=rows).astype(np.int64)
    return out


def ngram_overlap(pairs: DataFrame, cand: str, ref: str, orders: list[int], keep: list[str] = ()) -> DataFrame:
    """``keep``, and per row and order ``n, overlap, cand_total, ref_total``; no shuffle."""
    def count(c: pa.Array, r: pa.Array) -> pa.Array:
        found = clipped_matches(c, r, orders)
        return pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(orders), dtype=np.int32), pa.array(found.ravel()))

    rows = pairs.select(*keep, F.arrow_udf(count, "array<bigint>")(F.col(cand), F.col(ref)).alias("_m"),
                        *[F.coalesce(F.size(c), F.lit(0)).alias(a) for c, a in ((cand, "_c"), (ref, "_r"))])
    total = lambda c, n: F.greatest(F.col(c) - n + 1, F.lit(0)).cast("long")
    per = F.array(*[F.struct(F.lit(n).alias("n"), F.get("_m", F.lit(i)).alias("overlap"), total("_c", n).alias("cand_total"),
                             total("_r", n).alias("ref_total")) for i, n in enumerate(orders)])
    return rows.select(*keep, F.explode(per).alias("_x")).select(*keep, "_x.*")


def ngram_precision(pairs: DataFrame, cand: str = "cand", ref: str = "ref", max_n: int = 4) -> DataFrame:
    """Corpus-level clipped n-gram matches and candidate n-gram totals per order."""
    out = ngram_overlap(pairs, cand, ref, list(range(1, max_n + 1))).groupBy("n").agg(
        F.sum("overlap").alias("matches"), F.sum("cand_total").alias("possible"), F.sum("ref_total").alias("ref_possible"))
    return out.select("n", "matches", "possible", "ref_possible",
                      F.when(F.col("possible") > 0, F.col("matches") / F.col("possible"))
                       .otherwise(0.0).alias("precision"))


def bleu_corpus(pairs: DataFrame, cand: str = "cand", ref: str = "ref", max_n: int = 4) -> DataFrame:
    """Corpus BLEU with one reference and no smoothing.

    BLEU = BP * exp(mean(log p_n)); 0 when any p_n is 0.
    BP = 1 if c > r else exp(1 - r / c) (c, r = total token counts).
    """
    prec = ngram_precision(pairs, cand, ref, max_n)
    # unigram totals are the token counts of both sides
    j = prec.agg(*[F.max(F.when(F.col("n") == k, F.col("precision"))).alias(f"p{k}") for k in range(1, max_n + 1)],
                 F.max(F.when(F.col("n") == 1, F.col("possible"))).alias("c_len"),
                 F.max(F.when(F.col("n") == 1, F.col("ref_possible"))).alias("r_len"))
    ps = [F.col(f"p{k}") for k in range(1, max_n + 1)]
    any_zero = F.greatest(*[(pk <= 0).cast("int") for pk in ps]) == 1
    geo = F.exp(sum(F.log(pk) for pk in ps) / max_n)
    bp = F.when(F.col("c_len") > F.col("r_len"), F.lit(1.0)) \
          .when(F.col("c_len") == 0, F.lit(0.0)) \
          .otherwise(F.exp(1 - F.col("r_len") / F.col("c_len")))
    bleu = F.when(any_zero, F.lit(0.0)).otherwise(bp * geo)
    return j.select(bleu.alias("bleu"), *ps, bp.alias("brevity_penalty"),
                    F.when(F.col("r_len") > 0, F.col("c_len") / F.col("r_len")).alias("length_ratio"), "c_len", "r_len")


def rouge_n(pairs: DataFrame, n, cand: str = "cand", ref: str = "ref") -> DataFrame:
    """Per-pair ROUGE-N precision, recall and F-measure for one order or several.

    precision = overlap / max(cand n-grams, 1), recall = overlap / max(ref n-grams, 1),
    F = 2PR / (P + R), 0 when both are 0. Pairs without n-grams score 0.
    Several orders share one scan; the result has a column ``n``. One row per
    pair row and order.
    """
    j = ngram_overlap(pairs, cand, ref, [n] if isinstance(n, int) else list(n), ["pair_id"])
    p = F.col("overlap") / F.greatest(F.col("cand_total"), F.lit(1))
    r = F.col("overlap") / F.greatest(F.col("ref_total"), F.lit(1))
    s = j.select("pair_id", "n", p.alias("precision"), r.alias("recall"))
    return s.withColumn("fmeasure", F.when(F.col("precision") + F.col("recall") > 0,
                                           2 * F.col("precision") * F.col("recall")
                                           / (F.col("precision") + F.col("recall"))).otherwise(0.0))


#: positions of the reference in one block of the LCS
LCS_BLOCK = 1 << 15


def lcs_length(a: list, b: list, block: int = LCS_BLOCK) -> int:
    """Length of the longest common subsequence (bit-parallel, Hyyrö 2004, in blocks).

    Bits of ``v`` stand for positions of ``b``. Blocks of ``b`` are taken one
    after the other, each over all of ``a``; what the addition carries out of
    a block at a token of ``a`` is handed to the next block at that token. So
    a step works on ``block`` bits, memory is a block and a byte per token of
    ``a``, and tokens that a block does not hold are passed over.
    """
    if not a or not b:
        return 0
    carry, common = bytearray(len(a)), 0
    for start in range(0, len(b), block):
        part = b[start:start + block]
        m = len(part)
        masks: dict = {}
        for j, tok in enumerate(part):
            masks[tok] = masks.get(tok, 0) | (1 << j)
        full = (1 << m) - 1
        v = full
        for i, tok in enumerate(a):
            u, c = masks.get(tok, 0), carry[i]
            if not u and not c:
                continue
            u &= v
            s = v + u + c
            carry[i] = s >> m
            v = (s & full) | (v - u)
        common += m - v.bit_count()
    return common


@F.pandas_udf(LongType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x) if x is not None else [], list(y) if y is not None else [])
                      for x, y in zip(a, b)], dtype="int64")


def rouge_l(pairs: DataFrame, cand: str = "cand", ref: str = "ref") -> DataFrame:
    """Per-pair ROUGE-L precision, recall and F-measure from the LCS length."""
    j = pairs.select("pair_id", F.size(cand).alias("cn"), F.size(ref).alias("rn"),
                     lcs_udf(F.col(cand), F.col(ref)).alias("lcs"))
    p = F.when(F.col("cn") > 0, F.col("lcs") / F.col("cn")).otherwise(0.0)
    r = F.when(F.col("rn") > 0, F.col("lcs") / F.col("rn")).otherwise(0.0)
    s = j.select("pair_id", "lcs", p.alias("precision"), r.alias("recall"))
    return s.withColumn("fmeasure", F.when(F.col("precision") + F.col("recall") > 0,
                                           2 * F.col("precision") * F.col("recall")
                                           / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def corpus_mean(scores: DataFrame, by: list[str] = (), cols: list[str] = ("precision", "recall", "fmeasure")) -> DataFrame:
    """Corpus score: the mean over all pairs, and how many there are."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), *[F.avg(c).alias(c) for c in cols])


def greedy_match(tokens: DataFrame, pair: str = "pair_id", side: str = "side", vec: str = "vec",
                 cand_side=0, token_id: str | None = None, block: int = 2048) -> DataFrame:
    """Embedding greedy match per pair (BERTScore shape) over given token vectors.

    For every candidate token, the best cosine against the reference tokens
    of its pair (precision), and the reverse (recall); F1 = 2PR / (P + R).

    The similarity matrix of a pair is cut into blocks of at most ``block``
    tokens per side: a pair with ``nc`` candidate and ``nr`` reference
    tokens becomes ``ceil(nc/block) x ceil(nr/block)`` groups, each holding
    one candidate block and one reference block and computing their product
    in numpy. Each group emits one partial maximum per token (no pair rows);
    a max per token and a mean per pair finish the job. A normal sentence
    pair is a single group; a pair holding a large share of all tokens is
    spread over many tasks instead of landing in one.
    """
    t = tokens.select(pair, F.col(side).alias("_side"), F.col(vec).alias("_vec"),
                      (F.col(token_id) if token_id else F.monotonically_increasing_id()).alias("_tid"))
    is_c = F.col("_side") == F.lit(cand_side)
    sizes = t.groupBy(pair).agg(F.sum(is_c.cast("long")).alias("_nc"), F.sum((~is_c).cast("long")).alias("_nr"))
    pairs = sizes.select(pair)
    sizes = sizes.where((F.col("_nc") > 0) & (F.col("_nr") > 0)).select(
        pair, F.ceil(F.col("_nc") / block).alias("_sc"), F.ceil(F.col("_nr") / block).alias("_sr"))
    # a skewed pair is one key on the token side only: AQE splits that join partition
    j = t.join(sizes, pair, "inner")
    own = F.pmod(F.xxhash64("_tid"), F.when(is_c, F.col("_sc")).otherwise(F.col("_sr")))
    other = F.sequence(F.lit(0), F.when(is_c, F.col("_sr")).otherwise(F.col("_sc")) - 1)
    placed = j.select(pair, "_side", "_vec", "_tid", own.alias("_own"), F.explode(other).alias("_other"))
    placed = placed.select(pair, "_side", "_vec", "_tid",
                           F.when(is_c, F.col("_own")).otherwise(F.col("_other")).alias("_cb"),
                           F.when(is_c, F.col("_other")).otherwise(F.col("_own")).alias("_rb"))

    def block_max(g: pd.DataFrame) -> pd.DataFrame:
        c = (g["_side"] == cand_side).to_numpy()
        if c.all() or not c.any():
            return pd.DataFrame({pair: [], "_side": [], "_tid": [], "_best": []})
        m = np.stack([np.asarray(x, dtype=np.float64) for x in g["_vec"]])
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        sim = m[c] @ m[~c].T
        return pd.DataFrame({pair: g[pair].iloc[0], "_side": np.concatenate([g["_side"][c], g["_side"][~c]]),
                             "_tid": np.concatenate([g["_tid"][c], g["_tid"][~c]]),
                             "_best": np.concatenate([sim.max(axis=1), sim.max(axis=0)])})

    key_type = tokens.schema[pair].dataType.simpleString()
    side_type = tokens.schema[side].dataType.simpleString()
    partial = placed.groupBy(pair, "_cb", "_rb").applyInPandas(
        block_max, f"{pair} {key_type}, _side {side_type}, _tid long, _best double")
    best = partial.groupBy(pair, "_side", "_tid").agg(F.max("_best").alias("_best"))
    per = best.groupBy(pair).agg(
        F.avg(F.when(F.col("_side") == F.lit(cand_side), F.col("_best"))).alias("precision"),
        F.avg(F.when(F.col("_side") != F.lit(cand_side), F.col("_best"))).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    # a pair with an empty side matches nothing
    per = pairs.join(per, pair, "left").na.fill(0.0, ["precision", "recall"])
    return per.withColumn("f1", F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0))


def mean_pool(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean vector per key: ``posexplode`` + ``avg`` by (key, position).

    Partial aggregation keeps a key with many rows from landing in one task;
    the per-key result is re-assembled from ``dims`` values only.
    """
    long = df.select(key, F.posexplode(F.col(vec).cast("array<double>")).alias("dim", "x"))
    per = long.groupBy(key, "dim").agg(F.avg("x").alias("x"))
    return per.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean_vec"))
