"""Queries: generation metrics (A16-A19) and pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import textmetrics as TM
from kestrel.operators.metrics import round_cols as R
from kestrel.plans import fixtures as X
from kestrel.plans.catalogue import query
from kestrel.plans.sqlparts import PAIRS

_GRAMS = PAIRS + """,
po AS (SELECT pair_id, cand, ref, unnest([1, 2, 3, 4]) AS n FROM pairs),
g AS (
  SELECT pair_id, n, 'c' AS side, unnest(list_transform(range(1, len(cand) - n + 2),
         lambda i: array_to_string(cand[i:i + n - 1], ' '))) AS gram
  FROM po WHERE len(cand) >= n
  UNION ALL
  SELECT pair_id, n, 'r', unnest(list_transform(range(1, len(ref) - n + 2),
         lambda i: array_to_string(ref[i:i + n - 1], ' ')))
  FROM po WHERE len(ref) >= n),
gc AS (SELECT pair_id, n, gram, count(*) FILTER (WHERE side = 'c') AS c,
              count(*) FILTER (WHERE side = 'r') AS r FROM g GROUP BY pair_id, n, gram),
tot AS (SELECT n, CAST(sum(greatest(len(cand) - n + 1, 0)) AS BIGINT) AS possible,
               CAST(sum(greatest(len(ref) - n + 1, 0)) AS BIGINT) AS ref_possible
        FROM po GROUP BY n),
mt AS (SELECT n, CAST(sum(least(c, r)) AS BIGINT) AS matches FROM gc GROUP BY n),
prec AS (SELECT CAST(tot.n AS INTEGER) AS n, coalesce(matches, 0) AS matches, possible, ref_possible,
                CASE WHEN possible > 0 THEN coalesce(matches, 0) / possible ELSE 0 END AS precision
         FROM tot LEFT JOIN mt ON tot.n = mt.n)"""


@query("ngram_precision", f"""WITH {_GRAMS}
SELECT n, matches, possible, ref_possible, round(precision, 6) AS precision FROM prec""")
def ngram_precision_q(spark, sf):
    return R(TM.ngram_precision(X.text_pairs(spark, sf)))


@query("bleu_corpus", f"""WITH {_GRAMS},
w AS (SELECT max(precision) FILTER (WHERE n = 1) AS p1, max(precision) FILTER (WHERE n = 2) AS p2,
             max(precision) FILTER (WHERE n = 3) AS p3, max(precision) FILTER (WHERE n = 4) AS p4,
             max(possible) FILTER (WHERE n = 1) AS c_len, max(ref_possible) FILTER (WHERE n = 1) AS r_len
      FROM prec),
b AS (SELECT *, CASE WHEN c_len > r_len THEN 1.0 WHEN c_len = 0 THEN 0.0 ELSE exp(1 - r_len / c_len) END AS bp
      FROM w)
SELECT round(CASE WHEN least(p1, p2, p3, p4) <= 0 THEN 0.0
                  ELSE bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) END, 6) AS bleu,
       round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4,
       round(bp, 6) AS brevity_penalty, round(c_len / r_len, 6) AS length_ratio, c_len, r_len FROM b""")
def bleu_corpus_q(spark, sf):
    return R(TM.bleu_corpus(X.text_pairs(spark, sf)))


_ROUGE_PAIRS = _GRAMS + """,
ov AS (SELECT pair_id, n, CAST(sum(least(c, r)) AS BIGINT) AS overlap FROM gc GROUP BY pair_id, n),
pp AS (SELECT o.pair_id, CAST(o.n AS INTEGER) AS n, coalesce(ov.overlap, 0) / greatest(len(o.cand) - o.n + 1, 1) AS precision,
              coalesce(ov.overlap, 0) / greatest(len(o.ref) - o.n + 1, 1) AS recall
       FROM po o LEFT JOIN ov ON ov.pair_id = o.pair_id AND ov.n = o.n WHERE o.n <= 2),
pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                      ELSE 0 END AS fmeasure FROM pp)"""


def _rouge_pairs(spark, sf):
    return TM.rouge_n(X.text_pairs(spark, sf), [1, 2])


@query("rouge_n", f"""WITH {_ROUGE_PAIRS}
SELECT n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(fmeasure), 6) AS fmeasure FROM pf GROUP BY n""")
def rouge_n_q(spark, sf):
    return R(_rouge_pairs(spark, sf).groupBy("n").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("fmeasure").alias("fmeasure")))


@query("rouge_n_pairs", f"""WITH {_ROUGE_PAIRS}
SELECT pair_id, n, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(fmeasure, 6) AS fmeasure FROM pf""")
def rouge_n_pairs_q(spark, sf):
    return R(_rouge_pairs(spark, sf))


def _lcs(source: str) -> str:
    """CTEs up to ``lf(pair_id, lcs, precision, recall, fmeasure)``: a row of the LCS table per step, all pairs at once."""
    return f"""lt AS (SELECT pair_id, cand, ref, len(cand) AS cn, len(ref) AS rn, row_number() OVER () AS k FROM {source}),
lc AS (SELECT k, unnest(range(1, cn + 1)) AS i, unnest(cand) AS tok FROM lt),
lr AS (SELECT k, unnest(range(1, rn + 1)) AS j, unnest(ref) AS tok FROM lt),
dp AS (
  SELECT 0::BIGINT AS i, k, j, tok, 0::BIGINT AS v FROM lr
  UNION ALL
  SELECT i, k, j, tok, max(x) OVER (PARTITION BY k ORDER BY j) FROM (
    SELECT dp.i + 1 AS i, dp.k, dp.j, dp.tok,
           greatest(v, lag(v, 1, 0) OVER (PARTITION BY dp.k ORDER BY j) + CASE WHEN lc.tok = dp.tok THEN 1 ELSE 0 END) AS x
    FROM dp JOIN lc ON lc.k = dp.k AND lc.i = dp.i + 1)),
ll AS (SELECT pair_id, cn, rn, coalesce(dp.v, 0) AS lcs FROM lt LEFT JOIN dp ON dp.k = lt.k AND dp.i = cn AND dp.j = rn),
lp0 AS (SELECT pair_id, lcs, CASE WHEN cn > 0 THEN lcs / cn ELSE 0 END AS precision, CASE WHEN rn > 0 THEN lcs / rn ELSE 0 END AS recall FROM ll),
lf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS fmeasure FROM lp0)"""


_LF = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(fmeasure, 6) AS fmeasure"


@query("rouge_l", f"""WITH RECURSIVE {PAIRS}, {_lcs("pairs")}
SELECT pair_id, lcs, {_LF} FROM lf""")
def rouge_l_q(spark, sf):
    return R(TM.rouge_l(X.text_pairs(spark, sf)))


@query("rouge_l_corpus", f"""WITH RECURSIVE {PAIRS}, {_lcs("pairs")}
SELECT count(*) AS pairs, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(fmeasure), 6) AS fmeasure FROM lf""")
def rouge_l_corpus_q(spark, sf):
    return R(TM.corpus_mean(TM.rouge_l(X.text_pairs(spark, sf))))


_EMB = """tok AS (SELECT vec_id, vec_id // 10 AS pair_id, vec_id % 2 AS side, CAST(embedding AS DOUBLE[]) AS v
                 FROM embeddings)"""


_MATCH = f"""WITH {_EMB},
sim AS (SELECT c.pair_id, c.vec_id AS cid, r.vec_id AS rid, list_cosine_similarity(c.v, r.v) AS s
        FROM tok c JOIN tok r ON c.pair_id = r.pair_id AND c.side = 0 AND r.side = 1),
p AS (SELECT pair_id, avg(m) AS precision FROM (SELECT pair_id, cid, max(s) AS m FROM sim GROUP BY pair_id, cid)
      GROUP BY pair_id),
r AS (SELECT pair_id, avg(m) AS recall FROM (SELECT pair_id, rid, max(s) AS m FROM sim GROUP BY pair_id, rid)
      GROUP BY pair_id)"""


@query("greedy_match", f"""{_MATCH}
SELECT p.pair_id, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1
FROM p JOIN r ON p.pair_id = r.pair_id""")
def greedy_match_q(spark, sf):
    return R(_matched(spark, sf))


@query("greedy_match_corpus", f"""{_MATCH},
m AS (SELECT coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall FROM (SELECT DISTINCT pair_id FROM tok) LEFT JOIN p USING (pair_id) LEFT JOIN r USING (pair_id))
SELECT count(*) AS pairs, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END), 6) AS f1 FROM m""")
def greedy_match_corpus_q(spark, sf):
    return R(TM.corpus_mean(_matched(spark, sf), cols=["precision", "recall", "f1"]))


def _matched(spark, sf):
    e = X.table(spark, sf, "embeddings")
    toks = e.select((F.col("vec_id") / 10).cast("long").alias("pair_id"),
                    (F.col("vec_id") % 2).cast("int").alias("side"), F.col("embedding").alias("vec"), "vec_id")
    return TM.greedy_match(toks, "pair_id", "side", "vec", token_id="vec_id")


@query("mean_pool", """SELECT pair_id, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS x FROM (
  SELECT vec_id // 10 AS pair_id, unnest(generate_series(0, len(embedding) - 1)) AS dim,
         unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY pair_id, dim""")
def mean_pool_q(spark, sf):
    e = X.table(spark, sf, "embeddings").select((F.col("vec_id") / 10).cast("long").alias("pair_id"), "embedding")
    pooled = TM.mean_pool(e, "pair_id", "embedding")
    return pooled.select("pair_id", F.posexplode("mean_vec").alias("dim", "x")) \
                 .select("pair_id", F.col("dim").cast("int"), F.round("x", 6).alias("x"))


_LIB = """lp AS (
  SELECT pair_id,
    list_filter(string_split(regexp_replace(lower(array_to_string(cand, ' ')), '[^a-z0-9]+', ' ', 'g'), ' '),
                lambda x: x <> '') AS cand,
    list_filter(string_split(regexp_replace(lower(array_to_string(ref, ' ')), '[^a-z0-9]+', ' ', 'g'), ' '),
                lambda x: x <> '') AS ref
  FROM pairs)"""


def _library_token_pairs(spark, sf):
    from kestrel.functions.text import rouge_tokens
    p = X.text_pairs(spark, sf)
    return p.select("pair_id", rouge_tokens(F.array_join("cand", " ")).alias("cand"),
                    rouge_tokens(F.array_join("ref", " ")).alias("ref"))


@query("rouge_n_library_tokens", f"""WITH {PAIRS}, {_LIB},
po AS (SELECT pair_id, cand, ref, unnest([1, 2]) AS n FROM lp),
g AS (
  SELECT pair_id, n, 'c' AS side, unnest(list_transform(range(1, len(cand) - n + 2),
         lambda i: array_to_string(cand[i:i + n - 1], ' '))) AS gram FROM po WHERE len(cand) >= n
  UNION ALL
  SELECT pair_id, n, 'r', unnest(list_transform(range(1, len(ref) - n + 2),
         lambda i: array_to_string(ref[i:i + n - 1], ' '))) FROM po WHERE len(ref) >= n),
gc AS (SELECT pair_id, n, gram, count(*) FILTER (WHERE side = 'c') AS c,
              count(*) FILTER (WHERE side = 'r') AS r FROM g GROUP BY pair_id, n, gram),
ov AS (SELECT pair_id, n, sum(least(c, r)) AS overlap FROM gc GROUP BY pair_id, n),
pp AS (SELECT o.pair_id, o.n, coalesce(ov.overlap, 0) / greatest(len(o.cand) - o.n + 1, 1) AS precision,
              coalesce(ov.overlap, 0) / greatest(len(o.ref) - o.n + 1, 1) AS recall
       FROM po o LEFT JOIN ov ON ov.pair_id = o.pair_id AND ov.n = o.n),
pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                      ELSE 0 END AS fmeasure FROM pp)
SELECT CAST(n AS INTEGER) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(fmeasure), 6) AS fmeasure FROM pf GROUP BY n""")
def rouge_n_library_tokens_q(spark, sf):
    """ROUGE-1/2 on the ROUGE scorer's default tokens (ASCII letters and digits only)."""
    per = TM.rouge_n(_library_token_pairs(spark, sf), [1, 2])
    return R(per.groupBy("n").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                  F.avg("fmeasure").alias("fmeasure")))


@query("rouge_l_library_tokens", f"""WITH RECURSIVE {PAIRS}, {_LIB}, {_lcs("lp")}
SELECT pair_id, lcs, {_LF} FROM lf""")
def rouge_l_library_tokens_q(spark, sf):
    """ROUGE-L per pair on the ROUGE scorer's default tokens."""
    return R(TM.rouge_l(_library_token_pairs(spark, sf)))
