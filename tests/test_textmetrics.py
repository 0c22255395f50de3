"""Generation metrics against plain-Python implementations."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from kestrel.operators import textmetrics as TM


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
def test_lcs_bit_parallel_matches_dp(a, b):
    assert TM.lcs_length(a, b) == lcs_dp(a, b)


def test_lcs_long_text_is_fast():
    rnd = random.Random(3)
    a = [rnd.randrange(500) for _ in range(20000)]
    b = [x for i, x in enumerate(a) if i % 7 != 6]
    assert TM.lcs_length(b, a) == len(b)


def grams(toks, n):
    return Counter(" ".join(toks[i:i + n]) for i in range(len(toks) - n + 1))


def py_bleu(pairs, max_n=4):
    match = [0] * max_n
    poss = [0] * max_n
    c_len = r_len = 0
    for c, r in pairs:
        c_len += len(c)
        r_len += len(r)
        for n in range(1, max_n + 1):
            gc, gr = grams(c, n), grams(r, n)
            match[n - 1] += sum(min(v, gr[g]) for g, v in gc.items())
            poss[n - 1] += max(len(c) - n + 1, 0)
    p = [m / q if q else 0.0 for m, q in zip(match, poss)]
    if min(p) <= 0:
        return 0.0, p
    bp = 1.0 if c_len > r_len else math.exp(1 - r_len / c_len)
    return bp * math.exp(sum(math.log(x) for x in p) / max_n), p


def pairs_df(spark, pairs):
    return spark.createDataFrame([(str(i), c, r) for i, (c, r) in enumerate(pairs)],
                                 "pair_id string, cand array<string>, ref array<string>")


def sample_pairs(seed=5):
    rnd = random.Random(seed)
    out = []
    for _ in range(12):
        r = [rnd.choice("abcdefg") for _ in range(rnd.randrange(0, 25))]
        c = [x for i, x in enumerate(r) if i % 7 != 6] + ([rnd.choice("xyz")] if rnd.random() < 0.5 else [])
        out.append((c, r))
    out.append((["a"], []))
    return out


def test_bleu_and_precisions(spark):
    pairs = sample_pairs()
    got = TM.bleu_corpus(pairs_df(spark, pairs)).first()
    exp, p = py_bleu(pairs)
    assert got["bleu"] == pytest.approx(exp)
    assert [got[f"p{k}"] for k in range(1, 5)] == pytest.approx(p)


def test_rouge_n_per_pair(spark):
    pairs = sample_pairs(9)
    got = {r["pair_id"]: r for r in TM.rouge_n(pairs_df(spark, pairs), 2).collect()}
    for i, (c, r) in enumerate(pairs):
        gc, gr = grams(c, 2), grams(r, 2)
        ov = sum(min(v, gr[g]) for g, v in gc.items())
        p = ov / max(sum(gc.values()), 1)
        rc = ov / max(sum(gr.values()), 1)
        f = 2 * p * rc / (p + rc) if p + rc else 0.0
        assert (got[str(i)]["precision"], got[str(i)]["recall"], got[str(i)]["fmeasure"]) == pytest.approx((p, rc, f))


def test_rouge_l(spark):
    pairs = sample_pairs(11)
    got = {r["pair_id"]: r for r in TM.rouge_l(pairs_df(spark, pairs)).collect()}
    for i, (c, r) in enumerate(pairs):
        assert got[str(i)]["lcs"] == lcs_dp(c, r)


def test_greedy_match_and_mean_pool(spark):
    rnd = np.random.default_rng(0)
    vecs = rnd.normal(size=(12, 5))
    rows = [(i // 6, i % 2, [float(x) for x in vecs[i]]) for i in range(12)]
    df = spark.createDataFrame(rows, "pair_id long, side int, vec array<double>")
    got = {r["pair_id"]: r for r in TM.greedy_match(df).collect()}
    for pid in (0, 1):
        a = vecs[[i for i in range(12) if i // 6 == pid and i % 2 == 0]]
        b = vecs[[i for i in range(12) if i // 6 == pid and i % 2 == 1]]
        a = a / np.linalg.norm(a, axis=1, keepdims=True)
        b = b / np.linalg.norm(b, axis=1, keepdims=True)
        s = a @ b.T
        assert got[pid]["precision"] == pytest.approx(s.max(axis=1).mean())
        assert got[pid]["recall"] == pytest.approx(s.max(axis=0).mean())
    pooled = {r["pair_id"]: r["mean_vec"] for r in TM.mean_pool(df, "pair_id", "vec").collect()}
    assert pooled[0] == pytest.approx(list(vecs[:6].mean(axis=0)))


def test_greedy_match_blocked_equals_single_block(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for pid, (nc, nr) in enumerate([(7, 5), (1, 9), (12, 12), (3, 0)]):
        for i in range(nc + nr):
            rows.append((pid, 0 if i < nc else 1, i + 100 * pid, [float(x) for x in rnd.normal(size=4)]))
    df = spark.createDataFrame(rows, "pair_id long, side int, tid long, vec array<double>")
    one = {r["pair_id"]: r for r in TM.greedy_match(df, token_id="tid").collect()}
    many = {r["pair_id"]: r for r in TM.greedy_match(df, token_id="tid", block=2).collect()}
    assert set(one) == set(many) == {0, 1, 2, 3}
    assert (one[3]["precision"], one[3]["recall"], one[3]["f1"]) == (0, 0, 0)      # pair 3 has no reference side
    for k in one:
        assert (many[k]["precision"], many[k]["recall"], many[k]["f1"]) == \
               pytest.approx((one[k]["precision"], one[k]["recall"], one[k]["f1"]))


def brute_matches(c, r, n):
    from collections import Counter
    grams = lambda t: Counter(tuple(t[i:i + n]) for i in range(len(t or []) - n + 1))
    return sum((grams(c or []) & grams(r or [])).values())


def test_clipped_matches_against_counters(spark):
    import random
    rnd = random.Random(4)
    side = lambda: None if rnd.random() < 0.1 else [rnd.choice(["a", "b", "a b", "", None, "é"]) for _ in range(rnd.randrange(0, 30))]
    rows = [(i % 50, side(), side()) for i in range(200)] + [(0, ["x"] * 3000, ["x"] * 2000)]
    pairs = spark.createDataFrame(rows, "pair_id int, cand array<string>, ref array<string>")
    found = TM.ngram_overlap(pairs, "cand", "ref", [1, 2, 3, 4], ["pair_id", "cand", "ref"]).collect()
    assert len(found) == 4 * len(rows)
    for r in found:
        assert r["overlap"] == brute_matches(r["cand"], r["ref"], r["n"])
        assert r["cand_total"] == max(len(r["cand"] or []) - r["n"] + 1, 0)
    # repeated pair ids keep their rows
    assert TM.rouge_n(pairs, [1, 2]).count() == 2 * len(rows)
    assert TM.rouge_n(pairs.limit(0), 1).count() == 0 and TM.ngram_precision(pairs.limit(0)).count() == 0


def test_ngrams_are_not_shuffled(spark):
    pairs = spark.createDataFrame([(1, ["a"], ["a"])], "pair_id int, cand array<string>, ref array<string>")
    per_pair = TM.rouge_n(pairs, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in per_pair
    corpus = TM.ngram_precision(pairs)._jdf.queryExecution().executedPlan().toString()
    assert corpus.count("Exchange") == 1 and "partial_sum" in corpus


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 15])
def test_lcs_in_blocks(block):
    import random
    rnd = random.Random(block)
    for _ in range(40):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(0, 60))] for _ in range(2))
        assert TM.lcs_length(a, b, block) == lcs_dp(a, b)


def test_lcs_of_a_very_long_pair():
    a = [i * 7919 % 5003 for i in range(100_000)]
    b = [x for i, x in enumerate(a) if i % 7]
    assert TM.lcs_length(b, a) == len(b)


def test_corpus_mean(spark):
    pairs = spark.createDataFrame([(1, ["a", "b"], ["a"]), (2, [], []), (2, None, ["x"])], "pair_id int, cand array<string>, ref array<string>")
    r = TM.corpus_mean(TM.rouge_l(pairs)).first()
    assert r["pairs"] == 3 and r["precision"] == pytest.approx(0.5 / 3) and r["recall"] == pytest.approx(1 / 3)
