"""Phrase collocations, adaptive quality rules and whitening, against plain brute force."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import collocations, common, quality, whitening

SCHEMA = "doc_id long, text string, lang string, source string, f long, n long, size int, shard string, word string, k_0 int, bare string, kept int, failed int, level int, x int"
EXTRA = (1, 2, 3, "s", "w", 4, "b", 5, 6, 7, 8)
TEXT = "the red fox saw the red fox. A red fox, the red\tfox! New York City is New York city\nnew york city; the red"
ODD = [(1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (2, None, "en", None), (3, "", None, "a"), (None, TEXT.upper() + " É É É", None, None), (4, " \t\n\x0b. ;", "fr", "a"),
       (5, "word " * 5000, "en", "b"), (6, "x." * 3000, "und", "b"), (7, "\U0001f600 ▁ 힣 " * 40, "fr", "b"), (8, "a\x00b c\x1fd " * 30, "fr", "b"), (None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([r + EXTRA for r in ODD], SCHEMA)


# phrase collocations


def brute_phrases(rows, depth=3, least=10, cover=50, top=2000):
    """rows: (lang, text)."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang or "und"] += len(w)
            for k in range(1, depth + 1):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        rank = []
        for p, a in frequent.items():
            if 100 * inside[p] >= cover * a:
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rank)[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize(("depth", "least", "cover", "top", "size"), [(3, 2, 50, 2000, 2_000_000), (3, 2, 101, 3, 40), (2, 1, 50, 5, 7), (4, 2, 60, 2000, 100), (5, 3, 50, 2000, 1)])
def test_phrases_of_odd_rows(odd, depth, least, cover, top, size):
    got = found(collocations.collocations(odd, depth=depth, least=least, cover=cover, top=top, size=size))
    assert got == brute_phrases([(r[2], r[1]) for r in ODD], depth, least, cover, top) and got


def test_phrases_of_an_empty_table(odd):
    assert found(collocations.collocations(odd.limit(0))) == []
    assert found(collocations.collocations(odd.where("text is null"))) == []


def test_phrases_do_not_follow_the_partitioning(spark, odd):
    docs = spark.createDataFrame([(f"{'ab'[i % 2]} {'cd'[i % 3 % 2]} e f. {'g ' * (i % 5)}", "xy"[i % 2]) for i in range(300)], "text string, lang string")
    whole = [found(collocations.collocations(docs.repartition(k), size=size)) for k, size in ((1, 10_000), (7, 50))]
    assert whole[0] == whole[1] == brute_phrases([(r["lang"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("base", [3, 3_000_000])
def test_index_lists_every_phrase_with_its_count(base):
    """Numbers too wide for one sort key go through ranks."""
    rng = np.random.default_rng(base)
    text = rng.integers(0, 4, 400) * (base // 3)
    text[0] = text[-1] = 0
    want = Counter(tuple(text[i:i + k].tolist()) for k in (2, 3, 4, 5) for i in range(len(text) - k + 1) if (text[i:i + k] > 0).all())
    got = {tuple(p): c for found, n in collocations.phrases(text.astype(np.int32), 5) for p, c in zip(found.tolist(), n.tolist(), strict=True)}
    assert got == want


def test_hot_language_is_ranked_in_parts(spark, odd):
    plan = collocations.collocations(odd, least=2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "salt" in plan


# quality rules


def brute_counts(text):
    text = text or ""
    w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^ \t\n\x0b\x0c\r]", x)]
    windows, inside = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i:i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), len(lines)


def brute_fences(values, low, least):
    def bucket(v):
        shift = max(v.bit_length() - 7, 0)
        return v >> shift << shift

    v = sorted(map(bucket, values))
    lo, mid, hi = (v[max(-(-len(v) * q // 100), 1) - 1] for q in (10, 50, 90))
    return (lo - 3 * max(mid - lo, least) if low else -1), hi + 3 * max(hi - mid, least)


def brute_rules(rows, enough=100):
    """rows: (lang, source, text); returns (counts, base_failed, kept) per row."""
    out = []
    for lang, source, text in rows:
        n, chars, symbols, dup, repeat, lines = brute_counts(text)
        rates = {"symbol_rate": 1000 * symbols // max(chars, 1) if chars else 0, "dup_line_rate": 1000 * dup // lines if lines else 0,
                 "repeat_rate": 1000 * repeat // n if n else 0, "word_length": 1000 * chars // n if n else 0}
        out.append([lang, source, (n, chars, symbols, dup, repeat), rates, n < 50 or 100 * repeat > 50 * n])
    groups = defaultdict(list)
    for lang, source, _, rates, failed in out:
        if not failed:
            for g in {("s", lang, source), ("l", lang), ("a",)}:
                groups[g].append(rates)
    done = []
    for lang, source, counts, rates, failed in out:
        group = next((groups[g] for g in (("s", lang, source), ("l", lang), ("a",)) if len(groups[g]) >= enough), None)
        bad = False
        for r, (least, low) in quality.RATES.items():
            if group:
                lo, hi = brute_fences([x[r] for x in group], low, least)
                bad |= not lo <= rates[r] <= hi
        done.append((counts, failed, not failed and not bad))
    return done


def counted(r):
    return (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]), r["base_failed"], r["kept"]


def test_rules_on_odd_rows(odd, monkeypatch):
    monkeypatch.setattr(quality, "ENOUGH", 2)
    got = quality.judge(odd, keep=("doc_id", "kept", "text", "failed"))
    assert got.columns[:4] == ["doc_id", "kept_", "text", "failed_"] and len(set(got.columns)) == len(got.columns)
    assert Counter(counted(r) for r in got.collect()) == Counter(brute_rules([(r[2], r[3], r[1]) for r in ODD], 2))
    assert quality.judge(odd.limit(0)).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns


def test_rules_follow_each_source(spark):
    """What is common in one source is an outlier in another, and small groups take the language's fences."""
    rng, rows = np.random.default_rng(5), []
    for i in range(900):
        source = ("plain", "tables", f"small{i % 40}")[0 if i % 3 == 0 else 1 if i % 3 == 1 else 2]
        words = [f"w{rng.integers(1, 4000)}" for _ in range(60)]
        if source == "tables" or i % 60 == 0:
            words = [w + " |" if j % 2 else w for j, w in enumerate(words)]
        rows.append((i, "\n".join(" ".join(words[j:j + 9]) for j in range(0, 60, 9)), ("en", None)[i % 2], source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    want = brute_rules([(r[2], r[3], r[1]) for r in rows])
    assert [counted(got[i]) for i in range(900)] == want
    assert all(r["kept"] for i, r in got.items() if rows[i][3] == "tables")
    assert not any(got[i]["kept"] for i in range(900) if rows[i][3] == "plain" and i % 60 == 0)
    assert {r["level"] for r in got.values()} == {"source", "lang"}


def test_sketches_merge_to_the_sketch_of_all(spark):
    rows = spark.range(5000).select(*[(F.col("id") * 7919 % 100_003).alias(r) for r in quality.RATES], (F.col("id") % 3).cast("string").alias("lang"), (F.col("id") % 5).cast("string").alias("source"))
    parts = quality.merge(quality.merge(quality.sketch(rows.where("id % 2 = 0")).union(quality.sketch(rows.where("id % 2 = 1"))), "lang"))
    one = quality.merge(quality.sketch(rows.withColumns({"lang": F.lit("x"), "source": F.lit("y")})))
    assert sorted(parts.collect()) == sorted(one.collect())
    exact = sorted(i * 7919 % 100_003 for i in range(5000))
    for r in quality.quantiles(one).collect():
        for name, q in (("low", 0.1), ("middle", 0.5), ("high", 0.9)):
            true = exact[int(np.ceil(5000 * q)) - 1]
            assert true * (1 - 2.0 ** (1 - quality.BITS)) <= r[name] <= true


def test_rules_run_no_python(odd):
    plan = quality.measure(odd)._jdf.queryExecution().toString() + quality.judge(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "NestedLoop" not in plan and "Cartesian" not in plan


# whitening


def exact(x):
    u = np.unique(x, axis=0)
    n, total = len(u), u.sum(0)
    c = u - total / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    return n, total, e[::-1], q[:, ::-1], np.trace(v)


def vectors(spark, x):
    return spark.createDataFrame([(i, [v / 256 for v in r]) for i, r in enumerate(np.asarray(x).tolist())], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("seed", [1, 2])
def test_whitening(spark, seed):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((300, 9)) * np.array([90, 70, 50, 30, 9, 8, 7, 6, 5]) + 40).astype(int)
    x = np.vstack([x, x[:50], x[:1].repeat(200, 0)])  # repeated rows count once in the fit
    n, total, e, q, trace = exact(x)
    got = whitening.whiten(vectors(spark, x)).toPandas()
    assert len(got) == 4 * len(x) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-12
    want = (x - total / n) @ q[:, :4] / np.sqrt(e[:4])
    mine = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((mine * want).sum(0))
    assert np.abs(mine - want * sign).max() < 1e-10
    assert np.allclose(got.groupby("component")["explained"].first(), e[:4] / trace, rtol=1e-12)
    assert got.groupby("vec_id")["deviation"].first().tolist() == ((n * x - total) ** 2).sum(1).tolist()


CASES = {
    "few directions": (np.random.default_rng(3).integers(-3, 4, (60, 2)) @ np.random.default_rng(4).integers(-3, 4, (2, 7)), 2),
    "equal deviations": (np.vstack([np.eye(6), -np.eye(6)]).astype(int) * 5, 4),
    "two rows": ([[1, 2, 3], [4, 5, 9]], 1),
    "one dimension": ([[1], [2], [9], [9]], 1),
    "one distinct row": ([[1, 2, 3]] * 5, 0),
    "past 63 bits": (np.random.default_rng(5).integers(-2**40, 2**40, (5, 3)), 3),
}


@pytest.mark.parametrize("name", CASES)
def test_whitening_of_odd_spectra(spark, name):
    x, directions = np.asarray(CASES[name][0]), CASES[name][1]
    got = whitening.whiten(vectors(spark, x)).toPandas()
    assert len(got) == directions * len(x)
    if directions:
        n, total, e, _, trace = exact(x)
        assert np.allclose(got.groupby("component")["explained"].first(), e[:directions] / trace, rtol=1e-9) and got["identity_error"].max() < 1e-9
        want = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(r, x[np.unique(x, axis=0, return_index=True)[1]].sum(0), strict=True)) for r in x]
        assert got.groupby("vec_id")["deviation"].first().dropna().tolist() == [d for d in want if d < 1 << 63]


def test_whitening_leaves_out_what_is_no_vector(spark):
    rows = [(1, [0.1, 0.2], 1), (2, None, 1), (3, [None, 0.1], 1), (4, [float("nan"), 0.0], 1), (5, [float("inf"), 0.0], 1), (6, [], 1), (7, [0.5, 0.1, 0.3], 1), (None, [-0.0, 0.9], 1), (8, [0.3, 0.3], 1), (8, [0.3, 0.3], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    got = whitening.whiten(df, keep=("vec_id", "n")).toPandas()
    assert got.columns.tolist()[:2] == ["vec_id", "n_"] and Counter(got["vec_id"].fillna(-1)) == {1: 2, 8: 4, -1: 2} and set(got["n"]) == {3}
    assert whitening.whiten(df.limit(0)).count() == 0


def test_stored_tables_can_be_discarded(spark):
    a, b = common.stored(spark.range(5), "a"), common.stored(spark.range(5), "b")
    path = a.inputFiles()[0].removeprefix("file://")
    common.discard(a)
    common.discard(common.stored(spark.range(0), "none"))
    assert not os.path.exists(path) and b.count() == 5
