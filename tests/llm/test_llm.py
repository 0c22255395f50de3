"""Training-data operators against brute force, and on odd rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from kestrel.llm import decontam, langid, linededup, maxscore, pieces, pitmanyor, queries, revisit, simhash, spans, toxicity

SF = "/root/testdata/sf0.001"
A = "The quick brown fox jumps over the lazy dog near the old river bank today."
B = "Il fait beau aujourd'hui. Les oiseaux chantent dans le jardin. Nous irons marcher demain matin avec des amis."
ODD = [(1, A + "\n" + B, "en"), (2, A + "\n" + B, "en"), (2, A + "\n" + B, "en"), (3, None, "en"), (4, "", None), (None, A + "\n" + B, "fr"),
       (None, None, None), (5, " \t\n\x0b ", "fr"), (6, A.replace("dog", "cat"), None), (7, "word " * 30_000, "en"), (8, "힣 é \U0001f600 ▁x", "fr")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, lang string, fp long, rid long, key long, h string, line string, hits int, _rid string, c int"
    return spark.createDataFrame([r + (1, 2, 3, "h", "l", 4, "r", 5) for r in ODD], schema)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (6, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def words(text):
    return text.encode().lower().split()


# 1 language model


def log_ways(c, d):
    """log S(c, t) for t from 0, by the recurrence."""
    row = np.array([-np.inf, 0.0])
    for x in range(1, c):
        t = np.arange(1, x + 1)
        row = np.logaddexp(np.concatenate([[-np.inf], row[1:] + np.log(x - d * t), [-np.inf]]), np.concatenate([[-np.inf], row]))
    return row


def distance(got, law, cells=50):
    """Total variation between a sample and a law, in that many cells."""
    cell = np.minimum((np.cumsum(law) * cells).astype(int), cells - 1)
    return abs(np.bincount(cell, law, cells) - np.bincount(cell[np.clip(got, 0, len(law) - 1)], minlength=cells) / len(got)).sum() / 2


@pytest.mark.parametrize("d", [0.3, 0.8, 0.95])
@pytest.mark.parametrize("c", [2, 6, 17, 200])
def test_seating_has_the_exact_law(c, d):
    """With production settings, for few and many tables."""
    ways, t, n = log_ways(c, d), np.arange(c + 1), 50_000
    keys = np.random.default_rng(c).integers(0, 2**63, n).astype(np.uint64)
    for y in (1e-4, 0.2, 5.0, 60.0, 30.0 * c):
        law = ways + t * math.log(y)
        law = np.exp(law - law.max())
        got = pitmanyor.seat_dishes(np.full(n, c), d, np.full(n, y), keys, 0).astype(int)
        assert got.min() >= 1 and distance(got, law / law.sum()) < 0.02


@pytest.mark.parametrize("d", [0.3, 0.8, 0.95])
def test_seating_of_many_customers_has_the_exact_law(d):
    """Beyond the recurrence's bound, at evenly spaced quantiles."""
    u = (np.arange(1000) + 0.5) / 1000
    for c, several in ((1025, (1e-4, 5.0, 1000.0, 30_000.0)), (10_000, (0.2, 60.0))):
        ways, t = log_ways(c, d), np.arange(c + 1)
        for y in several:
            law = ways + t * math.log(y)
            law = np.exp(law - law.max())
            got = pitmanyor.large_dishes(np.full(1000, float(c)), d, np.full(1000, y), u).astype(int)
            assert got.min() >= 1 and distance(got, law / law.sum(), 20) < 0.02
    assert pitmanyor.seat_dishes(np.array([10**6, 1025, 0]), d, np.array([3.0, 1e-6, 1.0]), np.arange(3).astype(np.uint64), 0).tolist()[1:] == [1, 0]


@pytest.mark.parametrize("d", [0.05, 0.5, 0.8, 0.95])
def test_numbers_of_seatings_of_many_customers(d):
    ways, t = log_ways(3000, d), np.arange(1.0, 3001)
    got = pitmanyor.log_seatings(np.full(3000, 3000.0), t, d) + math.lgamma(3001)
    assert abs(got[:-30] - ways[1:-30]).max() < 1e-4 and abs(got - ways[1:]).max() < 0.01


def test_gammas_have_their_law():
    keys = np.random.default_rng(2).integers(0, 2**63, 200_000).astype(np.uint64)
    for shape in (0.05, 0.7, 1.0, 3.5, 1e6):
        x = pitmanyor.gammas(np.full(len(keys), shape), keys, 77)
        assert x.mean() == pytest.approx(shape, rel=0.03) and x.var() == pytest.approx(shape, rel=0.06)
    assert (pitmanyor.gammas(np.zeros(3), keys[:3], 1) == 0).all()


def test_sweeps_reach_the_posterior_of_a_restaurant():
    """Size and dishes in turn, against all seatings of three dishes under a Pitman-Yor restaurant."""
    c, p, d, n = [5, 3, 1], [0.2, 0.05, 0.3], 0.6, 40_000
    ways = [np.exp(log_ways(x, d)) for x in c]
    law = np.zeros(sum(c) + 1)
    for i in range(1, c[0] + 1):
        for j in range(1, c[1] + 1):
            t = i + j + 1
            law[t] += (ways[0][i] * p[0] ** i * ways[1][j] * p[1] ** j * ways[2][1] * p[2]
                       * math.prod(pitmanyor.STRENGTH + d * k for k in range(1, t)))
    keys = np.random.default_rng(3).integers(0, 2**63, n).astype(np.uint64)
    tables = np.full(n, 9.0)
    for sweep in range(12):
        x = pitmanyor.gammas(pitmanyor.STRENGTH / d + tables, keys, pitmanyor.stream(sweep, 0) + pitmanyor.SIZE)
        tables = sum(pitmanyor.seat_dishes(np.full(n, c[k]), d, d * x * p[k], keys + np.uint64(k + 1), pitmanyor.stream(sweep, 0)) for k in range(3))
    assert distance(tables.astype(int), law / law.sum()) < 0.02


def brute_scores(texts, sweeps):
    """{doc_id: score}: the model kept in plain dictionaries, seated with the same random numbers."""
    key = lambda w: np.array([xxhash.xxh64_intdigest(w, 7)], np.uint64)
    with np.errstate(over="ignore"):
        pair_key = {(u, w): pitmanyor.mixed(key(u) * np.uint64(0x9E3779B97F4A7C15) + key(w)) for t in texts.values() for u, w in zip([b"\t", *words(t)], [*words(t), b"\n"])}
    learn = [[*words(t), b"\n"] for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for t in learn for w in t)
    pair = Counter(p for t in learn for p in zip([b"\t", *t], t))
    n, v, s = sum(count.values()), len(count), pitmanyor.STRENGTH
    follow = {**count, b"\t": count[b"\n"]}
    of = lambda c: pitmanyor.discount(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    d, d0 = of(pair), of(count)
    one = lambda x: np.array([x], np.float64)
    share = [{w: (c + 0.5) / (n + 0.5 * (v + 1)) for w, c in count.items()}] * pitmanyor.CHAINS
    grown = lambda m: math.exp(math.lgamma(m + s + d) - math.lgamma(m + s) + math.lgamma(s) - math.lgamma(s + d))
    busy = [{u: max(s / d * (grown(m) - 1), 1.0) for u, m in follow.items()}] * pitmanyor.CHAINS
    roots = [v] * pitmanyor.CHAINS
    total = Counter()
    for sweep in range(sweeps):
        rng = np.random.default_rng(sweep)
        sizes = [rng.gamma(s / d0 + roots[k]) for k in range(pitmanyor.CHAINS)]
        state = []
        for k in range(pitmanyor.CHAINS):
            at = pitmanyor.stream(sweep, k)
            x = {u: pitmanyor.gammas(one(s / d + busy[k][u]), key(u), at + pitmanyor.SIZE)[0] for u in follow}
            t = {(u, w): pitmanyor.seat_dishes(np.array([c]), d, one(d * x[u] * share[k][w]), pair_key[u, w], at)[0] for (u, w), c in pair.items()}
            guests, tables = Counter(), Counter()
            for (u, w), m in t.items():
                tables[u] += m
                guests[w] += int(m)
            top = {w: pitmanyor.seat_dishes(np.array([m]), d0, one(d0 * sizes[k] / (v + 1)), key(w), at + (1 << 60))[0] for w, m in guests.items()}
            drawn = {w: pitmanyor.gammas(one(guests[w] - d0 * top[w]), key(w), at + pitmanyor.SHARE)[0] for w in guests}
            state.append((t, tables, guests, top, drawn))
        busy, roots, share = [x[1] for x in state], [sum(x[3].values()) for x in state], []
        for k, (t, tables, guests, top, drawn) in enumerate(state):
            rest = rng.gamma(s + d0 * roots[k])
            share.append({w: (drawn[w] + rest / (v + 1)) / (rest + sum(drawn.values())) for w in drawn})

    def chance(u, w):
        got = []
        for t, tables, guests, top, _ in state:
            p = (guests[w] - d0 * top.get(w, 0) + (s + d0 * sum(top.values())) / (v + 1)) / (s + sum(guests.values()))
            c = follow.get(u, 0)
            got.append((pair[u, w] - d * t.get((u, w), 0) + (s + d * tables[u]) * p) / (s + c) if c else p)
        return sum(got) / len(got)

    return {i: sum(math.log10(chance(u, w)) for u, w in zip([b"\t", *words(t)], [*words(t), b"\n"])) for i, t in texts.items()}


@pytest.mark.parametrize("sweeps, recurred", [(1, 8), (2, 1024), (3, 8)])
def test_language_model_equals_a_plain_one(spark, rows, monkeypatch, sweeps, recurred):
    monkeypatch.setattr(pitmanyor, "RECURRED", recurred)
    monkeypatch.setattr(pitmanyor, "TOKENS", 500)
    monkeypatch.setattr(pitmanyor, "TABLED", {})
    texts = {i: t[:600] for i, t in sorted(rows.items())[:60]} | {10**6 + i: "a b a a b c " * i for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in pitmanyor.score(df, sweeps).collect()}
    assert got == pytest.approx(brute_scores(texts, sweeps), rel=1e-4)


def test_language_model(spark, docs, rows):
    got = {r["doc_id"]: r for r in pitmanyor.score(docs).collect()}
    count = Counter(w for i, t in rows.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    assert set(got) == set(rows)
    for i, t in rows.items():
        own = [*words(t), None]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in count for w in own), n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / len(own)))
    for held in (True, False):
        assert sum(r["score"] for r in got.values() if r["held_out"] == held) > sum(r["base_score"] for r in got.values() if r["held_out"] == held)


def test_language_model_adds_up(spark):
    """After any context the probabilities of the learned tokens and the unknown one sum to 1."""
    text = [(i, " ".join("ab"[(i * j) % 3 % 2] for j in range(1 + i % 7))) for i in range(40)]
    probe = [(1000 + i, t) for i, t in enumerate(["", "a", "b", "zz"])]
    probe = [r for r in probe] + [(2000 + k, t) for k, t in enumerate(["a a", "a b", "a zz"])]
    held = [(i, t) for i, t in ((10_000 + j, t) for j in range(200) for t in [x[1] for x in probe]) if zlib.crc32(str(i).encode()) % 5 == 1]
    df = spark.createDataFrame(text + list({t: (i, t) for i, t in held}.values()), "doc_id long, text string")
    scores = {t: 10 ** s for t, s in df.join(pitmanyor.score(df).where("held_out"), "doc_id").select("text", "score").collect()}
    # P(first = a) etc. follow from P("a") = P(a | start) P(end | a); so compare the children of "a"
    end, a, b, z = (scores["a"], scores["a a"], scores["a b"], scores["a zz"])
    assert 0 < z < a and 0 < b < a and scores["zz"] < scores["a"] and end > 0


def test_language_model_odd_rows(odd, none):
    got = pitmanyor.score(odd).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert pitmanyor.score(none).count() == 0


# 2 line dedup


def brute_lines(rows):
    cls = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            if line.encode().split():
                cls.setdefault(line, (i, n))
    keys, sets = list(cls), [frozenset(k.encode().split()) for k in cls]
    links, later = Counter(), set()
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for j, o in Counter(j for w in s for j in at[w]).items():
            if o >= 0.8 * (len(s) + len(sets[j]) - o) - 1e-9:
                links[i] += 1
                links[j] += 1
                later.add(i)  # classes come in the order of their first places
        for w in s:
            at[w].append(i)
    number = {k: i for i, k in enumerate(keys)}
    return {(i, n): (*cls[line], links[number[line]], number[line] in later or cls[line] != (i, n))
            for i, t in rows for n, line in enumerate((t or "").split("\n")) if line.encode().split()}


def test_line_dedup(docs, rows):
    got = linededup.remove_marks(docs).collect()
    assert {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["n_links"], r["removed"]) for r in got} == brute_lines(list(rows.items()))


def test_line_dedup_without_broadcast(docs, rows, monkeypatch):
    monkeypatch.setattr(linededup, "SENT", -1)
    assert {(r["doc_id"], r["line_no"]): r["removed"] for r in linededup.remove_marks(docs).collect()} == {k: v[3] for k, v in brute_lines(list(rows.items())).items()}


@pytest.mark.parametrize("block", [1 << 14, 1 << 11])
def test_line_dedup_of_many_near_copies(spark, monkeypatch, block):
    """No step makes a row for every two near copies, and none of their links is lost."""
    rng, made = np.random.default_rng(5), {}
    base = [f"base{i}" for i in range(60)]

    def copy(i):
        line = list(base)
        for k, at in enumerate(rng.permutation(60)[:int(rng.integers(0, 7))]):
            line[at] = f"x{i}-{k}" if k % 2 else f"common{rng.integers(0, 30)}"
        return " ".join(line)

    near = [(i, copy(i)) for i in range(300)] + [(1000 + i, " ".join(f"own{i}-{j}" for j in range(12)) + "\n" + copy(i)) for i in range(100)]
    df = spark.createDataFrame(near, "doc_id long, text string").repartition(4)
    write = linededup.stored

    def counted(df, name, **options):
        made[name] = max(made.get(name, 0), (out := write(df, name, **options)).count())
        return out

    monkeypatch.setattr(linededup, "stored", counted)
    monkeypatch.setattr(linededup, "BLOCK", block, raising=False)
    expected = brute_lines(near)
    got = {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["n_links"], r["removed"]) for r in linededup.remove_marks(df).collect()}
    assert got == expected and sum(v[2] for v in expected.values()) > 40_000
    rid = {r["rid"]: r["doc_id"] for r in df.select("doc_id", linededup.row_id().alias("rid")).collect()}
    assert {(rid[r["rid"]], r["line_no"]) for r in linededup.removed_lines(df).collect()} == {k for k, v in expected.items() if v[3]}
    assert max(n for name, n in made.items() if name != "line-postings") < 8_000, made


def test_line_dedup_writes_no_row_a_prefix_word(spark, monkeypatch):
    """Prefix words lie on disk as one row a class, and are shuffled a part at a time."""
    rng, made = np.random.default_rng(6), Counter()
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 400, 40))) for i in range(200)]
    rows += [(200 + i, rows[i][1].rsplit(" ", 2)[0]) for i in range(20)]
    write = linededup.stored

    def counted(df, name, **options):
        out = write(df, name, **options)
        made[name] = max(made[name], out.count())
        return out

    monkeypatch.setattr(linededup, "stored", counted)
    got = linededup.remove_marks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["n_links"], r["removed"]) for r in got} == brute_lines(rows)
    assert made["line-links"] >= 20 and max(made.values()) <= len(rows), made


@pytest.mark.parametrize("marks", [True, False])
def test_line_dedup_describes_no_short_line_twice(spark, monkeypatch, marks):
    """The classes' places are found once, and only long lines need their texts before the candidates are known."""
    rng, made = np.random.default_rng(7), defaultdict(list)
    base = {30: [f"s{i}" for i in range(30)], 200: [f"l{i}" for i in range(200)]}
    rows = []
    for size, count in ((30, 40), (200, 25)):
        for i in range(count):
            line = list(base[size])
            line[rng.integers(0, size)] = f"x{size}-{i}"
            rows.append((len(rows), " ".join(line) + ("\n \t\r\n" + " ".join(base[30]) if i % 9 == 0 else "")))
    write = linededup.stored

    def counted(df, name, **options):
        out = write(df, name, **options)
        made[name].append(out.count())
        return out

    monkeypatch.setattr(linededup, "stored", counted)
    df, expected = spark.createDataFrame(rows, "doc_id long, text string"), brute_lines(rows)
    if marks:
        got = linededup.remove_marks(df).collect()
        assert {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["n_links"], r["removed"]) for r in got} == expected
    else:
        rid = {r["rid"]: r["doc_id"] for r in df.select("doc_id", linededup.row_id().alias("rid")).collect()}
        assert {(rid[r["rid"]], r["line_no"]) for r in linededup.removed_lines(df).collect()} == {k for k, v in expected.items() if v[3]}
    classes = len({v[:2] for v in expected.values()})
    assert made["line-firsts"] == [classes] and len(made["line-texts"]) == 2 and made["line-texts"][0] <= 25 < made["line-texts"][1], made


def test_line_dedup_odd_rows(odd, none):
    got = linededup.dedup_lines(odd)
    assert got.columns == odd.columns
    text = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert text[(1, A + "\n" + B)] == 1 and text[(2, "")] == 2 and text[(None, "")] == 1
    assert text[(3, None)] == 1 and text[(4, "")] == 1 and text[(None, None)] == 1 and text[(5, " \t\n\x0b ")] == 1
    assert text[(6, "")] == 1  # 14 words, one of them another: Jaccard 13 / 15
    assert {r["_rid"] for r in got.collect()} == {"r"}
    assert linededup.dedup_lines(none).count() == 0


def test_line_dedup_runs_no_python(docs):
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 3 language identification


def test_language_id(docs):
    got = docs.join(langid.identify(docs), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_kneser_ney_adds_up():
    rng = np.random.default_rng(0)
    text = [" ".join("abcde"[i] * int(n) for i, n in zip(rng.integers(0, 5, 400), rng.integers(1, 4, 400)))]
    key, n = np.unique(langid.grams(text, langid.symbol_table())[0], return_counts=True)
    logp, back, three = langid.kneser_ney(key, n)
    for context in np.unique(key >> 6)[:20]:
        total = 0.0
        for c in range(64):
            k = context << 6 | c
            at = np.searchsorted(key, k)
            total += 2.0 ** float(logp[at] if at < len(key) and key[at] == k else back[context] + three[k & 0x3FFFF])
        assert total == pytest.approx(1, abs=1e-4)


def test_language_id_odd_rows(odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == len(ODD) and {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert {r["lang_pred"] for r in got} <= {"en", "fr", "und"}
    assert langid.identify(none).count() == 0


# 4 SimHash


def brute_fingerprint(text, k=4):
    w = words(text)
    s = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(pairs):
    fps = sorted({f for _, f in pairs})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                up[root(b)] = root(a)
    low = {}
    for i, f in pairs:
        if i is not None:
            low[root(f)] = min(low.get(root(f), i), i)
    return Counter((i, f"{f:016x}", low.get(root(f))) for i, f in pairs)


def test_simhash(docs, rows):
    got = Counter(map(tuple, simhash.simhash_groups(docs).collect()))
    assert got == brute_groups([(i, brute_fingerprint(t)) for i, t in rows.items()])


def test_simhash_odd_rows(odd, none):
    got = Counter(map(tuple, simhash.simhash_groups(odd).collect()))
    assert got == brute_groups([(i, brute_fingerprint(t or "")) for i, t, _ in ODD])
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == sorted({x for _, _, x in got if x is not None})
    assert simhash.simhash_groups(none).count() == 0


def test_golay_keys_find_all_pairs_within_four_bits():
    rng = np.random.default_rng(0)
    fps = rng.integers(-2**63, 2**63 - 1, 2000)
    near = fps.view(np.uint64).copy()
    for i in range(len(near)):
        for b in rng.choice(64, i % 5, replace=False):
            near[i] ^= np.uint64(1 << int(b))
    tables = simhash.golay_tables()
    each = []
    for f in (fps, near.view(np.int64)):
        keys = defaultdict(set)
        for k, o in zip(*(x.tolist() for x in simhash.bucket_keys(f, tables))):
            keys[o].add(k)
        each.append([keys[x] for x in f.tolist()])
    assert all(a & b for a, b in zip(*each))


def test_hot_buckets_are_split_without_loss(spark):
    rng = np.random.default_rng(3)
    fps = sorted({int(b) for b in np.bitwise_xor.reduce(np.int64(1) << rng.integers(0, 18, (400, 3)), axis=1)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bucket in (8, 4096):
        edges = [(r["a"], r["b"]) for r in simhash.links(df, 4, bucket).collect()]
        up = {f: f for f in fps}

        def root(f):
            while up[f] != f:
                f = up[f]
            return f

        for a, b in edges:
            assert (a ^ b).bit_count() >= 1
            up[root(a)] = root(b)
        exact = brute_groups([(i, f) for i, f in enumerate(fps)])
        assert len({root(f) for f in fps}) == len({x for _, _, x in exact})


# 5 revisits


def test_revisits(spark):
    rows = [(1, "http://User@A.com:80/x/?b=2&a=1&utm_source=q#f", 10, "response", {"ETag": '"v1"', "Content-Type": "text/html", "Date": "d1"}),
            (2, "https://a.com/x?a=1&b=2", 20, "response", {"etag": '"v2"', "Content-Length": "9", "X": "old"}),
            (3, "https://a.com/x?a=1&b=2", 15, "revisit", {"ETag": 'W/"v1"', "Date": "d3", "Content-Length": "0"}),
            (4, "https://a.com/x?a=1&b=2", 20, "revisit", {"etag": '"v1"', "Date": "d4"}),
            (5, "https://a.com/x?a=1&b=2", 5, "revisit", None), (6, None, 30, "revisit", {"a": None}), (7, "https://a.com/x?a=1&b=2", 40, "revisit", {"Date": "d7", "X": "new"}),
            (8, "https://a.com/x?a=1&b=2", 50, "request", {}), (9, None, 1, "response", {})]
    df = spark.createDataFrame([r + ("clash",) for r in rows], "record_id long, url string, ts long, kind string, headers map<string,string>, slot string")
    for slots in (1, 3, 256):
        got = {r["record_id"]: (r["target_id"], r["outcome"], r["headers"]) for r in revisit.resolve(df, slots).collect()}
        assert got == {
            3: (1, "resolved", {"etag": 'W/"v1"', "content-type": "text/html", "date": "d3"}),
            4: (2, "changed", {"etag": '"v1"', "date": "d4"}), 5: (None, "missing", {}), 6: (None, "missing", {}),
            7: (2, "unchecked", {"etag": '"v2"', "content-length": "9", "x": "old", "date": "d7"})}
    assert revisit.resolve(df.limit(0)).count() == 0


# 6 spans


def brute_spans(rows):
    """(covered sentences) per row, with spans as texts."""
    places, parts = defaultdict(list), {}
    for n, (i, t) in enumerate(rows):
        own = [(j, b" ".join(s.lower().split())) for j, s in enumerate(spans.sentences((t or "").encode())) if s.split()]
        parts[n] = own
        for p in range(len(own) - spans.SPAN + 1):
            run = tuple(x for _, x in own[p:p + spans.SPAN])
            if sum(len(x.split()) for x in run) >= spans.MIN_WORDS:
                places[run].append((i is None, i or 0, n, p))
    gone = defaultdict(set)
    for at in places.values():
        for _, _, n, p in sorted(at)[1:]:
            gone[n].update(parts[n][p + k][0] for k in range(spans.SPAN))
    return gone


def test_spans(docs, rows):
    own = sorted(rows.items())
    gone = brute_spans(own)
    got = {r["doc_id"]: r for r in spans.remove_repeats(docs).collect()}
    for n, (i, t) in enumerate(own):
        assert set(got[i]["removed"]) == gone[n]
        assert got[i]["text"] == "".join(s.decode() for j, s in enumerate(spans.sentences(t.encode())) if j not in gone[n])


def test_long_passages_in_several_documents_are_found(spark):
    passage = "A first sentence has words in it. Then a second one follows here. The third is a bit longer than the others. " * 1 + \
        "After that comes a fourth sentence with more words. A fifth one closes the passage that is over fifty words long in all of it. "
    df = spark.createDataFrame([(i, f"Own words number {i} begin {i} here. {passage}Then text {i} ends on its own way {i}.") for i in range(5)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in spans.remove_repeats(df).collect()}
    assert not got[0]["removed"] and all(len(got[i]["removed"]) == 5 and "fifth" not in got[i]["text"] and got[i]["first_docs"] == [0] for i in range(1, 5))


def test_spans_odd_rows(odd, none):
    got = Counter((r["doc_id"], r["text"]) for r in spans.remove_repeats(odd).collect())
    assert got[(1, A + "\n" + B)] == 1 and got[(2, "")] == 2 and got[(None, "")] == 1 and got[(3, None)] == 1 and got[(None, None)] == 1
    assert spans.remove_repeats(none).count() == 0


def brute_runs(rows, least):
    """Per text the sentences of its stretches with ``least`` words that stand before them, as a stretch of sentences, too."""
    parts = [[s.lower().split() for s in spans.sentences(t.encode()) if s.split()] for t in rows]
    gone, seen = [], set()
    for own in parts:
        out, new = set(), set()
        for p in range(len(own)):
            for q in range(p + 1, len(own) + 1):
                run = tuple(b" ".join(x) for x in own[p:q])
                if sum(map(len, own[p:q])) >= least:
                    if run in seen or run in new:
                        out.update(range(p, q))
                    new.add(run)
        seen |= new
        gone.append(sorted(out))
    return gone


PASSAGES = {
    "one": ["".join(f"long{i} " for i in range(60)) + "stops. "],
    "two": ["".join(f"first{i} " for i in range(9)) + "stops. ", "".join(f"second{i} " for i in range(50)) + "ends. "],
    "list": [f"item number {i}\n" for i in range(40)],
    "tail": ["".join(f"begin{i} " for i in range(20)) + "here. ", "Then little. ", "And less. "],
}


@pytest.mark.parametrize("name", PASSAGES)
def test_passages_of_any_number_of_sentences_are_found(spark, tmp_path, name):
    passage = PASSAGES[name]
    texts = ["".join(passage)] * 2 + ["".join(["Own lead of this text.\n", *passage, f"Own end of text {i}."]) for i in range(2)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["removed"] for r in queries.op6_span_dedup(spark, str(tmp_path)).collect()}
    n = len(passage)
    assert got[1] == list(range(n)) and set(range(1, n + 1)) <= set(got[2]) and set(range(1, n + 1)) <= set(got[3]) and 0 not in got


def test_every_repeated_stretch_is_removed_whole(spark):
    rng = np.random.default_rng(4)
    pool = [" ".join(f"w{rng.integers(5)}" for _ in range(rng.choice([1, 2, 3, 5, 14]))) + ".\n" for _ in range(25)]
    texts = ["".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 14))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in spans.remove_repeats(df, span=None).collect()}
    want = brute_runs(texts, spans.MIN_WORDS)
    assert [got[i] for i in range(len(texts))] == want and sum(map(len, want)) > 100


# 7 pieces


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(*pieces.load_pieces(queries.VOCABULARY))


def brute_viterbi(codec, plain, text):
    best = [(0.0, 0)] + [(float("-inf"), 0)] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = max([(best[end - 1][0] + codec.unknown, 0)] + [(best[end - n][0] + plain[text[end - n:end]], n) for n in range(1, min(end, 48) + 1) if text[end - n:end] in plain])
    return best[-1][0]


def test_viterbi_has_the_best_score(codec, rows):
    plain = {p: s for _, p, s in pieces.load_pieces(queries.VOCABULARY)[0]}
    score = {i: s for i, p, s in pieces.load_pieces(queries.VOCABULARY)[0]}
    for text in [t[:300] for t in list(rows.values())[:25]] + ["é\U0001f600 ñ", "a  b   ", " x"]:
        ids = codec.encode(text).tolist()
        unknown = sum(1 for c in text if c not in codec.alphabet and c != " ")
        got = sum(score[i] for i in ids if i in score) + unknown * codec.unknown
        assert got == pytest.approx(brute_viterbi(codec, plain, pieces.MARK + text.replace(" ", pieces.MARK)))


def test_round_trip(spark, docs, odd, none, codec):
    for df in (docs, odd):
        enc = pieces.encode(df, queries.VOCABULARY, keep=("doc_id", "text"))
        assert enc.where("not round_trip").count() == 0
        back = pieces.decode(enc.withColumnRenamed("text", "was"), queries.VOCABULARY)
        assert back.where("not (was <=> text)").count() == 0 and back.count() == df.count()
    assert pieces.encode(none, queries.VOCABULARY).count() == 0
    assert codec.decode(codec.encode("▁ a▁ ▁").tolist()) == "▁ a▁ ▁"


@pytest.mark.parametrize("text", ["1" * 100_000, "0" * 1200, "\u6f22" * 100_000, "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(100_000)), "\u65e5\u672c\u8a9e\u306e\u6587" * 20_000, "word " * 3 + "\u6f22" * 2000 + " end"])
def test_long_stretches_without_known_pairs(codec, text):
    ids = codec.encode(text).tolist()
    assert codec.decode(ids) == text
    if " " not in text:  # the whole chunk in one Viterbi run
        assert ids == codec.viterbi(pieces.MARK + text)


# 8 MaxScore


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(600)]
    rows += [(601, rows[3][1]), (602, None), (603, [None] * 16), (604, [float("nan")] * 16), (None, [1.0] * 16), (605, []), (606, [3.0]), (3, rows[3][1]), (650, [0.0] * 16)]
    df = spark.createDataFrame([r + (0, 0) for r in rows], "vec_id long, embedding array<float>, shard int, v int")
    ok = [(i, np.floor(256 * np.array(v + [0.0] * (16 - len(v)), np.float32).astype(float)).astype(int)) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in ok:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in ok if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for shard, block in ((2048, 1024), (64, 4)):
        assert sorted(map(tuple, maxscore.top_k(df, 50, 5, shard, block).collect())) == sorted(want)
    assert maxscore.top_k(df.limit(0)).count() == 0


# 9 decontamination


def edit_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination(spark, rows):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:8]
    rng = np.random.default_rng(2)
    own = []
    for k, (_, t) in enumerate(bench):
        for edits in (0, len(decontam.normal(t)) * 5 // 100, len(t) * 3 // 10):
            chars = list(t)
            for at in rng.choice(len(chars), edits, replace=False):
                chars[at] = "#"
            own.append((len(own), "Lead in words, " + "".join(chars).upper() + "  and\nsome more.", 1))
    own += [(None, bench[0][1], 1), (900, None, 1), (901, "", 1)]
    items = spark.createDataFrame([(*b, "x") for b in bench] + [(None, "lead in words", "x"), (77, None, "x"), (78, "", "x")], "item_id long, text string, hits string")
    df = spark.createDataFrame(own, "doc_id long, text string, hits int")
    want = Counter()
    for i, t, _ in own:
        for item, b in bench:
            d = edit_in(decontam.normal(b), decontam.normal(t))
            if d <= int(decontam.RATE * len(decontam.normal(b))):
                want[(i, item, d)] += 1
    for most in (1 << 20, 300):
        got = Counter((r["doc_id"], h["item_id"], h["distance"]) for r in decontam.find_items(df, items, most=most).collect() for h in r["hits"])
        assert got == want
    assert sum(want.values()) >= 17 and decontam.find_items(df.limit(0), items).count() == 0
    assert decontam.find_items(df, items.limit(0)).where("size(hits) > 0").count() == 0


def test_decontamination_passes_keep_every_row(spark):
    """Repeated rows, equal ids with other texts and a kept column ``hits``: the same rows in one pass and in many."""
    rows = [(1, A, 7), (1, A, 7), (1, B, 7), (2, "nothing of it here", 8), (None, A, None), (3, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hits int")
    items = spark.createDataFrame([(10, A), (11, B), (12, A)], "item_id long, text string")
    for keep in (("doc_id",), ("doc_id", "hits"), ("doc_id", "text", "hits")):
        one, many = (sorted(map(repr, decontam.find_items(df, items, most=most, keep=keep).collect())) for most in (1 << 20, 10))
        assert one == many and len(one) == len(rows)
    got = decontam.find_items(df, items, most=10, keep=("doc_id", "hits"))
    assert got.columns == ["doc_id", "hits", "hits_"]
    assert sorted(len(r["hits_"]) for r in got.collect()) == [0, 0, 1, 2, 2, 2]


def test_new_columns_beside_kept_ones_of_their_names(spark, labels):
    df = spark.createDataFrame([(1, A, "s", 5, [1]), (2, None, None, None, None)], "doc_id long, text string, score string, predicted int, ids array<int>")
    got = toxicity.score(df, labels, keep=("doc_id", "score", "predicted"))
    assert got.columns == ["doc_id", "score", "predicted", "score_", "predicted_"]
    assert {(r["score"], r["predicted"], r["predicted_"]) for r in got.collect()} == {("s", 5, 0), (None, None, 0)}
    enc = pieces.encode(df, queries.VOCABULARY, keep=("doc_id", "ids"))
    assert enc.columns == ["doc_id", "ids", "ids_", "n_tokens", "round_trip"]
    assert [(r["ids"], r["ids_"] is None) for r in enc.orderBy("doc_id").collect()] == [([1], False), (None, True)]


# 10 toxicity


def test_toxicity(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).join(labels, "doc_id").where(toxicity.crc_mod("doc_id", 3) == 1).collect()
    hit = [r for r in got if r["predicted"] == 1]
    toxic = [r for r in got if r["toxic"] == 1]
    assert sum(r["toxic"] for r in hit) >= 0.95 * len(hit)
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic)
    assert all((r["score"] >= 0.7) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in got)


def test_label_model_recovers_the_classes():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.15
    votes = np.zeros((4000, 15), np.float32)
    for j in range(12):
        votes[:, j] = np.where(y, rng.random(4000) < 0.4, rng.random(4000) < 0.002)
    votes[:, 12] = votes[:, 11]  # a copy must not count twice
    votes[:, 13] = ~votes[:, :12].any(axis=1)
    votes[:, 14] = rng.random(4000) < 0.9
    post = toxicity.label_model(votes)
    assert ((post > 0.5) == y).mean() > 0.95


def test_toxicity_odd_rows(odd, none, labels):
    got = toxicity.score(odd, labels, keep=("doc_id", "text", "hits")).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    assert toxicity.score(odd, labels.limit(0)).count() == len(ODD)
    assert toxicity.score(none, labels).count() == 0


def test_toxicity_counts_all_labelled_rows_and_votes(spark, monkeypatch):
    """A toxic word in few of many labelled rows is a voter, and the label model reads every training row."""
    monkeypatch.setattr(toxicity, "SAMPLE", 100)
    monkeypatch.setattr(toxicity, "LABELLED", 100, raising=False)
    text = {i: ("idiots " * 3 + "zorgle rest") if i % 50 == 0 else "calm words about rivers" for i in range(4000)}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 50 == 0)) for i in text], "doc_id long, quality int, toxic int")
    train = [i for i in text if zlib.crc32(str(i).encode()) % 3 != 1]
    assert (1, "zorgle") in toxicity.lexicon(docs, labels)
    seen = []
    rule = toxicity.label_rule
    monkeypatch.setattr(toxicity, "label_rule", lambda total, both, sums: (seen.append((total, both)), rule(total, both, sums))[1])
    words, weights, b = toxicity.fit(docs, labels)
    voters = toxicity.Voters(words)
    fired = toxicity.matrix([voters(text[i]) for i in train], voters.size).astype(float)
    assert seen[0][0] == len(train) and (seen[0][1] == fired.T @ fired).all()
    monkeypatch.setattr(toxicity, "LOCAL", 0)
    _, again, c = toxicity.fit(docs, labels)
    assert np.allclose(weights, again, atol=1e-6) and b == pytest.approx(c, abs=1e-6)


# pipeline and queries


def test_pipeline_stages(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, out))
        assert set(after) <= set(before)
        if name == "line_dedup":
            marks = brute_lines(list(before.items()))
            assert after == {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not marks.get((i, n), (0,))[-1]) for i, t in before.items()}
        elif name == "simhash":
            groups = brute_groups([(i, brute_fingerprint(t or "")) for i, t in before.items()])
            assert set(after) == {g for _, _, g in groups}
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.where("not round_trip").count() == 0 and last.count() == docs.count()


def test_pipeline_run(spark):
    assert {"doc_id", "ids", "n_tokens", "round_trip"} == set(corpus_pipeline.run(spark, SF).columns)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(cur.fetchall()) == Counter(map(tuple, got.select(*names).collect()))


def test_every_operator_is_registered(spark):
    import __spark_entry__
    own = [q for q in __spark_entry__.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in own) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert queries.op9_decontamination(spark, SF).select(F.col("doc_id")).schema[0].dataType.simpleString() == "bigint"
