"""Toxicity by weak supervision.

Voters: lexicon words and word beginnings found in labelled training rows,
fixed patterns, and voters for clean text. A generative label model estimates
by EM how often each voter fires in toxic and in clean texts, without labels;
voters that fire together beyond what the class explains share their weight.
A logistic regression on the voters' features is then trained on the
posterior labels and scores every whole text.

The lexicon is counted over all labelled training rows and the label model
over all training rows: their vote patterns are written once and every EM step
sums over all of them, in Spark if they are more than ``LOCAL``; then the
driver holds voters x voters figures at most.
Only the classifier is fitted on a bounded sample (``SAMPLE`` rows, by a hash
of the row), on the driver from voter numbers, never text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import crc_mod, slices, stored, text_of, unused, with_text

SAMPLE = 20_000  # rows the classifier is fitted on
HELD = 500_000  # features or vote patterns a task counts before it sends them on
LOCAL = 200_000  # vote patterns up to which the driver sums, which saves a Spark job a step
VOTERS = 512  # lexicon voters
MIN_TOXIC = 5  # toxic rows a lexicon voter needs
MIN_PRECISION = 0.75
THRESHOLD = 0.7
SHARED = 0.5  # residual correlation from which voters share their weight
REMEMBERED = 400_000
WORD = re.compile(r"[^\W\d_]+")
# fixed patterns: (name, vote for toxic, expression over the lower-cased text)
PATTERNS = (
    ("insult", re.compile(r"\b(?:idiots?|morons?|stupid|losers?|scum|pathetic|worthless|disgusting|trash|clowns?)\b")),
    ("threat", re.compile(r"\b(?:shut up|go to hell|drop dead|hate you|kill (?:you|yourself))\b")),
    ("masked", re.compile(r"\b[a-z]+[*@#$]{2,}[a-z]*")),
    ("shout", re.compile(r"!{3,}")),
)


TIMES = (1, 2, 3, 5)  # a voter asks for so many occurrences


def features(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 8 letters marked with a star."""
    return [word, *(word[:n] + "*" for n in range(4, 9) if len(word) > n)]


class Features(dict):
    """The features of words, remembered within a bound."""

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = got = features(word)
        return got


def occurrences(text: str | None, known: Features) -> dict[str, int]:
    """How often each feature stands in the text."""
    seen: dict[str, int] = {}
    for w, n in Counter(WORD.findall((text or "").lower())).items():
        for f in known[w]:
            seen[f] = seen.get(f, 0) + n
    return seen


def lexicon(docs: DataFrame, labels: DataFrame) -> list[tuple[int, str]]:
    """Voters' (times, feature): frequent in toxic rows and rare elsewhere, best supported first."""
    marked = (labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
              .groupBy("doc_id").agg(F.max("y").alias("y")))  # rows that disagree count as toxic
    train = marked.where(crc_mod("doc_id", 3) != 1)

    def counted(both: dict[int, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for k, (clean, toxic) in both.items():
            every = list(clean | toxic)
            for i in range(0, len(every), 50_000):
                part = every[i:i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(part, pa.string()), *(pa.array([c[f] for f in part], pa.int64()) for c in (clean, toxic))], ["k", "f", "clean", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, both = Features(), {k: (Counter(), Counter()) for k in TIMES}
        for b in slices(batches):
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen = occurrences(t, known)
                for k in TIMES:
                    both[k][y].update([f for f, n in seen.items() if n >= k])
            if sum(len(c) for two in both.values() for c in two) >= HELD:
                yield from counted(both)
                both = {k: (Counter(), Counter()) for k in TIMES}
        yield from counted(both)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(train.hint("merge"), "doc_id").select("y", "text")  # one plan at any number of labels
    counts = rows.mapInArrow(run, "k int, f string, clean long, toxic long").groupBy("k", "f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    precision = (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1)
    top = (counts.where((F.col("toxic") >= MIN_TOXIC) & (precision >= MIN_PRECISION))
           .orderBy((F.col("toxic") * precision).desc(), "f", "k").limit(VOTERS))
    return [(r["k"], r["f"]) for r in top.collect()]


class Voters:
    """Which voters fire on a text: lexicon, patterns, then ``no lexicon``, ``no pattern``."""

    def __init__(self, lexicon: list[tuple[int, str]]):
        self.names = list(dict.fromkeys(f for _, f in lexicon))
        number = {f: i for i, f in enumerate(self.names)}
        self.number, self.asks = number, [[] for _ in number]
        for i, (k, f) in enumerate(lexicon):
            self.asks[number[f]].append((k, i))
        self.lexicon = len(lexicon)
        self.size = len(lexicon) + len(PATTERNS) + 2
        self.memory: dict[str, tuple[int, ...]] = {}

    def word(self, w: str) -> tuple[int, ...]:
        got = tuple(self.number[f] for f in features(w) if f in self.number)
        if len(self.memory) >= REMEMBERED:
            self.memory.clear()
        self.memory[w] = got
        return got

    def __call__(self, text: str | None) -> list[int]:
        low, memory, n = (text or "").lower(), self.memory, self.lexicon
        seen: dict[int, int] = {}
        for w, times in Counter(WORD.findall(low)).items():
            got = memory.get(w)
            if got is None:
                got = self.word(w)
            for f in got:
                seen[f] = seen.get(f, 0) + times
        fired = [i for f, times in seen.items() for k, i in self.asks[f] if k <= times]
        patterns = [n + i for i, (_, p) in enumerate(PATTERNS) if p.search(low)]
        clean = ([self.size - 2] if not fired else []) + ([self.size - 1] if not patterns else [])
        return sorted(fired) + patterns + clean


def matrix(rows: list[list[int]], size: int) -> np.ndarray:
    out = np.zeros((len(rows), size), np.float32)
    for i, r in enumerate(rows):
        out[i, r] = 1
    return out


def posterior(ids: np.ndarray, sizes: np.ndarray, size: int, rule: tuple[float, np.ndarray] | None) -> np.ndarray:
    """Posterior of the toxic class for rows with ``sizes`` votes each, ``ids`` in a row; without a rule a first guess."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    if rule is None:
        clean = (sizes > 0) & (np.bincount(row, ids < size - 2, len(sizes)) == 0)
        return np.where(clean, 0.02, 0.9)
    return 1 / (1 + np.exp(-np.clip(rule[0] + np.bincount(row, rule[1][ids], len(sizes)), -30, 30)))


def posterior_sums(ids: np.ndarray, sizes: np.ndarray, n: np.ndarray, size: int, rule: tuple[float, np.ndarray] | None) -> np.ndarray:
    """Sums over rows that stand for ``n`` rows each: the posterior, its square, and the posterior where each voter fires."""
    post = posterior(ids, sizes, size, rule)
    return np.concatenate([[n @ post, n @ post**2], np.bincount(ids, np.repeat(n * post, sizes), size)])


def label_rule(total: float, both: np.ndarray, sums, steps: int = 30) -> tuple[float, np.ndarray]:
    """(intercept, weight of every vote) of the toxic class's log odds, from the votes alone.

    EM for P(voter fires | class). A voter that does not fire abstains, which
    says nothing. Residual correlations within the classes above ``SHARED``
    give a voter the weight 1 / (1 + their sum). ``both`` counts the rows in
    which two voters fire, ``sums`` gives ``posterior_sums`` over all rows.
    """
    fires = np.diag(both)
    rule, weight = None, np.ones(len(fires))
    for step in range(steps):
        found = sums(rule)
        s, q, a = found[0], found[1], found[2:]
        prior = min(0.5, max(1e-3, s / total))
        a1 = (a + 0.5) / (s + 1)
        a0 = (fires - a + 0.5) / (total - s + 1)
        if step % 10 == 0:
            d = a1 - a0  # the residual of a row is its votes - a0 - posterior * d
            half = np.outer(fires, a0) + np.outer(a, d) - s * np.outer(a0, d)
            cov = (both - half - half.T + total * np.outer(a0, a0) + q * np.outer(d, d)) / total
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = cov / np.outer(sd, sd)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.where(corr > SHARED, corr, 0).sum(axis=1))
        rule = float(np.log(prior / (1 - prior))), weight * np.log(a1 / a0) * (fires > 0)
    return rule


def label_model(fired: np.ndarray, steps: int = 30) -> np.ndarray:
    """Posterior of the toxic class for every row of a matrix of votes."""
    ids, sizes, size = np.nonzero(fired)[1], np.count_nonzero(fired, axis=1), fired.shape[1]
    dense = fired.astype(np.float64)
    rule = label_rule(len(fired), dense.T @ dense, lambda r: posterior_sums(ids, sizes, np.ones(len(fired)), size, r), steps)
    return posterior(ids, sizes, size, rule)


def votes(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(votes, votes of each row, rows it stands for) of a batch of patterns."""
    return b.column(0).flatten().to_numpy(), b.column(0).value_lengths().to_numpy(), b.column(1).to_numpy().astype(np.float64)


def added(patterns: DataFrame, size: int, part) -> np.ndarray:
    """The arrays of ``part`` (of a batch) summed over all batches by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in slices(batches, 4096):
            total += part(*votes(b))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "v"])

    out = np.zeros(size)
    for r in patterns.select("fired", "n").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 15) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(shrink)
        move = np.linalg.solve(h, x.T @ (y - p) - shrink * w)
        w += np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[int, str]], np.ndarray, float]:
    """(lexicon, weights, intercept)."""
    words = lexicon(docs, labels)
    size = Voters(words).size
    train = docs.where(crc_mod("doc_id", 3) != 1)
    total = train.count()
    if not total:
        return words, np.zeros(size), -3.0
    row = F.xxhash64(F.lit("sample"), "doc_id", "text")
    low = int(min(1.0, 1.1 * SAMPLE / total + 1e-5) * 2**31)  # rows below it are sent one by one, the others as patterns with counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, held = Voters(words), Counter()

        def rows(fired: list, n: list[int], pick: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(fired, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(pick, pa.int64())], ["fired", "n", "pick"])

        for b in slices(batches):
            fired = [tuple(voters(t)) for t in b.column(0).to_pylist()]
            picked = [(f, h) for f, h in zip(fired, b.column(1).to_pylist()) if h & 0x7FFFFFFF < low]
            held.update(f for f, h in zip(fired, b.column(1).to_pylist()) if h & 0x7FFFFFFF >= low)
            yield rows([f for f, _ in picked], [1] * len(picked), [h for _, h in picked])
            if len(held) >= HELD:
                yield rows(list(held), list(held.values()), [None] * len(held))
                held = Counter()
        yield rows(list(held), list(held.values()), [None] * len(held))

    patterns = stored(train.select(F.col("text").cast("string"), row.alias("row")).mapInArrow(run, "fired array<int>, n long, pick long"), "votes")

    def together(ids: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
        out, at = np.zeros(size * size), np.concatenate([[0], np.cumsum(sizes)])
        for k in np.unique(sizes):
            own = np.flatnonzero(sizes == k)
            x = ids[at[own][:, None] + np.arange(k)].astype(np.int64)
            for i in range(k):
                np.add.at(out, x[:, i:i + 1] * size + x, n[own][:, None])
        return out

    both = added(patterns, size * size, together).reshape(size, size)
    if patterns.count() <= LOCAL:
        table = patterns.select("fired", "n").toArrow()
        own = [votes(b) for b in table.to_batches()]
        sums = lambda r: sum((posterior_sums(*x, size, r) for x in own), np.zeros(size + 2))
    else:
        sums = lambda r: added(patterns, size + 2, lambda ids, sizes, n: posterior_sums(ids, sizes, n, size, r))
    rule = label_rule(total, both, sums)
    sample = [r[0] for r in patterns.where("pick is not null").orderBy(F.col("pick").bitwiseAND(0x7FFFFFFF), "pick", "fired").limit(SAMPLE).select("fired").collect()]
    sizes = np.array([len(r) for r in sample])
    post = posterior(np.array([v for r in sample for v in r], np.int64), sizes, size, rule)
    weights, b = logistic(matrix(sample, size), post)
    return words, weights, b


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score (0 to 1) and predicted (1 from ``THRESHOLD``); one row per document row.

    A kept column called score or predicted stays; the new one's name is then
    lengthened (``common.unused``). The new columns are always the last two.

    Fitted on rows whose crc32(doc_id) mod 3 is not 1; labels, lang, source
    and doc_id are no inputs of a score. Null and empty texts are scored as
    texts without words. Without labelled toxic rows only the fixed patterns vote; without any training
    rows every score is that of an intercept of -3.
    """
    words, weights, b0 = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((words, weights, b0))
    kept = docs.select(*keep)
    schema, new = kept.schema, [unused(kept, "score"), unused(kept, "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights, b0 = sent.value
        voters = Voters(words)
        for b in slices(batches):
            logit = np.array([weights[voters(t)].sum() + b0 for t in text_of(b, keep)])
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [*keep, *new])

    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema)
    return with_text(docs, keep).mapInArrow(run, f"{out}`{new[0]}` double, `{new[1]}` int")
