"""Hierarchical Pitman-Yor language model over word pairs, by distributed Gibbs sampling.

Every word u (and the start of a text) is a restaurant whose customers are the
tokens that follow it; all of them share one parent, the restaurant of the
empty context, whose customers are their tables; below it lies the uniform
distribution over the V learned tokens and one unknown.

A Gibbs sweep draws, each from its conditional law: the size x of every
restaurant, Gamma(strength / d + tables), which makes its dishes independent;
the tables t of every dish (u, w) with c customers, P(t) in proportion to
S(c, t) (d x p)^t, S the generalised Stirling numbers and p the parent's share
of w; the same for the parent; and the parent's shares given its seating (its
unseen part is spread evenly, by its mean). The first sweep starts from the
words' frequencies and the prior's mean number of tables. Predictive
probabilities are averaged over independent chains after their last sweep.

Layout: texts become blocks of about ``TOKENS`` tokens, written once, with
block-local word numbers. A block sends its distinct words and pairs (64-bit
hashes, counts) to hash shards; a shard adds up and answers by position, so
no text is shuffled and every key of a block travels once. The tables of a
pair follow from its count, the last sweep's totals and random numbers drawn
from hashes: each block that holds the pair draws the same, and the pair's
first block reports them. Pairs of many customers are drawn there only and
answered to the other blocks by shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import crc_mod, scratch_path, slices, stored, text_bytes

TOKENS = 1_000_000  # tokens of a block
KEYS = 3_000_000  # keys of a shard, about
CHAINS = 2
SWEEPS = 2
UNIT = 1 << 16  # shares are added up in whole parts of this size
STRENGTH = 1.0  # concentration of every restaurant
END, START = 0, 1  # numbers of the text's end and start in every block
WORDS, PAIRS, TABLES, BEFORE, LARGE = 0, 1, 2, 3, 4  # BEFORE: the tables one sweep ago; LARGE: those of pairs of many customers

MESSAGE = "kind int, shard int, block long, keys binary, vals binary"
ANSWER = "block long, kind int, shard int, vals binary, own binary, stats array<long>"


def pack(x: np.ndarray) -> bytes:
    """Compressed byte planes of an array."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def unpack(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) that follow from key and stream."""
    with np.errstate(over="ignore"):
        h = mixed(key + np.uint64((stream + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def lgamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - np.log(low)


def gammas(shape: np.ndarray, key: np.ndarray, stream: int) -> np.ndarray:
    """Gamma numbers (scale 1) that follow from key and stream, by Marsaglia and Tsang; 0 where the shape is 0."""
    k = np.where(shape < 1, shape + 1, shape) - 1 / 3
    out = np.zeros(len(shape))
    left, draw = np.flatnonzero(shape > 0), stream + 1
    while len(left):
        e, at = k[left], key[left]
        z = np.sqrt(-2 * np.log(uniform(at, draw))) * np.cos(2 * np.pi * uniform(at, draw + 1))
        v = np.maximum(1 + z / np.sqrt(9 * e), 1e-100) ** 3
        ok = (v > 1e-200) & (np.log(uniform(at, draw + 2)) < z * z / 2 + e - e * v + e * np.log(v))
        out[left[ok]] = (e * v)[ok]
        left, draw = left[~ok], draw + 3
    low = np.flatnonzero((shape > 0) & (shape < 1))
    out[low] *= uniform(key[low], stream) ** (1 / shape[low])
    return out


RECURRED = 1024  # customers of a dish whose numbers of seatings come from the recurrence; beyond, from a contour integral
NODES = 64  # numbers of tables at which a larger dish's density is computed
PATH = 24  # points of the contour


TABLED: dict[float, np.ndarray] = {}  # ``seatings`` of this worker's discounts


def seatings(d: float) -> np.ndarray:
    """log S(c, t) for c up to ``RECURRED``: generalised Stirling numbers, S(c + 1, t) = (c - d t) S(c, t) + S(c, t - 1)."""
    if d in TABLED:
        return TABLED[d]
    out = np.full((RECURRED + 1, RECURRED + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(RECURRED + 1.0)
    for c in range(1, RECURRED):
        out[c + 1, 1:c + 1] = out[c, 1:c + 1] + np.log(c - d * t[1:c + 1])
        out[c + 1, 1:c + 2] = np.logaddexp(out[c + 1, 1:c + 2], out[c, :c + 1])
    TABLED[d] = out
    return out


def tilted(l: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of g(x) = 1 - (1 - x)^d at x = v / (1 + v), v = e^l: (v, g, mean, variance) of the law with weights x^n [x^n] g."""
    v = np.exp(l)
    y = -np.log1p(v)
    g = -np.expm1(d * y)
    m = d * v * np.exp(d * y) / g
    return v, g, m, m * (1 + (1 - d) * v - m)


def log_seatings(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) - log c! of many customers: S(c, t) = c! / (t! d^t) [x^c] g(x)^t.

    The coefficient is a saddle-point value with its second-order term where
    x is far from 1, else an integral along a parabola around the cut from 1
    on (relative error about 1e-7).
    """
    goal = np.log(c / np.minimum(t, c - 0.5) - 1)
    l = np.where(goal > 0, goal / (1 - d), goal)
    for _ in range(60):  # the saddle: mean c / t
        v, g, m, k2 = tilted(l, d)
        move = (np.log(m - 1) - goal) * (m - 1) * (1 + v) / k2
        l = l - np.clip(move, -3, 3)
        if np.max(np.abs(move), initial=0) < 1e-8:
            break
    v, g, m, k2 = tilted(l, d)
    s, slope = np.log1p(np.exp(-l)), (1 - d) * v * (1 + v)
    rest = 1 + (1 - d) * v - m
    with np.errstate(all="ignore"):  # values near the cut are replaced below
        k3 = k2 * rest + m * (slope - k2)
        k4 = k3 * rest + 2 * k2 * (slope - k2) + m * (slope * (1 + 2 * v) - k3)
        second = (k4 / k2**2 / 8 - 5 * k3**2 / k2**3 / 24) / t
        out = t * np.log(g) + c * s - 0.5 * np.log(2 * np.pi * t * k2) + np.log1p(np.maximum(second, -0.5))
    near = np.flatnonzero(s < 0.7)
    many, few, at = c[near], t[near], np.maximum(s[near], 4 / c[near])
    v, g, m, k2 = tilted(-np.log(np.expm1(at)), d)
    bend = 2 * at**2 * few * k2 + at * (many - few * m)
    reach = np.sqrt(30 / np.where(bend > 120, bend, np.minimum(bend, at * many)))
    turn = 1 + 1j * reach[:, None] * (np.arange(PATH) / PATH)
    x = -at[:, None] * turn**2
    top = few * np.log(g) + many * at
    f = (np.exp(few[:, None] * np.log(1 - (-np.expm1(x)) ** d) - many[:, None] * x - top[:, None]) * turn).real
    f[:, 0] /= 2
    out[near] = top + np.log(np.maximum(f.sum(axis=1), 1e-300) * 2 * at / np.pi * reach / PATH)
    return np.where(t >= c, -lgamma(c + 1), out - t * np.log(d) - lgamma(t + 1))


def large_dishes(c: np.ndarray, d: float, y: np.ndarray, u: np.ndarray) -> np.ndarray:
    """``seat_dishes`` of many customers: each number of tables within 7.5 deviations of the mode, or a piecewise linear density."""
    goal = np.log(c / y)
    l = np.where(goal > 0, goal / (1 - d), goal)
    for _ in range(60):  # y x (1 - x)^(d - 1) = c at the mode
        x = 1 / (1 + np.exp(-l))
        move = (l - d * np.log1p(np.exp(l)) - goal) / (1 - d * x)
        l = l - np.clip(move, -3, 3)
        if np.max(np.abs(move), initial=0) < 1e-8:
            break
    v, g, m, k2 = tilted(l, d)
    mode = y * g / d
    wide = 7.5 * np.sqrt(mode * k2 / (k2 + m * m)) + 2
    low, high = np.clip(np.floor(mode - wide), 1, c), np.clip(np.ceil(mode + wide), 1, c)
    each = high - low < NODES
    step = np.where(each, 1.0, (high - low) / (NODES - 1))
    t = low[:, None] + step[:, None] * np.arange(NODES)
    out = t > high[:, None] + 0.5
    t = np.minimum(t, high[:, None])
    w = log_seatings(np.repeat(c, NODES), t.ravel(), d).reshape(t.shape) + t * np.log(y)[:, None]
    w = np.where(out, -np.inf, w)
    w = np.exp(w - w.max(axis=1)[:, None])
    part = np.where(each[:, None], w, np.pad((w[:, 1:] + w[:, :-1]) / 2, ((0, 0), (0, 1))))
    total = np.cumsum(part, axis=1)
    aim = u * total[:, -1]
    i = np.minimum((total < aim[:, None]).sum(axis=1), NODES - 1)
    row = np.arange(len(c))
    f, h = w[row, i], w[row, np.minimum(i + 1, NODES - 1)]
    within = np.clip((aim - total[row, i] + part[row, i]) / np.maximum(part[row, i], 1e-300), 0, 1)
    root = np.sqrt(f * f + within * (h * h - f * f))
    inside = within * (f + h) / np.maximum(f + root, 1e-300)  # where the linear density's integral reaches ``within``
    return np.clip(np.where(each, t[row, i], np.rint(low + step * (i + inside))), 1, c)


def seat_dishes(c: np.ndarray, d: float, y: np.ndarray, key: np.ndarray, stream: int) -> np.ndarray:
    """Tables of every dish, drawn from their conditional law: P(t) in proportion to S(c, t) y^t; none without customers."""
    t = (c > 0).astype(np.float64)
    order = np.argsort(c, kind="stable")
    order = order[np.searchsorted(c[order], 2):]
    sizes, first = np.unique(c[order], return_index=True)
    log_y, u = np.log(y[order]), uniform(key[order], stream)
    for n, i, j in zip(sizes, first, np.append(first[1:], len(order))):
        if n > RECURRED:
            i, j, chunk = i, len(order), 512
        else:
            chunk = max(1, (1 << 20) // int(n))
        for k in range(i, j, chunk):
            at = slice(k, min(k + chunk, j))
            if n > RECURRED:
                t[order[at]] = large_dishes(c[order[at]].astype(np.float64), d, y[order[at]], u[at])
            elif n == 2:
                t[order[at]] = 2 - (u[at] * (1 - d + np.exp(log_y[at])) < 1 - d)
            else:
                w = seatings(d)[n, 1:n + 1] + np.arange(1, n + 1) * log_y[at, None]
                w = np.cumsum(np.exp(w - w.max(axis=1)[:, None]), axis=1)
                t[order[at]] = 1 + (w[:, :-1] < u[at, None] * w[:, -1:]).sum(axis=1)
        if n > RECURRED:
            break
    return t


class Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def tokenised(docs: DataFrame) -> DataFrame:
    """One row per block of whole texts, written to the shared folder, bucketed by block."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        numbers, held, docs, learn, size = Numbers({b"\n": END, b"\t": START}), [], [], [], 0

        def block():
            words = np.array([xxhash.xxh64_intdigest(w, 7) for w in numbers], np.uint64)
            ids = np.concatenate(held)
            sizes = np.array([len(h) for h in held], np.int64)
            null = np.array([x is None for x in docs])
            row = [(part << 32) + count, pack(np.array([x or 0 for x in docs], np.int64)), pack(null), pack(np.array(learn)), pack(sizes), pack(ids), pack(words), len(ids)]
            kinds = [pa.int64(), *[pa.binary()] * 6, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["block", "docs", "nulls", "learn", "sizes", "ids", "words", "tokens"])

        for b in slices(batches, 256):
            for doc, keep, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2))):
                words = text.lower().split()
                ids = np.empty(len(words) + 1, np.uint32)
                ids[:-1] = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
                ids[-1] = END
                held.append(ids), docs.append(doc), learn.append(keep)
                size += len(ids)
                if size >= TOKENS:
                    yield block()
                    count += 1
                    numbers, held, docs, learn, size = Numbers({b"\n": END, b"\t": START}), [], [], [], 0
        if held:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", 5) != 1).alias("learn"), F.col("text").cast("string")).mapInArrow(
        run, "block long, docs binary, nulls binary, learn binary, sizes binary, ids binary, words binary, tokens long")
    name = f"kestrel_llm_{uuid.uuid4().hex}"
    rows.write.option("path", scratch_path(spark, "blocks")).bucketBy(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name)
    return spark.table(name)


class Block:
    """A block's tokens, its words in hash order and its distinct pairs in hash order."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.docs, self.nulls = unpack(row["docs"], np.int64), unpack(row["nulls"], np.bool_)
        self.learn, self.sizes = unpack(row["learn"], np.bool_), unpack(row["sizes"], np.int64)
        self.ids, words = unpack(row["ids"], np.uint32), unpack(row["words"], np.uint64)
        order = np.argsort(words)
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        self.words = words[order]  # from here on words are numbered by hash order
        self.ids = rank[self.ids]
        self.end, self.start = int(rank[END]), int(rank[START])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.taught = np.repeat(self.learn, self.sizes)

    def pairs(self) -> None:
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[self.starts] = self.start
        both, self.at = np.unique(before.astype(np.uint64) << np.uint64(32) | self.ids, return_inverse=True)
        u, w = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        with np.errstate(over="ignore"):
            key = mixed(self.words[u] * np.uint64(0x9E3779B97F4A7C15) + self.words[w])
        order = np.argsort(key)
        rank = np.empty(len(key), np.int64)
        rank[order] = np.arange(len(key))
        self.at, self.key, self.u, self.w = rank[self.at], key[order], u[order], w[order]

    def messages(self, kind: int, keys: np.ndarray, columns: list[np.ndarray], shards: int) -> list[tuple]:
        """Rows for the shards: sorted keys as differences, columns side by side."""
        shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        out = []
        for s, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if i < j:
                step = keys[i:j].copy()
                step[1:] -= keys[i:j - 1]
                out.append((kind, s, self.block, pack(step), pack(np.concatenate([c[i:j] for c in columns]))))
        return out


def message_batch(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["kind", "shard", "block", "keys", "vals"])


def merge(table: pa.Table, columns: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(blocks, cuts, distinct keys, positions in them, summed columns, first of a key) of a shard's messages."""
    rows = sorted(zip(table["block"].to_pylist(), table["keys"].to_pylist(), table["vals"].to_pylist()))
    with np.errstate(over="ignore"):
        keys = [np.cumsum(unpack(r[1], np.uint64), dtype=np.uint64) for r in rows]
    vals = [unpack(r[2], np.int64).reshape(columns, -1) for r in rows]
    distinct, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    vals = np.concatenate(vals, axis=1)
    sums = [np.bincount(at, v, len(distinct)).astype(np.int64) for v in vals]
    cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    own = np.zeros(len(at), bool)
    own[first] = True
    return [r[0] for r in rows], cuts, distinct, at, sums, own


def answers(kind: int, shard: int, blocks, cuts, at, columns: list[np.ndarray], own: np.ndarray | None, stats: list[int]) -> pa.Table:
    rows = []
    for b, i, j in zip(blocks, cuts, cuts[1:]):
        rows.append((b, kind, shard, pack(np.concatenate([c[at[i:j]] for c in columns])), None if own is None else pack(own[i:j]), None))
    rows.append((-1, kind, shard, None, None, stats))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["block", "kind", "shard", "vals", "own", "stats"])


def totals(answered: DataFrame, kind: int, n: int) -> list[int]:
    r = answered.where((F.col("block") == -1) & (F.col("kind") == kind)).agg(*[F.sum(F.col("stats")[i]) for i in range(n)]).first()
    return [x or 0 for x in r]


class State:
    """What a block learns from the answers."""

    def __init__(self, block: Block, table: pa.Table, tables: int = TABLES):
        rows = sorted(zip(table["kind"].to_pylist(), table["shard"].to_pylist(), table["vals"].to_pylist(), table["own"].to_pylist()), key=lambda r: r[:2])

        def of(kind: int, columns: int) -> np.ndarray | None:
            parts = [unpack(v, np.int64).reshape(columns, -1) for k, _, v, _ in rows if k == kind]
            return np.concatenate(parts, axis=1) if parts else None

        self.count = of(WORDS, 1)[0]  # of every word in the learned texts
        self.pair = of(PAIRS, 1)[0]
        self.own = np.concatenate([unpack(o, np.bool_) for k, _, _, o in rows if k == PAIRS])
        self.tables = of(tables, 3 * CHAINS)
        self.large = of(LARGE, CHAINS)  # of the block's pairs with over ``RECURRED`` customers
        follow = self.count.copy()
        follow[block.start] = self.count[block.end]  # every learned text has one start
        self.follow = follow  # customers of each restaurant


SHARE, SIZE = 1 << 19, 1 << 18  # streams of the parent's shares and of the restaurants' sizes


def stream(sweep: int, chain: int) -> int:
    return (sweep * CHAINS + chain) << 20


class Model:
    """Fixed figures: learned tokens N, distinct V, discounts, and per chain the parent's totals.

    The totals are the parent's customers and tables, and of its drawn shares
    the part left for new tables and the sum of all.
    """

    def __init__(self, n: int, v: int, pair_discount: float, word_discount: float):
        self.n, self.v, self.d, self.d0 = n, v, pair_discount, word_discount
        self.totals: list[tuple[int, int, float, float]] | None = None

    def parent(self, s: State, chain: int) -> np.ndarray:
        """P(w) of the block's words."""
        if s.tables is None:  # before the first sweep: the words' own frequencies
            return (s.count + 0.5) / (self.n + 0.5 * (self.v + 1))
        customers, tables, _, _ = self.totals[chain]
        c, t = s.tables[CHAINS + chain], s.tables[2 * CHAINS + chain]
        return (c - self.d0 * t + (STRENGTH + self.d0 * tables) / (self.v + 1)) / (STRENGTH + customers)

    def share(self, b: Block, s: State, chain: int, sweep: int) -> np.ndarray:
        """The parent's shares of the block's words, drawn given the seating of the sweep before."""
        if s.tables is None:
            return self.parent(s, chain)
        _, _, rest, total = self.totals[chain]
        c, t = s.tables[CHAINS + chain], s.tables[2 * CHAINS + chain]
        return (gammas(c - self.d0 * t, b.words, stream(sweep - 1, chain) + SHARE) + rest / (self.v + 1)) / total

    def busy(self, s: State, chain: int) -> np.ndarray:
        """Tables of the block's restaurants; before the first sweep their prior mean."""
        if s.tables is not None:
            return s.tables[chain].astype(np.float64)
        n = s.follow.astype(np.float64)
        grown = np.exp(lgamma(n + STRENGTH + self.d) - lgamma(n + STRENGTH)
                       + float(lgamma(np.array([STRENGTH]))[0] - lgamma(np.array([STRENGTH + self.d]))[0]))
        return np.where(n > 0, np.maximum(STRENGTH / self.d * (grown - 1), 1.0), 0.0)

    def seat(self, b: Block, s: State, chain: int, sweep: int, at: np.ndarray) -> np.ndarray:
        """Tables of the block's pairs numbered ``at``, the same in each block that holds the pair."""
        size = gammas(STRENGTH / self.d + self.busy(s, chain), b.words, stream(sweep, chain) + SIZE)
        return seat_dishes(s.pair[at], self.d, self.d * size[b.u[at]] * self.share(b, s, chain, sweep)[b.w[at]], b.key[at], stream(sweep, chain))


def discount(one: int, two: int) -> float:
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


def score(docs: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; one row per document row.

    Learns from rows whose crc32(doc_id) mod 5 is not 1. Tokens: words of the
    text with A-Z in lower case, then one end. Null texts count as empty:
    their one token is the end. A null doc_id counts as the empty text for
    the split. Without learned texts the scores are those of one unknown token type.
    """
    if sweeps < 1:
        raise ValueError("at least one sweep seats the customers")
    spark = docs.sparkSession
    blocks = tokenised(docs)
    shards = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(blocks.agg(F.sum("tokens")).first()[0] or 0) // KEYS)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                n = np.bincount(b.ids[b.taught], minlength=len(b.words))
                rows = b.messages(WORDS, b.words, [n], shards)
                b.pairs()
                n = np.bincount(b.at[b.taught], minlength=len(b.key))
                rows += b.messages(PAIRS, b.key, [n], shards)
                yield from message_batch(rows).to_batches(max_chunksize=8)

    def count(table: pa.Table) -> pa.Table:
        kind, shard = table["kind"][0].as_py(), table["shard"][0].as_py()
        names, cuts, distinct, at, (n,), own = merge(table, 1)
        stats = [int((n > 0).sum()), int(n.sum()), int((n == 1).sum()), int((n == 2).sum())]
        return answers(kind, shard, names, cuts, at, [n], own if kind == PAIRS else None, stats)

    counted = stored(blocks.mapInArrow(send, MESSAGE).groupBy("kind", "shard").applyInArrow(count, ANSWER), "pitmanyor-counts")
    v, n, one, two = totals(counted, WORDS, 4)
    _, _, pair_one, pair_two = totals(counted, PAIRS, 4)
    model = Model(n, v, discount(pair_one, pair_two), discount(one, two))
    per_block = counted.where("block >= 0").drop("stats")
    heard, last, old = per_block, model, None
    for sweep in range(sweeps):
        rng = np.random.default_rng(sweep)
        sizes = [rng.gamma(STRENGTH / model.d0 + (model.totals[k][1] if model.totals else v)) for k in range(CHAINS)]  # of the parent

        def seat(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            for row in left.to_pylist():
                b = Block(row)
                b.pairs()
                s = State(b, right)
                columns: list[list[np.ndarray]] = [[], []]
                own = np.flatnonzero(s.own)  # the others are reported by their first blocks
                large = np.flatnonzero(s.pair > RECURRED)
                drawn = np.zeros((CHAINS, len(b.key)), np.int64)
                for chain in range(CHAINS):
                    t = model.seat(b, s, chain, sweep, own)
                    drawn[chain, own] = t
                    columns[0].append(np.bincount(b.u[own], t, len(b.words)).astype(np.int64))
                    columns[1].append(np.bincount(b.w[own], t, len(b.words)).astype(np.int64))
                rows += b.messages(TABLES, b.words, columns[0] + columns[1], shards)
                rows += b.messages(LARGE, b.key[large], list(drawn[:, large]), shards)
            return message_batch(rows)

        def parent(table: pa.Table) -> pa.Table:
            kind, shard = table["kind"][0].as_py(), table["shard"][0].as_py()
            if kind == LARGE:  # drawn once, where the pair comes first
                names, cuts, _, at, sums, _ = merge(table, CHAINS)
                return answers(LARGE, shard, names, cuts, at, sums, None, [])
            names, cuts, distinct, at, sums, _ = merge(table, 2 * CHAINS)
            seated, drawn = [], []
            for k in range(CHAINS):
                guests = sums[CHAINS + k]
                seated.append(seat_dishes(guests, model.d0, np.full(len(distinct), model.d0 * sizes[k] / (model.v + 1)), distinct, stream(sweep, k) + (1 << 60)).astype(np.int64))
                drawn.append(gammas(guests - model.d0 * seated[k], distinct, stream(sweep, k) + SHARE).sum() * UNIT)
            stats = [int(x) for x in (*(x.sum() for x in (*sums[CHAINS:], *seated)), *drawn)]
            return answers(TABLES, shard, names, cuts, at, sums + seated, None, stats)

        sent = blocks.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(seat, MESSAGE)
        seated = stored(sent.groupBy("kind", "shard").applyInArrow(parent, ANSWER), "pitmanyor-tables")
        found = totals(seated, TABLES, 3 * CHAINS)
        last = model
        model = Model(n, v, last.d, last.d0)
        model.totals = []
        for k in range(CHAINS):
            rest = rng.gamma(STRENGTH + model.d0 * found[CHAINS + k])
            model.totals.append((found[k], found[CHAINS + k], rest, rest + found[2 * CHAINS + k] / UNIT))
        now = seated.where("block >= 0").drop("stats")
        before, old = old, now
        heard = per_block.union(now)
    if before is not None:
        heard = heard.union(before.where(F.col("kind") == TABLES).withColumn("kind", F.lit(BEFORE)))

    def predict(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = Block(row)
            b.pairs()
            s, past = State(b, right), State(b, right, BEFORE)
            total, small, t = np.zeros(len(b.key)), s.pair <= RECURRED, np.zeros(len(b.key))
            for chain in range(CHAINS):
                t[small] = last.seat(b, past, chain, sweeps - 1, np.flatnonzero(small))  # the tables that the last sweep has reported
                if s.large is not None:
                    t[~small] = s.large[chain]
                p = model.parent(s, chain)[b.w]
                busy, guests = model.busy(s, chain)[b.u], s.follow[b.u]
                total += np.where(guests > 0, (np.maximum(s.pair - model.d * t, 0) + (STRENGTH + model.d * busy) * p) / (STRENGTH + guests), p)
            logp = np.log10(total / CHAINS)[b.at]
            base = np.log10((s.count + 0.5) / (n + 0.5 * (v + 1)))[b.ids]
            add = lambda x: np.add.reduceat(x, b.starts)
            mine = add(logp)
            out.append(pa.table([
                pa.array(b.docs, mask=b.nulls), pa.array(~b.learn), pa.array(b.sizes), pa.array(add((s.count > 0)[b.ids].astype(np.int64))),
                pa.array(np.full(len(b.docs), n)), pa.array(add(base)), pa.array(mine), pa.array(10 ** np.minimum(-mine / b.sizes, 300))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]))
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(
        predict, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
