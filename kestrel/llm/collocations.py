"""Phrase collocations from FM-indexes over word ids.

Texts are cut into shards where they lie, one per language and some number of
words, so texts are never shuffled. Every shard keeps its words and the text
as word numbers. Words that are too rare in the whole language end a piece,
since no phrase with one can be frequent. Over what is left a shard builds a
bidirectional FM-index: suffixes of the text and of its reverse, sorted as
deep as phrases go, with their BWTs. Intervals of phrases are extended to the
right in the reverse BWT and to the left in the forward one, which lists every
phrase up to the depth with its count. Spark adds these up over all shards, a
length at a time: longer phrases are only looked for where their first and
their last words are frequent together, which a bit table of fixed size tells
without missing any. If it fills up, more rows are summed, with the same result.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import discard, slices, stored

#: words of a shard; a shard ends at the next end of a piece
SHARD = 3 << 18
#: ends of pieces as one byte that UTF-8 never has; A-Z in lower case; a tab is a space
BREAK = b"\xff"
TABLE = bytes(BREAK[0] if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: bits of the table of frequent phrases (a prime), and the numbers of its hash
BITS, FACTOR, FOLD = 67_108_859, 1_000_003, 2_147_483_647


class Index:
    """FM-index of whole numbers, suffixes sorted by their first ``depth`` numbers.

    ``text`` starts and ends with 0, which separates pieces. An interval of a
    phrase of at most ``depth`` numbers is exact.
    """

    def __init__(self, text: np.ndarray, depth: int):
        size, self.base = len(text), int(text.max()) + 1
        key, bound = text.astype(np.int64), self.base
        for i in range(1, depth):
            if bound * self.base >= 1 << 62:  # ranks instead of the numbers themselves
                key = np.unique(key, return_inverse=True)[1]
                bound = int(key.max()) + 1
            key = key * self.base
            key[:size - i] += text[i:]
            bound *= self.base
        order = np.argsort(key).astype(np.int32)
        del key
        self.bwt = text[order - 1]
        self.size = size
        # rows by (number before the suffix, row): where a number's suffixes start, and its ranks
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.base))])
        del order
        self.seen = self.bwt.astype(np.int64)
        self.seen *= size
        self.seen += np.arange(size, dtype=np.int32)
        self.seen.sort()

    def extend(self, low: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions of intervals to the left: (interval, number, its rows' start, rows, rows of smaller numbers)."""
        first = np.cumsum(length) - length
        key = np.arange(int(length.sum()), dtype=np.int64)
        key += np.repeat(low - first, length)  # the intervals' rows
        key = self.bwt[key].astype(np.int64)
        key += np.repeat(np.arange(len(low)) * self.base, length)
        key.sort()
        ends = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(ends, prepend=-1)
        of, number = key[ends] // self.base, key[ends] % self.base
        del key, ends
        before = np.cumsum(n) - n
        before -= first[of]  # rows of the interval with a smaller number
        keep = number > 0
        of, number, n, before = of[keep], number[keep], n[keep], before[keep]
        return of, number, np.searchsorted(self.seen, number * self.size + low[of]), n, before


def phrases(text: np.ndarray, depth: int, frequent: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of 2, 3, ... ``depth`` numbers with their counts, a length at a time.

    Extends to the right and to the left in turn, with both intervals kept
    in step, so each length costs one pass over the rows of the last. Phrases
    that ``frequent`` rules out are not extended, nor longer ones with such a
    phrase at either end given out.
    """
    backward = Index(text[::-1], depth)
    forward = Index(text, depth) if depth > 2 else backward  # both start a number's suffixes at the same row
    words = np.flatnonzero(np.diff(backward.start)[1:]) + 1
    found = words[:, None]
    lows, n = [forward.start[words], backward.start[words]], backward.start[words + 1] - backward.start[words]
    for size in range(2, depth + 1):
        right = size % 2 == 0
        of, number, low, n, before = (backward if right else forward).extend(lows[right], n)
        pair = (found[of], number[:, None])
        found = np.hstack(pair if right else pair[::-1])
        other = lows[not right][of] + before
        lows = [other, low] if right else [low, other]
        if frequent is not None:
            keep = np.ones(len(n), bool)
            if size > 2:
                keep = frequent(found[:, :-1]) & frequent(found[:, 1:])
            if size < depth:
                keep &= frequent(found)
            found, lows, n = found[keep], [x[keep] for x in lows], n[keep]
        yield found, n


def shards(docs: DataFrame, lang: str = "lang", size: int = SHARD) -> DataFrame:
    """Shards of the texts: shard, lang, words, counts of the words, and the text as numbers of ``words`` from 1 (0 ends a piece)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, defaultdict] = {}
        texts: dict[str, list[np.ndarray]] = defaultdict(list)
        held: dict[str, int] = defaultdict(int)

        def flush(name: str) -> pa.RecordBatch:
            book, text = numbers.pop(name), np.concatenate(texts.pop(name))
            held.pop(name)
            words = list(book)[1:]
            counts = np.bincount(text, minlength=len(words) + 1)[1:]
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([name]), pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                 pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([text.tobytes()])], names=["shard", "lang", "words", "counts", "text"])

        for b in slices(batches, 256):
            by: dict[str, list[bytes]] = defaultdict(list)
            for name, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    by[name].append(text)
            for name, all_texts in by.items():
                raw = BREAK.join(all_texts).translate(TABLE).replace(BREAK, b" \xff ").split()
                for at in range(0, len(raw), size):
                    if name not in numbers:
                        numbers[name] = defaultdict(count().__next__)
                        numbers[name][BREAK]
                    part = raw[at:at + size]
                    if at + size < len(raw):  # go on to the end of the piece
                        stop = at + size
                        while stop < len(raw) and raw[stop] != BREAK:
                            stop += 1
                        part, raw[at + size:stop] = raw[at:stop], [BREAK] * (stop - at - size)
                    text = np.fromiter(map(numbers[name].__getitem__, part), np.int32, len(part))
                    texts[name] += [text, np.zeros(1, np.int32)]
                    held[name] += len(part)
                    if held[name] >= size:
                        yield flush(name)
        for name in list(numbers):
            yield flush(name)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(build, "shard string, lang string, words array<string>, counts array<bigint>, text binary")


def dictionary(parts: DataFrame, least: int) -> DataFrame:
    """The words of all shards that occur ``least`` times in their language: lang, word, id, f."""
    pairs = parts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", "w.words", "w.counts")
    words = pairs.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    return words.withColumn("id", F.monotonically_increasing_id())


def known_words(parts: DataFrame, words: DataFrame) -> DataFrame:
    """Shards with the numbers and ids of their dictionary words: text, known."""
    own = parts.select("shard", "lang", F.posexplode("words").alias("at", "word")).join(words, ["lang", "word"])
    own = own.groupBy("shard").agg(F.collect_list(F.struct("at", "id")).alias("known"))  # at most the words of a shard
    own = stored(own, "colloc-ids")  # the shuffles of the words end before that of the texts
    return parts.select("shard", "text").join(own, "shard").select("text", "known")


def shard_phrases(known: DataFrame, size: int, tables: dict[int, bytes]) -> DataFrame:
    """Every shard's phrases of ``size`` dictionary words: w1, w2, ... (ids), n; ``tables`` are those of ``bit_table`` by length."""
    names = [f"w{i + 1}" for i in range(size)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            pairs = b.column(1)[0].values
            at, ids = np.asarray(pairs.field(0)) + 1, np.asarray(pairs.field(1))
            text = np.frombuffer(b.column(0)[0].as_py(), np.int32)
            code, order = np.zeros(max(int(text.max()), int(at.max())) + 1, np.int32), np.argsort(at)
            code[at[order]] = np.arange(1, len(at) + 1)
            text = code[text]
            kept = np.ones(len(text), bool)  # one 0 between pieces
            kept[1:] = (text[1:] > 0) | (text[:-1] > 0)
            text = np.concatenate([[0], text[kept], [0]]).astype(np.int32)
            table = np.concatenate([[-1], ids[order]])

            def frequent(found, table=table):
                bits = tables.get(found.shape[1])
                if bits is None:
                    return np.ones(len(found), bool)
                h = np.zeros(len(found), np.int64)
                for j in range(found.shape[1]):
                    h = (h * FACTOR + (table % FOLD)[found[:, j]]) % BITS
                return np.frombuffer(bits, np.uint8)[h >> 3] >> (h & 7).astype(np.uint8) & 1 > 0

            for found, n in phrases(text, size, frequent):
                if found.shape[1] < size:
                    continue
                for i in range(0, len(n), 1 << 16):
                    part = table[found[i:i + (1 << 16)]]
                    yield pa.record_batch([pa.array(part[:, j]) for j in range(size)] + [pa.array(n[i:i + (1 << 16)])], names=[*names, "n"])

    return known.mapInArrow(search, ", ".join(f"{c} bigint" for c in [*names, "n"]))


def bit_table(counts: DataFrame, size: int) -> bytes:
    """A bit for the hash of every phrase of ``counts``: ``BITS`` bits, however many phrases there are."""
    h = F.lit(0).cast("long")
    for i in range(size):
        h = F.pmod(h * FACTOR + F.pmod(F.col(f"w{i + 1}"), F.lit(FOLD)), F.lit(BITS))
    at = h + 1  # buckets and positions of the bitmap functions count from 1
    bits = bytearray(BITS // 8 + (1 << 12))
    rows = counts.select(at.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m"))
    for r in rows.collect():  # a row for 32768 bits
        bits[(r["b"] - 1) << 12:((r["b"] - 1) << 12) + len(r["m"])] = r["m"]
    return bytes(bits)


def collocations(docs: DataFrame, lang: str = "lang", depth: int = 3, least: int = 10, cover: int = 50, top: int = 2000, size: int = SHARD) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase is 2 to ``depth`` words inside one piece with a >= ``least``
    occurrences. Of its cuts in two parts (l and r occurrences) the one with
    the lowest score floor(1000000 a a / (l r)) counts, of equals the first.
    A phrase inside a longer one with 100 f >= ``cover`` a goes. Ties go by a,
    then by the phrase's bytes. A null language is ``und``; null and empty
    texts have no words; a language without such phrases gives no rows.
    Repeated rows count as often as they occur.
    """
    parts = stored(shards(docs, lang, size), "colloc-shards")
    words = stored(dictionary(parts, least), "colloc-words")
    totals = parts.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    totals = stored(totals, "colloc-totals")
    names = [f"w{i + 1}" for i in range(depth)]
    known = stored(known_words(parts, words), "colloc-known")
    discard(parts)
    counts, tables = [], {}
    for m in range(2, depth + 1):
        ids = [f"w{i + 1}" for i in range(m)]
        found = shard_phrases(known, m, tables).groupBy(*ids).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        counts.append(stored(found, "colloc-counts").select(*[F.col(c) if c in ids else F.lit(-1).cast("long").alias(c) for c in names], "f"))
        if m < depth:
            tables[m] = bit_table(counts[-1], m)
    discard(known)
    counts = reduce(DataFrame.union, counts)
    return ranked(counts, words, totals, names, cover, top)


def ranked(counts: DataFrame, words: DataFrame, totals: DataFrame, names: list[str], cover: int, top: int) -> DataFrame:
    """Scores, covered phrases and ranks from the summed counts."""
    depth, spark = len(names), counts.sparkSession
    length = sum(((F.col(c) >= 0).cast("int") for c in names[1:]), F.lit(1))
    counts = counts.withColumn("size", length)
    # phrases inside a longer one
    spans = [F.struct(*[F.col(names[i + j]).alias(names[j]) if j < k else F.lit(-1).cast("long").alias(names[j]) for j in range(depth)], F.lit(i + k).alias("stop"))
             for k in range(2, depth) for i in range(depth - k + 1)]
    rows = counts
    if spans:
        inside = counts.where(F.col("size") > 2).select("f", "size", F.explode(F.array(*spans)).alias("s"))
        inside = inside.where((F.col("s.stop") <= F.col("size")) & (F.col(f"s.{names[1]}") >= 0)).select(*[f"s.{c}" for c in names], "f", "size")
        # a phrase does not cover itself
        inside = inside.where(sum(((F.col(c) >= 0).cast("int") for c in names[1:]), F.lit(1)) < F.col("size"))
        inside = inside.groupBy(*names).agg(F.max("f").alias("longer"))
        rows = rows.join(inside, names, "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("f"))).drop("longer")
    parts = []
    for size in range(2, depth + 1):
        part = rows.where(F.col("size") == size)
        for i in range(size):  # words with their counts
            w = words.select(F.col("id").alias(names[i]), F.col("word").alias(f"t{i}"), F.col("f").alias(f"g{i}_{i + 1}"), *([F.col("lang")] if i == 0 else []))
            part = part.join(w, names[i])
        for k in range(1, size):  # longer parts are counted in the table itself
            for start, stop in ((0, k), (k, size)):
                if stop - start > 1:
                    own = counts.where(F.col("size") == stop - start)
                    part = part.join(own.select(*[F.col(names[j]).alias(names[start + j]) for j in range(stop - start)], F.col("f").alias(f"g{start}_{stop}")), names[start:stop])
        cuts = [F.struct(F.expr(f"(1000000 * (cast(f as decimal(19,0)) * cast(f as decimal(19,0)))) div (cast(g0_{k} as decimal(19,0)) * cast(g{k}_{size} as decimal(19,0)))").alias("score"),
                         F.lit(k).alias("k"), F.col(f"g0_{k}").alias("l"), F.col(f"g{k}_{size}").alias("r")) for k in range(1, size)]
        best = F.array_min(F.array(*cuts))  # the lowest score, then the first cut
        parts.append(part.select("lang", F.concat_ws(" ", *[f"t{i}" for i in range(size)]).alias("phrase"), F.col("f").alias("a"), best.alias("c")))
    rows = reduce(DataFrame.union, parts).select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    # the best of every part of a language first, so that no task sorts all of it
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
