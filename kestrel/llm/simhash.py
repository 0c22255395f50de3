"""SimHash near-duplicates, linked through Golay-code keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The perfect
binary Golay code puts every 23-bit word within 3 bits of one codeword; the
codewords within 4 bits of a word (one, or six) are its keys, and two words at
most 2 bits apart share a key. Four differing bits over three segments leave
some two segments with at most 2 between them, so keys of segment pairs find
every pair of fingerprints at 4 bits or fewer. Candidates are verified by bit
count; only a spanning forest of the links of a bucket is emitted, never its
pairs. Copies share one fingerprint and are joined back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import components, row_id, slices, star, stored, text_bytes, unused

SEGMENTS = ((0, 23), (23, 23), (46, 18))
GENERATOR = 0b110001110101  # of the binary Golay code of length 23
MAX_BITS = 4  # what pairs of segments can find
BUCKET = 4096  # larger buckets are split into blocks of about this many


def shingle_hashes(text: bytes, k: int) -> bytes:
    """XXH64 (seed 42, big-endian) of every k-word shingle of a lower-cased text."""
    words = text.lower().split()
    if not words:
        return b""
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= k:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return b"".join([digest(joined[i:j], 42)
                     for i, j in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())])


def fingerprint(text: bytes, k: int = 4) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes; 0 without words."""
    raw = shingle_hashes(text, k)
    n, ones = len(raw) // 8, np.zeros(64, np.int64)
    bits = np.frombuffer(raw, np.uint8).reshape(n, 8)
    for i in range(0, n, 65536):
        ones += np.unpackbits(bits[i:i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, rid, fp): the fingerprint as a signed long, one row per document row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, k) for t in text_bytes(b.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "rid", "fp"])

    return docs.select(F.col("doc_id").cast("long"), row_id().alias("rid"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, rid long, fp long")


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of the upper 12 bits, and the error pattern of every remainder."""
    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    upper = np.array([remainder(x << 11) for x in range(4096)], np.int64)
    bits = [1 << i for i in range(23)]
    patterns = [0, *bits, *(a | b for a in bits for b in bits if a < b),
                *(a | b | c for a in bits for b in bits if a < b for c in bits if b < c)]
    errors = np.zeros(2048, np.int64)
    for p in patterns:
        errors[remainder(p)] = p
    return upper, errors


def segment_keys(words: np.ndarray, width: int, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(n, 6) indices of the codewords within 4 bits that a one-bit change decodes to; -1 pads."""
    upper, errors = tables
    flips = np.array([0, *(1 << i for i in range(width))], np.int64)
    near = words[:, None] ^ flips[None, :]
    index = (near ^ errors[upper[near >> 11] ^ (near & 2047)]) >> 11
    index.sort(axis=1)
    first = np.ones(index.shape, bool)
    first[:, 1:] = index[:, 1:] != index[:, :-1]
    out = np.full((len(words), 6), -1, np.int64)
    at = np.cumsum(first, axis=1) - 1
    rows = np.broadcast_to(np.arange(len(words))[:, None], index.shape)
    out[rows[first], at[first]] = index[first]
    return out


def bucket_keys(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp) rows: the keys of every two of the three segments."""
    u = fps.view(np.uint64)
    each = [segment_keys((u >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64), w, tables) for s, w in SEGMENTS]
    keys, owners = [], []
    for f, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = each[i][:, :, None], each[j][:, None, :]
        key = (f << 24) | (a << 12) | b
        ok = np.broadcast_to((a >= 0) & (b >= 0), key.shape)
        keys.append(key[ok])
        owners.append(np.broadcast_to(fps[:, None, None], key.shape)[ok])
    return np.concatenate(keys), np.concatenate(owners)


def near_in_runs(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links inside runs of equal (sorted) keys."""
    at, lag, a, b, held = np.arange(len(key)), 0, [], [], 0
    while True:
        lag += 1
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        near = at[np.bitwise_count((fp[at] ^ fp[at + lag]).view(np.uint64)) <= bits]
        if len(near):
            a.append(fp[near]), b.append(fp[near + lag])
            held += len(near)
            if held > 1 << 20:
                x, y = star(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], len(x)
    return star(np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def scan_runs(bits: int, limit: int):
    """mapInArrow body over rows (key, fp) sorted by key: edges (a, b), and (key, null) for runs above ``limit``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, over = np.empty(0, np.int64), np.empty(0, np.int64), None

        def edges(k, f, big):
            a, b = near_in_runs(k, f, bits)
            a, b = np.concatenate([a, big]), pa.array(np.concatenate([b, big]), mask=np.arange(len(a) + len(big)) >= len(a))
            return pa.RecordBatch.from_arrays([pa.array(a), b], ["a", "b"])

        for batch in batches:
            k, f = (batch.column(i).to_numpy() for i in range(2))
            if over is not None:
                k, f = k[k != over], f[k != over]
                if not len(k):
                    continue
                over = None
            k, f = np.concatenate([key, k]), np.concatenate([fp, f])
            starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
            sizes = np.diff(np.append(starts, len(k)))
            big = sizes > limit
            tail = 0 if big[-1] else sizes[-1]
            over = k[-1] if big[-1] else None
            keep = np.repeat(~big, sizes)
            if tail:
                keep[-tail:] = False
            yield edges(k[keep], f[keep], k[starts[big]])
            key, fp = (k[len(k) - tail:], f[len(f) - tail:])
        if len(key):
            yield edges(key, fp, key[:0])

    return run


def links(fps: DataFrame, bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between the distinct longs ``fp`` that connect all pairs at ``bits`` or fewer bits.

    A bucket above ``bucket`` rows is not held in one task: its rows are
    dealt into blocks, and every two blocks of it meet in a group of their own.
    """
    if bits > MAX_BITS:
        raise ValueError(f"segment pairs find at most {MAX_BITS} differing bits")
    tables = golay_tables()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            k, f = bucket_keys(b.column(0).to_numpy(), tables)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f)], ["key", "fp"])

    keys = fps.select("fp").mapInArrow(keyed, "key long, fp long")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(keys.repartition(n, "key").sortWithinPartitions("key", "fp")
                   .mapInArrow(scan_runs(bits, bucket), "a long, b long"), "simhash-links")
    edges = found.where("b is not null")
    large = found.where("b is null").select(F.col("a").alias("key")).distinct()
    if large.isEmpty():
        return edges
    hot = keys.join(large, "key")
    blocks = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(bucket)).alias("blocks"))
    dealt = (hot.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp"))
    more = (dealt.repartition(n, "key").sortWithinPartitions("key", "fp")
            .mapInArrow(scan_runs(bits, 1 << 62), "a long, b long"))
    return edges.union(more)


def grouped(docs: DataFrame, k: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(document rows with fp, distinct fp with their component's first document)."""
    marked = stored(fingerprints(docs, k), "simhash-fps")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")
    distinct = stored(marked.groupBy("fp").agg(F.min(place).alias("first")), "simhash-distinct")
    part = components(links(distinct, bits))
    rooted = distinct.join(part, distinct.fp == part.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return marked, rooted.drop("first").join(low, "root").select("fp", "first")


def simhash_groups(docs: DataFrame, k: int = 4, bits: int = MAX_BITS) -> DataFrame:
    """One row per document row: doc_id, fingerprint (hex), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and are linked like any other.
    Null ids are never the smallest; a component of null ids has a null id.
    Repeated rows give repeated results; other columns are ignored.
    """
    marked, named = grouped(docs, k, bits)
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, k: int = 4, bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with all columns, one of each component: the smallest doc_id (null last)."""
    _, named = grouped(docs, k, bits)
    rid = unused(docs, "rid")
    firsts = named.select(F.col("first.rid").alias(rid)).distinct()
    rows = docs.withColumn(rid, row_id()).join(firsts, rid, "left_semi")
    return rows.dropDuplicates([rid]).select(*docs.columns)  # rows equal in doc_id and text are one
