"""Substring dedup by sliding spans of sentences.

From every sentence the shortest runs forwards and backwards that reach
``min_words`` words get a 64-bit hash each: one long sentence or several short
ones. So every sentence of a repeated stretch with at least ``min_words``
words lies in a run that is within the stretch. With a number ``span`` the
spans are the runs of so many sentences that have ``min_words`` words instead.
Spans are joined globally; the first place of a hash (by doc_id, then
position) stays, and the sentences that any later place covers are removed
from their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import row_id, slices, stored, text_bytes

SPAN = 3
MIN_WORDS = 12
SENTENCE = re.compile(rb"[^.!?\n]*(?:[.!?]+(?![\s.!?])[^.!?\n]*)*[.!?\n]*\s*")


def sentences(text: bytes) -> list[bytes]:
    """The text cut after stop marks with white space behind them and after line ends; joined they are the text."""
    return [x for x in SENTENCE.findall(text) if x]


def shortest_runs(sizes: list[int], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first sentences, numbers of sentences) of the shortest runs with ``min_words`` words that begin or end at each sentence."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    end = np.searchsorted(total, total[:n] + min_words)  # of the run that begins at each sentence
    first = np.flatnonzero(end <= n)
    begin = np.searchsorted(total, total[1:] - min_words, "right") - 1  # of the run that ends at each sentence
    last = np.flatnonzero(begin >= 0)
    both = np.unique(np.concatenate([first * (n + 1) + end[first], begin[last] * (n + 1) + last + 1]))
    pos = both // (n + 1)
    return pos, both % (n + 1) - pos


def span_hashes(text: bytes, span: int | None, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first sentences, numbers of sentences); only sentences that have words count."""
    own, sizes = [], []
    for s in sentences(text):
        words = s.lower().split()
        if words:
            own.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
            sizes.append(len(words))
    if span is None:
        pos, size = shortest_runs(sizes, min_words)
    else:
        n = max(0, len(own) - span + 1)
        total = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        pos = np.flatnonzero(total[span:span + n] - total[:n] >= min_words)
        size = np.full(len(pos), span)
    h = np.array(own, np.uint64)
    out = np.zeros(len(pos), np.uint64)
    on, j = np.arange(len(pos)), 0
    with np.errstate(over="ignore"):
        while len(on := on[size[on] > j]):
            x = (out[on] ^ h[pos[on] + j]) * np.uint64(0x9E3779B97F4A7C15)
            out[on] = x ^ (x >> np.uint64(29))
            j += 1
    return out.view(np.int64), pos.astype(np.int32), size.astype(np.int32)


def span_rows(docs: DataFrame, span: int | None, min_words: int) -> DataFrame:
    """(h, doc_id, rid, pos, size): one row per span; pos and size count the sentences that have words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            each = [span_hashes(t, span, min_words) for t in text_bytes(b.column(2))]
            h, pos, size = (np.concatenate(x) for x in zip(*each))
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(x[0]) for x in each]))
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(at), b.column(1).take(at), pa.array(pos), pa.array(size)], ["h", "doc_id", "rid", "pos", "size"])

    return (docs.select(F.col("doc_id").cast("long"), row_id().alias("rid"), F.col("text").cast("string"))
            .mapInArrow(run, "h long, doc_id long, rid long, pos int, size int"))


def repeated(docs: DataFrame, span: int | None = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, runs, first_docs): per document its spans that are not the first of their hash (first sentence * 2^32 + number of sentences), and where those are."""
    rows = stored(span_rows(docs, span, min_words), "spans")
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("rid"), F.col("pos"))
    # rows equal in doc_id and text give equal places: they are one document
    first = rows.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    later = rows.join(first, "h").where(place != F.col("first")).withColumn("run", F.shiftleft(F.col("pos").cast("long"), 32) + F.col("size"))
    return later.groupBy("rid").agg(F.sort_array(F.collect_set("run")).alias("runs"), F.sort_array(F.collect_set("first.doc_id")).alias("first_docs"))


def remove_repeats(docs: DataFrame, span: int | None = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without the covered sentences, n_sentences, removed (their numbers), first_docs (that hold the first places).

    One row per document row. Null and empty texts stay as they are. Rows
    equal in doc_id and text count as one document: neither repeats the
    other. A null doc_id comes after all others. ``span`` None takes runs of
    any number of sentences; with a number, passages of fewer sentences or of
    ones too short for ``min_words`` are not found.
    """
    marks = repeated(docs, span, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            text, count, removed = [], [], []
            for t, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts = sentences((t or "").encode())
                worded = [i for i, s in enumerate(parts) if s.split()]
                out = sorted({worded[(r >> 32) + j] for r in runs or () for j in range(r & 0xFFFFFFFF)})
                gone = set(out)
                count.append(len(worded))
                removed.append(out)
                text.append(t if not out else b"".join(s for i, s in enumerate(parts) if i not in gone).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(count, pa.int32()), pa.array(removed, pa.list_(pa.int32())), b.column(3)], ["doc_id", "text", "n_sentences", "removed", "first_docs"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_id().alias("rid"))
            .join(marks, "rid", "left").select("doc_id", "text", "runs", F.coalesce("first_docs", F.array().cast("array<long>")).alias("first_docs"))
            .mapInArrow(run, "doc_id long, text string, n_sentences int, removed array<int>, first_docs array<long>"))
