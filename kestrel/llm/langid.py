"""Language identification by interpolated Kneser-Ney character models.

Text is lower-cased; a-z keep a symbol of their own, other letters share 37
by a hash, everything else is a space and runs of spaces are one. So a
character 4-gram is a 24-bit key: at most 2^24 n-grams per language, a proven
bound on the model whatever the corpus. Counts of all training texts become
one model per language; the models are stored as sorted key arrays with
interpolated log probabilities. A text gets the language of least cross-entropy per
symbol; it is rejected if that exceeds the language's threshold, a quantile
of the training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import crc_mod, slices, stored

QUANTILE = 0.999  # of training texts that their own language accepts
EVIDENCE = 40  # symbols after which the score's posterior takes no further weight
UNKNOWN = "und"


def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 no letter, 1-26 a-z, 27-63 other letters."""
    table = np.zeros(0x110000, np.uint8)
    letters = np.array([i for i in range(0x110000) if chr(i).isalpha()], np.int64)
    table[letters] = 27 + letters * 2654435761 % 4294967296 // 65536 % 37
    table[ord("a"):ord("z") + 1] = np.arange(1, 27)
    return table


def grams(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4-gram key at every symbol, text number at every symbol, has-letter per text)."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = table[points]
    own = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 1 for t in low])
    keep = symbols > 0
    lettered = np.bincount(own[keep], minlength=len(low)) > 0
    keep[1:] |= symbols[:-1] > 0
    symbols, own = symbols[keep], own[keep]
    at = np.arange(len(symbols)) + 3 * (own.astype(np.int64) + 1)  # three spaces stand before each text
    padded = np.zeros(len(symbols) + 3 * len(low) + 3, np.int32)
    padded[at] = symbols
    key = padded[:-3] << 18 | padded[1:-2] << 12 | padded[2:-1] << 6 | padded[3:]
    return key[at - 3], own, lettered


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n) over the training texts."""
    def merged(parts):
        k, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return k, np.bincount(inv, np.concatenate([p[1] for p in parts]), len(k)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = symbol_table(), {}
        for b in slices(batches, 1024):
            by: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                parts = held.setdefault(lang, [])
                parts.append(np.unique(grams(texts, table)[0], return_counts=True))
                if len(parts) > 8:
                    held[lang] = [merged(parts)]
        for lang, parts in held.items():
            k, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(n, pa.int64())], ["lang", "key", "n"])

    train = docs.where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = train.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, key int, n long")
    return rows.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def discount(counts: np.ndarray) -> float:
    """Kneser-Ney's absolute discount n1 / (n1 + 2 n2), kept inside (0, 1)."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.1


def kneser_ney(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log2 P at the sorted keys, log2 back-off weight of every 3-symbol context, log2 P of every trigram)."""
    def level(count: np.ndarray, lower: np.ndarray) -> np.ndarray:
        size, width = len(count), len(count) // 64
        d = discount(count[count > 0])
        total = count.reshape(width, 64).sum(axis=1)
        kinds = (count > 0).reshape(width, 64).sum(axis=1)
        below = lower[np.arange(size) % len(lower)].reshape(width, 64)
        with np.errstate(invalid="ignore", divide="ignore"):
            p = (np.maximum(count.reshape(width, 64) - d, 0) + (d * kinds)[:, None] * below) / total[:, None]
        return np.where(total[:, None] > 0, p, below).reshape(size)

    three = np.bincount(key & 0x3FFFF, minlength=1 << 18).astype(float)  # continuation counts
    two = np.bincount(np.flatnonzero(three) & 0xFFF, minlength=1 << 12).astype(float)
    one = np.bincount(np.flatnonzero(two) & 63, minlength=64).astype(float)
    p3 = level(three, level(two, level(one, np.full(64, 1 / 64))))
    d = discount(n)
    total = np.bincount(key >> 6, n, 1 << 18)
    kinds = np.bincount(key >> 6, minlength=1 << 18)
    back = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
    p4 = np.maximum(n - d, 0) / total[key >> 6] + back[key >> 6] * p3[key & 0x3FFFF]
    return tuple(np.log2(x).astype(np.float32) for x in (p4, back, p3))


class Models:
    """The languages' models over one sorted key array."""

    def __init__(self, rows: list[tuple[str, bytes, bytes, bytes, bytes]]):
        rows = sorted(rows, key=lambda r: r[0])
        self.langs = [r[0] for r in rows]
        keys = [np.frombuffer(r[1], np.int32) for r in rows]
        self.keys = np.unique(np.concatenate(keys))
        self.back = np.stack([np.frombuffer(r[3], np.float32) for r in rows], axis=1)
        self.three = np.stack([np.frombuffer(r[4], np.float32) for r in rows], axis=1)
        self.logp = self.back[self.keys >> 6] + self.three[self.keys & 0x3FFFF]
        for j, (k, r) in enumerate(zip(keys, rows)):
            self.logp[np.searchsorted(self.keys, k), j] = np.frombuffer(r[2], np.float32)

    def cross_entropy(self, key: np.ndarray, own: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(bits per symbol of every text and language, symbols of every text)."""
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        logp = self.logp[at]
        miss = np.flatnonzero(self.keys[at] != key)
        logp[miss] = self.back[key[miss] >> 6] + self.three[key[miss] & 0x3FFFF]
        size = np.bincount(own, minlength=texts)
        total = np.stack([np.bincount(own, logp[:, j], texts) for j in range(logp.shape[1])], axis=1)
        return -total / np.maximum(size, 1)[:, None], size


def train(docs: DataFrame) -> list[tuple]:
    """Model rows (lang, keys, log2 P, back-off, trigrams); each language's counts, at most 2^24 of them, meet in a task."""
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        key = frame["key"].to_numpy(np.int32)
        return pd.DataFrame([[frame["lang"].iloc[0], key.tobytes(), *(x.tobytes() for x in kneser_ney(key, frame["n"].to_numpy()))]])

    return [tuple(r) for r in gram_counts(docs).groupBy("lang").applyInPandas(
        build, "lang string, keys binary, logp binary, back binary, three binary").collect()]


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected; one row per document row.

    Learns from text and lang of rows whose crc32(doc_id) mod 4 is not 2.
    ``und`` (score 0, not rejected) if the text is null or has no letter, and
    for all texts if nothing can be learned. A null doc_id counts as the
    empty text for the split. Equal cross-entropies take the alphabetically
    first language. Score: posterior of the language under the models, with
    at most ``EVIDENCE`` symbols of weight, halved for rejected texts.
    """
    spark = docs.sparkSession
    rows = train(docs)
    ids = docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("lang").cast("string"), F.col("text").cast("string"))
    if not rows:
        return ids.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                          F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("rejected"))
    sent = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, table = Models(sent.value), symbol_table()
        names = np.array(models.langs, object)
        for b in slices(batches, 512):
            key, own, lettered = grams(b.column(3).to_pylist(), table)
            ce, size = models.cross_entropy(key, own, b.num_rows)
            best = ce.argmin(axis=1)
            least = ce[np.arange(len(best)), best]
            share = 1 / np.exp2((least[:, None] - ce) * np.minimum(size, EVIDENCE)[:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), b.column(2), pa.array(np.where(lettered, names[best], UNKNOWN), pa.string()),
                pa.array(np.where(lettered, share, 0.0)), pa.array(least, mask=~lettered)], ["doc_id", "held_out", "lang", "lang_pred", "share", "ce"])

    scored = stored(ids.mapInArrow(run, "doc_id long, held_out boolean, lang string, lang_pred string, share double, ce double"), "langid")
    limits = (scored.where("not held_out and lang = lang_pred").groupBy("lang_pred")
              .agg(F.percentile_approx("ce", QUANTILE, 10000).alias("most")))  # a row per language
    rejected = F.coalesce(F.col("ce") > F.col("most"), F.lit(False))
    return scored.join(F.broadcast(limits), "lang_pred", "left").select(
        "doc_id", "held_out", "lang_pred", F.when(rejected, F.col("share") / 2).otherwise(F.col("share")).alias("score"),
        F.col("ce").alias("cross_entropy"), rejected.alias("rejected"))
