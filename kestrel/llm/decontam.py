"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by e = floor(rate * m)
edits. Cut into e + 1 pieces, at least one piece is then in the passage
unchanged. An Aho-Corasick automaton finds all piece hits of a text in one
pass; the windows they imply are merged per item and verified with Myers'
bit-parallel distance, so the result is exact for the given budget.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import slices, stored, text_of, unused, with_text

RATE = 0.07
ITEM_BYTES = 32 << 20  # text of the items held by a task at once; more items take more passes


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): the item in errors + 1 parts of nearly equal length."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best approximate occurrence in ``text``, the first of equals; None above ``most``."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = mask, 0, m, None
    get = peq.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(across | plus) & mask
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score <= most:
            best, most = (score, at + 1), score - 1
            if score == 0:
                break
        up, down = up << 1, down << 1
        plus = (down | ~((eq | minus) | up)) & mask
        minus = up & (eq | minus) & mask
    return best


class Matcher:
    """Finds the items of one batch in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, e) in enumerate(self.items):
            for offset, piece in pieces(t, e):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def __call__(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        text = normal(raw)
        if not self.any or not text:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (size, at) in self.automaton.iter(text):
            for n, offset in at:
                _, t, e = self.items[n]
                a = end + 1 - size - offset
                windows.setdefault(n, []).append([max(0, a - e), a + len(t) + e])
        found = []
        for n, spans in windows.items():
            item_id, t, e = self.items[n]
            spans.sort()
            merged = spans[:1]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            best = None
            for a, b in merged:
                hit = myers(t, text[a:b], e if best is None else best[0] - 1)
                if hit:
                    best = (hit[0], a + hit[1])
                    if hit[0] == 0:
                        break
            if best:
                found.append((item_id, best[0], max(0, best[1] - len(t) - best[0]), best[1]))
        return sorted(found)


def item_batches(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in batches of at most ``most`` bytes of text (or one item)."""
    batch, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null").toLocalIterator():
        t = normal(r["text"])
        if not t:
            continue
        if batch and size + len(t) > most:
            yield batch
            batch, size = [], 0
        batch.append((r["item_id"], t))
        size += len(t)
    yield batch


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, most: int = ITEM_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every document row, and ``hits``: items within their edit budget, nearest place each.

    Items are sent to the tasks in batches of bounded size; benchmarks above
    ``most`` bytes take one pass over the documents per batch. The rows are
    then numbered and written first, and hits of all passes meet by that
    number, so any number of passes gives one row per document row. Null or
    empty texts have no hits; null or empty items, and items with a null id,
    match nothing. Items with equal ids each report. A kept column called
    hits stays; the new one, always the last, then has a lengthened name.
    """
    spark, kept = docs.sparkSession, docs.select(*keep)
    hits = unused(kept, "hits")
    kind = "array<struct<item_id:long,distance:int,start:int,`end`:int>>"

    def one(rows: DataFrame, own: tuple[str, ...], items: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = Matcher(sent.value, rate)
            form = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            for b in slices(batches):
                found = [[dict(zip(("item_id", "distance", "start", "end"), h)) for h in match(t)] for t in text_of(b, own)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(own))), pa.array(found, form)], [*own, hits])

        out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*own).schema)
        return with_text(rows, own).mapInArrow(run, f"{out}`{hits}` {kind}")

    batches = item_batches(benchmark, most)
    first, second = next(batches), next(batches, None)
    if second is None:
        return one(docs, keep, first)
    rows = with_text(docs, keep)
    row = unused(rows, "row")
    rows = stored(rows.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = None
    for items in itertools.chain([first, second], batches):
        part = one(rows, (row,), items).where(F.size(hits) > 0)
        found = part if found is None else found.unionByName(part)
    found = found.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list(hits))).alias(hits))
    return rows.join(found, row, "left").select(*keep, F.coalesce(hits, F.array().cast(kind)).alias(hits))
