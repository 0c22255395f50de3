"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

Text is written as in SentencePiece: a leading mark, each space as a mark
(U+2581). Walking the text once, every piece that ends at a position comes
from the automaton (its output links included) and relaxes the best score
there; a character that no piece covers costs the least score minus 10 and is
written as its UTF-8 bytes. Equal scores take the longer last piece. No piece
holds a mark after another character, so the best path of a text is the
concatenation of the best paths of its chunks (mark and following
characters); chunks repeat and are remembered per task, within a bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import slices, text_of, unused, with_text

MARK = "▁"
UNKNOWN_COST = 10.0
REMEMBERED = 400_000  # chunks a task keeps
CHUNK = re.compile(f"{MARK}*[^{MARK}]*")


def load_pieces(path: str) -> tuple[list[tuple[int, str, float]], list[int]]:
    """(id, piece, score) of the ordinary pieces of a model file, and the ids of the 256 byte pieces."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, byte = [], [-1] * 256
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            plain.append((i, sp.id_to_piece(i), sp.get_score(i)))
    return plain, byte


class Codec:
    """Encoder and decoder over a vocabulary."""

    def __init__(self, plain: list[tuple[int, str, float]], byte: list[int]):
        if min(byte) < 0:
            raise ValueError("the vocabulary has no byte pieces; a round trip needs them")
        self.automaton = ahocorasick.Automaton()
        for i, p, s in plain:
            if MARK in p.lstrip(MARK):
                raise ValueError(f"piece {p!r} has a mark after another character")
            self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        self.byte = byte
        self.pairs = {p[k:k + 2] for _, p, _ in plain for k in range(len(p) - 1)}
        self.alphabet = {p for _, p, _ in plain if len(p) == 1}
        self.unknown = min((s for _, _, s in plain), default=0.0) - UNKNOWN_COST
        self.raw = {i: p.replace(MARK, " ").encode() for i, p, _ in plain}
        self.raw |= {b: bytes([n]) for n, b in enumerate(byte)}
        self.memory: dict[str, bytes] = {}

    def viterbi(self, chunk: str) -> list[int]:
        """Ids of the best path of a chunk."""
        n = len(chunk)
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, float, int]] = [(0, 0.0, -1)] * (n + 1)
        # the automaton yields ends in order and, at one end, longer pieces first
        if self.alphabet.issuperset(chunk):
            for last, piece in self.automaton.iter(chunk):
                s = best[last + 1 - piece[0]] + piece[1]
                if s > best[last + 1]:
                    best[last + 1], back[last + 1] = s, piece
        else:
            ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
            for last, piece in self.automaton.iter(chunk):
                ends[last].append(piece)
            for last, found in enumerate(ends):
                for piece in (*found, (1, self.unknown, -1)):
                    s = best[last + 1 - piece[0]] + piece[1]
                    if s > best[last + 1]:
                        best[last + 1], back[last + 1] = s, piece
        path, at = [], n
        while at:
            size, _, i = back[at]
            if i < 0:
                path.extend(self.byte[b] for b in reversed(chunk[at - 1].encode()))
            else:
                path.append(i)
            at -= size
        path.reverse()
        return path

    def chunk_ids(self, chunk: str) -> bytes:
        got = self.memory.get(chunk)
        if got is None:
            end = len(chunk)
            while end > 2 and chunk[end - 2:end] not in self.pairs:  # no piece crosses there
                end -= 1
            if end < len(chunk):
                got = b"".join([self.chunk_ids(chunk[:end]), *map(self.chunk_ids, chunk[end:])])
            else:
                got = np.array(self.viterbi(chunk), np.int32).tobytes()
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            if len(chunk) < 64:
                self.memory[chunk] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. A mark in the text itself is written as bytes, so decoding restores it."""
        if not text:
            return np.empty(0, np.int32)
        if MARK in text:
            out = []
            for k, part in enumerate(text.split(MARK)):
                if k:
                    out.extend(self.byte[b] for b in MARK.encode())
                body = (" " if not k else "") + part
                out.extend(i for c in CHUNK.findall(body.replace(" ", MARK)) if c for i in np.frombuffer(self.chunk_ids(c), np.int32).tolist())
            return np.array(out, np.int32)
        memory, own = self.memory, self.chunk_ids
        words = text.split(" ")
        if "" in words:
            chunks = [c for c in CHUNK.findall((" " + text).replace(" ", MARK)) if c]
        else:
            chunks = [MARK + w for w in words]
        return np.frombuffer(b"".join([memory.get(c) or own(c) for c in chunks]), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the leading space that encoding adds is dropped."""
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ids (array<int>), n_tokens and round_trip (decoding the ids gives the text back).

    Where a kept column has one of these names, the new one's is lengthened
    (``common.unused``); the new columns are always the last three.

    Null texts have null ids, 0 tokens and round_trip true; empty texts have
    no ids. The vocabulary (bounded by its file) is read on the driver and
    sent to the tasks, so ``path`` need only exist there. Repeated rows give
    repeated results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(path))
    kept = docs.select(*keep)
    schema, new = kept.schema, [unused(kept, c) for c in ("ids", "n_tokens", "round_trip")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*sent.value)
        for b in slices(batches, 128):
            texts = text_of(b, keep)
            each = [codec.encode(t or "") for t in texts]
            same = [codec.decode(e.tolist()) == (t or "") for e, t in zip(each, texts)]
            sizes = np.array([len(e) for e in each], np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            null = np.array([t is None for t in texts] + [False])
            ids = pa.ListArray.from_arrays(pa.array(offsets, mask=null), pa.array(np.concatenate(each) if each else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), ids, pa.array(sizes), pa.array(same)], [*keep, *new])

    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema)
    return with_text(docs, keep).mapInArrow(run, f"{out}`{new[0]}` array<int>, `{new[1]}` int, `{new[2]}` boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` with ``text`` restored from ``ids``; null ids give a null text."""
    sent = encoded.sparkSession.sparkContext.broadcast(load_pieces(path))
    keep = [c for c in encoded.columns if c not in ("ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*sent.value)
        for b in slices(batches, 128):
            texts = [None if x is None else codec.decode(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], [*keep, "text"])

    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.select(*keep).schema)
    return encoded.select(*keep, "ids").mapInArrow(run, f"{out}text string")
