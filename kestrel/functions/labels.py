"""Label books: code <-> name, verbalised predictions, report rows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrel.codebook import (ASPECT_CLASS_NAMES, ASPECT_CLASS_NAMES_VI, LABEL_NAMES,
                              LABEL_NAMES_VI, SEP_TOKEN, VERBALISE_PREFIXES)

BOOKS = {
    "label": dict(enumerate(LABEL_NAMES)),
    "aspect": dict(enumerate(ASPECT_CLASS_NAMES)),
    "label_vi": LABEL_NAMES_VI,
    "aspect_vi": ASPECT_CLASS_NAMES_VI,
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _map(book: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in book.items()))


def label_decode(code, book: str = "label") -> Column:
    """Code -> name; unknown codes give null."""
    return F.element_at(_map(BOOKS[book]), _col(code))


def label_encode(name, book: str = "label") -> Column:
    """Name -> code; unknown names give null."""
    return F.element_at(_map({v: k for k, v in BOOKS[book].items()}), _col(name)).cast("int")


def verbalise(label, aspects) -> Column:
    """Vietnamese text of four aspect predictions and the label, ``[SEP]``-separated.

    ``<prefix>: <value> [SEP] `` for the four aspects then the label, with
    the final trailing space removed.
    """
    a = _col(aspects)
    parts = []
    for i in range(4):
        parts += [F.lit(f"{VERBALISE_PREFIXES[i]}: "), label_decode(F.element_at(a, i + 1), "aspect_vi"),
                  F.lit(f" {SEP_TOKEN} ")]
    parts += [F.lit(f"{VERBALISE_PREFIXES[4]}: "), label_decode(_col(label), "label_vi"),
              F.lit(f" {SEP_TOKEN}")]
    return F.concat(*parts)
