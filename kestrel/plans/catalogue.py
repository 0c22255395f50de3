"""Query catalogue: every operator run over the stand-in fixtures.

Each entry is ``name -> (callable(spark, sf_dir) -> DataFrame, oracle SQL)``.
The SQL is an independent DuckDB formulation over the same parquet
tables; doubles are rounded to 6 digits and counts cast to BIGINT on both
sides so results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` as query ``name`` with its oracle ``sql`` (None = rows only)."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}


def _load():
    # importing the modules fills REGISTRY
    from kestrel.plans import (q_metrics, q_registry, q_sequence, q_postings,  # noqa: F401
                               q_text, q_heads, q_messages, q_streaming)
