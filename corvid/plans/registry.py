"""Registry of named queries: a Spark builder plus (optionally) a DuckDB oracle.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver tables; the oracle is the same computation in DuckDB SQL over the
same parquet tables, used only for verification.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import oracle as _oracle

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(key: str, views: tuple[str, ...] = (), oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = _oracle(views, oracle)
        return fn
    return deco


def load_all() -> None:
    # importing the modules registers their queries
    from . import routing_queries, corpus_queries, chat_queries, eval_queries  # noqa: F401
