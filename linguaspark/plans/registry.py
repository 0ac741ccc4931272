"""Registered queries: one Spark job per operator group, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame over the whole test
tables; ``ORACLE[name]`` is the same relation in ANSI SQL over the raw
parquet views. Queries without an SQL form (model calls with Python
providers, approximate search) have no oracle entry and are checked by
brute force in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from . import q_catalog, q_glossary, q_import, q_inference, q_jobs, q_memory, q_stream, q_usage  # noqa: F401


_load_all()
