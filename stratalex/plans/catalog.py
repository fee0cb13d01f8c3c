"""Registry of named queries: ``QUERIES`` builds DataFrames, ``ORACLES`` holds equivalent ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


from . import documents_q, ingest_q, legal_q, more_q, records_q, retrieval_q, stream_q, structure_q, temporal_q  # noqa: E402, F401  the modules register themselves
