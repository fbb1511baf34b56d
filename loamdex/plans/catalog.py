"""All registered queries of the engine with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamdex.plans import analytic_queries, lexical_queries, relational_queries, source_queries, stream_queries, text_queries, upkeep_queries, vector_queries  # noqa: F401
from loamdex.plans.registry import ENTRIES, Tables

Query = Callable[[SparkSession, str], DataFrame]


def _bound(run: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, folder: run(Tables(spark, folder))


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over documents, joined to their labels."""
    return ENTRIES["bm25_with_labels"].run(Tables(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {name: _bound(e.run) for name, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in ENTRIES.items() if e.sql}


def coverage() -> dict[str, list[str]]:
    """Inventory id -> names of the queries that cover it."""
    out: dict[str, list[str]] = {}
    for e in ENTRIES.values():
        for i in e.covers:
            out.setdefault(i, []).append(e.name)
    return out
