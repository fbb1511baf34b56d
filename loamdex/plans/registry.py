"""The register of queries: a name, a function (tables) -> DataFrame, the ids of what it covers, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of a folder by name: ``t.orders`` is ``orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[Tables], DataFrame]
    covers: tuple[str, ...]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function of tables under its name. covers: ids of the operator inventory."""

    def add(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or run.__name__
        if key in ENTRIES:
            raise ValueError(f"{key} is registered twice")
        ENTRIES[key] = Entry(key, run, tuple(covers.split()), sql)
        return run

    return add
