"""Keeping derived rows current: staleness sweeps, batched fills with coverage, and new rules over stored rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def swept(rows: DataFrame, store: DataFrame, key: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(key, state) of every row and every stored one: KEEP, STALE (its text is another by now), ORPHAN (its row is gone) or MISSING.

    store: (key, hash).  A null text counts as empty.
    """
    now = rows.select(F.col(key).alias("_k"), digest(F.coalesce(F.col(text), F.lit(""))).alias("_now"))
    both = now.join(store.select(F.col(key).alias("_s"), F.col("hash").alias("_hash")), F.col("_k") == F.col("_s"), "full_outer")
    state = F.when(F.col("_k").isNull(), "ORPHAN").when(F.col("_s").isNull(), "MISSING").when(F.col("_now") == F.col("_hash"), "KEEP").otherwise("STALE")
    return both.select(F.coalesce("_k", "_s").alias(key), state.alias("state"))


def filled(rows: DataFrame, store: DataFrame, key: str, text: str, digest: Callable[[Column], Column], derive: Callable[[Column], Column], least_chars: int = 1, most: int | None = None) -> DataFrame:
    """The store after a pass (key, hash, value): orphans and stale rows go, and what is missing is derived, shortest keys first, ``most`` at a time.

    Rows of less than ``least_chars`` characters are not derived.
    """
    states = swept(rows, store, key, text, digest)
    keep = store.join(states.where("state = 'KEEP'"), key, "left_semi").select(key, "hash", "value")
    said = F.coalesce(F.col(text), F.lit(""))
    wanting = rows.where(F.length(said) >= least_chars).join(states.where("state in ('MISSING', 'STALE')"), key, "left_semi")
    wanting = wanting.select(key, said.alias("_t"))
    if most is not None:
        wanting = wanting.orderBy(key).limit(most)
    return keep.unionByName(wanting.select(key, digest(F.col("_t")).alias("hash"), derive(F.col("_t")).alias("value")))


def coverage(rows: DataFrame, store: DataFrame, key: str, group: str, text: str, least_chars: int = 1) -> DataFrame:
    """(group, eligible, covered): how many rows of each group should be in the store, and how many are."""
    eligible = rows.where(F.length(F.coalesce(F.col(text), F.lit(""))) >= least_chars).select(key, group)
    both = eligible.join(store.select(key, F.lit(1).alias("_in")).distinct(), key, "left")
    return both.groupBy(group).agg(F.count("*").alias("eligible"), F.count("_in").alias("covered"))


def rederived(rows: DataFrame, key: str, stored: str, rule: Column, version: int, current: int) -> DataFrame:
    """(key, old, new) of the rows that the rules in force give something else for; none where the stored version is the current one.

    Applying the changes makes a second pass empty.
    """
    if version == current:
        return rows.limit(0).select(key, F.col(stored).alias("old"), rule.alias("new"))
    return rows.select(key, F.col(stored).alias("old"), rule.alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))


def removed_everywhere(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """K6: what is left of each table (rows, its column of the key) without the removed ids."""
    return {name: rows.join(ids.select(F.col(key).alias(column)), column, "left_anti") for name, (rows, column) in tables.items()}
