"""Scans, filters, joins, ranking and table maintenance as functions of DataFrames.

All of them are plain Catalyst plans: predicates reach the scan, ranks are windows over a key, limits become
TakeOrderedAndProject, and maintenance gives new tables instead of changing rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first(df: DataFrame, ts: str, row_id: str) -> DataFrame:
    """Latest first, ties in stored order."""
    return df.orderBy(F.desc(ts), F.asc(row_id))


def page_after(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next page of a scan in key order; the predicate is pushed to the scan."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(limit)


def by_ids(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """S3: rows of a short list of ids, as a pushed-down predicate."""
    return df.where(F.col(key).isin(*ids))


def contains_any(column: Column, needles: Sequence[str]) -> Column:
    """Case-blind substring test for any of the needles; wildcards in a needle stand for themselves."""
    quoted = [n.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") for n in needles]
    return reduce(lambda a, b: a | b, [column.ilike(f"%{n}%") for n in quoted], F.lit(False))


def changed_since(found: DataFrame, stored: DataFrame, key: str, modified: str, read_at: str) -> DataFrame:
    """What a discovery run does with each found item: READ, READ_AGAIN or LEAVE."""
    known = stored.select(F.col(key).alias("_key"), F.col(read_at).alias("_read_at"))
    verdict = F.when(F.col("_key").isNull(), "READ").when(F.col(modified) > F.col("_read_at"), "READ_AGAIN").otherwise("LEAVE")
    return found.join(known, F.col(key) == F.col("_key"), "left").withColumn("decision", verdict).drop("_key", "_read_at")


def first_per(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_of_first_ties(df: DataFrame, key: str, order: Sequence[Column], tie: Column, best: Sequence[Column]) -> DataFrame:
    """Among a key's rows that tie with its first on ``tie``, the best by ``best``, else the first."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("_first", F.first(tie).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    marked = marked.withColumn("_same", F.when(tie.eqNullSafe(F.col("_first")), 0).otherwise(1))
    return first_per(marked, [key], [F.col("_same"), *best, *order]).drop("_first", "_same")


def keep_all_of(items: DataFrame, key: str, constraints: Sequence[DataFrame]) -> DataFrame:
    """Rows whose key every constraint lists; semi joins, smallest result early by Catalyst's choice."""
    return reduce(lambda df, c: df.join(c.select(F.col(key)).distinct(), key, "left_semi"), constraints, items)


def relaxing(strict: DataFrame, relaxed: DataFrame) -> tuple[DataFrame, bool]:
    """the strict result, or the relaxed one if the strict is empty."""
    empty = strict.isEmpty()
    return (relaxed, True) if empty else (strict, False)


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """K1: rows replace target rows of the same key; of several new rows the newest wins."""
    rows = first_per(rows, list(keys), newest)
    return target.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows.select(*target.columns))


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """K2: rows whose key the target lacks are added, the first of each key."""
    new = first_per(rows.join(target.select(*keys), list(keys), "left_anti"), list(keys), order)
    return target.unionByName(new.select(*target.columns))


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """K3: what stays after a DELETE; rows with an unknown condition stay."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def delete_orphans(target: DataFrame, parents: DataFrame, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a parent, orphans). A null key is an orphan."""
    ids = parents.select(F.col(parent_key).alias(key)).distinct()
    return target.join(ids, key, "left_semi"), target.join(ids, key, "left_anti")


def update_where(target: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """K4: columns set where the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return target.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def replace_documents(target: DataFrame, rows: DataFrame, document: str, key: str) -> tuple[DataFrame, DataFrame]:
    """K5: the table after all rows of the given documents are replaced, and the keys that went for good."""
    changed = rows.select(document).distinct()
    old = target.join(changed, document, "left_semi")
    gone = old.join(rows.select(key), key, "left_anti").select(key)
    return target.join(changed, document, "left_anti").unionByName(rows.select(*target.columns)), gone


def relink(documents: DataFrame, files: DataFrame, same: Sequence[tuple[str, str]]) -> DataFrame:
    """K8: documents with files that are the same by any of the pairs of columns, as one join per pair (no theta join)."""
    joined = [documents.join(files, (documents[a] == files[b]), "inner") for a, b in same]
    return reduce(DataFrame.unionByName, joined).distinct()


def compare_tables(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Per column how many keys are the same, differ, or stand in one table only."""
    columns = [c for c in a.columns if c != key]
    left = a.select(F.col(key).alias("_k"), F.lit(True).alias("_l"), *[F.col(c).alias(f"l_{c}_") for c in columns])
    right = b.select(F.col(key).alias("_k"), F.lit(True).alias("_r"), *[F.col(c).alias(f"r_{c}_") for c in columns])
    both = left.join(right, "_k", "full_outer")
    state = lambda c: F.when(F.col("_l").isNull(), "only_right").when(F.col("_r").isNull(), "only_left").when(F.col(f"l_{c}_").eqNullSafe(F.col(f"r_{c}_")), "same").otherwise("differs")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), state(c).alias("state")) for c in columns]))
    return both.select(pairs.alias("x")).groupBy("x.column", "x.state").agg(F.count("*").alias("n"))


def gap_sessions(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int, order: Sequence[str] = ()) -> DataFrame:
    """Adds ``session`` (from 1 per key): a gap strictly longer than ``gap_seconds`` opens a new one; rows without time are session 0."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    before = F.lag(ts).over(w)
    opens = F.when(before.isNull() | (F.col(ts) - before > F.expr(f"make_dt_interval(0, 0, 0, {gap_seconds})")), 1).otherwise(0)
    dated = df.where(F.col(ts).isNotNull()).withColumn("_opens", opens)
    dated = dated.withColumn("session", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")
    return dated.unionByName(df.where(F.col(ts).isNull()).withColumn("session", F.lit(0).cast("long")))


def add_column(df: DataFrame, name: str, default) -> DataFrame:
    """K9: a new column with a default, if it isn't there."""
    return df if name in df.columns else df.withColumn(name, F.lit(default))
