"""Evaluation and reporting: ranks and errors, percentiles, slices, comparisons, significance, calibration."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile_at(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], rounded: bool = False) -> DataFrame:
    """The value at index floor(share * (n - 1)) of each key, or at the index rounded half to even.

    Ranks and counts are windows; no group is collected into one row.
    """
    by = Window.partitionBy(*keys)
    rank = F.row_number().over(by.orderBy(value)) - 1
    rows = df.where(F.col(value).isNotNull()).withColumn("_i", rank).withColumn("_n", F.count("*").over(by))
    index = lambda p: (F.bround if rounded else F.floor)((F.col("_n") - 1) * F.lit(p)).cast("long")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.max(F.when(F.col("_i") == index(p), F.col(value))).alias(f"p{round(p * 100)}") for p in shares])


def top_share(df: DataFrame, value: str, share: float, tie: str) -> DataFrame:
    """The part of the total that the top ceil(share * n) rows hold.

    Counts and sums by value say at which value the top ends; only rows of that value are counted in part.  No row is sorted.
    """
    by = df.groupBy(value).agg(F.count("*").alias("_c"))
    parts = by.withColumn("_r", F.floor(F.log2(F.abs(F.col(value)) + 1) * F.signum(F.col(value)) * 8).cast("int"))
    ranges = parts.groupBy("_r").agg(F.sum("_c").alias("_rc"), F.sum(F.col("_c") * F.col(value)).alias("_rs"))
    above = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)  # some hundred ranges
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_rc").over(above), F.lit(0))).withColumn("_sum", F.coalesce(F.sum("_rs").over(above), F.lit(0)))
    totals = df.agg(F.count("*").alias("_n"), F.sum(value).alias("_total"))
    within = Window.partitionBy("_r").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    cut = ranges.crossJoin(F.broadcast(totals)).withColumn("_k", F.ceil(F.col("_n") * share)).where("_before < _k and _before + _rc >= _k")  # one range
    inside = parts.join(F.broadcast(cut), "_r").withColumn("_b", F.col("_before") + F.coalesce(F.sum("_c").over(within), F.lit(0)))
    inside = inside.withColumn("_take", F.greatest(F.lit(0), F.least(F.col("_c"), F.col("_k") - F.col("_b"))))
    out = inside.groupBy("_k", "_total", "_sum").agg(F.sum(F.col("_take") * F.col(value)).alias("_in"))
    return out.select(F.col("_k").cast("long").alias("rows"), ((F.col("_sum") + F.col("_in")) / F.col("_total")).alias("concentration"))


def slices(df: DataFrame, members: Column, measures: dict[str, Column]) -> DataFrame:
    """A row counts in every slice it belongs to."""
    return df.withColumn("slice", F.explode(members)).groupBy("slice").agg(F.count("*").alias("n"), *[m.alias(k) for k, m in measures.items()])


def ir_metrics(ranked: DataFrame, relevant: DataFrame, query: str = "query_id", item: str = "id", rank: str = "rank", grade: str = "grade", k: int = 10) -> DataFrame:
    """Per query precision@k (over k), recall@k (over all relevant), reciprocal rank and graded NDCG@k; ranks from 1."""
    hits = ranked.join(relevant.select(query, item, grade), [query, item], "left").withColumn("g", F.coalesce(F.col(grade), F.lit(0)))
    gain = F.when((F.col(rank) <= k), F.col("g") / F.log2(F.col(rank) + 1)).otherwise(0.0)
    per = hits.groupBy(query).agg(
        (F.sum(F.when((F.col("g") > 0) & (F.col(rank) <= k), 1).otherwise(0))).alias("_hit"), F.min(F.when(F.col("g") > 0, F.col(rank))).alias("_first"), F.sum(gain).alias("_dcg")
    )
    ideal = Window.partitionBy(query).orderBy(F.desc(grade), item)
    best = relevant.withColumn("_r", F.row_number().over(ideal)).groupBy(query).agg(F.count("*").alias("_rel"), F.sum(F.when(F.col("_r") <= k, F.col(grade) / F.log2(F.col("_r") + 1)).otherwise(0.0)).alias("_idcg"))
    both = best.join(per, query, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        query,
        zero(F.col("_hit") / k).alias("precision"),
        zero(F.col("_hit") / F.col("_rel")).alias("recall"),
        zero(1 / F.col("_first")).alias("mrr"),
        zero(F.when(F.col("_idcg") > 0, F.col("_dcg") / F.col("_idcg"))).alias("ndcg"),
    )


def error_rates(truth: Column, said: Column) -> Column:
    """struct(cer, wer_words, accuracy); null where the truth is empty, above one where more is wrong than there is."""
    edits = F.levenshtein(truth, said)
    cer = F.when(F.length(truth) > 0, edits / F.length(truth))
    return F.struct(cer.alias("cer"), F.greatest(1 - cer, F.lit(0.0)).alias("accuracy"))


def bag_compare(a: DataFrame, b: DataFrame, key: str, word: str) -> DataFrame:
    """Per key how many words (as multisets) are found, missed and added."""
    count = lambda df, name: df.groupBy(key, word).agg(F.count("*").alias(name))
    both = count(a, "na").join(count(b, "nb"), [key, word], "full_outer").fillna(0, ["na", "nb"])
    return both.groupBy(key).agg(F.sum(F.least("na", "nb")).alias("found"), F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))).alias("missed"), F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))).alias("added"))


def regression(base: DataFrame, current: DataFrame, keys: Sequence[str], threshold: float = 5.0) -> DataFrame:
    """Each metric of two runs (value, higher_is_better): UNCHANGED within the threshold, IMPROVED, REGRESSED or NOT_COMPARABLE."""
    rows = current.join(base.select(*keys, F.col("value").alias("base")), list(keys))
    delta = (F.col("value") - F.col("base")) / F.abs("base") * 100
    good = F.when(F.col("higher_is_better"), delta > 0).otherwise(delta < 0)
    zero = F.abs("base") < 1e-9
    verdict = (
        F.when(F.col("base").isNull() | F.col("value").isNull(), "NOT_COMPARABLE")
        .when(zero & (F.abs(F.col("value") - F.col("base")) < 1e-9), "UNCHANGED")
        .when(zero, "NOT_COMPARABLE")
        .when(F.abs(delta) <= threshold, "UNCHANGED")
        .when(good, "IMPROVED")
        .otherwise("REGRESSED")
    )
    return rows.withColumn("delta", F.when(~zero, delta)).withColumn("verdict", verdict)


def mcnemar(only_a: int, only_b: int) -> float:
    """The exact two-sided probability of a split at least as uneven, of discordant pairs."""
    n = only_a + only_b
    if not n:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(min(only_a, only_b) + 1)) / 2**n
    return min(1.0, 2 * tail)


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, steps: int = 200, non_negative: bool = False) -> np.ndarray:
    """Intercept and weights by Newton's method; with ``non_negative`` no weight is below zero: those that want to be are held at zero, and the
    others are solved for again until none changes sides."""
    x = np.column_stack([np.ones(len(features)), features])
    w, held = np.zeros(x.shape[1]), np.zeros(x.shape[1], bool)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (labels - p) - ridge * w
        if non_negative:
            held[1:] = (w[1:] <= 0) & (slope[1:] <= 0)
        free = np.flatnonzero(~held)
        own = x[:, free]
        step = np.linalg.solve((own * (p * (1 - p))[:, None]).T @ own + ridge * np.eye(len(free)), slope[free])
        if non_negative:  # no further than to the first weight that meets zero
            down = np.flatnonzero((free > 0) & (step < 0) & (w[free] > 0))
            reach = np.min(-w[free][down] / step[down], initial=1.0)
            step = step * reach
            step[(free > 0) & (w[free] <= 0) & (step < 0)] = 0
        w[free] += step
        w[1:] = np.where(non_negative & (np.abs(w[1:]) < 1e-12), 0, w[1:])
        if np.abs(step).max(initial=0) < 1e-10:
            break
    return w


def thresholds(scored: DataFrame, score: str, right: str, cuts: Sequence[float], precision: float = 0.95, least: int = 10) -> DataFrame:
    """Per threshold the rows at or above it and their precision, and whether it may be called sure."""
    rows = scored.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in cuts]))).where(F.col(score) >= F.col("cut"))
    out = rows.groupBy("cut").agg(F.count("*").alias("n"), F.avg(F.col(right).cast("double")).alias("precision"))
    return out.withColumn("sure", (F.col("n") >= least) & (F.col("precision") >= precision))


def islands(df: DataFrame, keys: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Contiguous runs of rows where the flag holds: (keys, first, last, n)."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_on", flag).withColumn("_all", F.row_number().over(w)).withColumn("_run", F.col("_all") - F.sum(F.when(F.col("_on"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("_on").groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def plan_costs(plans: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Of each item's feasible plans the one with the least weighted cost, ties to the first name."""
    score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return plans.where("feasible").withColumn("score", score).groupBy("item").agg(F.min(F.struct("score", "family")).alias("b")).select("item", "b.family", "b.score")


def fact_scores(found: DataFrame, truth: DataFrame, item: str) -> DataFrame:
    """Per kind of fact how many found are right (precision) and how many true ones are found (recall); rows (item, kind, value), compared without case
    and spaces."""
    norm = lambda df: df.select(item, "kind", F.upper(F.regexp_replace(F.col("value").cast("string"), r"[\s-]", "")).alias("v")).distinct()
    a, b = norm(found).withColumn("f", F.lit(1)), norm(truth).withColumn("t", F.lit(1))
    both = a.join(b, [item, "kind", "v"], "full_outer").groupBy("kind").agg(F.count("f").alias("found"), F.count("t").alias("true"), F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("right"))
    return both.select("kind", "found", "true", "right", (F.col("right") / F.nullif("found", F.lit(0))).alias("precision"), (F.col("right") / F.nullif("true", F.lit(0))).alias("recall"))


def ablation(lines: DataFrame, item: str, reading: str, text: str) -> DataFrame:
    """(item, reading, lost_lines, line_recall, char_recall) of an item's lines when a reading is left out: a line is kept if a line of another reading
    holds it.

    A line is compared with the lines of its own item that are as long at least and share its first word.
    """
    norm = F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))
    rows = lines.select(item, reading, norm.alias("line")).where("line <> ''").distinct()
    whole = rows.groupBy(item, "line").agg(F.collect_set(reading).alias("by"))  # readings of an item: a few
    # every word of a line names it; a line that holds another has that one's first word
    words = lambda df: df.select(item, F.explode(F.array_distinct(F.split("line", " "))).alias("word"), F.col("line").alias("holder"), reading)
    held = whole.select(item, "line", F.substring_index("line", " ", 1).alias("word"))
    # the first word may be the end of a longer one in the holder, so words are named by their ends
    ends = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substr("word", i, F.length("word")))
    holders = words(rows).withColumn("word", F.explode(ends))
    # a line of one word may stand inside a word, at any place
    single = whole.where(~F.contains("line", F.lit(" "))).select(item, "line").join(rows.select(item, reading, F.col("line").alias("holder")), item).where(F.contains("holder", F.col("line")))
    pairs = held.where(F.contains("line", F.lit(" "))).join(holders, [item, "word"]).where(F.contains("holder", F.col("line"))).select(item, "line", reading)
    kept_by = pairs.union(single.select(item, "line", reading)).distinct()
    readings = rows.select(item, reading).distinct()
    survive = kept_by.withColumnRenamed(reading, "_other").join(readings, item).where(F.col("_other") != F.col(reading)).select(item, "line", reading).distinct().withColumn("_kept", F.lit(1))
    every = whole.select(item, "line").join(readings, item).join(survive, [item, "line", reading], "left")
    out = every.groupBy(item, reading).agg(F.count(F.when(F.col("_kept").isNull(), 1)).alias("lost_lines"), F.count("*").alias("_n"), F.sum(F.length("line")).alias("_c"), F.sum(F.when(F.col("_kept").isNull(), F.length("line")).otherwise(0)).alias("_lc"))
    return out.select(item, reading, "lost_lines", (100 * (F.col("_n") - F.col("lost_lines")) / F.col("_n")).alias("line_recall"), (100 * (F.col("_c") - F.col("_lc")) / F.col("_c")).alias("char_recall"))


def best_setting(rows: DataFrame, settings: DataFrame, shown: Column, right: str, weight: float = 0.5) -> DataFrame:
    """Of a few settings (broadcast) the one whose shown rows have the most right ones less ``weight`` times the wrong ones, as shares of all; ties to
    the first by ``setting``."""
    tried = rows.crossJoin(F.broadcast(settings)).withColumn("_shown", shown)
    score = tried.groupBy(*settings.columns).agg((F.avg(F.when(F.col("_shown") & F.col(right), 1.0).otherwise(0.0)) - weight * F.avg(F.when(F.col("_shown") & ~F.col(right), 1.0).otherwise(0.0))).alias("objective"))
    return score.withColumn("objective", F.round("objective", 9)).orderBy(F.desc("objective"), "setting").limit(1)
