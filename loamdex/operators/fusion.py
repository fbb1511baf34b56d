"""Fusing ranked lanes into one result: reciprocal ranks, boosts, gates, chances, groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the fusion.
RRF_K = 60.0
LANES = {"bm25": 1.2, "substring": 1.1, "fuzzy": 0.6}
PHRASE, RATIO, NAME, ORDER, OPENED = 0.10, 0.06, 0.04, 0.10, 0.03
BOOSTS = {"organization": 1.5, "source_app": 1.4, "payment_app": 1.5, "document_type": 1.3, "default": 1.2, "category": 1.6}
SAYS = (-3.5844, 5.2243)
LOOKS = (-7.6766, 7.2518, 12.7806)
MEANING = (-2.4747, 0.6861, 1.7126)
GROUPS = ("SAYS", "NAME", "TAG", "NEAR_SPELLING", "FACT", "LOOKS", "MEANING")
SURE = {"SAYS": 1.01, "NEAR_SPELLING": 1.01, "FACT": 0.95, "LOOKS": 1.01, "MEANING": 1.01}
HALF_LIFE_DAYS, OPENED_MOST = 30, 2.0


def ranked(df: DataFrame, lane: str, order: Sequence[Column], limit: int) -> DataFrame:
    """(id, lane, rank from 0) of a lane's best rows; the limit comes first, so the rank is over few rows."""
    best = df.orderBy(*order).limit(limit)
    return best.select("id", F.lit(lane).alias("lane"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))


def fused(lanes: Sequence[DataFrame], weights: dict[str, float] = LANES) -> DataFrame:
    """(id, score) by weight / (60 + rank), summed over lanes."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    rows = reduce(DataFrame.unionByName, lanes)
    return rows.groupBy("id").agg(F.sum(weight[F.col("lane")] / (RRF_K + F.col("rank"))).alias("score"))


def boosted(scored: DataFrame, hits: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """The score times the boost of every preferred constraint whose ids list the row."""
    out = scored
    for i, (ids, kind) in enumerate(hits):
        out = out.join(ids.select("id").distinct().withColumn(f"_h{i}", F.lit(BOOSTS[kind])), "id", "left")
    factor = reduce(lambda a, b: a * b, [F.coalesce(F.col(f"_h{i}"), F.lit(1.0)) for i in range(len(hits))], F.lit(1.0))
    return out.withColumn("score", F.col("score") * factor).drop(*[f"_h{i}" for i in range(len(hits))])


def bonus(phrase: Column, said: Column, in_name: Column, run: Column, words: int) -> Column:
    """What the text adds: the phrase, the share of words said and named, and the longest run in order."""
    in_order = F.when(run >= 2, ORDER * (run - 1) / (words - 1)).otherwise(0.0) if words > 1 else F.lit(0.0)
    return F.when(phrase, PHRASE).otherwise(0.0) + RATIO * said / words + NAME * in_name / words + in_order


def standing(page_says: Column, said: Column, had: Column, near_page: Column, near_any: Column) -> Column:
    """5 to 0 by the strongest evidence of a row."""
    return F.when(page_says, 5).when(said > 0, 4).when(had > 0, 3).when(near_page, 2).when(near_any, 1).otherwise(0)


def opened_weight(opens: DataFrame, key: str, at: str, now: str) -> DataFrame:
    """(key, weight): opens decay by half in 30 days, two count at most."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp"))
    decayed = F.sum(F.pow(F.lit(0.5), age / (HALF_LIFE_DAYS * 86400)))
    return opens.groupBy(key).agg(F.least(F.lit(OPENED_MOST), decayed).alias("weight"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def says_chance(said: Column, words: int, similar_only: Column) -> Column:
    """The chance that a keyword result is right."""
    return sigmoid(SAYS[0] + SAYS[1] * F.when(similar_only, 0.0).otherwise(said / words if words else F.lit(0.0)))


def looks_chance(margin: Column, score: Column) -> Column:
    return sigmoid(LOOKS[0] + LOOKS[1] * margin + LOOKS[2] * score)


def meaning_chance(standing_: Column, margin: Column) -> Column:
    return sigmoid(MEANING[0] + MEANING[1] * standing_ + MEANING[2] * margin)


def grouped(hits: DataFrame, says_all: bool) -> DataFrame:
    """Hits (kind, rank, id, chance of the group) as groups in order, each id in the first group that lists it, with the group's verdict."""
    place = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), F.col("kind"))
    first = F.when((F.col("kind") == "SAYS") & F.lit(says_all), 0).otherwise(1)
    sure = F.create_map(*[F.lit(x) for kv in SURE.items() for x in kv])
    marked = hits.withColumn("_order", F.struct(first, -F.col("chance"), place))
    by_id = Window.partitionBy("id").orderBy("_order", "rank")
    kept = marked.withColumn("_n", F.row_number().over(by_id)).where("_n = 1")
    groups = kept.select("kind", "_order").distinct().withColumn("group_rank", F.row_number().over(Window.orderBy("_order")))  # a handful of groups
    out = kept.drop("_order", "_n").join(F.broadcast(groups.drop("_order")), "kind")
    return out.withColumn("verdict", F.when(F.col("chance") >= sure[F.col("kind")], "SURE").otherwise("POSSIBLE"))


def aliases(table: DataFrame, terms: Sequence[str], oldest: Column, least: float, most: int = 3) -> DataFrame:
    """The strongest learned stand-ins of each term."""
    w = Window.partitionBy("term").orderBy(F.desc("weight"), "stands_for")
    return table.where(F.col("term").isin(*terms) & (F.col("learned_at") >= oldest) & (F.col("weight") >= least)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


#: Seconds between two searches that may mean the same, what one such pair adds and the most it comes to, and words of a term at most.
WITHIN_S, LEARNED, LEARNED_MOST, TERM_WORDS = 60.0, 0.5, 2.0, 4


def learned(searches: DataFrame, user: str, at: str, query: str, opened: str, tie: str) -> DataFrame:
    """(term, stands_for, weight, learned_at) from searches of a user in order: one that nothing was opened of, followed within WITHIN_S seconds by
    another that something was, teaches that its words stand for the new words of the other.

    A search said again at once counts as one.
    """
    w = Window.partitionBy(user).orderBy(at, tie)
    said = F.trim(F.regexp_replace(F.lower(F.col(query)), r"\s+", " "))
    rows = searches.withColumn("_q", said).where("_q <> ''").withColumn("_new", ~F.lag("_q").over(w).eqNullSafe(F.col("_q")))
    rows = rows.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(user, "_run", "_q").agg(F.min(at).alias("_first"), F.min(F.when(F.col(opened), F.col(at))).alias("_opened"))
    order = Window.partitionBy(user).orderBy("_run")
    pairs = runs.withColumn("_before", F.lag(F.struct("_q", "_first", "_opened")).over(order))
    pairs = pairs.where("_opened is not null and _before._opened is null and _before._q is not null").where(F.col("_opened") - F.col("_before._first") <= WITHIN_S)
    words = F.split("_before._q", " ")
    new = F.filter(F.split("_q", " "), lambda x: ~F.array_contains(words, x))
    pairs = pairs.where((F.size(words) <= TERM_WORDS) & (F.size(new) > 0)).select(F.col("_before._q").alias("term"), F.array_join(new, " ").alias("stands_for"), F.col("_opened").alias("at"))
    return pairs.groupBy("term", "stands_for").agg(F.least(F.lit(LEARNED_MOST), F.count("*") * LEARNED).alias("weight"), F.max("at").alias("learned_at"))
