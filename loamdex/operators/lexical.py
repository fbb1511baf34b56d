"""Keyword search: words, postings, BM25, spelling and root fallback, substring and typo lanes.

Queries are short lists of words that the driver holds.  A fixed query is scored in one pass without an index: each
text's counts of the query's words come from its own array of words, and only document frequencies and the mean length
are aggregated, so nothing is shuffled but a few numbers.  The index forms (postings, vocabulary) are DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the ranking.
K1, B, NEAR_WEIGHT = 1.2, 0.75, 0.5
WORD = r"[\p{L}\p{M}\p{N}]+"
#: Endings that a word may have over its root (fixed values).
ENDINGS = ("ing", "ings", "ed", "er", "ers", "ion", "ions", "ation", "ations", "ment", "ments", "ness", "able", "ity", "ities", "ful", "less")
LEAST_ROOT, RADIX, LONGEST_RUN = 4, 1024, 8


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def indexed_text(text: Column, name: Column, tags: Column, item_type: Column, devanagari: Column) -> Column:
    """R2: what an item is found by: its text, its name as written and cut at separators, tags, type, and the keys of Devanagari words; nulls and
    empty parts are left out."""
    from loamdex.functions.spelling import shadows

    some = lambda c: F.when(F.trim(c) != "", c)
    cut = F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}]+", " "))
    return F.concat_ws(" ", some(text.cast("string")), some(name), some(cut), some(tags), some(item_type), some(F.array_join(shadows(devanagari), " ")))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf)."""
    return docs.select(id_col, F.explode(words(F.col(text_col))).alias("term")).groupBy("term", id_col).agg(F.count("*").alias("tf"))


def vocabulary(docs: DataFrame, text_col: str) -> DataFrame:
    """Distinct terms."""
    return docs.select(F.explode(F.array_distinct(words(F.col(text_col)))).alias("term")).distinct()


def bm25(docs: DataFrame, id_col: str, text_col: str, query: Sequence[tuple[Sequence[str], float]]) -> DataFrame:
    """(id, score) of documents with any of the words; a query entry is a group of terms that count as one word, and a weight.

    A word given twice is scored twice.  The terms of a group share one document frequency.
    """

    def tf(group: Sequence[str]) -> Column:
        return F.size(F.filter("_words", lambda w: w.isin(*group))) if group else F.lit(0)

    counts = [tf(group).alias(f"_tf{i}") for i, (group, _) in enumerate(query)]
    rows = docs.select(id_col, words(F.col(text_col)).alias("_words"))
    rows = rows.select(id_col, F.size("_words").alias("_len"), *counts)
    facts = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"), *[F.count(F.when(F.col(f"_tf{i}") > 0, 1)).alias(f"_df{i}") for i in range(len(query))])
    any_ = reduce(lambda a, b: a | b, [F.col(f"_tf{i}") > 0 for i in range(len(query))])
    scored = rows.where(any_).crossJoin(F.broadcast(facts))  # one row of numbers
    part = lambda i, weight: weight * F.ln((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5) + 1) * F.col(f"_tf{i}") * (K1 + 1) / (F.col(f"_tf{i}") + K1 * (1 - B + B * F.col("_len") / F.col("_mean")))
    return scored.select(id_col, reduce(lambda a, b: a + b, [part(i, w) for i, (_, w) in enumerate(query)]).alias("score"))


def tolerance(word: str) -> int:
    """Edits a word may differ by."""
    return 1 if len(word) <= 4 else 2


def near(term: Column, word: str) -> Column:
    """The term has three characters at least and is within the word's tolerance; the length band comes first."""
    most = tolerance(word)
    return (F.length(term) >= 3) & (F.abs(F.length(term) - len(word)) <= most) & (F.levenshtein(term, F.lit(word), most) >= 0)


def roots(word: str) -> list[str]:
    """What the word may be without an ending: the stem, with an e, or with its doubled last letter single."""
    out = set()
    for ending in ENDINGS:
        if word.endswith(ending):
            stem = word[: -len(ending)]
            out |= {stem, stem + "e"}
            if len(stem) >= 2 and stem[-1] == stem[-2]:
                out.add(stem[:-1])
    return sorted(r for r in out if len(r) >= LEAST_ROOT)


def has_all(text: Column, terms: Sequence[str]) -> Column:
    """Every term is a word of the text; ``abc*`` stands for a beginning."""
    cut = words(text)
    test = lambda t: F.exists(cut, lambda w: w.startswith(t[:-1])) if t.endswith("*") else F.array_contains(cut, t)
    return reduce(lambda a, b: a & b, [test(t) for t in terms])


def whole_word(text: Column, term: str) -> Column:
    """the term stands alone between characters of no word."""
    return F.lower(text).rlike(rf"(?<![\p{{L}}\p{{M}}\p{{N}}])\Q{term}\E(?![\p{{L}}\p{{M}}\p{{N}}])")


def substring_key(text: Column, query: Sequence[str]) -> tuple[Column, Column]:
    """(rows that qualify, sort key): words said, words had, words that stand alone, packed into one number."""
    low = F.lower(text)
    count = lambda tests: reduce(lambda a, b: a + b, [F.when(x, 1).otherwise(0) for x in tests])
    hits = count([F.contains(low, F.lit(w)) for w in query])
    alone = count([whole_word(text, w) for w in query])
    return hits > 0, ((hits * RADIX + hits) * RADIX + alone).cast("long")


def _any_number(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha() or not word.islower():
        return rf"\Q{word}\E"
    single = word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word
    return rf"\Q{single}\E(?:s|es)?"


def longest_run(text: Column, query: Sequence[str]) -> Column:
    """The most query words that follow one another in the text, in singular or plural; 0 below two."""
    query, low = list(query)[:LONGEST_RUN], F.lower(text)
    out = F.lit(0)
    for n in range(2, len(query) + 1):
        runs = [r"[^\p{L}\p{M}\p{N}]+".join(map(_any_number, query[i : i + n])) for i in range(len(query) - n + 1)]
        found = low.rlike(r"(?<![\p{L}\p{M}\p{N}])(?:" + "|".join(runs) + r")(?![\p{L}\p{M}\p{N}])")
        out = F.when(found, n).otherwise(out)
    return out


def typo_documents(docs: DataFrame, id_col: str, text_col: str, query: Sequence[str], limit: int) -> DataFrame:
    """The first documents, in id order, that say a near spelling of any word; spellings are matched once per distinct token."""
    tokens = docs.select(id_col, F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), r"\s+"))).alias("token"))
    match = reduce(lambda a, b: a | b, [near(F.col("token"), w) for w in query])
    good = tokens.where(match).select(id_col).distinct()
    return good.orderBy(id_col).limit(limit)


def top(df: DataFrame, score: str, tie: str, limit: int) -> DataFrame:
    """The best rows; ties to the smaller key."""
    return df.orderBy(F.desc(score), tie).limit(limit)


def top_per(df: DataFrame, key: str, score: str, tie: str, limit: int) -> DataFrame:
    """The best rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def excerpt(text: Column, word: str, before: int = 40, after: int = 80) -> Column:
    """The text around the first place that has the word."""
    at = F.locate(word, F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substr(text, start, at - start + len(word) + after))
