"""Vector search without an index: exact scans, quantized vectors, and the gates that decide what counts as a match."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the gates.
KEEP_STANDING, KEEP_MARGIN, GAP, SHOWN = 4.0, 0.06, 0.04, 10
SMALL_ROWS, SMALL_LEAD, SMALL_MARGIN = 200, 0.05, -0.03
#: Query vectors that are broadcast at once: 4 MB of 1,024 components.
FEW = 512


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from the first component."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector at length one."""
    return F.transform(F.array(F.struct(a.alias("a"), norm(a).alias("n"))), lambda s: F.transform(s["a"], lambda x: x / s["n"]))[0]


def quantized(a: Column) -> Column:
    """struct(scale, q): components as -127 to 127, halves up; scale is max|x| / 127."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.transform(F.array(F.struct(a.alias("a"), (top / 127).alias("scale"))), lambda s: F.struct(s["scale"].alias("scale"), F.transform(s["a"], lambda x: F.floor(x / s["scale"] + 0.5).cast("int")).alias("q")))[0]


def dequantized(packed: Column) -> Column:
    return F.transform(packed["q"], lambda x: x * packed["scale"])


def scored(vectors: DataFrame, queries: DataFrame, measure=cosine) -> DataFrame:
    """Every vector against each of some query vectors (query_id, query).

    Up to FEW queries are broadcast; more go in blocks of FEW against vectors dealt in parts, so nothing that grows is broadcast.
    """
    n = queries.count()
    if n <= FEW:
        both = vectors.crossJoin(F.broadcast(queries))
    else:
        blocks = -(-n // FEW)
        parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        asked = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        rows = vectors.withColumn("_part", F.pmod(F.xxhash64(*vectors.columns[:1]), F.lit(parts)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        both = rows.join(asked, ["_block", "_part"]).drop("_block", "_part")
    return both.withColumn("score", measure(F.col("embedding"), F.col("query")))


def standing(df: DataFrame, score: str, key: str) -> DataFrame:
    """The score's distance from the mean of its query, in standard deviations; aggregated, then joined back."""
    stats = df.groupBy(key).agg(F.avg(score).alias("_mean"), F.stddev_pop(score).alias("_std"), F.count("*").alias("scanned"))
    return df.join(stats, key).withColumn("standing", (F.col(score) - F.col("_mean")) / F.col("_std")).drop("_mean", "_std")


def margin(df: DataFrame, anchors: DataFrame, vector: str, score: str) -> DataFrame:
    """The score less the best similarity to any anchor; anchors travel as arrays of FEW, one after another."""
    blocks = max(1, -(-anchors.count() // FEW))
    dealt = anchors.select("anchor", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("_block"))
    df = df.withColumn("_best", F.lit(None).cast("double"))
    for b in range(blocks):
        packed = dealt.where(F.col("_block") == b).agg(F.collect_list("anchor").alias("_anchors"))
        best = F.array_max(F.transform("_anchors", lambda a: dot(F.col(vector), a)))
        df = df.crossJoin(F.broadcast(packed)).withColumn("_best", F.greatest("_best", best)).drop("_anchors")
    return df.withColumn("margin", F.col(score) - F.col("_best")).drop("_best")


def within_gap(df: DataFrame, key: str, score: str, gap: float) -> DataFrame:
    """Rows whose score is near the best of their key."""
    return df.withColumn("_best", F.max(score).over(Window.partitionBy(key))).where(F.col(score) >= F.col("_best") - gap).drop("_best")


def meaning_gate(df: DataFrame, key: str) -> DataFrame:
    """What a meaning search shows; df has score, standing, margin and scanned (rows searched)."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    large = within_gap(df.where((F.col("scanned") >= SMALL_ROWS) & (F.col("standing") >= KEEP_STANDING) & (F.col("margin") >= KEEP_MARGIN)), key, "score", GAP)
    small = df.where(F.col("scanned") < SMALL_ROWS)
    first = F.row_number().over(order) == 1
    top = small.withColumn("_lead", F.col("score") - F.lead("score").over(order)).withColumn("_first", first).where("_first")
    clear = (F.coalesce("_lead", F.lit(1e9)) >= SMALL_LEAD) | (F.col("margin") >= KEEP_MARGIN)
    top = top.where(clear & (F.col("margin") >= SMALL_MARGIN)).select(key, F.col("score").alias("_top"))
    small = small.join(top, key).where((F.col("score") >= F.col("_top") - GAP) & (F.col("margin") >= SMALL_MARGIN)).drop("_top")
    return large.unionByName(small).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SHOWN)


def sign_bits(a: Column, size: int = 64) -> Column:
    """A 64-bit signature: bit i is set if component i is above zero."""
    return F.aggregate(F.transform(F.slice(a, 1, size), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))), F.lit(0).cast("long"), lambda t, b: F.shiftleft(t, 1) + b)


#: Width of the blocks that a signature is cut into; signatures that meet as one group; candidates that are compared at once.
WIDE, GROUP, AT_ONCE = 16, 2**17, 2**19


def _near_in_block(x: np.ndarray, y: np.ndarray, block: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates, as places in x and in y: signatures that differ in at most ``most`` bits of a block."""
    value = lambda s: ((s >> np.uint64(WIDE * block)) & np.uint64(2**WIDE - 1)).astype(np.int64)
    order, sought = np.argsort(value(y), kind="stable"), value(x)
    count = np.bincount(value(y), minlength=2**WIDE)
    start = np.cumsum(count) - count
    for mask in (sum(1 << i for i in picked) for n in range(most + 1) for picked in combinations(range(WIDE), n)):
        found = count[sought ^ mask]
        own = np.flatnonzero(found)
        ends = np.cumsum(found[own])
        at, total = 0, int(ends[-1]) if len(own) else 0
        while at < total:
            # a stretch of all candidates, cut anywhere
            k = np.arange(at, min(at + AT_ONCE, total))
            i = np.searchsorted(ends, k, side="right")
            yield own[i], order[start[sought[own[i]] ^ mask] + k - (ends[i] - found[own[i]])]
            at += AT_ONCE


def near_signatures(df: DataFrame, key: str, bits: str, radius: int) -> DataFrame:
    """Pairs of rows (a < b) within ``radius`` bits.

    64 bits are cut into four blocks of 16, and radius + 1 is shared among them: two signatures within the radius differ in fewer bits than its share in
    one block at least.  Different signatures are dealt into groups by a hash, and each two groups meet in one task, which looks up all near values of
    its blocks in place: no row is made of a value or a candidate.  Each pair is kept in the first block that is near enough.  Equal signatures are one
    until the end.
    """
    blocks = 64 // WIDE
    most = [(radius + blocks - i) // blocks - 1 for i in range(blocks)]
    rows = df.select(F.col(key).alias("x"), F.col(bits).alias("s")).where("s is not null")
    once = rows.select("s").distinct()
    groups = -(-max(1, once.count()) // GROUP)
    group = F.pmod(F.xxhash64("s"), F.lit(groups)).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda h: F.struct(F.least("g", h).alias("g1"), F.greatest("g", h).alias("g2")))
    dealt = once.withColumn("g", group).select("s", "g", F.explode(meets).alias("m")).select("s", "g", "m.g1", "m.g2")

    def meet(own: pd.DataFrame) -> pd.DataFrame:
        first = own["g1"].iloc[0]
        x, y = own["s"][own["g"] == first].to_numpy().view(np.uint64), own["s"][own["g"] == own["g2"].iloc[0]].to_numpy().view(np.uint64)
        same, out = first == own["g2"].iloc[0], []
        for block in range(blocks):
            for i, j in _near_in_block(x, y, block, most[block]):
                both = x[i] ^ y[j]
                near = (np.bitwise_count(both) <= radius) & (x[i] < y[j] if same else True)
                i, j, both = i[near], j[near], both[near]
                new = np.ones(len(both), dtype=bool)
                for b in range(block):
                    new &= np.bitwise_count((both >> np.uint64(WIDE * b)) & np.uint64(2**WIDE - 1)) > most[b]
                out.append(pd.DataFrame({"sa": x[i[new]].view(np.int64), "sb": y[j[new]].view(np.int64), "distance": np.bitwise_count(both[new]).astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame({"sa": [], "sb": [], "distance": []})

    met = dealt.groupBy("g1", "g2").applyInPandas(meet, "sa long, sb long, distance int")
    a, b = rows.select(F.col("x").alias("xa"), F.col("s").alias("sa")), rows.select(F.col("x").alias("xb"), F.col("s").alias("sb"))
    pairs = met.join(a, "sa").join(b, "sb").select("xa", "xb", "distance")
    equal = a.join(b, (F.col("sa") == F.col("sb")) & (F.col("xa") < F.col("xb"))).select("xa", "xb", F.lit(0).alias("distance"))
    return pairs.unionByName(equal).select(F.least("xa", "xb").alias("a"), F.greatest("xa", "xb").alias("b"), "distance")


def mean_bits(a: Column) -> Column:
    """A 0/1 string: which of a picture's grey values (or any values) are above their mean."""
    mean = F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double")) / F.size(a)
    return F.transform(F.array(F.struct(a.alias("a"), mean.alias("m"))), lambda s: F.array_join(F.transform(s["a"], lambda x: F.when(x > s["m"], "1").otherwise("0")), ""))[0]
