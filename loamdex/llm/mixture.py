"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words.  Targets come from the weights; a source's target stops at CAP times its size and the excess is shared
out again by weight, until none is above: rounds of two sums over all sources, in whole numbers.

Each source's documents stand in the order of a keyed hash.  A source is passed over whole as often as its target
allows; a last pass takes documents in order until the next would exceed what is left, goes on with those of at most
half of the new gap, and so on until the gap is within TOLERANCE of it; at last the document nearest to the gap is
taken if that brings the sum nearer.  Each step halves the gap or exhausts the source, so steps are few, and each is a
sum over hash ranges and one range's order, never a source in one task.

The copies taken are numbered and cut into blocks of equal count, so block quotas are exact whole numbers and no block
is empty.  A tree splits the output shards in halves; at each node a multivariate hypergeometric draw says how many of
each source's blocks go left.  Sources are drawn in groups of GROUP first and inside each group then, which has the same
distribution, so the driver holds one number a group.  Below the leaves each source's blocks are permuted by a keyed
swap-or-not shuffle, dealt out disjointly by these counts, and rows get a hash by which a shard is shuffled locally.

Equal rows are worked out as one with a count, and dealt out in pieces of COPIES.

Nulls and odd cases: a null source is a source, last in order; a null or word-free text has size 0 and takes nothing;
a source without words has target 0; rows that repeat an id are documents of their own; an empty table gives an empty
table.  Reruns agree: everything follows from the rows and the seed.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.work import partitions, removed, shared_dir, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP, SHARDS, SEED = (1, 2, 3), 3, 64, 20240301
#: Copies of a block at least, and blocks at most (larger inputs have larger blocks).
BLOCK, BLOCKS = 32, 1 << 28
#: Sources of a group, and equal rows that are dealt out from one row.
GROUP, COPIES = 65536, 65536
#: The part of a last pass that may be left open before its nearest document is looked for.
TOLERANCE = 1 / 2000
#: Rounds of the shuffle of blocks.
ROUNDS = 12


def targets(sizes: list[int], weights: list[int], cap: int = CAP) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``cap`` times its size."""
    level, total = Fraction(0), sum(sizes)
    while True:
        over = [w * level > cap * n or not n for n, w in zip(sizes, weights, strict=True)]
        open_ = sum(w for w, o in zip(weights, over, strict=True) if not o)
        left = total - sum(cap * n for n, o in zip(sizes, over, strict=True) if o)
        if not open_ or Fraction(left, open_) == level:
            return [float(cap * n if o else w * level) for n, w, o in zip(sizes, weights, over, strict=True)]
        level = Fraction(left, open_)


def split(quotas: list[int] | np.ndarray, shards: int, seed: tuple[int, ...] = (SEED,), leaves: np.ndarray | None = None) -> np.ndarray:
    """Blocks of each source (column) in each shard (row); columns sum to the quotas, rows to ``leaves`` (if not given: whole numbers that
    differ by one at most)."""
    quotas = np.asarray(quotas, np.int64)
    out = np.zeros((shards, len(quotas)), np.int64)
    if leaves is None:
        each, more = divmod(int(quotas.sum()), shards)
        leaves = np.full(shards, each, np.int64) + (np.arange(shards) < more)

    def descend(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        middle = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([*seed, lo, hi]))
        left = rng.multivariate_hypergeometric(have, int(leaves[lo:middle].sum()), method="marginals")
        descend(lo, middle, left)
        descend(middle, hi, have - left)

    if len(quotas):
        descend(0, shards, quotas)
    return out


def _cuts(leaves: dict[int, list[int]], shards: int, seed: int):
    """The sources of one group (source, rank, blocks) -> their cuts: blocks of the shards up to each."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        group = key[0].as_py()
        rows = rows.sort_by("rank")
        counts = split(rows.column("blocks").to_numpy(), shards, (seed, 1, group), np.array(leaves[group], np.int64))
        cuts = np.cumsum(counts, axis=0).T
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cuts.size + 1, shards), pa.int32()), pa.array(cuts.ravel()))
        return pa.table({"s": rows.column("source"), "cuts": lists, "blocks": rows.column("blocks")})

    return run


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _key(seed: int, columns: list[Column]) -> Column:
    """A hash that tells nulls from what stands beside them."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (c.isNull(), c)])


def _ranked_sources(sums: DataFrame, place: str) -> DataFrame:
    """(source, words, n, rank): sources numbered by code point, null last, in ranges."""
    spark = sums.sparkSession
    sources = sums.groupBy("source").agg(F.sum("words").alias("words"), F.sum("n").alias("n"))
    ranged = sources.withColumn("none", F.col("source").isNull()).repartitionByRange(partitions(spark), "none", "source")
    ranged = written(ranged.withColumn("range", F.spark_partition_id()), "ranged", place)
    counts, at, starts = ranged.groupBy("range").count().orderBy("range").collect(), 0, []
    for r in counts:  # one row a partition
        starts.append((r["range"], at))
        at += r["count"]
    starts = spark.createDataFrame(starts, "range int, start long")
    number = F.row_number().over(Window.partitionBy("range").orderBy("none", "source")) - 1
    return written(ranged.withColumn("rank", number).join(F.broadcast(starts), "range").select("source", "words", "n", (F.col("rank") + F.col("start")).alias("rank")), "sources", place)


def _targeted(sources: DataFrame) -> DataFrame:
    """With weight and target: the level rises until no further source stops at its cap."""
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    sources = sources.withColumn("weight", weight)
    wide = lambda c: c.cast("decimal(38,0)")
    total, level = int(sources.agg(F.sum(wide(F.col("words")))).first()[0] or 0), Fraction(0)
    while True:
        over = (F.col("words") == 0) | (wide(F.col("weight")) * F.lit(str(level.numerator)).cast("decimal(22,0)") > wide(F.col("words") * CAP) * F.lit(str(level.denominator)).cast("decimal(18,0)"))
        capped, open_ = sources.agg(F.sum(F.when(over, wide(F.col("words")) * CAP)), F.sum(F.when(~over, wide(F.col("weight"))))).first()
        now = Fraction(total - int(capped or 0), int(open_)) if open_ else level
        if now == level:
            share = F.element_at(F.array(*[F.lit(float(w * level)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
            return sources.withColumn("target", F.when(over, (F.col("words") * CAP).cast("double")).otherwise(share))
        level = now


def _last_pass(base: DataFrame, plan: DataFrame, place: str) -> tuple[DataFrame, DataFrame]:
    """Which documents the last pass takes: (s, steps) with steps a list of (bound, h, k2), and (s, fill_h, fill_k2, filled).

    A row is taken whole if its size is at most the bound of the first step whose (h, k2) is above its own; the row that
    a step stops at may be taken in part, as told by the fills.
    """
    spark = base.sparkSession
    kind = "array<struct<bound:long,h:long,k2:long>>"
    state = plan.where("rest > 0").select("s", F.col("rest").alias("gap"), F.floor(F.col("rest") * TOLERANCE).alias("near"), F.lit(-1).cast("long").alias("at_h"), F.lit(0).cast("long").alias("at_k2"), F.array().cast(kind).alias("steps"))
    state, fills, closed = written(state, "state", place), [], []
    while True:
        closed.append(state.where("gap <= near").select("s", "gap", "steps"))
        state = state.where("gap > near")
        if state.isEmpty():
            break
        known = base.join(state, _same("source", "s")).withColumn("bound", F.floor((F.col("gap") + 1) / 2).cast("long"))
        known = known.where("size > 0 and size <= bound and (h > at_h or h = at_h and k2 > at_k2)")
        sums = known.groupBy("s", "part", "gap").agg(F.sum(F.col("size") * F.col("reps")).alias("words"))
        running = F.sum("words").over(Window.partitionBy("s").orderBy("part"))
        sums = written(sums.withColumn("until", running), "sums", place)
        # the part of each source in which the gap is exceeded
        part = sums.where("until > gap").groupBy("s").agg(F.min("part").alias("p")).withColumnRenamed("s", "s2")
        start = sums.withColumnsRenamed({"s": "s3"}).select("s3", "part", (F.col("until") - F.col("words")).alias("start"))
        inside = known.join(part, _same("s", "s2") & (F.col("part") == F.col("p"))).drop("s2", "p")
        inside = inside.join(start.withColumnRenamed("part", "p"), _same("s", "s3") & (F.col("part") == F.col("p"))).drop("s3", "p")
        before = F.sum(F.col("size") * F.col("reps")).over(Window.partitionBy("s", "part").orderBy("h", "k2")) - F.col("size") * F.col("reps") + F.col("start")
        stop = inside.withColumn("before", before).where("before + size * reps > gap")
        stop = stop.groupBy("s").agg(F.min(F.struct("h", "k2", "before", "size")).alias("stop"))
        stop = written(stop.select(F.col("s").alias("s2"), "stop.*"), "stops", place)
        every = sums.groupBy("s").agg(F.max("until").alias("every")).withColumnRenamed("s", "s3")
        now = state.join(stop, _same("s", "s2"), "left").join(every, _same("s", "s3"), "left").drop("s2", "s3")
        stopped, some = F.col("before").isNotNull(), F.floor((F.col("gap") - F.col("before")) / F.col("size"))
        bound = F.floor((F.col("gap") + 1) / 2).cast("long")
        end = F.lit(2**63 - 1)
        now = now.select(
            "s",
            F.when(stopped, F.col("gap") - F.col("before") - some * F.col("size")).otherwise(F.col("gap") - F.coalesce("every", F.lit(0))).cast("long").alias("gap"),
            # a source that has no more small rows goes on only to the nearest one
            F.when(stopped, F.col("near")).otherwise(end).alias("near"),
            F.coalesce("h", end).alias("at_h"),
            F.coalesce("k2", end).alias("at_k2"),
            F.concat("steps", F.array(F.struct(bound.alias("bound"), F.coalesce("h", end).alias("h"), F.coalesce("k2", end).alias("k2"))).cast(kind)).alias("steps"),
            F.when(stopped & (some > 0), some.cast("long")).alias("some"),
        )
        now = written(now, "state", place)
        fills.append(now.where("some > 0").select("s", F.col("at_h").alias("h"), F.col("at_k2").alias("k2"), F.col("some").alias("filled")))
        state = now.drop("some")
    done = closed[0]
    for part in closed[1:]:
        done = done.union(part)
    done = written(done, "steps", place)
    filled = spark.createDataFrame([], "s string, h long, k2 long, filled long")
    for part in fills:
        filled = filled.union(part)
    # the document nearest to what is left
    open_ = base.where("size > 0").join(done.where("gap > 0"), _same("source", "s")).where(~_in_steps())
    off = F.abs(F.col("gap") - F.col("size"))
    nearest = open_.where(off < F.col("gap")).groupBy("s").agg(F.min(F.struct(off.alias("off"), "h", "k2")).alias("x")).select("s", "x.h", "x.k2", F.lit(1).cast("long").alias("filled"))
    filled = filled.union(nearest).groupBy("s", "h", "k2").agg(F.sum("filled").alias("filled"))
    return done.select("s", "steps"), written(filled.withColumnsRenamed({"s": "fill_s", "h": "fill_h", "k2": "fill_k2"}), "fills", place)


def _in_steps() -> Column:
    """Whether a row (size, h, k2) is taken whole by ``steps``."""
    ahead = F.filter("steps", lambda x: (x["h"] > F.col("h")) | ((x["h"] == F.col("h")) & (x["k2"] > F.col("k2"))))
    stopped_at = F.exists("steps", lambda x: (x["h"] == F.col("h")) & (x["k2"] == F.col("k2")))
    return F.coalesce(F.col("size") <= F.get(ahead, F.lit(0))["bound"], F.lit(False)) & ~stopped_at


def _decided(docs: DataFrame, size: Column | None, text_col: str, source_col: str, id_col: str, shards: int, seed: int, carry: tuple[str, ...], place: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their keys; one row per different row with what the mix takes of it; and the plan of each source."""
    spark = docs.sparkSession
    counted = size if size is not None else F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD))
    tells = [F.col(c) for c in dict.fromkeys([id_col, source_col, text_col, *carry])]
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(counted, F.lit(0)).cast("long").alias("size"),
        _key(seed, tells).alias("k1"),
        _key(seed + 1, tells).alias("k2"),
        *([F.struct(*carry).alias("row")] if carry else []),
    )
    # ranges of the hash: the order by (part, h) is the order by h, whatever the number of parts
    parts = 4 * partitions(spark)
    h = F.shiftrightunsigned("k1", 1)
    base = rows.groupBy("source", "id", "size", "k1", "k2").agg(F.count("*").alias("reps"))
    base = base.withColumn("h", h).withColumn("part", F.floor(F.col("h") / F.lit(float(2**63)) * parts).cast("int"))
    base = written(base, "base", place)
    some = F.when(F.col("size") > 0, F.col("reps")).otherwise(0)
    sums = base.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("reps")).alias("words"), F.sum(some).alias("n"))
    sums = written(sums, "parts", place)
    plan = _targeted(_ranked_sources(sums, place))
    passes = F.when(F.col("words") > 0, F.least(F.lit(CAP), F.floor(F.col("target") / F.col("words") + 1e-12))).otherwise(0)
    plan = plan.withColumn("passes", passes.cast("int"))
    rest = F.greatest(F.lit(0), F.least(F.round(F.col("target") - F.col("passes") * F.col("words")).cast("long"), F.col("words")))
    plan = written(plan.withColumn("rest", rest).withColumnRenamed("source", "s"), "targets", place)
    steps, fills = _last_pass(base, plan, place)
    # what the last pass takes of each row
    taken = base.join(steps, _same("source", "s"), "left").withColumn("steps", F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)))
    taken = taken.withColumn("whole", (F.col("size") > 0) & _in_steps()).drop("s", "steps")
    taken = taken.join(fills, _same("source", "fill_s") & (F.col("h") == F.col("fill_h")) & (F.col("k2") == F.col("fill_k2")), "left")
    taken = taken.withColumn("last", F.when(F.col("whole"), F.col("reps")).otherwise(F.least("reps", F.coalesce("filled", F.lit(0)))).cast("long")).withColumn("some", some)
    taken = written(taken.select("source", "id", "size", "k1", "k2", "h", "part", "reps", "some", "last"), "taken", place)
    # how many copies stand before each row, over the whole source and in the last pass
    counts = taken.groupBy("source", "part").agg(F.sum("some").alias("some"), F.sum("last").alias("last"))
    counts = written(counts, "counts", place)
    until = Window.partitionBy("source").orderBy("part")
    starts = counts.select(F.col("source").alias("s"), F.col("part").alias("p"), (F.sum("some").over(until) - F.col("some")).alias("a"), (F.sum("last").over(until) - F.col("last")).alias("b"))
    inside = Window.partitionBy("source", "part").orderBy("h", "k2", "id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = taken.where("some > 0").withColumn("r_all", F.sum("some").over(inside) - F.col("some")).withColumn("r_last", F.sum("last").over(inside) - F.col("last"))
    ranked = ranked.join(starts, _same("source", "s") & (F.col("part") == F.col("p")))
    ranked = ranked.select("source", "id", "size", "k1", "k2", "reps", "last", (F.col("r_all") + F.col("a")).alias("r_all"), (F.col("r_last") + F.col("b")).alias("r_last"))
    none = taken.where("some = 0").select("source", "id", "size", "k1", "k2", "reps", "last", F.lit(0).cast("long").alias("r_all"), F.lit(0).cast("long").alias("r_last"))
    decided = written(ranked.union(none), "decided", place)
    # exact quotas of blocks, and the tree
    lasts = counts.groupBy("source").agg(F.sum("last").alias("lasts")).withColumnRenamed("source", "s2")
    plan = plan.join(lasts, _same("s", "s2")).drop("s2").withColumn("quota", F.col("passes") * F.col("n") + F.col("lasts"))
    plan = written(plan, "quotas", place)
    total = plan.agg(F.sum("quota")).first()[0] or 0
    block = max(BLOCK, -(-total // BLOCKS))
    plan = plan.withColumn("blocks", F.ceil(F.col("quota") / block).cast("long")).withColumn("group", F.floor(F.col("rank") / GROUP).cast("long"))
    groups = plan.groupBy("group").agg(F.sum("blocks").alias("blocks")).orderBy("group").collect()  # a number for each 65,536 sources
    leaves = split([r.blocks for r in groups], shards, (seed, 0)).T.tolist()
    leaves = {r.group: own for r, own in zip(groups, leaves, strict=True)}
    cuts = plan.select(F.col("s").alias("source"), "rank", "blocks", "group").groupBy("group").applyInArrow(_cuts(leaves, shards, seed), "s string, cuts array<long>, blocks long")
    plan = plan.drop("blocks").join(cuts.withColumnRenamed("s", "s2"), _same("s", "s2")).drop("s2")
    plan = plan.select("s", F.col("words").alias("source_size"), "target", "passes", "n", "cuts", "blocks", F.lit(block).cast("long").alias("block"), _key(seed + 2, [F.col("s")]).alias("own"))
    return rows, decided, written(plan, "plan", place)


def _shuffled(x: Column, n: Column, own: Column) -> Column:
    """A keyed permutation of 0 to n-1 (swap or not): each round pairs places and swaps a pair by a hash of its larger one."""

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(own, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(own, r, F.greatest(x, partner)), F.lit(2)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def _dealt(decided: DataFrame, plan: DataFrame) -> DataFrame:
    """Each of the equal rows with its copies and their shards: rows get ``i``, ``copies`` and ``shards``."""
    rows = decided.withColumn("first", F.lit(0).cast("long"))
    # rows of very many equals are dealt out in pieces by many tasks
    many = rows.where(F.col("reps") > COPIES).withColumn("first", F.explode(F.expr(f"sequence(0, reps - 1, {COPIES})")))
    rows = rows.where(F.col("reps") <= COPIES).unionByName(many.repartition("k1", "first"))
    rows = rows.withColumn("i", F.explode(F.expr(f"sequence(first, least(first + {COPIES}, reps) - 1)"))).drop("first")
    rows = rows.join(plan, _same("source", "s"), "left").drop("s")
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + F.when(F.col("i") < F.col("last"), 1).otherwise(0)).otherwise(0).cast("int"))
    number = lambda p: F.col("i") + F.when(p < F.col("passes"), p * F.col("n") + F.col("r_all")).otherwise(F.col("passes") * F.col("n") + F.col("r_last"))
    at = lambda p: _shuffled(F.floor(number(p) / F.col("block")).cast("long"), F.col("blocks"), F.col("own"))
    places = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), at)
    shards = F.transform(places, lambda x: F.size(F.filter("cuts", lambda cut: cut <= x)))
    return rows.withColumn("shards", F.when(F.col("copies") > 0, shards).otherwise(F.array().cast("array<int>")))


def mixture(docs: DataFrame, *, size: Column | None = None, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies (how often the mix takes it), shards (one for each copy)."""
    spark = docs.sparkSession
    place = shared_dir(spark)
    _, decided, plan = _decided(docs, size, text_col, source_col, id_col, shards, seed, (), place)
    result = written(_dealt(decided, plan).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", "shards"), "mixture")
    removed(spark, place)
    return result


def mixed(docs: DataFrame, *, size: Column | None = None, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: every taken copy as a row of ``docs``'s columns, with mix_copy, mix_shard and mix_order (sorting a shard's rows by it
    shuffles them)."""
    spark = docs.sparkSession
    place = shared_dir(spark)
    rows, decided, plan = _decided(docs, size, text_col, source_col, id_col, shards, seed, tuple(docs.columns), place)
    taken = decided.where("size > 0").join(plan.select("s", F.col("passes").alias("p")), _same("source", "s")).where("p > 0 or last > 0").drop("s", "p")
    columns = ["x1", "x2", "i", "shards"]
    keyed = lambda df: _dealt(df, plan).where("copies > 0").withColumnsRenamed({"k1": "x1", "k2": "x2"}).select(*columns)
    single, several = written(keyed(taken.where("reps = 1")), "single", place), written(taken.where("reps > 1"), "several", place)
    own = (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2"))
    out = rows.select("k1", "k2", "row").join(single, own).select("row", *columns)
    # of equal rows one stands for all
    keys = several.select(F.col("k1").alias("x1"), F.col("k2").alias("x2"))
    one = rows.select("k1", "k2", "row").join(keys, own).groupBy("k1", "k2").agg(F.first("row").alias("row"))
    out = out.unionByName(one.join(keyed(several), own).select("row", *columns))
    order = F.xxhash64(F.lit(seed + 3), "x1", "i", "mix_copy")
    out = out.select("row", "x1", "i", F.posexplode("shards").alias("mix_copy", "mix_shard")).select("row.*", "mix_copy", "mix_shard", order.alias("mix_order"))
    result = written(out, "mixed")
    removed(spark, place)
    return result
