"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards; a node's weight is the sum of its shards'.  A document descends from the top:
at each node every child draws an exponential clock, -ln(u) / weight, u from a hash of the document's id and the
child's name, and the earliest clock is followed.  Only the children of the nodes on the way are drawn for, so a
document costs the sum of three fan-outs and not the number of shards.

Each child gets documents in proportion to its weight.  A changed weight changes clocks of that shard, its rack and its
region alone: documents move into or out of the subtrees whose weights change, and nowhere else.  One more shard comes
as a region of its own (``grown``), so documents move only into that very shard: the law ``key``.

Slots number each shard's rows without gaps: rows are ranked in parts of a shard (a hash of id, checksum and size), and
each part starts where the parts before it end, so no shard is ranked in one task.  Equal rows are ranked as one with a
count, and counts are dealt out in pieces of COPIES.

Nulls and odd cases: a null text has size 16 and the checksum 0 of no bytes; rows without id share one shard; repeated
rows each have a slot; a shard of weight 0 gets nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.work import partitions, removed, shared_dir, written

Tree = Sequence[Sequence[Sequence[tuple[int, float]]]]
SEED = 20240229
#: Equal rows that are dealt out from one row.
COPIES = 65536


def tree(shards: int, *, rack: int = 4, region: int = 8, weights: Sequence[float] | None = None) -> Tree:
    """Regions of racks of (shard, weight): ``rack`` shards a rack and ``region`` shards a region, filled in turn."""
    weights = weights or [1.0] * shards
    return [[[(s, float(weights[s])) for s in range(k, min(k + rack, r + region, shards))] for k in range(r, min(r + region, shards), rack)] for r in range(0, shards, region)]


def grown(nodes: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, a region of its own."""
    return [*nodes, [[(1 + max((s for region in nodes for rack in region for s, _ in rack), default=-1), weight)]]]


def _earliest(children: Column, key: Column, level: int) -> Column:
    """The child (a struct with name and weight) whose clock is the earliest."""

    def clock(child: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED + level), key, child["name"]), 11) + 0.5) * F.lit(2.0**-53)
        return F.struct((-F.ln(u) / child["weight"]).alias("clock"), child.alias("child"))

    return F.array_min(F.transform(children, clock))["child"]


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def place(key: Column, nodes: Tree) -> Column:
    """struct(region, rack, shard) that a key descends to."""
    weigh = lambda rack: sum(w for _, w in rack)
    named = lambda name, weight: F.struct(F.lit(name).cast("int").alias("name"), F.lit(float(weight)).alias("weight"))
    regions = [(r, [(k, [x for x in rack if x[1] > 0]) for k, rack in enumerate(region)]) for r, region in enumerate(nodes)]
    regions = [(r, [(k, rack) for k, rack in racks if rack]) for r, racks in regions]
    # names are places in the whole tree, so each node's draws are its own
    tops = F.array(*[named(r, sum(weigh(rack) for _, rack in racks)) for r, racks in regions if racks])
    below = F.array(*[F.array(*[named(r * 65536 + k, weigh(rack)) for k, rack in racks]) for r, racks in regions])
    wide = max((len(region) for region in nodes), default=0)
    shards = {(r, k): rack for r, racks in regions for k, rack in racks}
    leaves = F.array(*[F.array(*[named(s, w) for s, w in shards.get((r, k), [])]) for r in range(len(nodes)) for k in range(wide)])

    def in_region(region: Column) -> Column:
        racks = F.get(below, region["name"])
        return _bound(_earliest(racks, key, 1), lambda rack: in_rack(region, rack["name"] % 65536))

    def in_rack(region: Column, rack: Column) -> Column:
        shard = _earliest(F.get(leaves, region["name"] * wide + rack), key, 2)
        return F.struct(region["name"].alias("region"), rack.cast("int").alias("rack"), shard["name"].alias("shard"))

    return _bound(_earliest(tops, key, 0), in_region)


def sharded(docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard, region, rack.

    ``size`` is the text's UTF-8 bytes plus 16; ``grown_shard`` is the shard in a tree with one more of weight 1.
    """
    spark = docs.sparkSession
    nodes = tree(shards, weights=weights)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    # the places are worked out where the texts are read, in as many tasks
    rows = rows.select("*", place(F.col("id"), nodes).alias("at"), place(F.col("id"), grown(nodes))["shard"].alias("grown"))
    part = F.pmod(F.xxhash64("id", "crc", "size", F.lit(SEED + 1)), F.lit(partitions(spark))).cast("int")
    keys = ["region", "rack", "shard", "grown", "part", "id", "crc", "size"]
    rows = rows.select("at.region", "at.rack", "at.shard", "grown", part.alias("part"), "id", "crc", "size").groupBy(*keys).agg(F.count("*").alias("copies"))
    work = shared_dir(spark)
    rows = written(rows, "placed", work)
    counts = rows.groupBy("shard", "part").agg(F.sum("copies").alias("n"))
    starts = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("start"))
    before = F.sum("copies").over(Window.partitionBy("shard", "part").orderBy("id", "crc", "size")) - F.col("copies")
    ranked = rows.withColumn("before", before).join(starts, ["shard", "part"]).withColumn("first", F.col("start") + F.col("before"))
    # a row of very many copies is dealt out in pieces by many tasks
    piece = F.explode(F.expr(f"sequence(0, copies - 1, {COPIES})")).alias("offset")
    many = ranked.where(F.col("copies") > COPIES).select("*", piece).withColumn("first", F.col("first") + F.col("offset"))
    many = many.withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("offset"))).drop("offset").repartition("id", "first")
    out = ranked.where(F.col("copies") <= COPIES).unionByName(many).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.expr("sequence(first, first + copies - 1)")).alias("slot"),
        F.col("grown").alias("grown_shard"),
        "region",
        "rack",
    )
    result = written(out, "shards")
    removed(spark, work)
    return result
