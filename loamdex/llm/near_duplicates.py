"""Near duplicates by SetSketch registers.

Each document's set of word shingles becomes ``M`` registers: truncated logarithms of minima of exponentially spaced
draws (SetSketch with b = 1.001, a = 20, q = 65534).  Registers of two sets merge by the larger value and agree about
as often as the sets overlap.  Bands of registers name buckets; documents that share a bucket are candidates; the
similarity is first estimated from all registers by likelihood and then verified on the full sets.

Sets of up to SMALL shingles have buckets of another kind: their first shingles in the order of their numbers, as many
as two linked sets can't miss each other in.  Sets a little larger have both kinds, so pairs of small sets are found
without any chance of loss, and no estimate stands between them and the check.

The nodes are classes: documents with equal sets.  A class's key is its smallest id followed by 128 bits of its set, so
keys sort by id and an id that stands on rows with different texts has one class per text; such classes are joined.

How groups of any size stay bounded: in a bucket each class is compared with the bucket's smallest one; what links
becomes one component.  A bucket whose classes still lie in several components goes on in rounds: each round takes
HEADS more classes from outside of the bucket's most common component, sixteen times as many in the next, and compares
them with the whole bucket, until all classes not yet taken lie in one component.  Heads and bucket are dealt in blocks
bounded by rows and bytes; blocks give only links that join components.  So no link between different texts is lost
and no group is written out as pairs.

Chance that a pair of larger sets at exactly 0.8 shares no bucket: (1 - 0.8**5)**32 = 3e-6, and less above; the
estimate lets pairs through down to SLACK standard errors below the threshold.  Of 150,000 simulated pairs at exactly
0.8, of 27 to 450 shingles, bands and estimate lost none (with four standard errors the estimate lost 3).

Nulls and odd cases: a null or word-free text has an empty set, is linked with nothing and is kept, also where its id
stands on other rows.  Rows that repeat an id are one node; each gives a row.  Rows without id take part and stand
behind all ids: their component is null unless it holds an id, and of a component without ids the rows of one set are
kept.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.words import mix, shingle_numbers, slices, tidy, word_numbers
from loamdex.llm.work import removed, shared_dir, written

M, BAND_ROWS, BANDS = 256, 5, 32
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Standard errors below the threshold at which an estimate still lets a pair through to the check on full sets.
SLACK = 6.0
#: Sets of up to so many shingles are found and verified without registers.
SMALL = 24
#: Classes and bytes of a block, and the heads of the first round.
BLOCK, BLOCK_BYTES, HEADS = 512, 16 << 20, 16

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
_SKETCH = "id long, text_md5 string, n long, digest binary, registers binary, bands array<long>"


def registers(elements: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """SetSketch registers of consecutive sets of distinct 64-bit numbers, one row a set.

    An element's points come in ascending order, so it is dropped as soon as its next point exceeds every minimum of
    its set: about M log M points a set in all, however large the set is.
    """
    sets = len(begins) - 1
    low = np.full(sets * M, np.inf)
    owner = np.repeat(np.arange(sets), np.diff(begins))
    seed = mix(elements + _U(0xA0761D6478BD642F))
    first = mix(seed ^ _U(0xE7037ED1A0B428DB))
    # a permutation of the places for each element: three odd factors with shifts between them
    one, two, three = ((first >> _U(k)) & _U(M - 1) | _U(1) for k in (20, 28, 36))
    more = (first >> _U(44)) & _U(M - 1)
    first = first & _U(M - 1)
    point = np.zeros(len(elements))
    for j in range(M):
        if not len(owner):
            break
        seed += _GOLD
        draw = ((mix(seed) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        point -= np.log(draw) / (RATE * (M - j))
        at = (first + one * _U(j)) & _U(M - 1)
        at = ((at ^ at >> _U(4)) * two + more) & _U(M - 1)
        at = ((at ^ at >> _U(4)) * three) & _U(M - 1)
        place = owner * M + at.astype(np.int64)
        np.minimum.at(low, place, point)
        if j < 12 or j % 4 == 0:
            go = point < low.reshape(sets, M).max(1)[owner]
            owner, seed, first, one, two, three, more, point = (x[go] for x in (owner, seed, first, one, two, three, more, point))
    with np.errstate(divide="ignore"):
        level = np.floor(1.0 - np.log(low) / np.log(BASE))
    return np.clip(level, 0, TOP + 1).astype(np.uint16).reshape(sets, M)


def band_numbers(regs: np.ndarray) -> np.ndarray:
    """BANDS bucket numbers of each row of registers."""
    out = np.empty((len(regs), BANDS), np.uint64)
    for band in range(BANDS):
        number = np.full(len(regs), band + 1, np.uint64) * _GOLD
        for r in range(BAND_ROWS):
            number = mix(number + regs[:, band * BAND_ROWS + r])
        out[:, band] = number
    return out.view(np.int64)


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarities of pairs, given their registers and set sizes."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    more, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def slope(j: np.ndarray) -> np.ndarray:
        step = 1e-5
        return value(j + step) - value(j - step)

    def value(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(22):  # the likelihood has a single peak
        middle = (low + high) / 2
        rising = slope(middle) > 0
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    return (low + high) / 2


def prefix_numbers(elements: np.ndarray, percent: int) -> np.ndarray:
    """Buckets of a small set (sorted numbers): two sets that reach the threshold share one."""
    n = len(elements)
    first = elements[: n - -(-percent * n // 100) + 1]
    return mix(first ^ _U(0xD6E8FEB86659FD93)).view(np.int64)


def _sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Each row's set of shingles as sorted numbers."""
    numbers, begins, _, _ = word_numbers(column)
    shingles, begins = shingle_numbers(numbers, begins, k)
    return [np.unique(shingles[begins[r] : begins[r + 1]]) for r in range(len(column))]


def _sums(flat: np.ndarray, at: np.ndarray, full: np.ndarray, sets: int) -> np.ndarray:
    """128 bits that name each set, one row a set."""
    total = np.zeros((sets, 2), np.uint64)
    if len(full):
        total[full, 0] = np.add.reduceat(mix(flat + _GOLD), at[full])
        total[full, 1] = np.add.reduceat(mix(flat ^ _U(0x8EBC6AF09C88C6E3)), at[full])
    return total


def _sketch(k: int, percent: int):
    """(id, text_md5, text) -> id, text_md5, the set's size, 128 bits that name the set, registers and buckets."""
    both = SMALL * 100 // percent  # the largest set that a small one can be linked with

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 1 << 20):
                sets = _sets(batch.column(2), k)
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets)
                at = np.concatenate([[0], np.cumsum(sizes)])
                regs = registers(flat, at)
                banded = band_numbers(regs)
                names = _sums(flat, at, np.flatnonzero(sizes), len(sets))
                buckets = []
                for own, bands in zip(sets, banded, strict=True):
                    n = len(own)
                    parts = [bands] if n > SMALL else []
                    if 0 < n <= both:
                        parts.append(prefix_numbers(own, percent))
                    buckets.append(np.concatenate(parts) if parts else bands[:0])
                counts = np.array([len(x) for x in buckets], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(sizes),
                        pa.array([x.tobytes() for x in names], pa.binary()),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.concatenate(buckets), pa.int64())),
                    ],
                    names=["id", "text_md5", "n", "digest", "registers", "bands"],
                )

    return run


def _members(k: int):
    """(digest, text) -> the digest and its full set, sorted; a row that repeats one before it in the batch gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                names = batch.column(0).to_pylist()
                once = pa.array([i for _, i in sorted({x: i for i, x in enumerate(names)}.items())], pa.int64())
                batch = batch.take(once)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in _sets(batch.column(1), k)], pa.binary())], names=["digest", "members"])

    return run


def _likely(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are worth the check on full sets, and their estimates (0 elsewhere; small sets: 1)."""
    least = percent / 100
    least -= SLACK * np.sqrt(least * (1 - least) / M)
    out = np.zeros(len(a))
    sized = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    small = sized & (np.minimum(n_a, n_b) <= SMALL)
    out[small] = 1.0
    # registers agree at least as often as sets overlap, so pairs far below need no likelihood
    at = np.flatnonzero(sized & ~small & ((a == b).sum(1) >= (least - 0.02) * M))
    if len(at):
        out[at] = estimated(a[at], b[at], n_a[at], n_b[at])
    return out >= least, out


def _star(percent: int):
    """(a, b, n_a, n_b, regs_a, regs_b) -> the pairs whose estimate is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, M) for i in (4, 5))
                keep = pa.array(_likely(n_a, n_b, a, b, percent)[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _verify(percent: int):
    """(a, b, members_a, members_b) -> the pairs with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = _shared(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _across(percent: int):
    """A block of a bucket's heads (side 0) and one of its classes (side 1) -> links that join components.

    The likeliest pairs are verified first; pairs whose components are joined by then need no verification.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        nodes, side = rows.column("node").to_pylist(), rows.column("side").to_numpy()
        names = sorted({c for c in rows.column("component").to_pylist()})
        number = {c: i for i, c in enumerate(names)}
        comp = np.array([number[c] for c in rows.column("component").to_pylist()], np.int64)
        order_of = np.argsort(np.argsort(np.array(nodes, object), kind="stable"), kind="stable")
        n, members = rows.column("n").to_numpy().astype(float), rows.column("members")
        regs = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(-1, M)
        bands = band_numbers(regs)
        here = np.flatnonzero((bands == key[0].as_py()).any(0))
        here = int(here[0]) if len(here) else 0  # buckets of small sets are no bands
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(left[:0], left[:0], np.zeros(0))]
        step = max(1, 16384 // max(1, len(right)))
        for lo in range(0, len(left), step):
            i, j = (x.ravel() for x in np.meshgrid(left[lo : lo + step], right, indexing="ij"))
            go = comp[i] != comp[j]
            i, j = i[go], j[go]
            if here:
                go = ~(bands[i, :here] == bands[j, :here]).any(1) | (np.minimum(n[i], n[j]) <= SMALL)  # else another bucket has the pair
                i, j = i[go], j[go]
            keep, likely = _likely(n[i], n[j], regs[i], regs[j], percent)
            found.append((i[keep], j[keep], likely[keep]))
        i, j, likely = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((order_of[j], order_of[i], -likely))
        root, out = list(range(len(names))), []

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        sets: dict[int, np.ndarray] = {}

        def members_of(r: int) -> np.ndarray:
            if r not in sets:
                sets[r] = np.frombuffer(members[r].as_buffer(), np.uint64)
            return sets[r]

        for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
            x, y = find(int(comp[a])), find(int(comp[b]))
            if x != y:
                both = _shared(members_of(a), members_of(b))
                if 100 * both >= percent * (n[a] + n[b] - both):
                    root[max(x, y)] = min(x, y)
                    out.append((min(nodes[a], nodes[b]), max(nodes[a], nodes[b])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return run


def components(edges: DataFrame, place: str | None = None) -> DataFrame:
    """(id, component): the smallest node reachable over edges (a, b), for every node on an edge.

    Large-star and small-star steps in turn; each is an aggregation with map-side minima and a join, and each round's
    edges are written to the shared folder.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", place)
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = written(small.where("u <> v").distinct(), "edges", place)
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(now.select("v", "v").distinct()) if before else spark.createDataFrame([], f"id {kind}, component {kind}")


#: What stands for a missing id in a node: behind all ids.
_NO_ID = b"\xff" * 9


def _node(id_: Column, digest: Column) -> Column:
    """A class's key: nine bytes that sort as the ids do, then the digest."""
    biased = F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(id_.bitwiseXOR(F.lit(-(2**63)))), 16, "0")))
    return F.concat(F.coalesce(biased, F.lit(_NO_ID)), digest)


def _id_of(node: Column) -> Column:
    """The id that a key begins with; null for none."""
    digits = F.hex(node)
    half = lambda at: F.conv(F.substr(digits, F.lit(at), F.lit(8)), 16, 10).cast("long")
    return F.when(F.substr(digits, F.lit(1), F.lit(2)) == "00", (F.shiftleft(half(3), 32) + half(11)).bitwiseXOR(F.lit(-(2**63))))


def _closed(shared: DataFrame, links: DataFrame, of_class: DataFrame, percent: int, place: str) -> DataFrame:
    """Components over ``links`` and all links inside the buckets of ``shared`` (bucket, node, n, head; the head has met all others).

    Rounds as told at the top; of_class: (node, registers, members).
    """
    comps = written(components(links, place), "components", place)
    spark, done, heads = shared.sparkSession, None, HEADS
    while True:
        of_node = comps.select(F.col("id").alias("node"), "component")
        labelled = shared.join(of_node, "node", "left").withColumn("component", F.coalesce("component", "node"))
        waiting = labelled.where("node <> head")
        waiting = waiting.join(done, ["bucket", "node"], "left_anti") if done is not None else waiting
        counts = waiting.groupBy("bucket", "component").agg(F.count("*").alias("rows"))
        open_ = counts.groupBy("bucket").agg(F.max(F.struct("rows", "component")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
        open_ = written(open_.select("bucket", F.col("most.component").alias("common")), "open", place)
        if open_.isEmpty():
            return comps
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("node"), "node"))
        outside = waiting.join(open_, "bucket").where("component <> common")
        chosen = written(outside.withColumn("rank", rank).where(F.col("rank") <= heads).select("bucket", "node", "n", "component"), "heads", place)
        # blocks by rows and bytes, of the heads and of the bucket
        weight = F.sum(F.col("n") * 8 + 4 * M)
        number = lambda rows: F.ceil(F.greatest(rows / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
        blocks = labelled.join(open_, "bucket", "left_semi").groupBy("bucket").agg(F.count("*").alias("rows"), weight.alias("bytes")).select("bucket", number(F.col("rows")).alias("blocks"))
        blocks = blocks.join(chosen.groupBy("bucket").agg(F.count("*").alias("rows"), weight.alias("bytes")).select("bucket", number(F.col("rows")).alias("head_blocks")), "bucket")
        blocks = written(blocks, "blocks", place)
        dealt = lambda salt, of: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(of)).cast("int")
        full = lambda df: df.join(blocks, "bucket").join(of_class, "node")
        columns = ["bucket", "x", "y", "node", "n", "component", "registers", "members", "side"]
        above = full(chosen).withColumn("x", dealt(7, "head_blocks")).withColumn("y", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("side", F.lit(0)).select(*columns)
        below = full(labelled.select("bucket", "node", "n", "component")).withColumn("y", dealt(8, "blocks")).withColumn("x", F.explode(F.expr("sequence(0, head_blocks - 1)"))).withColumn("side", F.lit(1)).select(*columns)
        more = above.unionByName(below).groupBy("bucket", "x", "y").applyInArrow(_across(percent), "a binary, b binary")
        more = written(more.distinct(), "more", place)
        if not more.isEmpty():
            comps = written(components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), place), "components", place)
        chosen = chosen.select("bucket", "node")
        done = written(done.union(chosen) if done is not None else chosen, "done", place)
        heads *= 16


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable), kept (it is its component's first), text_md5.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of ``words``-word shingles.
    """
    spark = docs.sparkSession
    place = shared_dir(spark)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(text).alias("text_md5"), text.alias("text"))
    sketch = written(texts.mapInArrow(tidy(_sketch(words, percent)), _SKETCH), "sketch", place)
    # size, registers and buckets follow from the set, so any row of a class has them; one text stands for it
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_md5"))
    classes = sketch.where("n > 0").groupBy("digest").agg(rep.alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.select("digest", _node(F.col("rep.id"), F.col("digest")).alias("node"), "n", "bands", "rep.id", "rep.text_md5"), "classes", place)
    buckets = classes.select(F.explode("bands").alias("bucket"), "node", "n")
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("head")).where("size > 1")
    sizes = sizes.select("bucket", "head")
    shared = written(buckets.join(sizes, "bucket"), "buckets", place)
    # registers and full sets of what shares a bucket; the sets are worked out again from the texts
    wanted = classes.join(shared.select("node").distinct(), "node", "left_semi").select("digest", "node", F.col("id").alias("rep_id"), F.col("text_md5").alias("rep_md5"))
    wanted = written(wanted, "wanted", place)
    of_rep = (F.col("text_md5") == F.col("rep_md5")) & F.col("id").eqNullSafe(F.col("rep_id"))
    sets = texts.join(wanted, of_rep).select("digest", "text").mapInArrow(tidy(_members(words)), "digest binary, members binary").dropDuplicates(["digest"])
    regs = sketch.withColumnRenamed("digest", "own").join(wanted, of_rep & (F.col("own") == F.col("digest"))).select("digest", "node", "registers").dropDuplicates(["digest"])
    of_class = written(regs.join(sets, "digest").select("node", "registers", "members"), "sets", place)
    # each class with its bucket's smallest
    stars = shared.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    stars = written(stars, "stars", place)
    side = lambda c, *what: of_class.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in what])
    counts = classes.select("node", "n")
    likely = stars.join(counts.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b").join(counts.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a")
    likely = likely.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").join(side("b", "registers"), "b").join(side("a", "registers"), "a")
    likely = likely.select("a", "b", "n_a", "n_b", "registers_a", "registers_b").mapInArrow(tidy(_star(percent)), "a binary, b binary")
    pairs = likely.join(side("b", "members"), "b").join(side("a", "members"), "a").select("a", "b", "members_a", "members_b")
    links = pairs.mapInArrow(tidy(_verify(percent)), "a binary, b binary")
    # classes that one id stands on
    of_row = sketch.where("n > 0 and id is not null").select("id", "digest").join(classes.select("digest", "node"), "digest")
    first = of_row.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("id", "a")
    repeats = of_row.join(first, "id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    links = written(links.union(repeats), "links", place)
    final = _closed(shared, links, of_class, percent, place)
    out = sketch.select("id", "n", "digest", "text_md5").join(classes.select("digest", "node"), "digest", "left")
    out = out.join(final.select(F.col("id").alias("node"), "component"), "node", "left")
    head = F.coalesce("component", "node")
    component = F.when(F.col("n") > 0, _id_of(head)).otherwise(F.col("id"))
    kept = F.when(F.col("n") == 0, True).when(F.col("id").isNull(), component.isNull() & (head == F.col("node"))).otherwise(component == F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "text_md5")
    result = written(out, "near_duplicates")
    removed(spark, place)
    return result
