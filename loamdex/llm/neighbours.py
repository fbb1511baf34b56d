"""Approximate nearest neighbours by inner product on robust-pruned directed graphs.

Vectors are dealt into shards by a hash: SHARD rows each, more where that makes over WAYS shards, up to MOST rows or
MOST_BYTES, so queries meet few shards.  Within a shard the largest inner product becomes the smallest distance by one
more coordinate, sqrt(m*m - |x|**2) with m the largest norm.  The graph is built in batches: greedy searches on the
graph so far propose neighbours; pruning keeps a neighbour only if no kept one is closer to it by the factor 1/ALPHA, so
edges stay diverse; reverse edges are added, and lists that grow too long are pruned again.  A second pass over all
nodes mends what early nodes could not see.  Beam search answers a block of queries on each shard; graphs and searches
take single precision, but scores are inner products of the original vectors in double precision.

Equal vectors are one node that keeps its smallest k + 1 ids, which is all that a result can hold, so a vector that a
third of all rows share neither crowds out a graph nor a task.

Nulls and odd cases: rows without id, and vectors that are null, empty, zero or hold null or non-finite components take
no part.  Repeated rows count once.  An id that stands on rows with different vectors counts once for a query, with the
best of its vectors found, and asks with all of them.  A product that overflows to no number counts as the smallest.
Vectors meet only those of their own length.  Ties go to the smaller id.  An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.work import removed, shared_dir, written

SHARD, QUERIES = 8192, 2048
WAYS, MOST, MOST_BYTES = 64, 1 << 17, 256 << 20
#: Out-degree after pruning and before it, beam of builds and of searches, slack of pruning.
DEGREE, ROOM, BUILD_BEAM, BEAM, ALPHA = 32, 48, 64, 96, 1.2
BATCH, MARKS = 512, 1 << 27
#: The longest vectors of a shard at which searches start besides its middle.
STARTS = 31

_INDEX = "dim int, part int, ids array<array<long>>, vectors binary, graph binary, starts array<int>"


def _beam(points: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, width: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and squared distances of the ``width`` closest found to each query, closest first (missing: -1, inf)."""
    n, q = len(points), len(queries)
    norms, own = (points * points).sum(1), (queries * queries).sum(1)
    ids, dist, done = np.full((q, width), -1, np.int64), np.full((q, width), np.inf, np.float32), np.ones((q, width), bool)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # stands for no node
    first = (own[:, None] + norms[starts] - 2 * (queries @ points[starts].T)).astype(np.float32)
    order = np.argsort(first, axis=1, kind="stable")
    ids[:, : len(starts)], done[:, : len(starts)], seen[:, starts] = starts[order], False, True
    dist[:, : len(starts)] = np.take_along_axis(first, order, 1)
    active = np.arange(q)
    while len(active):
        open_ = np.where(done[active], np.inf, dist[active])
        best = np.argsort(open_, axis=1, kind="stable")[:, :wide]
        go = np.isfinite(open_[np.arange(len(active))[:, None], best])
        active, best, go = active[go[:, 0]], best[go[:, 0]], go[go[:, 0]]
        if not len(active):
            break
        rows = active[:, None]
        from_ = np.where(go, ids[rows, best], n)
        done[rows, best] |= go
        near = np.sort(np.where((from_ < n)[:, :, None], graph[np.minimum(from_, n - 1)], n).reshape(len(active), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[rows, near]] = n
        seen[rows, near] = True
        far = near == n
        pick = np.minimum(near, n - 1)
        d = norms[pick] + own[active][:, None] - 2 * np.matmul(points[pick], queries[active][:, :, None])[:, :, 0]
        d[far] = np.inf
        all_d, all_i = np.concatenate([dist[active], d], 1), np.concatenate([ids[active], np.where(far, -1, near)], 1)
        all_done = np.concatenate([done[active], far], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        at = np.arange(len(active))[:, None]
        dist[active], ids[active], done[active] = all_d[at, order], all_i[at, order], all_done[at, order]
    return ids, dist


def _pruned(points: np.ndarray, node: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Up to DEGREE diverse neighbours of each node out of its candidates (-1: none), padded with len(points)."""
    n = len(points)
    out = np.full((len(node), DEGREE), n, np.int64)
    for lo in range(0, len(node), 256):
        c, p = cand[lo : lo + 256], node[lo : lo + 256]
        c = np.sort(np.where((c < 0) | (c >= n) | (c == p[:, None]), n, c), axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = n
        x = points[np.minimum(c, n - 1)]
        d = ((x - points[p][:, None]) ** 2).sum(2)
        d[c == n] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        at = np.arange(len(p))[:, None]
        c, d, x = c[at, order], d[at, order], x[at, order]
        squares = (x * x).sum(2)
        between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        alive, kept = np.isfinite(d), np.zeros(len(p), np.int64)
        for j in range(c.shape[1]):
            take = np.flatnonzero(alive[:, j] & (kept < DEGREE))
            if not len(take):
                continue
            out[lo + take, kept[take]] = c[take, j]
            kept[take] += 1
            alive[take] &= ALPHA * ALPHA * between[take, j] > d[take]
    return out


def _insert(points: np.ndarray, graph: np.ndarray, degree: np.ndarray, nodes: np.ndarray, proposed: np.ndarray) -> None:
    """Set the nodes' neighbours from proposals and add the reverse edges."""
    n = len(points)
    out = _pruned(points, nodes, proposed)
    graph[nodes] = n
    graph[nodes, :DEGREE] = out
    degree[nodes] = (out < n).sum(1)
    to, back = out.ravel(), np.repeat(nodes, DEGREE)
    to, back = to[to < n], back[to < n]
    there = (graph[to] == back[:, None]).any(1)
    to, back = to[~there], back[~there]
    order = np.lexsort((((points[to] - points[back]) ** 2).sum(1), to))
    to, back = to[order], back[order]
    first = np.searchsorted(to, to)
    rank = np.arange(len(to)) - first
    fits = degree[to] + rank < ROOM
    full = np.unique(to[~fits])
    ok = fits & ~np.isin(to, full)
    graph[to[ok], degree[to[ok]] + rank[ok]] = back[ok]
    np.add.at(degree, to[ok], 1)
    if len(full):  # the closest new ones compete with what is there
        mine = np.isin(to, full) & (rank < ROOM)
        new = np.full((len(full), ROOM), -1, np.int64)
        new[np.searchsorted(full, to[mine]), rank[mine]] = back[mine]
        out = _pruned(points, full, np.concatenate([graph[full], new], 1))
        graph[full] = n
        graph[full, :DEGREE] = out
        degree[full] = (out < n).sum(1)


def build(vectors: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each vector (padded with len(vectors)) and the nodes where searches start: the middle one and the longest."""
    points = lifted(vectors)
    n = len(points)
    graph, degree = np.full((n, ROOM), n, np.int64), np.zeros(n, np.int64)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    order = np.random.Generator(np.random.PCG64(seed)).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    middle = np.array([start])
    at = 1
    while at < n:
        nodes = order[at : at + min(BATCH, at)]
        near, _ = _beam(points, graph, middle, points[nodes], BUILD_BEAM)
        _insert(points, graph, degree, nodes, near)
        at += len(nodes)
    for lo in range(0, n, BATCH):
        nodes = order[lo : lo + BATCH]
        near, _ = _beam(points, graph, middle, points[nodes], BUILD_BEAM)
        _insert(points, graph, degree, nodes, np.concatenate([near, np.where(graph[nodes] == n, -1, graph[nodes])], 1))
    # the longest vectors answer many queries, and lie apart from the others once lifted
    longest = np.argsort(points[:, -1], kind="stable")[:STARTS]
    return graph, np.concatenate([middle, longest[longest != start]])


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate, all of the same norm."""
    x = vectors.astype(np.float32)
    squares = (vectors.astype(np.float64) ** 2).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None].astype(np.float32)], 1)


def _make(rows: pa.Table) -> pa.Table:
    rows = rows.take(pc.sort_indices(rows.select(["gid", "vid"]), sort_keys=[("gid", "ascending"), ("vid", "ascending")]))
    vectors = np.array(rows.column("embedding").to_pylist(), np.float64)
    # a common scale keeps squares finite; the searched order doesn't change
    graph, starts = build(vectors / max(1e-30, float(np.abs(vectors).max())))
    one = lambda v, t: pa.array([v], t)
    return pa.table(
        {
            "dim": rows.column("dim")[:1],
            "part": rows.column("part")[:1],
            "ids": one(rows.column("ids").to_pylist(), pa.list_(pa.list_(pa.int64()))),
            "vectors": one(vectors.astype("<f8").tobytes(), pa.binary()),
            "graph": one(graph.astype("<i4").tobytes(), pa.binary()),
            "starts": one(starts.tolist(), pa.list_(pa.int32())),
        }
    )


def _search(k: int):
    def run(rows: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        vectors = np.frombuffer(rows.column("vectors")[0].as_py(), "<f8").reshape(-1, dim)
        graph = np.frombuffer(rows.column("graph")[0].as_py(), "<i4").reshape(len(vectors), -1).astype(np.int64)
        ids, starts = rows.column("ids")[0].as_py(), np.array(rows.column("starts")[0].as_py(), np.int64)
        block = rows.column("queries")[0].as_py()
        gid, wanted = [(q["gid"], q["vid"]) for q in block], np.array([q["embedding"] for q in block], np.float64)
        scale = max(1e-30, float(np.abs(vectors).max()))
        points, out = lifted(vectors / scale), []
        longest = np.maximum(np.abs(wanted).max(1, keepdims=True), 1e-30)
        flat = np.concatenate([wanted / longest, np.zeros((len(wanted), 1))], 1).astype(np.float32)
        # larger shards take a wider beam, and as many queries at once as the marks of what was seen allow
        width = max(round(BEAM * max(1.0, len(vectors) / 8192) ** 0.25), k + 1)
        step = max(64, min(1024, MARKS // len(vectors)))
        for lo in range(0, len(gid), step):
            near, _ = _beam(points, graph, starts, flat[lo : lo + step], width)
            for g, w, found in zip(gid[lo : lo + step], wanted[lo : lo + step], near, strict=True):
                found = found[found >= 0]
                with np.errstate(over="ignore", invalid="ignore"):
                    score = (vectors[found] * w).sum(1)
                score[np.isnan(score)] = -np.inf
                firsts, different = np.array([ids[f][0] for f in found]), set()
                for i in np.lexsort((firsts, -score)):
                    out.append((*g, ids[found[i]], score[i]))
                    different.update(ids[found[i]])
                    if len(different) > k:  # ids may stand on several vectors
                        break
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64())
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("gid", "vid", "ids", "score"), zip(*out, strict=True) if out else ((), (), (), ()), kinds, strict=True)})

    return run


def groups(rows: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(gid, embedding, ids, dim): each different vector that takes part, its smallest id and its k + 1 smallest ids."""
    vector = F.col(vector_col).cast("array<double>")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    clean = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("embedding")).where(F.col("id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(good, F.lit(False))).distinct()
    salted = clean.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(61)))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy("embedding", "salt").orderBy("id"))).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("id"))).where(F.col("n") <= k + 1)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("gid"), "embedding", "ids", F.size("embedding").alias("dim"))


def graphs(known: DataFrame, shards: int) -> DataFrame:
    """The index: one row a shard, each with its vectors, ids and graph."""
    dealt = known.withColumn("vid", F.xxhash64("embedding")).withColumn("part", F.pmod(F.xxhash64("gid", "vid"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "part").applyInArrow(_make, _INDEX)


def nearest(rows: DataFrame, *, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the neighbour's id and score: the k nearest found of each row that ``is_query`` (a condition on
    the id column) holds for, among all other rows."""
    spark = rows.sparkSession
    place = shared_dir(spark)
    known = written(groups(rows, id_col, vector_col, k), "vectors", place)
    n, dim = known.agg(F.count("*"), F.max("dim")).first()
    size = max(1, min(max(SHARD, math.ceil(n / WAYS)), MOST, MOST_BYTES // (8 * (dim or 1))))
    shards = max(1, math.ceil(n / size))
    index = written(graphs(known, shards), "graphs", place)
    vector = F.col(vector_col).cast("array<double>")
    asked = rows.where(is_query).select(F.col(id_col).cast("long").alias("query_id"), vector.alias("embedding")).where("query_id is not null").distinct()
    asked = written(asked.join(known.select("gid", "embedding", "dim"), "embedding").select("query_id", "gid", "dim", "embedding"), "queries", place)
    # a vector is known by its smallest id and itself: one id may stand on several
    unique = asked.withColumn("vid", F.xxhash64("embedding")).groupBy("gid", "vid", "dim", "embedding").agg(F.count("*")).drop("count(1)")
    blocks = max(1, math.ceil(asked.select("gid").distinct().count() / QUERIES))
    packed = unique.groupBy("dim", F.pmod(F.xxhash64("gid", "vid", F.lit(1)), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("gid", "vid", "embedding")).alias("queries"))
    packed = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = packed.join(index, ["dim", "part"]).groupBy("dim", "part", "block").applyInArrow(_search(k), "gid long, vid long, ids array<long>, score double")
    found = found.select("gid", "vid", "score", F.explode("ids").alias("id")).groupBy("gid", "vid", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("gid", "vid").orderBy(F.desc("score"), "id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    mine = asked.select("query_id", "gid", F.xxhash64("embedding").alias("vid")).join(found.select("gid", "vid", "id", "score"), ["gid", "vid"]).where("id <> query_id")
    mine = mine.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    mine = mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    result = written(mine.select("query_id", "rank", F.col("id").alias(id_col), "score"), "nearest")
    removed(spark, place)
    return result
