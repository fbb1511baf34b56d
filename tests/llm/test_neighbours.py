"""Nearest neighbours: recall against brute force, exact scores, ties, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from loamdex.llm import neighbours as nb


def brute(rows, k):
    out = {}
    for q, v in rows:
        if q % 20:
            continue
        scores = sorted((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found(spark, rows, k):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 3) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    out = {}
    for r in nb.nearest(df, is_query=F.col("vec_id") % 20 == 0, k=k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(nb, "SHARD", 700)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 32))
    x = (centres[rng.integers(12, size=2400)] + rng.normal(size=(2400, 32))).astype(np.float32) * rng.uniform(0.5, 2, (2400, 1)).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x)]
    want, got = brute(rows, 20), found(spark, rows, 20)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95
    for q in got:
        assert all(abs(s - float(np.dot(np.float64(x[q]), np.float64(x[i])))) < 1e-9 for i, s in got[q])


def test_recall_of_whole_shards(spark):
    """Several shards of full size."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(200, 48))
    x = (centres[rng.integers(200, size=20_000)] + 0.7 * rng.normal(size=(20_000, 48))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in nb.nearest(df, is_query=F.col("vec_id") % 200 == 0, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    wide, recall = x.astype(np.float64), []
    for q in range(0, 20_000, 200):
        score = wide @ wide[q]
        score[q] = -np.inf
        recall.append(len(got[q] & set(np.argsort(-score, kind="stable")[:20].tolist())) / 20)
    assert len(got) == 100 and np.mean(recall) >= 0.95


def test_double_vectors_are_scored_as_given(spark):
    rows = [(0, [0.1, 0.7]), (1, [1.0, 0.1]), (2, [1e200, 0.0]), (3, [1e-3, 1e300]), (20, [-1e200, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in nb.nearest(df, is_query=F.col("vec_id") % 20 == 0, k=4).collect()}
    of = dict(rows)
    assert got == {(q, i): of[q][0] * of[i][0] + of[q][1] * of[i][1] for q in (0, 20) for i in of if i != q}
    assert abs(got[0, 1] - 0.17) < 1e-15  # single precision would be off by 1e-9


def test_an_id_with_several_vectors_counts_once(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 60, rng.normal(size=6).tolist()) for i in range(300)] + [(20, [9.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (21, [8.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (21, [0.0, 7.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {}
    for q in (0, 20, 40):
        best = {}
        for i, w in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), *(float((np.array(v) * np.array(w)).sum()) for j, v in rows if j == q))
        want[q] = sorted(best, key=lambda i: (-best[i], i))[:5]
    got = {}
    for r in nb.nearest(df, is_query=F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want


def test_hot_vector_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    hot = np.float32([1, 2, 3, 4])
    rows = [(i, hot) for i in range(0, 300)] + [(1000 + i, rng.normal(size=4).astype(np.float32)) for i in range(100)] + [(2000, np.float32([5, 1])), (2001, np.float32([1, 1]))]
    odd = [(3000, None), (3020, []), (3040, [0, 0, 0, 0]), (3060, [1, None, 2, 3]), (3080, [1, float("nan"), 2, 3]), (3100, [1, float("inf"), 2, 3])]
    got = found(spark, rows + odd + [rows[0]], 5)
    want = brute(rows, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_few_and_no_rows(spark):
    assert found(spark, [(0, np.float32([1, 0]))], 3) == {}
    assert found(spark, [], 3) == {}
    assert [i for i, _ in found(spark, [(0, np.float32([1, 0])), (1, np.float32([0, 1]))], 3)[0]] == [1]
