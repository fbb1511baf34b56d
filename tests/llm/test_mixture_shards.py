"""Mixing and sharding: quotas, targets, movement, determinism and odd inputs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from plain import words
from pyspark.sql import functions as F

from loamdex.llm import mixture as mx, shards as sh


def corpus(seed=1, n=1500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "é", "z", None])
        text = rng.choice([None, ""]) if rng.random() < 0.05 else " ".join(["w"] * rng.choice([1, 3, 20, 60, 200, 900]))
        rows.append((i, text, source, 7))
    return rows


def test_targets_stop_at_the_cap():
    assert mx.targets([100, 100, 100], [1, 1, 1]) == [100, 100, 100]
    got = mx.targets([10, 1000, 0, 500], [5, 1, 9, 2])
    assert got[0] == 30 and got[2] == 0 and sum(got) == pytest.approx(1510) and got[3] / got[1] == pytest.approx(2)
    assert mx.targets([], []) == [] and mx.targets([0], [1]) == [0]


def test_splitting_tree_deals_all_blocks():
    counts = mx.split([1000, 7, 0, 350], 13)
    assert counts.sum(0).tolist() == [1000, 7, 0, 350]
    rows = counts.sum(1)
    assert rows.max() - rows.min() <= 1 and (mx.split([1000, 7, 0, 350], 13) == counts).all()
    # as often as a plain draw would: shares of a source vary around its mean
    assert abs(counts[:, 0].mean() - 1000 / 13) < 1e-9 and 1 < counts[:, 0].std() < 12


def test_mix_comes_near_its_targets(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mx.mixture(df, shards=8).collect()
    again = mx.mixture(df.repartition(7), shards=8).collect()
    key = lambda r: (r.doc_id, r.size, r.copies, tuple(r.shards))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes = {r[0]: len(words(r[1])) for r in rows}
    of = defaultdict(int)
    for i, _, s, _ in rows:
        of[s] += sizes[i]
    order = sorted(of, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mx.targets([of[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])))
    taken = Counter()
    for r in got:
        assert r.size == sizes[r.doc_id] and r.source_size == of[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.copies <= 3 and len(r.shards) == r.copies and all(0 <= x < 8 for x in r.shards)
        taken[r.source] += r.size * r.copies
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(3, 0.01 * goal[s])


def test_blocks_are_dealt_out_by_the_drawn_counts(spark, monkeypatch):
    """Every block has rows, blocks are whole, and shards get as many blocks of a source as the tree drew; sources in groups of two."""
    monkeypatch.setattr(mx, "GROUP", 2)
    monkeypatch.setattr(mx, "BLOCK", 4)
    got = mx.mixture(spark.createDataFrame(corpus(), "doc_id long, text string, source string, size int"), shards=8).collect()
    per = defaultdict(Counter)
    for r in got:
        per[r.source].update(r.shards)
    order = sorted(per, key=lambda s: (s is None, s or ""))
    copies = [sum(per[s].values()) for s in order]
    blocks = [-(-n // 4) for n in copies]
    groups = [sum(blocks[i : i + 2]) for i in range(0, len(blocks), 2)]
    leaves = mx.split(groups, 8, (mx.SEED, 0))
    drawn = np.concatenate([mx.split(blocks[2 * g : 2 * g + 2], 8, (mx.SEED, 1, g), leaves[:, g]) for g in range(len(groups))], 1)
    assert drawn.sum(0).tolist() == blocks and max(drawn.sum(1)) - min(drawn.sum(1)) <= 1
    for i, s in enumerate(order):
        short = copies[i] % 4 and 4 - copies[i] % 4  # the last block may be short, in one shard
        off = [4 * int(drawn[k, i]) - per[s][k] for k in range(8)]
        assert sorted(off) == [0] * 7 + [short]


def test_groups_of_sources_are_drawn_as_all_at_once():
    """Means and variances over many seeds are those of a plain multivariate hypergeometric draw."""
    quotas, draws = [30, 50, 20, 60], []
    for seed in range(1500):
        leaves = mx.split([80, 80], 4, (seed, 0))
        draws.append(np.concatenate([mx.split(quotas[2 * g : 2 * g + 2], 4, (seed, 1, g), leaves[:, g])[0] for g in range(2)]))
    draws, total = np.array(draws), 160
    for i, q in enumerate(quotas):
        share = q / total
        assert abs(draws[:, i].mean() - 40 * share) < 0.25
        assert abs(draws[:, i].var() / (40 * share * (1 - share) * (total - 40) / (total - 1)) - 1) < 0.15


def test_the_shuffle_is_a_permutation(spark):
    for n in (1, 2, 7, 100, 1001):
        got = [r.x for r in spark.range(n).select(mx._shuffled(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("x")).collect()]
        assert sorted(got) == list(range(n))
        assert n < 100 or abs(np.corrcoef(got, range(n))[0, 1]) < 0.3
    other = [r.x for r in spark.range(100).select(mx._shuffled(F.col("id"), F.lit(100).cast("long"), F.lit(6).cast("long")).alias("x")).collect()]
    assert other != [r.x for r in spark.range(100).select(mx._shuffled(F.col("id"), F.lit(100).cast("long"), F.lit(5).cast("long")).alias("x")).collect()]


def test_giants_repeats_and_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mx, "COPIES", 50)
    rows = [(1, "w " * 9000, "a")] + [(2 + i, "w", "a") for i in range(800)]  # a document larger than what is left
    rows += [(5000, f"t{i} x", "b") for i in range(300)] + [(6000, "same text here", "c")] * 777 + [(None, f"n{i}", None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, again = mx.mixture(df, shards=8).collect(), mx.mixture(df.repartition(9), shards=8).collect()
    key = lambda r: (r.doc_id or 0, r.source or "", r.size, r.copies, tuple(r.shards))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    taken, goal = Counter(), {}
    for r in got:
        taken[r.source] += r.size * r.copies
        goal[r.source] = (r.target, r.source_size)
    for s, (t, n) in goal.items():
        assert taken[s] <= 3 * n and abs(taken[s] - t) <= max(5, 0.01 * t) or s == "a"
    # 9,800 words of which 9,000 are one document: no sum is nearer to the target
    t, n = goal["a"]
    passes = min(3, int(t // n))
    sums = [passes * n + x for x in (*range(801), *range(9000, 9801))]
    assert abs(taken["a"] - t) <= min(abs(x - t) for x in sums) + 0.001 * t + 1
    once = lambda d: sorted(((r.doc_id or 0, r.text, r.source or "", r.mix_shard) for r in d.collect()), key=str)
    mix = once(mx.mixed(df, shards=8))
    assert mix == once(mx.mixed(df.repartition(9), shards=8))
    assert Counter((i, s) for i, _, s, _ in mix) == Counter({k: n for k, n in sum((Counter({(r.doc_id or 0, r.source or ""): r.copies}) for r in got), Counter()).items() if n})


def test_mixed_rows_keep_their_columns(spark):
    df = spark.createDataFrame(corpus(n=200), "doc_id long, text string, source string, c long").withColumn("size", F.lit(1)).withColumn("target", F.lit("x"))
    plan = mx.mixture(df).agg(F.sum("copies")).first()[0]
    got = mx.mixed(df)
    assert got.columns == [*df.columns, "mix_copy", "mix_shard", "mix_order"] and abs(got.count() - plan) <= 0.02 * plan
    assert mx.mixed(df.limit(0)).count() == 0


def _places(spark, n, *trees):
    ids = spark.range(0, n)
    return [{r.id: (r.p.region, r.p.rack, r.p.shard) for r in ids.select("id", sh.place(F.col("id"), t).alias("p")).collect()} for t in trees]


def test_tree_places_by_weight_and_grows_only_into_the_new_shard(spark):
    for n in (5, 12, 40):
        a, b = _places(spark, 20_000, sh.tree(n), sh.grown(sh.tree(n)))
        moved = [i for i in a if a[i][2] != b[i][2]]
        assert all(b[i][2] == n for i in moved) and abs(len(moved) / 20_000 - 1 / (n + 1)) < 0.02
        assert all(s // 8 == r and (s % 8) // 4 == k for r, k, s in a.values())
        assert max(abs(c / 20_000 - 1 / n) for c in Counter(x[2] for x in a.values()).values()) < 0.02
    assert sh.grown(sh.tree(40)) == sh.tree(41)


def test_changed_weights_move_rows_only_in_their_subtrees(spark):
    """Weight of shard 3 (region 0, rack 0) grows: what moves between regions enters region 0, between racks rack 0 of it."""
    weights = [1.0] * 20
    a, b = _places(spark, 20_000, sh.tree(20, weights=weights), sh.tree(20, weights=[*weights[:3], 4.0, *weights[4:]]))
    for i in a:
        if a[i][0] != b[i][0]:
            assert b[i][0] == 0
        elif a[i][1] != b[i][1]:
            assert b[i][:2] == (0, 0)
        elif a[i][2] != b[i][2]:
            assert b[i][2] == 3
    share = Counter(x[2] for x in b.values())
    assert abs(share[3] / 20_000 - 4 / 23) < 0.02
    (none,) = _places(spark, 2000, sh.tree(9, weights=[0, 0, 0, 0, 1, 1, 1, 1, 0]))
    assert {x[2] for x in none.values()} == {4, 5, 6, 7}


def test_descent_is_that_of_a_plain_tree(spark):
    """Level by level in Python, over Spark's hashes of the drawn names alone."""
    import math

    nodes, n = sh.tree(11, weights=[1, 2, 1, 3, 1, 1, 0, 2, 5, 1, 1]), 300
    names = {0: range(2), 1: [r * 65536 + k for r, region in enumerate(nodes) for k in range(len(region))], 2: range(11)}
    pairs = spark.createDataFrame([(level, name) for level in names for name in names[level]], "level int, name int").crossJoin(spark.range(n))
    drawn = {(r.level, r.name, r.id): ((r.h >> 11) % 2**53 + 0.5) * 2.0**-53 for r in pairs.select("*", F.xxhash64(F.col("level") + sh.SEED, "id", "name").alias("h")).collect()}
    (got,) = _places(spark, n, nodes)

    def earliest(level, children, i):
        return min((-math.log(drawn[level, name, i]) / w, name) for name, w in children if w > 0)[1]

    for i in range(n):
        r = earliest(0, [(r, sum(w for rack in region for _, w in rack)) for r, region in enumerate(nodes)], i)
        k = earliest(1, [(r * 65536 + k, sum(w for _, w in rack)) for k, rack in enumerate(nodes[r])], i) % 65536
        assert got[i] == (r, k, earliest(2, nodes[r][k], i))


def test_many_copies_of_one_row_are_dealt_out_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sh, "COPIES", 100)
    df = spark.createDataFrame([(1, "a")] * 1234 + [(None, "b"), (2, None)], "doc_id long, text string")
    got = sh.sharded(df, shards=1).collect()
    assert sorted(r.slot for r in got) == list(range(1236)) and Counter(r.doc_id for r in got) == {1: 1234, None: 1, 2: 1}


def test_slots_have_no_gaps(spark):
    rows = [(i, "x" * (i % 50)) for i in range(3000)] + [(5, "xxxxx")] * 900 + [(None, None), (None, ""), (1, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sh.sharded(df).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and (r.grown_shard in (r.shard, 40))
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(16, 0)}
    assert len({r.shard for r in got if r.doc_id == 5}) == 1 and any(r.size == 18 for r in got)
    assert sh.sharded(df.limit(0)).count() == 0
