"""Near duplicates against all pairs, and odd inputs."""

import itertools
import random

import numpy as np
import pytest
from plain import components

from loamdex.llm import near_duplicates as nd


def corpus(seed, groups=40, copies=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(600)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(own) // 20)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


def run(spark, texts, k):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, n int, component string")
    return {r.doc_id: r for r in nd.near_duplicates(df, words=k).collect()}


@pytest.mark.parametrize("k", [2, 5])
def test_all_links_are_found(spark, k):
    texts = dict(enumerate(corpus(k)))
    texts |= {1000: None, 1001: "", 1002: " \t\n", 1003: "One", 1004: "oNE", 1005: "é É", 1006: "é É", 1007: "word " * 30_000}
    want, sets = components(texts, k)
    got = run(spark, texts, k)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_a_large_group_of_near_copies(spark):
    """Hundreds of texts around one base, half of whose pairs are links: nothing is lost and nothing capped."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(110)]
    texts = {}
    for i in range(400):
        own = list(base)
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
        texts[i] = " ".join(own)
    got = run(spark, texts, 2)
    assert {i: r.component_id for i, r in got.items()} == components(texts, 2)[0]


def test_repeated_and_missing_ids_and_empty_table(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, None), (3, "x y z"), (4, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in nd.near_duplicates(df, words=2).collect())
    assert got == [(0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 3, False)]
    assert nd.near_duplicates(df.limit(0), words=2).count() == 0


def test_an_id_with_two_texts_joins_the_groups_of_both(spark):
    """In all row orders: documents 2 and 3 are near copies of the two texts of document 1."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a.replace("a30", "z")), (3, b.replace("b30", "z"))]
    for order in itertools.permutations(rows):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = {(r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(df, words=2).collect()}
        assert got == {(1, 1, True), (2, 1, False), (3, 1, False)}


def test_rows_without_id_keep_one_set(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, None), (7, "x y z")]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert all(r.component_id is None and r.kept for r in got if r.n_shingles in (0, 3))
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got if r.n_shingles == 2) == [(0, 7, False), (7, 7, True)]


def test_ids_of_all_signs(spark):
    rows = [(-5, "a b c"), (-7, "a b c"), (0, "x y"), (-(2**63), "q r s"), (2**63 - 1, "q r s")]
    got = {r.doc_id: (r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == {-5: (-7, False), -7: (-7, True), 0: (0, True), -(2**63): (-(2**63), True), 2**63 - 1: (-(2**63), False)}


def test_small_sets_at_the_threshold(spark):
    """Pairs of 4 and 5 shingles, and of 24 and 30, share exactly 0.8: none may be lost."""
    texts = {}
    for g in range(300):
        texts[10 * g] = " ".join(f"g{g}x{i}" for i in range(6))
        texts[10 * g + 1] = " ".join(f"g{g}x{i}" for i in range(5))
        texts[10 * g + 2] = " ".join(f"h{g}x{i}" for i in range(31))
        texts[10 * g + 3] = " ".join(f"h{g}x{i}" for i in range(25))
    got = run(spark, texts, 2)
    assert {i: r.component_id for i, r in got.items()} == components(texts, 2)[0]


def test_a_bucket_of_many_components(spark, monkeypatch):
    """Texts that share most of their shingles, but too few to be linked, in small blocks and rounds."""
    monkeypatch.setattr(nd, "BLOCK", 16)
    monkeypatch.setattr(nd, "HEADS", 2)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(70)]
    texts = {}
    for i in range(120):
        own = common + [f"o{i}y{j}" for j in range(25)]
        texts[i] = " ".join(own)
        if i % 3 == 0:
            own[rng.randrange(len(own))] = "z"
            texts[1000 - i] = " ".join(own)
    got = run(spark, texts, 2)
    assert {i: r.component_id for i, r in got.items()} == components(texts, 2)[0]


def test_registers_estimate_similarity_and_merge():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for both, only in ((2000, 500), (1000, 1000), (100, 20)):
        a, b = pool[: both + only], np.concatenate([pool[:both], pool[both + only : both + 2 * only]])
        regs = nd.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        j = nd.estimated(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(j - both / (both + 2 * only)) < 0.13
    union = np.unique(np.concatenate([a, b]))
    assert (nd.registers(union, np.array([0, len(union)])) == np.maximum(regs[0], regs[1])).all()
