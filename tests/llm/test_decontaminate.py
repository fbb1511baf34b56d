"""Decontamination against all windows of all documents."""

import random

from plain import leaks as all_windows

from loamdex.llm import decontaminate as dc


def run(spark, texts, items):
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items.items()], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): r for r in dc.leaks(docs, bench).collect()}


def test_same_as_all_windows(spark):
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = {i: " ".join(say(rng.randint(15, 60))) for i in range(30)} | {30: None, 31: "", 32: "lone", 33: "just three words", 34: "Just Three  words"}
    texts = {}
    for d in range(120):
        body = say(rng.randint(0, 150))
        if d % 3 == 0:
            passage = items[rng.randrange(30)].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = rng.choice([[], ["new"], [passage[at].upper()]])
            at = rng.randint(0, len(body))
            body[at:at] = passage
        texts[d] = " ".join(body)
    texts |= {200: None, 201: "", 202: "a LONE word", 203: "here are just three words.", 204: "just three words", 205: items[0], 206: " ".join(items[1].split()[1:]), 207: "pad " * 100_000 + items[2]}
    want = all_windows({d: t for d, t in texts.items() if d != 207}, items)
    got = run(spark, texts, items)
    assert got.pop((207, 2)).similarity == 1.0
    assert {k: round(r.similarity, 9) for k, r in got.items()} == {k: round(s, 9) for k, s in want.items()}
    for (d, _), r in got.items():
        assert r.passage.split() == texts[d].split()[r.start_word : r.start_word + r.n_words]
        assert texts[d].encode()[r.start_byte :].decode().startswith(r.passage)


def test_empty_tables_and_repeats(spark):
    assert run(spark, {}, {1: "a b c d e f"}) == {} == run(spark, {1: "a b c d e f"}, {})
    docs = spark.createDataFrame([(1, "a b c d e f")] * 2, "doc_id long, text string")
    assert dc.leaks(docs, docs.withColumnRenamed("doc_id", "item_id")).count() == 4


def test_many_blocks_repeated_items_and_texts_that_are_leaks_all_through(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEM_BYTES", 300)
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    items = {i: say(rng.randint(12, 40)) for i in range(25)} | {100: say(400)}
    items |= {200 + i: items[i] for i in range(3)}
    texts = {d: say(rng.randint(5, 30)) + " " + items[rng.randrange(25)] + " " + say(9) for d in range(40)} | {90: " ".join([items[0]] * 30), 91: items[100], 92: items[100] + " tail", 93: say(50)}
    got = run(spark, texts, items)
    assert {k: round(r.similarity, 9) for k, r in got.items()} == {k: round(s, 9) for k, s in all_windows(texts, items).items()}


def test_window_fingerprints_are_the_signs_of_sums():
    import numpy as np

    rng = np.random.default_rng(2)
    own = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 60, dtype=np.uint64)
    starts = np.array([0, 3, 40])
    for s, got in zip(starts.tolist(), dc._window_fingerprints(own, starts, 20).tolist(), strict=True):
        window = own[s : s + 20].tolist()
        assert got == sum(1 << b for b in range(64) if sum(1 if x >> b & 1 else -1 for x in window) > 0)


def test_the_index_finds_all_within_the_radius():
    import numpy as np

    index = dc.Items(list(range(50)), [" ".join(f"w{i * j % 97}" for j in range(1, 21)) for i in range(50)], 5)
    rng = np.random.default_rng(0)
    for flips in (0, 5, 12, 19, 20):
        for i in range(50):
            bits = sum(1 << int(b) for b in rng.choice(64, flips, replace=False))
            probe = np.array([int(index.prints[i]) ^ bits], np.uint64)
            near = {x for _, x in index.near(20, probe)}
            assert near == set(np.flatnonzero(dc.distance(index.prints, np.repeat(probe, 50)) <= dc.RADIUS).tolist())
