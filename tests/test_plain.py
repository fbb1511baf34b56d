"""Queries without SQL, and operators, against plain versions on the smallest tables."""

import math
import re

import numpy as np
import pytest

from loamdex.functions import answers, rules, text as tx
from loamdex.operators import analytics as an, vectors as vec
from loamdex.plans import catalog, reading  # noqa: F401
from loamdex.plans.registry import ENTRIES, Tables
from loamdex.sources import files


@pytest.fixture(scope="module")
def t(spark, small):
    return Tables(spark, small)


def rows(name, t):
    return ENTRIES[name].run(t).collect()


def test_significance(t):
    (r,) = rows("significance", t)
    pairs = [(x.quality, x.toxic) for x in t.labels.collect()]
    assert (r.a, r.b) == (pairs.count((1, 1)), pairs.count((0, 0)))
    n, least = r.a + r.b, min(r.a, r.b)
    assert r.p == pytest.approx(min(1.0, 2 * sum(math.comb(n, i) for i in range(least + 1)) / 2**n), abs=1e-6)


def slope(x, y, w, ridge=1e-3):
    x = np.column_stack([np.ones(len(x)), x])
    return x.T @ (y - 1 / (1 + np.exp(-x @ w))) - ridge * w


def test_logistic_fits_are_at_their_best():
    rng = np.random.default_rng(1)
    for seed in range(20):
        x = rng.normal(size=(300, 4))
        y = (rng.random(300) < 1 / (1 + np.exp(-(x @ np.array([1.0, -1.5, 0.3, -0.2]) + 0.4)))).astype(float)
        assert np.abs(slope(x, y, an.logistic(x, y))).max() < 1e-6
        w = an.logistic(x, y, non_negative=True)
        s = slope(x, y, w)
        # no weight below zero; none above zero could be bettered, and those at zero want to be below
        assert (w[1:] >= 0).all() and abs(s[0]) < 1e-5 and (np.abs(s[1:][w[1:] > 0]) < 1e-5).all() and (s[1:][w[1:] == 0] <= 1e-6).all(), seed


def test_calibration_scores_the_other_half(t):
    got = rows("logistic_calibration", t)
    assert got and all(0 < r.chance < 1 for r in got)
    assert len({r.doc_id for r in got}) == len(got) < t.labels.count()
    weights = {r.feature: r.weight for r in rows("ranker_weights", t)}
    assert set(weights) == {"base", "phrase", "share", "run", "short"} and all(w >= 0 for f, w in weights.items() if f != "base")


def test_masked_cards(t):
    def luhn(digits):
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0

    masked = {r.doc_id: r.hidden for r in rows("mask_cards", t)}
    card = re.compile(r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)")
    for d in t.documents.collect():
        found = [m for m in card.findall(d.text or "") if 13 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))]
        if found:
            assert masked[d.doc_id] >= len(found)


def test_trust_of_documents(t):
    got = {r.doc_id: r for r in rows("trust_scores", t)}
    for d in t.documents.where("text is not null").collect():
        solid = re.sub(r"\s", "", d.text)
        few = len(d.text.split()) < 3
        low = solid and sum(c.isalpha() or c.isdecimal() for c in solid) / len(solid) < 0.5
        if solid:
            assert ("TOO_FEW_WORDS" in got[d.doc_id].reasons) == few and ("LOW_LETTER_RATIO" in got[d.doc_id].reasons) == bool(low)


def test_merged_readings_keep_what_most_readings_have(spark, t):
    from loamdex.functions import spelling as sp

    said = {0: ["a b", "c d", "d c a"], 1: ["a b", "x y"], 2: ["A b!", "c d", "b"]}
    lines = [(1, r, i, x) for r, xs in said.items() for i, x in enumerate(xs)] + [(2, 0, 0, "alone"), (2, 0, 1, "alone")]
    df = spark.createDataFrame(lines, "item long, reading int, at int, text string")
    got = sorted((r.item, r.line, r.seen_by) for r in sp.merged_readings(df, "item", "reading", "at", "text").collect())
    # two readings of three have a line, or it says a new word; of one reading all stays
    assert got == [(1, "a b", 3), (1, "c d", 2), (1, "x y", 1), (2, "alone", 1)]
    whole = {r.conv_id: r for r in rows("merged_readings", t)}
    said = {r.conv_id for r in t.conversations.collect() if re.sub(r"[\W_]+", "", r.text or "")}
    assert whole.keys() == said and all(r.lines >= 1 and 1 <= r.most <= 3 for r in whole.values())


def test_merged_readings_deal_each_text_once(spark, t):
    # by item alone, and without a row for each word
    from loamdex.functions import spelling as sp

    df = ENTRIES["merged_readings"].run(t)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.count("FileScan") <= 1
    # words that an earlier line of the same rank says are not new
    lines = [(7, r, i, x) for r, xs in enumerate((["p q", "r s"], ["q p", "s"], ["z"])) for i, x in enumerate(xs)]
    df = spark.createDataFrame(lines, "item long, reading int, at int, text string")
    got = sorted((r.line, r.seen_by, r.place) for r in sp.merged_readings(df, "item", "reading", "at", "text").collect())
    assert got == [("p q", 1, 0.0), ("r s", 1, 1.0), ("z", 1, 0.0)]


def test_misread_texts(spark):
    from loamdex.functions import spelling as sp

    said = "Only 50 of the Bees come to see B0le in Oslo; all lose. " * 40
    df = spark.createDataFrame([(1, said), (2, said), (3, None), (4, "")], "id long, t string")
    got = {r.id: r.x for r in df.select("id", sp.misread(df.t, df.id, 10).alias("x")).collect()}
    assert got[1] != got[2] and got[3] is None and got[4] == ""
    for x in (got[1], got[2]):
        swaps = [(a, b) for a, b in zip(said, x, strict=True) if a != b]
        assert set(swaps) <= set(zip("oOlI5Be0", "0O1l$8co")) and 0.2 < len(swaps) / (sum(c in "olI5Be0" for c in said) / 10) < 3


def test_direct_answers(t):
    question = "which version of the general public license"
    about = answers.about_words(question)
    assert about == ["version", "general", "public", "license"] and answers.fact_asked(question) is None
    want = {}
    for d in t.documents.where("text is not null").collect():
        low = " ".join(d.text.split()).lower()
        places = {m.start() for w in about for m in re.finditer(w, low)}
        if places:
            want[d.doc_id] = max(sum(0 <= low.find(w, p) - p < answers.WINDOW for w in about) for p in places)
    best = sorted(want, key=lambda i: (-want[i], i))[:20]
    got = rows("direct_answers", t)
    assert [(r.doc_id, r.words) for r in got] == [(i, want[i]) for i in best]


def test_marks_of_other_forms(spark):
    df = spark.createDataFrame([(1, "Plan, planned plans; planning the plant"), (2, "copies and a copy"), (3, None)], "id long, t string")
    got = {}
    for r in rules.marks(df, "id", "t", ["planned", "copies"]).orderBy("id", "start").collect():
        got.setdefault(r.id, []).append((r.start, r.end))
    assert got == {1: [(0, 4), (6, 13), (14, 19), (21, 29)], 2: [(0, 6), (13, 17)]}
    assert rules.mark_roots("planned") == ["plann", "plan"] and "copy" in rules.mark_roots("copies")


def test_broken_files_are_results(spark):
    df = spark.createDataFrame([("a.pdf", b"no"), ("b.docx", b"PK"), ("c.zip", b""), ("d.epub", files.made_epub([(1, "x")]))], "path string, content binary")
    got = {r.path: r for r in files.pages_of(df).collect()}
    assert all(got[p].failure and got[p].text is None for p in ("a.pdf", "b.docx", "c.zip")) and got["d.epub"].text == "x & its people, no 1"


def test_near_signatures_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 30)
    bits = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 12), replace=False)) for b in base for _ in range(4)] + [7, 7, 7]
    df = spark.createDataFrame(list(enumerate(bits)), "id long, bits long")
    got = {(r.a, r.b): r.distance for r in vec.near_signatures(df, "id", "bits", 9).collect()}
    want = {(i, j): d for i in range(len(bits)) for j in range(i + 1, len(bits)) if (d := bin((bits[i] ^ bits[j]) & (2**64 - 1)).count("1")) <= 9}
    assert got == want


def test_near_signatures_of_several_groups(spark, monkeypatch):
    monkeypatch.setattr(vec, "GROUP", 40, raising=False)
    monkeypatch.setattr(vec, "AT_ONCE", 7, raising=False)
    rng = np.random.default_rng(6)
    bits = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 12), replace=False)) for b in rng.integers(-(2**63), 2**63, 25) for _ in range(4)] + [7, 7, -1, -1]
    df = spark.createDataFrame([*enumerate(bits), (999, None)], "id long, bits long")
    for radius in (0, 2, 9):
        near = vec.near_signatures(df, "id", "bits", radius)
        # one row for each group that a signature meets, none for each near value
        assert near._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") <= 1
        want = {(i, j, d) for i in range(len(bits)) for j in range(i + 1, len(bits)) if (d := bin((bits[i] ^ bits[j]) & (2**64 - 1)).count("1")) <= radius}
        got = [tuple(r) for r in near.collect()]
        assert len(got) == len(want) and set(got) == want


def test_windows_cut_a_text_once(spark):
    """Twice the text may take little more than twice the time."""
    import time

    def took(n):
        df = spark.createDataFrame([("word " * n,)], "t string")
        start = time.perf_counter()
        df.select(tx.word_windows(df.t).alias("c")).selectExpr("size(c)").collect()
        return time.perf_counter() - start

    took(1000)
    assert took(160_000) < 3 * took(80_000) + 1.5


def test_many_queries_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vec, "FEW", 3)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(10)], "query_id long, query array<double>")
    got = {(r.id, r.query_id): r.score for r in vec.scored(rows, asked, vec.dot).collect()}
    assert got == {(i, q): float(i + q) for i in range(8) for q in range(10)}


def test_pages_wait_for_those_before_them(spark, tmp_path):
    """Files come one after another; a page that never comes holds back all behind it."""
    from loamdex.streaming import jobs

    place = f"file://{tmp_path}/in"
    for part in ([(1, 2), (1, 3), (2, 1)], [(1, 1), (2, 3)], [(2, 4), (1, 4), (1, 2)]):
        spark.createDataFrame(part, "doc long, page long").coalesce(1).write.mode("append").parquet(place)
    stream = jobs.in_order(jobs.source(spark, place, files_per_batch=1), "doc", "page")
    got = sorted(tuple(r) for r in jobs.run_available(stream, f"file://{tmp_path}/out").collect())
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (2, 1, 1)]


def test_merged_tables_rewrite_what_changes_alone(spark, tmp_path):
    from loamdex.streaming import jobs

    place, rows = f"file://{tmp_path}/in", {}
    for n, part in enumerate(([(k, 10, f"a{k}") for k in range(200)], [(5, 11, "b"), (6, 9, "old"), (300, 1, "new")])):
        spark.createDataFrame(part, "k long, at long, v string").coalesce(1).write.mode("append").parquet(place)
        stream = jobs.source(spark, place)
        got = {r.k: r.v for r in jobs.run_merged(stream, f"file://{tmp_path}/out", ["k"], "at").collect()}
        for k, at, v in part:
            rows[k] = max(rows.get(k, (0, "")), (at, v))
        assert got == {k: v for k, (_, v) in rows.items()}, n
    touched = [p.name for p in (tmp_path / "out" / "rows").glob("batch=00000001/folder=*")]
    assert 1 <= len(touched) <= 3


def test_plans_of_words():
    p = reading.plan('"last month" bill between 2 lakh and 3 lakh oldest', now="2024-01-31")
    assert p.words == "last month bill" and p.period is None and p.amount == (200000.0, 300000.0) and p.newest_first is False and p.limit == 1
