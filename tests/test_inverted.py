"""The keyword index against a plain one: add, replace, remove, sweep, ties, unknown words."""

import math
import random
import re

import pytest

from loamdex.operators import inverted as iv, lexical as lex

WORDS = ["red", "fox", "dog", "cat", "licence", "license", "licensed", "run", "running", "ünder", "x1", "ok"]


def bm25(texts, groups):
    cut = {i: re.findall(r"\w+", (t or "").lower()) for i, t in texts.items()}
    n, mean = len(cut), sum(map(len, cut.values())) / max(1, len(cut))
    out = {}
    for group, weight in groups:
        tf = {i: sum(w in group for w in ws) for i, ws in cut.items()}
        df = sum(x > 0 for x in tf.values())
        for i, x in tf.items():
            if x:
                out[i] = out.get(i, 0) + weight * math.log((n - df + 0.5) / (df + 0.5) + 1) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(cut[i]) / mean))
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string")


def same(index, texts, query):
    got = {r.id: r.score for r in index.bm25(query).collect()}
    assert got == pytest.approx(bm25(texts, [([w], 1.0) for w in query]))


def test_a_life_of_an_index(spark, tmp_path):
    rng = random.Random(1)
    say = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))
    place = f"file://{tmp_path}/ix"
    texts = {i: say() for i in range(60)} | {60: None, 61: "", 62: "Red, RED; red!"}
    index = iv.Index(spark, place).add(frame(spark, texts), "id", "text")
    same(index, texts, ["fox", "red", "fox", "absent"])
    more = {i: say() for i in range(50, 75)}  # replaces some, adds some
    index.add(frame(spark, more), "id", "text")
    texts |= more
    same(index, texts, ["fox", "red"])
    index.remove(spark.createDataFrame([(i,) for i in (3, 55, 70, 999)], "id long"), "id")
    for i in (3, 55, 70):
        del texts[i]
    same(index, texts, ["dog", "ünder"])
    assert (index.live, index.words) == (len(texts), sum(len(re.findall(r"\w+", t or "")) for t in texts.values()))
    again = iv.Index.opened(spark, place)
    same(again, texts, ["cat"])
    assert {r.id for r in index.first_added().where("first > 1").collect()} == set(range(63, 75)) - {70}
    index.sweep()
    assert len(index.segments) == 1 and index.dead == 0
    same(index, texts, ["dog", "ünder", "red"])
    assert {r.id for r in iv.Index.opened(spark, place).first_added().where("first > 1").collect()} == set(range(63, 75)) - {70}
    index.add(frame(spark, {3: "fox again"}), "id", "text")
    assert index.first_added().where("id = 3").first().first > 2
    terms = {(r.term, r.df) for r in index.terms().collect()}
    assert ("fox", sum("fox" in re.findall(r"\w+", t or "") for t in (texts | {3: "fox again"}).values())) in terms


def test_ties_go_to_what_was_added_first(spark, tmp_path):
    index = iv.Index(spark, f"file://{tmp_path}/ix").add(frame(spark, {5: "a fox", 9: "a fox"}), "id", "text")
    index.add(frame(spark, {1: "a fox", 9: "a fox"}), "id", "text")
    assert [r.id for r in index.best(["fox"]).collect()] == [5, 9, 1]
    index.remove(spark.createDataFrame([(9,)], "id long"), "id").add(frame(spark, {9: "a fox"}), "id", "text")
    assert [r.id for r in index.best(["fox"], 3).collect()] == [5, 1, 9]


def test_unknown_words_and_candidates(spark, tmp_path):
    texts = {1: "licence of a dog", 2: "licensed fox", 3: "run fox run", 4: "cat", 5: "work of the day"}
    index = iv.Index(spark, f"file://{tmp_path}/ix").add(frame(spark, texts), "id", "text")
    for query, groups in ((["licens"], [(["licensed"], 0.5)]), (["licens", "fox"], [(["licensed"], 0.5), (["fox"], 1.0)]), (["runing"], []), (["running"], []), (["licance"], [(["licence"], 0.5)]), (["worked"], [(["work"], 0.5)])):
        got = {r.id: r.score for r in index.bm25(index.expanded(query)).collect()}
        assert got == pytest.approx(bm25(texts, groups)), query
    every = frame(spark, texts).select("id")
    says = every.where("id = 4")
    assert {r.id for r in index.candidates(["dog", "fox"], says, every).collect()} == {1, 2, 3, 4}
    assert {r.id for r in index.candidates(["zebra"], says.limit(0), every).collect()} == {1, 2, 3, 4, 5}


def test_sweeps_when_many_are_dead(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(iv, "SWEEP_AT", 4)
    index = iv.Index(spark, f"file://{tmp_path}/ix").add(frame(spark, {i: "fox" for i in range(10)}), "id", "text")
    index.add(frame(spark, {i: "dog" for i in range(3)}), "id", "text")
    assert len(index.segments) == 2 and index.dead == 3
    index.add(frame(spark, {i: "cat" for i in range(4)}), "id", "text")
    assert len(index.segments) == 1 and index.dead == 0 and index.terms().where("term = 'dog'").count() == 0


def test_cuts_as_the_word_cutter_does(spark, tmp_path, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, "don't ÉTÉ-x_y 日本語 áb \U0001f600 ١٢"), (-2, None)], docs.schema)
    docs = docs.unionByName(odd)
    index = iv.Index(spark, f"file://{tmp_path}/ix").add(docs, "doc_id", "text")
    got = {(r.term, r.id, r.tf) for r in index.postings().collect()}
    assert got == {(r.term, r.doc_id, r.tf) for r in lex.postings(docs, "doc_id", "text").collect()}
    assert index.live == docs.count() and iv.Index(spark, f"file://{tmp_path}/none").add(docs.limit(0), "doc_id", "text").bm25(["a"]).count() == 0
