"""Rules on literal inputs, and operators against short plain-Python versions."""

import math
import re
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamdex.functions import facts, text as tx
from loamdex.operators import analytics as an, lexical as lex, relational as rel
from loamdex.plans import reading
from loamdex.sources import files


def test_sentence_chunks_step_back_after_the_last_window(spark):
    said = "One is here. Two is here. Three is here. Four is here. Five is here."
    long = " ".join(f"Sentence {i} says so and so. " + "word " * (i % 50) for i in range(400))
    df = spark.createDataFrame([(1, said), (2, ""), (3, None), (4, " \n\n "), (5, long)], "id long, t string")
    got = {}
    for r in tx.sentence_chunks(df, "id", "t").orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append(r.text)
    assert [c.count(".") for c in got[1]] == [5, 3, 2, 1] and got[2] == [""] and got[4] == [" \n\n "] and got.keys() == {1, 2, 4, 5}
    # by the rule: which sentences each chunk holds
    cut = [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", long) if s.strip()]
    counts, at, want = [len(re.split(r"\s+", s)) for s in cut], 0, []
    while at < len(cut):
        end = next((e for e in range(at + 1, len(cut)) if sum(counts[at:e]) >= 200), len(cut))
        want.append(" ".join(cut[at:end]))
        at = max(end - 3, at + 1)
    assert got[5] == want


def test_romanised_words_and_keys(spark):
    from loamdex.functions import spelling as sp
    from loamdex.plans.text_queries import WORDS_IN_LATIN

    df = spark.createDataFrame([(w,) for w in WORDS_IN_LATIN], "w string").select("w", sp.romanised(F.col("w")).alias("x"))
    assert {r.w: r.x for r in df.collect()} == WORDS_IN_LATIN
    df = spark.createDataFrame([("मेरा पैन कार्ड, मेरा",)], "t string").select(sp.shadows(F.col("t")).alias("k"))
    assert df.first().k == ["mera", "pen", "kard"]


def test_questions_and_answers(spark):
    """Against a direct search for the best place of each text."""
    from loamdex.functions import answers as an

    assert an.fact_asked("how much is the fee due when") == "AMOUNT" and an.fact_asked("date of birth on my pan card") == "DATE"
    assert an.fact_asked("pan number") == "PAN" and an.fact_asked("expand this") is None
    assert an.about_words("when is the school fee due") == ["school", "fee", "due"] and an.about_words("what is my date") == ["date"]
    texts = ["The school fee is due. " + "pad " * 60 + "School fee due on 12/04/2024 or Rs. 5,000", "fee " * 5 + "x" * 700 + " 2024-01-01", "no such thing", None, "Fee 1 Jan 2023 school " + "y " * 200 + "school of 3 Feb 2021"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r for r in an.answers(df, "id", "t", "when is the school fee").collect()}
    about, pattern = ["school", "fee"], re.compile(an.FACTS["DATE"][1])
    for i, text in enumerate(texts):
        t = " ".join((text or "").split())
        places = sorted({m.start() for w in about for m in re.finditer(w, t.lower())})
        if not places:
            assert i not in got
            continue
        ahead = {p: [q for w in about if 0 <= (q := t.lower().find(w, p)) < p + an.WINDOW] for p in places}
        at = min(places, key=lambda p: (-len(ahead[p]), max(ahead[p]) - p, p))
        dates = [(m.start(), m[0]) for m in pattern.finditer(t)]
        behind = [v for p, v in dates if at <= p <= at + an.WINDOW]
        near = sorted((abs(p - at), p, v) for p, v in dates if abs(p - at) <= 3 * an.WINDOW)
        want = behind[0] if behind else near[0][2] if near else None
        assert (got[i].words, got[i].value, got[i].quote) == (len(ahead[at]), want, t[max(0, at - 40) : at + an.WINDOW])


def test_word_windows(spark):
    words = " ".join(f"w{i}" for i in range(500))
    got = spark.createDataFrame([(words,), ("one two",), ("",)], "t string").select(tx.word_windows(F.col("t")).alias("c")).collect()
    cut = words.split()
    assert [r.c for r in got] == [[" ".join(cut[0:200]), " ".join(cut[170:370]), " ".join(cut[340:540])], ["one two"], [""]]


def test_roots_and_tolerance():
    assert "run" not in lex.roots("running") and "runn" in lex.roots("running")
    assert lex.roots("planning") == ["plan", "plann", "planne"]
    assert lex.tolerance("abcd") == 1 and lex.tolerance("abcde") == 2


def test_bm25_against_plain_python(spark):
    docs = ["the red fox", "the fox the dog", "a cat", "", "fox fox fox fox dog"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    got = {r.id: r.score for r in lex.bm25(df, "id", "text", [(["fox"], 1.0), (["dog", "cat"], 0.5)]).collect()}
    cut = [re.findall(r"\w+", d) for d in docs]
    mean, n = sum(map(len, cut)) / len(cut), len(cut)
    want = {}
    for group, weight in ((["fox"], 1.0), (["dog", "cat"], 0.5)):
        tf = [sum(w in group for w in d) for d in cut]
        df_ = sum(x > 0 for x in tf)
        for i, x in enumerate(tf):
            if x:
                want[i] = want.get(i, 0) + weight * math.log((n - df_ + 0.5) / (df_ + 0.5) + 1) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(cut[i]) / mean))
    assert got == pytest.approx(want)


def test_longest_run(spark):
    df = spark.createDataFrame([("last working days of may",), ("say: working, days",), ("the last worked",)], "t string")
    assert [r.n for r in df.select(lex.longest_run(F.col("t"), ["last", "working", "day"]).alias("n")).collect()] == [3, 2, 0]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=30), st.floats(0, 1))
def test_floor_index(values, share):
    assert sorted(values)[math.floor((len(values) - 1) * share)] in values


def test_percentiles_take_the_floor_index(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 4, 2, 3, 9)], "k string, v double")
    row = an.percentile_at(df, ["k"], "v", [0.5, 0.95]).first()
    assert (row.p50, row.p95) == (3.0, 5.0)


def test_mcnemar():
    assert an.mcnemar(0, 0) == 1.0
    assert an.mcnemar(1, 9) == pytest.approx(2 * 11 / 1024)


def test_logistic_finds_the_slope():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 1))
    y = rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0])))
    assert an.logistic(x, y.astype(float)) == pytest.approx([0.5, 2.0], abs=0.2)


NOW = datetime(2024, 1, 31)


@pytest.mark.parametrize(
    "said, since, until",
    [
        ("bill from last month", datetime(2023, 12, 1), datetime(2024, 1, 1)),
        ("photos this week", datetime(2024, 1, 29), datetime(2024, 2, 5)),
        ("3 days ago", datetime(2024, 1, 28), datetime(2024, 1, 29)),
        ("invoice in march 2022", datetime(2022, 3, 1), datetime(2022, 4, 1)),
        ("report 2021?", datetime(2021, 1, 1), datetime(2022, 1, 1)),
    ],
)
def test_periods(said, since, until):
    assert reading.read_period(said, NOW)[0] == (since, until)


def test_may_alone_is_no_month():
    assert reading.read_period("may I see it", NOW)[0] is None
    assert reading.read_period("bill in may", NOW)[0][0].month == 5


def test_amounts():
    assert reading.read_amount("between rs 2,000 and 1 lakh")[0] == (2000.0, 100000.0)
    assert reading.read_amount("around 500")[0] == pytest.approx((450.0, 550.0))
    assert reading.read_amount("over 5k")[0] == (5000.0, float("inf"))
    assert reading.read_amount("no number")[0] is None


def test_operators_and_acronyms():
    p = reading.plan("type:pdf otp source:mail latest", now="2024-01-31")
    assert p.operators == {"type": "pdf", "source": "mail"} and p.words == "otp" and p.newest_first and p.limit == 1
    assert "Password" in reading.expanded("otp")


def test_dates_and_amounts_read_from_text(spark):
    row = spark.sql("select 31 d, 2 m, 2024 y, '1,20,000.5' a").select(facts.date_of(F.col("d"), F.col("m"), F.col("y")).alias("none"), facts.date_of(F.lit(29), F.col("m"), F.col("y")).alias("leap"), facts.amount(F.col("a"), F.lit("lakh")).alias("amount")).first()
    assert row.none is None and str(row.leap) == "2024-02-29" and row.amount == 120000.5 * 1e5


def test_masking(spark):
    said = ["Your OTP is 482913.", "password: hunter2 ok", "card 4111 1111 1111 1111 or 4111 1111 1111 1112", None, ""]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "t string").select(tx.masked(F.col("t"))).collect()]
    assert got == [f"Your OTP is {tx.HIDDEN}.", f"password: {tx.HIDDEN} ok", f"card {tx.HIDDEN} or 4111 1111 1111 1112", None, ""]


def test_trust(spark):
    said = ["", "Plain words that are fine.", "one two", "�� ��� � ab cd ef"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "t string").select(tx.trust(F.col("t"))).collect()]
    assert [g.trusted for g in got] == [False, True, False, False]
    assert got[0].reasons == ["BLANK"] and got[2].reasons == ["TOO_FEW_WORDS"] and "REPLACEMENT_CHARS" in got[3].reasons


def test_seed_wraps(spark):
    def plain(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) % 2**64
        return h - 2**64 if h >= 2**63 else h

    said = ["", "a", "a long name that wraps around many times"]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in said], "t string").select(tx.seed64(F.col("t"))).collect()] == [plain(s) for s in said]


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, rel.upsert(old, new, ["k"], [F.desc("v")]).collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_sessions_split_after_strictly_more_than_the_gap(spark):
    df = spark.sql("select 1 k, timestamp'2024-01-01' ts union all select 1, timestamp'2024-01-04' union all select 1, timestamp'2024-01-07 00:00:01' union all select 1, null")
    assert sorted(r.session for r in rel.gap_sessions(df, ["k"], "ts", 3 * 86400).collect()) == [0, 1, 1, 2]


def test_files_read_what_was_packed(spark):
    made = files.made_docx(["One & two", "three"])
    rows = spark.createDataFrame([("a.docx", bytearray(made)), ("b.docx", bytearray(b"no zip")), ("c.xyz", bytearray(b""))], "path string, content binary")
    got = {r.path: r for r in files.pages_of(rows).collect()}
    assert got["a.docx"].text == "One & two\nthree" and got["a.docx"].failure is None
    assert got["b.docx"].text is None and "BadZipFile" in got["b.docx"].failure and "unknown" in got["c.xyz"].failure


def test_pdf_text_layer():
    import zlib

    body = zlib.compress(rb"BT /F1 12 Tf (Hello \(there\)) Tj T* [(wo) -20 (rld)] TJ ET")
    data = b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode /Length 9 >>\nstream\n" + body + b"\nendstream\nendobj"
    assert files.pdf(data) == ["Hello (there)\nworld"]
    with pytest.raises(ValueError):
        files.pdf(b"%PDF-1.4")
