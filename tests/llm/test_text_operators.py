"""Main text, languages, token counts: against plain versions, and odd inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamdex.llm import languages as lg, main_text as mt, token_counts as tc
from loamdex.llm.queries import vocabulary

PAGES = [
    (
        '<body><header><h1>Site</h1></header><div class="content"><h2>Title</h2><p>Some long paragraph of text that goes on and on, with punctuation.</p><p>Yes.</p><ul><li>Item one of the list</li></ul></div>'
        '<aside>Side stuff here.</aside><div id="comments"><p>Great article, thanks a lot for sharing it with all of us here.</p></div><footer>(c)</footer></body>',
        "Title Some long paragraph of text that goes on and on, with punctuation. Yes. Item one of the list",
    ),
    ('<div class="cookie-notice">We use cookies on this site to improve things. OK.</div><div>Plain text without tags, which is long enough to be content, surely.</div><form><p>Subscribe to our list</p></form>', "Plain text without tags, which is long enough to be content, surely."),
    ('<main><div class="related-posts"><a href=x>Other</a></div><article><h1>Head &amp; line</h1><p>Text&nbsp;here<br>and <b>bo</b>ld &#8212; &lt;ok&gt;.<p>Unclosed para<section class="comments"><p>I like this.</p></section></article></main>', "Head & line Text here and bold — <ok>. Unclosed para"),
    ("<article><p>One</p><script>if (a < b) { x('</p>') }</script><p hidden>no</p><p>Two</p>", "One Two"),
    ("a < b and c > d, which is text", "a < b and c > d, which is text"),
    ("<p>seen by all of us<!-- unclosed", "seen by all of us"),
    ("<script>alert(1)", ""),
    # words of names weigh, and don't decide, inside an article
    ('<article><p>One two three.</p><div class="legal-analysis"><p>The court held that the law applies.</p></div><section class="form-and-function"><p>Design follows use.</p></section></article>', "One two three. The court held that the law applies. Design follows use."),
    ("<article><p>We see <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p><noscript><p>This is shown without scripts.</p></noscript></article>", "We see x=2 here. This is shown without scripts."),
    ('<article><p>Some prose <span class="advert">Buy <b>now</b></span> goes on<button>Like</button>.</p><div class="ad">Buy this.</div><ul class="share-buttons"><li>Send</li></ul></article>', "Some prose goes on."),
    ('<article><p>Some prose <span hidden>x<div>y</div> z</span> ends here.</article>', "Some prose y z ends here."),  # the div ends the paragraph and all in it
    ("<article><p>One <svg/>two <svg>no</svg><object>three.</p>", "One two three."),
    ('<article title="a > b"><p>All of this.</p></article data-x="1"><a ', "All of this."),
    ("", ""),
    (None, ""),
    ("  \n ", ""),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, "u", h, "clash") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in mt.main_texts(df).collect()}
    assert [got[i].text for i in range(len(PAGES))] == [t for _, t in PAGES]
    assert all(r.n_chars == len(r.text) for r in got.values()) and mt.main_texts(df.limit(0)).count() == 0


def test_generated_pages_give_their_article(small):
    """The tables' pages hold one article each: all of it comes out, and nothing else."""
    import html
    import re

    import duckdb

    for (page,) in duckdb.sql(f"select html from '{small}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", article))
        assert mt.main_text(page) == " ".join(html.unescape(plain).split())


def cost(labels, odds, edges):
    return sum(max(0, -o) if on else max(0, o) for on, o in zip(labels, odds)) + sum(w for i, j, w in edges if labels[i] != labels[j])


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 9)
        odds = [rng.choice([-30.0, rng.uniform(-2, 2)]) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1.5)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        best = min(cost(x, odds, edges) for x in itertools.product((False, True), repeat=n))
        assert cost(mt.minimum_cut(odds, edges), odds, edges) == pytest.approx(best)


HOSTILE = ["<a ", "<a x='", '<a x=">', "<p>some words.", "<p>some words.</p><nav>x y</nav>", "<div>", "<b>", "<svg>", "<!--", "<script>", "<", "= ", "<ul><li>x", "<p><span class=ad>", "</i>", "<table><td>x"]


@pytest.mark.parametrize("part", HOSTILE)
def test_hostile_pages_take_no_longer(part):
    """Twice the page may take little more than twice the time."""
    import time

    def took(n):
        page = "<a " * (part == "= ") + part * (n // len(part)) + "</i>" * (part == "<b>") * (n // 8)
        start = time.process_time()
        mt.main_text(page)
        return time.process_time() - start

    took(10_000)
    assert took(1_000_000) < 3 and took(400_000) < 3 * took(200_000) + 0.3


def test_large_page_is_read_whole():
    page = "<article>" + "<p>word one two.</p>" * 20_000 + "</article><nav>" + "<a href=x>menu</a>" * 2000 + "</nav>"
    assert mt.main_text(page) == " ".join(["word one two."] * 20_000)


TEXTS = {"en": "the quick brown fox jumps over the lazy dog and then it was there with them", "de": "der schnelle braune fuchs springt über den faulen hund und dann war er nicht mehr da", "fr": "le renard brun saute par dessus le chien paresseux et puis il était là avec eux", "es": "el rápido zorro marrón salta sobre el perro perezoso y luego estaba allí con ellos"}


def labelled(spark, n=80, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(TEXTS))
        cut = TEXTS[lang].split()
        rows.append((i, " ".join(rng.choices(cut, k=rng.randint(6, 40))), lang, f"h{i % 5}"))
    return rows


def test_held_out_texts_get_their_language(spark):
    train = spark.createDataFrame(labelled(spark), "doc_id long, text string, lang string, source string")
    model = lg.trained(train, id_col="doc_id", text_col="text", label_col="lang")
    held = labelled(spark, 60, seed=9)
    rng = random.Random(4)
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(400)), "12345 !!! ###", "", None, "   "]
    rows = [(i, t, None, None, lang) for i, t, lang, _ in held] + [(1000 + i, t, None, None, None) for i, t in enumerate(junk)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, language string")
    got = {r.doc_id: r for r in lg.identified(df, declared=F.col("declared"), host=F.col("host"), model=model).collect()}
    assert sum(got[i].language == lang for i, _, lang, _ in held) >= 58
    assert not any(got[1000 + i].accepted or got[1000 + i].language for i in range(len(junk)))


def test_other_evidence_decides_where_the_text_is_thin(spark):
    model = lg.trained(spark.createDataFrame(labelled(spark, 200), "doc_id long, text string, lang string, source string"), id_col="doc_id", text_col="text", label_col="lang")
    rows = [(i, t, lang, "https://%s.site%d.example.%s/x" % (lang, i % 3, lang)) for i, t, lang, _ in labelled(spark, 200, seed=3)] + [(900, "de", "es", "https://es.site1.example.es/y"), (901, "de", "fr-FR", "https://fr.site1.example.fr/y"), (902, "de", None, "not an address")]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, url string")
    suffix, host, domain = lg.address_clues(F.col("url"))
    got = {r.doc_id: r for r in lg.identified(df, declared=F.col("declared"), suffix=suffix, host=host, domain=domain, model=model).collect()}
    assert got[900].language == "es" and got[901].language == "fr" and got[902].accepted
    assert lg.identified(df.limit(0), declared=F.col("declared"), model=model).count() == 0


def test_posterior_is_the_plain_one(spark):
    """Counts and the fusion formula in plain Python, on pages with hosts, domains, suffixes and declarations."""
    import math

    rng = random.Random(7)
    rows = [(i, t, rng.choice([lang, lang, "en", None]), rng.choice([f"https://{lang}{i % 2}.site.example.{lang}/x", f"http://other.example.org/{i}", "no address"]), lang) for i, t, lang, _ in labelled(spark, 120, seed=5)]
    rows += [(500, None, "en", "http://other.example.org/", None), (501, "12 34", "de", None, None), (0, rows[0][1], rows[0][2], rows[0][3], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, url string, label string")
    model = lg.trained(df, id_col="doc_id", text_col="text", label_col="label")
    suffix, host, domain = lg.address_clues(F.col("url"))
    given = {(r.doc_id, r.url): (r.s, r.h, r.d) for r in df.select("*", suffix.alias("s"), host.alias("h"), domain.alias("d")).collect()}
    got = sorted((r.doc_id, r.text_md5 or "", r.language, r.by_text, r.confidence) for r in lg.identified(df, declared=F.col("declared"), suffix=suffix, host=host, domain=domain, model=model).collect())
    names = [*lg.LANGUAGES, lg.OTHER]
    k, plain = len(names), []
    for i, text, declared, url, _ in rows:
        data = [c if c >= 128 else c | 32 if chr(c).isalpha() else 32 for c in (text or "").encode()]
        data = [32, *data, 32]
        grams = [(a << 16 | b << 8 | c) for a, b, c in zip(data, data[1:], data[2:]) if b != 32 or (a != 32 and c != 32)]
        places = [(g * 0x9E3779B1 % 2**32) >> (32 - lg.BITS) for g in grams]
        like = [round(sum(float(model[p, c]) for p in places) * lg.TEMPER, 6) for c in range(k)]
        plain.append((i, text, declared, *given[i, url], like, max(range(k), key=lambda c: (like[c], -c)) if places else None))
    every = [sum(r[-1] == c for r in plain) for c in range(k)]
    overall = [(n + 1) / (sum(every[:-1]) + k - 1) * (1 - lg.STRANGE) for n in every[:-1]] + [lg.STRANGE]
    want = []
    for row in plain:
        i, text, declared, suf, hst, dom, like, first = row
        own = [float(first == c) for c in range(k)]
        counts = lambda place, value: [sum(r[place] == value and r[-1] == c for r in plain) - own[c] for c in range(k)]
        prior = overall
        for place, value in ((5, dom), (4, hst)):
            if value is not None:
                n = counts(place, value)[:-1]
                prior = [(x + lg.KAPPA * p) / (sum(n) + lg.KAPPA) * (1 - lg.STRANGE) for x, p in zip(n, prior)] + [lg.STRANGE]
        joint = [math.log(p) + x for p, x in zip(prior, like)]
        for place, value in ((2, declared), (3, suf)):
            if value is not None:
                n = counts(place, value)
                share = sum(n) / max(1, sum(every))
                joint = [j + math.log((x + lg.KAPPA * share + 1e-3) / (a - o + lg.KAPPA)) for j, x, a, o in zip(joint[:-1], n, every, own)] + [joint[-1] + math.log(share + 1e-3 / lg.KAPPA)]
        top = max(joint)
        won = joint.index(top)
        want.append((i, names[won] if first is not None and won < k - 1 else None, names[first] if first is not None else None, 1 / sum(math.exp(j - top) for j in joint)))
    want.sort(key=lambda x: (x[0], x[3]))
    mine = sorted(((i, lang, by, c) for i, _, lang, by, c in got), key=lambda x: (x[0], x[3]))
    assert [x[:3] for x in mine] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(mine, want))


def test_pages_bring_their_own_evidence(spark, small):
    docs, pages = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/pages.parquet")
    model = lg.trained(docs, id_col="doc_id", text_col="text", label_col="lang")
    got = lg.of_pages(pages, model=model).collect()
    declared = {r.page_id: r.d for r in pages.select("page_id", lg.declared_language(F.col("html")).alias("d")).collect()}
    # what the text alone says is held against the markup, which is no part of it
    assert len(got) == len(declared) and sum(r.by_text == declared[r.page_id] for r in got) >= 0.95 * len(got)
    assert all(r.url for r in got) and lg.of_pages(pages.limit(0), model=model).count() == 0
    late = "<!--" + "x" * 5000 + "--><html " + "data-a='b' " * 500 + "LANG=es-MX><p>x"
    assert spark.createDataFrame([(late,)], "h string").select(lg.declared_language(F.col("h"))).first()[0] == "es"


def test_long_texts_repeated_rows_and_ties(spark):
    model = lg.trained(spark.createDataFrame(labelled(spark, 120), "doc_id long, text string, lang string, source string"), id_col="doc_id", text_col="text", label_col="lang")
    flat = np.full_like(model, -9.0)
    rows = [(1, (TEXTS["de"] + " ") * 40_000, "x"), (2, TEXTS["fr"], "x"), (2, TEXTS["fr"], "x"), (2, TEXTS["es"], "x"), (None, TEXTS["en"], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string").withColumn("confidence", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.language, r.accepted) for r in lg.identified(df, host=F.col("host"), model=model).collect())
    assert got == [(0, "en", True), (1, "de", True), (2, "es", True), (2, "fr", True), (2, "fr", True)]
    # of equal evidence the earlier language wins
    assert {r.by_text for r in lg.identified(df, model=flat).collect()} == {lg.LANGUAGES[0]}


def test_a_hot_repeated_id_stays_one_sample(spark):
    rows = [(1, "the same text over and over", "en")] * 3000 + [(1, f"text number {i} of the same id", "en") for i in range(300)] + [(i, f"ein text {i}", "de") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert lg.trained(df, id_col="doc_id", text_col="text", label_col="lang", sample=50).shape == (2**lg.BITS, 5)


def test_address_clues(spark):
    row = spark.createDataFrame([("http://u@www.A.example.DE:80/x?y",)], "u string").select(*lg.address_clues(F.col("u")), lg.declared_language(F.lit("<!doctype html><HTML class=x lang='fr-CA'>"))).first()
    assert tuple(row) == ("de", "www.a.example.de", "a.example.de", "fr")


def unigram(pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tc.BLANK, prepend_scheme="always", split=True)
    return t


ODD = [" lead", " ", "", None, "a  b   ", "日本語 ਅx", "ab\n\ncd\t", "ሴስ \U0001f600\U0001f601z", "<0x0A> x▁y", "x" * 3000, "▁", "tail "]


def test_counts_as_the_tokenizer_does(spark, small):
    pieces, _ = tc.load_pieces(vocabulary("piece_bpe_32k.model"))
    whole = unigram(pieces)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.lit("clash").alias("n_tokens"))
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, t, "x") for i, t in enumerate(ODD)], docs.schema))
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(docs, pieces).collect()}
    assert got == {r.doc_id: len(whole.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert tc.token_counts(docs.limit(0), pieces).count() == 0


def test_side_by_side_is_as_one_by_one():
    """Pieces of all lengths in lockstep against the same pieces alone, with many ties."""
    rng = random.Random(11)
    for _ in range(30):
        vocabulary_ = [("a", -1.0), ("b", -2.0), (tc.BLANK, -1.0), *{"".join(rng.choice("ab▁") for _ in range(rng.randint(2, 5))): float(-rng.randint(1, 4)) for _ in range(12)}.items()]
        fallback = rng.random() < 0.5
        vocabulary_ += [(f"<0x{b:02X}>", -9.0) for b in range(256)] * fallback
        counter = tc.Counter(vocabulary_, byte_fallback=fallback)
        pieces = ["".join(rng.choice("aab▁\né日c" if rng.random() < 0.1 else "aab▁") for _ in range(rng.choice([1, 2, 3, 7, 20, 200]))) for _ in range(150)]
        good, n, score = counter.lockstep.count(pieces)
        for p, g in zip(pieces, good):
            assert g == (all(c in "ab▁" or fallback and c not in "<>0123456789xABCDEF" for c in p))
        for p, g, a, b in zip(pieces, good, n, score):
            assert not g or (a, b) == counter.count(p)


def test_ties_and_unknown_runs():
    """Few scores, so that ties are common; with and without byte pieces."""
    rng = random.Random(8)
    for fallback in (True, False):
        for _ in range(60):
            pieces = {"<unk>": 0.0} | ({f"<0x{b:02X}>": -9.0 for b in range(256)} if fallback else {})
            for _ in range(rng.randint(1, 14)):
                pieces["".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4)))] = float(-rng.randint(1, 3))
            vocabulary_ = list(pieces.items())
            whole = unigram(vocabulary_)
            if not fallback:
                from tokenizers import models

                pre = whole.pre_tokenizer
                whole.model = models.Unigram(vocabulary_, unk_id=0, byte_fallback=False)
                whole.pre_tokenizer = pre
            counter = tc.Counter(vocabulary_, byte_fallback=fallback)
            for _ in range(20):
                text = "".join(rng.choice("aabbcé ") for _ in range(rng.randint(0, 14)))
                assert counter.text(text)[0] == len(whole.encode(text, add_special_tokens=False).ids), (vocabulary_, text)
