"""Keyword search and fusion over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.operators import fusion, inverted, lexical as lex
from loamdex.plans.registry import Tables, query
from loamdex.streaming.jobs import folder

W = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')"


def bm25_sql(words: list[str], extra: str = "", table: str = "documents") -> str:
    """BM25 of each document in SQL: CTEs d (id, length, words) and s (doc_id, score)."""
    terms = ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))
    return f"""WITH d AS (SELECT doc_id, {W} AS ws FROM {table}), q AS (SELECT * FROM (VALUES {terms}) v(i, term)),
    n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d), tf AS (SELECT i, doc_id, len(ws) AS l, len(list_filter(ws, lambda x: x = term)) AS tf FROM d, q),
    df AS (SELECT i, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1),
    s AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS score FROM tf JOIN df USING (i), n WHERE tf > 0 GROUP BY 1){extra}"""


def index(t: Tables) -> inverted.Index:
    """The keyword index of documents, made once and read by all queries over the same files."""
    return inverted.of_table(t.spark, f"{t.folder}/documents.parquet", "doc_id", "text", folder(t.spark))


def score(t: Tables, words: list[str]) -> DataFrame:
    return index(t).bm25(words).withColumnRenamed("id", "doc_id")


ROUNDED = "round(score, 6) AS score"


@query("R1 R5 R7 O1", bm25_sql(["that", "license"]) + f" SELECT doc_id, {ROUNDED} FROM s ORDER BY round(score, 6) DESC, doc_id LIMIT 10")
def bm25_top10(t: Tables) -> DataFrame:
    return lex.top(score(t, ["that", "license"]).withColumn("score", F.round("score", 6)), "score", "doc_id", 10)


@query("R5 R7 J11", bm25_sql(["under", "license"]) + f" SELECT s.doc_id, {ROUNDED}, quality, toxic FROM s LEFT JOIN labels ON labels.doc_id = s.doc_id ORDER BY round(score, 6) DESC, s.doc_id LIMIT 50")
def bm25_with_labels(t: Tables) -> DataFrame:
    best = lex.top(score(t, ["under", "license"]).withColumn("score", F.round("score", 6)), "score", "doc_id", 50)
    return best.join(t.labels, "doc_id", "left").select("doc_id", "score", "quality", "toxic")


@query("R5", bm25_sql(["that", "that", "with"]) + f" SELECT doc_id, {ROUNDED} FROM s ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def bm25_repeated_word(t: Tables) -> DataFrame:
    return lex.top(score(t, ["that", "that", "with"]).withColumn("score", F.round("score", 6)), "score", "doc_id", 20)


@query(
    "R5 W1 R13",
    bm25_sql(["that", "der", "les"]) + " SELECT lang, doc_id, round(score, 6) AS score, rank FROM (SELECT lang, s.doc_id, score, row_number() OVER (PARTITION BY lang ORDER BY round(score, 6) DESC, s.doc_id) AS rank FROM s JOIN documents USING (doc_id)) WHERE rank <= 3",
)
def bm25_per_lang(t: Tables) -> DataFrame:
    rows = score(t, ["that", "der", "les"]).withColumn("score", F.round("score", 6)).join(t.documents.select("doc_id", "lang"), "doc_id")
    return lex.top_per(rows, "lang", "score", "doc_id", 3).select("lang", "doc_id", "score", "rank")


@query("R4", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({W}) AS term FROM documents) GROUP BY 1 ORDER BY df DESC, term LIMIT 200")
def term_statistics(t: Tables) -> DataFrame:
    return index(t).terms().orderBy(F.desc("df"), "term").limit(200)


@query(
    "R6 R5",
    rf"""WITH d AS (SELECT doc_id, {W} AS ws FROM documents), terms AS (SELECT DISTINCT unnest(ws) AS term FROM d), sub AS (SELECT list(term) AS g FROM terms WHERE contains(term, 'licens')),
    n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d), tf AS (SELECT doc_id, len(ws) AS l, len(list_filter(ws, lambda x: list_contains(g, x))) AS tf FROM d, sub), f AS (SELECT count(*) AS df FROM tf WHERE tf > 0)
    SELECT doc_id, round(0.5 * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean)), 6) AS score FROM tf, f, n WHERE tf > 0""",
)
def unknown_word_fallback(t: Tables) -> DataFrame:
    own = index(t)
    return own.bm25(own.expanded(["licens"])).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(
    "R8 J13",
    rf"""WITH terms AS (SELECT DISTINCT unnest({W}) AS term FROM documents), q AS (SELECT * FROM (VALUES ('licence', 2), ('publick', 2), ('teh', 1), ('wiht', 1)) v(word, most))
    SELECT word, term, levenshtein(term, word) AS distance FROM q JOIN terms ON regexp_matches(term, '^[a-z0-9]+$') AND length(term) >= 3 AND abs(length(term) - length(word)) <= most AND levenshtein(term, word) <= most""",
)
def fuzzy_vocab_match(t: Tables) -> DataFrame:
    vocab = index(t).vocabulary().where("term rlike '^[a-z0-9]+$'")
    parts = [vocab.where(lex.near(F.col("term"), w)).select(F.lit(w).alias("word"), "term", F.levenshtein("term", F.lit(w)).cast("long").alias("distance")) for w in ("licence", "publick", "teh", "wiht")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "R12",
    rf"WITH terms AS (SELECT DISTINCT unnest({W}) AS term FROM documents) SELECT word, term FROM (VALUES ('licensing', 'licens'), ('licensing', 'license'), ('generalities', 'general'), ('generalities', 'generale'), ('worker', 'work'), ('worker', 'worke')) q(word, root) JOIN terms ON term = root",
)
def root_match(t: Tables) -> DataFrame:
    vocab = index(t).vocabulary()
    pairs = [(w, r) for w in ("licensing", "generalities", "worker") for r in lex.roots(w)]
    return vocab.join(F.broadcast(t.spark.createDataFrame(pairs, "word string, term string")), "term").select("word", "term")


@query(
    "R10 O3",
    rf"""WITH h AS (SELECT doc_id, CASE WHEN contains(lower(text), 'licen') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'public') THEN 1 ELSE 0 END AS hits,
    CASE WHEN list_contains({W}, 'licen') THEN 1 ELSE 0 END + CASE WHEN list_contains({W}, 'public') THEN 1 ELSE 0 END AS alone FROM documents)
    SELECT doc_id, CAST((hits * 1024 + hits) * 1024 + alone AS BIGINT) AS key FROM h WHERE hits > 0 ORDER BY key DESC, doc_id LIMIT 50""",
)
def substring_lane(t: Tables) -> DataFrame:
    good, key = lex.substring_key(F.col("text"), ["licen", "public"])
    return t.documents.where(good).select("doc_id", key.alias("key")).orderBy(F.desc("key"), "doc_id").limit(50)


@query(
    "R11 O7",
    r"""WITH tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM documents) SELECT DISTINCT doc_id FROM tok WHERE length(token) >= 3 AND abs(length(token) - 7) <= 2 AND levenshtein(token, 'licence') <= 2 ORDER BY doc_id LIMIT 30""",
)
def typo_lane(t: Tables) -> DataFrame:
    return lex.typo_documents(t.documents, "doc_id", "text", ["licence"], 30)


@query("S6 J3", f"SELECT doc_id FROM (SELECT doc_id, {W} AS ws FROM documents) WHERE list_contains(ws, 'license') AND len(list_filter(ws, lambda x: starts_with(x, 'publ'))) > 0 ORDER BY doc_id LIMIT 50")
def full_text_match(t: Tables) -> DataFrame:
    return t.documents.where(lex.has_all(F.col("text"), ["license", "publ*"])).select("doc_id").orderBy("doc_id").limit(50)


@query("F11 F14", f"SELECT doc_id FROM (SELECT doc_id, {W} AS ws FROM documents) WHERE list_contains(ws, 'version')")
def whole_word_documents(t: Tables) -> DataFrame:
    return t.documents.where(lex.whole_word(F.col("text"), "version")).select("doc_id")


@query(
    "R18 S6",
    r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{M}\p{N}])general(s|es)?[^\p{L}\p{M}\p{N}]+public(s|es)?[^\p{L}\p{M}\p{N}]+license(s|es)?([^\p{L}\p{M}\p{N}]|$)') THEN 3
    WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{M}\p{N}])(general(s|es)?[^\p{L}\p{M}\p{N}]+public(s|es)?|public(s|es)?[^\p{L}\p{M}\p{N}]+license(s|es)?)([^\p{L}\p{M}\p{N}]|$)') THEN 2 ELSE 0 END AS run FROM documents""",
)
def words_in_order(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", lex.longest_run(F.col("text"), ["general", "publics", "license"]).alias("run"))


@query(
    "R14 U2 F9",
    bm25_sql(["license", "public"])
    + f""", one AS (SELECT i, doc_id, row_number() OVER (PARTITION BY i ORDER BY round(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean)), 12) DESC, doc_id) AS r FROM tf JOIN df USING (i), n WHERE tf > 0),
    b AS (SELECT doc_id FROM s ORDER BY round(score, 12) DESC, doc_id LIMIT 50), f AS (SELECT doc_id FROM documents WHERE list_contains({W}, 'version') ORDER BY doc_id LIMIT 50)
    SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM b UNION SELECT doc_id FROM f UNION SELECT doc_id FROM one WHERE r <= 20)""",
)
def candidate_bounding(t: Tables) -> DataFrame:
    own = index(t)
    says = own.postings(["version"]).select("id").distinct()
    some = own.candidates(["license", "public"], says, t.documents.select(F.col("doc_id").alias("id")))
    return t.documents.select("doc_id", "lang").join(some.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")


@query("R14", "SELECT count(*) AS n FROM documents")
def candidates_of_nothing(t: Tables) -> DataFrame:
    """No text has the words, so a search looks at all."""
    own, every = index(t), t.documents.select(F.col("doc_id").alias("id"))
    return own.candidates(["qqzzxy"], every.limit(0), every).agg(F.count("*").alias("n"))


CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'license ' || source ELSE text END AS text FROM documents WHERE doc_id % 5 <> 4)"


@query(
    "R4",
    f"""WITH w AS (SELECT doc_id, {W} AS ws FROM {CHANGED}) SELECT term, df, cf, n, words FROM (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(ws) AS term FROM w) GROUP BY 1), (SELECT count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS words FROM w)""",
)
def index_changed_and_swept(t: Tables) -> DataFrame:
    """All documents added, every seventh replaced, every fifth removed, and the index swept."""
    own = inverted.Index(t.spark, folder(t.spark)).add(t.documents, "doc_id", "text")
    own.add(t.documents.where("doc_id % 7 = 3").withColumn("text", F.concat(F.lit("license "), "source")), "doc_id", "text")
    own.remove(t.documents.where("doc_id % 5 = 4"), "doc_id").sweep()
    return own.terms().select("term", "df", "cf", F.lit(own.live).cast("long").alias("n"), F.lit(own.words).cast("long").alias("words"))


@query("R4 R5 R7", bm25_sql(["license"], table=CHANGED) + " SELECT doc_id, round(score, 6) AS score FROM s")
def bm25_of_changed_index(t: Tables) -> DataFrame:
    """Scores where replaced and removed documents still lie in older segments."""
    own = inverted.Index(t.spark, folder(t.spark)).add(t.documents, "doc_id", "text")
    own.add(t.documents.where("doc_id % 7 = 3").withColumn("text", F.concat(F.lit("license "), "source")), "doc_id", "text")
    own.remove(t.documents.where("doc_id % 5 = 4"), "doc_id")
    return own.bm25(["license"]).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("R34", "SELECT doc_id, substr(text, greatest(p - 40, 1), p - greatest(p - 40, 1) + 7 + 80) AS excerpt FROM (SELECT *, instr(lower(text), 'license') AS p FROM documents) WHERE p > 0")
def excerpts(t: Tables) -> DataFrame:
    return t.documents.where(F.locate("license", F.lower("text")) > 0).select("doc_id", lex.excerpt(F.col("text"), "license").alias("excerpt"))


@query(
    "F15",
    f"SELECT role, count(*) AS n, count(*) FILTER (list_has_any(list_filter({W}, lambda x: NOT list_contains(['the', 'of', 'and', 'a', 'is', 'in', 'to'], x)), ['that', 'thing'])) AS saying FROM conversations GROUP BY 1",
)
def says_a_word(t: Tables) -> DataFrame:
    content = F.filter(lex.words(F.col("text")), lambda w: ~w.isin("the", "of", "and", "a", "is", "in", "to"))
    return t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.count(F.when(F.arrays_overlap(content, F.array(F.lit("that"), F.lit("thing"))), 1)).alias("saying"))


LANES_SQL = """, l1 AS (SELECT doc_id, 1.2 AS w, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) - 1 AS r FROM s QUALIFY r < 50),
    l2 AS (SELECT doc_id, 1.1 AS w, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS r FROM documents WHERE contains(lower(text), 'licens') QUALIFY r < 50),
    l3 AS (SELECT doc_id, 0.6 AS w, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents WHERE lang = 'en' QUALIFY r < 30),
    fused AS (SELECT doc_id, sum(w / (60 + r)) AS score FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY 1)"""


def lanes(t: Tables) -> DataFrame:
    """(id, score) of three lanes, fused."""
    best = score(t, ["license", "public"]).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("s"))
    docs = t.documents.withColumnRenamed("doc_id", "id")
    contains = docs.where(F.contains(F.lower("text"), F.lit("licens"))).select("id", F.length("text").alias("s"))
    english = docs.where("lang = 'en'").select("id")
    return fusion.fused(
        [fusion.ranked(best, "bm25", [F.desc("s"), F.asc("id")], 50), fusion.ranked(contains, "substring", [F.asc("s"), F.asc("id")], 50), fusion.ranked(english, "fuzzy", [F.asc("id")], 30)]
    )


@query("R15 W3 R21", bm25_sql(["license", "public"], LANES_SQL) + " SELECT doc_id, round(score, 8) AS score FROM fused ORDER BY round(score, 8) DESC, doc_id LIMIT 50")
def rrf_fuse(t: Tables) -> DataFrame:
    return lanes(t).select(F.col("id").alias("doc_id"), F.round("score", 8).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query(
    "R16",
    bm25_sql(["license", "public"], LANES_SQL)
    + " SELECT f.doc_id, round(score * CASE WHEN lang = 'en' THEN 1.5 ELSE 1 END * CASE WHEN source = 'src0' THEN 1.6 ELSE 1 END, 8) AS score FROM fused f JOIN documents USING (doc_id) ORDER BY score DESC, f.doc_id LIMIT 50",
)
def weighted_boost_rank(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("id"), "lang", "source")
    rows = fusion.boosted(lanes(t), [(docs.where("lang = 'en'"), "organization"), (docs.where("source = 'src0'"), "category")])
    return rows.select(F.col("id").alias("doc_id"), F.round("score", 8).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query(
    "R17 R18 R21",
    bm25_sql(["license", "public"], LANES_SQL)
    + rf""", g AS (SELECT f.doc_id, score, lower(text) AS low, CASE WHEN contains(lower(text), 'public') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END AS said, source FROM fused f JOIN documents USING (doc_id))
    SELECT doc_id, round(score + CASE WHEN contains(low, 'public license') THEN 0.10 ELSE 0 END + 0.06 * said / 2 + CASE WHEN regexp_matches(low, '(^|[^\p{{L}}\p{{M}}\p{{N}}])public(s|es)?[^\p{{L}}\p{{M}}\p{{N}}]+license(s|es)?([^\p{{L}}\p{{M}}\p{{N}}]|$)') THEN 0.10 ELSE 0 END, 8) AS score
    FROM g WHERE said > 0 ORDER BY score DESC, doc_id LIMIT 50""",
)
def phrase_gate(t: Tables) -> DataFrame:
    words = ["public", "license"]
    text, low = F.col("text"), F.lower("text")
    said = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    rows = lanes(t).join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id").withColumn("said", said).where("said > 0")
    extra = fusion.bonus(F.contains(low, F.lit("public license")), F.col("said"), F.lit(0), lex.longest_run(text, words), 2)
    return rows.select(F.col("id").alias("doc_id"), F.round(F.col("score") + extra, 8).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query(
    "R19",
    f"""SELECT standing, count(*) AS n FROM (SELECT CASE WHEN list_contains({W}, 'license') THEN 5 WHEN contains(lower(text), 'license') THEN 4 WHEN contains(lower(text), 'licen') THEN 3
    WHEN contains(lower(text), 'lice') THEN 2 WHEN contains(lower(source), '1') THEN 1 ELSE 0 END AS standing FROM documents) GROUP BY 1""",
)
def standing_levels(t: Tables) -> DataFrame:
    has = lambda w: F.contains(F.lower("text"), F.lit(w))
    level = fusion.standing(lex.whole_word(F.col("text"), "license"), has("license").cast("int"), has("licen").cast("int"), has("lice"), F.contains(F.lower("source"), F.lit("1")))
    return t.documents.groupBy(level.alias("standing")).agg(F.count("*").alias("n"))


@query(
    "A13 R20",
    """SELECT user_id, round(least(2.0, sum(power(0.5, (epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / (30 * 86400.0)))), 6) AS weight FROM events WHERE event_type = 'click' GROUP BY 1""",
)
def decayed_opens(t: Tables) -> DataFrame:
    return fusion.opened_weight(t.events.where("event_type = 'click'"), "user_id", "ts", "2024-01-31").withColumn("weight", F.round("weight", 6))


HITS = """(SELECT 'SAYS' AS kind, row_number() OVER (ORDER BY doc_id) AS rank, doc_id AS id, 1 / (1 + exp(-(-3.5844 + 5.2243 * 0.5))) AS chance FROM documents WHERE lang = 'fr'
    UNION ALL SELECT 'FACT', row_number() OVER (ORDER BY doc_id), doc_id, 0.97 FROM documents WHERE doc_id % 5 = 0
    UNION ALL SELECT 'MEANING', row_number() OVER (ORDER BY doc_id), doc_id, 1 / (1 + exp(-(-2.4747 + 0.6861 * 3.0 + 1.7126 * 0.1))) FROM documents WHERE doc_id % 3 = 0)"""


@query(
    "R29 R30 W10",
    f"""WITH h AS {HITS}, o AS (SELECT kind, chance, row_number() OVER (ORDER BY chance DESC) AS group_rank FROM (SELECT DISTINCT kind, chance FROM h)),
    k AS (SELECT h.kind, id, group_rank, rank, h.chance, row_number() OVER (PARTITION BY id ORDER BY group_rank, rank) AS n FROM h JOIN o ON h.kind = o.kind)
    SELECT kind, group_rank, count(*) AS ids, round(max(chance), 6) AS chance, CASE WHEN max(chance) >= CASE kind WHEN 'FACT' THEN 0.95 ELSE 1.01 END THEN 'SURE' ELSE 'POSSIBLE' END AS verdict FROM k WHERE n = 1 GROUP BY 1, 2""",
)
def group_dedup_priority(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("id"), "lang")
    chance = {"SAYS": fusion.says_chance(F.lit(1), 2, F.lit(False)), "FACT": F.lit(0.97), "MEANING": fusion.meaning_chance(F.lit(3.0), F.lit(0.1))}
    part = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), F.col("id").alias("rank"), "id", chance[kind].alias("chance"))
    hits = part("SAYS", docs.where("lang = 'fr'")).unionByName(part("FACT", docs.where("id % 5 = 0"))).unionByName(part("MEANING", docs.where("id % 3 = 0")))
    rows = fusion.grouped(hits, says_all=False)
    return rows.groupBy("kind", "group_rank").agg(F.count("*").alias("ids"), F.round(F.max("chance"), 6).alias("chance"), F.first("verdict").alias("verdict"))


@query(
    "R31",
    """WITH a AS (SELECT 'e' || (user_id % 5) AS term, event_type AS stands_for, sum(value) AS weight, max(ts) AS learned_at FROM events GROUP BY 1, 2)
    SELECT term, stands_for, CAST(row_number() OVER (PARTITION BY term ORDER BY weight DESC, stands_for) AS INT) AS rank FROM a WHERE term IN ('e1', 'e3') AND learned_at >= TIMESTAMP '2024-01-05' AND weight >= 1 QUALIFY rank <= 3""",
)
def alias_expansion(t: Tables) -> DataFrame:
    table = t.events.groupBy(F.concat(F.lit("e"), (F.col("user_id") % 5).cast("string")).alias("term"), F.col("event_type").alias("stands_for")).agg(F.sum("value").alias("weight"), F.max("ts").alias("learned_at"))
    return fusion.aliases(table, ["e1", "e3"], F.lit("2024-01-05").cast("timestamp"), 1.0).select("term", "stands_for", "rank")


@query(
    "R33",
    bm25_sql(["license", "public"], LANES_SQL)
    + " SELECT 'KEYWORD' AS stage, doc_id FROM (SELECT doc_id FROM l1 ORDER BY r LIMIT 10) UNION ALL SELECT 'LEXICAL', doc_id FROM (SELECT doc_id FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY 1 ORDER BY round(sum(w / (60 + r)), 8) DESC, doc_id LIMIT 10) UNION ALL SELECT 'FINAL', doc_id FROM (SELECT doc_id FROM fused ORDER BY round(score, 8) DESC, doc_id LIMIT 10)",
)
def progressive_stages(t: Tables) -> DataFrame:
    best = score(t, ["license", "public"]).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("s"))
    docs = t.documents.withColumnRenamed("doc_id", "id")
    one = fusion.ranked(best, "bm25", [F.desc("s"), F.asc("id")], 50)
    two = fusion.ranked(docs.where(F.contains(F.lower("text"), F.lit("licens"))).select("id", F.length("text").alias("s")), "substring", [F.asc("s"), F.asc("id")], 50)
    order = lambda df, stage: df.withColumn("score", F.round("score", 8)).orderBy(F.desc("score"), "id").limit(10).select(F.lit(stage).alias("stage"), F.col("id").alias("doc_id"))
    return order(fusion.fused([one]), "KEYWORD").unionByName(order(fusion.fused([one, two]), "LEXICAL")).unionByName(order(lanes(t), "FINAL"))


@query(
    "R21 O5 R22",
    bm25_sql(["license", "public"], LANES_SQL) + ", b AS (SELECT doc_id FROM fused ORDER BY round(score, 8) DESC, doc_id LIMIT 100) SELECT b.doc_id, n_chars FROM b JOIN documents USING (doc_id) ORDER BY n_chars DESC, b.doc_id LIMIT 20",
)
def rerank_by_date(t: Tables) -> DataFrame:
    best = lanes(t).withColumn("score", F.round("score", 8)).orderBy(F.desc("score"), "id").limit(100).select(F.col("id").alias("doc_id"))
    return best.join(t.documents.select("doc_id", "n_chars"), "doc_id").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("R3 R2", r"SELECT page_id, lower(regexp_extract(url, '[^/]+/?$')) || ' ' || trim(regexp_replace(lower(regexp_extract(url, '[^/]+/?$')), '[^\p{L}\p{N}]+', ' ', 'g')) AS name FROM pages")
def searchable_names(t: Tables) -> DataFrame:
    written = F.lower(F.regexp_extract("url", r"[^/]+/?$", 0))
    return t.pages.select("page_id", F.concat_ws(" ", written, F.trim(F.regexp_replace(written, r"[^\p{L}\p{N}]+", " "))).alias("name"))


@query(
    "R28",
    """SELECT item_id, amount, CAST(row_number() OVER (ORDER BY exact DESC, item_id) AS INT) AS rank FROM (SELECT o_orderkey AS item_id, round(o_totalprice, 2) AS amount, CASE WHEN o_orderkey = 7 THEN 1 ELSE 0 END AS exact FROM orders
    WHERE o_orderkey = 7 OR o_totalprice BETWEEN (SELECT o_totalprice FROM orders WHERE o_orderkey = 33) - 500 AND (SELECT o_totalprice FROM orders WHERE o_orderkey = 33) + 500) QUALIFY rank <= 20""",
)
def facts_lane(t: Tables) -> DataFrame:
    asked = t.orders.where("o_orderkey = 33").select(F.col("o_totalprice").alias("asked"))
    near = t.orders.join(F.broadcast(asked), F.col("o_totalprice").between(F.col("asked") - 500, F.col("asked") + 500), "left_semi")
    rows = near.unionByName(t.orders.where("o_orderkey = 7")).select(F.col("o_orderkey").alias("item_id"), F.round("o_totalprice", 2).alias("amount")).distinct()
    rows = rows.withColumn("exact", F.when(F.col("item_id") == 7, 1).otherwise(0)).orderBy(F.desc("exact"), "item_id").limit(20)
    return rows.select("item_id", "amount", F.row_number().over(Window.orderBy(F.desc("exact"), "item_id")).alias("rank"))
