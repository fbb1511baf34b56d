"""Aggregation cards, evaluation and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.operators import analytics as an, lexical as lex, relational as rel, vectors as vec
from loamdex.plans.registry import Tables, query
from loamdex.plans.relational_queries import EAV, eav

W = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')"


@query(
    "A2 A1",
    f"""WITH {EAV}, c AS (SELECT e.value AS entity, count(DISTINCT a.item_id) AS items, sum(a.num) AS total, count(a.num) / count(*) AS complete FROM eav e LEFT JOIN eav a ON a.item_id = e.item_id AND a.type = 'AMOUNT' AND a.item_id % 4 <> 0 WHERE e.type = 'ORGANIZATION' GROUP BY 1)
    SELECT entity, items, round(total, 2) AS total, round(least(1.0, 0.9 * complete / 0.75), 6) AS confidence FROM c WHERE least(1.0, 0.9 * complete / 0.75) >= 0.80""",
)
def knowledge_cards(t: Tables) -> DataFrame:
    m = eav(t)
    amounts = m.where("type = 'AMOUNT' and item_id % 4 <> 0").select("item_id", F.col("item_id").alias("amount_item"), "num")
    rows = m.where("type = 'ORGANIZATION'").select("item_id", F.col("value").alias("entity")).join(amounts, "item_id", "left")
    cards = rows.groupBy("entity").agg(F.countDistinct("amount_item").alias("items"), F.sum("num").alias("total"), (F.count("num") / F.count("*")).alias("complete"))
    return cards.withColumn("confidence", F.least(F.lit(1.0), 0.9 * F.col("complete") / 0.75)).where("confidence >= 0.80").select("entity", "items", F.round("total", 2).alias("total"), F.round("confidence", 6).alias("confidence"))


@query(
    "A3 W11",
    """WITH f AS (SELECT l_orderkey, l_extendedprice AS first_price FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) = 1)
    SELECT o_custkey, round(sum(first_price), 2) AS evidence, round(max(total), 2) AS total, abs(sum(first_price) - max(total)) <= 0.01 AS holds FROM f JOIN orders ON o_orderkey = l_orderkey JOIN (SELECT o_custkey AS k, sum(l_extendedprice) AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) ON k = o_custkey GROUP BY 1""",
)
def evidence_check(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    first = rel.first_per(lines, ["l_orderkey"], [F.asc("l_linenumber"), F.asc("l_extendedprice")]).groupBy("o_custkey").agg(F.sum("l_extendedprice").alias("evidence"))
    both = first.join(lines.groupBy("o_custkey").agg(F.sum("l_extendedprice").alias("total")), "o_custkey")
    return both.select("o_custkey", F.round("evidence", 2).alias("evidence"), F.round("total", 2).alias("total"), (F.abs(F.col("evidence") - F.col("total")) <= 0.01).alias("holds"))


@query("A4", "SELECT p_type AS class, count(*) AS rows, count(DISTINCT p_brand) AS brands, CASE WHEN count(*) > 20 THEN 'Your ' || lower(p_type) ELSE 'Some ' || lower(p_type) END AS title FROM part GROUP BY 1")
def collection_cards(t: Tables) -> DataFrame:
    rows = t.part.groupBy(F.col("p_type").alias("class")).agg(F.count("*").alias("rows"), F.countDistinct("p_brand").alias("brands"))
    return rows.withColumn("title", F.concat(F.when(F.col("rows") > 20, "Your ").otherwise("Some "), F.lower("class")))


@query("A16 W13", "SELECT count(*) AS rows, round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem), 6) AS concentration FROM (SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey LIMIT (SELECT CAST(ceil(count(*) * 0.05) AS BIGINT) FROM lineitem))")
def top_concentration(t: Tables) -> DataFrame:
    return an.top_share(t.lineitem, "l_extendedprice", 0.05, "l_orderkey").withColumn("concentration", F.round("concentration", 6))


def percentiles_sql(index: str) -> str:
    pick = lambda p: f"max(CASE WHEN i = CAST({index.format(p)} AS BIGINT) THEN value END)"
    return f"""SELECT event_type, count(*) AS n, {pick(0.5)} AS p50, {pick(0.95)} AS p95, {pick(1.0)} AS p100
    FROM (SELECT event_type, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)) GROUP BY 1"""


@query("A18 A34", percentiles_sql("floor((n - 1) * {})"))
def percentile_floor_idx(t: Tables) -> DataFrame:
    return an.percentile_at(t.events, ["event_type"], "value", [0.5, 0.95, 1.0])


@query("A19", percentiles_sql("round_even((n - 1) * {}, 0)"))
def percentile_rounded_idx(t: Tables) -> DataFrame:
    return an.percentile_at(t.events, ["event_type"], "value", [0.5, 0.95, 1.0], rounded=True)


@query(
    "A20",
    """SELECT event_type AS strategy, count(*) AS n, round(avg(value), 4) AS mean, round(max(value), 4) AS top, round(count(*) FILTER (value > 40) / count(*), 6) AS ratio, count(*) FILTER (value < 10) AS small, count(*) FILTER (value >= 10 AND value < 50) AS middle, count(*) FILTER (value >= 50) AS large FROM events GROUP BY 1""",
)
def contribution_report(t: Tables) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    v = F.col("value")
    return t.events.groupBy(F.col("event_type").alias("strategy")).agg(
        F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.max(v), 4).alias("top"), F.round(n(v > 40) / F.count("*"), 6).alias("ratio"), n(v < 10).alias("small"), n((v >= 10) & (v < 50)).alias("middle"), n(v >= 50).alias("large")
    )


@query(
    "A21 A29 X37",
    f"""WITH w AS (SELECT conv_id, role, unnest({W}) AS word FROM conversations), a AS (SELECT conv_id, word, count(*) AS na FROM w WHERE role = 'user' GROUP BY 1, 2), b AS (SELECT conv_id, word, count(*) AS nb FROM w WHERE role <> 'user' GROUP BY 1, 2)
    SELECT conv_id, CAST(sum(least(coalesce(na, 0), coalesce(nb, 0))) AS BIGINT) AS found, CAST(sum(greatest(coalesce(na, 0) - coalesce(nb, 0), 0)) AS BIGINT) AS missed, CAST(sum(greatest(coalesce(nb, 0) - coalesce(na, 0), 0)) AS BIGINT) AS added FROM a FULL JOIN b USING (conv_id, word) GROUP BY 1""",
)
def bag_comparison(t: Tables) -> DataFrame:
    words = t.conversations.select("conv_id", "role", F.explode(lex.words(F.col("text"))).alias("word"))
    return an.bag_compare(words.where("role = 'user'"), words.where("role <> 'user'"), "conv_id", "word")


@query(
    "A22",
    """WITH u AS (SELECT DISTINCT user_id, event_type FROM events), m AS (SELECT range AS mask FROM range(1, 32)), k AS (SELECT *, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS bit FROM (SELECT DISTINCT event_type FROM events)),
    s AS (SELECT mask, count(DISTINCT user_id) AS users, bit_count(mask) AS cost FROM m, u JOIN k USING (event_type) WHERE (mask >> bit) & 1 = 1 GROUP BY 1)
    SELECT CAST(mask AS BIGINT) AS mask, users, CAST(cost AS INT) AS cost FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.cost <= s.cost AND o.users >= s.users AND (o.cost < s.cost OR o.users > s.users))""",
)
def pareto_subsets(t: Tables) -> DataFrame:
    # per user a bit mask of the kinds it has; users are counted per mask first, so subsets meet a few masks only
    kinds = t.events.select("event_type").distinct().withColumn("bit", (F.row_number().over(Window.orderBy("event_type")) - 1))
    mask = t.events.select("user_id", "event_type").distinct().join(F.broadcast(kinds), "event_type").groupBy("user_id").agg(F.sum(F.expr("shiftleft(1L, bit)")).alias("has"))
    masks = mask.groupBy("has").agg(F.count("*").alias("users"))
    subsets = t.spark.range(1, 32).withColumnRenamed("id", "mask")
    seen = subsets.join(F.broadcast(masks), F.col("mask").bitwiseAND(F.col("has")) > 0).groupBy("mask").agg(F.sum("users").alias("users")).withColumn("cost", F.bit_count("mask"))
    other = seen.select(F.col("users").alias("u"), F.col("cost").alias("c"))
    return seen.join(F.broadcast(other), (F.col("c") <= F.col("cost")) & (F.col("u") >= F.col("users")) & ((F.col("c") < F.col("cost")) | (F.col("u") > F.col("users"))), "left_anti")


@query(
    "A23 A31",
    """WITH s AS (SELECT doc_id, n_chars, unnest(list_distinct([lang, 'all', CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END])) AS slice FROM documents) SELECT slice, count(*) AS n, round(avg(n_chars), 4) AS mean, round(count(*) FILTER (n_chars > 1000) / count(*), 6) AS rate FROM s GROUP BY 1""",
)
def slice_multi_membership(t: Tables) -> DataFrame:
    members = F.array("lang", F.lit("all"), F.when(F.col("n_chars") > 2000, "long").otherwise("short"))
    return an.slices(t.documents, members, {"mean": F.round(F.avg("n_chars"), 4), "rate": F.round(F.avg((F.col("n_chars") > 1000).cast("double")), 6)})


@query(
    "A24",
    """SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, count(*) FILTER (n_chars < 500) AS w0, count(*) FILTER (n_chars >= 500 AND n_chars < 2000) AS w1, count(*) FILTER (n_chars >= 2000) AS w2, round(median(n_chars), 4) AS middle FROM documents GROUP BY 1""",
)
def corpus_statistics(t: Tables) -> DataFrame:
    c = F.col("n_chars")
    n = lambda x: F.count(F.when(x, 1))
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(c), 4).alias("mean"), n(c < 500).alias("w0"), n((c >= 500) & (c < 2000)).alias("w1"), n(c >= 2000).alias("w2"), F.round(F.percentile(c, 0.5), 4).alias("middle"))


@query("A25", r"SELECT CASE WHEN regexp_matches(ch, '\p{L}') THEN 'letter' WHEN regexp_matches(ch, '[0-9]') THEN 'digit' WHEN regexp_matches(ch, '\s') THEN 'space' ELSE 'other' END AS class, count(DISTINCT ch) AS kinds, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM conversations) WHERE ch <> '' GROUP BY 1")
def character_inventory(t: Tables) -> DataFrame:
    chars = t.conversations.select(F.explode(F.split("text", "(?!^)")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    kind = F.when(F.col("ch").rlike(r"\p{L}"), "letter").when(F.col("ch").rlike("[0-9]"), "digit").when(F.col("ch").rlike(r"\s"), "space").otherwise("other")
    return chars.groupBy(kind.alias("class")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))


@query("A26", "SELECT user_id % 10 AS person, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 2) AS spent, round(sum(CASE WHEN event_type = 'refund' THEN value ELSE 0 END), 2) AS received, round(sum(CASE WHEN event_type = 'refund' THEN value WHEN event_type = 'purchase' THEN -value ELSE 0 END), 2) AS net FROM events GROUP BY 1")
def payment_totals(t: Tables) -> DataFrame:
    total = lambda *pairs: F.round(F.sum(pairs[0] if len(pairs) == 1 else pairs[0]), 2)
    kind, v = F.col("event_type"), F.col("value")
    return t.events.groupBy((F.col("user_id") % 10).alias("person")).agg(
        total(F.when(kind == "purchase", v).otherwise(0)).alias("spent"), total(F.when(kind == "refund", v).otherwise(0)).alias("received"), total(F.when(kind == "refund", v).when(kind == "purchase", -v).otherwise(0)).alias("net")
    )


@query("A27", "SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) AS n, round(sum(octet_length(encode(text))) / count(*) * 10000, 2) AS projected FROM documents GROUP BY 1")
def storage_projection(t: Tables) -> DataFrame:
    rows = t.documents.groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"))
    return rows.withColumn("projected", F.round(F.col("bytes") / F.col("n") * 10000, 2))


@query(
    "A30",
    """WITH b(bucket) AS (VALUES ('de'), ('en'), ('es'), ('fr'), ('hi')), s AS (SELECT lang, avg(n_chars) AS mean, count(*) AS n FROM documents GROUP BY 1) SELECT bucket, round(mean, 4) AS mean, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no data' ELSE '' END AS note FROM b LEFT JOIN s ON lang = bucket""",
)
def canonical_buckets(t: Tables) -> DataFrame:
    frame = t.spark.createDataFrame([(x,) for x in ("de", "en", "es", "fr", "hi")], "bucket string")
    s = t.documents.groupBy(F.col("lang").alias("bucket")).agg(F.avg("n_chars").alias("mean"), F.count("*").alias("n"))
    return frame.join(s, "bucket", "left").select("bucket", F.round("mean", 4).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "no data").otherwise("").alias("note"))


@query("A32 A33", "SELECT o_orderpriority AS pass, count(*) AS lines, count(DISTINCT o_custkey) AS survived, count(*) - count(DISTINCT o_custkey) AS duplicates, round(100.0 * (count(*) - count(DISTINCT o_custkey)) / count(*), 4) AS reduction FROM orders GROUP BY 1")
def pass_reductions(t: Tables) -> DataFrame:
    rows = t.orders.groupBy(F.col("o_orderpriority").alias("pass")).agg(F.count("*").alias("lines"), F.countDistinct("o_custkey").alias("survived"))
    rows = rows.withColumn("duplicates", F.col("lines") - F.col("survived"))
    return rows.withColumn("reduction", F.round(100 * F.col("duplicates") / F.col("lines"), 4))


@query(
    "A35",
    """SELECT code, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'NO_LABEL' WHEN toxic = 1 THEN 'TOXIC' WHEN quality = 0 THEN 'LOW' ELSE 'READY' END AS code FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY 1""",
)
def readiness_audit(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    code = F.when(F.col("quality").isNull(), "NO_LABEL").when(F.col("toxic") == 1, "TOXIC").when(F.col("quality") == 0, "LOW").otherwise("READY")
    return rows.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


RANKED = """q AS (SELECT vec_id AS query_id, label AS ql, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v, q), 9) DESC, id) AS rank, CASE WHEN label = ql THEN 1 + id % 3 ELSE 0 END AS grade FROM q, v WHERE id <> query_id)"""


def ranked(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, rank) of a vector search, and (query_id, id, grade) of what has the query's label."""
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("ql"))
    rows = vec.scored(t.embeddings.withColumnRenamed("vec_id", "id"), queries).where("id <> query_id").withColumn("score", F.round("score", 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    rows = rows.select("query_id", "id", rank.alias("rank"), F.when(F.col("label") == F.col("ql"), 1 + F.col("id") % 3).otherwise(0).alias("grade"))
    return rows.select("query_id", "id", "rank"), rows.where("grade > 0").select("query_id", "id", "grade")


@query(
    "X28 X33",
    f"""WITH {RANKED}, i AS (SELECT query_id, sum(grade / log2(n + 1)) AS idcg FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS n FROM r WHERE grade > 0) WHERE n <= 10 GROUP BY 1)
    SELECT r.query_id, round(count(*) FILTER (grade > 0 AND rank <= 10) / 10, 6) AS precision, round(count(*) FILTER (grade > 0 AND rank <= 10) / count(*) FILTER (grade > 0), 6) AS recall, round(1.0 / min(CASE WHEN grade > 0 THEN rank END), 6) AS mrr,
    round(sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) ELSE 0 END) / max(idcg), 6) AS ndcg FROM r JOIN i ON i.query_id = r.query_id GROUP BY 1""",
)
def ir_metrics(t: Tables) -> DataFrame:
    rows = an.ir_metrics(*ranked(t))
    return rows.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


@query(
    "X26 X27",
    "SELECT c_custkey, levenshtein(lower(c_mktsegment), 'machinery') AS edits, round(levenshtein(lower(c_mktsegment), 'machinery') / length(c_mktsegment), 6) AS cer, round(greatest(1 - levenshtein(lower(c_mktsegment), 'machinery') / length(c_mktsegment), 0), 6) AS accuracy FROM customer",
)
def character_errors(t: Tables) -> DataFrame:
    rates = an.error_rates(F.lower("c_mktsegment"), F.lit("machinery"))
    rows = t.customer.select("c_custkey", F.levenshtein(F.lower("c_mktsegment"), F.lit("machinery")).cast("long").alias("edits"), rates.alias("r"))
    return rows.select("c_custkey", "edits", F.round("r.cer", 6).alias("cer"), F.round("r.accuracy", 6).alias("accuracy"))


@query(
    "X35 J16",
    """WITH m AS (SELECT c_nationkey AS section, avg(c_acctbal) FILTER (c_custkey % 2 = 0) AS base, avg(c_acctbal) FILTER (c_custkey % 2 = 1) AS value FROM customer GROUP BY 1)
    SELECT section, CASE WHEN base IS NULL OR value IS NULL THEN 'NOT_COMPARABLE' WHEN abs(value - base) / abs(base) * 100 <= 5 THEN 'UNCHANGED' WHEN value > base THEN 'IMPROVED' ELSE 'REGRESSED' END AS verdict FROM m""",
)
def regression_verdict(t: Tables) -> DataFrame:
    run = lambda odd: t.customer.groupBy(F.col("c_nationkey").alias("section")).agg(F.avg(F.when(F.col("c_custkey") % 2 == odd, F.col("c_acctbal"))).alias("value")).withColumn("higher_is_better", F.lit(True))
    return an.regression(run(0), run(1), ["section"]).select("section", "verdict")


@query("X30")
def significance(t: Tables) -> DataFrame:
    pairs = t.labels.agg(F.count(F.expr("case when quality = 1 and toxic = 1 then 1 end")).alias("a"), F.count(F.expr("case when quality = 0 and toxic = 0 then 1 end")).alias("b"))
    row = pairs.first()
    return pairs.withColumn("p", F.round(F.lit(an.mcnemar(row["a"], row["b"])), 6))


#: Rows that a model is fitted on at most; those with the smallest hashes.
FIT_ROWS = 20_000


def _sample(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.md5(F.concat(F.lit("fit"), F.col("doc_id").cast("string"))), "doc_id").limit(FIT_ROWS)


@query("X31")
def logistic_calibration(t: Tables) -> DataFrame:
    """Fit on the half of labels whose hash is even (a hash sample of FIT_ROWS at most), score the other half."""
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("half", F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 2)
    fit = _sample(rows.where("half = 0")).toPandas()
    w = an.logistic(fit[["n_chars"]].to_numpy() / 1000, fit["quality"].to_numpy())
    chance = 1 / (1 + F.exp(-(F.lit(float(w[0])) + float(w[1]) * F.col("n_chars") / 1000)))
    return rows.where("half = 1").select("doc_id", "quality", F.round(chance, 6).alias("chance"))


#: What a ranker's features are made of.
RANKED_WORDS = ("license", "public", "version", "terms")


def ranker_features(t: Tables) -> DataFrame:
    """(doc_id, quality, phrase, share, run, short): whether a text has the phrase, its share of the words, the run of words in order, and shortness."""
    from loamdex.operators import lexical as lex

    low = F.lower("text")
    said = sum((F.when(F.contains(low, F.lit(w)), 1.0).otherwise(0.0) for w in RANKED_WORDS), F.lit(0.0))
    run = lex.longest_run(F.col("text"), RANKED_WORDS)
    docs = t.documents.where("text is not null").select("doc_id", F.contains(low, F.lit("public license")).cast("double").alias("phrase"), (said / len(RANKED_WORDS)).alias("share"), (F.greatest(run - 1, F.lit(0)) / (len(RANKED_WORDS) - 1)).alias("run"), (1000 / (1000 + F.length("text"))).alias("short"))
    return docs.join(t.labels.select("doc_id", "quality"), "doc_id")


@query("X32")
def ranker_weights(t: Tables) -> DataFrame:
    """Weights of a ranker's features, none below zero, fitted on a hash sample of FIT_ROWS at most."""
    names = ["phrase", "share", "run", "short"]
    fit = _sample(ranker_features(t)).toPandas()
    w = an.logistic(fit[names].to_numpy(), fit["quality"].to_numpy(), non_negative=True)
    return t.spark.createDataFrame([(n, float(x)) for n, x in zip(["base", *names], w, strict=True)], "feature string, weight double")


@query(
    "X48",
    "SELECT cut, n, round(precision, 6) AS precision, n >= 10 AND precision >= 0.95 AS sure FROM (SELECT cut, count(*) AS n, avg(CAST(l_returnflag <> 'R' AS INT)) AS precision FROM lineitem, (VALUES (10.0), (25.0), (40.0), (49.0)) c(cut) WHERE l_quantity >= cut GROUP BY 1)",
)
def threshold_choice(t: Tables) -> DataFrame:
    rows = an.thresholds(t.lineitem.withColumn("right", F.col("l_returnflag") != "R"), "l_quantity", "right", [10.0, 25.0, 40.0, 49.0])
    return rows.withColumn("precision", F.round("precision", 6))


@query(
    "W15",
    """WITH r AS (SELECT user_id, ts, event_id, value > 30 AS f, row_number() OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, a - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r WHERE f)
    SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY user_id, run""",
)
def contiguous_runs(t: Tables) -> DataFrame:
    return an.islands(t.events, ["user_id"], "event_id", F.col("value") > 30)


@query(
    "X43",
    """WITH p AS (SELECT doc_id AS item, 'ocr' AS family, TRUE AS feasible, n_chars / 100.0 AS latency, 1.0 AS risk FROM documents UNION ALL SELECT doc_id, 'text', lang <> 'fr', n_chars / 400.0, 3.0 FROM documents)
    SELECT item, arg_min(family, (score, family)) AS family, round(min(score), 6) AS score FROM (SELECT *, latency * 0.7 + risk * 2.0 AS score FROM p WHERE feasible) GROUP BY 1""",
)
def cheapest_plan(t: Tables) -> DataFrame:
    d = t.documents
    plans = d.select(F.col("doc_id").alias("item"), F.lit("ocr").alias("family"), F.lit(True).alias("feasible"), (F.col("n_chars") / 100.0).alias("latency"), F.lit(1.0).alias("risk"))
    plans = plans.unionByName(d.select(F.col("doc_id").alias("item"), F.lit("text").alias("family"), (F.col("lang") != "fr").alias("feasible"), (F.col("n_chars") / 400.0).alias("latency"), F.lit(3.0).alias("risk")))
    return an.plan_costs(plans, {"latency": 0.7, "risk": 2.0}).withColumn("score", F.round("score", 6))


@query("X51", "SELECT conv_id, CASE WHEN shared >= 0.25 AND turns <= 8 THEN 'new' ELSE 'old' END AS chosen FROM (SELECT conv_id, count(DISTINCT role) / count(*) AS shared, count(*) AS turns FROM conversations GROUP BY 1)")
def route_choice(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg((F.countDistinct("role") / F.count("*")).alias("shared"), F.count("*").alias("turns"))
    return rows.select("conv_id", F.when((F.col("shared") >= 0.25) & (F.col("turns") <= 8), "new").otherwise("old").alias("chosen"))


@query("X41 A33", "SELECT c.conv_id, c.turn, EXISTS(SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.turn < c.turn AND o.text = c.text) AS repeated FROM conversations c")
def contained_lines(t: Tables) -> DataFrame:
    first = t.conversations.groupBy("conv_id", "text").agg(F.min("turn").alias("first_turn"))
    return t.conversations.join(first, ["conv_id", "text"]).select("conv_id", "turn", (F.col("first_turn") < F.col("turn")).alias("repeated"))
