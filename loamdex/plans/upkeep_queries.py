"""Jobs on streams, upkeep of derived rows, readers of files, and reports, over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.functions import facts, text as tx
from loamdex.operators import analytics as an, fusion, lexical as lex, upkeep, vectors as vec
from loamdex.plans.registry import Tables, query
from loamdex.sources import files
from loamdex.streaming import jobs


def streamed(t: Tables, *parts: DataFrame) -> DataFrame:
    """Rows as a stream of one folder, a file a part, in this order."""
    place = jobs.folder(t.spark)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(place)
    return jobs.source(t.spark, place, files_per_batch=1)


# -- streams -------------------------------------------------------------------------------------------------------


@query(
    "T1",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) / 3600.0 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    x AS (SELECT a.user_id, a.n, min(b.n) AS nxt FROM e a JOIN e b ON a.user_id = b.user_id AND b.n > a.n AND b.s - a.s >= 5 GROUP BY 1, 2),
    k AS (SELECT user_id, n FROM e WHERE n = 1 UNION ALL SELECT k.user_id, x.nxt FROM k JOIN x ON x.user_id = k.user_id AND x.n = k.n)
    SELECT e.user_id, e.event_id FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n ORDER BY e.s DESC, e.event_id LIMIT 200""",
)
def stream_suppressed(t: Tables) -> DataFrame:
    """What is left when an hour counts as a second and repeats within five of them are dropped; the queue's newest 200 first."""
    stream = streamed(t, t.events.select("user_id", "event_id", (F.col("ts").cast("timestamp").cast("double") / 3600).alias("seconds")))
    rows = jobs.run_available(jobs.suppressed(stream, "user_id", "seconds", 5.0), jobs.folder(t.spark))
    return rows.orderBy(F.desc("seconds"), "event_id").limit(200).select("user_id", "event_id")


@query(
    "T4",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'done' WHEN event_id % 7 = 0 THEN 'pause' ELSE 'fail' END AS step, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (SELECT user_id, 0::BIGINT AS n, 0 AS done, 0 AS skipped, 0 AS attempts, -1::BIGINT AS last_id, 'WAITING' AS state FROM e WHERE n = 1
    UNION ALL SELECT r.user_id, e.n, done + (step = 'done')::INT, skipped + (step = 'fail' AND attempts = 2)::INT, CASE WHEN step = 'fail' AND attempts < 2 THEN attempts + 1 ELSE 0 END, e.event_id, CASE WHEN step = 'pause' THEN 'WAITING' ELSE 'READING' END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id, done, skipped, last_id, attempts, state FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""",
)
def stream_progress(t: Tables) -> DataFrame:
    """Events as steps of each user's reading, in two files: pages done, failed starts, pauses, pages given up after three starts."""
    step = F.when(F.col("event_type").isin("click", "view"), "done").when(F.col("event_id") % 7 == 0, "pause").otherwise("fail")
    rows = t.events.select("user_id", "event_id", step.alias("step"))
    # found once: on several executors it differs from run to run, and both files must part at the same event
    middle = F.lit(rows.agg(F.percentile_approx("event_id", 0.5).alias("m")).first().m)
    stream = jobs.resumable_progress(streamed(t, rows.where(F.col("event_id") <= middle), rows.where(F.col("event_id") > middle)))
    return jobs.run_merged(stream, jobs.folder(t.spark), ["user_id"], "last_id", "update")


@query(
    "T5",
    "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page, page AS turn FROM events",
)
def stream_in_order(t: Tables) -> DataFrame:
    """Each user's events as pages, of which the even ones come first."""
    from pyspark.sql import Window

    pages = t.events.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("page"))
    return jobs.run_available(jobs.in_order(streamed(t, pages.where("page % 2 = 0"), pages.where("page % 2 = 1")), "user_id", "page"), jobs.folder(t.spark))


@query(
    "T6 T2",
    "SELECT 0 AS version, event_type, count(*) AS n, max(event_id) AS last FROM events WHERE event_id % 2 = 0 GROUP BY 2 UNION ALL SELECT 1, event_type, count(*), max(event_id) FROM events GROUP BY 2",
)
def stream_refreshed(t: Tables) -> DataFrame:
    """A query over a table that runs again when a file comes into the watched folder."""
    watched, place, rows = jobs.folder(t.spark), jobs.folder(t.spark), t.events.select("event_id", "event_type")
    sink = jobs.refreshed(place, lambda table: table.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last")))
    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(watched)
        jobs.run_available(jobs.source(t.spark, watched), place, "append", sink)
    return t.spark.read.schema("event_type string, n long, last long, version int").parquet(f"{place}/rows/v=0", f"{place}/rows/v=1")


@query(
    "T7",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type FROM s QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_type DESC) = 1""",
)
def stream_settled(t: Tables) -> DataFrame:
    """What each user did last before a quiet stretch of six hours; all before it was cancelled."""
    place = jobs.folder(t.spark)
    stream = streamed(t, t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"))
    rows = jobs.run_available(jobs.settled(stream, "user_id", "ts", "event_type", "6 hours"), place, "complete", jobs.latest_batch(place))
    return rows.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type")


@query(
    "T11",
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, event_id % 3 = 0 AS ends, lag(event_id % 3 = 0) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE NOT ends AND coalesce(before, TRUE)",
)
def stream_claims(t: Tables) -> DataFrame:
    """Starts of a reading that find nobody reading already; every third event ends one."""
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, "end").otherwise("start").alias("step"))
    return jobs.run_available(jobs.claimed(streamed(t, rows), "user_id"), jobs.folder(t.spark))


# -- upkeep --------------------------------------------------------------------------------------------------------


def _store(t: Tables) -> DataFrame:
    """A store of documents of which some are missing, some stale, and some have no document."""
    old = F.when(F.col("doc_id") % 5 == 0, F.md5(F.lit("old"))).otherwise(F.md5(F.coalesce("text", F.lit(""))))
    rows = t.documents.where("doc_id % 7 <> 0").select("doc_id", old.alias("hash"), F.lit("kept").alias("value"))
    return rows.unionByName(t.documents.where("doc_id % 11 = 0").select((F.col("doc_id") + 1000000000).alias("doc_id"), F.md5(F.lit("gone")).alias("hash"), F.lit("gone").alias("value")))


STATES = "SELECT doc_id, lang, text, CASE WHEN doc_id % 7 = 0 THEN 'MISSING' WHEN doc_id % 5 = 0 THEN 'STALE' ELSE 'KEEP' END AS state FROM documents"


@query("T9", f"SELECT doc_id, state FROM ({STATES}) UNION ALL SELECT doc_id + 1000000000, 'ORPHAN' FROM documents WHERE doc_id % 11 = 0")
def store_swept(t: Tables) -> DataFrame:
    return upkeep.swept(t.documents, _store(t), "doc_id", "text", F.md5)


@query(
    "T9",
    f"""WITH s AS ({STATES}), w AS (SELECT doc_id FROM s WHERE state <> 'KEEP' AND length(text) >= 200 ORDER BY doc_id LIMIT 50)
    SELECT lang, count(*) FILTER (length(text) >= 200) AS eligible, count(*) FILTER (length(text) >= 200 AND (state = 'KEEP' OR doc_id IN (SELECT doc_id FROM w))) AS covered FROM s GROUP BY 1 HAVING eligible > 0""",
)
def store_filled(t: Tables) -> DataFrame:
    """How far the store reaches after one pass of fifty."""
    after = upkeep.filled(t.documents, _store(t), "doc_id", "text", F.md5, lambda x: F.lit("made"), least_chars=200, most=50)
    return upkeep.coverage(t.documents, after, "doc_id", "lang", "text", least_chars=200)


@query("T10", "SELECT 1 AS pass, count(*) AS changed, count(DISTINCT lang) AS kinds FROM documents WHERE n_chars < 1000 UNION ALL SELECT 2, 0, 0 UNION ALL SELECT 3, 0, 0")
def tags_rederived(t: Tables) -> DataFrame:
    """Tags under new rules: what the first pass changes, what is left for a second, and what a pass under the current version does."""
    rule = F.when(F.col("n_chars") < 1000, F.concat(F.lit("short "), "lang")).otherwise(F.col("lang"))
    rows = t.documents.select("doc_id", "lang", "n_chars", F.col("lang").alias("tags"))
    first = upkeep.rederived(rows, "doc_id", "tags", rule, 1, 2)
    applied = rows.join(first.select("doc_id", "new"), "doc_id", "left").withColumn("tags", F.coalesce("new", "tags"))
    passes = [first, upkeep.rederived(applied, "doc_id", "tags", rule, 1, 2), upkeep.rederived(applied, "doc_id", "tags", rule, 2, 2)]
    out = [p.agg(F.lit(i + 1).alias("pass"), F.count("*").alias("changed"), F.countDistinct("old").alias("kinds")) for i, p in enumerate(passes)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "K6 K3",
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
    SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)""",
)
def removed_everywhere(t: Tables) -> DataFrame:
    """Customers in debt go, with their orders, and the lines of these."""
    gone = t.customer.where("c_acctbal < 0").select("c_custkey")
    orders = t.orders.join(gone.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left_semi").select(F.col("o_orderkey").alias("c_custkey"))
    left = upkeep.removed_everywhere({"customer": (t.customer, "c_custkey")}, gone, "c_custkey")
    left |= upkeep.removed_everywhere({"orders": (t.orders, "o_orderkey"), "lineitem": (t.lineitem, "l_orderkey")}, orders, "c_custkey")
    counts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "R32 W7",
    """WITH e AS (SELECT user_id, epoch(ts) / 360.0 AS sec, event_id, event_type || ' ' || CAST(event_id % 3 AS VARCHAR) AS q, event_id % 2 = 0 AS opened, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT *, sum(CASE WHEN p = q THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS run FROM (SELECT *, lag(q) OVER (PARTITION BY user_id ORDER BY n) AS p FROM e)),
    g AS (SELECT user_id, run, q, min(sec) AS first, min(sec) FILTER (opened) AS opened FROM r GROUP BY 1, 2, 3),
    x AS (SELECT *, lag(q) OVER w AS bq, lag(first) OVER w AS bf, lag(opened) OVER w AS bo FROM g WINDOW w AS (PARTITION BY user_id ORDER BY run)),
    y AS (SELECT bq AS term, array_to_string(list_filter(string_split(q, ' '), lambda w: NOT list_contains(string_split(bq, ' '), w)), ' ') AS stands_for FROM x WHERE opened IS NOT NULL AND bo IS NULL AND bq IS NOT NULL AND opened - bf <= 60)
    SELECT term, stands_for, least(2.0, count(*) * 0.5) AS weight FROM y WHERE stands_for <> '' GROUP BY 1, 2""",
)
def aliases_learned(t: Tables) -> DataFrame:
    """Events as searches, six minutes counting as a second; even ones were opened."""
    rows = t.events.select("user_id", "event_id", (F.col("ts").cast("timestamp").cast("double") / 360).alias("at"), F.concat_ws(" ", "event_type", (F.col("event_id") % 3).cast("string")).alias("q"), (F.col("event_id") % 2 == 0).alias("opened"))
    return fusion.learned(rows, "user_id", "at", "q", "opened", "event_id").select("term", "stands_for", "weight")


# -- files ---------------------------------------------------------------------------------------------------------


@query("S12", "SELECT r_name || '.xlsx' AS path, row_number() OVER (PARTITION BY r_name ORDER BY sheet) - 1 AS page, text FROM (SELECT r_name, 0 AS sheet, 'Sheet: Nations' || chr(10) || 'key | name' || chr(10) || string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT r_name, 1, 'Sheet: Region' || chr(10) || r_name FROM region)")
def excel_files(t: Tables) -> DataFrame:
    """A workbook of two sheets for each region, with shared and inline strings, numbers and blank cells, read again."""
    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey", "n_name")
    return files.pages_of(files.packed_xlsx(rows, "r_name", "n_nationkey", "n_name")).select("path", "page", "text")


@query("S13", "SELECT r_name || '.epub' AS path, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey DESC) - 1 AS page, n_name || ' & its people, no ' || n_nationkey AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def book_files(t: Tables) -> DataFrame:
    """A book for each region, a nation a chapter, which its spine puts in falling order; scripts and heads are no text."""
    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey", "n_name")
    return files.pages_of(files.packed_epub(rows, "r_name", "n_nationkey", "n_name")).select("path", "page", "text")


@query("S10", "SELECT n_nationkey || '.pdf' AS path, n_name || 'land café (' || n_regionkey || ')' AS text, TRUE AS trusted FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey || '.pdf', 'x', FALSE FROM nation WHERE n_nationkey % 2 = 1")
def pdf_pages(t: Tables) -> DataFrame:
    """Pages of PDF files, repaired, composed, and judged; a page that isn't trusted is one to be read as a picture."""
    said = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("­land café ("), F.col("n_regionkey").cast("string"), F.lit(")"))).otherwise("x")
    pages = files.pages_of(files.packed_pdf(t.nation.select("n_nationkey", F.array(said).alias("lines")), "n_nationkey", "lines"))
    clean = pages.where("failure is null").select("path", tx.nfc(tx.repaired(F.col("text"))).alias("text"))
    return clean.select("path", "text", tx.trust(F.col("text"))["trusted"].alias("trusted"))


@query(
    "S15",
    """SELECT 'items' AS name, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS total FROM documents UNION ALL SELECT 'pages', 2 * count(*), CAST(sum(coalesce(length(text), 0) + length(source)) AS BIGINT) FROM documents UNION ALL SELECT 'facts', count(*), CAST(sum(n_chars) AS BIGINT) FROM documents""",
)
def corpus_loaded(t: Tables) -> DataFrame:
    """Documents written as JSON lines with pages and facts, and loaded into tables of items, pages and facts."""
    place = jobs.folder(t.spark)
    rows = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.lit("doc").alias("kind"), "lang", F.array(F.coalesce("text", F.lit("")), "source").alias("pages"), F.create_map(F.lit("AMOUNT"), F.col("n_chars").cast("string")).alias("facts"))
    rows.write.json(place)
    loaded = files.load_corpus(t.spark, place)
    out = [("items", F.col("id").cast("long")), ("pages", F.length("text")), ("facts", F.col("value").cast("long"))]
    counts = [loaded[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(v).cast("long").alias("total")) for name, v in out]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("R2", r"""SELECT page_id, concat_ws(' ', lower(regexp_extract(url, '[^/]+/?$')), trim(regexp_replace(lower(regexp_extract(url, '[^/]+/?$')), '[^\p{L}\p{N}]+', ' ', 'g')), 'tag' || page_id % 3, 'page', CASE WHEN page_id % 2 = 0 THEN 'bijli bil' END) AS words FROM pages""")
def indexed_texts(t: Tables) -> DataFrame:
    """What a page is found by: its name in both forms, its tags, its type, and the keys of its Devanagari words."""
    name = F.lower(F.regexp_extract("url", r"[^/]+/?$", 0))
    said = F.when(F.col("page_id") % 2 == 0, "बिजली बिल").otherwise("")
    return t.pages.select("page_id", lex.indexed_text(F.lit(None), name, F.concat(F.lit("tag"), (F.col("page_id") % 3).cast("string")), F.lit("page"), said).alias("words"))


# -- reports -------------------------------------------------------------------------------------------------------


@query(
    "X33",
    """SELECT 'AMOUNT' AS kind, count(*) AS found, count(*) FILTER (o_orderkey % 4 <> 0) + count(*) FILTER (o_orderkey % 4 = 1) AS "true", count(*) FILTER (o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0) AS "right",
    round(count(*) FILTER (o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0) / count(*), 6) AS precision, round(count(*) FILTER (o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0) / (count(*) FILTER (o_orderkey % 4 <> 0) + count(*) FILTER (o_orderkey % 4 = 1)), 6) AS recall FROM orders""",
)
def fact_scores(t: Tables) -> DataFrame:
    """Amounts read of orders' messages against true ones: every third is misread, a quarter has none, and another quarter a second one."""
    said = F.concat(F.lit("Rs "), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") + 7000001).otherwise(F.col("o_orderkey") + 1000000).cast("string"))
    found = facts.facts(t.orders.select("o_orderkey", said.alias("text")), "o_orderkey", "text").where("kind = 'AMOUNT'")
    value = lambda n: (F.col("o_orderkey") + n).cast("string").alias("value")
    truth = t.orders.where("o_orderkey % 4 <> 0").select("o_orderkey", F.lit("AMOUNT").alias("kind"), value(1000000)).unionByName(t.orders.where("o_orderkey % 4 = 1").select("o_orderkey", F.lit("AMOUNT").alias("kind"), value(3000000)))
    out = an.fact_scores(found.select("o_orderkey", "kind", "value"), truth, "o_orderkey")
    return out.select("kind", "found", "true", "right", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


LINES = """WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber % 3 AS reading, CASE l_partkey % 4 WHEN 0 THEN 'total due' WHEN 1 THEN 'the total due today' WHEN 2 THEN 'paid' ELSE 'prepaid card ' || l_quantity END AS line FROM lineitem),
    f AS (SELECT DISTINCT k, line FROM l), r AS (SELECT DISTINCT k, reading FROM l),
    x AS (SELECT f.k, r.reading, f.line, EXISTS (SELECT 1 FROM l WHERE l.k = f.k AND l.reading <> r.reading AND contains(l.line, f.line)) AS kept FROM f JOIN r ON r.k = f.k)"""


@query("X41", LINES + " SELECT k, CAST(reading AS BIGINT) AS reading, count(*) FILTER (NOT kept) AS lost_lines, round(100 * count(*) FILTER (kept) / count(*), 6) AS line_recall, round(100 * coalesce(sum(length(line)) FILTER (kept), 0) / sum(length(line)), 6) AS char_recall FROM x GROUP BY 1, 2")
def readings_ablated(t: Tables) -> DataFrame:
    """Lines of orders as lines that three readings found, some inside others: what is lost without each."""
    quantity = F.col("l_quantity").cast("string")
    line = F.when(F.col("l_partkey") % 4 == 0, "total due").when(F.col("l_partkey") % 4 == 1, "the total due today").when(F.col("l_partkey") % 4 == 2, "paid").otherwise(F.concat(F.lit("prepaid card "), quantity))
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 3).cast("long").alias("reading"), line.alias("line"))
    out = an.ablation(rows, "k", "reading", "line")
    return out.select("k", "reading", "lost_lines", F.round("line_recall", 6).alias("line_recall"), F.round("char_recall", 6).alias("char_recall"))


@query(
    "X48",
    """WITH s AS (SELECT row_number() OVER (ORDER BY a, b) AS setting, a, b FROM (SELECT unnest([10.0, 25.0, 50.0, 75.0]) AS a) x, (SELECT unnest([0, 2, 5]) AS b) y),
    o AS (SELECT setting, a, b, round(avg(CASE WHEN value >= a AND event_id % 7 >= b AND event_type = 'click' THEN 1.0 ELSE 0 END) - 0.5 * avg(CASE WHEN value >= a AND event_id % 7 >= b AND event_type <> 'click' THEN 1.0 ELSE 0 END), 9) AS objective FROM events, s GROUP BY 1, 2, 3)
    SELECT * FROM o ORDER BY objective DESC, setting LIMIT 1""",
)
def best_setting(t: Tables) -> DataFrame:
    """The limits on two scores that show the most clicks and the fewest others."""
    pairs = [(float(a), b) for a in (10, 25, 50, 75) for b in (0, 2, 5)]
    settings = t.spark.createDataFrame([(i + 1, *p) for i, p in enumerate(pairs)], "setting long, a double, b int")
    rows = t.events.select("value", "event_id", (F.col("event_type") == "click").alias("right"))
    return an.best_setting(rows, settings, (F.col("value") >= F.col("a")) & (F.col("event_id") % 7 >= F.col("b")), "right")


@query(
    "X49",
    """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), w AS (SELECT vec_id, label, [embedding[1:16], embedding[33:48]] AS ws FROM embeddings WHERE vec_id <> 0),
    u AS (SELECT vec_id, label, unnest(ws) AS v FROM w), n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))) AS len FROM u),
    z AS (SELECT vec_id, label, list_transform(v, lambda x: CAST(x AS DOUBLE) / len) AS v FROM n), m AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM z),
    d AS (SELECT vec_id, label, list_transform(v, lambda x: floor(x / scale + 0.5) * scale) AS v FROM m), k AS (SELECT list_transform(q[1:16], lambda x: CAST(x AS DOUBLE)) AS q FROM q),
    s AS (SELECT vec_id, label, round(max(list_sum(list_transform(list_zip(v, q), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(q, lambda x: x * x)))), 6) AS score FROM d, k GROUP BY 1, 2)
    SELECT label, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1""",
)
def window_ablation(t: Tables) -> DataFrame:
    """Two windows of sixteen dimensions, made unit vectors, taken to int8 and back; a row scores its better window, a label its first row."""
    asked = t.embeddings.where("vec_id = 0").select(vec.unit(F.slice("embedding", 1, 16)).alias("q"))
    short = lambda at: vec.dequantized(vec.quantized(vec.unit(F.slice("embedding", at, 16))))
    rows = t.embeddings.where("vec_id <> 0").select("vec_id", "label", short(1).alias("a"), short(33).alias("b")).crossJoin(F.broadcast(asked))
    rows = rows.select("vec_id", "label", F.round(F.greatest(vec.dot(F.col("a"), F.col("q")), vec.dot(F.col("b"), F.col("q"))), 6).alias("score"))
    return lex.top_per(rows, "label", "score", "vec_id", 1).select("label", "vec_id", "score")


