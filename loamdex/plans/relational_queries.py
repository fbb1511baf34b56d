"""Scans, filters, joins, aggregates, windows, sorts and set operations over the tables.

The metadata table of the engine (item, type, value, number, time) is the unpivot of orders and customers: AMOUNT is the
total price, DATE the order date, ORGANIZATION the customer's segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.operators import relational as op
from loamdex.plans.registry import Tables, query

EAV = """eav AS (
  SELECT o_orderkey AS item_id, 'AMOUNT' AS type, NULL::VARCHAR AS value, o_totalprice AS num, NULL::TIMESTAMP AS ts FROM orders
  UNION ALL SELECT o_orderkey, 'DATE', NULL, NULL, o_orderdate FROM orders
  UNION ALL SELECT o_orderkey, 'ORGANIZATION', c_mktsegment, NULL, NULL FROM orders JOIN customer ON o_custkey = c_custkey)"""


def eav(t: Tables) -> DataFrame:
    """The metadata table (see above)."""
    orders = t.orders
    rows = lambda df, kind, value=None, num=None, ts=None: df.select(
        F.col("o_orderkey").alias("item_id"),
        F.lit(kind).alias("type"),
        (F.col(value) if value else F.lit(None).cast("string")).alias("value"),
        (F.col(num) if num else F.lit(None).cast("double")).alias("num"),
        (F.col(ts) if ts else F.lit(None).cast("timestamp")).alias("ts"),
    )
    named = orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows(orders, "AMOUNT", num="o_totalprice").unionByName(rows(orders, "DATE", ts="o_orderdate")).unionByName(rows(named, "ORGANIZATION", value="c_mktsegment"))


day = lambda c: F.date_format(c, "yyyy-MM-dd")


# -- scans ---------------------------------------------------------------------------------------------------------


@query("S1 F1", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def scan_newest_first(t: Tables) -> DataFrame:
    return op.newest_first(t.orders.select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate", "o_orderkey").select("o_orderkey", day("o_orderdate").alias("day"), "o_totalprice")


@query("S2 O7", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def scan_page_after_key(t: Tables) -> DataFrame:
    return op.page_after(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", 500, 100)


@query("S3", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 33, 64, 900, 1000001)")
def scan_by_ids(t: Tables) -> DataFrame:
    return op.by_ids(t.orders, "o_orderkey", [1, 7, 33, 64, 900, 1000001]).select("o_orderkey", "o_totalprice")


@query("S4 F14", "SELECT EXISTS(SELECT 1 FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)) AS found, (SELECT count(*) FROM documents WHERE text IS NULL) AS without_text")
def scan_equality_exists(t: Tables) -> DataFrame:
    brand = t.part.agg(F.min("p_brand").alias("b"))
    found = t.part.join(F.broadcast(brand), F.col("p_brand") == F.col("b"), "left_semi").limit(1).agg((F.count("*") > 0).alias("found"))
    return found.crossJoin(t.documents.where("text is null").agg(F.count("*").alias("without_text")))


@query("S5", "SELECT page_id, url FROM pages WHERE url ILIKE 'https://%' AND (url ILIKE '%blog.%' OR url ILIKE '%/EN/%')")
def scan_prefix_substring(t: Tables) -> DataFrame:
    return t.pages.where(F.col("url").ilike("https://%") & op.contains_any(F.col("url"), ["blog.", "/EN/"])).select("page_id", "url")


@query("S7 O1", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 20")
def scan_recent(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "user_id")


@query(
    "S8 S9 J4",
    """WITH stored AS (SELECT o_custkey AS c_custkey, max(o_orderdate) AS read_at FROM orders GROUP BY 1),
    found AS (SELECT c_custkey, TIMESTAMP '1996-01-01' + to_days(CAST(c_custkey % 900 AS INT)) AS modified FROM customer)
    SELECT decision, count(*) AS n FROM (SELECT CASE WHEN s.c_custkey IS NULL THEN 'READ' WHEN modified > read_at THEN 'READ_AGAIN' ELSE 'LEAVE' END AS decision
    FROM found f LEFT JOIN stored s USING (c_custkey)) GROUP BY 1""",
)
def discovery_decisions(t: Tables) -> DataFrame:
    stored = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("read_at"))
    found = t.customer.select("c_custkey", F.expr("timestamp'1996-01-01' + make_dt_interval(cast(c_custkey % 900 as int))").alias("modified"))
    return op.changed_since(found, stored, "c_custkey", "modified", "read_at").groupBy("decision").agg(F.count("*").alias("n"))


@query("S16 S18 A8", "SELECT label, count(*) AS n FROM embeddings WHERE label = 3 GROUP BY 1")
def vectors_of_one_model(t: Tables) -> DataFrame:
    return t.embeddings.where("label = 3").groupBy("label").agg(F.count("*").alias("n"))


@query(
    "S17",
    """SELECT user_id, event_id, score FROM (SELECT user_id, event_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ts DESC, event_id) AS rn
    FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 50 WHEN 'signup' THEN 40 WHEN 'click' THEN 20 ELSE 10 END + CASE WHEN value > 50 THEN 5 ELSE 0 END AS score FROM events)) WHERE rn = 1""",
)
def primary_attachment(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", 50).when(F.col("event_type") == "signup", 40).when(F.col("event_type") == "click", 20).otherwise(10)
    scored = t.events.withColumn("score", kind + F.when(F.col("value") > 50, 5).otherwise(0))
    return op.first_per(scored, ["user_id"], [F.desc("score"), F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id", "score")


# -- maintenance ---------------------------------------------------------------------------------------------------


@query(
    "K1",
    """WITH new AS (SELECT s_suppkey, s_acctbal + 10 AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey + 100000, s_acctbal FROM supplier WHERE s_suppkey < 4)
    SELECT s_suppkey, round(s_acctbal, 4) AS s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM new) UNION ALL SELECT s_suppkey, round(s_acctbal, 4) FROM new""",
)
def upsert_suppliers(t: Tables) -> DataFrame:
    old = t.supplier.select("s_suppkey", "s_acctbal")
    new = old.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 10).unionByName(old.where("s_suppkey < 4").withColumn("s_suppkey", F.col("s_suppkey") + 100000))
    return op.upsert(old, new, ["s_suppkey"], [F.desc("s_acctbal")]).withColumn("s_acctbal", F.round("s_acctbal", 4))


@query(
    "K2",
    "SELECT s_suppkey, 'old' AS origin FROM supplier WHERE s_suppkey <= 5 UNION ALL SELECT s_suppkey, 'new' FROM supplier WHERE s_suppkey > 5",
)
def insert_or_ignore_suppliers(t: Tables) -> DataFrame:
    old = t.supplier.where("s_suppkey <= 5").select("s_suppkey", F.lit("old").alias("origin"))
    new = t.supplier.select("s_suppkey", F.lit("new").alias("origin"))
    return op.insert_or_ignore(old, new, ["s_suppkey"], [F.asc("origin")])


@query("K3 J8", "SELECT count(*) AS kept, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS orphans FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def delete_orphan_orders(t: Tables) -> DataFrame:
    kept, orphans = op.delete_orphans(t.orders, t.customer.where("c_acctbal > 0"), "o_custkey", "c_custkey")
    return kept.agg(F.count("*").alias("kept")).crossJoin(orphans.agg(F.count("*").alias("orphans")))


@query("K3 K4", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, greatest(c_nationkey, 5) AS c_nationkey FROM customer WHERE NOT coalesce(c_mktsegment = 'BUILDING', FALSE)")
def delete_and_update(t: Tables) -> DataFrame:
    left = op.delete_where(t.customer.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"), F.col("c_mktsegment") == "BUILDING").drop("c_mktsegment")
    left = op.update_where(left, F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)})
    return op.update_where(left, F.lit(True), {"c_nationkey": F.greatest("c_nationkey", F.lit(5))})


@query(
    "K5 K6 U4",
    """WITH new AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey < 200 AND l_linenumber % 2 = 1),
    gone AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM new) EXCEPT SELECT * FROM new)
    SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new)) + (SELECT count(*) FROM new) AS rows_after, (SELECT count(*) FROM gone) AS removed""",
)
def replace_documents(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    new = rows.where("l_orderkey < 200 and l_linenumber % 2 = 1")
    after, gone = op.replace_documents(rows, new, "l_orderkey", "id")
    return after.agg(F.count("*").alias("rows_after")).crossJoin(gone.agg(F.countDistinct("id").alias("removed")))


@query(
    "K8 U6",
    """SELECT count(DISTINCT a.doc_id) AS linked FROM (SELECT doc_id, md5(text) AS h, source || n_chars AS k FROM documents WHERE doc_id % 2 = 0) a
    JOIN (SELECT doc_id, md5(text) AS h, source || n_chars AS k FROM documents WHERE doc_id % 2 = 1) b ON a.h = b.h OR a.k = b.k""",
)
def relink_by_hash(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.concat("source", F.col("n_chars").cast("string")).alias("k"))
    files = rows.where("doc_id % 2 = 1").select(F.col("doc_id").alias("file_id"), F.col("h").alias("file_h"), F.col("k").alias("file_k"))
    return op.relink(rows.where("doc_id % 2 = 0"), files, [("h", "file_h"), ("k", "file_k")]).agg(F.countDistinct("doc_id").alias("linked"))


@query(
    "K9 J9",
    """SELECT o_custkey AS document_id, count(*) AS piece_count, min(o_orderkey) AS first_piece, split_part(min(o_orderpriority), '-', 1) AS priority, 1 AS version FROM orders GROUP BY 1""",
)
def schema_migration_backfill(t: Tables) -> DataFrame:
    made = t.orders.groupBy(F.col("o_custkey").alias("document_id")).agg(
        F.count("*").alias("piece_count"), F.min("o_orderkey").alias("first_piece"), F.substring_index(F.min("o_orderpriority"), "-", 1).alias("priority")
    )
    return op.add_column(made, "version", 1)


# -- filters -------------------------------------------------------------------------------------------------------


@query("F2", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-03-31' OR o_totalprice > 400000")
def range_filters(t: Tables) -> DataFrame:
    return t.orders.where("o_orderdate between timestamp'1995-03-01' and timestamp'1995-03-31' or o_totalprice > 400000").select("o_orderkey", "o_totalprice")


@query(
    "F3 U1 U2 X12",
    f"""WITH {EAV}, dated AS (SELECT DISTINCT item_id FROM eav WHERE type = 'DATE' AND item_id % 5 <> 0 AND ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1996-01-01'),
    all_dated AS (SELECT DISTINCT item_id FROM eav WHERE type = 'DATE' AND item_id % 5 <> 0)
    SELECT item_id FROM dated UNION SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT item_id FROM all_dated) AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'
    UNION SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1-%' AND o_totalprice > 450000""",
)
def strict_date_union(t: Tables) -> DataFrame:
    dates = eav(t).where("type = 'DATE' and item_id % 5 <> 0").select("item_id", "ts")
    inside = lambda c: (F.col(c) >= F.lit("1995-01-01").cast("timestamp")) & (F.col(c) < F.lit("1996-01-01").cast("timestamp"))
    undated = t.orders.withColumnRenamed("o_orderkey", "item_id").join(dates.select("item_id"), "item_id", "left_anti").where(inside("o_orderdate")).select("item_id")
    says = t.orders.where("o_orderpriority like '1-%' and o_totalprice > 450000").select(F.col("o_orderkey").alias("item_id"))
    return dates.where(inside("ts")).select("item_id").union(undated).union(says).distinct()


@query("F4 U1", f"WITH {EAV} SELECT item_id FROM eav WHERE type = 'AMOUNT' AND num BETWEEN 1000 AND 20000 UNION SELECT l_orderkey FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 1500")
def union_amount_ids(t: Tables) -> DataFrame:
    facts = t.lineitem.where("l_extendedprice between 1000 and 1500").select(F.col("l_orderkey").alias("item_id"))
    return eav(t).where("type = 'AMOUNT' and num between 1000 and 20000").select("item_id").union(facts).distinct()


@query(
    "F5 F6 U3",
    f"""WITH {EAV} SELECT o_orderkey AS item_id, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT item_id FROM eav WHERE type = 'ORGANIZATION' AND value IN ('BUILDING', 'MACHINERY'))
    AND o_orderkey IN (SELECT item_id FROM eav WHERE type = 'DATE' AND ts >= TIMESTAMP '1997-01-01') AND o_orderkey IN (SELECT item_id FROM eav WHERE type = 'AMOUNT' AND num > 100000)""",
)
def strict_conjunction(t: Tables) -> DataFrame:
    m = eav(t)
    wanted = [m.where(F.col("type") == "ORGANIZATION").where(F.col("value").isin("BUILDING", "MACHINERY")), m.where("type = 'DATE' and ts >= timestamp'1997-01-01'"), m.where("type = 'AMOUNT' and num > 100000")]
    return op.keep_all_of(t.orders.select(F.col("o_orderkey").alias("item_id"), "o_orderstatus"), "item_id", wanted)


@query(
    "F9 F10 O5",
    "SELECT o_orderkey, TRUE AS relaxed FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 25",
)
def relaxed_blank_query(t: Tables) -> DataFrame:
    order = lambda df: df.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey")
    rows = t.orders.where("o_totalprice > 100000")
    found, relaxed = op.relaxing(order(rows.where("o_orderstatus = 'NONE'")), order(rows))
    return found.withColumn("relaxed", F.lit(relaxed))


@query("F12 X53", "SELECT source, count(*) AS n FROM documents WHERE length(trim(coalesce(text, ''))) > 0 OR lang = 'zxx' GROUP BY 1")
def rows_read_to_end(t: Tables) -> DataFrame:
    return t.documents.where((F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) | (F.col("lang") == "zxx")).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "F13 O4",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate, o_orderkey LIMIT 200",
)
def unfinished_in_case_order(t: Tables) -> DataFrame:
    order = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.where("o_orderstatus <> 'F'").orderBy(order, "o_orderdate", "o_orderkey").limit(200).select("o_orderkey", "o_orderstatus")


# -- joins ---------------------------------------------------------------------------------------------------------


@query(
    "J1 A1",
    f"""WITH {EAV} SELECT e.value AS entity, count(DISTINCT a.item_id) AS items, round(sum(a.num), 2) AS total, round(avg(a.num), 4) AS mean,
    string_agg(DISTINCT substr(o_orderpriority, 1, 1), ',' ORDER BY substr(o_orderpriority, 1, 1)) AS priorities
    FROM eav a JOIN eav e ON a.item_id = e.item_id JOIN orders ON o_orderkey = a.item_id WHERE a.type = 'AMOUNT' AND e.type = 'ORGANIZATION' GROUP BY 1""",
)
def eav_self_join_total(t: Tables) -> DataFrame:
    m = eav(t)
    amounts, entities = m.where("type = 'AMOUNT'").select("item_id", "num"), m.where("type = 'ORGANIZATION'").select("item_id", F.col("value").alias("entity"))
    both = amounts.join(entities, "item_id").join(t.orders.select(F.col("o_orderkey").alias("item_id"), F.substring("o_orderpriority", 1, 1).alias("p")), "item_id")
    return both.groupBy("entity").agg(
        F.countDistinct("item_id").alias("items"), F.round(F.sum("num"), 2).alias("total"), F.round(F.avg("num"), 4).alias("mean"), F.array_join(F.sort_array(F.collect_set("p")), ",").alias("priorities")
    )


@query("J2", f"WITH {EAV} SELECT e.value AS entity, strftime(max(d.ts), '%Y-%m-%d') AS last_action FROM eav d JOIN eav e ON d.item_id = e.item_id AND d.type = 'DATE' AND e.type = 'ORGANIZATION' GROUP BY 1")
def last_action_date(t: Tables) -> DataFrame:
    m = eav(t)
    both = m.where("type = 'DATE'").select("item_id", "ts").join(m.where("type = 'ORGANIZATION'").select("item_id", F.col("value").alias("entity")), "item_id")
    return both.groupBy("entity").agg(day(F.max("ts")).alias("last_action"))


@query(
    "J4 O9",
    """SELECT o_orderkey, coalesce(p.priority, 0) AS priority FROM orders LEFT JOIN (SELECT c_custkey AS k, c_nationkey % 4 AS priority FROM customer WHERE c_acctbal > 5000) p ON coalesce(NULLIF(o_custkey, 0), o_orderkey) = p.k
    ORDER BY priority DESC, o_orderdate DESC, o_orderkey LIMIT 150""",
)
def left_join_computed_key(t: Tables) -> DataFrame:
    p = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 4).alias("priority"))
    rows = t.orders.join(p, F.expr("coalesce(nullif(o_custkey, 0), o_orderkey) = k"), "left").withColumn("priority", F.coalesce("priority", F.lit(0)))
    return rows.orderBy(F.desc("priority"), F.desc("o_orderdate"), "o_orderkey").limit(150).select("o_orderkey", "priority")


@query("J5", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND labels.toxic = 0)")
def anti_join_unlabelled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.where("toxic = 0").select("doc_id"), "doc_id", "left_anti")


@query("J6 W1", "SELECT a.l_orderkey, a.l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = a.l_returnflag AND b.l_linenumber < a.l_linenumber)")
def theta_first_line_item(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    # no row of the same order and flag has a smaller line: ties at the smallest all stay
    w = Window.partitionBy("l_orderkey", "l_returnflag")
    return rows.withColumn("least", F.min("l_linenumber").over(w)).where("l_linenumber = least").select("l_orderkey", "l_linenumber")


@query("J7", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def semi_join_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id").join(t.documents.where("lang <> 'en'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")


@query(
    "J10",
    f"""WITH {EAV} SELECT CASE e.type WHEN 'AMOUNT' THEN 'amount' WHEN 'DATE' THEN 'date' WHEN 'ORGANIZATION' THEN 'party' END AS kind, o_orderstatus AS status, count(*) AS n
    FROM eav e JOIN orders ON o_orderkey = item_id GROUP BY 1, 2""",
)
def metadata_to_facts(t: Tables) -> DataFrame:
    kind = F.when(F.col("type") == "AMOUNT", "amount").when(F.col("type") == "DATE", "date").when(F.col("type") == "ORGANIZATION", "party")
    rows = eav(t).join(t.orders.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("status")), "item_id")
    return rows.groupBy(kind.alias("kind"), "status").agg(F.count("*").alias("n"))


@query(
    "J11 R9",
    "SELECT h.rank, d.doc_id, d.lang FROM (VALUES (1, 40), (2, 7), (3, 123456789), (4, 11), (5, 3)) h(rank, doc_id) JOIN documents d ON d.doc_id = h.doc_id ORDER BY 1",
)
def rank_preserving_lookup(t: Tables) -> DataFrame:
    hits = t.spark.createDataFrame([(1, 40), (2, 7), (3, 123456789), (4, 11), (5, 3)], "rank int, doc_id long")
    return t.documents.select("doc_id", "lang").join(F.broadcast(hits), "doc_id").orderBy("rank").select("rank", "doc_id", "lang")


@query(
    "J15 J17",
    """WITH a AS (SELECT c_custkey AS k, c_name, c_acctbal, c_nationkey FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey AS k, c_name, c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS c_acctbal,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 6 <> 0),
    j AS (SELECT a.k AS ak, b.k AS bk, a.c_name AS n1, b.c_name AS n2, a.c_acctbal AS x1, b.c_acctbal AS x2, a.c_nationkey AS y1, b.c_nationkey AS y2 FROM a FULL JOIN b ON a.k = b.k),
    s AS (SELECT 'c_name' AS "column", ak, bk, n1 IS NOT DISTINCT FROM n2 AS same FROM j UNION ALL SELECT 'c_acctbal', ak, bk, x1 IS NOT DISTINCT FROM x2 FROM j UNION ALL SELECT 'c_nationkey', ak, bk, y1 IS NOT DISTINCT FROM y2 FROM j)
    SELECT "column", CASE WHEN ak IS NULL THEN 'only_right' WHEN bk IS NULL THEN 'only_left' WHEN same THEN 'same' ELSE 'differs' END AS state, count(*) AS n FROM s GROUP BY 1, 2""",
)
def full_outer_compare(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("k"), "c_name", "c_acctbal", "c_nationkey")
    b = c.where("k % 6 <> 0").withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("k") % 5 == 0, 1).otherwise(0)).withColumn("c_nationkey", F.when(F.col("k") % 11 != 0, F.col("c_nationkey")))
    return op.compare_tables(c.where("k % 7 <> 0"), b, "k")


# -- aggregates ----------------------------------------------------------------------------------------------------


@query(
    "A5 A6",
    """SELECT o_custkey, count(*) AS rows_total, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS rows_done,
    CASE WHEN sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = count(*) THEN 'FULL' WHEN sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) > 0 THEN 'PARTIAL' ELSE 'NONE' END AS tier FROM orders GROUP BY 1""",
)
def coverage_tiers(t: Tables) -> DataFrame:
    rows = t.orders.groupBy("o_custkey").agg(F.count("*").alias("rows_total"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("rows_done"))
    tier = F.when(F.col("rows_done") == F.col("rows_total"), "FULL").when(F.col("rows_done") > 0, "PARTIAL").otherwise("NONE")
    return rows.withColumn("tier", tier)


@query("A6 A8 A9", "SELECT count(*) AS n, coalesce(CAST(sum(l_linenumber) AS BIGINT), 0) AS lines, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem WHERE l_quantity > 10")
def totals_and_distinct(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity > 10").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("l_linenumber"), F.lit(0)).alias("lines"), F.countDistinct("l_suppkey").alias("suppliers"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned")
    )


@query("A7", "SELECT coalesce(max(l_linenumber) + 1, 0) AS next_line, coalesce((SELECT max(l_linenumber) + 1 FROM lineitem WHERE l_orderkey = -1), 0) AS next_of_none FROM lineitem WHERE l_orderkey = 1")
def next_index(t: Tables) -> DataFrame:
    next_ = lambda key, name: t.lineitem.where(F.col("l_orderkey") == key).agg(F.coalesce(F.max("l_linenumber") + 1, F.lit(0)).alias(name))
    return next_(1, "next_line").crossJoin(next_(-1, "next_of_none"))


@query("A10", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_pairs(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("A11 A12", "SELECT event_type, count(*) AS frequency, round(avg(value), 6) AS mean, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen FROM events GROUP BY 1")
def frequency_and_mean(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("frequency"), F.round(F.avg("value"), 6).alias("mean"), day(F.min("ts")).alias("first_seen"), day(F.max("ts")).alias("last_seen")
    )


@query(
    "A14",
    """SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high, CASE WHEN count(*) >= 10 THEN 'many' WHEN count(*) >= 3 THEN 'some' ELSE 'few' END AS bucket FROM customer GROUP BY 1, 2""",
)
def profile_by_kind(t: Tables) -> DataFrame:
    rows = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
    return rows.withColumn("bucket", F.when(F.col("n") >= 10, "many").when(F.col("n") >= 3, "some").otherwise("few"))


@query(
    "A17 A28",
    """SELECT stage, count(*) AS n, round(sum(v), 2) AS total, CAST(sum(CAST(floor(v) AS BIGINT)) // count(*) AS BIGINT) AS mean_whole FROM (SELECT 'price' AS stage, l_extendedprice AS v FROM lineitem
    UNION ALL SELECT 'tax', l_extendedprice * l_tax FROM lineitem UNION ALL SELECT 'discount', l_extendedprice * l_discount FROM lineitem) GROUP BY 1""",
)
def stage_totals(t: Tables) -> DataFrame:
    stages = F.create_map(F.lit("price"), F.col("l_extendedprice"), F.lit("tax"), F.col("l_extendedprice") * F.col("l_tax"), F.lit("discount"), F.col("l_extendedprice") * F.col("l_discount"))
    rows = t.lineitem.select(F.explode(stages).alias("stage", "v")).groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.sum(F.floor("v")).alias("w"))
    return rows.select("stage", "n", "total", F.expr("w div n").alias("mean_whole"))


# -- windows and sorts ---------------------------------------------------------------------------------------------


@query(
    "W2 W3",
    """WITH r AS (SELECT *, first_value(l_returnflag) OVER w AS f FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber))
    SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = f THEN 0 ELSE 1 END, l_quantity DESC, l_shipdate, l_linenumber) AS rn FROM r) WHERE rn = 1""",
)
def best_of_first_ties(t: Tables) -> DataFrame:
    # the SQL leaves open which of two lines of one date and number is first; by the flag, reruns agree
    order = [F.asc("l_shipdate"), F.asc("l_linenumber"), F.asc("l_returnflag")]
    return op.best_of_first_ties(t.lineitem, "l_orderkey", order, F.col("l_returnflag"), [F.desc("l_quantity")]).select("l_orderkey", "l_linenumber")


@query(
    "W4 W9 A14",
    """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 3 DAY THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
    SELECT user_id, session, count(*) AS n, round(sum(value), 4) AS total, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began FROM s GROUP BY 1, 2""",
)
def gap_sessions_events(t: Tables) -> DataFrame:
    rows = op.gap_sessions(t.events, ["user_id"], "ts", 3 * 86400, ["event_id"])
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("began"))


@query(
    "W5 W6",
    """SELECT user_id, event_id, round(value, 4) AS value, round(value - coalesce(lead(value) OVER w, 0), 4) AS lead FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS best FROM events)
    WHERE value >= best - 5 WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)""",
)
def lead_within_gap_of_best(t: Tables) -> DataFrame:
    rows = t.events.withColumn("best", F.max("value").over(Window.partitionBy("user_id"))).where("value >= best - 5")
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return rows.select("user_id", "event_id", F.round("value", 4).alias("value"), F.round(F.col("value") - F.coalesce(F.lead("value").over(w), F.lit(0)), 4).alias("lead"))


@query(
    "W9",
    """SELECT CAST(floor((rn - 1) / 6) AS BIGINT) AS stretch, conv_id, min(turn) AS first_turn, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations) GROUP BY 1, 2""",
)
def stretches_of_six(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = t.conversations.withColumn("stretch", F.floor((F.row_number().over(w) - 1) / 6))
    return rows.groupBy("stretch", "conv_id").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


@query(
    "W11 R22",
    f"""WITH {EAV} SELECT o_orderkey AS item_id, strftime(coalesce(d.ts, TIMESTAMP '1990-01-01'), '%Y-%m-%d') AS effective FROM orders LEFT JOIN (SELECT item_id, ts, row_number() OVER (PARTITION BY item_id ORDER BY ts) AS rn
    FROM eav WHERE type = 'DATE' AND item_id % 3 <> 0) d ON d.item_id = o_orderkey AND rn = 1""",
)
def effective_date(t: Tables) -> DataFrame:
    first = op.first_per(eav(t).where("type = 'DATE' and item_id % 3 <> 0").select("item_id", "ts"), ["item_id"], [F.asc("ts")])
    rows = t.orders.select(F.col("o_orderkey").alias("item_id")).join(first, "item_id", "left")
    return rows.select("item_id", day(F.coalesce("ts", F.lit("1990-01-01").cast("timestamp"))).alias("effective"))


@query(
    "W12 X41",
    """WITH b AS (SELECT event_type, count(DISTINCT user_id) AS users, CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS INT) AS step FROM events GROUP BY 1)
    SELECT event_type, users, CAST(sum(users) OVER (ORDER BY step, event_type ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ladder FROM b""",
)
def cumulative_ladder(t: Tables) -> DataFrame:
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    rows = t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users")).withColumn("step", step)
    return rows.select("event_type", "users", F.sum("users").over(Window.orderBy("step", "event_type").rowsBetween(Window.unboundedPreceding, 0)).alias("ladder"))


@query("W13 O2", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def longest_documents(t: Tables) -> DataFrame:
    return t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "n_chars")


@query(
    "W16",
    "SELECT event_type, user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events WHERE user_id = (SELECT min(user_id) FROM events) GROUP BY 1, 2 ORDER BY max(ts) DESC, event_type LIMIT 10",
)
def recent_distinct_history(t: Tables) -> DataFrame:
    user = t.events.agg(F.min("user_id").alias("u"))
    rows = t.events.join(F.broadcast(user), F.col("user_id") == F.col("u"), "left_semi").groupBy("event_type", "user_id").agg(F.max("ts").alias("ts"))
    return rows.orderBy(F.desc("ts"), "event_type").limit(10).select("event_type", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


@query(
    "O3",
    "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY (CAST(l_quantity AS BIGINT) * 1024 + l_linenumber) DESC, l_orderkey, l_linenumber LIMIT 50",
)
def packed_key_sort(t: Tables) -> DataFrame:
    key = F.col("l_quantity").cast("long") * 1024 + F.col("l_linenumber")
    return t.lineitem.orderBy(key.desc(), "l_orderkey", "l_linenumber").limit(50).select("l_orderkey", "l_linenumber")


@query("O6", "SELECT event_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 15")
def newest_queue(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(15).select("event_id")


@query("U4", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query(
    "U5",
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
    SELECT (SELECT count(*) FROM a SEMI JOIN b USING (user_id)) AS shared, round((SELECT count(*) FROM a SEMI JOIN b USING (user_id)) / greatest((SELECT count(*) FROM a), (SELECT count(*) FROM b)), 6) AS overlap""",
)
def overlap_ratio(t: Tables) -> DataFrame:
    users = lambda kind, name: t.events.where(F.col("event_type") == kind).select("user_id").distinct().withColumn(name, F.lit(1))
    both = users("click", "a").join(users("purchase", "b"), "user_id", "full_outer")
    n = both.agg(F.count(F.expr("a + b")).alias("shared"), F.count("a").alias("na"), F.count("b").alias("nb"))
    return n.select("shared", F.round(F.col("shared") / F.greatest("na", "nb"), 6).alias("overlap"))


@query(
    "U6",
    "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2",
)
def distinct_by_key(t: Tables) -> DataFrame:
    return op.first_per(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.asc("event_id")])


@query(
    "W7",
    """SELECT user_id, event_id, prev_id FROM (SELECT *, lag(event_id) OVER w AS prev_id, lag(ts) OVER w AS prev_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE prev_ts IS NOT NULL AND ts - prev_ts <= INTERVAL 6 HOUR""",
)
def lag_pairs(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.withColumn("prev_id", F.lag("event_id").over(w)).withColumn("gap", F.col("ts") - F.lag("ts").over(w))
    return rows.where("gap <= interval 6 hours").select("user_id", "event_id", "prev_id")


@query(
    "F7 F8 X42",
    """SELECT CASE WHEN html IS NULL OR length(html) = 0 THEN 'empty' WHEN url ILIKE '%blog.%' THEN 'blog' WHEN url ILIKE '%shop%' OR url ILIKE '%cheap%' THEN 'shop' WHEN url ILIKE '%.html%' THEN 'page' WHEN url LIKE 'https://%' THEN 'secure' ELSE 'other' END AS species, count(*) AS n FROM pages GROUP BY 1""",
)
def content_species(t: Tables) -> DataFrame:
    url = F.col("url")
    species = (
        F.when(F.col("html").isNull() | (F.length("html") == 0), "empty")
        .when(op.contains_any(url, ["blog."]), "blog")
        .when(op.contains_any(url, ["shop", "cheap"]), "shop")
        .when(op.contains_any(url, [".html"]), "page")
        .when(url.startswith("https://"), "secure")
        .otherwise("other")
    )
    return t.pages.groupBy(species.alias("species")).agg(F.count("*").alias("n"))


@query("F6 X53", "SELECT json_extract_string(props, '$.k') AS k, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def json_prop_agg(t: Tables) -> DataFrame:
    return t.events.groupBy(F.get_json_object("props", "$.k").alias("k"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
