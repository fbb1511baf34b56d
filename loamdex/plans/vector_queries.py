"""Vector search over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions import pictures
from loamdex.operators import vectors as vec
from loamdex.plans.registry import Tables, query

E = "CAST(embedding AS DOUBLE[])"
QUERIES = f"q AS (SELECT vec_id AS query_id, {E} AS q FROM embeddings WHERE vec_id IN (0, 7, 42)), v AS (SELECT vec_id AS id, label, {E} AS v FROM embeddings)"


def scored(t: Tables) -> DataFrame:
    """(id, label, embedding, query_id, query, score) of three queries against all vectors."""
    queries = t.embeddings.where(F.col("vec_id").isin(0, 7, 42)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vec.scored(t.embeddings.withColumnRenamed("vec_id", "id"), queries).withColumn("score", F.round("score", 9))


@query(
    "R23 J12 O2",
    f"WITH {QUERIES} SELECT query_id, id, round(list_cosine_similarity(v, q), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v, q), 9) DESC, id) AS INT) AS rank FROM q, v QUALIFY rank <= 20",
)
def cosine_topk(t: Tables) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored(t).withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "R24",
    f"""WITH v AS (SELECT vec_id, {E} AS v FROM embeddings), s AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM v), z AS (SELECT *, list_transform(v, lambda x: CAST(floor(x / scale + 0.5) AS INT)) AS q FROM s)
    SELECT vec_id, round(scale, 9) AS scale, CAST(list_sum(q) AS BIGINT) AS total, list_max(q) AS top, round(list_cosine_similarity(v, CAST(q AS DOUBLE[])), 6) AS fidelity FROM z""",
)
def quantize_int8(t: Tables) -> DataFrame:
    rows = t.embeddings.withColumn("p", vec.quantized(F.col("embedding")))
    total = F.aggregate("p.q", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("vec_id", F.round("p.scale", 9).alias("scale"), total.alias("total"), F.array_max("p.q").alias("top"), F.round(vec.cosine(F.col("embedding"), vec.dequantized(F.col("p"))), 6).alias("fidelity"))


@query(
    "R26 A15 W14 W6",
    f"""WITH {QUERIES}, s AS (SELECT query_id, id, round(list_cosine_similarity(v, q), 9) AS score FROM q, v), z AS (SELECT *, (score - avg(score) OVER w) / stddev_pop(score) OVER w AS standing FROM s WINDOW w AS (PARTITION BY query_id)),
    k AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM z WHERE standing >= 2) SELECT query_id, id, round(standing, 5) AS standing FROM k WHERE score >= best - 0.6""",
)
def zscore_gate(t: Tables) -> DataFrame:
    rows = vec.standing(scored(t).select("query_id", "id", "score"), "score", "query_id").where("standing >= 2")
    return vec.within_gap(rows, "query_id", "score", 0.6).select("query_id", "id", F.round("standing", 5).alias("standing"))


CENTROIDS = "parts AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM v) GROUP BY 1, 2), anchors AS (SELECT label, list(m ORDER BY i) AS a FROM parts GROUP BY 1)"


def centroids(t: Tables) -> DataFrame:
    """(label, anchor): the mean vector of each label, by components."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))  # as many entries as dimensions
    return packed.select("label", F.transform("p", lambda s: s["m"]).alias("anchor"))


@query(
    "R25 W6",
    f"""WITH {QUERIES}, {CENTROIDS}, m AS (SELECT query_id, id, round(list_cosine_similarity(v, q), 9) AS score, round(list_cosine_similarity(v, q), 9) - (SELECT max(list_dot_product(v.v, a)) FROM anchors) AS margin FROM q, v)
    SELECT query_id, id, round(margin, 5) AS margin FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM m WHERE margin >= -0.1) WHERE score >= best - 0.8""",
)
def margin_to_centroids(t: Tables) -> DataFrame:
    rows = vec.margin(scored(t), centroids(t), "embedding", "score").where("margin >= -0.1")
    return vec.within_gap(rows, "query_id", "score", 0.8).select("query_id", "id", F.round("margin", 5).alias("margin"))


@query(
    "R26 W5",
    f"""WITH {QUERIES}, {CENTROIDS}, m AS (SELECT query_id, id, round(list_cosine_similarity(v, q), 9) AS score, round(list_cosine_similarity(v, q), 9) - (SELECT max(list_dot_product(v.v, a)) FROM anchors) AS margin FROM q, v WHERE id < 150),
    l AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM m WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id)),
    t AS (SELECT query_id, score AS top FROM l WHERE rn = 1 AND (coalesce(score - nxt, 1e9) >= 0.05 OR margin >= 0.06) AND margin >= -0.03)
    SELECT m.query_id, m.id, CAST(row_number() OVER (PARTITION BY m.query_id ORDER BY m.score DESC, m.id) AS INT) AS rank FROM m JOIN t ON m.query_id = t.query_id WHERE score >= top - 0.04 AND margin >= -0.03 QUALIFY rank <= 10""",
)
def small_corpus_gate(t: Tables) -> DataFrame:
    rows = vec.margin(scored(t).where("id < 150"), centroids(t), "embedding", "score")
    rows = vec.standing(rows.select("query_id", "id", "score", "margin"), "score", "query_id")
    return vec.meaning_gate(rows, "query_id").select("query_id", "id", "rank")


@query(
    "R27 J5",
    "SELECT vec_id, md5(text) <> md5(text || CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE '' END) AS stale FROM embeddings JOIN documents ON doc_id = vec_id",
)
def stale_vectors(t: Tables) -> DataFrame:
    now = F.concat("text", F.when(F.col("doc_id") % 4 == 0, " ").otherwise(""))
    hash_ = lambda c: F.md5(c.cast("binary"))
    rows = t.embeddings.select("vec_id").join(t.documents.select("doc_id", "text"), F.col("vec_id") == F.col("doc_id"))
    return rows.select("vec_id", (hash_(F.col("text")) != hash_(now)).alias("stale"))


@query(
    "X49",
    f"""WITH {QUERIES}, a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v, q), 9) DESC, id) AS r FROM q, v),
    b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v[1:32], q[1:32]), 9) DESC, id) AS r FROM q, v)
    SELECT a.query_id, count(*) AS shared FROM a JOIN b ON a.query_id = b.query_id AND a.id = b.id WHERE a.r <= 20 AND b.r <= 20 GROUP BY 1""",
)
def truncated_dimensions(t: Tables) -> DataFrame:
    w = lambda s: Window.partitionBy("query_id").orderBy(F.desc(s), "id")
    rows = scored(t).withColumn("short", F.round(vec.cosine(F.slice("embedding", 1, 32), F.slice("query", 1, 32)), 9))
    rows = rows.withColumn("r1", F.row_number().over(w("score"))).withColumn("r2", F.row_number().over(w("short")))
    return rows.where("r1 <= 20 and r2 <= 20").groupBy("query_id").agg(F.count("*").alias("shared"))


@query("R37 U6", f"WITH {QUERIES} SELECT id, round(max(round(list_cosine_similarity(v, q), 9)), 6) AS best FROM q, v GROUP BY 1")
def merged_by_best_score(t: Tables) -> DataFrame:
    return scored(t).groupBy("id").agg(F.round(F.max("score"), 6).alias("best"))


@query(
    "J14 X23",
    """WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings)
    SELECT a.vec_id AS a, b.vec_id AS b, CAST(len(list_filter(list_zip(a.b, b.b), lambda p: p[1] <> p[2])) AS INT) AS distance FROM s a JOIN s b ON a.vec_id < b.vec_id AND len(list_filter(list_zip(a.b, b.b), lambda p: p[1] <> p[2])) <= 9""",
)
def near_dup_hamming(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", vec.sign_bits(F.col("embedding")).alias("bits"))
    return vec.near_signatures(rows, "vec_id", "bits", 9)


@query("X22 X23", "SELECT vec_id, array_to_string(list_transform(v, lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), '') AS bits FROM (SELECT vec_id, v, list_sum(v) / len(v) AS m FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))")
def mean_bit_hashes(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", vec.mean_bits(F.col("embedding")).alias("bits"))


@query(
    "X47",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity * 8 AS INT) AS across, CAST(10 + l_linenumber * 20 AS INT) AS down FROM lineitem),
    n AS (SELECT *, across > 0 AND down >= 1.5 * across AS turned FROM s), w AS (SELECT *, CAST(ceil(48.0 * CASE WHEN turned THEN down / across ELSE across / down END) AS INT) AS need FROM n)
    SELECT l_orderkey, l_linenumber, l_partkey, across, down, turned, need, CASE WHEN need <= 320 THEN 320 WHEN need <= 640 THEN 640 WHEN need <= 960 THEN 960 ELSE CAST(floor(48.0 * across / down) AS INT) END AS width FROM w""",
)
def line_strips(t: Tables) -> DataFrame:
    """Lines as places on a page: as wide as eight times the quantity, higher with the line's number."""
    w, h = F.floor(F.col("l_quantity") * 8).cast("double"), (10 + F.col("l_linenumber") * 20).cast("double")
    corners = F.array(F.lit(5.0), F.lit(7.0), 5 + w, F.lit(7.0), 5 + w, 7 + h, F.lit(5.0), 7 + h)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", pictures.strip(corners).alias("s")).select("l_orderkey", "l_linenumber", "l_partkey", "s.*")


def _pictures(t: Tables) -> DataFrame:
    """Each vector of 64 as a grey picture of eight rows."""
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x * 64 + 128).cast("int"))))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(grey, i * 8 + 1, F.lit(8)))
    return t.embeddings.select("vec_id", rows.alias("pixels"))


@query("X47")
def resized_pictures(t: Tables) -> DataFrame:
    small = _pictures(t).select("vec_id", F.flatten(pictures.resized(F.col("pixels"), 8, 8, 4)).alias("p"))
    return small.select("vec_id", F.array_join(F.transform("p", lambda x: F.format_number(x, 4)), " ").alias("pixels"))


@query("X47")
def places_of_lines(t: Tables) -> DataFrame:
    """Lines in vectors as maps of chances."""
    chance = _pictures(t).select("vec_id", F.transform("pixels", lambda r: F.transform(r, lambda x: x / 255.0)).alias("map"))
    return pictures.line_places(chance, "vec_id", "map", 0.5, 0.5, 2.0).select("vec_id", "place", F.array_join(F.transform("corners", lambda x: F.round(x, 4).cast("string")), " ").alias("corners"), "score")
