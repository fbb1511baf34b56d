"""Readers and writers, over files that the queries write in the shared folder or pack in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.operators import inverted
from loamdex.plans.registry import Tables, query
from loamdex.sources import files
from loamdex.streaming.jobs import folder


@query("S11", "SELECT conv_id || '.docx' AS path, 0 AS page, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def word_files(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.regexp_replace("text", r"[\r\n]", " ").alias("text"))
    pages = files.pages_of(files.packed_docx(rows, "conv_id", "turn", "text"))
    lines = F.split("text", "\n")
    return pages.select("path", "page", F.size(lines).cast("long").alias("turns"), (F.length("text") - F.size(lines) + 1).cast("long").alias("chars"))


@query("S18 K7 X53", "SELECT 'b' || item_id AS id, length(text) AS chars, 2 AS top_grade FROM benchmark")
def json_cases(t: Tables) -> DataFrame:
    cases = t.benchmark.select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.lit("exact").alias("slice"), F.col("text").alias("query"), F.lit("en").alias("lang"), F.create_map(F.col("item_id").cast("string"), F.lit(2), F.lit("other"), F.lit(1)).alias("relevant"), F.lit(False).alias("none")
    )
    place = folder(t.spark)
    cases.write.json(place)
    return files.read_cases(t.spark, place).select("id", F.length("query").cast("long").alias("chars"), F.array_max(F.map_values("relevant")).alias("top_grade"))


@query("S18 K7", "SELECT r_regionkey, r_name FROM region")
def tab_separated(t: Tables) -> DataFrame:
    place = folder(t.spark)
    t.region.select("r_regionkey", "r_name").write.option("sep", "\t").option("header", "true").csv(place)
    return files.read_truth(t.spark, place, "r_regionkey int, r_name string")


@query("K7", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def report_files(t: Tables) -> DataFrame:
    report = t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n"))
    places = files.write_report(report, folder(t.spark))
    return t.spark.read.schema("n_regionkey int, n long").json(places["json"])


@query("K7", "SELECT '| n_regionkey | n |' AS line UNION ALL SELECT '|-|-|' UNION ALL SELECT '| ' || n_regionkey || ' | ' || count(*) || ' |' FROM nation GROUP BY n_regionkey")
def markdown_report(t: Tables) -> DataFrame:
    report = t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return t.spark.read.text(files.write_report(report, folder(t.spark))["md"]).select(F.col("value").alias("line"))


@query("S12", "SELECT n_regionkey, 'Sheet: nations' || chr(10) || string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1")
def sheet_texts(t: Tables) -> DataFrame:
    from loamdex.functions.text import sheet_text

    rows = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.lit(" "), F.col("n_name")).alias("cells")))).alias("s"))
    return rows.select("n_regionkey", sheet_text(F.lit("nations"), F.transform("s", lambda x: x["cells"])).alias("text"))


@query("S10", "SELECT n_nationkey || '.pdf' AS path, n_name || chr(10) || '(' || n_regionkey || ')' AS text FROM nation")
def pdf_files(t: Tables) -> DataFrame:
    rows = t.nation.select("n_nationkey", F.array("n_name", F.concat(F.lit("("), F.col("n_regionkey").cast("string"), F.lit(")"))).alias("lines"))
    return files.pages_of(files.packed_pdf(rows, "n_nationkey", "lines")).select("path", "text")


@query("T8", r"SELECT count(*) AS postings, CAST(sum(tf) AS BIGINT) AS words FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS term FROM documents) GROUP BY 1, 2)")
def keyword_index_fill(t: Tables) -> DataFrame:
    """A new index of all documents, and what it holds."""
    own = inverted.Index(t.spark, folder(t.spark)).add(t.documents, "doc_id", "text")
    return own.postings().agg(F.count("*").alias("postings"), F.sum("tf").alias("words"))
