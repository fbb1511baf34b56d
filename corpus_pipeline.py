"""The corpus pipeline over the table documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and gives the columns of
documents, but for the last, which gives each row's shard.  ``run`` chains them and writes each stage's rows in the
shared folder, so a lost executor costs one stage.

Decisions hold for a document: an id together with a text.  An id that stands on rows with different texts is several
documents, of which one may go and another stay; a missing id is an id like any other.  Rows that repeat a document
share its fate until near_duplicates, which leaves one row of each (the smallest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm import decontaminate, languages, mixture, near_duplicates, shards
from loamdex.llm.work import removed, shared_dir, written

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express trigram models, registers or hash trees; tests hold the stages against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of documents that are not among ``gone``, columns doc_id and text_md5."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_md5").alias("gone_md5")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & F.md5(F.col("text").cast("string")).eqNullSafe(F.col("gone_md5"))
    return docs.select(*DOCUMENTS).join(gone, same, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language identification rejects.

    The column lang labels the sample that the trigrams are fitted on, so it is no evidence; the source is the host.
    A document on several sources stays if it is accepted on one.
    """
    found = languages.identified(docs, host=F.col("source"), label_col="lang")
    return _without(docs, found.groupBy("doc_id", "text_md5").agg(F.max("accepted").alias("any")).where("not any"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, and one row of each document.

    Documents of one id with different texts are kept together or go together.  Of equal texts without id one row stays.
    """
    found = near_duplicates.near_duplicates(docs, words=5, percent=80)
    # rows that repeat a document: the smallest stays
    place = shared_dir(spark)
    again = found.where("kept").groupBy("doc_id", "text_md5").agg(F.count("*").alias("rows")).where("rows > 1")
    again = written(again.select("doc_id", "text_md5"), "again", place)
    once = _without(docs, found.where("not kept").select("doc_id", "text_md5").union(again))
    md5 = F.md5(F.col("text").cast("string"))
    rows = docs.join(again.withColumnsRenamed({"doc_id": "key", "text_md5": "md5"}), F.col("doc_id").eqNullSafe(F.col("key")) & md5.eqNullSafe(F.col("md5")))
    rows = rows.groupBy("key", "md5").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("row"))
    return once.unionByName(rows.select(F.col("key").alias("doc_id"), *[F.col(f"row.{c}") for c in DOCUMENTS[1:]]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.leaks(docs, items, words=5, percent=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as their source's target asks for."""
    return mixture.mixed(docs.select(*DOCUMENTS)).select(*DOCUMENTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot."""
    return shards.sharded(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicate), ("decontamination", decontamination), ("mixture", mix), ("shards", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs, places = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        places.append(shared_dir(spark))
        docs = written(stage(spark, docs, sf_dir), name, places[-1])
        if len(places) > 1:
            removed(spark, places[-2])
    return docs
