"""One query per operator of this folder, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm.decontaminate import leaks
from loamdex.llm.languages import of_pages, trained
from loamdex.llm.main_text import main_texts
from loamdex.llm.mixture import mixture
from loamdex.llm.near_duplicates import near_duplicates
from loamdex.llm.neighbours import nearest
from loamdex.llm.pseudonyms import pseudonymised
from loamdex.llm.shards import sharded
from loamdex.llm.token_counts import load_pieces, token_counts
from loamdex.llm.token_files import read_tokens, write_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=5, percent=80)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), width=2, end_id=2)
    return read_tokens(shards).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0, k=20)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), shards=40).drop("region", "rack")


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's; where it sets none, one that is good for tests alone."""
    return pseudonymised(table(spark, sf_dir, "documents"), key=spark.conf.get("spark.loamdex.pseudonyms.key", "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, with its markup's language, address suffix, host and domain; trigrams of labelled documents."""
    model = trained(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text", label_col="lang")
    return of_pages(table(spark, sf_dir, "pages"), model=model)


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixture(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", F.concat_ws(",", F.col("shards").cast("array<string>")).alias("shards"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts under the unigram reading of a public vocabulary.

    No unigram vocabulary is installed and none may be trained, so the pieces and scores are those of a BPE model, whose scores are
    merge ranks: counts equal the tokenizers library's unigram model over these pieces, and not the BPE tokenizer that ships them.
    """
    pieces, _ = load_pieces(vocabulary("piece_bpe_32k.model"))
    return token_counts(table(spark, sf_dir, "documents"), pieces)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_files": op2_token_files,
    "op3_nearest": op3_nearest,
    "op4_shards": op4_shards,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_main_text": op6_main_text,
    "op7_language": op7_language,
    "op8_mixture": op8_mixture,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_token_counts": op10_token_counts,
}

#: None of the ten can be written in SQL that DuckDB runs: they rest on Spark's hashes, checksums, vocabularies or search.
ORACLE_SQL: dict[str, str] = {}
