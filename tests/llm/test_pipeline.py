"""The pipeline's stages: columns, effects, and odd tables."""

import corpus_pipeline as cp
import pytest
from plain import components, leaks
from pyspark.sql import functions as F

from loamdex.llm.queries import QUERIES


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), {}
    out["start"] = docs
    for name, stage in cp.STAGES:
        place = f"file://{tmp_path_factory.mktemp(name)}/rows"
        stage(spark, docs, small).write.parquet(place)
        out[name] = docs = spark.read.parquet(place)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns_and_take_effect(stages, small, spark):
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "shards"]
    for name in ("language", "near_duplicates", "decontamination", "mixture"):
        assert stages[name].columns == stages["start"].columns
    before = texts(stages["language"])
    root, _ = components(before, 5)
    assert set(texts(stages["near_duplicates"])) == {i for i, r in root.items() if i == r}
    before = texts(stages["near_duplicates"])
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    assert set(texts(stages["decontamination"])) == set(before) - {d for d, _ in leaks(before, items)}
    assert set(texts(stages["mixture"])) <= set(texts(stages["decontamination"]))
    assert stages["shards"].count() == stages["mixture"].count()


def test_an_id_with_two_texts_loses_none(spark, small):
    """Every order of rows gives the same rows; of an id's two texts the one that is a leak goes and the other stays."""
    leak = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    prose = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").where("lang = 'en' and length(text) between 800 and 3000").orderBy("doc_id").limit(3).collect()]
    rows = [(1, leak, "en", "a", 1), (1, prose[0], "en", "a", 1), (1, prose[0], "en", "b", 1), (None, prose[1], "en", "a", 1), (None, prose[1], "en", "a", 1), (2, prose[0] + " end", "en", "a", 1), (None, leak, "en", "a", 2), (3, "12 34 !!", "en", "a", 3), (3, prose[2], "en", "a", 3)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long")
        # the last rows would all be of one language; a model needs the others, too
        docs = docs.unionByName(spark.read.parquet(f"{small}/documents.parquet").where("doc_id >= 20").select(docs.columns))
        for name, stage in cp.STAGES[:3]:
            docs = stage(spark, docs, small)
        got = sorted(((r.doc_id or 0, r.text, r.source) for r in docs.where("doc_id is null or doc_id < 20").collect()))
        assert got == sorted([(1, prose[0], "a"), (0, prose[1], "a"), (3, prose[2], "a")])


def test_run_gives_the_same_rows(stages, spark, small):
    assert sorted(map(tuple, cp.run(spark, small).collect())) == sorted(map(tuple, stages["shards"].collect()))


def test_odd_documents(spark, small):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "the thing is that", "en", "a", 5), (3, "the thing is that", "en", "a", 5), (3, "the thing is that", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("size", F.lit(1))
    for table in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            table = stage(spark, table, small)
        table.collect()


def test_every_query_runs_on_the_smallest_tables(spark, small):
    for name, run in QUERIES.items():
        assert run(spark, small).count() > 0, name
