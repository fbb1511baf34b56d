"""Token files: round trips, the perfect hash, and odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamdex.llm import token_files as tf
from loamdex.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
ODD = [None, "", " ", "  ", "a  b", "a \n b", " lead", "trail ", "x  y", "it's 'll  \t\r\n z", "<|endoftext|> hi", "日本 語", "a　 b", "é é", "1 2 3", "...  ...", "a.\n\nB, c", "l'été n'est", "×÷ ×.÷", "word" * 5000, "\U0001f600 \U0001f601."]


def encoded(texts, special=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = not special
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def test_pieces_give_the_same_ids_as_whole_texts(small):
    import duckdb
    import pyarrow as pa

    texts = ODD + [r[0] for r in duckdb.sql(f"select text from '{small}/documents.parquet'").fetchall()]
    encoder = tf.Encoder(PATH, 2, 2)
    for part in (texts, texts[::-1]):  # also with all pieces known
        ids, n = encoder.encode(pa.array(part, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == encoded(part)


def test_special_tokens_count_where_they_are_asked_for():
    import pyarrow as pa

    part = ["a <|endoftext|> b", "plain text", None, "<|endoftext|>", "x<|endoftext|>y <|endoftext|", "plain again"]
    for special in (False, True):
        ids, n = tf.Encoder(PATH, 2, 2, special).encode(pa.array(part, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == encoded(part, special)
        assert (50256 in ids) == special


def test_ids_that_fill_several_shards(spark):
    """Many texts of one id and many without: copies are numbered through, starts go on, the largest id is no missing one."""
    rows = [(5, f"text {i} " * (i % 7)) for i in range(300)] + [(None, f"none {i}") for i in range(300)] + [(i, "x") for i in range(5)] + [(7, None), (2**63 - 1, "last"), (-(2**63), "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shards = tf.write_tokens(docs, PATH, shard_bytes=400)
    got = tf.read_tokens(shards).orderBy("start").collect()
    assert shards.where("first_key = 5 and last_key = 5").count() > 1 and shards.where("first_none").count() > 1
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows if r[0] is not None)) + [None] * 300
    assert [r.copy for r in got if r.doc_id == 5] == list(range(300)) == [r.copy for r in got if r.doc_id is None]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    for key in (5, None):
        want = sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in encoded([t for i, t in rows if i == key]))
        assert sorted(r.ids_crc32 for r in got if r.doc_id == key) == want
    asked = [*range(-2, 9), 2**63 - 1, -(2**63)]
    found = {r.doc_id: list(r.ids) for r in tf.lookup(shards, spark.createDataFrame([(k,) for k in asked], "doc_id long")).collect()}
    assert found.keys() == {0, 1, 2, 3, 4, 5, 7, 2**63 - 1, -(2**63)} and found[2**63 - 1] == encoded(["last"])[0] and found[7] == [2]
    assert zlib.crc32(np.array(found[5], "<u4").tobytes()) == next(r.ids_crc32 for r in got if r.doc_id == 5 and r.copy == 0)


def test_a_cold_lookup_reads_little(tmp_path):
    w = tf.ShardWriter(f"file://{tmp_path}/a.tok", 2)
    for k in range(50_000):
        w.add(k, 0, np.full(3, k % 1000, "<u2").tobytes())
    w.close()
    shard = tf.Shard(f"file://{tmp_path}/a.tok")
    reads, file = [], shard.file

    class Counted:
        def read_at(self, n, at):
            reads.append(n)
            return file.read_at(n, at)

    shard.file, asked = Counted(), np.zeros(100, tf._KEY)
    asked["key"] = np.arange(100) * 431
    start, n = shard.find(asked)
    assert (start == asked["key"] * 3).all() and (n == 3).all()
    assert sum(reads) < 100 * 250 and not shard.loaded


def test_files_round_trip(spark, small):
    docs = spark.createDataFrame([(i * 7 % 23, t, "clash") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    docs = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.limit(1).selectExpr("cast(null as long) doc_id", "'none' text", "ids"))
    shards = tf.write_tokens(docs, PATH)
    got = tf.read_tokens(shards).orderBy("start").collect()
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    rows = [x[:4] for x in sorted(((r.doc_id is None, r.doc_id, r.text is not None, r.text or "", r.h) for r in hashed), key=lambda x: (x[0], x[1] or 0, x[4], x[2], x[3]))]
    ids, at = encoded([r[3] for r in rows]), 0
    for r, own, (_, key, _, _) in zip(got, ids, rows, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    wanted = spark.createDataFrame([(3,), (9999,), (None,)], "doc_id long")
    found = tf.lookup(shards, wanted).collect()
    assert [(r.doc_id, list(r.ids)) for r in found] == [(3, next(o for o, x in zip(ids, rows) if x[1] == 3))]


def test_empty_table(spark):
    assert tf.read_tokens(tf.write_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.zeros(n, tf._KEY)
    keys["key"], keys["copy"] = np.arange(n) // 2 * 977 - 12345, np.arange(n) % 2
    index = tf.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(n))
    assert index.blocks.nbytes * 8 <= 4 * n + 512 * 20


def test_absent_keys_are_told(tmp_path):
    w = tf.ShardWriter(f"file://{tmp_path}/a.tok", 4)
    for k in range(2000):
        w.add(k * 3, 0, np.arange(k % 5, dtype="<u4").tobytes())
    w.close()
    shard, asked = tf.Shard(f"file://{tmp_path}/a.tok"), np.zeros(2000, tf._KEY)
    asked["key"] = np.arange(2000) * 3 + 1
    assert (shard.find(asked)[0] == -1).all()
    assert [p.name for p in tmp_path.iterdir()] == ["a.tok"]
