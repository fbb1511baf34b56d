"""A keyword index that lives in a folder: add, replace, remove, sweep, and the searches that read it.

An index is a list of segments.  Each holds the postings of the texts added with it (term, id, tf, length), sorted by
term, so a search reads the row groups of its terms alone; its terms with their document frequencies; and a record of
every id that it added or took out.  The latest record of an id decides: what older segments hold of it is dead.  Counts
of live texts and words stand in the manifest, so a search aggregates nothing but its own hits.

Adding an id again replaces it and keeps its place among equal scores; removing it and adding it later does not.  A
segment is never changed, and a change counts once its manifest is written, so a job that fails midway leaves the index
as it was.  ``sweep`` writes what is live as one segment; it runs of itself when SWEEP_AT texts are dead and they are
half as many as the live ones.

A frequent term's postings are spread over SPREAD parts by id, so no term is one task.  Nulls: rows without id are left
out; a null text has no words.  An id may stand once in what is added at once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loamdex.operators import lexical as lex

#: Fixed value: dead texts from which a sweep is due.
SWEEP_AT = 256
SPREAD = 64
#: What stands between words.
NO_WORD = r"[^\p{L}\p{M}\p{N}]+"
_IDS = "id long, length int, live boolean, first int, segment int"
_POSTINGS = "term string, id long, tf int, length int, segment int"
#: Bytes of text that are cut at once.
PIECE = 4 << 20


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lower-cased text) -> (term, id, tf, length); a text without words gives the null term.

    Whole columns at a time: words are numbered by a dictionary, and equal pairs of text and number counted by sorting.
    """
    for whole in batches:
        sizes, at = np.cumsum(pc.binary_length(whole.column(1)).to_numpy(zero_copy_only=False)), 0
        while at < whole.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE, "right")))
            batch = whole.slice(at, end - at)
            at = end
            words = pc.split_pattern_regex(batch.column(1), NO_WORD)
            begins = words.offsets.to_numpy()
            named = words.values.slice(int(begins[0]), int(begins[-1] - begins[0])).dictionary_encode()
            row, code = np.repeat(np.arange(batch.num_rows), np.diff(begins)), named.indices.to_numpy().astype(np.int64)
            some = pc.binary_length(named.dictionary).to_numpy()[code] > 0
            row, code, most = row[some], code[some], max(1, len(named.dictionary))
            length = np.bincount(row, minlength=batch.num_rows)
            pairs, tf = np.unique(row * most + code, return_counts=True)
            none = np.flatnonzero(length == 0)
            of = np.concatenate([pairs // most, none])
            term = pa.concat_arrays([named.dictionary.take(pa.array(pairs % most)), pa.nulls(len(none), pa.string())])
            counts = np.concatenate([tf, np.zeros(len(none), np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([term, batch.column(0).take(pa.array(of)), pa.array(counts), pa.array(length[of].astype(np.int32))], names=["term", "id", "tf", "length"])


class Index:
    """An index in ``place``, a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, place: str) -> None:
        self.spark, self.place = spark, place.rstrip("/")
        self.segments: list[int] = []
        self.number = self.live = self.words = self.dead = 0

    @classmethod
    def opened(cls, spark: SparkSession, place: str) -> Index:
        """The index that a folder holds."""
        self = cls(spark, place)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/manifest")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []
        whole = [n for n in names if n.endswith(".json")]
        if whole:
            state = json.loads(spark.read.text(f"{self.place}/manifest/{whole[-1]}").first()[0])
            self.segments, self.number, self.live, self.words, self.dead = (state[k] for k in ("segments", "number", "live", "words", "dead"))
        return self

    def _commit(self, segments: list[int], live: int, words: int, dead: int) -> None:
        """Write a manifest; it appears under its name only when it is whole."""
        state = {"segments": segments, "number": self.number, "live": live, "words": words, "dead": dead}
        hadoop, name = self.spark._jvm.org.apache.hadoop.fs, f"{self.place}/manifest/{self.number:08d}-{uuid.uuid4().hex[:8]}"
        path = hadoop.Path(f"{name}.tmp")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(path)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not files.rename(path, hadoop.Path(f"{name}.json")):
            raise OSError(f"{name}.json can't be written")
        self.segments, self.live, self.words, self.dead = segments, live, words, dead

    def _read(self, what: str, schema: str, segments: Sequence[int] | None = None) -> DataFrame:
        paths = [f"{self.place}/segment-{n:08d}/{what}" for n in (self.segments if segments is None else segments)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _latest(self) -> DataFrame:
        """Each id's latest record."""
        ids = self._read("ids", _IDS)
        if len(self.segments) < 2:
            return ids
        return ids.groupBy("id").agg(F.max_by(F.struct("length", "live", "first", "segment"), "segment").alias("r")).select("id", "r.*")

    def _counted(self) -> tuple[int, int]:
        n, words = self._latest().where("live").agg(F.count("*"), F.sum("length")).first()
        return n, words or 0

    # -- changes

    def add(self, docs: DataFrame, id_col: str, text_col: str) -> Index:
        """Index texts; ids that are there are replaced."""
        number = self.number = self.number + 1
        folder, old = f"{self.place}/segment-{number:08d}", self.live
        rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
        entries = rows.mapInArrow(_entries, "term string, id long, tf int, length int")
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        entries = entries.withColumn("segment", F.lit(number)).repartition(parts, "term", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("term", "id")
        entries.write.parquet(f"{folder}/postings")
        made = self._read("postings", _POSTINGS, [number])
        terms = made.where("term is not null").groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term")
        ids = made.groupBy("id").agg(F.first("length").alias("length"))
        if self.segments:
            known = self._latest().where("live").select(F.col("id").alias("k"), F.col("first").alias("f"))
            ids = ids.join(known, F.col("id") == F.col("k"), "left").select("id", "length", F.lit(True).alias("live"), F.coalesce("f", F.lit(number)).cast("int").alias("first"), F.lit(number).alias("segment"))
        else:
            ids = ids.select("id", "length", F.lit(True).alias("live"), F.lit(number).alias("first"), F.lit(number).alias("segment"))
        # what is added is counted as it is written
        seen = Observation()
        ids = ids.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"))
        with ThreadPoolExecutor(2) as pool:
            for job in [pool.submit(terms.write.parquet, f"{folder}/terms"), pool.submit(ids.write.parquet, f"{folder}/ids")]:
                job.result()
        return self._changed(number, old, seen.get["n"], seen.get["words"])

    def remove(self, ids: DataFrame, id_col: str) -> Index:
        """Take texts out; ids that are not there change nothing."""
        if not self.segments:
            return self
        number = self.number = self.number + 1
        folder, old = f"{self.place}/segment-{number:08d}", self.live
        gone = self._latest().where("live").join(ids.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
        gone.select("id", F.lit(0).alias("length"), F.lit(False).alias("live"), F.lit(number).alias("first"), F.lit(number).alias("segment")).write.parquet(f"{folder}/ids")
        self.spark.createDataFrame([], _POSTINGS).write.parquet(f"{folder}/postings")
        self.spark.createDataFrame([], "term string, df long").write.parquet(f"{folder}/terms")
        return self._changed(number, old, 0, 0)

    def _changed(self, number: int, old: int, added: int, words: int) -> Index:
        before, live = self.segments, added
        if before:
            self.segments = [*before, number]
            try:
                live, words = self._counted()
            finally:
                self.segments = before
        # what was live before and is no more in its old place: replaced or removed
        self._commit([*before, number], live, words, self.dead + old + added - live)
        return self.sweep() if self.dead >= SWEEP_AT and self.dead >= self.live / 2 else self

    def sweep(self) -> Index:
        """Write what is live as one segment, and delete the others."""
        if len(self.segments) < 2:
            return self
        old, number = self.segments, self.number + 1
        folder = f"{self.place}/segment-{number:08d}"
        self.number = number
        live = self._latest().where("live")
        live.select("id", "length", "live", "first", F.lit(number).alias("segment")).write.parquet(f"{folder}/ids")
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        kept = self._read("postings", _POSTINGS).join(live.select("id", "segment"), ["id", "segment"], "left_semi")
        kept = kept.select("term", "id", "tf", "length", F.lit(number).alias("segment")).repartition(parts, "term", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("term", "id")
        kept.write.parquet(f"{folder}/postings")
        self._read("postings", _POSTINGS, [number]).where("term is not null").groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.parquet(f"{folder}/terms")
        self._commit([number], self.live, self.words, 0)
        for n in old:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/segment-{n:08d}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self

    # -- searches

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """(term, id, tf, length) of live texts; of some terms, only their row groups are read."""
        rows = self._read("postings", _POSTINGS).where("term is not null")
        if terms is not None:
            rows = rows.where(F.col("term").isin(*terms) if terms else F.lit(False))
        if len(self.segments) > 1:
            newer = self._read("ids", _IDS, self.segments[1:]).groupBy("id").agg(F.max("segment").alias("newer"))
            rows = rows.join(newer, "id", "left").where("newer is null or newer <= segment")
        return rows.select("term", "id", "tf", "length")

    def terms(self) -> DataFrame:
        """(term, df, cf) of live texts."""
        return self.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def vocabulary(self) -> DataFrame:
        """Distinct terms of live texts."""
        if len(self.segments) == 1:
            return self._read("terms", "term string, df long").select("term")
        return self.postings().select("term").distinct()

    def first_added(self) -> DataFrame:
        """(id, first): what decides among equal scores, then the id."""
        return self._latest().where("live").select("id", "first")

    def expanded(self, query: Sequence[str]) -> DataFrame:
        """(i, term, weight) of each query word: itself if a text has it; else the terms that contain it; else near spellings and roots, at
        half weight.  However many terms stand for a word, they stay rows."""
        known = {r.term for r in self.postings(list(dict.fromkeys(query))).select("term").distinct().collect()}  # the query's own words
        rows = self.spark.createDataFrame([(i, w, 1.0) for i, w in enumerate(query) if w in known], "i int, term string, weight double")
        vocabulary = self.vocabulary()
        for i, word in enumerate(query):
            if word in known:
                continue
            found = vocabulary.where(F.contains(F.col("term"), F.lit(word)))
            if found.isEmpty():
                found = vocabulary.where(lex.near(F.col("term"), word) | F.col("term").isin(*lex.roots(word) or [word]))
            rows = rows.unionByName(found.select(F.lit(i).alias("i"), "term", F.lit(lex.NEAR_WEIGHT).alias("weight")))
        return rows

    def bm25(self, query: Sequence[str] | DataFrame) -> DataFrame:
        """(id, score) of texts with any of the words; a word given twice counts twice.

        ``query`` is words, or rows (i, term, weight) of ``expanded``: terms of one i count as one word with one document frequency.
        """
        if isinstance(query, DataFrame):
            groups, hits = query, self.postings()
        else:
            groups = self.spark.createDataFrame([(i, w, 1.0) for i, w in enumerate(query)], "i int, term string, weight double")
            hits = self.postings(list(dict.fromkeys(query)))
        per = hits.join(groups, "term").groupBy("i", "id").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"), F.first("weight").alias("weight"))
        df = per.groupBy("i").agg(F.count("*").alias("df"))  # a row a query word
        n, mean = F.lit(self.live), F.lit(self.words / max(1, self.live))
        idf = F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        part = F.col("weight") * idf * F.col("tf") * (lex.K1 + 1) / (F.col("tf") + lex.K1 * (1 - lex.B + lex.B * F.col("length") / mean))
        return per.join(F.broadcast(df), "i").groupBy("id").agg(F.sum(part).alias("score"))

    def best(self, query: Sequence[str] | DataFrame, limit: int = 300) -> DataFrame:
        """(id, score) of the best texts; ties to the one added first, then the smaller id."""
        scored = self.bm25(query).withColumn("score", F.round("score", 12))
        order = [F.desc("score"), F.asc("first"), F.asc("id")]
        return scored.join(self.first_added(), "id").orderBy(*order).limit(limit).select("id", "score")

    def candidates(self, words: Sequence[str], says: DataFrame, every: DataFrame, limit: int = 50, each: int = 20) -> DataFrame:
        """Ids that a search looks at: the best of all words, those that ``says`` (ids) holds, and the best of each word; all of ``every``
        (ids) if there is none."""
        lanes = [self.best(words, limit).select("id"), says.select("id").orderBy("id").limit(limit)]
        lanes += [self.best([w], each).select("id") for w in dict.fromkeys(words)]
        some = reduce(DataFrame.union, lanes).distinct()
        return every.select("id") if some.isEmpty() else some


_opened: dict[tuple, Index] = {}


def of_table(spark: SparkSession, path: str, id_col: str, text_col: str, place: str) -> Index:
    """The index of a Parquet table, made when first asked for and again when the table's files change; below ``place``."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    summary = files.getFileSystem(spark._jsc.hadoopConfiguration())
    status, size = summary.getFileStatus(files), summary.getContentSummary(files)
    key = (spark.sparkContext.applicationId, path, status.getModificationTime(), size.getLength(), size.getFileCount())
    if key not in _opened:
        _opened[key] = Index(spark, place).add(spark.read.parquet(path).select(id_col, text_col), id_col, text_col)
    return _opened[key]
