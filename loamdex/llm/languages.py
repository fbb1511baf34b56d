"""Language identification by Bayesian evidence fusion.

Evidence on a text's language: its byte trigrams under each language; the language its markup declares; the suffix of
its address; and a prior of its host.  All meet in one posterior,

    P(language) ~ P(language | host) * P(trigrams | language) * P(declared | language) * P(suffix | language).

The host prior is smoothed hierarchically: a host's counts lean on its domain's, these on the counts of all rows, with
KAPPA rows' weight at each step.  Counts come from grouped aggregation over all rows (the best language by text alone)
and leave out the row itself.  How declarations and suffixes go with languages is counted the same way.

One more class, OTHER, stands for text of no language known: uniform over the trigrams.  A row is accepted unless that
class wins or the text has no letters.

Trigrams: ASCII letters count as lower case, all other ASCII as one blank, trigrams without letters don't count.
Neighbouring trigrams overlap, so their joint evidence is tempered by one third.

The trigram model is fitted on at most ``sample`` labelled rows a language (different ones, with the smallest hashes of
id and text).  The label is no evidence: where a table's declarations are the labels, leave ``declared`` out.

Nulls and odd cases: a null, empty or letter-free text is not accepted and its language is null; a null declaration,
suffix or host says nothing; whole texts are read; ties go to the earlier language; repeated rows give equal rows; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.main_text import main_texts
from loamdex.llm.words import slices, texts, tidy
from loamdex.llm.work import removed, shared_dir, written

LANGUAGES = ("de", "en", "es", "fr")
OTHER = "other"
SAMPLE, KAPPA, SMOOTH, TEMPER = 500, 10.0, 0.5, 1 / 3
#: Prior of OTHER.
STRANGE = 1e-3
BITS = 16

_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[:128] = 32
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all trigrams (BITS bits) and the row of each; a blank stands before and after each row."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    padded = np.full(len(data) + 2 * rows, 32, np.uint32)
    place = np.arange(len(data)) + np.repeat(2 * np.arange(rows) + 1, sizes)
    padded[place] = _CLASS[data]
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    row = np.repeat(np.arange(rows), sizes + 2)
    whole = (row[:-2] == row[2:]) & ((b != 32) | ((a != 32) & (c != 32)))
    number = ((a << 16 | b << 8 | c) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return number[whole], row[:-2][whole]


def fit(counts: dict[str, np.ndarray], languages: Sequence[str]) -> np.ndarray:
    """Log probabilities of trigrams (rows) under each language and OTHER (columns)."""
    out = np.full((2**BITS, len(languages) + 1), -BITS * np.log(2.0), np.float32)
    for i, name in enumerate(languages):
        n = counts.get(name, np.zeros(2**BITS)) + SMOOTH
        out[:, i] = np.log(n / n.sum())
    return out


def _count_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, text) -> a language's trigram counts within the task."""
    found: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole, 1, 1 << 19):
            number, row = trigrams(*texts(batch.column(1)))
            names = np.array(batch.column(0).to_pylist(), object)
            for name in set(names):
                own = number[(names == name)[row]]
                found[name] = found.get(name, 0) + np.bincount(own, minlength=2**BITS)
    for name, n in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n.astype("<i8").tobytes()], pa.binary())], names=["language", "counts"])


def _add(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<i8") for x in rows.column("counts"))
    return pa.table({"language": rows.column("language")[:1], "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def trained(docs: DataFrame, *, id_col: str, text_col: str, label_col: str, languages: Sequence[str] = LANGUAGES, sample: int = SAMPLE) -> np.ndarray:
    """The trigram model, from at most ``sample`` labelled rows a language."""
    label = F.substring_index(F.lower(F.col(label_col)), "-", 1)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), label.alias("language"), text.alias("text"), F.xxhash64(F.col(id_col).cast("long"), text).alias("h"))
    rows = rows.where(F.col("language").isin(*languages) & F.col("id").isNotNull())
    # a hash bound that a little more than the sample is below; then the smallest hashes of these few
    many = {r.language: r.n for r in rows.groupBy("language").agg(F.count("*").alias("n")).collect()}
    bound = F.coalesce(*[F.when(F.col("language") == name, F.lit(min(1.0, (1.5 * sample + 50) / n))) for name, n in sorted(many.items())], F.lit(0.0))
    near = rows.where(F.shiftrightunsigned("h", 11) * F.lit(2.0**-53) < bound).select("id", "language", "h").distinct()
    first = Window.partitionBy("language").orderBy("h", "id")
    chosen = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).drop("n")
    own = rows.join(F.broadcast(chosen), ["id", "language", "h"]).dropDuplicates(["id", "language", "h"]).select("language", "text")
    own = own.repartition(8)  # a bounded sample
    counts = own.mapInArrow(tidy(_count_sample), "language string, counts binary").groupBy("language").applyInArrow(_add, "language string, counts binary")
    return fit({r.language: np.frombuffer(r.counts, "<i8") for r in counts.collect()}, languages)


def _likelihood(model, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for whole in batches:
            for batch in slices(whole, 1, 1 << 19):
                number, row = trigrams(*texts(batch.column(1)))
                out = np.zeros((batch.num_rows, classes))
                n = np.bincount(row, minlength=batch.num_rows)
                for c in range(classes):
                    out[:, c] = np.bincount(row, table[number, c], minlength=batch.num_rows)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, classes), pa.int32()), pa.array(np.round(out.ravel() * TEMPER, 6)))
                yield pa.RecordBatch.from_arrays([batch.column(0), values, pa.array(n, pa.int64()), *batch.columns[2:]], names=["id", "likelihood", "n", *batch.schema.names[2:]])

    return run


def identified(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    domain: Column | None = None,
    label_col: str | None = None,
    model: np.ndarray | None = None,
    languages: Sequence[str] = LANGUAGES,
    sample: int = SAMPLE,
    keep: str | None = None,
) -> DataFrame:
    """One row per input row: id, language (null if not accepted), confidence (of the best class), by_text, accepted, text_md5.

    ``declared``, ``suffix``, ``host`` and ``domain`` (the host's parent) are columns of ``docs``; what is left out says nothing.  ``keep`` is a
    column that is handed on.  Either a ``model`` or the ``label_col`` to fit one on is needed.
    """
    spark = docs.sparkSession
    if model is None:
        model = trained(docs, id_col=id_col, text_col=text_col, label_col=label_col, languages=languages, sample=sample)
    names = [*languages, OTHER]
    k = len(names)
    sent = spark.sparkContext.broadcast(model)
    say = lambda c, name: (c if c is not None else F.lit(None)).cast("string").alias(name)
    clues = [say(F.substring_index(F.lower(declared), "-", 1) if declared is not None else None, "declared"), say(suffix, "suffix"), say(host, "host"), say(domain, "domain"), F.md5(F.col(text_col).cast("string")).alias("text_md5"), say(F.col(keep) if keep else None, "kept_column")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *clues)
    rows = rows.mapInArrow(tidy(_likelihood(sent, k)), "id long, likelihood array<double>, n long, declared string, suffix string, host string, domain string, text_md5 string, kept_column string")
    best = F.expr("array_position(likelihood, array_max(likelihood)) - 1").cast("int")
    place = shared_dir(spark)
    rows = written(rows.withColumn("first", F.when(F.col("n") > 0, best)), "likelihoods", place)
    # -- counts by the text alone; OTHER doesn't count as a language of a host
    tally = [F.count(F.when(F.col("first") == i, 1)).alias(f"n{i}") for i in range(k)]
    every = rows.agg(*tally).first()
    total = sum(every[: k - 1])
    overall = [(every[i] + 1) / (total + k - 1) * (1 - STRANGE) for i in range(k - 1)] + [STRANGE]
    given = {"host": host, "domain": domain, "declared": declared, "suffix": suffix}
    for level in given:
        if given[level] is None:
            rows = rows.withColumn(f"by_{level}", F.lit(None).cast("array<long>"))
            continue
        known = rows.where(F.col(level).isNotNull()).groupBy(level).agg(F.array(*tally).alias(f"by_{level}"))
        if level == "domain":  # a domain's counts hold all its hosts
            known = rows.where(F.col(level).isNotNull()).groupBy(level, "host").agg(*tally).groupBy(level).agg(F.array(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]).alias(f"by_{level}"))
        # rows that the level says nothing of meet no key, and not all in one task
        key = F.coalesce(F.col(level), F.concat(F.lit("\0"), F.pmod(F.xxhash64("text_md5", "id"), F.lit(1009)).cast("string")))
        rows = rows.withColumn("key", key).join(known.withColumnRenamed(level, "key"), "key", "left").drop("key")
    own = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(F.col("first") == i, 1.0).otherwise(0.0))

    def less_own(level: str) -> Column:
        return F.when(F.col(level).isNotNull(), F.zip_with(f"by_{level}", own, lambda n, o: F.greatest(n - o, F.lit(0.0))))

    def leaning(level: str, prior: Column) -> Column:
        """The prior drawn towards a level's counts (of languages, not of OTHER)."""
        counts = less_own(level)
        of_known = F.aggregate(F.slice(counts, 1, k - 1), F.lit(0.0), lambda t, n: t + n)
        drawn = F.zip_with(F.slice(counts, 1, k - 1), F.slice(prior, 1, k - 1), lambda n, p: (n + KAPPA * p) / (of_known + KAPPA) * (1 - STRANGE))
        return F.when(F.col(level).isNotNull(), F.concat(drawn, F.array(F.lit(STRANGE)))).otherwise(prior)

    rows = rows.withColumn("prior", F.array(*[F.lit(float(p)) for p in overall]))
    rows = rows.withColumn("prior", leaning("domain", F.col("prior"))).withColumn("prior", leaning("host", F.col("prior")))
    everything = F.array(*[F.lit(float(n)) for n in every])

    def clue(level: str) -> Column:
        """log P(clue | language), smoothed; a clue says nothing on OTHER beyond its share of all rows."""
        counts = less_own(level)
        share = F.aggregate(counts, F.lit(0.0), lambda t, n: t + n) / float(max(1, sum(every)))
        each = F.zip_with(counts, F.zip_with(everything, own, lambda n, o: n - o), lambda n, all_: F.ln((n + KAPPA * share + 1e-3) / (all_ + KAPPA)))
        each = F.concat(F.slice(each, 1, k - 1), F.array(F.ln(share + 1e-3 / KAPPA)))
        return F.when(F.col(level).isNotNull(), each).otherwise(F.array(*[F.lit(0.0)] * k))

    joint = F.transform("prior", lambda p: F.ln(p))
    for part in (F.col("likelihood"), clue("declared"), clue("suffix")):
        joint = F.zip_with(joint, part, lambda a, b: a + b)
    rows = rows.withColumn("joint", joint).withColumn("top", F.array_max("joint"))
    rows = rows.withColumn("class", F.expr("array_position(joint, top)").cast("int"))
    rows = rows.withColumn("confidence", F.round(1 / F.aggregate("joint", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("top"))), 6))
    accepted = (F.col("n") > 0) & (F.col("class") < k)
    literal = F.array(*[F.lit(x) for x in names])
    out = rows.select(
        F.col("id").alias(id_col),
        F.when(accepted, F.element_at(literal, F.col("class"))).alias("language"),
        "confidence",
        F.when(F.col("first").isNotNull(), F.element_at(literal, F.col("first") + 1)).alias("by_text"),
        accepted.alias("accepted"),
        "text_md5",
        *([F.col("kept_column").alias(keep)] if keep else []),
    )
    result = written(out, "languages")
    removed(spark, place)
    return result


def address_clues(url: Column) -> tuple[Column, Column, Column]:
    """(suffix, host, domain) of an address: its top-level name, its host, and the host without its first name."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    names = F.split(host, r"\.")
    return F.when(F.size(names) > 1, F.element_at(names, -1)), host, F.when(F.size(names) > 2, F.regexp_replace(host, r"^[^.]+\.", "")).otherwise(host)


def declared_language(html: Column) -> Column:
    """What a page's html element declares, however far in it stands and however long it is."""
    start = F.regexp_extract(html, r"(?is)<html(?=[\s/>])([^>]*)", 1)
    found = F.regexp_extract(start, r"(?is)[\s\"'/]lang\s*+=\s*+[\"']?([A-Za-z]{2,3})(?![A-Za-z])", 1)
    return F.when(found != "", F.lower(found))


def of_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """``identified`` over the main texts of pages, with their markup's language, address suffix, host and domain as evidence; one row
    per page: id, url, and what ``identified`` gives."""
    texts = main_texts(pages, id_col=id_col, url_col=url_col, html_col=html_col, declared=declared_language(F.col(html_col)))
    suffix, host, domain = address_clues(F.col(url_col))
    return identified(texts, id_col=id_col, text_col="text", declared=F.col("declared"), suffix=suffix, host=host, domain=domain, keep=url_col, **options)
