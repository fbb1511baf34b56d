"""Rules that name what went wrong or where something opens: ordered cases over Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions.answers import _places

# Limits and names of outliers,
TIMEOUT_MS, LARGE_MP, DENSE_CHARS, LOW_TRUST = 20_000, 8.0, 3_000, 0.10
PAGE_LIMITS_MS = {"ocr": 3_000.0, "strip": 300.0, "render": 500.0, "total": 5_000.0}
# what readers say of a file that is not whole, in names and in words,
DAMAGED_ERRORS = ("NotOfficeXmlFileException", "OLE2NotOfficeXmlFileException", "InvalidFormatException", "NotOLE2FileException", "EmptyFileException", "POIXMLException")
DAMAGED_WORDS = ("end-of-file", "end of file", "header doesn't contain versioninfo", "missing root object", "expected='", "xref", "not a pdf", "zip file", "package should contain", "premature", "has no pages")
NO_SPACE_ERRORS, NO_SPACE_WORDS = ("SQLiteFullException", "SQLiteDiskIOException"), ("enospc", "no space left", "database or disk is full")
# platforms by host (a name that ends in a point may stand anywhere in the host),
PLATFORMS = {
    "Instagram": ("instagram.com", "instagr.am"),
    "Facebook": ("facebook.com", "fb.com", "fb.watch", "m.facebook.com"),
    "Threads": ("threads.net", "threads.com"),
    "X": ("twitter.com", "x.com", "t.co"),
    "Reddit": ("reddit.com", "redd.it"),
    "TikTok": ("tiktok.com", "vm.tiktok.com"),
    "LinkedIn": ("linkedin.com", "lnkd.in"),
    "Pinterest": ("pinterest.com", "pin.it"),
    "Amazon": ("amazon.", "amzn.to", "a.co"),
    "Flipkart": ("flipkart.com", "fkrt.it", "dl.flipkart.com"),
    "Telegram": ("t.me", "telegram.me"),
    "WhatsApp": ("wa.me", "chat.whatsapp.com"),
}
# and endings of words that are marked.
MARK_ENDINGS = ("ations", "ation", "ities", "ments", "ings", "ions", "ment", "ness", "able", "less", "ing", "ion", "ers", "ity", "ful", "ies", "'s", "’s", "es", "ed", "er", "s")
MARK_SMALL, MARK_ROOT = ("", "s", "es", "e", "'s", "’s", "ed", "ing", "y"), 3


#: What is told of an import that failed.
IMPORT_WORDS = {
    "FILE_GONE": "The file is no longer where it was.",
    "LOCKED": "The file asks for a password.",
    "DAMAGED": "The file is not whole.",
    "NO_TEXT": "The file has no words and is kept by its name.",
}


def outlier(megapixels: Column, ms: Column, trust: Column, chars: Column) -> Column:
    """Why a page took long, the first cause that holds."""
    return (
        F.when(ms >= TIMEOUT_MS, "timeout_capped")
        .when(megapixels >= LARGE_MP, "extremely_large_bitmap")
        .when(chars >= DENSE_CHARS, "dense_text")
        .when(trust < LOW_TRUST, "low_contrast_or_noise")
        .otherwise("other")
    )


def over_limits(times: dict[str, Column]) -> Column:
    """The stages (by name, in milliseconds) that took longer than they may."""
    tests = [F.when(times[k] > limit, F.lit(k)) for k, limit in PAGE_LIMITS_MS.items() if k in times]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def import_failure(stage: Column, errors: Column, said: Column, file_name: Column) -> Column:
    """struct(failure, detail) of a failed import.

    stage: UNSUPPORTED, EMPTY, READ or STORE; errors: class names of the error and its causes, outermost first; said: their messages.
    """
    low = F.lower(F.array_join(F.transform(said, lambda x: F.coalesce(x, F.lit(""))), " "))
    any_of = lambda names: F.arrays_overlap(errors, F.array(*[F.lit(n) for n in names]))
    says = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    memory, space = any_of(["OutOfMemoryError"]), any_of(NO_SPACE_ERRORS) | says(NO_SPACE_WORDS)
    gone = any_of(["FileNotFoundException", "SecurityException"])
    reading = (
        F.when(memory, "TOO_BIG")
        .when(any_of(["InvalidPasswordException"]) | says(["password"]), "LOCKED")
        .when(gone | says(["cannot open"]), "FILE_GONE")
        .when(space, "NO_SPACE")
        .when(any_of(["ZipException", "EOFException"]) | any_of(DAMAGED_ERRORS) | says(DAMAGED_WORDS), "DAMAGED")
        .otherwise("OTHER")
    )
    storing = F.when(memory, "TOO_BIG").when(space, "NO_SPACE").when(gone, "FILE_GONE").otherwise("OTHER")
    failure = F.when(stage == "UNSUPPORTED", "NOT_A_DOCUMENT").when(stage == "EMPTY", "NO_TEXT").when(stage == "READ", reading).otherwise(storing)
    ending = F.substr(F.lower(F.trim(F.regexp_extract(file_name, r"\.([^.]*)$", 1))), F.lit(1), F.lit(8))
    first = F.trim(F.substring_index(F.coalesce(F.get(said, F.lit(0)), F.lit("")), "\n", 1))
    own = F.substr(F.when(first != "", first).otherwise(F.get(errors, F.lit(0))), F.lit(1), F.lit(120))
    return F.transform(F.array(failure), lambda f: F.struct(f.alias("failure"), F.when((f == "NOT_A_DOCUMENT") & (ending != ""), ending).when(f == "OTHER", own).alias("detail")))[0]


def failure_words(failure: Column) -> Column:
    """What the user is told."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in IMPORT_WORDS.items() for x in kv]), failure)


def platform(host: Column) -> Column:
    """The platform whose app opens an address of this host; null: the browser does."""
    low, out = F.lower(host), None
    for name, hosts in PLATFORMS.items():
        test = reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) if h.endswith(".") else (low == h) | low.endswith(f".{h}") for h in hosts])
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def mark_roots(word: str) -> list[str]:
    """A typed word without each ending that it may have."""
    out: dict[str, None] = {}
    for ending in MARK_ENDINGS:
        root = word[: -len(ending)]
        if word.endswith(ending) and len(root) >= MARK_ROOT:
            out |= dict.fromkeys([root, *([root[:-1]] if len(root) > MARK_ROOT and root[-1] == root[-2] else []), *([root + "y"] if ending == "ies" else [])])
    return list(out)


def marks(texts: DataFrame, id_col: str, text_col: str, words: list[str]) -> DataFrame:
    """(id, start, end) of the stretches to mark, from 0, in order, merged where they meet: typed words wherever they stand, and their other
    forms as words of their own."""
    words = list(dict.fromkeys(w.lower() for w in words if w.strip()))
    inner = r"\p{L}\p{M}\p{N}'’"
    patterns = [rf"(?i)\Q{w}\E" for w in words]
    roots = sorted({r for w in words if len(w) > MARK_ROOT for r in mark_roots(w)}, key=len, reverse=True)
    if roots:
        endings = "|".join(rf"\Q{e}\E" for e in sorted(MARK_SMALL, key=len, reverse=True) if e)
        patterns.append(rf"(?i)(?<![{inner}])(?:{'|'.join(rf'\Q{r}\E' for r in roots)})(?:{endings})?(?![{inner}])")
    rows = texts.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = reduce(DataFrame.unionByName, [_places(rows, id_col, F.col("t"), p) for p in patterns])
    spans = found.select(id_col, F.col("at").alias("start"), (F.col("at") + F.length("found")).alias("end")).distinct()
    order = Window.partitionBy(id_col).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("opens", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("n", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(id_col, "n").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("n")


def similar_word(vocabulary: DataFrame, word: str) -> DataFrame:
    """The word of a text or vocabulary (term) nearest to one that it doesn't have; ties to the first in order."""
    from loamdex.operators import lexical as lex

    near = vocabulary.where(lex.near(F.col("term"), word)).select("term", F.levenshtein("term", F.lit(word)).alias("distance"))
    return near.orderBy("distance", "term").limit(1)
