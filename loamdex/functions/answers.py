"""Facts that a question asks for, read next to the words it asks about.

Occurrences of words and of facts are rows; what stands near what is a window over positions, so a page of any length
and with any number of occurrences is worked out by sorting.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How a question names a fact, and how the fact looks on a page.
_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)"
FACTS = {
    "PAN": ("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    "AADHAAR": ("aadhaar|aadhar|adhar|adhaar", r"\b\d{4}\s\d{4}\s\d{4}\b"),
    "IFSC": ("ifsc", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    "UPI": ("upi", r"\b[\w.\-]{2,}@[a-zA-Z]{2,}\b(?!\.)"),
    "EMAIL": ("email|e-mail|mail id|gmail", r"\b[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+\b"),
    "OTP": ("otp|verification code|one time password", r"\b\d{4,8}\b"),
    "PHONE": ("phone|mobile|contact number|phone number", r"(?:\+91[\s-]?)?\b[6-9]\d{4}[\s-]?\d{5}\b"),
    "REFERENCE": (
        "reference|transaction id|transaction number|order id|order number|invoice number|invoice no|bill number|bill no|receipt number|receipt no|pnr|booking id",
        r"(?i)(?:\b(?:no|number|id|ref|reference|pnr)\b\.?\s*[:#\-]?\s*)((?=[A-Z0-9\-/]*\d)[A-Z0-9][A-Z0-9\-/]{2,})|\b[A-Z]{1,6}\d[A-Z0-9]{6,}\b",
    ),
    "AMOUNT": (
        "how much|amount|price|cost|fee|fees|total|paid|pay|charge|charges|rupees|kitna|kitne|kitni",
        r"(?i)(?:₹|\brs\.?|\binr)\s?[\d,]+(?:\.\d{1,2})?|\b[\d,]+(?:\.\d{1,2})?\s?(?:rupees\b|/-)",
    ),
    "DATE": (
        "when|date|deadline|due|which day|what day|kab|tarikh",
        rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTH}[a-z]*\.?,?\s+\d{{4}}\b|\b{_MONTH}[a-z]*\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b|\b\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{2,4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b",
    ),
}
#: What settles the kind whatever else is said.
SETTLES = {"AMOUNT": "how much|kitna|kitne|kitni", "DATE": "when|kab|what date|which date|which day|what day"}
#: Words of a question that ask, rather than say what is asked about.
ASKING = frozenset((
    "what", "whats", "when", "where", "which", "who", "whose", "how", "much", "many", "is", "are", "was", "were", "the", "a", "an", "of", "for", "to",
    "in", "on", "at", "from", "by", "with", "and", "or", "my", "me", "i", "did", "do", "does", "it", "that", "this", "tell", "show", "find", "give",
    "get", "please", "about", "any", "there", "number", "no", "id", "date", "amount", "day", "pay", "paid", "kya", "hai", "tha", "thi", "ka", "ki",
    "ke", "ko", "se", "mera", "meri", "mere", "kab", "kitna", "kitne", "kitni", "batao", "bata", "dikhao", "kahan", "kaun",
))
#: Fixed value: characters within which words stand together.
WINDOW = 160


def _names(question: str, words: str) -> re.Match | None:
    return re.search(rf"(?i)(?<![^\W_])(?:{words})(?![^\W_])", question)


def fact_asked(question: str) -> str | None:
    """The kind of fact a question asks for: what settles it, else the kind named first."""
    for kind, words in SETTLES.items():
        if _names(question, words):
            return kind
    named = [(m.start(), i, kind) for i, (kind, (words, _)) in enumerate(FACTS.items()) if (m := _names(question, words))]
    return min(named)[2] if named else None


def about_words(question: str) -> list[str]:
    """The words that say what is asked about; of a question that only asks, those it names."""
    words = [w for w in re.split(r"[\W_]+", question.lower()) if len(w) >= 2]
    return list(dict.fromkeys(w for w in words if w not in ASKING)) or list(dict.fromkeys(w for w in words if len(w) >= 3 and w not in ("what", "the", "how", "who", "when")))


def _places(rows: DataFrame, id_col: str, text: Column, pattern: str) -> DataFrame:
    """(id, at, found): where a pattern stands in a text, from 0."""
    cut = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    parts = rows.select(id_col, F.posexplode(cut).alias("i", "x")).select(id_col, "i", F.length("x.piece").alias("before"), F.col("x.found").alias("found"))
    until = Window.partitionBy(id_col).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.col("before") + F.coalesce(F.length("found"), F.lit(0))).over(until)
    return parts.withColumn("at", (ends - F.coalesce(F.length("found"), F.lit(0))).cast("int")).where("found is not null").select(id_col, "at", "found")


def answers(pages: DataFrame, id_col: str, text_col: str, question: str) -> DataFrame:
    """(id, words, value, quote) of all pages that say any word asked about; the caller takes the best.

    On a page the place counts where the most words asked about follow within WINDOW characters, of several where they stand closest, of
    these the first.  The value is the first fact of the kind asked for that follows within WINDOW, else the nearest within three times that.
    """
    about, fact = about_words(question), fact_asked(question)
    text = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " "))
    rows = pages.select(id_col, text.alias("t")).withColumn("low", F.lower("t"))
    rows = rows.where(reduce(lambda a, b: a | b, [F.contains("low", F.lit(w)) for w in about], F.lit(False)))
    said = reduce(DataFrame.unionByName, [_places(rows, id_col, F.col("low"), rf"\Q{w}\E").select(id_col, "at", F.lit(w).alias("word")) for w in about or ["\0"]])
    ahead = Window.partitionBy(id_col).orderBy("at").rangeBetween(0, WINDOW - 1)
    next_ = [F.min(F.when(F.col("word") == w, F.col("at"))).over(ahead).alias(f"n{i}") for i, w in enumerate(about or ["\0"])]
    near = [F.col(f"n{i}") for i in range(len(next_))]
    count = reduce(lambda a, b: a + b, [F.when(n.isNotNull(), 1).otherwise(0) for n in near])
    spans = said.select(id_col, "at", *next_).select(id_col, "at", count.alias("words"), (F.greatest(*near, F.col("at")) - F.col("at")).alias("span"))
    best = spans.groupBy(id_col).agg(F.max(F.struct("words", (-F.col("span")).alias("s"), (-F.col("at")).alias("a"))).alias("b")).select(id_col, "b.words", (-F.col("b.a")).alias("at"))
    found = rows.join(best, id_col)
    quote = F.substr("t", F.greatest(F.col("at") - 40, F.lit(0)) + 1, F.least(F.col("at"), F.lit(40)) + WINDOW)
    if not fact:
        return found.select(id_col, "words", F.lit(None).cast("string").alias("value"), quote.alias("quote"))
    pattern = FACTS[fact][1]
    labelled = F.regexp_extract("found", pattern, 1) if re.compile(pattern).groups else F.lit("")
    value = F.trim(F.when(labelled != "", labelled).otherwise(F.col("found")))
    seen = _places(found.select(id_col, "t"), id_col, F.col("t"), pattern).select(id_col, F.col("at").alias("s"), value.alias("v"))
    if fact == "OTP":
        seen = seen.where(~F.col("v").rlike("^(?:19|20)..$"))
    seen = seen.join(best.select(id_col, "at"), id_col)
    behind, off = F.col("s").between(F.col("at"), F.col("at") + WINDOW), F.abs(F.col("s") - F.col("at"))
    seen = seen.where(behind | (off <= 3 * WINDOW)).groupBy(id_col).agg(F.min(F.struct(F.when(behind, 0).otherwise(1).alias("k"), off.alias("off"), "s", "v")).alias("x"))
    return found.join(seen.select(id_col, F.col("x.v").alias("value")), id_col, "left").select(id_col, "words", "value", quote.alias("quote"))
