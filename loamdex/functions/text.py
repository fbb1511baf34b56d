"""Text functions as Columns: cleaning, chunks, scripts, trust, masking, addresses, hashes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Script code and range of code points, in the order in which ties are decided.
SCRIPTS = {
    "hi": (0x0900, 0x097F),
    "bn": (0x0980, 0x09FF),
    "ta": (0x0B80, 0x0BFF),
    "te": (0x0C00, 0x0C7F),
    "kn": (0x0C80, 0x0CFF),
    "ml": (0x0D00, 0x0D7F),
    "gu": (0x0A80, 0x0AFF),
    "pa": (0x0A00, 0x0A7F),
    "or": (0x0B00, 0x0B7F),
    "ar": (0x0600, 0x06FF),
    "zh": (0x4E00, 0x9FFF),
    "ja": (0x3040, 0x30FF),
    "ko": (0xAC00, 0xD7AF),
    "th": (0x0E00, 0x0E7F),
}
SCRIPT_SHARE = 0.15
#: Limits of the trust score.
LEAST_WORDS, REPLACED, REPLACED_AT_LEAST, PRIVATE, CONTROL, LETTERS, MIXED, MIXED_AT_LEAST = 3, 0.005, 3, 0.01, 0.01, 0.50, 0.05, 2
# Devanagari consonants, vowels and vowel signs, as parts of character classes.
CONSONANTS = r"\x{0915}-\x{0939}\x{0958}-\x{095F}\x{0978}-\x{097F}"
VOWELS = r"\x{0904}-\x{0914}\x{0960}\x{0961}\x{0972}"
VOWEL_SIGNS = r"\x{093A}\x{093B}\x{093E}-\x{094C}\x{094E}\x{094F}\x{0962}\x{0963}"
CHUNK_WORDS, CHUNK_OVERLAP, CHUNK_SENTENCES_BACK = 200, 30, 3
#: Fixed value: where sentences end.
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Zऀ-ॿ])|\n{2,}"
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "ref_src", "igshid", "si")
MIME_BY_EXTENSION = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "epub": "application/epub+zip",
    "html": "text/html",
    "txt": "text/plain",
}
HIDDEN = "••••"


def count_of(text: Column, pattern: str) -> Column:
    """How many characters match a character class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, Arrow batches at a time (no built-in composes)."""
    return text.str.normalize("NFC")


def repaired(text: Column) -> Column:
    """Without soft hyphens (and the line end behind them) and zero-width spaces; no-break spaces and ligatures written out."""
    text = F.regexp_replace(text, "­(?:\r?\n)?", "")
    text = F.translate(text, " ​", " ")
    for one, many in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        text = F.replace(text, F.lit(one), F.lit(many))
    return text


def word_windows(text: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of windows of ``size`` words that overlap; a text of no more words is one window as it is."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    step = size - overlap

    def windows(cut: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(cut) - overlap, F.lit(1)), F.lit(step))
        return F.when(F.size(cut) > size, F.transform(starts, lambda at: F.array_join(F.slice(cut, at, F.lit(size)), " ")))

    # the words are bound once: a window takes its slice of them and doesn't cut the text again
    return F.coalesce(F.element_at(F.transform(F.array(words), windows), 1), F.when(text.isNotNull(), F.array(text)))


def sentence_chunks(df: DataFrame, id_col: str, text_col: str, target: int = CHUNK_WORDS, back: int = CHUNK_SENTENCES_BACK) -> DataFrame:
    """(id, chunk, text): sentences filled up to ``target`` words, the next chunk beginning ``back`` sentences before the last one's end.

    Where a chunk that begins at a sentence ends is a count over the running number of words; which sentences begin chunks is then one walk
    over these ends.  A text without sentences is one chunk as it is; ids must be unique.
    """
    said = F.filter(F.split(text_col, SENTENCE_END), lambda s: F.trim(s) != "")
    rows = df.where(F.col(text_col).isNotNull()).select(id_col, F.when(F.size(said) > 0, said).otherwise(F.array(F.col(text_col))).alias("said"))
    rows = rows.select(id_col, F.posexplode("said").alias("i", "s"))
    order = Window.partitionBy(id_col).orderBy("i")
    before = F.coalesce(F.sum(F.size(F.split("s", r"\s+"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = F.count("*").over(Window.partitionBy(id_col).orderBy("before").rangeBetween(0, target - 1))
    rows = rows.withColumn("before", before).withColumn("end", (F.col("i") + reach).cast("int")).withColumn("next", F.greatest(F.col("end") - back, F.col("i") + 1))
    whole = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", "end", "next", "s"))).alias("x"))
    walk = F.aggregate(
        "x",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda w, x: F.when(x["i"] == w["at"], F.struct(x["next"].alias("at"), F.concat(w["starts"], F.array(x["i"])).alias("starts"))).otherwise(w),
        lambda w: w["starts"],
    )
    whole = whole.withColumn("starts", walk)
    chunk = lambda i: F.array_join(F.transform(F.slice("x", i + 1, F.get("x", i)["end"] - i), lambda x: x["s"]), " ")
    return whole.select(id_col, F.posexplode(F.transform("starts", chunk)).alias("chunk", "text"))


def script(text: Column, share: float = SCRIPT_SHARE) -> Column:
    """The commonest non-Latin script if it has its share of the characters, else en; ties go to the first in the list."""
    counts = F.array(*[F.struct(count_of(text, f"[\\x{{{lo:X}}}-\\x{{{hi:X}}}]").alias("n"), F.lit(-i).alias("i"), F.lit(code).alias("code")) for i, (code, (lo, hi)) in enumerate(SCRIPTS.items())])
    return F.transform(F.array(F.array_max(counts)), lambda best: F.when((best["n"] > 0) & (best["n"] >= F.length(text) * share), best["code"]).otherwise("en"))[0]


def trust(text: Column) -> Column:
    """struct(trusted, score, reasons): why extracted text may be broken, each reason worth a quarter.

    Script interleaving counts words whose letters change script twice.  Devanagari marks are out of order where a vowel sign, virama or
    nukta follows no consonant (a nukta may stand between), or a nasal mark or visarga follows no syllable.
    """
    solid = count_of(text, r"\S")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    latin, indic = "A-Za-zÀ-ɏ", "ऀ-ॿ"
    other = rf"\p{{L}}&&[^{latin}{indic}]"
    change = rf"[{latin}][^\p{{L}}]*[\p{{L}}&&[^{latin}]]|[{indic}&&\p{{L}}][^\p{{L}}]*[\p{{L}}&&[^{indic}]]|[{other}][^\p{{L}}]*[{latin}{indic}&&\p{{L}}]"
    twice = F.size(F.filter(words, lambda w: F.regexp_count(w, F.lit(f"(?={change})")) >= 2))
    ratio = lambda pattern: count_of(text, pattern) / solid
    wrong = F.regexp_count(text, F.lit(f"(?<![{CONSONANTS}\\x{{093C}}])[{VOWEL_SIGNS}\\x{{094D}}]|(?<![{CONSONANTS}{VOWELS}{VOWEL_SIGNS}])[\\x{{0900}}-\\x{{0903}}]|(?<![{CONSONANTS}])\\x{{093C}}"))
    marks = count_of(text, f"[{VOWEL_SIGNS}\\x{{094D}}\\x{{0900}}-\\x{{0903}}\\x{{093C}}]")
    out_of_order = (count_of(text, f"[{indic}]") >= 10) & (marks > 0) & (wrong >= 2) & (wrong / marks > 0.05)
    reasons = [
        ("TOO_FEW_WORDS", F.size(words) < LEAST_WORDS),
        ("REPLACEMENT_CHARS", (count_of(text, "�") >= REPLACED_AT_LEAST) & (ratio("�") > REPLACED)),
        ("PRIVATE_USE_CHARS", ratio("[-]") > PRIVATE),
        ("CONTROL_CHARS", ratio(r"[\p{Cc}&&[^\s]]") > CONTROL),
        ("LOW_LETTER_RATIO", ratio(r"[\p{L}\p{Nd}]") < LETTERS),
        ("MIXED_SCRIPT_WORDS", (twice >= MIXED_AT_LEAST) & (twice / F.size(words) > MIXED)),
        ("DEVANAGARI_ORDER", out_of_order),
    ]
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in reasons]), lambda r: r.isNotNull())
    found = F.when(solid == 0, F.array(F.lit("BLANK"))).otherwise(found)
    return F.transform(F.array(found), lambda r: F.struct((F.size(r) == 0).alias("trusted"), F.when(F.array_contains(r, "BLANK"), 0.0).otherwise(F.greatest(1 - 0.25 * F.size(r), F.lit(0.0))).alias("score"), r.alias("reasons")))[0]


def stripped(html: Column) -> Column:
    """Text of simple markup by replacement: scripts and styles out, block ends to line ends, tags out, five references decoded, white space folded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?is)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def mime(declared: Column, name: Column) -> Column:
    """The declared type unless it says nothing, else by extension."""
    table = F.create_map(*[F.lit(x) for kv in MIME_BY_EXTENSION.items() for x in kv])
    by_name = F.try_element_at(table, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))
    return F.coalesce(F.when(~declared.isin("", "application/octet-stream", "*/*"), declared), by_name)


def sheet_text(name: Column, rows: Column) -> Column:
    """A sheet's heading line, then each row's cells that are not blank, joined by bars."""
    line = lambda cells: F.array_join(F.filter(cells, lambda c: F.trim(c) != ""), " | ")
    return F.concat_ws("\n", F.concat(F.lit("Sheet: "), name), F.array_join(F.filter(F.transform(rows, line), lambda r: r != ""), "\n"))


def masked(text: Column) -> Column:
    """One-time codes, card numbers that pass their check, and named secrets hidden."""
    words = "(?:otp|one[- ]time (?:password|passcode|pin|code)|verification code|security code|login code)"
    out = F.regexp_replace(text, rf"(?i)({words}[^\n\d]{{0,40}}?)(?<!\d)\d{{4,8}}(?!\d)", f"$1{HIDDEN}")
    out = F.regexp_replace(out, rf"(?i)(?<!\d)\d{{4,8}}(?!\d)([^\n\d]{{0,40}}?{words})", f"{HIDDEN}$1")
    out = F.regexp_replace(out, r"(?i)\b((?:password|passcode|pin|cvv|upi pin)\s*[:=-]\s*)\S{3,40}", f"$1{HIDDEN}")
    card = r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"
    digits = lambda m: F.regexp_replace(m, r"\D", "")
    hide = lambda p, m: F.concat(p, F.when(m.isNull(), "").when(F.length(digits(m)).between(13, 19) & F.call_function("luhn_check", digits(m)), HIDDEN).otherwise(m))
    cards = F.array_join(F.zip_with(F.split(out, card, -1), F.regexp_extract_all(out, F.lit(card), F.lit(0)), hide), "")
    return F.when(out.rlike(r"\d(?:[ -]?\d){12}"), cards).otherwise(out)


def first_url(text: Column) -> Column:
    """The first web address, without closing punctuation."""
    found = F.regexp_extract(text, r"(https?://\S+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"[.,)\]}\"'>;]+$", ""))


def normal_url(url: Column, tracking: Sequence[str] = TRACKING) -> Column:
    """Scheme and host in lower case without www, no fragment, no closing slash, parameters sorted and without tracking."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*tracking)))
    return F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def qr_fields(payload: Column) -> Column:
    """The parameters of a payment code as a map, decoded."""
    query = F.regexp_extract(payload, r"(?i)^upi://pay\?(.*)$", 1)
    pairs = F.str_to_map(query, F.lit("&"), F.lit("="))
    return F.when(query != "", F.transform_values(pairs, lambda k, v: F.try_url_decode(v)))


def split_tags(text: Column, known: Sequence[str]) -> Column:
    """struct(text, tags) of a text whose last line is a bracketed list of known tags."""
    line = F.regexp_extract(text, r"\n\[([a-z ]+)\]\s*$", 1)
    tags = F.split(line, " ")
    good = (line != "") & F.forall(tags, lambda t: t.isin(*known))
    return F.struct(F.when(good, F.regexp_replace(text, r"\n\[[a-z ]+\]\s*$", "")).otherwise(text).alias("text"), F.when(good, line).otherwise("").alias("tags"))


def content_hash(text: Column) -> Column:
    """SHA-256."""
    return F.sha2(text, 256)


def digits_repaired(text: Column) -> Column:
    """The Bengali digits that a reader takes for 8 and 0, put right unless they touch a letter."""
    for wrong, right in (("০", "0"), ("৪", "8")):
        text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{M}}]){wrong}(?![\p{{L}}\p{{M}}])", right)
    return text


def seed64(text: Column) -> Column:
    """H * 31 + c over the characters, in 64 bits with wrapping."""
    chars = F.split(text, r"(?!^)(?!\z)")
    return F.when(text == "", F.lit(0).cast("long")).otherwise(F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: _wrapped(h, F.ascii(c))))


def _wrapped(h: Column, c: Column) -> Column:
    """31 * h + c modulo 2**64, as a signed number."""
    wide = h.cast("decimal(38,0)") * 31 + c
    two64, two63 = F.expr("18446744073709551616BD"), F.expr("9223372036854775808BD")
    low = F.pmod(wide, two64)
    return F.when(low >= two63, low - two64).otherwise(low).cast("long")


def kind_by(text: Column, kinds: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """An ordered CASE of named tests."""
    first, *rest = kinds
    return reduce(lambda out, k: out.when(k[1], k[0]), rest, F.when(first[1], first[0])).otherwise(otherwise)
