"""Text functions, facts and query reading over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.functions import answers as an, facts, layout, rules, spelling as sp, text as tx
from loamdex.plans import reading
from loamdex.plans.registry import Tables, query


@query("X2 X53", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(trim(text), '^\s+|\s+$', '', 'g'), '\s+'), lambda x: x <> '') AS ws, text FROM documents),
    c AS (SELECT doc_id, unnest(CASE WHEN len(ws) <= 200 THEN [text] ELSE list_transform(range(1, greatest(len(ws) - 30, 1) + 1, 170), lambda a: array_to_string(ws[a:a + 199], ' ')) END) AS chunk FROM w)
    SELECT doc_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM c GROUP BY 1""")
def word_window_chunks(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.explode(tx.word_windows(F.col("text"))).alias("chunk"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


@query(
    "X3",
    r"""WITH RECURSIVE s AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+([A-Zऀ-ॿ])', '\1' || chr(1) || '\2', 'g'), '\n{2,}', chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS cut FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, CASE WHEN len(cut) > 0 THEN cut ELSE [text] END AS said FROM s), r AS (SELECT doc_id, unnest(said) AS s, unnest(range(len(said))) AS i FROM t),
    b AS (SELECT doc_id, i, coalesce(sum(len(regexp_split_to_array(s, '\s+'))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
    e AS (SELECT doc_id, i, i + count(*) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 199 FOLLOWING) AS e FROM b),
    w AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, 0 AS k FROM t UNION ALL SELECT w.doc_id, greatest(e.e - 3, e.i + 1), k + 1 FROM w JOIN e ON e.doc_id = w.doc_id AND e.i = w.i)
    SELECT doc_id, k AS chunk_index, length(c) AS chars, md5(c) AS hash FROM (SELECT w.doc_id, k, array_to_string(said[w.i + 1:e.e], ' ') AS c FROM w JOIN e ON e.doc_id = w.doc_id AND e.i = w.i JOIN t ON t.doc_id = w.doc_id)""",
)
def sentence_chunks(t: Tables) -> DataFrame:
    rows = tx.sentence_chunks(t.documents, "doc_id", "text")
    return rows.select("doc_id", F.col("chunk").alias("chunk_index"), F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("hash"))


@query("X1", "SELECT doc_id, md5(nfc_normalize(text)) AS hash FROM documents")
def nfc_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.nfc("text").cast("binary")).alias("hash"))


def script_sql(text: str) -> str:
    """SQL for the script of a text: the first of the largest counts, if it has its share."""
    counts = ", ".join(f"length(regexp_replace({text}, '[^\\x{{{lo:X}}}-\\x{{{hi:X}}}]', '', 'g'))" for lo, hi in tx.SCRIPTS.values())
    codes = ", ".join(f"'{c}'" for c in tx.SCRIPTS)
    return f"(SELECT CASE WHEN list_max(c) > 0 AND list_max(c) >= length({text}) * 0.15 THEN [{codes}][list_position(c, list_max(c))] ELSE 'en' END FROM (SELECT [{counts}] AS c))"


@query("X4 A25", f"""SELECT lang, count(*) AS n, CAST(sum(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))) AS BIGINT) AS letters, CAST(sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) AS BIGINT) AS digits, max({script_sql("text")}) AS script FROM documents GROUP BY 1""")
def script_histogram(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", tx.count_of(F.col("text"), r"\p{L}").alias("letters"), tx.count_of(F.col("text"), "[0-9]").alias("digits"), tx.script(F.col("text")).alias("script"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("letters").alias("letters"), F.sum("digits").alias("digits"), F.max("script").alias("script"))


#: Greetings in several scripts, some mixed, for texts that the tables don't have.
GREETINGS = ("नमस्ते दुनिया", "স্বাগতম", "வணக்கம் ab", "مرحبا بالعالم", "你好", "こんにちは你好世界", "안녕하세요 hello", "hello world", "สวัสดี ไทย नमस्ते", "x 你")


@query("X4", f"""SELECT script, count(*) AS n FROM (SELECT {script_sql("said")} AS script FROM (SELECT source || ' ' || [{", ".join(f"'{g}'" for g in GREETINGS)}][CAST(doc_id % {len(GREETINGS)} AS INT) + 1] AS said FROM documents)) GROUP BY 1""")
def scripts_of_greetings(t: Tables) -> DataFrame:
    """The script of each source's name with a greeting behind it."""
    greeting = F.element_at(F.array(*[F.lit(g) for g in GREETINGS]), (F.col("doc_id") % len(GREETINGS)).cast("int") + 1)
    return t.documents.groupBy(tx.script(F.concat("source", F.lit(" "), greeting)).alias("script")).agg(F.count("*").alias("n"))


@query("X5")
def trust_scores(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", tx.trust(F.col("text")).alias("t"))
    return rows.select("doc_id", "t.trusted", "t.score", F.concat_ws(",", "t.reasons").alias("reasons"))


@query("X6", "SELECT page_id, md5(replace(replace(replace(html, chr(160), ' '), chr(8203), ''), chr(64257), 'fi')) AS hash FROM pages")
def repaired_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(tx.repaired(F.col("html")).cast("binary")).alias("hash"))


@query("X38", """SELECT o_orderkey, 'on ' || replace(replace(CAST(o_orderkey AS VARCHAR), '8', '8'), '0', '0') || '/08 ক০ক' AS said FROM orders""")
def look_alike_digits(t: Tables) -> DataFrame:
    """Order keys as a reader takes them, with Bengali digits for 8 and 0; one that touches a letter stays."""
    read = F.concat(F.lit("on "), F.translate(F.col("o_orderkey").cast("string"), "08", "০৪"), F.lit("/০৪ ক০ক"))
    return t.orders.select("o_orderkey", tx.digits_repaired(read).alias("said"))


TRUST = {
    "BLANK": " \n ",
    "TOO_FEW_WORDS": "two words",
    "REPLACEMENT_CHARS": "three or more � � � signs stand in this text",
    "PRIVATE_USE_CHARS": "letters of a font's own  stand here",
    "CONTROL_CHARS": "control \x01\x02 signs stand in here",
    "LOW_LETTER_RATIO": "a b c ***** ***** ----- =====",
    "MIXED_SCRIPT_WORDS": "aбcд бaбa and some words more",
    "DEVANAGARI_ORDER": "िक ाल नमस्ते दुनिया में कुछ शब्द",
    "": "plain words in order नमस्ते दुनिया में कुछ शब्द",
    "TOO_FEW_WORDS,LOW_LETTER_RATIO": "***** a",
}


@query("X5", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(not k).upper()}, {0.0 if k == 'BLANK' else 1 - 0.25 * len([x for x in k.split(',') if x])})" for k in TRUST) + ") v(reasons, trusted, score)")
def trust_of_samples(t: Tables) -> DataFrame:
    """A text for each reason not to be trusted."""
    rows = t.spark.createDataFrame([(x,) for x in TRUST.values()], "said string").select(tx.trust(F.col("said")).alias("t"))
    return rows.select(F.concat_ws(",", "t.reasons").alias("reasons"), "t.trusted", "t.score")


@query("X50", """SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 20 AND length(regexp_replace(text, '[^\\p{L}\\p{Nd}]', '', 'g')) >= 0.5 * length(regexp_replace(text, '\\s', '', 'g')) AS accepted FROM documents WHERE text IS NOT NULL""")
def early_accepts(t: Tables) -> DataFrame:
    """Which documents a first reading would be kept of."""
    return t.documents.where("text is not null").select("doc_id", facts.healthy(F.col("text"), 20).alias("accepted"))


@query("S13", r"""SELECT page_id, length(t) AS n, md5(t) AS hash FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'),
    '(?is)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)""")
def html_strip_pages(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", tx.stripped(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("hash"))


@query("S14 X42", """SELECT mime, count(*) AS n FROM (SELECT CASE WHEN page_id % 10 = 0 THEN 'image/png' WHEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) = 'html' THEN 'text/html' END AS mime FROM pages) GROUP BY 1""")
def mime_types(t: Tables) -> DataFrame:
    declared = F.when(F.col("page_id") % 10 == 0, "image/png").otherwise("application/octet-stream")
    return t.pages.groupBy(tx.mime(declared, F.col("url")).alias("mime")).agg(F.count("*").alias("n"))


@query("X18", r"""SELECT doc_id, md5(regexp_replace(text, '(?i)\b((?:password|passcode|pin|cvv|upi pin)\s*[:=-]\s*)\S{3,40}', '\1••••', 'g')) AS hash FROM documents WHERE NOT regexp_matches(text, '[0-9]([ -]?[0-9]){12}')""")
def mask_sensitive(t: Tables) -> DataFrame:
    rows = t.documents.where(~F.col("text").rlike("[0-9]([ -]?[0-9]){12}"))
    return rows.select("doc_id", F.md5(tx.masked(F.col("text")).cast("binary")).alias("hash"))


@query("X18")
def mask_cards(t: Tables) -> DataFrame:
    rows = t.documents.where(F.col("text").rlike("[0-9]([ -]?[0-9]){12}")).select("doc_id", tx.masked(F.col("text")).alias("m"))
    return rows.select("doc_id", ((F.length("m") - F.length(F.replace("m", F.lit(tx.HIDDEN), F.lit("")))) / len(tx.HIDDEN)).cast("long").alias("hidden"))


@query("X19", r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')
    || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS url FROM (SELECT page_id, url, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains(['utm_source', 'utm_medium', 'ref'], lower(split_part(p, '=', 1))))) AS k FROM pages)""")
def url_normalize(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.normal_url(F.col("url")).alias("url"))


@query("X20", "SELECT event_id, 'shop' || user_id || '@bank' AS pa, CAST(CAST(floor(value) AS INT) AS VARCHAR) AS am, 'a b' AS tn FROM events WHERE event_type = 'purchase'")
def qr_payment_fields(t: Tables) -> DataFrame:
    payload = F.concat(F.lit("upi://pay?pa=shop"), F.col("user_id").cast("string"), F.lit("%40bank&am="), F.floor("value").cast("int").cast("string"), F.lit("&tn=a%20b"))
    rows = t.events.where("event_type = 'purchase'").select("event_id", tx.qr_fields(payload).alias("f"))
    return rows.select("event_id", F.col("f")["pa"].alias("pa"), F.col("f")["am"].alias("am"), F.col("f")["tn"].alias("tn"))


@query("X21 X20", "SELECT conv_id, turn, length(text) AS n, CASE WHEN turn % 2 = 0 THEN 'pdf document' ELSE '' END AS tags FROM conversations")
def split_stored_tags(t: Tables) -> DataFrame:
    stored = F.concat("text", F.when(F.col("turn") % 2 == 0, "\n[pdf document]").otherwise("\n[other words]"))
    rows = t.conversations.select("conv_id", "turn", "text", tx.split_tags(stored, ["pdf", "document"]).alias("s"))
    return rows.select("conv_id", "turn", (F.length("s.text") - F.when(F.col("s.tags") == "", len("\n[other words]")).otherwise(0)).cast("long").alias("n"), "s.tags")


@query("X24 X25 A12", "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(t: Tables) -> DataFrame:
    rows = t.documents.groupBy(tx.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return rows.where("copies > 1")


@query("X25", """WITH e AS (SELECT l_orderkey, count(*) AS expected, count(*) FILTER (l_returnflag <> 'R') AS stored FROM lineitem GROUP BY 1)
    SELECT CASE WHEN stored = 0 THEN 'NEW' WHEN stored >= expected THEN 'DUPLICATE' ELSE 'PARTIAL' END AS verdict, count(*) AS n FROM e GROUP BY 1""")
def duplicate_verdicts(t: Tables) -> DataFrame:
    e = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("expected"), F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("stored"))
    return e.groupBy(F.when(F.col("stored") == 0, "NEW").when(F.col("stored") >= F.col("expected"), "DUPLICATE").otherwise("PARTIAL").alias("verdict")).agg(F.count("*").alias("n"))


@query("X29", "SELECT CASE WHEN lang IN ('en', 'de') THEN 'germanic' WHEN lang IN ('fr', 'es') THEN 'romance' ELSE 'other' END AS stratum, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def strata(t: Tables) -> DataFrame:
    lang = F.col("lang")
    kind = tx.kind_by(lang, [("germanic", lang.isin("en", "de")), ("romance", lang.isin("fr", "es"))], "other")
    return t.documents.groupBy(kind.alias("stratum")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "X44",
    """SELECT c_custkey, CASE WHEN h >= 9223372036854775808 THEN CAST(h - 18446744073709551616 AS BIGINT) ELSE CAST(h AS BIGINT) END AS seed FROM
    (SELECT c_custkey, list_reduce(list_transform(string_split(c_name, ''), lambda c: CAST(ord(c) AS HUGEINT)), lambda h, c: (h * 31 + c) % 18446744073709551616) AS h FROM customer)""",
)
def stable_seeds(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", tx.seed64(F.col("c_name")).alias("seed"))


@query("X7 X8", r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:version|price|total)\s*[:\-]?\s*(\d+(?:\.\d{1,2})?)', 1)) AS d FROM documents) SELECT doc_id, d AS value, round(CAST(d AS DOUBLE), 2) AS number FROM m WHERE CAST(d AS DOUBLE) > 0""")
def amount_extract(t: Tables) -> DataFrame:
    found = facts.matches(F.col("text"), r"(?i)(?:version|price|total)\s*[:\-]?\s*(\d+(?:\.\d{1,2})?)", 1)
    rows = t.documents.select("doc_id", F.explode(found).alias("value")).withColumn("number", facts.amount(F.col("value")))
    return rows.where("number is not null")


@query("X7 X8 X9 X53", """WITH o AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS price, c_mktsegment AS who, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderkey, 'AMOUNT' AS kind, price AS value, CAST(price AS DOUBLE) AS number, 0.9 AS trust FROM o UNION ALL SELECT o_orderkey, 'ID_NUMBER', 'AB' || (o_orderkey + 10000), NULL, 0.9 FROM o
    UNION ALL SELECT o_orderkey, 'DATE', day, NULL, 0.8 FROM o UNION ALL SELECT o_orderkey, 'PARTY', who, NULL, 0.6 FROM o UNION ALL SELECT o_orderkey, 'DOC_KIND', 'bill', NULL, 0.6 FROM o""")
def facts_of_receipts(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    said = F.concat(F.lit("Invoice ab"), (F.col("o_orderkey") + 10000).cast("string"), F.lit("\nGrand total: Rs "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("\nPaid to "), "c_mktsegment", F.lit(", on "), F.date_format("o_orderdate", "dd/MM/yyyy"))
    return facts.facts(rows.select("o_orderkey", said.alias("text")), "o_orderkey", "text")


@query("X9 X12", """SELECT d, m, y, strftime(try_cast(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE), '%Y-%m-%d') AS day FROM (SELECT CAST(o_orderkey % 33 AS INT) AS d, CAST(o_orderkey % 14 AS INT) AS m, CAST(1990 + o_orderkey % 30 AS INT) AS y FROM orders)""")
def guarded_dates(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("cast(o_orderkey % 33 as int) d", "cast(o_orderkey % 14 as int) m", "cast(1990 + o_orderkey % 30 as int) y")
    return rows.select("d", "m", "y", F.date_format(facts.date_of(F.col("d"), F.col("m"), F.col("y")), "yyyy-MM-dd").alias("day"))


FACT_TEXTS = {
    1: ("City Hospital Ltd\nकुल राशि: ₹ 2 लाख\nDL No DL-0420110149646\n3 Jan 2024", [("AMOUNT", "2", 200000.0, 0.9), ("ID_NUMBER", "DL0420110149646", None, 0.9), ("DATE", "3 Jan 2024", None, 0.8), ("PARTY", "City Hospital Ltd", None, 0.5)]),
    2: ("उपभोक्ता क्रमांक: 12345678\nराम कुमार को भेजा गया\nCall 98765 43210", [("ID_NUMBER", "12345678", None, 0.9), ("PARTY", "राम कुमार", None, 0.6), ("PHONE", "9876543210", None, 0.7), ("DOC_KIND", "phone", None, 0.6)]),
    3: ("Account: 1234 5678 9012 on 31 Feb 2024 रु 500", [("ID_NUMBER", "123456789012", None, 0.9), ("AMOUNT", "500", 500.0, 0.8)]),
    4: ("Received from Mr. Rao, 12 sept. 2023 for 1,23,456.78", [("PARTY", "Mr. Rao", None, 0.6), ("DATE", "12 sept. 2023", None, 0.8), ("AMOUNT", "1,23,456.78", 123456.78, 0.5)]),
}


@query("X7 X8 X9", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{v}', CAST({n if n is not None else 'NULL'} AS DOUBLE), CAST({w} AS DOUBLE))" for i, (_, fs) in FACT_TEXTS.items() for k, v, n, w in fs) + ") v(id, kind, value, number, trust)")
def facts_of_two_languages(t: Tables) -> DataFrame:
    return facts.facts(t.spark.createDataFrame([(i, x) for i, (x, _) in FACT_TEXTS.items()], "id int, text string"), "id", "text")


KIND_TEXTS = {
    "PAYMENT": "UPI Ref No 627912345678 paid Rs 500 via PhonePe",
    "BILL": "Tax Invoice\nGSTIN 22AAAAA\nfor things",
    "OTP": "Your OTP is 123456",
    "PHONE": "Call 9876543210 now",
    "MARKSHEET": "Grade card CGPA 8.1 Roll No 12",
    "PRESCRIPTION": "Rx Paracetamol 500 mg",
    "RESUME": "Curriculum Vitae\nEducation\nSkills",
    "AGREEMENT": "This agreement, whereas the lessor and the lessee",
    "": "An article about money paid by UPI",
}
KIND_SQL = "[" + ", ".join(f"'{facts.KIND_TAGS.get(k, '')}'" for k in KIND_TEXTS) + "]"


@query(
    "X14",
    f"""WITH p AS (SELECT o_orderkey, string_split(CASE WHEN o_orderkey % 4 = 1 THEN 'pdf document' ELSE '' END || ' ' || {KIND_SQL}[CAST(o_orderkey % {len(KIND_TEXTS)} AS INT) + 1] || ' ' ||
    CASE o_orderkey % 3 WHEN 0 THEN 'qr code upi payment' WHEN 1 THEN 'barcode' ELSE '' END, ' ') AS w FROM orders)
    SELECT o_orderkey, array_to_string(list_filter(w, lambda x, i: x <> '' AND list_position(w, x) = i), ' ') AS tags FROM p""",
)
def tag_kinds(t: Tables) -> DataFrame:
    """A text of each kind with a document's type and a code read off it, by order key."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("o_orderkey") % len(values)).cast("int") + 1)
    codes = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("upi://pay?pa=x@y"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("12345678"))).otherwise(F.array().cast("array<string>"))
    return t.orders.select("o_orderkey", facts.tags(pick(KIND_TEXTS.values()), F.when(F.col("o_orderkey") % 4 == 1, "PDF").otherwise("IMAGE"), codes).alias("tags"))


@query(
    "X15",
    """WITH o AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS price FROM orders)
    SELECT id, 'DATE' AS type, day AS value, 1.0 AS confidence, 'regex' AS source FROM o UNION ALL SELECT id, 'AMOUNT', price, 0.8, 'regex' FROM o UNION ALL SELECT id, 'UPI', 'u' || id || '@okbank', 1.0, 'regex' FROM o
    UNION ALL SELECT id, 'SOURCE_APP', 'WhatsApp', 0.9, 'dictionary' FROM o WHERE id % 2 = 0 UNION ALL SELECT id, 'STATUS', CASE WHEN id % 3 = 0 THEN 'Failed' ELSE 'Success' END, 0.8, 'heuristic' FROM o""",
)
def metadata_of_messages(t: Tables) -> DataFrame:
    """A payment's message for each order; a date that stands twice, in both forms, counts once."""
    text = F.concat(
        F.lit("Payment "), F.when(F.col("o_orderkey") % 3 == 0, "declined").otherwise("successful"), F.lit(" on "), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(" ("), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(") Rs "),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" to u"), F.col("o_orderkey").cast("string"), F.lit("@okbank"), F.when(F.col("o_orderkey") % 2 == 0, " via WhatsApp").otherwise(""),
    )
    return facts.metadata(t.orders.select(F.col("o_orderkey").alias("id"), text.alias("text")), "id", "text")


@query("X15 W11", r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}')) AS value FROM documents) SELECT value, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_id FROM m GROUP BY 1""")
def metadata_conflicts(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.explode(facts.matches(F.col("text"), facts.ACTIONS["Email"])).alias("value"))
    return rows.groupBy("value").agg(F.countDistinct("doc_id").alias("documents"), F.min("doc_id").alias("first_id"))


@query("X16 A4", """WITH c AS (SELECT o_custkey, count(*) AS dates, count(*) FILTER (o_totalprice > 150000) AS amounts FROM orders GROUP BY 1),
    s AS (SELECT *, CASE WHEN amounts > 0 THEN 40 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 40 ELSE 0 END + 20 - CASE WHEN amounts > 5 OR dates > 5 THEN 50 ELSE 0 END AS pay, CASE WHEN dates > 5 THEN 40 ELSE 0 END + CASE WHEN amounts > 5 THEN 40 ELSE 0 END + CASE WHEN o_custkey % 5 = 1 THEN 20 ELSE 0 END AS bank,
    CASE WHEN o_custkey % 3 = 0 THEN 50 ELSE 0 END + CASE WHEN o_custkey % 5 = 2 THEN 40 ELSE 0 END AS train, CASE WHEN o_custkey % 5 = 3 THEN 100 ELSE 0 END AS aadhaar, CASE WHEN amounts > 0 THEN 40 ELSE 0 END + CASE WHEN o_custkey % 5 = 4 THEN 50 ELSE 0 END AS invoice FROM c),
    b AS (SELECT *, greatest(pay, bank, train, aadhaar, invoice) AS best FROM s)
    SELECT CASE WHEN best < 80 THEN 'UNKNOWN' WHEN pay = best THEN 'PAYMENT' WHEN bank = best THEN 'FINANCE' WHEN train = best THEN 'TICKET' WHEN aadhaar = best THEN 'IDENTITY' ELSE 'ORDER' END AS class, count(*) AS n FROM b GROUP BY 1""")
def classify_customers(t: Tables) -> DataFrame:
    """Customers' orders as facts, and a text that speaks for one class or none."""
    rows = t.orders.groupBy("o_custkey").agg(F.count("*").alias("dates"), F.count(F.when(F.col("o_totalprice") > 150000, 1)).alias("amounts"))
    key = F.col("o_custkey")
    counts = {"AMOUNT": F.col("amounts"), "DATE": F.col("dates"), "PAYMENT_APP": F.when(key % 2 == 0, 1).otherwise(0), "STATUS": F.lit(1), "PNR": F.when(key % 3 == 0, 1).otherwise(0)}
    said = F.element_at(F.array(*[F.lit(x) for x in ("", "Closing balance", "Train no 1", "Government of India 1234 5678 9012", "Tax invoice")]), (key % 5).cast("int") + 1)
    return rows.groupBy(facts.document_class(counts, said).alias("c")["class"].alias("class")).agg(F.count("*").alias("n"))


@query("X17 J13 A2", """WITH a(alias, canonical) AS (VALUES ('building', 'B'), ('machinery', 'M'), ('house-hold', 'H'), ('autmobile', 'A')), d AS (SELECT DISTINCT c_mktsegment AS name FROM customer),
    s AS (SELECT name, canonical, CASE WHEN lower(name) = alias THEN 0.98 WHEN lower(name) = replace(alias, '-', '') THEN 0.96 WHEN length(name) >= 6 THEN 1 - levenshtein(lower(name), replace(alias, '-', '')) / greatest(length(name), length(replace(alias, '-', ''))) ELSE 0 END AS c FROM d, a),
    b AS (SELECT name, max(c) AS c, arg_max(canonical, c) AS canonical FROM s GROUP BY 1)
    SELECT name AS c_mktsegment, CASE WHEN c >= 0.9 THEN 'RESOLVED' WHEN c >= 0.8 THEN 'CANDIDATE' ELSE 'UNRESOLVED' END AS decision, CASE WHEN c >= 0.8 THEN canonical END AS canonical FROM b""")
def resolve_entities(t: Tables) -> DataFrame:
    aliases = t.spark.createDataFrame([("building", "B"), ("machinery", "M"), ("house-hold", "H"), ("autmobile", "A")], "alias string, canonical string")
    return facts.resolved(t.customer, "c_mktsegment", aliases)


ACTION_TEXT = "Call +91 98765 43210, flight 6E123 and EK77, Order: AB12345, pan ABCDE1234F, to a.b@okaxis or mail@example.com: Rs 1,200.50 see https://x.in/a?b=1 "
ACTION_VALUES = [("Phone", "+919876543210"), ("URL", "https://x.in/a?b=1"), ("Email", "mail@example.com"), ("Flight", "6E123"), ("Flight", "EK77"), ("OrderId", "AB12345"), ("UPI", "a.b@okaxis"), ("UPI", "mail@example"), ("PAN", "ABCDE1234F"), ("Amount", "Rs1,200.50")]


@query("X40", "WITH v(label, value) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ACTION_VALUES) + ") SELECT o_orderkey, label, value FROM orders, v UNION ALL SELECT o_orderkey, 'OrderId', 'ZZ-' || (o_orderkey + 1000) FROM orders")
def detect_actions(t: Tables) -> DataFrame:
    """A message for each order with all that can be acted on; its e-mail address reads as a payment address, too."""
    text = F.concat(F.lit(ACTION_TEXT), F.lit("booking ZZ-"), (F.col("o_orderkey") + 1000).cast("string"))
    return t.orders.select("o_orderkey", F.explode(facts.actions(text)).alias("a")).select("o_orderkey", "a.label", "a.value")


@query("X40", r"""WITH m AS (SELECT doc_id, 'Email' AS label, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}')) AS value FROM documents UNION ALL SELECT doc_id, 'URL', unnest(regexp_extract_all(text, 'https?://[^\s]+')) FROM documents) SELECT DISTINCT doc_id, label, value FROM m""")
def mail_and_addresses(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.explode(facts.actions(F.col("text"))).alias("a")).select("doc_id", "a.label", "a.value")
    return rows.where(F.col("label").isin("Email", "URL"))


# -- rules and layout ----------------------------------------------------------------------------------------------


FAILURES = [
    ("UNSUPPORTED", [], [], "notes.DOCXML9000", "NOT_A_DOCUMENT", "docxml90"),
    ("EMPTY", [], [], "a.pdf", "NO_TEXT", None),
    ("READ", ["IOException", "OutOfMemoryError"], ["x", None], "a.pdf", "TOO_BIG", None),
    ("READ", ["InvalidPasswordException"], ["no"], "a.pdf", "LOCKED", None),
    ("READ", ["IOException"], ["Cannot open the Password store"], "a.pdf", "LOCKED", None),
    ("READ", ["FileNotFoundException"], ["gone"], "a.pdf", "FILE_GONE", None),
    ("READ", ["IOException"], ["write failed: ENOSPC"], "a.pdf", "NO_SPACE", None),
    ("READ", ["RuntimeException", "ZipException"], ["a", "b"], "a.pdf", "DAMAGED", None),
    ("READ", ["IOException"], ["Missing root object"], "a.pdf", "DAMAGED", None),
    ("READ", ["IOException"], ["  odd thing\nmore"], "a.pdf", "OTHER", "odd thing"),
    ("STORE", ["IOException"], ["password"], "a.pdf", "OTHER", "password"),
    ("STORE", ["SQLiteFullException"], [""], "a.pdf", "NO_SPACE", None),
    ("STORE", ["SecurityException"], [""], "a.pdf", "FILE_GONE", None),
    ("STORE", ["OddException"], [""], "a.pdf", "OTHER", "OddException"),
]


@query("X52", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}', {repr(d) if d else 'NULL'}, {repr(rules.IMPORT_WORDS[f]) if f in rules.IMPORT_WORDS else 'NULL'})" for i, (*_, f, d) in enumerate(FAILURES)) + ") v(id, failure, detail, words)")
def import_failures(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(i, *x[:4]) for i, x in enumerate(FAILURES)], "id int, stage string, errors array<string>, said array<string>, file string")
    rows = rows.select("id", rules.import_failure(F.col("stage"), F.col("errors"), F.col("said"), F.col("file")).alias("f"))
    return rows.select("id", "f.failure", "f.detail", rules.failure_words(F.col("f.failure")).alias("words"))


HOSTS = {"www.instagram.com": "Instagram", "fb.watch": "Facebook", "x.com": "X", "notx.com": None, "old.reddit.com": "Reddit", "www.amazon.co.uk": "Amazon", "a.co": "Amazon", "dl.flipkart.com": "Flipkart", "t.me": "Telegram", "wa.me": "WhatsApp", "T.CO": "X", "threads.net": "Threads"}


@query(
    "X46",
    "WITH h(i, host, platform) AS (VALUES " + ", ".join(f"({i}, '{h}', {repr(x) if x else 'NULL'})" for i, (h, x) in enumerate(HOSTS.items())) + f") SELECT page_id, platform FROM pages JOIN h ON page_id % {len(HOSTS) + 1} = i UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % {len(HOSTS) + 1} = {len(HOSTS)}",
)
def open_platforms(t: Tables) -> DataFrame:
    """The platform of each page's host, after some hosts were put in place of its own."""
    hosts = F.array(*[F.lit(h) for h in HOSTS])
    own = F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)
    host = F.coalesce(F.try_element_at(hosts, (F.col("page_id") % (len(HOSTS) + 1)).cast("int") + 1), own)
    return t.pages.select("page_id", rules.platform(host).alias("platform"))


@query(
    "X36",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice >= 20000 THEN 'timeout_capped' WHEN l_quantity / 4 >= 8 THEN 'extremely_large_bitmap' WHEN l_partkey * 20 >= 3000 THEN 'dense_text' WHEN l_discount < 0.1 THEN 'low_contrast_or_noise' ELSE 'other' END AS cause,
    CASE WHEN l_extendedprice > 3000 THEN 'ocr,' ELSE '' END || CASE WHEN l_quantity * 10 > 300 THEN 'strip,' ELSE '' END || CASE WHEN l_tax * 10000 > 500 THEN 'render,' ELSE '' END || CASE WHEN l_extendedprice > 5000 THEN 'total,' ELSE '' END AS late FROM lineitem""",
)
def outliers(t: Tables) -> DataFrame:
    """Lines as pages: price for milliseconds, quantity for size, discount for trust."""
    c = F.col
    late = rules.over_limits({"ocr": c("l_extendedprice"), "strip": c("l_quantity") * 10, "render": c("l_tax") * 10000, "total": c("l_extendedprice")})
    return t.lineitem.select("l_orderkey", "l_linenumber", rules.outlier(c("l_quantity") / 4, c("l_extendedprice"), c("l_discount"), c("l_partkey") * 20).alias("cause"), F.array_join(F.transform(late, lambda x: F.concat(x, F.lit(","))), "").alias("late"))


@query(
    "O8",
    """WITH RECURSIVE b AS (SELECT l_orderkey AS k, l_linenumber AS tie, l_quantity AS t, l_extendedprice AS l, CAST(4 + 4 * l_linenumber AS DOUBLE) AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice, l_linenumber) AS n FROM lineitem),
    r AS (SELECT k, n, t, l, tie, t AS ft, h AS fh, 1 AS row FROM b WHERE n = 1
    UNION ALL SELECT b.k, b.n, b.t, b.l, b.tie, CASE WHEN b.t - r.ft > 0.5 * least(r.fh, b.h) THEN b.t ELSE r.ft END, CASE WHEN b.t - r.ft > 0.5 * least(r.fh, b.h) THEN b.h ELSE r.fh END, r.row + CASE WHEN b.t - r.ft > 0.5 * least(r.fh, b.h) THEN 1 ELSE 0 END FROM r JOIN b ON b.k = r.k AND b.n = r.n + 1)
    SELECT k AS l_orderkey, tie AS l_linenumber, row, row_number() OVER (PARTITION BY k ORDER BY row, l, t, tie) AS place FROM r""",
)
def reading_order(t: Tables) -> DataFrame:
    """Lines as blocks of a page: quantity from the top, price from the left."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (4 + 4 * F.col("l_linenumber")).alias("h"))
    return layout.reading_order(rows, ["l_orderkey"], "l_quantity", "l_extendedprice", "h", "l_linenumber")


@query(
    "W9",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_linenumber * 1000000 + l_partkey AS o, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(l_partkey / 60) AS BIGINT) END AS page, row_number() OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY o)),
    c AS (SELECT *, first_value(page) OVER w AS fp, CASE WHEN n > 1 AND lag(page) OVER w IS NOT DISTINCT FROM page THEN 0 ELSE 1 END AS change FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY o))
    SELECT l_orderkey, l_linenumber, CASE WHEN fp IS NULL THEN CAST(floor((n - 1) / 6) AS BIGINT) + 1 ELSE CAST(sum(change) OVER (PARTITION BY l_orderkey ORDER BY o) AS BIGINT) END AS unit FROM c""",
)
def tag_units(t: Tables) -> DataFrame:
    """Lines as pieces of an order, a third of the orders without pages."""
    page = F.when(F.col("l_orderkey") % 3 != 0, F.floor(F.col("l_partkey") / 60))
    return layout.units(t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("o"), page.alias("page")), "l_orderkey", "o", "page").select("l_orderkey", "l_linenumber", "unit")


@query(
    "W15",
    """WITH RECURSIVE b AS (SELECT l_orderkey AS k, CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity + l_linenumber AS BIGINT) AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS BIGINT), CAST(l_quantity + l_linenumber AS BIGINT)) AS n FROM lineitem),
    r AS (SELECT k, n, a, b, 1 AS band FROM b WHERE n = 1 UNION ALL SELECT x.k, x.n, CASE WHEN x.a - r.b <= 3 AND x.b - r.a <= 15 THEN r.a ELSE x.a END, x.b, r.band + CASE WHEN x.a - r.b <= 3 AND x.b - r.a <= 15 THEN 0 ELSE 1 END FROM r JOIN b x ON x.k = r.k AND x.n = r.n + 1)
    SELECT k AS l_orderkey, a, arg_max(b, n) AS b FROM r GROUP BY k, band, a""",
)
def merged_bands(t: Tables) -> DataFrame:
    """Lines as bands of ink: from the quantity, as high as the line's number."""
    rows = t.lineitem.select("l_orderkey", F.col("l_quantity").cast("long").alias("a"), (F.col("l_quantity") + F.col("l_linenumber")).cast("long").alias("b"))
    return layout.merged_bands(rows, ["l_orderkey"], "a", "b", 3, 15)


@query(
    "W8",
    """WITH RECURSIVE l AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS n, count(*) OVER (PARTITION BY l_orderkey) AS matched FROM lineitem),
    c AS (SELECT l_orderkey, n, a, matched, 1 AS run FROM l UNION SELECT c.l_orderkey, l.n, l.a, l.matched, run + 1 FROM c JOIN l ON l.l_orderkey = c.l_orderkey AND l.n > c.n AND l.a > c.a)
    SELECT l_orderkey, matched, max(run) AS run FROM c GROUP BY 1, 2""",
)
def lines_in_order(t: Tables) -> DataFrame:
    """Lines in their order, with the quantity as the place where each was found."""
    return layout.longest_run(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], "l_linenumber", "l_quantity")


def _places_sql(word: str) -> str:
    return f"SELECT doc_id, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * {len(word)} AS BIGINT) AS start, {len(word)} AS n, i, many FROM (SELECT doc_id, unnest(cut) AS piece, unnest(range(1, len(cut) + 1)) AS i, len(cut) AS many FROM (SELECT doc_id, string_split(lower(text), '{word}') AS cut FROM documents))"


@query(
    "R34",
    f"""WITH m AS (SELECT doc_id, start, start + n AS stop FROM (SELECT * FROM ({_places_sql("public")}) UNION ALL SELECT * FROM ({_places_sql("blic lic")})) WHERE i < many),
    o AS (SELECT *, CASE WHEN max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS opens FROM m),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS grp FROM o)
    SELECT doc_id, min(start) AS start, max(stop) AS "end" FROM g GROUP BY doc_id, grp""",
)
def marked_words(t: Tables) -> DataFrame:
    """Stretches to mark of a word and of one that overlaps it."""
    return rules.marks(t.documents, "doc_id", "text", ["public", "blic lic"]).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    "R34 R8",
    r"""SELECT term, levenshtein(term, 'licanse') AS distance FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS term FROM documents) WHERE length(term) >= 3 AND abs(length(term) - 7) <= 2 AND regexp_matches(term, '^[a-z]+$') AND levenshtein(term, 'licanse') <= 2 ORDER BY distance, term LIMIT 1""",
)
def similar_word(t: Tables) -> DataFrame:
    from loamdex.plans.lexical_queries import index

    return rules.similar_word(index(t).vocabulary().where("term rlike '^[a-z]+$'"), "licanse").select("term", F.col("distance").cast("long").alias("distance"))


# -- reading queries -----------------------------------------------------------------------------------------------


@query("X11 X12 X13 F2 S4", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' AND event_type = 'click' AND ts >= TIMESTAMP '2024-01-10'")
def planned_query_events(t: Tables) -> DataFrame:
    plan = reading.plan("clicks this month type:click after:2024-01-10", now="2024-01-31")
    return t.events.where(reading.time_predicate(plan, F.col("ts")) & reading.type_predicate(plan, F.col("event_type"))).select("event_id")


@query("X10 X13 F4", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 90000 AND 110000")
def planned_query_amounts(t: Tables) -> DataFrame:
    plan = reading.plan("orders around rs 1 lakh", now="2024-01-31")
    return t.orders.where(reading.amount_predicate(plan, F.col("o_totalprice"))).select("o_orderkey")


READINGS = [
    ("find the bill from last month", "SEARCH", "2023-12-01", "2024-01-01"),
    ("how much did I pay this year", "EXTRACT", "2024-01-01", "2025-01-01"),
    ("explain the report of march 2022", "REASON", "2022-03-01", "2022-04-01"),
    ("yesterday", "SEARCH", "2024-01-30", "2024-01-31"),
    ("parso ka bill", "SEARCH", "2024-01-29", "2024-01-30"),
    ("पिछले साल का बिल", "SEARCH", "2023-01-01", "2024-01-01"),
    ("kal milega", "SEARCH", None, None),
    ("do hafte pehle ki photo", "SEARCH", "2024-01-15", "2024-01-22"),
    ("notes of last month and this week", "SEARCH", "2024-01-29", "2024-02-05"),
    ('"last month" memo', "SEARCH", None, None),
    ("bill of 3 may", "SEARCH", "2023-05-01", "2023-06-01"),
    ("may I see this", "SEARCH", None, None),
]


@query("R36 X11", "SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{k}', {repr(a) if a else 'NULL'}, {repr(b) if b else 'NULL'})" for q, k, a, b in READINGS) + ") v(query, tier, since, until)")
def query_tiers(t: Tables) -> DataFrame:
    """What questions are read as on 31 January 2024, a Wednesday: the later of two periods counts, quoted words are words."""
    day = lambda p: [x.strftime("%Y-%m-%d") for x in p] if p else [None, None]
    rows = [(q, reading.tier(q), *day(reading.plan(q, now="2024-01-31").period)) for q, *_ in READINGS]
    return t.spark.createDataFrame(rows, "query string, tier string, since string, until string")


@query("X10", "SELECT 'around rs 1 lakh' AS said, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 90000 AND 110000 UNION ALL SELECT '1 lakh se 2 lakh tak', count(*) FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 UNION ALL SELECT '3 लाख से ज्यादा', count(*) FROM orders WHERE o_totalprice >= 300000 UNION ALL SELECT '50 hazaar se kam', count(*) FROM orders WHERE o_totalprice BETWEEN 0 AND 50000 UNION ALL SELECT 'lagbhag 2,00,000', count(*) FROM orders WHERE o_totalprice BETWEEN 180000 AND 220000")
def amounts_in_two_languages(t: Tables) -> DataFrame:
    said = ["around rs 1 lakh", "1 lakh se 2 lakh tak", "3 लाख से ज्यादा", "50 hazaar se kam", "lagbhag 2,00,000"]
    tests = [reading.amount_predicate(reading.plan(x, now="2024-01-31"), F.col("o_totalprice")) for x in said]
    counts = t.orders.agg(*[F.count(F.when(x, 1)).alias(f"n{i}") for i, x in enumerate(tests)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(x).alias("said"), F.col(f"n{i}").alias("n")) for i, x in enumerate(said)])).alias("x")).select("x.*")


@query(
    "R38",
    "SELECT * FROM (VALUES ('ocr pdf', 'ocr pdf Optical Character Recognition Portable Document Format', TRUE, 'OCR = optical character recognition;PDF = portable document format'), ('amazon receipt', 'amazon receipt', FALSE, ''), (' my GPU ', 'my GPU Graphics Processing Unit', TRUE, 'GPU = graphics processing unit')) v(query, expanded, known, understood)",
)
def acronyms(t: Tables) -> DataFrame:
    rows = []
    for q in ("ocr pdf", "amazon receipt", " my GPU "):
        a = reading.analysed(q)
        rows.append((q, reading.expanded(q), a["known"], ";".join(a["understood"])))
    return t.spark.createDataFrame(rows, "query string, expanded string, known boolean, understood string")


@query("X45", "SELECT o_orderkey, strftime(o_orderdate - to_months(CAST(o_orderkey % 5 AS INT)), '%Y-%m') AS month FROM orders")
def month_tokens(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.date_format(F.add_months("o_orderdate", -(F.col("o_orderkey") % 5).cast("int")), "yyyy-MM").alias("month"))


FOLD_SQL = "lower(word)"
for _many, _one in sp.FOLDS:
    FOLD_SQL = f"replace({FOLD_SQL}, '{_many}', '{_one}')"


@query(
    "R39",
    f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), f AS (SELECT word, {FOLD_SQL} AS k FROM w), d AS (SELECT word, {"regexp_replace(" * 20}k{"".join(f", '{c}+', '{c}', 'g')" for c in "bcdfghjklmnprstvxkqz")} AS k FROM f)
    SELECT word, CASE WHEN length(k) > 3 AND regexp_matches(k, '[aeiou]h$') THEN regexp_replace(k, 'h$', '') ELSE k END AS key FROM d""",
)
def folded_words(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", sp.folded(F.col("word")).alias("key"))


WORDS_IN_LATIN = {"नमस्ते": "namaste", "बिजली": "bijlee", "किताब": "kitaab", "राम": "raam", "हिंदी": "hindee", "कमल": "kamal", "समझना": "samajhnaa", "प्रदेश": "pradesh", "दुःख": "duhkh", "अगर": "agar", "न": "na", "औरत": "aurat", "ज़मीन": "jameen", "ऋषि": "rishi"}


@query("R39", "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{x}')" for w, x in WORDS_IN_LATIN.items()) + ") v(word, latin)")
def romanised_words(t: Tables) -> DataFrame:
    words = t.spark.createDataFrame([(w,) for w in WORDS_IN_LATIN], "word string")
    return words.select("word", sp.romanised(F.col("word")).alias("latin"))


@query("R39 R2", "SELECT * FROM (VALUES (1, 'bijli bil', 3), (2, 'bijli ghar bil', 1), (3, 'ghar', 0), (4, '', 0), (5, 'bijli ka bil', 3)) v(id, shadows, run)")
def shadow_runs(t: Tables) -> DataFrame:
    """Keys of what is written, and how long a run of "bijli ka bill" stands there; the small word may be missing, and counts."""
    rows = t.spark.createDataFrame([(1, "बिजली बिल 2024"), (2, "बिजली घर बिल"), (3, "घर"), (4, "no such word"), (5, "बिजली का बिल")], "id int, said string")
    typed = {"bijli": "bijli", "ka": "ka", "bill": "bil"}
    return rows.select("id", F.array_join(sp.shadows(F.col("said")), " ").alias("shadows"), sp.spelled_run(F.col("said"), list(typed), typed, ["ka"]).alias("run"))


@query(
    "X39",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderkey * 9973 AS VARCHAR) AS s FROM orders), k AS (SELECT o_orderkey, s, list_filter(range(1, length(s) + 1), lambda i: s[i] <> '0' AND (i = 1 OR s[i] <> s[i - 1])) AS spots FROM o),
    u AS (SELECT o_orderkey, unnest(spots) AS i, s FROM k), d AS (SELECT o_orderkey, i, s[i] AS d, (10.0 + CAST(s[i] AS INT)) / 20 AS score, sum(CASE WHEN s[i] = '9' THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderkey ORDER BY i) AS word FROM u),
    w AS (SELECT o_orderkey, min(m) AS weakest FROM (SELECT o_orderkey, word, avg(score) AS m FROM d WHERE d <> '9' GROUP BY 1, 2) GROUP BY 1)
    SELECT k.o_orderkey, array_to_string(list_transform(spots, lambda i: CASE WHEN s[i] = '9' THEN ' ' ELSE chr(96 + CAST(s[i] AS INT)) END), '') AS text, round(coalesce(list_sum(list_transform(spots, lambda i: (10.0 + CAST(s[i] AS INT)) / 20)) / len(spots), 0), 6) AS confidence,
    round(coalesce(weakest, 0), 6) AS weakest FROM k LEFT JOIN w ON w.o_orderkey = k.o_orderkey""",
)
def reader_steps(t: Tables) -> DataFrame:
    """The digits of each order's key, times 9973, as a reader's classes: 0 the blank one, 9 a blank of the text."""
    best = F.transform(F.split((F.col("o_orderkey") * 9973).cast("string"), r"(?!^)(?!\z)"), lambda c: c.cast("int"))
    letters = F.array(*[F.lit(" " if i == 9 else chr(96 + i)) for i in range(1, 10)])
    rows = t.orders.select("o_orderkey", sp.ctc_text(best, F.transform(best, lambda c: (c + 10) / F.lit(20.0)), letters).alias("r"))
    return rows.select("o_orderkey", "r.text", F.round("r.confidence", 6).alias("confidence"), F.round("r.weakest", 6).alias("weakest"))


@query("X34 X37")
def merged_readings(t: Tables) -> DataFrame:
    """Three readings of each conversation's turns, two of them with misread letters, put together again."""
    # dealt before the readings are made of it, so the text travels once
    rows = t.conversations.select("conv_id", "turn", F.regexp_replace("text", r"\s+", " ").alias("text")).repartition("conv_id")
    misread = [F.struct(F.lit(n).alias("reading"), sp.misread(F.col("text"), F.concat_ws("/", F.lit(str(n)), "conv_id", "turn"), 30 * n).alias("text")) for n in (1, 2)]
    readings = rows.select("conv_id", "turn", F.explode(F.array(F.struct(F.lit(0).alias("reading"), "text"), *misread)).alias("r")).select("conv_id", "turn", "r.reading", "r.text")
    return sp.merged_readings(readings, "conv_id", "reading", "turn", "text").groupBy("conv_id").agg(F.count("*").alias("lines"), F.max("seen_by").alias("most"))


@query("R35")
def direct_answers(t: Tables) -> DataFrame:
    return an.answers(t.documents, "doc_id", "text", "which version of the general public license").orderBy(F.desc("words"), "doc_id").limit(20)
