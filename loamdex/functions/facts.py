"""Facts, metadata, tags and classes read from text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of amounts, identifiers, phones, dates and parties.
NUMBER = r"(\d{1,3}(?:,\d{2,3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)"
SCALE = r"(?:\s*(lakh|lakhs|lac|crore|crores|cr|हज़ार|हजार|लाख|करोड़))?"
LABELS = (
    "total|net amount payable|net amount|amount payable|amount paid|amount|net pay|fare|total fare|fare paid|premium paid|premium|closing balance|balance|total received|grand total|payable|price|"
    "देय राशि|कुल देय राशि|कुल|राशि"
)
LABELLED_AMOUNT = rf"(?i)(?:{LABELS})\s*(?:\(?(?:rs\.?|inr|₹)\)?)?\s*[:\-]?\s*(?:rs\.?|inr|₹)?\s*{NUMBER}{SCALE}"
CURRENCY_AMOUNT = rf"(?i)(?:₹|\brs\.?|\binr\b|रु\.?)\s*{NUMBER}{SCALE}"
GROUPED_AMOUNT = r"(?<![\d,.])\d{1,3}(?:,\d{2})*,\d{3}\.\d{2}(?![\d,])"
PHONE = r"(?<!\d)(?:\+91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?!\d)"
DATE_NUMERIC = r"(?<!\d)(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})(?!\d)"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DATE_WORDS = r"(?i)(?<!\d)(\d{1,2})\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?,?\s+(\d{4})(?!\d)"
LABELLED_ID = (
    r"(?i)(?:pnr|booking reference(?: \(pnr\))?|policy number|policy no\.?|consumer no\.?|consumer number|account|customer id|order id|booking id|ticket no|receipt no\.?|bill no|upi transaction id|"
    r"transaction id|serial number|serial|dl no|invoice|tax invoice|code|उपभोक्ता क्रमांक|कनेक्शन संख्या|पहचान संख्या|लेनदेन आईडी)\s*[:#]?\s*(?:\(pnr\)\s*)?([A-Z0-9][A-Z0-9-]{3,24}(?: [0-9]{4}){0,2})"
)
PARTIES = (r"(?i)(?:paid to|sent to|received from)\s+([A-Z][\w.&' ]{2,50}?)(?:\n|$|,)", r"(?:^|\n)([^\n]{3,50}?) को भेजा गया")
ORGANISATION = (
    r"(?i)\b(?:ltd|limited|pvt|store|stores|bank|pharmacy|medical|restaurant|hotel|cafe|insurance|airlines|travels|telecom|broadband|fibre|school|college|university|hospital|clinic|cinemas|supermart|mart|services|"
    r"corporation|nigam|petroleum|electricals|dairy|hardware)\b|निगम|विभाग|बैंक"
)
FACTORS = {"lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "लाख": 1e5, "crore": 1e7, "crores": 1e7, "cr": 1e7, "करोड़": 1e7, "हज़ार": 1e3, "हजार": 1e3}
# What can be done with a text.
ACTIONS = {
    "Phone": r"(?<![a-zA-Z0-9])(?:\+91[\s\-]?)?[6-9][\d\s\-]{8,13}(?<!\s)(?![a-zA-Z0-9])",
    "URL": r"https?://[^\s]+",
    "Email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "Flight": r"(?<![A-Z0-9])(?:AI|6E|SG|UK|G8|QP|IX|I5|S5|YB|YS|IG|HR|OG|ZO|AA|UA|DL|BA|EK|QR|TK|LH|AF|KL|SQ|CX|MH|TG|NH|JL|OZ|KE|CA|MU|CZ|FM)[0-9]{1,4}(?![A-Z0-9])",
    "OrderId": r"(?i)(?:order|booking|ref)[\s#:]+([A-Z0-9\-]{6,20})",
    "UPI": r"(?i)(?:upi://pay\?pa=)?([a-zA-Z0-9.\-_]{2,}\s?@\s?[a-zA-Z0-9]{2,})",
    "PAN": r"[A-Z]{5}[0-9]{4}[A-Z]",
    "Amount": r"(?:Rs\.?|₹)\s?[\d,]+(?:\.\d{2})?",
}
# What speaks for a kind of item.
_AMOUNT = r"(?i)(?:₹|\brs\.?|\binr\b)\s*\d[\d,]*(?:\.\d{1,2})?"
_REFERENCE = r"(?i)\b(?:transaction|txn|upi|utr|reference|ref|order)\s*(?:id|no|number|ref|reference)?\.?\s*[:#-]?\s*(?=[a-z0-9-]*\d)[a-z0-9][a-z0-9-]{7,}\b"
_PAID = r"(?i)\b(?:paid|payment|debited|credited|received|sent|transferred)\b"
_CHANNEL = r"(?i)\b(?:upi|neft|imps|rtgs|vpa|gpay|google pay|phonepe|paytm|bhim|amazon pay|net ?banking)\b"
_PAYMENT_TITLE = r"(?i)\b(?:payment (?:receipt|confirmation|successful|received|completed)|transaction (?:receipt|successful|completed)|paid successfully|money (?:sent|received))\b"
_BILL_LINE = r"(?i)\b(?:tax invoice|invoice (?:no|number|date)|bill (?:no|number|date|to)|billed to|amount due|total due|balance due|gstin|receipt (?:no|number)|cash memo|grand total|sub ?total)\b"
_OTP_WORDS = r"(?:\botp\b|one[- ]time (?:password|passcode|pin|code)|verification code|security code)"
_CODE = r"(?<!\d)(?:\d{5,8}|(?!19|20)\d{4})(?!\d)"
_OTP = rf"(?i){_OTP_WORDS}[^\n]{{0,40}}?{_CODE}|{_CODE}[^\n]{{0,40}}?{_OTP_WORDS}"
_CALL = r"(?i)(?:\b(?:call|phone|mobile|mob|ph|tel|contact|whatsapp|helpline)\b[^\n\d]{0,20}(?:\+91[\s-]?|0)?|\+91[\s-]?)[6-9]\d{4}[\s-]?\d{5}(?!\d)"
_MARKS = r"(?i)\b(?:cgpa|sgpa|grade point|mark ?sheet|statement of marks|grade card|marks obtained|max(?:imum|\.)? marks|total marks)\b"
_STUDENT = r"(?i)\b(?:roll (?:no|number)|enrol?lment (?:no|number)|registration (?:no|number)|seat (?:no|number)|name of (?:the )?student|student name|candidate)\b"
_PRESCRIPTION, _DOSE, _MEDICINE = r"(?i)\b(?:prescription|rx)\b|℞", r"(?i)\b\d+(?:\.\d+)?\s?(?:mg|ml|mcg|iu)\b", r"(?i)\b(?:tablets?|tab|capsules?|syrup|injection|ointment|drops)\b"
_RESUME_HEADING, _RESUME = r"(?i)\b(?:curriculum vitae|bio[- ]?data)\b", r"(?i)\b(?:resume|résumé)\b"
_RESUME_SECTIONS = ("experience", "education", "skills", "objective", "projects", "certifications?", "internships?", "achievements", "date of birth", "languages", "references", "declaration", "hobbies")
_AGREEMENT = r"(?i)\b(?:agreement|contract|deed|memorandum of understanding)\b"
_LEGAL = ("hereinafter", "whereas", "witnesseth", "party of the first part", "first party", "second party", "lessor", "lessee", "licensor", "licensee", "landlord", "tenant", "in witness whereof", "terms and conditions")
#: The tags of a kind, of a document's type, and a product's number.
KIND_TAGS = {
    "PAYMENT": "payment receipt transaction",
    "BILL": "invoice bill receipt",
    "OTP": "otp verification code",
    "PHONE": "phone number contact",
    "MARKSHEET": "marksheet result academic",
    "PRESCRIPTION": "prescription medical",
    "RESUME": "resume cv",
    "AGREEMENT": "agreement contract legal",
}
TYPE_TAGS = {"PDF": "pdf document", "WORD": "word document", "EXCEL": "spreadsheet excel", "EPUB": "ebook epub"}
PRODUCT_NUMBER = r"^(?:\d{8}|\d{12,14})$"
CLASSES = {"PAYMENT_RECEIPT": "PAYMENT", "BANK_STATEMENT": "FINANCE", "TRAIN_TICKET": "TICKET", "AADHAAR": "IDENTITY", "INVOICE": "ORDER"}
LEAST_SCORE = 80


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def amount(digits: Column, scale: Column | None = None) -> Column:
    """A written amount with its scale word, above 0 and below 10**12, to two places; null else."""
    value = F.regexp_replace(digits, ",", "").try_cast("double")
    if scale is not None:
        table = F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv])
        value = value * F.coalesce(F.try_element_at(table, F.lower(scale)), F.lit(1.0))
    return F.when((value > 0) & (value < 1e12), F.floor(value * 100 + 0.5) / 100)


def date_of(day: Column, month: Column, year: Column) -> Column:
    """A date of the years 1950 to 2100 if the month has the day; null else."""
    good = month.between(1, 12) & year.between(1950, 2100) & (day >= 1)
    first = F.when(good, F.make_date(year, F.when(good, month).otherwise(1), F.lit(1)))
    return F.when(good & (day <= F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))


def _month(word: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substr(word, F.lit(1), F.lit(3)))).cast("int")


def facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, value, number, trust): amounts, phones, identifiers, dates, parties and the kinds of item that a text is.

    Of overlapping amounts the better trusted stays: a currency amount is dropped where a labelled one has the same digits, a grouped one where any has.
    """
    text = F.col(text_col)
    pair = lambda p: F.zip_with(matches(text, p, 1), matches(text, p, 2), lambda d, s: F.struct(d.alias("said"), amount(d, s).alias("number")))
    plain = F.transform(matches(text, GROUPED_AMOUNT), lambda d: F.struct(d.alias("said"), amount(d).alias("number")))
    say = lambda a, trust: F.transform(a, lambda x: F.struct(F.lit("AMOUNT").alias("kind"), x["said"].alias("value"), x["number"].alias("number"), F.lit(trust).alias("trust")))
    rows = docs.select(id_col, text_col, pair(LABELLED_AMOUNT).alias("a"), pair(CURRENCY_AMOUNT).alias("b"), plain.alias("c"))
    unlike = lambda xs, *others: reduce(lambda out, o: F.filter(out, lambda x: ~F.exists(o, lambda y: y["said"] == x["said"])), others, xs)
    text_fact = lambda values, kind, trust: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(None).cast("double").alias("number"), F.lit(trust).alias("trust")))
    phones = F.filter(F.transform(matches(text, PHONE), lambda m: F.right(F.regexp_replace(m, r"\D", ""), F.lit(10))), lambda d: F.length(d) == 10)
    ids = F.filter(F.transform(matches(text, LABELLED_ID, 1), lambda v: F.upper(F.regexp_replace(v, r"[\s-]", ""))), lambda v: v.rlike(r"\d") & (F.length(v) >= 4))
    part = lambda m, p, n: F.regexp_extract(m, p, n)
    dates = F.filter(matches(text, DATE_NUMERIC), lambda m: date_of(*[part(m, DATE_NUMERIC, n).cast("int") for n in (1, 2, 3)]).isNotNull())
    said = F.filter(matches(text, DATE_WORDS), lambda m: date_of(part(m, DATE_WORDS, 1).cast("int"), _month(part(m, DATE_WORDS, 2)), part(m, DATE_WORDS, 3).cast("int")).isNotNull())
    parties = [F.filter(F.transform(F.slice(matches(text, p, 1), 1, 1), lambda v: F.regexp_replace(F.trim(v), r"[.,]+$", "")), lambda v: F.length(v).between(3, 60)) for p in PARTIES]
    line = F.trim(F.regexp_extract(text, r"^\s*([^\r\n]*\S[^\r\n]*)", 1))
    first = F.filter(F.array(line), lambda v: v.rlike(ORGANISATION) & (F.length(v) <= 60) & (F.length(F.regexp_replace(v, r"\D", "")) <= 2))
    every = F.concat(
        say(F.col("a"), 0.9), say(unlike(F.col("b"), F.col("a")), 0.8), say(unlike(F.col("c"), F.col("a"), F.col("b")), 0.5),
        text_fact(ids, "ID_NUMBER", 0.9), text_fact(phones, "PHONE", 0.7), text_fact(dates, "DATE", 0.8), text_fact(said, "DATE", 0.8),
        *[text_fact(v, "PARTY", 0.6) for v in parties], text_fact(first, "PARTY", 0.5), text_fact(F.transform(kinds(text), F.lower), "DOC_KIND", 0.6),
    )
    found = rows.select(id_col, F.explode(every).alias("f")).select(id_col, "f.kind", "f.value", "f.number", "f.trust")
    return found.where("kind <> 'AMOUNT' or number is not null")


def kinds(text: Column) -> Column:
    """What a text is, of eight kinds, by the evidence that each asks for; in order."""
    has = lambda p: text.rlike(p)
    count = lambda tests: reduce(lambda a, b: a + b, [F.when(x, 1).otherwise(0) for x in tests])
    word = lambda w: has(rf"(?i)\b(?:{w})\b")
    lines = F.size(F.array_distinct(F.transform(matches(text, _BILL_LINE), lambda m: F.lower(F.regexp_replace(m, r"\s+", " ")))))
    sections = count([word(w) for w in _RESUME_SECTIONS])
    evidence = {
        "PAYMENT": (has(_REFERENCE) | has(_PAYMENT_TITLE)) & (count([has(p) for p in (_REFERENCE, _PAYMENT_TITLE, _AMOUNT, _PAID, _CHANNEL)]) >= 3),
        "BILL": (lines >= 2) | ((lines == 1) & has(_AMOUNT)),
        "OTP": has(_OTP),
        "PHONE": has(_CALL),
        "MARKSHEET": has(_MARKS) & has(_STUDENT),
        "PRESCRIPTION": has(_PRESCRIPTION) & (has(_DOSE) | has(_MEDICINE)),
        "RESUME": (has(_RESUME_HEADING) & (sections >= 2)) | (has(_RESUME) & (sections >= 3)),
        "AGREEMENT": has(_AGREEMENT) & (count([word(w) for w in _LEGAL]) >= 2),
    }
    return F.filter(F.array(*[F.when(test, F.lit(k)) for k, test in evidence.items()]), lambda k: k.isNotNull())


def tags(text: Column, item_type: Column | None = None, codes: Column | None = None) -> Column:
    """The tags of a text: of its type, of the kinds it is, and of the codes read off it; each once, as one string."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    parts = []
    if item_type is not None:
        parts.append(F.split(F.coalesce(F.try_element_at(table(TYPE_TAGS), item_type), F.lit("")), " "))
    parts.append(F.split(F.array_join(F.transform(kinds(text), lambda k: F.element_at(table(KIND_TAGS), k)), " "), " "))
    if codes is not None:
        product = lambda c: F.trim(c).rlike(PRODUCT_NUMBER)
        qr = F.when(F.exists(codes, lambda c: ~product(c)), F.lit("qr code"))
        bar = F.when(F.exists(codes, product), F.lit("barcode"))
        upi = F.when(F.exists(codes, lambda c: F.lower(F.trim(c)).startswith("upi://")), F.lit("upi payment"))
        parts.append(F.split(F.concat_ws(" ", qr, bar, upi), " "))
    return F.array_join(F.filter(F.array_distinct(F.concat(*parts)), lambda t: t != ""), " ")


def metadata(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, type, value, confidence, source) of dates, amounts, payment addresses, source apps and the status; of equal values the surest."""
    text, low = F.col(text_col), F.lower(F.col(text_col))
    day = lambda m, p, y, a, b: F.when(F.regexp_extract(m, p, b).cast("int") > 12, date_of(F.regexp_extract(m, p, b).cast("int"), F.regexp_extract(m, p, a).cast("int"), F.regexp_extract(m, p, y).cast("int"))).otherwise(
        date_of(F.regexp_extract(m, p, a).cast("int"), F.regexp_extract(m, p, b).cast("int"), F.regexp_extract(m, p, y).cast("int"))
    )
    short, iso = r"\b(\d{1,2})[-/](\d{1,2})[-/](\d{4})\b", r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"
    dates = F.concat(F.transform(matches(text, short), lambda m: day(m, short, 3, 1, 2)), F.transform(matches(text, iso), lambda m: date_of(*[F.regexp_extract(m, iso, n).cast("int") for n in (3, 2, 1)])))
    dates = F.transform(F.filter(dates, lambda d: d.isNotNull()), lambda d: d.cast("string"))
    amounts = F.filter(F.transform(matches(text, r"(?i)(?:₹|Rs\.?|INR)\s*([\d,]+(?:\.\d{2})?)", 1), lambda v: F.regexp_replace(v, ",", "")), lambda v: v != "")
    apps = F.filter(F.array(*[F.when(F.contains(low, F.lit(a.lower())), F.lit(a)) for a in ("WhatsApp", "Telegram", "Instagram", "Chrome")]), lambda a: a.isNotNull())
    status = F.when(F.contains(low, F.lit("success")), "Success").when(F.contains(low, F.lit("failed")) | F.contains(low, F.lit("declined")), "Failed")
    said = lambda kind, values, sure, how: F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(sure).alias("confidence"), F.lit(how).alias("source")))
    every = F.concat(
        said("DATE", dates, 1.0, "regex"), said("AMOUNT", amounts, 0.8, "regex"), said("UPI", matches(text, r"[a-zA-Z0-9.\-_]{2,256}@[a-zA-Z]{2,64}"), 1.0, "regex"),
        said("SOURCE_APP", apps, 0.9, "dictionary"), said("STATUS", F.filter(F.array(status), lambda v: v.isNotNull()), 0.8, "heuristic"),
    )
    rows = docs.select(id_col, F.explode(every).alias("m"))
    return rows.groupBy(id_col, "m.type", "m.value").agg(F.max_by(F.struct("m.confidence", "m.source"), "m.confidence").alias("b")).select(id_col, "type", "value", "b.confidence", "b.source")


def healthy(text: Column, least_words: int) -> Column:
    """The text may be taken as it is: enough words, and nothing that makes it suspicious."""
    from loamdex.functions.text import trust

    return F.coalesce((F.size(matches(text, r"\S+")) >= least_words) & trust(text)["trusted"], F.lit(False))


def document_class(facts_of: dict[str, Column], text: Column) -> Column:
    """struct(type, class, score): additive evidence, the best type from LEAST_SCORE points on; facts_of: counts by metadata type."""
    low = F.lower(text)
    says = lambda *ws: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ws])
    points = lambda *tests: reduce(lambda a, b: a + b, [F.when(t, n).otherwise(0) for t, n in tests])
    amounts, dates = facts_of["AMOUNT"], facts_of["DATE"]
    scores = {
        "PAYMENT_RECEIPT": points((amounts > 0, 40), (facts_of["PAYMENT_APP"] > 0, 40), (facts_of["STATUS"] > 0, 20), ((amounts > 5) | (dates > 5), -50)),
        "BANK_STATEMENT": points((dates > 5, 40), (amounts > 5, 40), (says("closing balance", "opening balance"), 20)),
        "TRAIN_TICKET": points((facts_of["PNR"] > 0, 50), (says("train", "coach"), 40)),
        "AADHAAR": points((text.rlike(r"\b\d{4}\s\d{4}\s\d{4}\b"), 50), (says("government of india", "aadhaar"), 50)),
        "INVOICE": points((amounts > 0, 40), (says("tax invoice", "invoice no", "gstin"), 50)),
    }
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("i"), F.lit(k).alias("type"), F.lit(CLASSES[k]).alias("class")) for i, (k, s) in enumerate(scores.items())]))
    known = lambda b, c: F.when(b["score"] >= LEAST_SCORE, b[c]).otherwise("UNKNOWN")
    return F.transform(F.array(best), lambda b: F.struct(known(b, "type").alias("type"), known(b, "class").alias("class"), b["score"].alias("score")))[0]


def resolved(names: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Names against a short table of aliases (alias, canonical): equal, equal without marks, or by edit distance from six letters on.

    Distinct names are compared once; the alias table is broadcast (it is a fixed list).
    """
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", "")
    distinct = names.select(F.col(column).alias("name")).distinct().withColumn("n", norm(F.col("name")))
    table = F.broadcast(aliases.select("alias", "canonical", norm(F.col("alias")).alias("an")))
    longest = F.greatest(F.length("n"), F.length("an"))
    alike = F.when(F.lower(F.trim("name")) == F.col("alias"), 0.98).when(F.col("n") == F.col("an"), 0.96).when((F.length("n") >= 6), 1 - F.levenshtein("n", "an") / longest)
    scored = distinct.crossJoin(table).withColumn("confidence", alike)
    best = scored.groupBy("name").agg(F.max(F.struct(F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("canonical"))).alias("b"))
    decision = F.when(F.col("b.confidence") >= 0.9, "RESOLVED").when(F.col("b.confidence") >= 0.8, "CANDIDATE").otherwise("UNRESOLVED")
    return best.select(F.col("name").alias(column), decision.alias("decision"), F.when(F.col("b.confidence") >= 0.8, F.col("b.canonical")).alias("canonical"))


def actions(text: Column) -> Column:
    """What can be done with a text: array of (label, value), each value once; phones are Indian mobile numbers, with their country code."""

    def said(label: str, pattern: str) -> Column:
        whole = matches(text, pattern)
        if "([" in pattern:
            whole = F.zip_with(whole, matches(text, pattern, 1), lambda all_, part: F.when(F.trim(part) != "", part).otherwise(all_))
        values = F.transform(whole, lambda v: F.regexp_replace(v, r"\s", ""))
        if label == "Phone":
            digits = F.transform(values, lambda v: F.regexp_replace(v, "[^0-9]", ""))
            phone = lambda d: F.when((F.length(d) == 12) & d.startswith("91"), F.concat(F.lit("+"), d)).when(F.length(d) == 10, F.concat(F.lit("+91"), d)).when((F.length(d) == 11) & d.startswith("0"), F.concat(F.lit("+91"), F.substr(d, F.lit(2))))
            values = F.filter(F.transform(digits, phone), lambda v: v.isNotNull())
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))

    every = F.concat(*[said(k, p) for k, p in ACTIONS.items()])
    # of one value the first label stays
    return F.transform(F.array(every), lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, lambda y: y["value"]), x["value"]) == i + 1))[0]
