"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Found and validated: e-mail addresses, payment card numbers (Luhn), IBANs (remainder 97), IPv4 addresses, phone
numbers (8 to 15 digits, written with a plus or grouped), social security numbers, dates of the years 1900 to 2099
(year first, day first, and month first where that can't be a day), and hexadecimal secrets.  What fails its validation
stays as it is.

A value is replaced by a keyed permutation of all values of its format, a Feistel network of ROUNDS rounds: letters
become letters, digits digits, separators stay, check digits are made right again, dates become other real dates,
addresses addresses.  The key, the kind and the value alone decide, so equal values get equal pseudonyms in all
documents, and different values of one format different ones.  Country codes of phones and IBANs and the domains of
e-mail addresses stay.  In e-mail addresses letters and digits beyond ASCII move within their RANGES (by script, and by
case where scripts have it); those of none become ASCII letters, and there alone different values may meet.

Round functions are SHA-512 or SHA-256 of key, kind, round and the other half.

Nulls and odd cases: a null text stays null with no values found; an empty text stays empty; whole texts are searched,
however long; repeated rows give equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The places between two characters.
_EACH = r"(?!^)(?!\z)"

#: What may be private, by kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}+",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}(?!\.?[0-9])",
    "iso_date": r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?!-?[0-9])",
    "day_date": r"(?<![0-9./])[0-9]{2}(?<d>[./])[0-9]{2}\k<d>(?:19|20)[0-9]{2}(?![0-9]|[./][0-9])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}|\+[0-9]{8,15}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}(?<t>[.-])[0-9]{3}\k<t>[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?!-?[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?<c>[ -])[0-9]{4}\k<c>[0-9]{4}\k<c>[0-9]{1,7}|[0-9]{4}(?<e>[ -])[0-9]{6}\k<e>[0-9]{4,5})(?![0-9])",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without a digit and without an at sign holds nothing.
_MAY = "[0-9@]"

# 1900-01-01 to 2099-12-31: 73,049 days = 4,297 * 17
_FIRST_DAY, _A, _B = "1900-01-01", 4297, 17
# First and last code points of ranges that hold letters alone, or digits alone.
RANGES = (
    (0x00C0, 0x00D6), (0x00D8, 0x00DE), (0x00DF, 0x00F6), (0x00F8, 0x00FF), (0x0100, 0x017F), (0x0180, 0x01BA), (0x01C4, 0x024F), (0x0250, 0x0293),
    (0x0391, 0x03A1), (0x03A3, 0x03A9), (0x03B1, 0x03C9), (0x0400, 0x040F), (0x0410, 0x042F), (0x0430, 0x044F), (0x0450, 0x045F),
    (0x0531, 0x0556), (0x0561, 0x0587), (0x05D0, 0x05EA), (0x0620, 0x064A), (0x0660, 0x0669), (0x06F0, 0x06F9),
    (0x0904, 0x0939), (0x0966, 0x096F), (0x0995, 0x09A8), (0x09E6, 0x09EF), (0x0E01, 0x0E30), (0x0E50, 0x0E59), (0x10D0, 0x10FA), (0x1E00, 0x1EFF),
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A),
)
# month-first dates by days: 13 to 28; 29 to 31 but for 29 February; 29 February
_LATE_DAYS = [f"{m:02}{d}" for m in range(1, 13) for d in (29, 30, 31) if m != 2 and not (d == 31 and m in (4, 6, 9, 11))]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def _shifted(char: Column, by: Column, letters: int, wide: bool) -> Column:
    """The character moved on within its class: digits, lower-case or upper-case letters, and if ``wide`` those of RANGES; others stay."""
    code = F.ascii(char)
    moved = lambda low, n: F.char(F.lit(low) + (code - low + by) % n)
    out = F.when(code.between(48, 57), moved(48, 10)).when(code.between(97, 96 + letters), moved(97, letters)).when(code.between(65, 64 + letters), moved(65, letters))
    if wide:
        ranges = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b - a + 1).alias("size")) for a, b in RANGES])
        own = F.filter(ranges, lambda r: (code >= r["first"]) & (code < r["first"] + r["size"]))
        point = lambda c: F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), "UTF-32")
        inside = F.element_at(F.transform(own, lambda r: point(r["first"] + (code - r["first"] + by) % r["size"])), 1)
        out = out.when(code < 128, char).when(F.size(own) > 0, inside).when(char.rlike(r"[\p{L}\p{N}]"), F.char(F.lit(97) + by % 26))
    return out.otherwise(char)


def permuted(value: Column, key: str, kind: str, letters: int = 26, wide: bool = False) -> Column:
    """A keyed permutation of all strings of the value's format, character class by character class."""

    def moved(half: Column, other: Column, turn: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), F.length(half).cast("string"), other), 512)
        return _let(
            stream,
            lambda s: F.when(half == "", F.lit("")).otherwise(
                F.array_join(F.transform(F.split(half, _EACH), lambda c, j: _shifted(c, _number(F.substr(s, (j % 32) * 4 + 1, F.lit(4))), letters, wide)), "")
            ),
        )

    middle = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), middle).alias("a"), F.substr(value, middle + 1, F.length(value)).alias("b"))
    turns = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(turns, start, lambda s, i: F.struct(s["b"].alias("a"), moved(s["a"], s["b"], i).alias("b")), lambda s: F.concat(s["a"], s["b"]))


def permuted_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 to a*b-1."""
    hashed = lambda turn, other: _number(F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other.cast("string")), 256), F.lit(1), F.lit(15)))

    def turn(s: Column, i: Column) -> Column:
        size = F.when(i % 2 == 1, F.lit(a)).otherwise(F.lit(b)).cast("long")
        return F.struct(s["r"].alias("l"), ((s["l"] + hashed(i, s["r"])) % size).alias("r"))

    value = value.cast("long")
    start = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * b + s["r"])


def _filled(form: Column, chars: Column, pattern: str) -> Column:
    """``form`` with the characters that match the pattern replaced, in order, by those of ``chars``."""

    def step(s: Column, c: Column) -> Column:
        own = c.rlike(pattern)
        return F.struct(F.concat(s["out"], F.when(own, F.substr(chars, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + F.when(own, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(form, _EACH), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda s: s["out"])


def _luhn(payload: Column) -> Column:
    """The check digit of a payload, as a string."""

    def step(total: Column, i: Column) -> Column:
        d = F.substr(payload, F.length(payload) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), step, lambda t: ((10 - t % 10) % 10).cast("string"))


def _mod97(chars: Column) -> Column:
    """Remainder by 97 of the number that letters (A = 10 ...) and digits spell."""

    def step(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (r * 100 + code - 55) % 97).otherwise((r * 10 + code - 48) % 97)

    return F.aggregate(F.split(chars, _EACH), F.lit(0), step)


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")

    def changed(d: Column) -> Column:
        payload = F.substr(d, F.lit(1), F.length(d) - 1)
        new = _let(permuted(payload, key, "card"), lambda p: F.concat(p, _luhn(p)))
        return F.when(_luhn(payload) == F.substr(d, F.length(d), F.lit(1)), _filled(m, new, "[0-9]"))

    return _let(digits, changed)


def _iban(m: Column, key: str) -> Column:
    def changed(v: Column) -> Column:
        country, body = F.substr(v, F.lit(1), F.lit(2)), F.substr(v, F.lit(5), F.length(v))
        good = (F.length(v) >= 15) & (_mod97(F.concat(body, country, F.substr(v, F.lit(3), F.lit(2)))) == 1)
        new = _let(permuted(body, key, "iban"), lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(good, _filled(m, new, "[A-Z0-9]"))

    return _let(F.regexp_replace(m, " ", ""), changed)


def _ip(m: Column, key: str) -> Column:
    number = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda t, x: t * 256 + x.cast("long"))
    octet = lambda n, k: (F.shiftright(n, k) % 256).cast("string")
    return _let(permuted_number(number, 65536, 65536, key, "ip"), lambda n: F.concat_ws(".", octet(n, 24), octet(n, 16), octet(n, 8), octet(n, 0)))


def _date(m: Column, key: str, year_first: bool) -> Column:
    """A date as yyyy-MM-dd, or as dd, mark, MM, mark, yyyy."""
    part = lambda at, n: F.substr(m, F.lit(at), F.lit(n))
    iso = m if year_first else F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2))
    day = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")
    number = F.date_diff(day, F.lit(_FIRST_DAY).cast("date"))

    def said(n: Column) -> Column:
        new = F.date_add(F.lit(_FIRST_DAY).cast("date"), n.cast("int"))
        return F.date_format(new, "yyyy-MM-dd") if year_first else F.concat(F.date_format(new, "dd"), part(3, 1), F.date_format(new, "MM"), part(3, 1), F.date_format(new, "yyyy"))

    whole = F.when(day.isNotNull() & (number >= 0), _let(permuted_number(number, _A, _B, key, "date"), said))
    return whole if year_first else F.coalesce(whole, _month_first(m, key))


def _month_first(m: Column, key: str) -> Column:
    """A date as MM, mark, dd, mark, yyyy with a day above 12; the new one has such a day, too, so it meets no day-first date."""
    part = lambda at, n: F.substr(m, F.lit(at), F.lit(n))
    month, day, year = part(1, 2).cast("int"), part(4, 2).cast("int"), part(7, 4).cast("int")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    say = lambda mm, dd, yyyy: F.concat(mm, part(3, 1), dd, part(3, 1), yyyy.cast("string"))
    late = F.array(*[F.lit(x) for x in _LATE_DAYS])
    at = F.array_position(late, F.concat(part(1, 2), part(4, 2)))
    some = lambda index, a, b, kind, body: _let(permuted_number(index, a, b, key, kind), lambda n: body(n.cast("int")))
    return (
        F.when(month.between(1, 12) & day.between(13, 28), some((year - 1900) * 192 + (month - 1) * 16 + day - 13, 240, 160, "month_date", lambda n: say(two(F.floor(n % 192 / 16) + 1), two(n % 16 + 13), F.floor(n / 192) + 1900)))
        .when(at > 0, some((year - 1900) * 29 + at - 1, 58, 100, "late_date", lambda n: _let(F.element_at(late, n % 29 + 1), lambda d: say(F.substr(d, F.lit(1), F.lit(2)), F.substr(d, F.lit(3), F.lit(2)), F.floor(n / 29) + 1900))))
        .when((month == 2) & (day == 29) & (year % 4 == 0) & (year > 1900), some(F.floor((year - 1904) / 4), 7, 7, "leap_date", lambda n: say(F.lit("02"), F.lit("29"), n * 4 + 1904)))
    )


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3})[ .(-]", 1)
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    good = F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    return F.when(good, F.concat(code, _filled(rest, permuted(digits, key, "phone"), "[0-9]")))


def _email(m: Column, key: str) -> Column:
    return F.concat(permuted(F.substring_index(m, "@", 1), key, "email", wide=True), F.lit("@"), F.substring_index(m, "@", -1))


def _kind(m: Column) -> Column:
    """The kind of a found value: the first pattern that fits it whole, as in the search."""
    out = None
    for kind, pattern in PATTERNS.items():
        test = m.rlike(f"^(?:{pattern})$")
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out


def pseudonym(value: Column, key: str) -> Column:
    """struct(kind, new) of a found value; new is null if the value fails its validation."""
    made = {
        "email": lambda m: _email(m, key),
        "secret": lambda m: F.when(m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), permuted(m, key, "secret", 6)),
        "iban": lambda m: _iban(m, key),
        "ip": lambda m: _ip(m, key),
        "iso_date": lambda m: _date(m, key, True),
        "day_date": lambda m: _date(m, key, False),
        "phone": lambda m: _phone(m, key),
        "ssn": lambda m: _filled(m, permuted(F.regexp_replace(m, "-", ""), key, "ssn"), "[0-9]"),
        "card": lambda m: _card(m, key),
    }

    def by_kind(kind: Column) -> Column:
        new = None
        for name, make in made.items():
            new = F.when(kind == name, make(value)) if new is None else new.when(kind == name, make(value))
        return F.struct(kind.alias("kind"), new.alias("new"))

    return _let(_kind(value), by_kind)


def pseudonymised(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the whole text with pseudonyms, n_values replaced, and their kinds in text order."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col), text.alias("text"))
    found = F.regexp_extract_all("text", F.lit(_ANY), 0)
    cut = F.zip_with(F.split("text", _ANY, -1), found, lambda piece, m: F.struct(piece.alias("piece"), m.alias("m"), F.when(m.isNotNull(), pseudonym(m, key)).alias("p")))
    # one fold puts the text together, so each value is worked out once
    joined = lambda cut: F.struct(
        F.array_join(F.transform(cut, lambda x: F.concat(x["piece"], F.coalesce(x["p"]["new"], x["m"], F.lit("")))), "").alias("text"),
        F.transform(F.filter(cut, lambda x: x["p"]["new"].isNotNull()), lambda x: x["p"]["kind"]).alias("kinds"),
    )
    done = F.when(F.col("text").rlike(_MAY) & F.col("text").rlike(_ANY), _let(cut, joined))
    none = F.array().cast("array<string>")
    rows = rows.select(id_col, F.element_at(F.transform(F.array(F.struct(done.alias("done"), F.col("text").alias("text"))), lambda x: F.struct(F.coalesce(x["done"]["text"], x["text"]).alias("text"), F.coalesce(x["done"]["kinds"], none).alias("kinds"))), 1).alias("out"))
    return rows.select(id_col, F.col("out.text").alias("text"), F.size("out.kinds").cast("long").alias("n_values"), F.concat_ws(",", "out.kinds").alias("kinds"))
