"""Format-preserving pseudonyms: validation, formats, links between documents, bijections, odd inputs."""

import re

from pyspark.sql import functions as F

from loamdex.llm import pseudonyms as ps


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


SAID = [
    "Card 4111 1111 1111 1111, again 4111111111111111!! but not 4111 1111 1111 1112.",
    "Two 4845168114407329 4111111111111111 beside each other",
    "mail und.34@mail7.example.com, épa.68@mail2.example.com and call +1 (017) 555-7713###",
    "ip 129.38.82.176 not 1.2.3 nor 999.1.1.1 nor 1.2.3.4.5",
    "born 1987-02-28, seen 31.12.2020 and 31/02/2020; GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 but GB83 WEST 1234 5698 7654 32",
    'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" ssn 078-05-1120',
    "Licensed under CC BY-NC 4.0. Version 3.",
    None,
    "",
]


def run(spark, said, key="k"):
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").withColumn("kinds", F.lit("clash"))
    return {r.doc_id: r for r in ps.pseudonymised(df, key=key).collect()}


def test_values_are_replaced_within_their_format(spark):
    got = run(spark, SAID)
    t = got[0].text
    a, b, c = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}), again (\d{16})!! but not (.*)\.$", t).groups()
    assert a.replace(" ", "") == b != "4111111111111111" and luhn(b) and c == "4111 1111 1111 1112"
    assert (got[0].n_values, got[0].kinds) == (2, "card,card")
    # equal values stay linked across documents
    one, two = re.search(r"Two (\d{16}) (\d{16}) beside", got[1].text).groups()
    assert two == b and luhn(two) and (one == "4845168114407329") == (not luhn("4845168114407329"))
    assert re.fullmatch(r"mail [a-z]{3}\.\d\d@mail7\.example\.com, [ß-ö][a-z]{2}\.\d\d@mail2\.example\.com and call \+1 \(\d{3}\) \d{3}-\d{4}###", got[2].text)
    assert "und.34" not in got[2].text and "555-7713" not in got[2].text and got[2].kinds == "email,email,phone"
    ip = re.fullmatch(r"ip (\d+\.\d+\.\d+\.\d+) not 1\.2\.3 nor 999\.1\.1\.1 nor 1\.2\.3\.4\.5", got[3].text)[1]
    assert ip != "129.38.82.176" and all(0 <= int(x) <= 255 for x in ip.split("."))
    iso, day, gb, de = re.fullmatch(r"born (\d{4}-\d\d-\d\d), seen (\d\d\.\d\d\.\d{4}) and 31/02/2020; (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) and (DE\d{20}) but GB83 WEST 1234 5698 7654 32", got[4].text).groups()
    assert iso != "1987-02-28" and day != "31.12.2020" and iban_ok(gb) and iban_ok(de) and "WEST" not in gb
    assert re.fullmatch(r'token = "[0-9a-f]{40}" ssn \d{3}-\d\d-\d{4}', got[5].text) and "b44e15" not in got[5].text
    assert (got[6].text, got[6].n_values) == (SAID[6], 0)
    assert got[7].text is None and got[7].n_values == 0 and got[8].text == ""


def test_the_key_decides(spark):
    assert run(spark, SAID)[0].text == run(spark, SAID)[0].text != run(spark, SAID, key="other")[0].text


def test_permutations_are_one_to_one(spark):
    rows = spark.range(0, 1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"), F.col("id"))
    got = rows.select(ps.permuted(F.col("s"), "k", "x").alias("p"), ps.permuted_number(F.col("id") % 972, 36, 27, "k", "d").alias("n")).collect()
    assert len({r.p for r in got}) == 1000 and all(re.fullmatch(r"\d{3}", r.p) for r in got)
    assert {r.n for r in got} == set(range(972))


def test_long_text_and_empty_table(spark):
    long = "word " * 200_000 + "mail a.b@c.de end"
    got = run(spark, [long])
    assert len(got[0].text) == len(long) and got[0].n_values == 1
    assert ps.pseudonymised(spark.createDataFrame([], "doc_id long, text string"), key="k").count() == 0


def test_no_python_on_the_way(spark):
    df = ps.pseudonymised(spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(1), key="k")
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_letters_beyond_ascii_are_replaced_too(spark):
    said = ["éü@x.org", "王@x.org", "Ёлка.١٢@x.org", "ÅÆ@x.org", "한글@x.org", "ꙮ@x.org", "ａ１@x.org"]
    got = run(spark, said)
    for i, old in enumerate(said):
        new, old = got[i].text.split("@")[0], old.split("@")[0]
        assert got[i].n_values == 1 and len(new) == len(old) and all(a != b or a == "." for a, b in zip(new, old)), (old, new)
        assert all(x.isalnum() or x == "." for x in new)
    assert 0x4E00 <= ord(got[1].text[0]) <= 0x9FFF and 0xAC00 <= ord(got[4].text[0]) <= 0xD7A3
    # one to one within a range
    df = spark.range(0x430, 0x450).select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    new = {r.n for r in df.select(ps.permuted(F.concat("c", "c"), "k", "email", wide=True).alias("n")).collect()}
    assert len(new) == 32 and all(0x430 <= ord(c) <= 0x44F for n in new for c in n)


def test_dates_of_all_orders(spark):
    import datetime

    said = ["07/25/1980", "1900-05-05", "02/29/1996", "12/31/2099", "02/30/1996", "02/29/1900", "13/25/1980", "04/31/2000", "2/3/1999"]
    got = run(spark, said)
    new = [got[i].text for i in range(len(said))]
    assert [a == b for a, b in zip(new, said)] == [False] * 4 + [True] * 5
    assert all(int(new[i][3:5]) > 12 and datetime.datetime.strptime(new[i], "%m/%d/%Y") for i in (0, 2, 3)) and datetime.date.fromisoformat(new[1])
    assert new[2].startswith("02/29/")
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(days=d) for d in range(0, 73049)]
    us = [d.strftime("%m/%d/%Y") for d in days if d.day > 12]
    df = spark.createDataFrame([(x,) for x in us], "d string").select("d", ps._month_first(F.col("d"), "k").alias("n"))
    row = df.agg(F.count("n").alias("n"), F.countDistinct("n").alias("different"), F.min(F.substring("n", 4, 2)).alias("least")).first()
    assert row.n == row.different == len(us) and row.least == "13"
    iso = spark.createDataFrame([(d.isoformat(),) for d in days], "d string").select(ps._date(F.col("d"), "k", True).alias("n"))
    assert iso.distinct().count() == len(days)
