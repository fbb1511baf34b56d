"""Every registered query with SQL against DuckDB on the same tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from loamdex.plans import catalog
from loamdex.plans.registry import ENTRIES, Tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else repr(round(float(value), 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if e.sql))
def test_same_rows(name, spark, small, oracle):
    entry = ENTRIES[name]
    df = entry.run(Tables(spark, small))
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = oracle.execute(entry.sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_the_rest_runs(spark, small):
    for name, entry in ENTRIES.items():
        if not entry.sql:
            assert entry.run(Tables(spark, small)).columns, name


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert catalog.coverage()["R5"]
