"""Every registered query against its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = sorted(n for n in QUERIES if not n.startswith("op") and n != "pipeline")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def in_order(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    if name in SQL:
        got = duck.execute(SQL[name])
        at = [[d[0] for d in got.description].index(c) for c in columns]
        want = [tuple(plain(r[i]) for i in at) for r in got.fetchall()]
        assert in_order(rows) == in_order(want)
    else:
        assert rows


def test_response_mode_follows_the_scope(spark, sf, monkeypatch):
    from lodeseek.operators import search
    from lodeseek.plans import search_queries

    mode = lambda: QUERIES["s16_response_meta"](spark, sf).first().retrieval_mode
    n = search.scope_hashes(search_queries.tables(spark, sf)["chunks"], search_queries._scope(search_queries.tables(spark, sf))).count()
    for least, want in ((n + 1, "narrow"), (n, "broad"), (2, "broad")):
        monkeypatch.setattr(search, "NARROW", least)
        assert mode() == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0
