"""Every registered catalogue query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tessella.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    want = sorted(repr([plain(v) for _, v in sorted(zip(rel.columns, r, strict=True))]) for r in rel.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted({*catalogue.queries()} - {*catalogue.oracle_sql()}))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() >= 0


def test_entry_point(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).columns) == 5 and {*catalogue.queries()} <= {*__spark_entry__.queries()}
    assert os.environ["PYTHONPATH"]
