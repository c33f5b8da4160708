"""Every query against its SQL, and the entry point's contract."""

import duckdb
import pytest

import __spark_entry__
from stepforge.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = con.execute(catalogue.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted((plain(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)
    assert sorted((plain(r[c] for c in columns) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_other_queries_give_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
