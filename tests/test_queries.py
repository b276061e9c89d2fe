"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from polyloci.plans import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.5g}"
    if isinstance(v, (bool, int)):
        return f"{float(v):.5g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    want = sorted([tuple(plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in cur.fetchall()])
    got = sorted([tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()])
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    off = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not off, off[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
