from decimal import Decimal

import duckdb

from polyloci.operators import finemap as I
from polyloci.plans import ORACLE, QUERIES, result_queries


def test_credible_set_adds_up_unrounded_posteriors(spark, monkeypatch):
    """I2's SQL ranks by nine digits, but adds up and rounds the posteriors themselves: before, both were taken from nine digits."""
    rows = [(0, 1, 0.5), (0, 2, 0.4000000003), (0, 3, 0.0999999997), (1, 1, 0.1234564999999), (1, 2, 0.7), (1, 3, 0.1765435000001), (2, 2, 0.45), (2, 1, 0.4500000000001), (2, 3, 0.0999999999999)]
    monkeypatch.setattr(result_queries, "_pips", lambda *_: spark.createDataFrame(rows, "locus long, j int, pip double"))
    got = sorted(map(tuple, QUERIES["i2_credible_set"](spark, "").select("locus", "j", "pip").collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE pip (locus BIGINT, j INT, pip DOUBLE)")
    con.executemany("INSERT INTO pip VALUES (?, ?, ?)", rows)
    assert got == sorted(con.execute("WITH m AS (" + ORACLE["i2_credible_set"].split(", m AS (", 1)[1]).fetchall())


def test_pips_where_bayes_factors_overflow(spark):
    """Log Bayes factors beyond 709, of which exp() is infinite in doubles, against decimals of any range."""
    rows = [(0, j, x) for j, x in enumerate([1942.07909, 1940.5, 1941.25, -2.7, 700.0])] + [(1, j, x) for j, x in enumerate([800.0, 800.0, 9393.4662])]
    got = {(r["locus"], r["j"]): r["pip"] for r in I.softmax(spark.createDataFrame(rows, "locus int, j int, lbf double"), ["locus"], "lbf", "pip").collect()}
    total = {k: sum(Decimal(x).exp() for g, _, x in rows if g == k) for k in (0, 1)}
    assert len(got) == len(rows) and all(abs(got[k, j] - float(Decimal(x).exp() / total[k])) < 1e-12 for k, j, x in rows)
