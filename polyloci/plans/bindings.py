"""The study's roles played by the given tables, as DataFrames and, word for word, as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _counted(sql: str) -> str:
    """count_if(x) as count(CASE WHEN x THEN 1 END), which is a BIGINT in DuckDB as well."""
    while (start := sql.find("count_if(")) >= 0:
        at, depth = start + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        sql = f"{sql[:start]}count(CASE WHEN {sql[start + len('count_if('):at - 1]} THEN 1 END){sql[at:]}"
    return sql


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that states its result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = _counted(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, as sums are not ordered; minus zero is zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def assoc(spark: SparkSession, sf: str) -> DataFrame:
    """Large association: a line item is a person's call of a variant at the region of its supplier."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity", "l_discount")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    x = li.join(s, li.l_suppkey == s.s_suppkey).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))  # nation has a fixed 25 rows
    return x.select(
        F.col("n_regionkey").alias("site"), (F.col("l_partkey") % 200).alias("variant"), ((F.col("l_linenumber") + F.col("l_suppkey")) % 3).alias("dosage"),
        F.col("l_extendedprice").alias("y"), (F.col("l_returnflag") == "R").alias("is_case"), F.col("l_quantity").alias("c1"), F.col("l_discount").alias("c2"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
    )


ASSOC = """assoc AS (SELECT n_regionkey AS site, l_partkey % 200 AS variant, (l_linenumber + l_suppkey) % 3 AS dosage,
  l_extendedprice AS y, l_returnflag = 'R' AS is_case, l_quantity AS c1, l_discount AS c2, l_orderkey, l_linenumber, l_suppkey, l_partkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def geno(spark: SparkSession, sf: str) -> DataFrame:
    """Dense genotypes: a vector is a person, its first 60 numbers are calls."""
    e = table(spark, sf, "embeddings")
    y = F.element_at("embedding", 1).cast("double") + F.element_at("embedding", 31).cast("double") + 0.5 * F.element_at("embedding", 61).cast("double")
    x = e.select("vec_id", "label", y.alias("y"), F.posexplode(F.slice("embedding", 1, 60)).alias("p", "v"))
    v, j = F.col("v").cast("double"), F.col("p") + 1
    return x.select(
        F.col("vec_id").alias("sample"), (F.col("label") % 3).alias("site"), (F.col("label") % 2).alias("pop"), F.col("label"), j.alias("j"),
        F.floor(F.col("p") / 20).cast("int").alias("locus"), (j * 1000).cast("long").alias("bp"),
        F.when(v < -0.1, 0).when(v < 0.1, 1).otherwise(2).alias("dosage"), ((F.col("vec_id") * 7 + j) % 97 == 0).alias("missing"), "y", v.alias("v"),
    )


GENO = """geno AS (SELECT vec_id AS sample, label % 3 AS site, label % 2 AS pop, label, j::INT AS j, ((j - 1) // 20)::INT AS locus, j * 1000 AS bp,
  CASE WHEN v < (-0.1)::DOUBLE THEN 0 WHEN v < 0.1::DOUBLE THEN 1 ELSE 2 END AS dosage, (vec_id * 7 + j) % 97 = 0 AS missing, y, v
  FROM (SELECT vec_id, label, t.j AS j, embedding[t.j]::DOUBLE AS v,
        embedding[1]::DOUBLE + embedding[31]::DOUBLE + 0.5::DOUBLE * embedding[61]::DOUBLE AS y FROM embeddings, range(1, 61) t(j)))"""


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Result grid: an order is a fit."""
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n_sets = (c % 4).cast("long")
    return o.select(
        (c % 50).alias("locus"), F.col("o_orderpriority").alias("architecture"), k.alias("replicate"), (k % 2).alias("arm"), (c % 3).alias("stratum"), ((c % 50) % 12).alias("region"),
        (F.col("o_orderstatus") == "F").alias("captured"), n_sets.alias("n_sets"), F.least(n_sets, k % 3).alias("n_true_sets"), (1 + c % 7).alias("best_size"),
        ((k % 101) / 100.0).alias("causal_pip"), (F.col("o_orderstatus") != "P").alias("converged"), (F.col("o_orderstatus") == "P").alias("failed"),
        (k % 5).alias("n_true_pip95"), (c % 2).alias("n_false_pip95"), ((k % 4) / 1000.0 + 0.001).alias("h2"), (F.col("o_totalprice") / 1000).alias("runtime_s"),
        (1 + k % 3).alias("n_causal"), F.least(1 + k % 3, k % 4).alias("n_caught"),
    )


GRID = """grid AS (SELECT o_custkey % 50 AS locus, o_orderpriority AS architecture, o_orderkey AS replicate, o_orderkey % 2 AS arm, o_custkey % 3 AS stratum, (o_custkey % 50) % 12 AS region,
  o_orderstatus = 'F' AS captured, o_custkey % 4 AS n_sets, least(o_custkey % 4, o_orderkey % 3) AS n_true_sets, 1 + o_custkey % 7 AS best_size,
  (o_orderkey % 101) / 100.0::DOUBLE AS causal_pip, o_orderstatus <> 'P' AS converged, o_orderstatus = 'P' AS failed,
  o_orderkey % 5 AS n_true_pip95, o_custkey % 2 AS n_false_pip95, (o_orderkey % 4) / 1000.0::DOUBLE + 0.001::DOUBLE AS h2, o_totalprice / 1000 AS runtime_s,
  1 + o_orderkey % 3 AS n_causal, least(1 + o_orderkey % 3, o_orderkey % 4) AS n_caught FROM orders)"""

LCG = "(({0} % 2147483647) * 48271 + {1}) % 2147483647"


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows: a part is a window on one of five chromosomes; sizes repeat, so that windows overlap."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    start = (k * 48271 % 2147483647) % 2_000_000
    return p.select(k.alias("window"), (k % 5).cast("int").alias("chrom"), start.alias("start_bp"), (start + 200 + F.col("p_size") * 100).cast("long").alias("end_bp"), F.col("p_retailprice").alias("score"))


WINDOWS = """windows AS (SELECT p_partkey AS "window", (p_partkey % 5)::INT AS chrom, (p_partkey * 48271 % 2147483647) % 2000000 AS start_bp,
  (p_partkey * 48271 % 2147483647) % 2000000 + 200 + p_size * 100 AS end_bp, p_retailprice AS score FROM part)"""


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """Variants: a line item's (order, line) is a variant of one of five chromosomes."""
    li = table(spark, sf, "lineitem")
    bp = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) * 48271 % 2147483647) % 2_000_000
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("variant"), (F.col("l_suppkey") % 5).cast("int").alias("chrom"), bp.alias("bp"))


POSITIONS = """positions AS (SELECT l_orderkey * 10 + l_linenumber AS variant, (l_suppkey % 5)::INT AS chrom,
  ((l_orderkey * 7 + l_linenumber) * 48271 % 2147483647) % 2000000 AS bp FROM lineitem)"""
