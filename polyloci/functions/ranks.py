"""Ranks and running sums within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .lineage import cut


def rank_within(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds `name`, a row's place from 0 within its group in ascending order, and `name`_n, the group's size.

    Rows are dealt by ranges of (by, order), numbered within a range, and moved up by the rows of the ranges before: no
    task holds a whole group. `order` must have no ties, or ties between equal rows only; null is a group. The ranged rows
    are checkpointed, so ranges are the same in both of their uses.
    """
    x = cut(df.repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()))
    n = x.groupBy(*by, "__p").agg(F.count("*").alias("__rows"))  # a row or two for each range or group
    w = W.partitionBy(*by)
    before = F.coalesce(F.sum("__rows").over(w.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("__before", before).withColumn(f"{name}_n", F.sum("__rows").over(w)).drop("__rows")
    place = F.row_number().over(W.partitionBy(*by, "__p").orderBy(*order)) - 1
    n = n.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate([*by, "__p"])], "__before", f"{name}_n")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate([*by, "__p"])])
    x = x.withColumn("__place", place).join(n, same)
    return x.withColumn(name, F.col("__before") + F.col("__place")).drop("__p", "__place", "__before", *[f"__by{i}" for i in range(len(by) + 1)])


def in_ranges(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """df dealt by ranges of (by, order), with a row's range as __p, for running_over(); checkpointed, so that ranges stay."""
    return cut(df.repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()))


def running_within(df: DataFrame, by: list[str], order: list, sums: dict[str, str], include: bool = True, largest: bool = False) -> DataFrame:
    """Adds running sums within groups along `order`, each row included or, if not `include`, up to the row before (0 for the
    first): new name -> column. Null is a group. If `largest`, the largest values so far instead (null before the first row).

    Rows are dealt by ranges of (by, order) and added up within a range. Only groups that lie in several ranges need the sums
    of the ranges before; these are at most two rows for each range, and are broadcast whatever the input's size. `order` is
    made of column names or of sort expressions and must have no ties, or ties between equal rows only.
    """
    return running_over(in_ranges(df, by, order), by, order, sums, include, largest).drop("__p")


def running_over(x: DataFrame, by: list[str], order: list, sums: dict[str, str], include: bool = True, largest: bool = False) -> DataFrame:
    """running_within() of rows that in_ranges() dealt; __p stays, so that another total can follow without moving rows."""
    total = F.max if largest else F.sum
    some = (lambda c: c) if largest else (lambda c: F.coalesce(c, F.lit(0)))
    both = F.greatest if largest else (lambda a, b: a + F.coalesce(b, F.lit(0)))
    group = W.partitionBy(*by)
    per = x.groupBy(*by, "__p").agg(*[total(c).alias(n) for n, c in sums.items()]).withColumn("__ranges", F.count("*").over(group)).filter("__ranges > 1")
    before = group.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    keys = [*by, "__p"]
    per = per.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(keys)], *[total(n).over(before).alias(f"__before_{n}") for n in sums])
    own = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if include else -1)
    out = x.select("*", *[some(total(c).over(own)).alias(n) for n, c in sums.items()])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(keys)])
    out = out.join(F.broadcast(per), same, "left")
    for n in sums:
        out = out.withColumn(n, both(F.col(n), F.col(f"__before_{n}")))
    return out.drop(*[f"__by{i}" for i in range(len(keys))], *[f"__before_{n}" for n in sums])
