"""Connected components of an undirected graph of LONG ids by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Up to so many edges the table of least neighbours is broadcast (16 bytes a row); beyond, it is joined by shuffle.
BROADCAST_EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in edges (a, b): root is the least id that can be reached.

    Loops and repeated edges do no harm. Each round is checkpointed and keeps at most as many edges as it got; the
    number of rounds grows with the logarithm of a component's size. No component is ever gathered in one place.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges = cut(edges)
    state = _state(edges)
    while state[0]:
        small = state[0] <= BROADCAST_EDGES
        side = F.broadcast if small else cut  # a table of its own is needed for a join whose hot keys can be split
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.join(side(least), F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").distinct()
        if not small:
            large = cut(large)
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        joined = large.join(side(least), F.col("b") == F.col("u"))
        pair = F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b"))))
        after = cut(joined.select(pair.alias("e")).select("e.*").filter("a < b").distinct())
        then = _state(after)
        edges = after
        if then == state:
            break
        state = then
    out = edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
    return out.unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
