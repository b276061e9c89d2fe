"""Operator 9, sharding: a reproducible shuffle of all rows with computable shard and slot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut
from .feistel import PRIME, permuted

#: Groups within which rows are numbered; the table of their sizes is the only thing the driver sees.
BUCKETS = 4096


def numbered(df: DataFrame, keys: list[str], buckets: int = BUCKETS, name: str = "row") -> tuple[DataFrame, int]:
    """df with a gapless number for every row from 0, in an order that depends on the key columns only, and the row count.

    Rows are dealt to buckets by a hash of all key columns, numbered within their bucket in key order, and moved up
    by the sizes of the buckets before. The bucket of a row does not depend on how the input is partitioned, so the
    numbers are the same on every cluster. The keys' first column must be a LONG. Rows equal in all keys may swap.
    Nulls count as 0 in the bucket and sort first.
    """
    bucket = F.lit(0).cast("long")
    for k in keys:
        bucket = (bucket * F.lit(48271) + F.coalesce(F.pmod(F.col(k), F.lit(PRIME).cast("long")), F.lit(0))) % F.lit(PRIME)
    df = cut(df.withColumn("__bucket", (bucket % F.lit(buckets)).cast("int")))
    sizes = sorted(tuple(r) for r in df.groupBy("__bucket").count().collect())  # at most `buckets` rows
    starts, total = [], 0
    for b, c in sizes:
        starts.append((b, total))
        total += c
    schema = "__bucket int, __start long"
    offsets = df.sparkSession.createDataFrame(starts, schema)
    rank = F.row_number().over(W.partitionBy("__bucket").orderBy(*keys))
    out = df.withColumn("__rank", rank.cast("long") - 1).join(F.broadcast(offsets), "__bucket")
    return out.withColumn(name, F.col("__start") + F.col("__rank")).drop("__bucket", "__start", "__rank"), total


def assign_shards(docs: DataFrame, shards: int = 40, key: int = 20240917, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every document: row number -> Feistel place -> (place mod shards, place div shards).

    Law `rows`: shard sizes are at most one row apart and slots are gapless from 0. Columns: id_col, size (UTF-8
    bytes of the text plus 16), text_crc32, row, shard, slot. Null text counts as empty; null ids are kept; repeated
    rows get places of their own; an empty table gives no rows; other columns are ignored whatever their names are.
    Only native functions are used, and the text is read once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias(id_col),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows, n = numbered(rows, [id_col, "text_crc32", "size"])
    place = permuted(F.col("row"), n, key)
    return rows.withColumn("__place", place).select(
        id_col, "size", "text_crc32", "row",
        (F.col("__place") % shards).cast("int").alias("shard"),
        F.floor(F.col("__place") / F.lit(shards)).cast("long").alias("slot"),
    )
