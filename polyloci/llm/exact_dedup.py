"""Operator 6, exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, fresh, stored, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_CHARS = 64
#: Cells of the presence map. Its 2**MAP_BITS / 32 words are all that is broadcast, whatever the input's size.
MAP_BITS = 22
_WORD = 5


def normalised(text: Column) -> Column:
    """Null as empty; A-Z, and no other letters, in lower case."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _shared_cells(keys: DataFrame) -> DataFrame:
    """The cells hit by at least two rows, as a bit map of fixed size: (word, bits). keys: one LONG column, hash."""
    cell = F.pmod("hash", F.lit(1 << MAP_BITS)).alias("cell")
    shared = keys.groupBy(cell).agg(F.count("*").alias("n")).filter("n > 1")
    word = F.shiftright("cell", _WORD).alias("word")
    bit = F.expr(f"shiftleft(1L, int(cell & {(1 << _WORD) - 1}))")
    return shared.groupBy(word).agg(F.bit_or(bit).alias("bits"))


def _in_map(df: DataFrame, cells: DataFrame, hash_col: str, flag: str) -> DataFrame:
    """df with a flag: is this row's cell shared? A row that shares its key with another always is."""
    df = df.withColumn("__cell", F.pmod(hash_col, F.lit(1 << MAP_BITS)))
    df = df.withColumn("__word", F.shiftright("__cell", _WORD))
    cells = F.broadcast(cells.select(F.col("word").alias("__word"), F.col("bits").alias("__bits")))
    hit = F.coalesce(F.expr(f"shiftright(__bits, int(__cell & {(1 << _WORD) - 1})) & 1L") == 1, F.lit(False))
    return df.join(cells, "__word", "left").withColumn(flag, hit).drop("__cell", "__word", "__bits")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every_hash: bool = False) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is empty. Of equal texts the row with the largest id
    stays; among repeated rows of that id exactly one stays. Null ids sort below all others.

    Refinement: (1) rows alone in their byte length are settled; (2) of the rest, rows alone in (length, hash of the
    first PREFIX_CHARS characters) are settled; (3) only the survivors' whole texts are hashed and grouped. What is
    settled is decided against bit maps of fixed size: a collision there only sends a row on to the next step.
    text_sha256 is null for rows that never needed it, unless every_hash asks for it. No step moves a text.
    """
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    lengths = docs.select(F.xxhash64(size).alias("hash"))
    by_length = cut(_shared_cells(lengths))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), size.alias("size"))
    rows = _in_map(rows.withColumn("len_hash", F.xxhash64("size")), by_length, "len_hash", "again")
    prefix = F.xxhash64("size", normalised(F.substring("text", 1, PREFIX_CHARS)))
    by_prefix = cut(_shared_cells(rows.filter("again").select(prefix.alias("hash"))))
    rows = rows.withColumn("prefix_hash", F.when(F.col("again"), prefix))
    rows = _in_map(rows, by_prefix, "prefix_hash", "survives")
    digest = F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256)
    wanted = F.lit(True) if every_hash else F.col("survives")
    rows = cut(rows.select("id", "survives", F.when(wanted, digest).alias("sha")))

    # Copies of a text may be a third of all rows: everything about a group is a partial aggregation.
    twins = rows.filter("survives").groupBy("sha", "id").agg(F.count("*").alias("rows"))
    # As a written table it has no partitioning of its own: where it is too large to be broadcast, both sides of the join are
    # shuffled and a hot group is split.
    groups = stored(twins.groupBy("sha").agg(F.max("id").alias("keep_id"), F.sum("rows").alias("group_size")), "groups")
    found = twins.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, "sha").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    found = found.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "sha")
    alone = rows.filter("NOT survives").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return found.unionByName(alone).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates() drops; columns unchanged.

    The ids to drop are matched with the texts' hash, so a document that shares its id with another text stays. Rows
    that repeat both id and text, and rows of a dropped copy, are told apart by a number within (id, hash).
    """
    names = docs.columns
    ident, digest, row_digest, keep, count = (fresh(docs, x) for x in ("gone_id", "gone_sha", "row_sha", "gone_keep", "gone_count"))
    dropped = exact_duplicates(docs, id_col, text_col).filter(~F.col("kept"))
    gone = dropped.groupBy(F.col(id_col).alias(ident), F.col("text_sha256").alias(digest)).agg(F.count("*").alias(count), F.max("keep_id").alias(keep))
    gone = cut(gone.select(ident, digest, F.col(ident).eqNullSafe(F.col(keep)).alias(keep)))
    marked = docs.withColumn(row_digest, F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256))
    same = F.col(id_col).eqNullSafe(F.col(ident)) & (F.col(row_digest) == F.col(digest))
    out = without(marked, gone.filter(~F.col(keep)), same)
    repeats = gone.filter(F.col(keep))
    if not repeats.isEmpty():
        again = marked.join(repeats, same, "left_semi").dropDuplicates([id_col, row_digest])
        out = without(out, repeats, same).unionByName(again)
    return out.select(*[F.col(f"`{c}`") for c in names])
