"""Genotype moments and LD as matrix tiles: a pair of blocks of variants is one row, and nothing is a row per pair.

A tile holds, for the variants `vi` of its rows and `vj` of its columns, the number of people, the sums and sums of squares of
both, and the products X_i'X_j, as one array of float64. All of it adds up over batches of people and over sites, and is
enough to turn the tile into LD by itself. Only tiles with ti <= tj are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Variants of a tile's side: 128 KB a tile.
WIDTH = 128
#: A variant varies if its variance is above this.
VARIES = 1e-12

_TILE = [T.StructField("ti", T.IntegerType()), T.StructField("tj", T.IntegerType()), T.StructField("vi", T.ArrayType(T.IntegerType())), T.StructField("vj", T.ArrayType(T.IntegerType())), T.StructField("block", T.BinaryType())]
TILE = [f.name for f in _TILE]


def variant_axis(variants: DataFrame, block: list[str], site: str = "site", j: str = "j", codes: tuple[str, ...] = ()) -> DataFrame:
    """(block, j, pos): the variants that every site of a block has, numbered from 0 in their order.

    codes: columns that all sites must give a variant alike, as its alleles and position; a site that codes one the other way
    fails the job, since its dosages would add up in silence.
    """
    sites = variants.groupBy(*block).agg(F.count_distinct(site).alias("__sites"))
    same = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"__n_{c}") for c in codes]
    v = variants.groupBy(*block, j).agg(F.count_distinct(site).alias("__have"), *same).join(sites, block).filter("__have = __sites")
    if codes:
        alike = reduce(lambda a, b: a & b, [F.col(f"__n_{c}") == 1 for c in codes])
        wrong = F.raise_error(F.concat(F.lit("sites disagree on the coding of variant "), F.col(j).cast("string"))).cast("int")
        v = v.withColumn("__alike", F.when(alike, 1).otherwise(wrong)).filter("__alike = 1")
    return v.select(*block, j, (F.row_number().over(W.partitionBy(*block).orderBy(j)) - 1).alias("pos"))  # the variants of a locus


def _as_rows(batch: pa.RecordBatch, by: list[str]):
    keys = zip(*[batch.column(c).to_pylist() for c in by], strict=True) if by else [()] * batch.num_rows
    return zip(keys, *[batch.column(c).to_pylist() for c in TILE], strict=True)


def _batch(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))


_FIELDS = [pa.field("ti", pa.int32()), pa.field("tj", pa.int32()), pa.field("vi", pa.list_(pa.int32())), pa.field("vj", pa.list_(pa.int32())), pa.field("block", pa.binary())]


def geno_tiles(geno: DataFrame, by: list[str], axis: DataFrame, block: list[str], sample: str = "sample", j: str = "j", width: int = WIDTH) -> DataFrame:
    """(by, tile) of raw whole dosages, partial over batches of people: add_tiles() adds them up.

    axis: variant_axis() of the block, which is part of `by`; other variants are left out. Anything but whole numbers, and a
    person who lacks a variant of the axis, fails the job.
    """
    sizes = axis.groupBy(*block).agg(F.count("*").alias("__m"))
    x = geno.join(axis, [*block, j]).groupBy(*by, sample).agg(F.array_sort(F.collect_list(F.struct("pos", F.col(j).cast("int").alias("j"), F.col("dosage").cast("double").alias("d")))).alias("x"))
    x = x.join(sizes, block).select(*by, "__m", F.col("x.j").alias("js"), F.col("x.d").alias("d"))
    schema = T.StructType([f for f in x.schema if f.name in by] + _TILE)

    def gram(batches):
        for batch in batches:
            fields = [batch.schema.field(c) for c in by] + _FIELDS
            keys = list(zip(*[batch.column(c).to_pylist() for c in by], strict=True)) if by else [()] * batch.num_rows
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                m = batch.column("__m")[at[0]].as_py()
                part = batch.column("d").take(pa.array(at))
                if part.value_lengths().to_numpy().tolist() != [m] * len(at):
                    raise ValueError(f"{key}: some people lack a variant")
                dosage = part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), m)
                if not np.array_equal(dosage, np.rint(dosage)):
                    raise ValueError(f"{key}: dosages are not whole numbers, or some are missing")
                js = batch.column("js")[at[0]].as_py()
                sums, squares = dosage.sum(0), (dosage * dosage).sum(0)
                for i in range(0, m, width):
                    rows = []
                    for k in range(i, m, width):
                        a, b = slice(i, i + width), slice(k, k + width)
                        data = np.concatenate(([len(at)], sums[a], sums[b], squares[a], squares[b], (dosage[:, a].T @ dosage[:, b]).ravel()))
                        rows.append((*key, i // width, k // width, js[a], js[b], data.tobytes()))
                    yield _batch(rows, fields)

    return x.mapInArrow(gram, schema)


def add_tiles(tiles: DataFrame, by: list[str]) -> DataFrame:
    """Tiles added up over everything but `by`, one block at a time."""
    fields_by = [f for f in tiles.schema if f.name in by]
    x = tiles.select(*by, *TILE).repartition(*by, "ti", "tj").sortWithinPartitions(*by, "ti", "tj")

    def run(batches):
        label, row, total, fields = None, None, None, None
        for batch in batches:
            fields = [batch.schema.field(c) for c in by] + _FIELDS
            for key, ti, tj, vi, vj, block in _as_rows(batch, by):
                data = np.frombuffer(block)
                if (key, ti, tj) != label:
                    if label is not None:
                        yield _batch([(*row, total.tobytes())], fields)
                    label, row, total = (key, ti, tj), (*key, ti, tj, vi, vj), data.copy()
                elif (vi, vj) != (row[-2], row[-1]):
                    raise ValueError(f"{key}: tiles of different variants")
                else:
                    total += data
        if label is not None:
            yield _batch([(*row, total.tobytes())], fields)

    return x.mapInArrow(run, T.StructType([*fields_by, *_TILE]))


def parts(block: bytes, a: int, b: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """People, sums and sums of squares of both sides, and products, of a tile of moments."""
    data = np.frombuffer(block)
    at = np.cumsum([1, a, b, a, b])
    return data[0], data[1 : at[1]], data[at[1] : at[2]], data[at[2] : at[3]], data[at[3] : at[4]], data[at[4] :].reshape(a, b)


def _mapped(tiles: DataFrame, by: list[str], f: Callable) -> DataFrame:
    """Tiles with each block replaced by f(ti == tj, block, rows, columns), an array of rows x columns."""
    fields_by = [x for x in tiles.schema if x.name in by]

    def run(batches):
        for batch in batches:
            rows = [(*key, ti, tj, vi, vj, np.ascontiguousarray(f(ti == tj, block, len(vi), len(vj)), float).tobytes()) for key, ti, tj, vi, vj, block in _as_rows(batch, by)]
            if rows:
                yield _batch(rows, [batch.schema.field(c) for c in by] + _FIELDS)

    return tiles.select(*by, *TILE).mapInArrow(run, T.StructType([*fields_by, *_TILE]))


def _correlation(diagonal: bool, block: bytes, a: int, b: int) -> np.ndarray:
    n, ui, uj, si, sj, g = parts(block, a, b)
    mi, mj = ui / n, uj / n
    vi, vj = si / n - mi * mi, sj / n - mj * mj
    ok = (vi > VARIES)[:, None] & (vj > VARIES)[None, :]
    r = np.where(ok, (g / n - np.outer(mi, mj)) / np.sqrt(np.where(ok, np.outer(vi, vj), 1.0)), 0.0)
    if diagonal:
        np.fill_diagonal(r, 1.0)
    return r


def _centered(diagonal: bool, block: bytes, a: int, b: int) -> np.ndarray:
    n, ui, uj, _, _, g = parts(block, a, b)
    return g - np.outer(ui, uj) / n


def ld_tiles(tiles: DataFrame, by: list[str]) -> DataFrame:
    """Tiles of population correlations; 0 without variance, 1 on the diagonal."""
    return _mapped(tiles, by, _correlation)


def r2_tiles(tiles: DataFrame, by: list[str]) -> DataFrame:
    """Tiles of squared correlations."""
    return _mapped(tiles, by, lambda *tile: _correlation(*tile) ** 2)


def centered_tiles(tiles: DataFrame, by: list[str]) -> DataFrame:
    """Tiles of X'X - uu'/n."""
    return _mapped(tiles, by, _centered)


def product_tiles(tiles: DataFrame, by: list[str]) -> DataFrame:
    """Tiles of the products X'X alone."""
    return _mapped(tiles, by, lambda _, block, a, b: parts(block, a, b)[-1])


def tile_pairs(tiles: DataFrame, by: list[str], value: str, kind: str = "double") -> DataFrame:
    """(by, i <= j, value) of tiles of one value a pair; for reports, as it is a row per pair."""
    schema = T.StructType([f for f in tiles.schema if f.name in by] + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField(value, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for key, ti, tj, vi, vj, block in _as_rows(batch, by):
                data = np.frombuffer(block).reshape(len(vi), len(vj))
                p, q = np.triu_indices(len(vi)) if ti == tj else (x.ravel() for x in np.indices(data.shape))
                own = [pa.array([k] * len(p), batch.schema.field(c).type) for k, c in zip(key, by, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.array(vi, np.int32)[p]), pa.array(np.array(vj, np.int32)[q]), pa.array(data[p, q])], names=[*by, "i", "j", value])

    out = tiles.select(*by, *TILE).mapInArrow(run, schema)
    return out if kind == "double" else out.withColumn(value, F.round(value).cast(kind))


def tiles_of_pairs(pairs: DataFrame, by: list[str], value: str, width: int = WIDTH) -> DataFrame:
    """Tiles of one value a pair from (by, i <= j, value) rows; pairs that are not there are 0, and 1 on the diagonal."""
    ends = pairs.select(*by, F.explode(F.array(F.col("i").cast("int"), F.col("j").cast("int"))).alias("v")).distinct()
    axis = ends.withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy("v")) - 1).withColumn("t", F.floor(F.col("pos") / width).cast("int"))  # the variants of a locus
    lists = axis.groupBy(*by, "t").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    end = lambda k: axis.select(*by, F.col("v").alias(k), F.col("pos").alias(f"p{k}"), F.col("t").alias(f"t{k}"))
    x = pairs.withColumns({k: F.col(k).cast("int") for k in ("i", "j")}).join(end("i"), [*by, "i"]).join(end("j"), [*by, "j"])
    x = x.groupBy(*by, "ti", "tj").agg(F.collect_list(F.struct((F.col("pi") % width).alias("p"), (F.col("pj") % width).alias("q"), F.col(value).cast("double").alias("x"))).alias("cells"))
    every = lists.select(*by, F.col("t").alias("ti"), F.col("vs").alias("vi")).join(lists.select(*by, F.col("t").alias("tj"), F.col("vs").alias("vj")), by).filter("ti <= tj")
    x = every.join(x, [*by, "ti", "tj"], "left").select(*by, "ti", "tj", "vi", "vj", F.col("cells.p").alias("p"), F.col("cells.q").alias("q"), F.col("cells.x").alias("x"))

    def run(batches):
        for batch in batches:
            rows = []
            keys = zip(*[batch.column(c).to_pylist() for c in by], strict=True) if by else [()] * batch.num_rows
            for key, ti, tj, vi, vj, p, q, own in zip(keys, *[batch.column(c).to_pylist() for c in ("ti", "tj", "vi", "vj", "p", "q", "x")], strict=True):
                data = np.eye(len(vi)) if ti == tj else np.zeros((len(vi), len(vj)))
                if own:
                    data[p, q] = own
                    if ti == tj:
                        data[q, p] = own
                rows.append((*key, ti, tj, vi, vj, data.tobytes()))
            if rows:
                yield _batch(rows, [batch.schema.field(c) for c in by] + _FIELDS)

    return x.mapInArrow(run, T.StructType([f for f in pairs.schema if f.name in by] + _TILE))


def tile_divergence(tiles: DataFrame, by: list[str], site: str = "site") -> DataFrame:
    """Frobenius distance between two sites' matrices, averaged over pairs of sites, from their tiles."""
    a = tiles.select(*by, F.col(site).alias("sa"), "ti", "tj", F.col("vi").alias("via"), F.col("vj").alias("vja"), F.col("block").alias("a"))
    b = tiles.select(*by, F.col(site).alias("sb"), "ti", "tj", F.col("vi").alias("vib"), F.col("vj").alias("vjb"), F.col("block").alias("b"))
    x = a.join(b, [*by, "ti", "tj"]).filter("sa < sb")
    wrong = F.raise_error(F.lit("sites have different variants; take those they share")).cast("int")
    x = x.withColumn("times", F.when((F.col("via") != F.col("vib")) | (F.col("vja") != F.col("vjb")), wrong).when(F.col("ti") == F.col("tj"), 1).otherwise(2))
    x = x.select(*by, "sa", "sb", "times", "a", "b")

    def run(batches):
        for batch in batches:
            d = [t * float(((np.frombuffer(p) - np.frombuffer(q)) ** 2).sum()) for t, p, q in zip(*[batch.column(c).to_pylist() for c in ("times", "a", "b")], strict=True)]
            keep = [*by, "sa", "sb"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(d, pa.float64())], schema=pa.schema([*[batch.schema.field(c) for c in keep], pa.field("d", pa.float64())]))

    schema = T.StructType([f for f in x.schema if f.name in (*by, "sa", "sb")] + [T.StructField("d", T.DoubleType())])
    d = x.mapInArrow(run, schema).groupBy(*by, "sa", "sb").agg(F.sqrt(F.sum("d")).alias("d"))
    return d.groupBy(*by).agg(F.avg("d").alias("divergence"), F.count("*").alias("n_pairs"))
