"""Least squares from sums of products, for any number of given terms of any rank."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A term is explained by those before it if so small a share of its squares is left.
SINGULAR = 1e-9


def swept(a: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric matrices (rows, q, q) with their first terms taken out of the others one by one, and how many were, by row. A
    term that those before it explain is passed over."""
    a = np.array(a, dtype=float)
    own = np.einsum("rii->ri", a).copy()
    rank = np.zeros(len(a), np.int64)
    for k in range(pivots):
        pivot = a[:, k, k]
        ok = pivot > SINGULAR * own[:, k]
        column = np.where(ok[:, None], a[:, k, :], 0.0)
        a -= column[:, :, None] * column[:, None, :] / np.where(ok, pivot, 1.0)[:, None, None]
        rank += ok
    return a, rank


def unpacked(flat: np.ndarray, q: int) -> np.ndarray:
    """Matrices from the upper triangles of their rows."""
    i, j = np.triu_indices(q)
    out = np.zeros((len(flat), q, q))
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def least_squares(df: DataFrame, by: list[str], given: Sequence[Column], x: Column, y: Column, weight: Column | None = None) -> DataFrame:
    """(by, n, rank, xx, xy, yy, y0) of each group: the weighted sums of squares and products of x and y that an intercept and
    the given terms leave, the number of terms that were independent, and what the intercept alone leaves of y.

    One aggregation of packed sums of products; the sweep goes over batches of groups. Rows that lack a value are left out.
    """
    columns = [F.lit(1.0), *given, x, y]
    names = [f"__t{i}" for i in range(len(columns))]
    rows = df.select(*by, *[c.cast("double").alias(n) for c, n in zip(columns, names, strict=True)], (weight if weight is not None else F.lit(1.0)).alias("__w")).dropna(subset=[*names, "__w"])
    q = len(names)
    factor = (lambda c: c) if weight is None else (lambda c: F.col("__w") * c)
    sums = [F.sum(factor(F.col(names[i]) * F.col(names[j]))) for i in range(q) for j in range(i, q)]
    m = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*sums).alias("__sums"))
    schema = T.StructType([f for f in m.schema if f.name != "__sums"] + [T.StructField("rank", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("xx", "xy", "yy", "y0")])

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("__sums")
            flat = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            whole = unpacked(flat, q)
            left, rank = swept(whole, q - 2)
            y0 = swept(whole[:, [0, -1]][:, :, [0, -1]], 1)[0][:, 1, 1]
            out = [left[:, -2, -2], left[:, -2, -1], left[:, -1, -1], y0]
            keep = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(rank), *[pa.array(c) for c in out]], schema=pa.schema([batch.schema.field(i) for i in range(batch.num_columns) if i != at] + [pa.field("rank", pa.int64())] + [pa.field(c, pa.float64()) for c in ("xx", "xy", "yy", "y0")]))

    return m.mapInArrow(run, schema)
