"""Iterations within one stage: tasks keep their rows and exchange sums each round, in barrier execution mode."""

from __future__ import annotations

import base64
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .lineage import new_path


def gathered(value: Any) -> list[Any]:
    """Every task's value, in order of the tasks, at every task."""
    sent = base64.b64encode(pickle.dumps(value)).decode()
    return [pickle.loads(base64.b64decode(x)) for x in BarrierTaskContext.get().allGather(sent)]


def summed(values: np.ndarray) -> np.ndarray:
    """The sum of all tasks' arrays, the same at every task to the last bit."""
    return np.sum(gathered(values), axis=0)


def by_group(group: np.ndarray, groups: int, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of values by group, a row for each group."""
    out = np.zeros((groups, values.shape[1]))
    for i in range(values.shape[1]):
        out[:, i] = np.bincount(group, values[:, i], minlength=groups)
    return out


class Kept:
    """A task's rows in a file on its machine: each iteration reads them again, a batch at a time."""

    def __init__(self, batches: Iterator[pa.RecordBatch], path: str):
        self.path, writer = path, None
        for batch in batches:
            writer = writer or pa.ipc.new_stream(path, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
            writer.write_batch(batch)
        self.empty = writer is None
        if writer:
            writer.close()

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        if not self.empty:
            with pa.OSFile(self.path) as f:
                yield from pa.ipc.open_stream(f)


def codes(column: pa.Array, at: dict[Any, int]) -> np.ndarray:
    """Each value's number."""
    d = column.dictionary_encode()
    return np.array([at[v] for v in d.dictionary.to_pylist()], np.int64)[d.indices.to_numpy()]


def in_rounds(rows: DataFrame, work: Callable[[Kept], Iterator[tuple]], schema: T.StructType, tasks: int | None = None) -> DataFrame:
    """(action) work(the task's rows, to be read any number of times) at all tasks at once; it may call gathered() and summed(), the same
    number of times at every task, and the tuples that it gives at the first task are the result's rows.

    There are as many tasks as the cluster runs at once (spark.default.parallelism), or `tasks`; each keeps its share of the
    rows on its machine's disk and holds one batch in memory. A lost executor starts the stage anew.
    """
    n, kinds = tasks or rows.sparkSession.sparkContext.defaultParallelism, to_arrow_schema(schema)

    def run(batches):
        with tempfile.TemporaryDirectory(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as folder:
            out = list(work(Kept(batches, f"{folder}/rows")))
        if BarrierTaskContext.get().partitionId() == 0 and out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    path = new_path(rows.sparkSession, "rounds")
    rows.repartition(n).mapInArrow(run, schema, barrier=True).write.parquet(path)  # a table, as no other stage may follow a barrier's rows
    return rows.sparkSession.read.schema(schema).parquet(path)
