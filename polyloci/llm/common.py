"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A list of rows to leave out is broadcast up to this many rows (some 10 MB); longer ones are joined by shuffle.
BROADCAST_ROWS = 150_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new one where that is unset and Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.getCheckpointDir() is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-polyloci-", dir="/tmp"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/polyloci/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder, so that a lost executor costs no rework."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Spark removes the shuffle files of each write in this block once it has ended: what it wrote is read instead."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write df as a compressed table in the shared folder and read it again; for what is too wide to checkpoint."""
    path = new_table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.page.size", 4 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame) -> DataFrame:
    """A stored or checkpointed table, broadcast where it has few rows; else it is joined by shuffle, where hot keys are split."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case: `name`, or that with marks after it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, same: Column) -> DataFrame:
    """docs without the rows that have a match in gone (checkpointed rows, so that counting them is cheap)."""
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(side, same, "left_anti")


def passed_through(docs: DataFrame, run) -> DataFrame:
    """docs through mapInArrow(run), which leaves the columns as they are, whatever their names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def slices(batches, rows: int = 512):
    """Arrow batches in parts of a few rows: a worker holds the Python objects of one part at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
