"""Streams of site status, round updates and moment blocks. Each function takes and returns a streaming DataFrame; all of
them also work on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import new_path


def site_status(events: DataFrame, interval: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Status of each site by interval: online if all up, unknown if all failed to answer, degraded if some are up, else
    offline. events: ts, site, online, error."""
    e = events.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", interval), "site").agg(F.count("*").alias("n"), F.count_if(F.col("online")).alias("up"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    status = F.when(F.col("up") == F.col("n"), "online").when(F.col("failed") == F.col("n"), "unknown").when(F.col("up") > 0, "degraded").otherwise("offline")
    return g.select(F.col("window.start").alias("start"), "site", "n", "up", status.alias("status"))


def round_progress(updates: DataFrame, n_sites: int) -> DataFrame:
    """Sites that reported, rows and time by round; complete when all sites have. updates: round, site, num_samples,
    train_time_sec. The set of sites is the state; it is as large as the number of sites."""
    g = updates.groupBy("round").agg(F.size(F.collect_set("site")).alias("sites"), F.sum("num_samples").alias("samples"), F.max("train_time_sec").alias("slowest"))
    return g.withColumn("complete", F.col("sites") == n_sites)


def round_parts(updates: DataFrame, interval: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """J2 for update mode: what was reported on a round in each interval of ts. Intervals that the watermark has passed leave the
    state, however many rounds there are; rounds_of() puts the intervals of a round together."""
    e = updates.withWatermark("ts", late).groupBy(F.window("ts", interval), "round")
    g = e.agg(F.collect_set("site").alias("reported"), F.sum("num_samples").alias("samples"), F.max("train_time_sec").alias("slowest"))
    return g.select(F.col("window.start").alias("start"), "round", "reported", "samples", "slowest")


def rounds_of(parts: DataFrame, n_sites: int) -> DataFrame:
    """round_progress() from the rows of round_parts()."""
    g = parts.groupBy("round").agg(F.size(F.array_distinct(F.flatten(F.collect_list("reported")))).alias("sites"), F.sum("samples").alias("samples"), F.max("slowest").alias("slowest"))
    return g.withColumn("complete", F.col("sites") == n_sites)


def pool_parts(blocks: DataFrame, key: list[str], value: str, interval: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """J3 for update mode: stream_pool() by interval of ts, so that both the blocks seen and the sums leave the state behind the
    watermark; pool_of() adds the intervals up. A block that comes again within the watermark is not added again."""
    e = blocks.withWatermark("ts", late)
    once = e.dropDuplicatesWithinWatermark(["site", "block"]) if blocks.isStreaming else e.dropDuplicates(["site", "block"])
    g = once.groupBy(F.window("ts", interval), *key).agg(F.sum(value).alias(value), F.count("*").alias("n_blocks"))
    return g.select(F.col("window.start").alias("start"), *key, value, "n_blocks")


def pool_of(parts: DataFrame, key: list[str], value: str) -> DataFrame:
    """Moments from the rows of pool_parts()."""
    return parts.groupBy(*key).agg(F.sum(value).alias(value), F.sum("n_blocks").alias("n_blocks"))


def stream_pool(blocks: DataFrame, key: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Moments added up as blocks arrive, each (site, block) once. blocks: ts, site, block, key, value."""
    e = blocks.withWatermark("ts", late)
    once = e.dropDuplicatesWithinWatermark(["site", "block"]) if blocks.isStreaming else e.dropDuplicates(["site", "block"])
    return once.groupBy(*key).agg(F.sum(value).alias(value), F.count("*").alias("n_blocks"))


def run_available(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Everything a finite stream holds, as a batch; for tests and queries. In complete mode each batch's result is a table of its
    own in the shared folder, of which the last is read; in append mode all are. Progress is kept there as well."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    done: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/result/batch={batch}")
        done.append(batch)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/progress").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    tables = done[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/result/batch={b}" for b in tables])


#: Changed rows of so many batches are merged into one table.
MERGE_EVERY = 8


def latest(changes: DataFrame, key: list[str]) -> DataFrame:
    """The row of the last batch for each key. changes: the keys and values, and batch."""
    rest = [c for c in changes.columns if c != "batch"]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("__row")).select("__row.*")


def run_keyed(stream: DataFrame, name: str, key: list[str], every: int = MERGE_EVERY) -> tuple[DataFrame, dict]:
    """Everything a finite stream holds, in update mode: the last state of each key, and how many batches there were and rows
    that came behind the watermark and were dropped (as counted by the stateful operators, after their partial sums).

    A batch writes its changed rows alone, as a table of its own in the shared folder, so a batch that runs again overwrites
    itself; `every` so many batches the changes are merged by key into one table. Nothing is rewritten for each batch.
    """
    spark, schema = stream.sparkSession, stream.schema
    path = new_path(spark, name)
    tables: dict[int, str] = {}  # last batch in a table -> its path

    def read() -> DataFrame:
        out = None
        for batch, at in sorted(tables.items()):
            rows = spark.read.schema(schema).parquet(at).withColumn("batch", F.lit(batch))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else spark.createDataFrame([], schema).withColumn("batch", F.lit(0))

    def write(rows: DataFrame, batch: int) -> None:
        at = f"{path}/changes/batch={batch}"
        rows.write.mode("overwrite").parquet(at)
        tables[batch] = at
        if len(tables) > every:
            merged = f"{path}/merged/batch={batch}"
            latest(read(), key).write.mode("overwrite").parquet(merged)
            tables.clear()
            tables[batch] = merged

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/progress").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)
    return latest(read(), key), {"batches": len({p.batchId for p in q.recentProgress}), "dropped": dropped}
