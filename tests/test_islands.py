import random

import pytest
from pyspark.sql import functions as F

from polyloci.operators import variants as V


def windows(seed, n=250, length=4000):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 2, None]), s := rng.randrange(length), s + rng.randrange(60), rng.choice("xyz"), float(rng.randrange(30))) for i in range(n)]
    return rows + [(n + 1, 1, 9000, 9000, "x", 1.0), (n + 2, 1, 9000, 9000, "x", 0.0), (n + 3, 1, 9001, 9002, "x", 0.0)]


SCHEMA = "w long, chrom int, start_bp long, end_bp long, stratum string, score double"


def greedy(rows, within):
    kept = []
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        same = [k for k in kept if k[1] == r[1] and (not within or k[4] == r[4])]
        if not any(k[2] <= r[3] and r[2] <= k[3] for k in same):
            kept.append(r)
    return {r[0] for r in kept}


@pytest.mark.parametrize("task_windows", [1, 5, 100_000])
@pytest.mark.parametrize("within", [[], ["stratum"]])
def test_choice_is_that_of_one_by_one(spark, task_windows, within):
    rows = windows(len(within) + task_windows)
    rows = [r for r in rows if r[1] is not None] if task_windows < 100 else rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["w"] for r in V.drop_overlaps(df, 50, ["score"], "w", within, task_windows).collect()}
    assert got == greedy(rows, within)


def test_islands_over_many_ranges(spark):
    rows = [r for r in windows(9, 600, 40_000) if r[1] is not None]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r["w"]: r["region"] for r in V.region_ids(df).collect()}
    assert len(got) == len(rows)
    for chrom in (1, 2):
        region, end, want = 0, None, {}
        for r in sorted((r for r in rows if r[1] == chrom), key=lambda r: (r[2], r[3])):
            if end is None or r[2] > end:
                region += 1
            end = r[3] if end is None else max(end, r[3])
            want[r[0]] = region
        assert {k: got[k] for k in want} == want


def test_few_jobs(spark):
    df = spark.createDataFrame(windows(3), SCHEMA).filter("chrom IS NOT NULL")
    spark.sparkContext.setJobGroup("islands", "islands")
    V.drop_overlaps(df, 50, ["score"], "w").write.format("noop").mode("overwrite").save()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("islands"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 30
    assert V.drop_overlaps(df.filter(F.lit(False)), 50, ["score"], "w").count() == 0
