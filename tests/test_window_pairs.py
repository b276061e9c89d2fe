import random

import pyarrow as pa

from polyloci.operators import variants as V


def test_pairs_come_in_order(spark):
    """All pairs, each variant's windows in order of start, variants in order of position: before, a file of the pairs took eight times the bytes."""
    rng = random.Random(5)
    variants = [(i, rng.choice([1, 2, None]), rng.choice([None, *range(3000)])) for i in range(1500)]
    windows = [(i, rng.choice([1, 2, None]), s := rng.randrange(3000), s + rng.randrange(900)) for i in range(120)] + [(200, 1, 50, 40), (201, 1, 7, 7), (202, 2, None, 9)]
    v = spark.createDataFrame(variants, "variant long, chrom int, bp long").repartition(3)
    w = spark.createDataFrame(windows, "window long, chrom int, start_bp long, end_bp long").repartition(3)
    want = {(a, b) for a, c, p in variants for b, d, s, e in windows if c is not None and c == d and p is not None and s is not None and s <= p <= e}
    tasks = V.assign_windows(v, w, 500).select("variant", "window").rdd.glom().collect()
    assert sorted((r["variant"], r["window"]) for t in tasks for r in t) == sorted(want)
    bp, start = {a: p for a, _, p in variants}, {b: s for b, _, s, _ in windows}
    keys = [[(r["variant"], bp[r["variant"]], start[r["window"]]) for r in t] for t in tasks]
    for t in keys:
        runs = 1 + sum(x[0] != y[0] for x, y in zip(t, t[1:])) if t else 0
        assert runs == len({x[0] for x in t})
        assert all(x[2] <= y[2] for x, y in zip(t, t[1:]) if x[0] == y[0])
        back = sum(x[1] > y[1] for x, y in zip(t, t[1:]))
        assert back <= 2 * 7  # at most once for each bucket of a chromosome


def test_dense_pairs_take_little_room(spark, tmp_path):
    """Where a variant has hundreds of windows, files of all pairs take under a third of a byte a pair (before, 0.61), also where a
    bucket is crowded."""
    rng = random.Random(7)
    variants = [(i, "1", rng.randrange(500)) for i in range(3000)]
    windows = [(i, "1", s := rng.randrange(-2000, 500), s + 200 + 100 * rng.randrange(1, 20)) for i in range(1500)] + [(5000 + i, "1", 250, 250) for i in range(300)]
    v = spark.createDataFrame(variants, "variant long, chrom string, bp long")
    w = spark.createDataFrame(windows, "window long, chrom string, start_bp long, end_bp long")
    V.assign_windows(v, w, 2000).select("variant", "window").write.parquet(out := str(tmp_path / "pairs"))
    got = spark.read.parquet(out)
    want = sorted((a, b) for a, _, p in variants for b, _, s, e in windows if s <= p <= e)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < len(want) / 3


def test_batches_of_pairs_are_bounded():
    """Every variant of a crowded bucket lies in every window; no batch is larger than a block of both."""
    v = pa.RecordBatch.from_pydict({"lo": [5] * 3000, "v0": list(range(3000))})
    w = pa.RecordBatch.from_pydict({"lo": [0] * 700, "hi": [9] * 700, "w0": list(range(700))})
    rows = [b.num_rows for b in V._pairs(v, w, ["v0"], ["w0"], ["variant", "window"])]
    assert sum(rows) == 3000 * 700 and max(rows) == V.BLOCK_VARIANTS * V.BLOCK_WINDOWS


def test_many_variants_go_to_many_tasks(spark):
    """A task has so few variants that a file's dictionary holds them: before, all 500,000 came to a few tasks."""
    v = spark.range(500_000).selectExpr("id AS variant", "1 AS chrom", "id % 100000 AS bp")
    w = spark.range(20).selectExpr("id AS window", "1 AS chrom", "id * 5000 AS start_bp", "id * 5000 AS end_bp")
    df = V.assign_windows(v, w, 2000).select("variant", "window")
    assert df.rdd.getNumPartitions() >= 10 and df.count() == 100
