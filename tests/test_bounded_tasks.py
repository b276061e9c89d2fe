import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from polyloci.functions.dealing import dealt
from polyloci.functions.rounds import Kept
from polyloci.operators import association as A
from polyloci.operators import classify as C
from polyloci.operators import finemap as I
from polyloci.operators import variants as V


def test_rows_of_rounds_are_read_batch_by_batch(spark):
    df = spark.range(40_000).select(F.lit("a").alias("site"), (F.hash("id") % 3 == 0).alias("case"), (F.col("id") / 40_000).alias("c1"))
    with tempfile.TemporaryDirectory() as folder:
        kept = Kept(iter([pa.RecordBatch.from_pydict({"x": [i, i]}) for i in range(5)]), f"{folder}/rows")
        for _ in range(2):
            assert [b.num_rows for b in kept] == [2] * 5
        assert list(Kept(iter([]), f"{folder}/none")) == []
    x = df.toPandas()
    c, y, b = np.column_stack([np.ones(len(x)), x["c1"]]), x["case"].to_numpy(float), np.zeros(2)
    for _ in range(20):
        mu = 1 / (1 + np.exp(-c @ b))
        b += np.linalg.solve(c.T @ (c * (mu * (1 - mu))[:, None]), c.T @ (y - mu))
    got = A.fit_null(df, covs=("c1",), tasks=1).first()
    assert np.allclose([got["b0"], got["b1"]], b, atol=1e-8)


def test_temperature_of_rows_of_any_length(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, k)), rng.normal(size=k).tolist()) for k in (2, 3, 5) * 30] + [(None, [1.0]), (0, [None, 1.0]), (0, [])]
    loss = {t: np.mean([np.log(np.exp(np.array(z) / t).sum()) - z[y] / t for y, z in rows[:90]]) for t in C.temperature_grid()}
    got = C.fit_temperature(spark.createDataFrame(rows, "y int, logits array<double>").repartition(3)).first()
    assert np.isclose(got["nll"], min(loss.values()), rtol=1e-12) and got["temperature"] == min(loss, key=loss.get)
    assert C.fit_temperature(spark.createDataFrame([], "y int, logits array<double>")).first()["temperature"] is None


def test_effects_that_do_not_vary_have_no_correlation(spark):
    rows = [("a", v, p, e) for v in range(4) for p, e in (("A", 0.5), ("N", 0.1 + v), ("R", 2.0 * v + 1))] + [("b", 0, p, 1.0) for p in "ANR"]
    df = spark.createDataFrame(rows, "t string, variant int, pop string, effect double")
    got = {r["t"]: r for r in I.effect_correlation(df, ["t"], ["A", "N", "R"]).collect()}
    assert np.isnan(got["a"]["r_A_N"]) and np.isclose(got["a"]["r_N_R"], 1) and got["a"]["n"] == 4 and got["b"]["r_A_N"] is None


def test_tasks_grow_in_number_and_not_in_size(spark):
    df = spark.range(5_000).select((F.col("id") % 1000).alias("k"))
    assert dealt(df, ["k"], task_rows=100).rdd.getNumPartitions() == 50
    assert dealt(df, ["k"]).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    scores = spark.createDataFrame([("chr1", 5, "a", 0.5), ("1", 5, "A", 0.25), ("2", 7, "g", 1.0), ("1", 5, "t", 9.0)], "hm_chr string, hm_pos int, effect_allele string, effect_weight double")
    bim = spark.createDataFrame([("x", "1", 5, "G", "A")], "snp_id string, chrom string, bp long, a1 string, a2 string")
    assert [tuple(r)[-2:] for r in V.prepare_scores(scores, bim).collect()] == [(0.75, True)]
