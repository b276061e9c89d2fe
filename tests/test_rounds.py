import numpy as np
import pytest
from pyspark.sql import functions as F

from polyloci.operators import association as A
from polyloci.operators import classify as C


@pytest.mark.parametrize("tasks", [1, 3, 4])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_null_models_in_one_stage(spark, tasks, kind):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for site in range(2):
        c = np.column_stack([rng.normal(size=150), rng.integers(0, 2, 150)])
        y = rng.random(150) < 1 / (1 + np.exp(-(0.3 * site + c @ [0.5, -0.4])))
        rows += [(str(site), bool(y[i]), float(c[i, 0]), float(c[i, 1])) for i in range(150)]
        x, b = np.column_stack([np.ones(150), c]), np.zeros(3)
        for _ in range(30):
            mu = 1 / (1 + np.exp(-x @ b))
            b += np.linalg.solve(x.T @ (x * (mu * (1 - mu))[:, None]), x.T @ (y - mu))
        want[str(site)] = b
    rows.append(("0", None, 1.0, 1.0))
    df = spark.createDataFrame(rows, "site string, case boolean, c1 double, c2 double").withColumn("site", F.col("site").cast(kind))
    spark.sparkContext.setJobGroup(f"null{tasks}{kind}", "null models")
    got = A.fit_null(df, tasks=tasks)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"null{tasks}{kind}")) < 5
    spark.sparkContext.setJobGroup("", "")
    assert dict(got.dtypes)["site"] == kind
    found = {str(r["site"]): [r[f"b{i}"] for i in range(3)] for r in got.collect()}
    assert found.keys() == want.keys() and all(np.allclose(found[s], want[s], atol=1e-8) for s in want)


def test_null_models_of_no_rows_and_of_fewer_rows_than_tasks(spark):
    df = spark.createDataFrame([(1, True, 0.5), (1, False, 0.5), (1, True, 0.5)], "site int, case boolean, c1 double")
    assert np.isclose((lambda r: r["b0"] + 0.5 * r["b1"])(A.fit_null(df, covs=("c1",), tasks=4).first()), np.log(2))
    assert A.fit_null(df.limit(0), covs=("c1",)).count() == 0


@pytest.mark.parametrize("tasks", [1, 4])
def test_federated_rounds_are_gradient_descent_by_site(spark, tasks):
    rng = np.random.default_rng(9)
    x, site = rng.normal(size=(120, 2)), rng.integers(0, 3, 120)
    y, test = (x[:, 0] + 0.3 * rng.normal(size=120) > 0).astype(int), np.arange(120) % 4 == 0
    df = spark.createDataFrame([(f"s{site[i]}", x[i].tolist(), int(y[i]), bool(test[i])) for i in range(120)], "site string, x array<double>, y int, test boolean")
    f = np.column_stack([np.ones(120), x])
    w, want = np.zeros(3), []
    for r in range(4):
        want.append((r, int(test.sum()), float(((f[test] @ w > 0) == y[test]).mean())))
        parts = []
        for s in range(3):
            own, v = (site == s) & ~test, w.copy()
            for _ in range(5):
                v -= 0.8 * f[own].T @ (1 / (1 + np.exp(-f[own] @ v)) - y[own]) / own.sum()
            parts.append(v * own.sum())
        w = sum(parts) / (~test).sum()
    assert [tuple(r) for r in C.fed_logistic(df, 3, steps=5, rate=0.8, tasks=tasks).orderBy("round").collect()] == want
    assert [tuple(r) for r in C.fed_logistic(df.filter("NOT test"), 1, steps=1).orderBy("round").collect()] == [(0, 0, None), (1, 0, None)]
