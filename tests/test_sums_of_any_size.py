"""Least squares of any rank, and ranks and running sums whose groups lie in several ranges."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from polyloci.functions.ranks import running_within
from polyloci.functions.sweep import swept, unpacked
from polyloci.operators import association as A
from polyloci.operators import classify as C
from polyloci.operators import cohort as H
from polyloci.operators import finemap as I
from polyloci.operators import results as R
from polyloci.operators import variants as V


def test_sweep_passes_over_what_is_explained():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 5))
    x[:, 2] = 3 * x[:, 0] - x[:, 1]
    m = x.T @ x
    flat = m[np.triu_indices(5)]
    left, rank = swept(unpacked(flat[None], 5), 4)
    y = x[:, 4] - x[:, :4] @ np.linalg.lstsq(x[:, :4], x[:, 4], rcond=None)[0]
    assert rank[0] == 3 and math.isclose(left[0, 4, 4], y @ y, rel_tol=1e-9)


@pytest.mark.parametrize("covs", [(), ("c1",), ("c1", "flat"), ("flat", "c1", "twice", "c2", "site"), ("c1", "c2", "flat", "zero")])
def test_linear_association_with_covariates_of_any_rank(spark, covs):
    rng = np.random.default_rng(len(covs))
    rows = []
    for i in range(300):
        c1, c2, g = float(rng.normal(40, 9)), float(rng.integers(0, 2)), rng.integers(0, 3, 2)
        y = float(3 + 0.4 * g[0] + 0.1 * c1 + c2 + rng.normal())
        rows += [(i % 3, j, int(g[j]), y, c1, c2, 7.0 + i % 3, 2 * c1 + 1, 0.0) for j in range(2)]
    df = spark.createDataFrame(rows, "site int, variant int, dosage int, y double, c1 double, c2 double, flat double, twice double, zero double")
    names = {"site": 0, "c1": 4, "c2": 5, "flat": 6, "twice": 7, "zero": 8}
    for r in A.gwas_linear(df, covs=covs).collect():
        own = [x for x in rows if x[0] == r["site"] and x[1] == r["variant"]]
        x = np.column_stack([np.ones(len(own)), *[[o[names[c]] for o in own] for c in covs], [o[2] for o in own]]).astype(float)
        y = np.array([o[3] for o in own])
        b, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        g = x[:, -1] - x[:, :-1] @ np.linalg.lstsq(x[:, :-1], x[:, -1], rcond=None)[0]
        dof = len(own) - len(covs) - 2
        se = math.sqrt(((y - x @ b) ** 2).sum() / dof / (g @ g))
        assert r["dof"] == dof and math.isclose(r["beta"], b[-1], rel_tol=1e-6) and math.isclose(r["se"], se, rel_tol=1e-6) and math.isclose(r["stat"], b[-1] / se, rel_tol=1e-6)


def test_a_variant_without_variance(spark):
    df = spark.createDataFrame([(0, 0, 1, float(i), float(i % 3), float(i % 2)) for i in range(20)], "site int, variant int, dosage int, y double, c1 double, c2 double")
    r = A.gwas_linear(df).first()
    assert (r["beta"], r["se"], r["stat"]) == (None, None, 0.0)


def test_score_test_with_three_covariates(spark):
    rng = np.random.default_rng(3)
    rows = [(0, 0, int(rng.integers(0, 3)), bool(rng.random() < 0.4), float(rng.normal()), float(rng.normal()), 5.0) for _ in range(300)]
    df = spark.createDataFrame(rows, "site int, variant int, dosage int, case boolean, c1 double, c2 double, flat double")
    two = A.gwas_score(A.null_mean(df, A.fit_null(df)))
    three = A.gwas_score(A.null_mean(df, A.fit_null(df)), covs=("c1", "flat", "c2"))
    for a, b in zip(two.first(), three.first(), strict=True):
        assert math.isclose(a, b, rel_tol=1e-9)


@pytest.mark.parametrize("include", [True, False])
def test_running_sums_over_ranges(spark, include):
    rng = np.random.default_rng(1)
    rows = [(None if i % 5 == 0 else "big" if i % 5 < 4 else f"g{i % 40}", i, int(rng.integers(0, 9))) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    got = {(r["k"], r["o"]): r["s"] for r in running_within(df, ["k"], ["o"], {"s": "v"}, include).collect()}
    total, want = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        want[k, o] = total.get(k, 0) + (v if include else 0)
        total[k] = total.get(k, 0) + v
    assert got == want


def test_one_group_over_all_partitions(spark):
    n = 3000
    df = spark.range(n).select(F.lit("all").alias("k"), "id", (F.col("id") * 48271 % 2003 / 2003).alias("score"), (F.col("id") % 3 == 0).alias("case"))
    rows = df.collect()
    pos, neg = [r["score"] for r in rows if r["case"]], [r["score"] for r in rows if not r["case"]]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert math.isclose(A.auroc(df, "score", "case", ["k"]).first()["auroc"], want, rel_tol=1e-9)
    assert V.sample_variants(df, 0.1, 3, "id").count() == 300
    assert V.sample_strata(df.withColumn("stratum", F.lit("x")), 25, "id", 1).count() == 25
    split = {r["split"]: r["count"] for r in H.patient_holdout(df.withColumn("label", F.lit("a")), "id", "label", 1).groupBy("split").count().collect()}
    assert split == {"test": 600, "validation": 240, "train": 2160}
    pips = df.withColumn("pip", (n - F.col("id")) * 2.0 / (n * (n + 1)))
    chosen = sorted(r["id"] for r in I.credible_set(pips, ["k"], 0.5, order="id").collect())
    mass = np.cumsum([(n - i) * 2.0 / (n * (n + 1)) for i in range(n)])
    assert chosen == list(range(int((mass <= 0.5).sum()) + 1))
    values = spark.range(400).select((F.col("id") % 40).alias("feature"), (F.col("id") / 40).cast("int").alias("t")).select("feature", (F.col("feature") * F.col("t")).alias("value"))
    assert [r["feature"] for r in C.select_panel(values, 5).orderBy("rank").collect()] == [39, 38, 37, 36, 35]


def test_requests_above_capacity_are_errors(spark):
    cap = spark.createDataFrame([("a", 3), ("b", 4)], "cell string, capacity long")
    for f in (lambda: H.allocate(cap, 100, "cell"), lambda: H.allocate_priority(cap, 8, ["cell"])):
        with pytest.raises(PySparkException, match="requested .* available 7"):
            f().collect()
    assert sum(r["quota"] for r in H.allocate(cap, 7, "cell").collect()) == 7
    people = spark.range(5).select("id", F.lit("a").alias("cell"))
    quota = spark.createDataFrame([("a", 6)], "cell string, quota int")
    with pytest.raises(ValueError, match="fewer"):
        H.compose_cohort(people, quota, "id", 1, ["cell"])
    assert H.compose_cohort(people, quota, "id", 1, ["cell"], strict=False).count() == 5


def test_failed_fits_have_no_probabilities(spark):
    pips = spark.createDataFrame([(1, 1, 0.96), (1, 2, 0.4), (2, 1, None), (2, 2, None), (3, 1, 0.97), (4, 5, 0.2)], "k int, variant int, pip double")
    sets = spark.createDataFrame([(1, 0, 1, 0.9), (1, 1, 2, 0.5), (2, 0, 1, 0.8)], "k int, component int, variant int, purity double")
    truth = spark.createDataFrame([(1, 1), (1, 3), (2, 1), (3, 1), (4, 1), (5, 1)], "k int, variant int")
    fits = spark.createDataFrame([(1, True), (2, False), (3, False), (4, True), (5, True)], "k int, converged boolean")
    got = {r["k"]: r for r in I.score_fits(pips, sets, truth, ["k"], fits).collect()}
    one = got[1]
    assert (one["causal_pip_max"], one["causal_pip_mean"], one["causal_pip_mean_eligible"], one["n_true_pip95"], one["n_excluded_causal"], one["n_eligible_causal"]) == (0.96, 0.48, 0.96, 1, 1, 1)
    assert (one["mean_cs_purity"], one["min_cs_purity"], one["n_credible_sets"]) == (0.7, 0.5, 2)
    for k in (2, 3):
        assert (got[k]["causal_pip_max"], got[k]["causal_pip_mean"], got[k]["top_pip"], got[k]["n_true_pip95"]) == (None, None, None, 0)
    assert got[2]["any_causal_captured"] and got[2]["n_eligible_causal"] == 1
    assert (got[4]["causal_pip_max"], got[4]["causal_pip_mean_eligible"], got[4]["top_pip"]) == (0.0, None, 0.2)
    assert (got[5]["top_pip"], got[5]["causal_pip_max"]) == (0.0, 0.0)


def test_candidates_without_sets_are_not_eligible(spark):
    rows = [("a", True, 0.99, 1, 1, 1, 1, 0), ("a", True, 0.5, 2, 1, 1, 0, 0), ("b", True, 0.99, 1, 0, 0, 0, 0), ("c", False, None, 1, 1, 2, 1, 1), ("d", True, 0.97, 3, 2, 2, 1, 0)]
    df = spark.createDataFrame(rows, "m string, captured boolean, causal_pip double, locus int, n_true_sets int, n_sets int, n_true_pip95 int, n_false_pip95 int")
    got = R.rank_candidates(df, "m", ["d"]).orderBy("rank").collect()
    assert [(r["m"], r["eligible"]) for r in got] == [("d", True), ("a", True), ("b", False), ("c", False)]
    assert (got[1]["yield"], got[1]["n_instances"], got[1]["n_loci"], got[2]["coverage"], got[2]["fdr"]) == (0.5, 2, 2, None, None)


def test_outcomes(spark):
    df = spark.createDataFrame([("x", False, True, 1), ("x", False, True, 0), ("x", False, False, 0), ("x", True, False, 2)], "m string, failed boolean, converged boolean, n_sets int")
    assert {r["outcome"]: r["n"] for r in R.outcome_counts(df, ["m"]).collect()} == {"returned": 1, "converged_no_cs": 1, "nonconverged": 1, "error": 1}


def test_cohort_gate(spark):
    files = spark.range(50).select(F.col("id").alias("sample"), F.col("id").alias("patient"))
    cases = spark.range(50).select(F.col("id").alias("patient"), F.when(F.col("id") < 30, "M1").otherwise("M2").alias("label"))
    chosen = H.select_cohort(files, cases, ["M1", "M2"], "patient", "sample", "label")
    assert {r["label"]: r["n"] for r in H.check_cohort(chosen, ["M1", "M2"], "label").collect()} == {"M1": 30, "M2": 20}
    with pytest.raises(ValueError, match="M2"):
        H.check_cohort(chosen, ["M1", "M2"], "label", 21)
