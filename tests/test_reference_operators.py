"""Closed forms, known answers and invariances of the operators; no llm import here."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyloci.functions import scalars as S
from polyloci.functions.ranks import rank_within
from polyloci.operators import association as A
from polyloci.operators import classify as C
from polyloci.operators import cohort as H
from polyloci.operators import finemap as I
from polyloci.operators import moments as M
from polyloci.operators import policy as P
from polyloci.operators import results as R
from polyloci.operators import variants as V


def _t(t, df):
    return S.t_tails(np.array([t], float), np.array([df], float))[0]


def test_tails_of_known_values():
    assert _t(0.0, 5) == 1.0
    assert math.isclose(_t(2.570581835636314, 5), 0.05, rel_tol=1e-9)
    assert math.isclose(_t(12.706204736174698, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(_t(1.959963984540054, 1e9), 0.05, rel_tol=1e-6)
    assert _t(1e6, 100) == S.TINY or _t(1e6, 100) < 1e-300


def test_tail_columns(spark):
    df = spark.createDataFrame([(1.959963984540054, 10.0), (0.0, 3.0), (60.0, 4.0), (None, 2.0)], "z double, df double")
    rows = df.select(S.p_norm("z").alias("n"), S.p_chi2(F.col("z") * F.col("z")).alias("c"), S.p_t("z", "df").alias("t")).collect()
    assert math.isclose(rows[0]["n"], 0.05, rel_tol=1e-12) and math.isclose(rows[0]["c"], 0.05, rel_tol=1e-12)
    assert rows[1]["n"] == 1.0 and rows[2]["n"] == S.TINY and rows[3]["n"] is None


def test_chromosomes_and_ids(spark):
    df = spark.createDataFrame([("chrX",), (" mt ",), ("22",), ("XY",), ("weird",)], "c string")
    assert [r[0] for r in df.select(S.normalize_chr(F.col("c"))).collect()] == [23, 26, 22, 25, None]
    one = spark.createDataFrame([("L7_ncsl3_h2-0.001_rg-0.5_rep12",), ("bad",)], "instance string")
    row, bad = S.parse_architecture(S.split_instance(one)).collect()
    assert (row["locus_id"], row["ncsl"], row["h2"], row["rg"], row["replicate"]) == ("L7", 3, 0.001, -0.5, 12)
    assert bad["locus_id"] is None and bad["h2"] is None


def people(seed, n=400, variants=5):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, (n, variants))
    c1, c2 = rng.normal(50, 10, n), rng.integers(0, 2, n)
    y = 3 + 0.5 * g[:, 0] - 0.2 * g[:, 1] + 0.05 * c1 + c2 + rng.normal(0, 1, n)
    case = rng.random(n) < 1 / (1 + np.exp(-(-1 + 0.4 * g[:, 0] + 0.01 * c1)))
    return g, c1, c2, y, case


def long_rows(spark, g, c1, c2, y, case, sites=3):
    rows = [(int(i % sites), j, int(g[i, j]), float(y[i]), float(c1[i]), float(c2[i]), bool(case[i])) for i in range(len(y)) for j in range(g.shape[1])]
    return spark.createDataFrame(rows, "site int, variant int, dosage int, y double, c1 double, c2 double, case boolean")


@pytest.mark.parametrize("shift", [0.0, 1000.0])
def test_linear_association_is_least_squares(spark, shift):
    g, c1, c2, y, case = people(1)
    got = {(r["site"], r["variant"]): r for r in A.gwas_linear(long_rows(spark, g, c1, c2, y, case), y_shift=shift).collect()}
    for site in range(3):
        own = np.arange(len(y)) % 3 == site
        for j in range(g.shape[1]):
            x = np.column_stack([np.ones(own.sum()), c1[own], c2[own], g[own, j]])
            b, *_ = np.linalg.lstsq(x, y[own], rcond=None)
            rss = ((y[own] - x @ b) ** 2).sum()
            se = math.sqrt(rss / (own.sum() - 4) * np.linalg.inv(x.T @ x)[3, 3])
            assert math.isclose(got[site, j]["beta"], b[3], rel_tol=1e-6) and math.isclose(got[site, j]["se"], se, rel_tol=1e-6)


def test_logistic_score_against_newton(spark):
    g, c1, c2, y, case = people(2)
    df = long_rows(spark, g, c1, c2, y, case, sites=1)
    null = A.fit_null(df)
    b = np.array([null.first()[f"b{i}"] for i in range(3)])
    x = np.column_stack([np.ones(len(y)), c1, c2])
    want = np.zeros(3)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-x @ want))
        want += np.linalg.solve(x.T @ (x * (mu * (1 - mu))[:, None]), x.T @ (case - mu))
    assert np.allclose(b, want, atol=1e-6)
    mu = 1 / (1 + np.exp(-x @ want))
    w = mu * (1 - mu)
    got = {r["variant"]: r for r in A.gwas_score(A.null_mean(df, null)).collect()}
    for j in range(g.shape[1]):
        gr = g[:, j] - x @ np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * g[:, j]))
        info = (w * gr * gr).sum()
        assert math.isclose(got[j]["beta"], (gr * (case - mu)).sum() / info, rel_tol=1e-5)
        assert math.isclose(got[j]["se"], 1 / math.sqrt(info), rel_tol=1e-6)


def test_meta_known_answers(spark):
    rows = [("a", 1, 0.5, 0.1), ("a", 2, 0.2, 0.1), ("b", 1, None, None), ("b", 2, 0.3, 0.1), ("a", 3, None, None), ("b", 3, float("nan"), 0.1)]
    got = {r["variant"]: r for r in A.meta_ivw(spark.createDataFrame(rows, "site string, variant int, beta double, se double"), ["variant"]).collect()}
    assert math.isclose(got[1]["beta"], 0.5) and math.isclose(got[2]["beta"], 0.25) and math.isclose(got[2]["se"], math.sqrt(0.005))
    assert got[3]["beta"] is None and got[3]["se"] is None and got[3]["stat"] == 0.0


def test_duplicate_keys_are_an_error(spark):
    fam = spark.createDataFrame([(1,), (2,)], "iid int")
    twice = spark.createDataFrame([(1, 2.0), (1, 3.0)], "iid int, v double")
    with pytest.raises(ValueError, match="pheno"):
        A.assemble_samples(fam, twice, fam, fam, ["iid"])


def test_strict_z_score(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0)], "g int, x double")
    assert [r["z"] for r in S.zscore(df, "x", ["g"], "z").collect()] == [0.0, 0.0]
    with pytest.raises(Exception, match="does not vary"):
        S.zscore(df, "x", ["g"], "z", strict=True).collect()


def test_pooled_correlation_of_two_sites(spark):
    a, b = [[2, 2], [2, 1], [0, 0]], [[0, 0], [0, 1], [2, 2]]
    rows = [(s, f"{s}{i}", j, d) for s, m in (("A", a), ("B", b)) for i, r in enumerate(m) for j, d in enumerate(r)]
    g, u = M.geno_moments(spark.createDataFrame(rows, "site string, sample string, j int, dosage int"), ["site"])
    pooled = M.pooled_ld(M.pool(g.withColumn("k", F.lit(1)), ["k", "i", "j"], ["g"]), M.pool(u.withColumn("k", F.lit(1)), ["k", "j"], ["u", "n"]), ["k"])
    r = {(x["i"], x["j"]): x["r"] for x in pooled.collect()}
    assert math.isclose(r[0, 1], 0.8165, abs_tol=5e-5) and r[0, 0] == 1.0
    alone = {(x["site"], x["i"], x["j"]): x["r"] for x in M.pooled_ld(g, u, ["site"]).collect()}
    assert math.isclose(alone["A", 0, 1], 0.866, abs_tol=5e-4)


@pytest.mark.parametrize("sites", [1, 2, 5])
def test_pooling_does_not_depend_on_the_sites(spark, sites):
    g, *_, y, _ = people(3, 60, 4)
    rows = [(int(i * 7 % sites), i, j, int(g[i, j])) for i in range(60) for j in range(4)]
    geno = spark.createDataFrame(rows, "site int, sample int, j int, dosage int")
    gm, _ = M.geno_moments(geno, ["site"])
    want = {(i, j): int((g[:, i] * g[:, j]).sum()) for i in range(4) for j in range(i, 4)}
    assert {(r["i"], r["j"]): r["g"] for r in M.pool(gm, ["i", "j"], ["g"]).collect()} == want
    assert {(r["i"], r["j"]): r["g"] for r in M.pool(M.geno_moments(geno, ["site"], rows=7)[0], ["i", "j"], ["g"]).collect()} == want


def test_masked_sum(spark):
    rows = [(s, e, v) for e, vs in (("x", (1.5, -2.25, 4.0)), ("y", (0.0, -1.0, -1e6)), ("z", (1.0, 2.0, None))) for s, v in zip("ABC", vs, strict=True) if v is not None]
    masked = M.mask_moments(spark.createDataFrame(rows, "site string, element string, value double"), list("ABC"), "key")
    got = {r["element"]: (r["complete"], r["value"]) for r in M.secure_sum(masked, list("ABC")).collect()}
    assert got == {"x": (True, 3.25), "y": (True, -1000001.0), "z": (False, None)}
    assert all(abs(float(r["masked"])) > 1e9 for r in masked.collect())


def test_greedy_windows_as_one_by_one(spark):
    rng = random.Random(4)
    for _ in range(3):
        rows = [(k, rng.randint(0, 1), s := rng.randint(0, 300), s + rng.randint(1, 30), rng.randint(0, 9)) for k in range(60)]
        kept = []
        for k, c, s, e, _p in sorted(rows, key=lambda r: (r[4], r[0])):
            if not any(c == c2 and s <= e2 and s2 <= e for _, c2, s2, e2 in kept):
                kept.append((k, c, s, e))
        df = spark.createDataFrame(rows, "w int, chrom int, start_bp int, end_bp int, prio int")
        assert {r["w"] for r in V.drop_overlaps(df, 50, ["prio"], "w").collect()} == {k[0] for k in kept}


def test_pruning_from_left_to_right(spark):
    rng = random.Random(5)
    r2 = {(i, j): rng.random() for i in range(20) for j in range(i + 1, 20)}
    kept = []
    for j in range(20):
        if not any(r2[i, j] >= 0.8 for i in kept[-4:]):
            kept.append(j)
    edges = spark.createDataFrame([(0, i, j, v) for (i, j), v in r2.items()], "k int, i int, j int, r2 double")
    v = spark.createDataFrame([(0, j) for j in range(20)], "k int, j int")
    assert sorted(r["j"] for r in V.ld_prune(edges, v, ["k"], 0.8, 4).collect()) == kept


def test_terciles_leave_the_rest_in_the_middle(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(11)], "k int, score double")
    got = {r["stratum"]: r["count"] for r in V.stratify(df, "score", ["k"]).groupBy("stratum").count().collect()}
    assert got == {"low": 3, "medium": 5, "high": 3}
    with pytest.raises(ValueError, match="fewer than 4"):
        V.sample_strata(V.stratify(df, "score", ["k"]), 4, "k", 1)


def test_overall_pip_and_purity(spark):
    df = spark.createDataFrame([(1, 0.4), (1, 0.4), (2, 0.9), (2, 0.0), (3, 1.0), (3, 0.5), (4, 1.5)], "v int, alpha double")
    got = {r["v"]: r["pip"] for r in I.overall_pip(df, ["v"]).collect()}
    assert math.isclose(got[1], 0.64) and math.isclose(got[2], 0.9) and got[3] == 1.0 and got[4] is None
    members = spark.createDataFrame([(1, 1, v) for v in (0, 1)], "locus int, component int, variant int")
    ld = spark.createDataFrame([(1, "a", 0, 1, -0.8), (1, "b", 0, 1, 0.2)], "locus int, pop string, i int, j int, r double")
    assert I.purity(members, ld, ["locus", "component"], ["locus"]).first()["purity"] == 0.8
    assert I.purity(members, ld.filter("pop = 'b'"), ["locus", "component"], ["locus"], pairwise=True).first()["purity"] == 0.2


def test_joint_fit_on_constructed_loci(spark):
    m, n = 12, 2000
    ld = np.eye(m)
    ld[3, 4] = ld[4, 3] = 1.0
    beta = np.zeros(m)
    beta[7] = 0.3
    alpha, _, _, ok = I.ibss([beta], [np.eye(m)], [n], [0.09], effects=3)
    assert ok and alpha[:, 7].max() > 0.999
    beta = np.zeros(m)
    beta[3] = beta[4] = 0.3
    alpha, _, _, ok = I.ibss([beta], [ld], [n], [0.09], effects=1)
    assert ok and np.allclose(alpha[0, [3, 4]], 0.5, atol=1e-6)
    rows = [(1, "a", j, float(b), n) for j, b in enumerate(np.linspace(0, 0.1, m))]
    ss = spark.createDataFrame(rows, "locus int, pop string, j int, beta_hat double, n int")
    tau = ss.groupBy("locus", "pop").agg(F.max(F.col("beta_hat") * F.col("beta_hat")).alias("tau_sq"))
    single = {r["j"]: r["pip"] for r in I.single_effect_pip(ss, tau, ["locus"]).collect()}
    full = spark.createDataFrame([(1, "a", i, j, 1.0 if i == j else 0.0) for i in range(m) for j in range(i, m)], "locus int, pop string, i int, j int, r double")
    fit = I.fit_multi_effect(ss, full, ["locus"], ["locus"], effects=1, most=1).collect()
    assert all(math.isclose(r["alpha"], single[r["variant"]], rel_tol=1e-9) for r in fit)


def test_repeating_rows_leaves_the_cluster_interval(spark):
    df = spark.createDataFrame([(c, float(c % 3), 1.0 + c % 2) for c in range(9)], "c int, num double, den double").withColumn("g", F.lit(1))
    ten = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(10))))
    one = R.clustered_ratio(df, "num", "den", "c", ["g"], 300).first()
    many = R.clustered_ratio(ten, "num", "den", "c", ["g"], 300).first()
    assert all(math.isclose(one[k], many[k], rel_tol=1e-12) for k in ("ratio", "lo", "hi")) and one["lo"] <= one["ratio"] <= one["hi"]
    single = R.clustered_ratio(df.filter("c = 1"), "num", "den", "c", ["g"], 50).first()
    assert single["lo"] is None and single["hi"] is None


def test_equal_methods_have_no_difference(spark):
    df = spark.createDataFrame([(m, c, float(c % 3)) for m in ("x", "y") for c in range(8)], "method string, c int, v double")
    r = R.paired_method_summary(df, {"a": (F.col("v"), F.lit(1.0))}, "method", ("x", "y"), "c", 100).first()
    assert r["difference"] == 0 and r["lo"] == 0 and r["hi"] == 0
    with pytest.raises(ValueError, match="unique"):
        R.paired_differences(df.unionByName(df), ["c"], "v", "method", "x", "c", 10)


def test_cohorts_are_nested_and_disjoint(spark):
    people = spark.createDataFrame([(i, i % 3) for i in range(300)], "id int, pop int")
    quota = lambda q: spark.createDataFrame([(p, q) for p in range(3)], "pop int, quota int")
    small = {r["id"] for r in H.compose_cohort(people, quota(10), "id", 1, ["pop"]).collect()}
    large = {r["id"] for r in H.compose_cohort(people, quota(40), "id", 1, ["pop"]).collect()}
    assert len(small) == 30 and small < large
    q = spark.createDataFrame([(p, s, 20) for p in range(3) for s in ("a", "b")], "pop int, site string, quota int")
    got = H.assign_individuals(people, q, "id", 3).collect()
    assert len(got) == len({r["id"] for r in got}) == 120
    with pytest.raises(ValueError, match="too few"):
        H.assign_individuals(people, q.withColumn("quota", F.lit(90)), "id", 3)


def test_panel_components_against_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 6)) @ np.diag([5, 3, 1, 1, 1, 1])
    rows = [(i, j, float(x[i, j])) for i in range(40) for j in range(6)]
    s, share = C.panel_pca(spark.createDataFrame(rows, "s int, f int, v double"), "s", "f", "v")
    c = x - x.mean(0)
    _, d, vt = np.linalg.svd(c, full_matrices=False)
    got = np.array([[r["pc1"], r["pc2"]] for r in s.orderBy("s").collect()])
    assert np.allclose(np.abs(got), np.abs(c @ vt[:2].T), atol=1e-6) and np.allclose(share, (d**2 / (d**2).sum())[:2])


def test_federated_logistic_learns_and_one_site_is_gradient_descent(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] > 0).astype(int)
    rows = [(int(i % 2), x[i].tolist(), int(y[i]), bool(i % 5 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "site int, x array<double>, y int, test boolean")
    out = C.fed_logistic(df, 2, steps=6, rate=1.0).orderBy("round").collect()
    assert out[-1]["accuracy"] >= 0.85 and [r["round"] for r in out] == [0, 1, 2]


def test_balanced_accuracy_interval_redraws_binomials(spark):
    cm = spark.createDataFrame([(0, 0, 80), (0, 1, 20), (1, 1, 60), (1, 0, 40)], "y int, pred int, n int")
    r = C.balanced_accuracy_interval(cm).first()
    rng = np.random.default_rng(0)
    want = np.percentile(np.mean([rng.binomial(100, 0.8, size=4000) / 100, rng.binomial(100, 0.6, size=4000) / 100], axis=0), [2.5, 97.5])
    assert math.isclose(r["balanced_accuracy"], 0.7) and np.allclose([r["lo"], r["hi"]], want)


def test_ratio_of_draws_with_nothing_to_divide_by(spark):
    """Three clusters, one of which has a denominator: draws without it are left out, and the others give 1."""
    df = spark.createDataFrame([("a", 2.0, 2.0), ("b", 0.0, 0.0), ("c", 0.0, 0.0)], "cluster string, num double, den double")
    x = R.clustered_ratio(df, "num", "den", "cluster", []).first()
    assert (x["ratio"], x["lo"], x["hi"]) == (1.0, 1.0, 1.0)
    none = R.clustered_ratio(df.filter("num = 0"), "num", "den", "cluster", []).first()
    assert none["ratio"] is None and none["lo"] is None and none["hi"] is None


@pytest.mark.parametrize(("n", "k"), [(9, 8), (100, 7), (5, 5), (3, 8), (50, 1), (1000, 333)])
def test_even_places(spark, n, k):
    got = [r["j"] for r in V.even_stride(spark.range(n).selectExpr("0 AS g", "id AS j"), ["g"], "j", k).orderBy("j").collect()]
    assert got == (list(range(n)) if n <= k else np.unique(np.linspace(0, n - 1, k).round().astype(int)).tolist())


def test_macro_f1_counts_all_classes_with_logits(spark):
    df = spark.createDataFrame([(0, [2.0, 0.0, 0.0]), (1, [0.0, 3.0, 0.0]), (1, [2.0, 0.0, 0.0])], "y int, logits array<double>")
    x = C.classification_metrics(C.softmax_columns(df), []).first()
    assert math.isclose(x["macro_f1"], (2 / 3 + 2 / 3 + 0) / 3) and math.isclose(x["balanced_accuracy"], 0.75)


FLAGS = ["non_commercial", "not_for_profit_organisation", "publication_agreed", "collaboration_agreed", "moratorium_accepted", "return_to_resource_agreed"]
G, POP, ANC, METH = "DUO:0000038", "DUO:0000032", "DUO:0000033", "DUO:0000031"
#: permission, its values, modifiers, what the request says besides (genetic research by me@example.org), decision on 2026-06-01
CASES = [
    *[(P.GENERAL, [], [], {"purposes": [p]}, "permitted") for p in (G, POP, ANC, METH)],
    (P.UNRESTRICTED, [], [], {"purposes": [G, POP, METH]}, "permitted"),
    ("none", [], [], {}, "denied"),
    (P.HEALTH, [], [], {"purposes": [POP]}, "denied"),
    (P.HEALTH, [], [], {}, "permitted"),
    (P.HEALTH, [], [], {"purposes": [G, POP]}, "denied"),
    (P.DISEASE, ["type 2 diabetes"], [], {"disease": "Type 2 Diabetes"}, "permitted"),
    (P.DISEASE, ["type 2 diabetes"], [], {"disease": "asthma"}, "denied"),
    (P.DISEASE, ["type 2 diabetes"], [], {}, "denied"),
    (P.POPULATION, [], [], {"purposes": [ANC]}, "permitted"),
    (P.POPULATION, [], [], {}, "denied"),
    (P.GENERAL, [], [(P.NO_ANCESTRY, None)], {"purposes": [POP]}, "denied"),
    (P.GENERAL, [], [(P.NO_ANCESTRY, None)], {}, "permitted"),
    (P.GENERAL, [], [(P.NO_METHODS, None)], {"purposes": [METH]}, "denied"),
    (P.GENERAL, [], [(P.NO_METHODS, None)], {}, "permitted"),
    *[case for code, flags in P.ATTESTED.items() for case in ((P.GENERAL, [], [(code, None)], {}, "denied"), (P.GENERAL, [], [(code, None)], {f: True for f in flags}, "permitted"))],
    (P.GENERAL, [], [(P.NON_PROFIT_NON_COMMERCIAL, None)], {"non_commercial": True}, "denied"),
    (P.GENERAL, [], [(P.ETHICS, None)], {}, "denied"),
    (P.GENERAL, [], [(P.ETHICS, None)], {"ethics_approval": "IRB-2026-114"}, "permitted"),
    (P.GENERAL, [], [(P.ETHICS, None)], {"acknowledged": [P.ETHICS]}, "denied"),
    (P.GENERAL, [], [(P.USER, ["me@example.org"])], {}, "permitted"),
    (P.GENERAL, [], [(P.USER, ["me@example.org"])], {"requester": "someone@else.org"}, "denied"),
    (P.GENERAL, [], [(P.USER, ["me@example.org"])], {"requester": ""}, "denied"),
    *[case for code, f in ((P.PROJECT, "project"), (P.INSTITUTION, "institution"), (P.GEOGRAPHY, "geography")) for case in ((P.GENERAL, [], [(code, ["ALPHA"])], {f: "alpha"}, "permitted"), (P.GENERAL, [], [(code, ["ALPHA"])], {f: "beta"}, "denied"), (P.GENERAL, [], [(code, ["ALPHA"])], {}, "denied"), (P.GENERAL, [], [(code, ["", "  "])], {f: ""}, "undetermined"), (P.GENERAL, [], [(code, None)], {f: "alpha"}, "undetermined"))],
    (P.GENERAL, [], [(P.TIME_LIMIT, [" 2026-06-01 "])], {}, "permitted"),
    (P.GENERAL, [], [(P.TIME_LIMIT, ["2026-05-31"])], {"acknowledged": [P.TIME_LIMIT]}, "denied"),
    *[(P.GENERAL, [], [(P.TIME_LIMIT, [t])], {}, "undetermined") for t in ("31-12-2020", "December 2020", "2020/12/31", "soon", "10000 years")],
    (P.GENERAL, [], [(P.TIME_LIMIT, ["soon"])], {"acknowledged": [P.TIME_LIMIT]}, "permitted"),
    *[(permission, [], mods, {"purposes": p}, "denied") for permission, mods in ((P.HEALTH, []), (P.POPULATION, []), (P.GENERAL, [(P.GENETIC_ONLY, None)])) for p in ([], None)],
    (P.GENERAL, [], [(P.GENETIC_ONLY, None)], {"purposes": [G, "DUO:0000037"]}, "denied"),
    (P.GENERAL, [], None, {"acknowledged": None}, "permitted"),
    (P.GENERAL, [], [(P.RESEARCH_TYPE, ["no use in studies of X"])], {}, "undetermined"),
    (P.GENERAL, [], [(P.RESEARCH_TYPE, ["no use in studies of X"])], {"acknowledged": [P.RESEARCH_TYPE]}, "permitted"),
    (P.GENERAL, [], [(P.CLINICAL_CARE, None), ("DUO:0000001", None)], {}, "undetermined"),
    (P.GENERAL, [], [(P.CLINICAL_CARE, None)], {}, "permitted"),
]


def test_data_use_rules(spark):
    base = {"disease": None, "geography": None, "requester": "me@example.org", "project": None, "institution": None, "ethics_approval": None, "purposes": [G], "acknowledged": [], **{f: None for f in FLAGS}}
    prof = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "dataset_id int, permission string, permission_value array<string>, modifiers array<struct<id:string,value:array<string>>>")
    text = "disease string, geography string, requester string, project string, institution string, ethics_approval string, purposes array<string>, acknowledged array<string>, " + ", ".join(f"{f} boolean" for f in FLAGS)
    req = spark.createDataFrame([(i, *(base | c[3]).values()) for i, c in enumerate(CASES)], "request_id int, " + text)
    rows = P.evaluate_data_use(prof, req, "2026-06-01").filter("dataset_id = request_id").collect()
    got = {r["dataset_id"]: r["decision"] for r in rows}
    assert [got[i] for i in range(len(CASES))] == [c[4] for c in CASES], [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[4]]


def test_ranks_within_groups_of_any_size(spark):
    rng = random.Random(2)
    rows = [(k, "a" if k % 3 else "b", rng.randint(0, 5)) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, g string, v int")
    for by in (["g"], []):
        x = rank_within(df.withColumn("one", F.lit(1)), by or ["one"], ["v", "k"], "r").collect()
        groups = {"a", "b"} if by else {None}
        for g in groups:
            want = [k for _, k in sorted((v, k) for k, h, v in rows if g in (None, h))]
            own = sorted((r for r in x if g in (None, r["g"])), key=lambda r: r["r"])
            assert [r["k"] for r in own] == want and [r["r"] for r in own] == list(range(len(want))) and {r["r_n"] for r in own} == {len(want)}
    assert rank_within(df.limit(0), ["g"], ["v", "k"], "r").count() == 0


def greedy(rows):
    kept = []
    for row in rows:
        if not any(row[1] == k[1] and row[2] <= k[3] and k[2] <= row[3] for k in kept):
            kept.append(row)
    return kept


def test_overlaps_go_in_two_passes_by_extremeness(spark):
    rng = random.Random(8)
    for n in (0, 1, 80):
        rows = [(k, rng.randint(0, 1), s := rng.randint(0, 400), s + rng.randint(1, 30), float(rng.randint(0, 20)), rng.choice(["high", "low", "medium"])) for k in range(n)]
        first = []
        for stratum in ("high", "low", "medium"):
            own = [r for r in rows if r[5] == stratum]
            middle = float(np.median([r[4] for r in own])) if own else 0.0
            far = {"high": lambda r: -r[4], "low": lambda r: r[4], "medium": lambda r, m=middle: abs(r[4] - m)}[stratum]
            ranked = sorted(own, key=lambda r: (far(r), r[0]))
            first += greedy([(*r, i / len(own)) for i, r in enumerate(ranked)])
        want = {r[0] for r in greedy(sorted(first, key=lambda r: (r[6], r[5])))}
        df = spark.createDataFrame(rows, "w int, chrom int, start_bp int, end_bp int, score double, stratum string")
        got = V.drop_overlaps_by_extremeness(df, 50, "score", "w")
        assert got.columns == df.columns and {r["w"] for r in got.collect()} == want


def test_a_third_of_each_stratums_regions_is_for_development(spark):
    rows = [(k, k % 2, 100 * k + d, 100 * k + d + 20, ["low", "high"][k % 5 == 0]) for k in range(40) for d in (0, 10)]
    df = spark.createDataFrame(rows, "w int, chrom int, start_bp int, end_bp int, stratum string")
    x = V.split_regions(df, 3).collect()
    regions = {(r["chrom"], r["region"]): (r["stratum"], r["split"]) for r in x}
    assert len(x) == 80 and len(regions) == 40
    count = {s: sum(v == s for v in regions.values()) for s in set(regions.values())}
    assert count == {("low", "development"): 10, ("low", "evaluation"): 22, ("high", "development"): 2, ("high", "evaluation"): 6}
    with pytest.raises(ValueError, match="fewer than two"):
        V.split_regions(df.filter("w in (0, 1, 2)"), 3)


def test_sites_have_their_capacities_and_the_class_minimum(spark):
    people = spark.createDataFrame([(k, "abc"[min(2, k % 7 // 2)]) for k in range(101)], "k int, label string")
    got = H.partition_sites(people, "k", "label", 0.3, 0.1, 5, minimum=2).collect()
    assert sorted(r["k"] for r in got) == list(range(101))
    assert [sum(r["site"] == s for r in got) for s in range(4)] == [31, 30, 30, 10] == H.site_capacities(101, 0.1)
    assert min(sum(r["site"] == s and r["label"] == c for r in got) for s in range(4) for c in "abc") >= 2
    assert sorted(got) == sorted(H.partition_sites(people, "k", "label", 0.3, 0.1, 5, minimum=2).collect())  # rows have no order
    for bad, message in (({"minimum": 4}, "capacity"), ({"minimum": -1}, "negative")):
        with pytest.raises(ValueError, match=message):
            H.partition_sites(people, "k", "label", 0.3, 0.1, 5, **bad)
    with pytest.raises(ValueError, match="at least 4"):
        H.partition_sites(people.limit(3), "k", "label", 0.3, 0.1, 5)


def test_score_evaluation_takes_covariates(spark):
    rng = np.random.default_rng(6)
    c1, c2, score = rng.integers(0, 4, 300).astype(float), rng.normal(size=300), rng.normal(size=300)
    y = 1 + 0.5 * c1 - c2 + 0.7 * score + rng.normal(size=300)
    case = rng.random(300) < 1 / (1 + np.exp(-(0.4 * c1 + c2 + score - 1)))
    rows = list(zip([1] * 300, c1.tolist(), c2.tolist(), score.tolist(), y.tolist(), case.tolist(), strict=True)) + [(1, None, 0.0, 1.0, 1.0, True), (2, 1.0, 1.0, 1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "site int, c1 double, c2 double, score double, y double, ill boolean")
    x = np.column_stack([np.ones(300), c1, c2, score])
    rss = np.linalg.lstsq(x, y, rcond=None)[1][0]
    got = {r["site"]: (r["n"], r["r2"]) for r in A.r_squared_given(df, "score", ("c1", "c2"), "y", ["site"]).collect()}
    assert got[1] == (300, pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum(), abs=1e-9)) and got[2] == (1, None)
    b = np.zeros(4)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x, x.T @ (case - mu))
    p = x @ b
    want = (p[case][:, None] > p[~case][None, :]).mean()
    area = {r["site"]: r["auroc"] for r in A.auroc_given(df.filter("site = 1"), "score", ("c1", "c2"), "ill", "site").collect()}
    assert area == {1: pytest.approx(want, abs=1e-9)}


@pytest.mark.parametrize("fan", [2, 3, 50])
def test_fingerprint_is_a_tree_of_bounded_blocks(spark, fan):
    def tree(lines):
        digests, leaf = lines, True
        while leaf or len(digests) > 1:
            blocks = [digests[i : i + fan] for i in range(0, len(digests), fan)]
            digests = [b[0] if len(b) == 1 and not leaf else hashlib.sha256("\n".join(b).encode()).hexdigest() for b in blocks]
            leaf = False
        return digests[0]

    sizes = {"a": 1, "b": 2, "c": 7, "d": 19, None: 5}
    rows = [(k, i // 2, f"{k}{i}") for k, n in sizes.items() for i in range(n)] + [("e", 1, "x"), ("e", 1, "x"), ("e", 0, "z")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, l string").repartition(3)
    got = {r["k"]: r["fingerprint"] for r in P.fingerprint(df, ["k"], "o", F.col("l"), fan).collect()}
    assert got == {k: tree([x[2] for x in sorted(r for r in rows if r[0] == k)]) for k in [*sizes, "e"]}
    assert P.fingerprint(df.limit(0), ["k"], "o", F.col("l"), fan).count() == 0


def test_blocking_sites_are_rows(spark):
    d = spark.createDataFrame([("a", 1, "denied"), ("b", 1, "undetermined"), ("c", 1, "permitted"), ("a", 2, "permitted"), ("b", 3, "denied")], "dataset_id string, request_id int, decision string")
    assert sorted((r["request_id"], r["dataset_id"], r["n_blocking"]) for r in P.blocking(d).collect()) == [(1, "a", 2), (1, "b", 2), (3, "b", 1)]


def test_hits_or_the_smallest_p(spark):
    rows = [("x", i, p) for i, p in enumerate([0.5, 0.001, 0.002, None])] + [("y", i, p) for i, p in enumerate([0.5, 0.1, None, 0.1])] + [("z", 0, None)]
    got = A.hits_table(spark.createDataFrame(rows, "t string, v int, p double"), 0.01, 2, ["t"], ["v"]).collect()
    assert sorted((r["t"], r["v"], r["rank"], r["hit_set"]) for r in got) == [("x", 1, 1, "significant"), ("x", 2, 2, "significant"), ("y", 1, 1, "top"), ("y", 3, 2, "top"), ("z", 0, 1, "top")]


def test_no_value_has_no_log_and_no_odds(spark):
    df = spark.createDataFrame([(None,), (0.0,), (100.0,)], "x double")
    rows = df.select(S.neglog10(F.col("x")).alias("l"), S.odds_ratio(F.col("x")).alias("o")).collect()
    assert rows[0]["l"] is None and rows[0]["o"] is None
    assert rows[1]["l"] > 307 and rows[1]["o"] == 1.0 and math.isclose(rows[2]["o"], math.exp(50))


def test_joint_fit_of_several_instances_of_a_locus(spark):
    rng = np.random.default_rng(4)
    ld = np.corrcoef(rng.normal(size=(200, 6)).T)
    pairs = [(loc, p, i, j, float(ld[i, j])) for loc in (1, 2) for p in ("A", "B") for i in range(6) for j in range(i, 6)]
    b = {(loc, rep, p): rng.normal(size=6) * 0.1 for loc in (1, 2) for rep in (0, 1) for p in ("A", "B")}
    ss = [(loc, rep, p, j, float(v[j]), 500) for (loc, rep, p), v in b.items() for j in range(6)]
    df = I.fit_multi_effect(spark.createDataFrame(ss, "locus int, rep int, pop string, j int, beta_hat double, n int"), spark.createDataFrame(pairs, "locus int, pop string, i int, j int, r double"), ["locus", "rep"], ["locus"], effects=3)
    got = {(r["locus"], r["rep"], r["component"], r["variant"]): r["alpha"] for r in df.collect()}
    for loc in (1, 2):
        for rep in (0, 1):
            own = [b[loc, rep, p] for p in ("A", "B")]
            alpha, *_ = I.ibss(own, [ld, ld], [500.0, 500.0], [float((v * v).max()) for v in own], 3)
            assert np.allclose([[got[loc, rep, k, j] for j in range(6)] for k in range(3)], alpha, atol=1e-9)
