import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from polyloci.operators import finemap as I
from polyloci.operators import moments as M
from polyloci.operators import tiles as L


def genotypes(seed=0, people=60, m=11, sites=3):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, (people, m))
    g[:, 4] = 1  # no variance
    g[:, 6] = g[:, 5]
    return g, np.arange(people) % sites


def frame(spark, g, site, names=None):
    names = names or [10 * k for k in range(g.shape[1])]
    rows = [(int(site[i]), 1, f"p{i}", names[k], float(g[i, k])) for i in range(len(g)) for k in range(g.shape[1])]
    return spark.createDataFrame(rows, "site int, locus int, sample string, j int, dosage double").repartition(4)


def axis(df):
    return L.variant_axis(df.select("site", "locus", "j").distinct(), ["locus"])


@pytest.mark.parametrize("width", [3, 4, 128])
def test_tiles_are_the_pooled_matrices(spark, width):
    g, site = genotypes()
    df = frame(spark, g, site)
    t = L.geno_tiles(df, ["site", "locus"], axis(df), ["locus"], width=width)
    pooled = L.add_tiles(t, ["locus"])
    names = [10 * k for k in range(g.shape[1])]
    cells = lambda tiles, by: {tuple(r)[len(by) :][:2]: r["x"] for r in L.tile_pairs(tiles, by, "x").collect()}
    with np.errstate(invalid="ignore"):
        r = np.nan_to_num(np.corrcoef(g.T))
    np.fill_diagonal(r, 1.0)
    c = g - g.mean(0)
    got = [cells(f(pooled, ["locus"]), ["locus"]) for f in (L.product_tiles, L.ld_tiles, L.r2_tiles, L.centered_tiles)]
    assert all(len(x) == len(names) * (len(names) + 1) // 2 for x in got)
    for i, a in enumerate(names):
        for j, b in enumerate(names[i:], i):
            want = (g[:, i] @ g[:, j], r[i, j], r[i, j] ** 2, c[:, i] @ c[:, j])
            assert np.allclose([x[a, b] for x in got], want, atol=1e-9), (a, b)


def test_tiles_equal_rows_of_pairs(spark):
    g, site = genotypes(1)
    df = frame(spark, g, site)
    by = ["site", "locus"]
    t = L.add_tiles(L.geno_tiles(df, by, axis(df), ["locus"], width=4), by)
    gm, um = M.geno_moments(df, by)
    rows = {tuple(r)[:4]: r["r"] for r in M.pooled_ld(gm, um, by).collect()}
    tiles = {tuple(r)[:4]: r["r"] for r in L.tile_pairs(L.ld_tiles(t, by), by, "r").collect()}
    assert rows.keys() == tiles.keys() and all(abs(rows[k] - tiles[k]) < 1e-9 for k in rows)
    r2 = L.tile_pairs(L.r2_tiles(t, by), by, "r2").cache()
    one, two = M.ld_divergence(r2, ["locus"]).first(), L.tile_divergence(L.r2_tiles(t, by), ["locus"]).first()
    assert abs(one["divergence"] - two["divergence"]) < 1e-9 and one["n_pairs"] == two["n_pairs"] == 3
    back = {tuple(r)[:4]: r["r"] for r in L.tile_pairs(L.tiles_of_pairs(M.pooled_ld(gm, um, by), by, "r", width=3), by, "r").collect()}
    assert back.keys() == rows.keys() and all(abs(rows[k] - back[k]) < 1e-12 for k in rows)


def test_only_variants_of_all_sites_are_pooled(spark):
    g, site = genotypes(2)
    df = frame(spark, g, site).filter("NOT (site = 1 AND j IN (0, 50))")
    a = axis(df)
    assert [(r["j"], r["pos"]) for r in a.orderBy("j").collect()] == [(10 * k, i) for i, k in enumerate(x for x in range(11) if x not in (0, 5))]
    pooled = L.add_tiles(L.geno_tiles(df, ["site", "locus"], a, ["locus"], width=4), ["locus"])
    got = {(r["i"], r["j"]): r["g"] for r in L.tile_pairs(L.product_tiles(pooled, ["locus"]), ["locus"], "g", "long").collect()}
    assert len(got) == 45 and got[10, 20] == g[:, 1] @ g[:, 2]


def test_sites_must_code_variants_alike(spark):
    v = spark.createDataFrame([("a", 1, 1, "A", "G"), ("b", 1, 1, "G", "A"), ("a", 1, 2, "C", "T"), ("b", 1, 2, "C", "T")], "site string, locus int, j int, a1 string, a2 string")
    with pytest.raises(PySparkException, match="coding of variant 1"):
        L.variant_axis(v, ["locus"], codes=("a1", "a2")).collect()
    assert L.variant_axis(v.filter("j = 2"), ["locus"], codes=("a1", "a2")).count() == 1


@pytest.mark.parametrize("bad", [0.5, None])
def test_dosages_must_be_whole(spark, bad):
    g, site = genotypes(3)
    df = frame(spark, g, site)
    df = df.withColumn("dosage", F.when((F.col("sample") == "p7") & (F.col("j") == 30), F.lit(bad).cast("double")).otherwise(F.col("dosage")))
    with pytest.raises(PySparkException, match="whole numbers"):
        L.geno_tiles(df, ["site", "locus"], axis(df), ["locus"]).collect()
    if bad:
        gm, um = M.geno_moments(df, ["site", "locus"])
        with pytest.raises(PySparkException, match="not whole"):
            gm.collect()
        with pytest.raises(PySparkException, match="not whole"):
            um.collect()


def test_people_must_have_all_variants(spark):
    g, site = genotypes(4)
    df = frame(spark, g, site).filter("NOT (sample = 'p3' AND j = 20)")
    with pytest.raises(PySparkException, match="lack a variant"):
        L.geno_tiles(df, ["site", "locus"], axis(df), ["locus"]).collect()


@pytest.mark.parametrize("task_fits", [1, 2, 50])
def test_joint_fits_of_many_instances_equal_fits_alone(spark, task_fits):
    rng = np.random.default_rng(5)
    g, site = genotypes(5, people=90)
    g[:, 4] = rng.integers(0, 3, 90)
    df = frame(spark, g, site)
    tiles = L.ld_tiles(L.add_tiles(L.geno_tiles(df, ["site", "locus"], axis(df), ["locus"], width=4), ["locus"]), ["locus"]).withColumn("pop", F.lit("x"))
    r = np.corrcoef(g.T)
    ss, want = [], {}
    for rep in range(7):
        beta = r @ rng.normal(0, 0.2, 11) / 5
        ss += [(1, rep, "x", 10 * k, float(beta[k]), 90.0) for k in range(11)]
        alpha, sigma2, rounds, ok = I.ibss([beta], [r], [90.0], [max(float((beta * beta).max()), 1e-12)], 3)
        want[rep] = alpha, sigma2, rounds, "converged" if ok else "nonconverged"
    stats = spark.createDataFrame(ss, "locus int, rep int, pop string, j int, beta_hat double, n double")
    got = I.fit_multi_effect(stats, tiles, ["locus", "rep"], ["locus"], effects=3, task_fits=task_fits).collect()
    assert len(got) == 7 * 3 * 11
    for x in got:
        alpha, sigma2, rounds, status = want[x["rep"]]
        assert np.isclose(x["alpha"], alpha[x["component"], x["variant"] // 10], atol=1e-8) and np.isclose(x["sigma2"], sigma2) and (x["iterations"], x["status"]) == (rounds, status)
    assert I.fit_multi_effect(stats.withColumn("locus", F.lit(2)), tiles, ["locus", "rep"], ["locus"]).count() == 0
