"""Queries of the variant, window, locus and moment families (C, D2-D7, D13-D16, E10-E25, E30, E32, E33, H4-H9, H16, H20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import moments as M
from ..operators import tiles as L
from ..operators import variants as V
from .bindings import GENO, LCG, POSITIONS, WINDOWS, geno, positions, query, r, table, windows


@query(f"WITH {POSITIONS} SELECT variant, bp FROM positions WHERE chrom = 3 AND bp BETWEEN 500000 AND 900000")
def c1_in_window(spark, sf):
    return V.in_window(positions(spark, sf), 3, 500_000, 900_000).select("variant", "bp")


_U = f"{GENO}, u AS (SELECT site, pop, locus, j, sum(dosage)::BIGINT AS u, count(*) AS n FROM geno GROUP BY site, pop, locus, j)"


def _gu(spark, sf):
    """Genotypes by site, ancestry and locus, and their moments."""
    g = geno(spark, sf)
    return g, *M.geno_moments(g, ["site", "pop", "locus"])


@query(f"WITH {_U} SELECT j, sum(u)::BIGINT AS u, sum(n)::BIGINT AS n FROM u GROUP BY j HAVING least(sum(u), 2 * sum(n) - sum(u)) >= 2 * sum(n) * 0.47 - 1e-10")
def c2_filter_maf(spark, sf):
    u = geno(spark, sf).groupBy("j").agg(F.sum("dosage").alias("u"), F.count("*").alias("n"))
    return V.filter_maf(u, 0.47)


@query(f"WITH {_U} SELECT j, round(max(least(u / (2.0 * n), 1 - u / (2.0 * n)))::DOUBLE, 9) AS max_maf FROM u GROUP BY j HAVING max(least(u / (2.0 * n), 1 - u / (2.0 * n))) > 0.49")
def c3_filter_maf_any_site(spark, sf):
    u = geno(spark, sf).groupBy("site", "pop", "j").agg((F.sum("dosage") / (2.0 * F.count("*"))).alias("af"))
    return V.filter_maf_any_site(u.withColumn("maf", F.least("af", 1 - F.col("af"))), 0.49, ["j"]).select("j", r("max_maf", 9).alias("max_maf"))


@query(f"WITH {GENO}, s AS (SELECT label, j, max(missing) AS m FROM geno GROUP BY label, j) SELECT label, count_if(m) AS n_incomplete FROM s GROUP BY label")
def c4_drop_incomplete(spark, sf):
    g = geno(spark, sf).withColumn("dosage", F.when(~F.col("missing"), F.col("dosage")))
    return V.drop_incomplete(g, ["label"], "j")[1]


@query(f"""WITH {POSITIONS}, k AS (SELECT chrom, variant, row_number() OVER (PARTITION BY chrom ORDER BY {LCG.format('variant', 7)}, variant) AS r, count(*) OVER (PARTITION BY chrom) AS n FROM (SELECT DISTINCT chrom, variant FROM positions))
  SELECT chrom, variant FROM k WHERE r <= greatest(1, round(n * 0.1))""")
def c5_sample_variants(spark, sf):
    return V.sample_variants(positions(spark, sf), 0.1, 7, by=["chrom"])


@query(f"WITH {_U}, m AS (SELECT site, pop, j, least(u / (2.0 * n), 1 - u / (2.0 * n)) AS maf FROM u) SELECT j FROM m GROUP BY j HAVING max(maf) > 0.495 AND min(maf) < 0.45")
def c10_ancestry_specific(spark, sf):
    u = geno(spark, sf).groupBy("site", "pop", "j").agg((F.sum("dosage") / (2.0 * F.count("*"))).alias("af"))
    return V.ancestry_specific(u.withColumn("maf", F.least("af", 1 - F.col("af"))), 0.495, 0.45, ["j"])


def _bim(spark, sf):
    """A site's variant table: a part is a variant; some have their alleles swapped, other alleles or another position."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("snp_id"), (k % 5).cast("string").alias("chrom"), F.when(k % 17 == 0, k * 1000 + 1).otherwise(k * 1000).alias("bp"),
        F.when(k % 3 == 0, "g").otherwise("A").alias("a1"), F.when(k % 3 == 0, "a").when(k % 7 == 0, "T").otherwise("G").alias("a2"),
    )


def _ref(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").filter(k % 11 > 0).select(k.alias("snp_id"), (k * 1000).alias("bp"), F.lit("A").alias("a1"), F.lit("G").alias("a2"))


_STATUS = "CASE WHEN p_partkey % 11 = 0 THEN 'absent' WHEN p_partkey % 17 = 0 THEN 'incompatible' WHEN p_partkey % 3 = 0 THEN 'swap' WHEN p_partkey % 7 = 0 THEN 'incompatible' ELSE 'ok' END"


@query(f"SELECT p_partkey AS snp_id, {_STATUS} AS status, {_STATUS} = 'swap' AS flip FROM part")
def d2_harmonize_variants(spark, sf):
    return V.harmonize_variants(_bim(spark, sf), _ref(spark, sf)).select("snp_id", "status", "flip")


@query(f"SELECT p_partkey AS snp_id, CASE WHEN {_STATUS} = 'swap' THEN -p_retailprice ELSE p_retailprice END AS beta, CASE WHEN {_STATUS} = 'swap' THEN -p_size ELSE p_size END::DOUBLE AS stat FROM part WHERE {_STATUS} IN ('ok', 'swap')")
def d3_harmonize_sumstats(spark, sf):
    ss = _bim(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("snp_id"), F.col("p_retailprice").alias("beta"), F.col("p_size").cast("double").alias("stat")), "snp_id")
    return V.harmonize_sumstats(ss, _ref(spark, sf)).select("snp_id", "beta", "stat")


@query("""SELECT 's1' AS site, count_if(p_partkey % 23 = 0) AS n_missing, 0::BIGINT AS n_extra, 0::BIGINT AS n_other_variant, count_if(p_partkey % 23 > 0 AND p_partkey % 19 = 0) AS n_swapped, 0::BIGINT AS n_other_alleles FROM part""")
def d4_check_variant_axis(spark, sf):
    k = F.col("p_partkey")
    base = table(spark, sf, "part").select(F.lit("s0").alias("site"), k.alias("vidx"), k.alias("snp_id"), F.lit("A").alias("a1"), F.lit("G").alias("a2"))
    other = table(spark, sf, "part").filter(k % 23 > 0).select(F.lit("s1").alias("site"), k.alias("vidx"), k.alias("snp_id"), F.when(k % 19 == 0, "G").otherwise("A").alias("a1"), F.when(k % 19 == 0, "A").otherwise("G").alias("a2"))
    return V.check_variant_axis(base.unionByName(other))


@query("""WITH s AS (SELECT l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'G' ELSE 'A' END AS ea, sum(l_discount) AS w FROM lineitem GROUP BY 1, 2)
  SELECT l_partkey AS snp_id, ea, round(w, 6) AS weight, ea = 'G' AS flip FROM s""")
def d5_prepare_scores(spark, sf):
    li = table(spark, sf, "lineitem")
    scores = li.select((F.col("l_partkey") % 5 + 1).cast("string").alias("hm_chr"), (F.col("l_partkey") * 1000).alias("hm_pos"), F.when(F.col("l_linenumber") % 2 == 0, "g").otherwise("a").alias("effect_allele"), F.col("l_discount").alias("effect_weight"))
    k = F.col("p_partkey")
    bim = table(spark, sf, "part").select(k.alias("snp_id"), (k % 5 + 1).cast("string").alias("chrom"), (k * 1000).alias("bp"), F.lit("A").alias("a1"), F.lit("G").alias("a2"))
    return V.prepare_scores(scores, bim).select("snp_id", "ea", r("weight").alias("weight"), "flip")


@query("""WITH p AS (SELECT DISTINCT l_partkey AS variant, n_regionkey AS site FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
  SELECT variant FROM p GROUP BY variant HAVING count(*) = (SELECT count(DISTINCT site) FROM p)""")
def d6_common_variants(spark, sf):
    li, s, n = (table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    x = li.join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("l_partkey").alias("variant"), F.col("n_regionkey").alias("site"))
    return V.common_variants(x, ["variant"])


@query(f'WITH {POSITIONS}, {WINDOWS} SELECT variant, "window" FROM positions p JOIN windows w ON p.chrom = w.chrom AND p.bp BETWEEN w.start_bp AND w.end_bp')
def d7_assign_windows(spark, sf):
    return V.assign_windows(positions(spark, sf), windows(spark, sf), 2000, keep=["variant", "window"])


@query("""WITH o AS (SELECT l_partkey AS v FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 2), t AS (SELECT o_orderkey, unnest([o_custkey % 200 + 1, o_orderkey % 200 + 1]) AS v FROM orders)
  SELECT o_orderkey, bool_or(v IN (SELECT v FROM o)) AS inconsistent FROM t GROUP BY o_orderkey""")
def d13_flip_flags(spark, sf):
    bims = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("snp_id"), F.col("l_returnflag").alias("a1")).agg(F.count("*"))
    two = bims.groupBy("snp_id").agg(F.count("*").alias("k"), F.first("a1").alias("a1")).filter("k > 2").select("snp_id", "a1")
    truth = table(spark, sf, "orders").select("o_orderkey", F.concat_ws(",", F.col("o_custkey") % 200 + 1, F.col("o_orderkey") % 200 + 1).alias("causal_snp_ids"))
    return V.flip_flags(two.unionByName(two.withColumn("a1", F.lit("-"))), truth, ["o_orderkey"])


@query("""SELECT l_partkey AS snp_id, bool_or(l_returnflag = 'A') AS eligible_A, bool_or(l_returnflag = 'N') AS eligible_N, bool_or(l_returnflag = 'R') AS eligible_R, count(DISTINCT l_linenumber) > 5 AS many, count(DISTINCT l_linestatus) > 1 AS conflict FROM lineitem GROUP BY l_partkey""")
def d14_union_variants(spark, sf):
    li = table(spark, sf, "lineitem")
    x = li.select(F.col("l_partkey").alias("snp_id"), F.col("l_returnflag").alias("pop"), F.lit(1).alias("bp"), F.col("l_linestatus").alias("a1"), F.lit("G").alias("a2"))
    many = li.groupBy(F.col("l_partkey").alias("snp_id")).agg((F.count_distinct("l_linenumber") > 5).alias("many"))
    return V.union_variants(x, ["A", "N", "R"], ["snp_id"]).join(many, "snp_id")


@query("""WITH s AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS j, l_partkey, l_linenumber FROM lineitem), l AS (SELECT * FROM s WHERE l_linenumber < 7),
  f AS (SELECT s.l_suppkey, count_if(l.j IS NULL) AS n_unmatched, count_if(l.j IS NOT NULL AND (s.l_partkey <> l.l_partkey OR l.l_partkey % 10 = 0)) AS n_different FROM s LEFT JOIN l ON s.l_suppkey = l.l_suppkey AND s.j = l.j GROUP BY 1),
  d AS (SELECT l_suppkey, count(*) - count(DISTINCT l_partkey) AS n_duplicate FROM s GROUP BY 1) SELECT f.*, n_duplicate FROM f JOIN d ON f.l_suppkey = d.l_suppkey""")
def d15_check_inputs(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("j"), F.col("l_partkey").alias("snp_id"), F.lit("A").alias("a1"), F.lit("G").alias("a2"), "l_linenumber")
    ld = li.filter("l_linenumber < 7").withColumn("a1", F.when(F.col("snp_id") % 10 == 0, "T").otherwise("A"))
    return V.check_inputs(li, ld, ["l_suppkey"])


@query(f"""WITH {_U}, s AS (SELECT * FROM u WHERE site = 0), l AS (SELECT * FROM u WHERE site = 1) SELECT s.pop, s.locus, s.j, s.u AS u, l.u AS lent FROM s JOIN l ON s.pop = l.pop AND s.locus = l.locus AND s.j = l.j""")
def d16_borrow_ld(spark, sf):
    u = geno(spark, sf).groupBy("site", "pop", "locus", "j").agg(F.sum("dosage").alias("u"))
    return V.borrow_ld(u, u.withColumnRenamed("u", "lent"), 1, 0, ["pop", "locus", "j"])


_G = f"{GENO}, g AS (SELECT a.site, a.pop, a.locus, a.j AS i, b.j AS j, sum(a.dosage * b.dosage)::BIGINT AS g, sum(a.dosage)::DOUBLE AS ui, sum(b.dosage)::DOUBLE AS uj, count(*) AS n FROM geno a JOIN geno b ON a.sample = b.sample AND a.locus = b.locus AND a.j <= b.j GROUP BY ALL)"


@query(f"WITH {_G} SELECT site, pop, locus, i, j, g FROM g")
def e10_geno_moments(spark, sf):
    return _gu(spark, sf)[1]


@query(f"WITH {_G} SELECT site, pop, locus, i, j, g FROM g")
def e10_geno_moments_blocked(spark, sf):
    return M.geno_moments(geno(spark, sf), ["site", "pop", "locus"], rows=64)[0]


@query(f"WITH {GENO} SELECT site, pop, j, round(sum(dosage * y), 6) AS c FROM geno GROUP BY site, pop, j")
def e11_pheno_moments(spark, sf):
    g = geno(spark, sf)
    p = g.select("sample", "y").distinct()
    return M.pheno_moments(g.drop("y"), p, ["site", "pop"])[0].select("site", "pop", "j", r("c").alias("c"))


@query(f"WITH {GENO}, p AS (SELECT DISTINCT sample, site, pop, y FROM geno) SELECT site, pop, round(sum(y), 6) AS q, round(sum(y * y), 6) AS w, count(*) AS n FROM p GROUP BY site, pop")
def e11_pheno_scalars(spark, sf):
    g = geno(spark, sf)
    p = g.select("sample", "y").distinct()
    return M.pheno_moments(g.drop("y"), p, ["site", "pop"])[1].select("site", "pop", r("q").alias("q"), r("w").alias("w"), "n")


@query(f"WITH {_G} SELECT site, pop, locus, i, j, g FROM g")
def e10_geno_tiles(spark, sf):
    by = ["site", "pop", "locus"]
    return L.tile_pairs(L.product_tiles(tiles(spark, sf, by), by), by, "g", "long")


@query(f"WITH {_G} SELECT pop, locus, i, j, sum(g)::BIGINT AS g FROM g GROUP BY pop, locus, i, j")
def e12_pool_tiles(spark, sf):
    by = ["pop", "locus"]
    return L.tile_pairs(L.product_tiles(tiles(spark, sf, by), by), by, "g", "long")


@query(f"WITH {_G} SELECT pop, locus, i, j, sum(g)::BIGINT AS g FROM g GROUP BY pop, locus, i, j")
def e12_e13_pool(spark, sf):
    return M.pool(_gu(spark, sf)[1], ["pop", "locus", "i", "j"], ["g"])


@query("""SELECT n_regionkey AS pop, count(*) AS n, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS sites FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) >= 10""")
def e14_c8_plan_columns(spark, sf):
    x = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return M.plan_columns(x.select(F.col("n_regionkey").alias("pop"), F.col("c_mktsegment").alias("site")), 10)


_LD = f"""{GENO}, c AS (SELECT a.pop, a.locus, a.j AS i, b.j AS j, corr(a.dosage, b.dosage) AS r FROM geno a JOIN geno b ON a.sample = b.sample AND a.locus = b.locus AND a.j <= b.j GROUP BY ALL)"""


def tiles(spark, sf, by=("pop", "locus"), width=16):
    """Moments of the loci as tiles, pooled to `by`, over the variants that all sites have; small tiles, so that a locus has some."""
    g = geno(spark, sf)
    coded = g.select("site", "locus", "j", "bp").distinct()
    axis = L.variant_axis(coded, ["locus"], codes=("bp",))
    return L.add_tiles(L.geno_tiles(g, ["site", "pop", "locus"], axis, ["locus"], width=width), list(by))


def _ld(spark, sf, by=("pop", "locus")):
    return L.tile_pairs(L.ld_tiles(tiles(spark, sf, by), list(by)), list(by), "r")


@query(f"WITH {_LD} SELECT pop, locus, i, j, round(r, 6) + 0.0::DOUBLE AS r FROM c")
def e15_pooled_ld(spark, sf):
    return _ld(spark, sf).select("pop", "locus", "i", "j", r("r").alias("r"))


_SS = f"""{GENO}, s AS (SELECT pop, j, count(*) AS n, regr_slope(y, dosage) AS beta, regr_sxx(y, dosage) AS sxx, regr_sxy(y, dosage) AS sxy, regr_syy(y, dosage) AS syy FROM geno GROUP BY pop, j),
ss AS (SELECT pop, j, n, beta, sqrt((syy - beta * sxy) / (n - 2) / sxx) AS se, sxy / sqrt(sxx * syy) AS beta_hat FROM s)"""


def _sumstats(spark, sf):
    g = geno(spark, sf)
    p = g.select("sample", "y").distinct()
    c, one = M.pheno_moments(g.drop("y"), p, ["site", "pop"])
    u = g.groupBy("pop", "j").agg(F.sum("dosage").alias("u"), F.sum(F.col("dosage") * F.col("dosage")).alias("g"))
    return M.pooled_sumstats(u, u, M.pool(c, ["pop", "j"], ["c"]), M.pool(one, ["pop"], ["q", "w", "n"]), ["pop"])


@query(f"WITH {_SS} SELECT pop, j, n, round(beta, 6) AS beta, round(se, 6) AS se, round(beta / se, 5) AS stat, n - 2 AS dof, round(beta_hat, 6) AS beta_hat FROM ss")
def e16_pooled_sumstats(spark, sf):
    return _sumstats(spark, sf).select("pop", "j", "n", r("beta").alias("beta"), r("se").alias("se"), r("stat", 5).alias("stat"), "dof", r("beta_hat").alias("beta_hat"))


@query(f"WITH {_SS} SELECT pop, round(max(beta_hat * beta_hat), 6) AS tau_sq FROM ss GROUP BY pop")
def e17_tau_sq(spark, sf):
    return M.tau_sq(_sumstats(spark, sf), ["pop"]).select("pop", r("tau_sq").alias("tau_sq"))


@query(f"WITH {_G} SELECT site, pop, locus, i, j, round(g - ui * uj / n, 6) AS sxx FROM g")
def e18_centered_moments(spark, sf):
    by = ["site", "pop", "locus"]
    return L.tile_pairs(L.centered_tiles(tiles(spark, sf, by), by), by, "sxx").select(*by, "i", "j", r("sxx").alias("sxx"))


_R2 = f"""{GENO}, r2 AS (SELECT a.site, a.locus, a.j AS i, b.j AS j, corr(a.dosage, b.dosage) * corr(a.dosage, b.dosage) AS r2 FROM geno a JOIN geno b ON a.sample = b.sample AND a.locus = b.locus AND a.j <= b.j GROUP BY ALL)"""


def _r2(spark, sf):
    by = ["site", "locus"]
    return L.tile_pairs(L.r2_tiles(tiles(spark, sf, by), by), by, "r2")


@query(f"WITH {_R2} SELECT site, locus, i, j, round(r2, 6) AS r2 FROM r2")
def e19_r2_pairs(spark, sf):
    return _r2(spark, sf).select("site", "locus", "i", "j", r("r2").alias("r2"))


@query(f"""WITH {_R2}, d AS (SELECT a.locus, a.site AS sa, b.site AS sb, sqrt(sum(CASE WHEN a.i = a.j THEN 1 ELSE 2 END * (a.r2 - b.r2) * (a.r2 - b.r2))) AS d FROM r2 a JOIN r2 b ON a.locus = b.locus AND a.i = b.i AND a.j = b.j AND a.site < b.site GROUP BY ALL)
  SELECT locus, round(avg(d), 6) AS divergence, count(*) AS n_pairs FROM d GROUP BY locus""")
def e20_ld_divergence(spark, sf):
    by = ["site", "locus"]
    return L.tile_divergence(cut(L.r2_tiles(tiles(spark, sf, by), by)), ["locus"]).select("locus", r("divergence").alias("divergence"), "n_pairs")


@query(f"WITH {_R2}, m AS (SELECT locus, site, avg(r2) AS m FROM r2 WHERE i <> j GROUP BY locus, site) SELECT locus, round(avg(m), 8) AS mean_r2 FROM m GROUP BY locus")
def e21_ld_strength(spark, sf):
    return M.ld_strength(_r2(spark, sf), ["locus"]).select("locus", r("mean_r2", 8).alias("mean_r2"))


@query(f"WITH {_U}, m AS (SELECT pop, j, sum(n) AS n, least(sum(u) / (2.0::DOUBLE * sum(n)), 1 - sum(u) / (2.0::DOUBLE * sum(n))) AS maf FROM u GROUP BY pop, j) SELECT pop, count(*) AS n_variants, round(quantile_cont(maf, 0.5), 8) AS median_maf, round(avg(CASE WHEN maf > 0.05 THEN 1.0 ELSE 0.0 END), 8) AS share_common FROM m WHERE n >= 50 GROUP BY pop")
def e22_qc_maf(spark, sf):
    u = geno(spark, sf).groupBy("pop", "j").agg(F.count("*").alias("n"), (F.sum("dosage") / (2.0 * F.count("*"))).alias("af")).withColumn("maf", F.least("af", 1 - F.col("af")))
    return M.qc_maf(u, ["pop"], 50).select("pop", "n_variants", r("median_maf", 8).alias("median_maf"), r("share_common", 8).alias("share_common"))


@query(f"""WITH {_R2}, b AS (SELECT site, least((j // 2 - i // 2) * 1000 * 20 // 25000, 19)::INT AS bin, r2 FROM r2 WHERE j > i), m AS (SELECT site, bin, avg(r2) AS m, count(*) AS n FROM b GROUP BY site, bin)
  SELECT g.site, g.bin, round(m, 8) AS mean_r2, coalesce(n, 0) AS n_pairs FROM (SELECT site, bin::INT AS bin FROM (SELECT DISTINCT site FROM r2), range(0, 20) t(bin)) g LEFT JOIN m ON g.site = m.site AND g.bin = m.bin""")
def e23_ld_decay(spark, sf):
    x = _r2(spark, sf).withColumn("bp_i", F.floor(F.col("i") / 2) * 1000).withColumn("bp_j", F.floor(F.col("j") / 2) * 1000)  # two variants a position
    return M.ld_decay(x, 25_000, 20, ["site"]).select("site", "bin", r("mean_r2", 8).alias("mean_r2"), "n_pairs")


_TER = f"""{WINDOWS}, t AS (SELECT *, row_number() OVER (ORDER BY score, "window") AS rk, count(*) OVER () // 3 AS th, count(*) OVER () AS nn FROM windows),
str AS (SELECT "window", chrom, start_bp, end_bp, score, CASE WHEN rk <= th THEN 'low' WHEN rk > nn - th THEN 'high' ELSE 'medium' END AS stratum FROM t)"""


def _strata(spark, sf):
    return V.stratify(windows(spark, sf), "score", ["window"])


@query(f"WITH {_TER} SELECT stratum, min(score) AS least, round(quantile_cont(score, 0.5), 6) AS median, max(score) AS largest FROM str GROUP BY stratum")
def e24_qc_divergence(spark, sf):
    return M.qc_divergence(_strata(spark, sf).withColumnRenamed("score", "divergence")).select("stratum", "least", r("median").alias("median"), "largest")


@query(f'WITH {_TER}, k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {LCG.format(chr(34) + "window" + chr(34), 3)}, "window") AS q FROM str) SELECT stratum, "window" FROM k WHERE q <= 10')
def h5_stratify_and_sample(spark, sf):
    return V.sample_strata(_strata(spark, sf), 10, "window", 3).select("stratum", "window")


@query(f'WITH {_TER}, k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY score, "window") AS q, count(*) OVER (PARTITION BY stratum) AS m FROM str) SELECT stratum, "window" FROM k WHERE q = m // 2 + 1')
def h16_median_panel(spark, sf):
    from ..operators.cohort import median_panel

    return median_panel(_strata(spark, sf), "score", "window").select("stratum", "window")


@query(f"""WITH {POSITIONS}, e AS (SELECT chrom, min(bp) AS lo, max(bp) AS hi FROM positions GROUP BY chrom) SELECT chrom, s AS start_bp, least(s + 50000, hi) AS end_bp FROM (SELECT chrom, hi, unnest(generate_series(lo, hi, 25000)) AS s FROM e)""")
def h4_candidate_windows(spark, sf):
    return V.candidate_windows(positions(spark, sf), 50_000, 25_000)


def _one_by_one(name: str, rows: str, by: str) -> str:
    """A greedy choice as a recursion: in each group of `by` the windows of `rows` in the order of q, a window kept unless it
    overlaps one kept before; `name` has the last state of each group."""
    add = """CASE WHEN len(list_filter(kept, lambda k: k.s <= o.end_bp AND o.start_bp <= k.e)) > 0 THEN kept ELSE list_append(kept, {'w': o."window", 's': o.start_bp, 'e': o.end_bp}) END"""
    same = " AND ".join(f"g.{c.strip()} = o.{c.strip()}" for c in by.split(","))
    own = ", ".join(f"g.{c.strip()}" for c in by.split(","))
    return f"""{name}_all AS (SELECT {by}, 0::BIGINT AS q, []::STRUCT(w BIGINT, s BIGINT, e BIGINT)[] AS kept FROM (SELECT DISTINCT {by} FROM {rows})
  UNION ALL SELECT {own}, g.q + 1, {add} FROM {name}_all g JOIN {rows} o ON {same} AND o.q = g.q + 1),
{name} AS (SELECT unnest(arg_max(kept, q)).w AS w FROM {name}_all GROUP BY {by})"""


@query(f"""WITH RECURSIVE {_TER}, md AS (SELECT stratum, quantile_cont(score, 0.5) AS md FROM str GROUP BY stratum),
far AS (SELECT str.*, CASE str.stratum WHEN 'high' THEN -score WHEN 'low' THEN score ELSE abs(score - md) END AS far FROM str JOIN md ON str.stratum = md.stratum),
pr AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY far, "window") - 1) / count(*) OVER (PARTITION BY stratum) AS pr FROM far),
o1 AS (SELECT *, row_number() OVER (PARTITION BY stratum, chrom ORDER BY pr, "window") AS q FROM pr), {_one_by_one("k1", "o1", "stratum, chrom")},
o2 AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pr, stratum, "window") AS q FROM pr JOIN k1 ON w = "window"), {_one_by_one("k2", "o2", "chrom")}
SELECT stratum, "window", chrom, start_bp, end_bp FROM str JOIN k2 ON "window" = w""")
def h6_drop_overlaps(spark, sf):
    return V.drop_overlaps_by_extremeness(_strata(spark, sf), 10_000, "score", "window").select("stratum", "window", "chrom", "start_bp", "end_bp")


_REG = f"""{_TER}, p AS (SELECT *, max(end_bp) OVER (PARTITION BY chrom ORDER BY start_bp, end_bp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM str),
reg AS (SELECT *, sum(CASE WHEN e IS NULL OR start_bp > e THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_bp, end_bp)::BIGINT AS region FROM p)"""


@query(f'WITH {_REG} SELECT "window", chrom, region FROM reg')
def h7_region_ids(spark, sf):
    return V.region_ids(_strata(spark, sf)).select("window", "chrom", "region")


@query(f"""WITH {_REG}, c AS (SELECT chrom, region, stratum, count(*) AS n FROM reg GROUP BY ALL) SELECT chrom, region, stratum FROM (SELECT *, row_number() OVER (PARTITION BY chrom, region ORDER BY n DESC, stratum) AS q FROM c) WHERE q = 1""")
def h7_region_stratum(spark, sf):
    return V.region_stratum(V.region_ids(_strata(spark, sf)))


@query(f"""WITH {_TER}, s AS (SELECT "window", chrom, stratum, "window" * 700 AS start_bp, "window" * 700 + end_bp - start_bp AS end_bp FROM str),
  p AS (SELECT *, max(end_bp) OVER (PARTITION BY chrom ORDER BY start_bp, end_bp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s),
  reg AS (SELECT *, sum(CASE WHEN e IS NULL OR start_bp > e THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_bp, end_bp)::BIGINT AS region FROM p),
  c AS (SELECT chrom, region, stratum, count(*) AS n FROM reg GROUP BY ALL), f AS (SELECT chrom, region, stratum FROM (SELECT *, row_number() OVER (PARTITION BY chrom, region ORDER BY n DESC, stratum) AS q FROM c) WHERE q = 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {LCG.format("(chrom * 1000003 + region)", 9)}, chrom, region) AS q, count(*) OVER (PARTITION BY stratum) AS m FROM f)
  SELECT "window", reg.chrom, reg.region, CASE WHEN q <= greatest(1, m // 3) THEN 'development' ELSE 'evaluation' END AS split FROM reg JOIN k ON reg.chrom = k.chrom AND reg.region = k.region""")
def h7_split_regions(spark, sf):
    """Windows are moved apart, so that there are the more regions the more windows there are."""
    x = _strata(spark, sf).withColumn("end_bp", F.col("window") * 700 + F.col("end_bp") - F.col("start_bp")).withColumn("start_bp", F.col("window") * 700)
    return V.split_regions(x, 9).select("window", "chrom", "region", "split")


@query(f"""WITH RECURSIVE {_R2}, v AS (SELECT site, locus, j, row_number() OVER (PARTITION BY site, locus ORDER BY j) AS q FROM (SELECT DISTINCT site, locus, j FROM r2)),
near AS (SELECT site, locus, j, list(i) AS near FROM r2 WHERE i < j AND r2 >= 0.02 GROUP BY ALL), o AS (SELECT v.*, coalesce(near, []) AS near FROM v LEFT JOIN near n ON v.site = n.site AND v.locus = n.locus AND v.j = n.j),
g AS (SELECT site, locus, 0::BIGINT AS q, []::INT[] AS kept FROM (SELECT DISTINCT site, locus FROM v)
  UNION ALL SELECT g.site, g.locus, g.q + 1, CASE WHEN len(list_intersect(list_slice(kept, greatest(len(kept) - 4, 1), len(kept)), near)) > 0 THEN kept ELSE list_append(kept, j) END FROM g JOIN o ON g.site = o.site AND g.locus = o.locus AND o.q = g.q + 1),
k AS (SELECT site, locus, arg_max(kept, q) AS kept FROM g GROUP BY site, locus),
p AS (SELECT site, locus, kept, unnest(range(0, len(kept))) AS p, len(kept) AS n FROM k)
SELECT site, locus, kept[p + 1] AS j FROM p WHERE n <= 8 OR list_contains(list_transform(range(0, 8), lambda i: round_even(i * ((n - 1) / 7), 0)::BIGINT), p)""")
def h8_h9_pick_tags(spark, sf):
    x = _r2(spark, sf)
    v = x.select("site", "locus", "j").distinct()
    return V.pick_tags(v, x.filter("i < j").select("site", "locus", "i", "j", "r2"), ["site", "locus"], 8, 0.02, 5)


@query(f"WITH {_LD} SELECT pop, locus, round(max(CASE WHEN i = j THEN abs(r - 1) END), 6) AS diagonal, round(max(abs(r)), 6) AS largest, 0.0::DOUBLE AS share_above, 0::BIGINT AS n_null FROM c GROUP BY pop, locus")
def e30_ld_sanity(spark, sf):
    return M.ld_sanity(_ld(spark, sf), ["pop", "locus"]).select("pop", "locus", r("diagonal").alias("diagonal"), r("largest").alias("largest"), "share_above", "n_null")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n_variants, 8 * count(DISTINCT l_partkey) * count(DISTINCT l_partkey) AS moment_bytes, 24 * count(DISTINCT l_partkey) AS summary_bytes FROM lineitem GROUP BY l_suppkey")
def e32_uplink_cost(spark, sf):
    return M.uplink_cost(table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n_variants")), 8)


@query("""SELECT l_partkey::VARCHAR AS element, TRUE AS complete, round(sum(s), 2) AS value FROM (SELECT l_partkey, l_returnflag, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2) GROUP BY l_partkey HAVING count(*) = 3
  UNION ALL SELECT l_partkey::VARCHAR, FALSE, NULL FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) < 3""")
def e33_secure_sum(spark, sf):
    x = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("element"), F.col("l_returnflag").alias("site")).agg(F.sum("l_quantity").alias("value"))
    s = M.secure_sum(M.mask_moments(x, ["A", "N", "R"], "secret"), ["A", "N", "R"])
    return s.select("element", "complete", r("value", 2).alias("value"))


@query(f"""WITH {_SS}, l AS (SELECT j, (j - 1) // 20 AS locus, sum(abs(beta / se)) AS pip FROM ss GROUP BY j), m AS (SELECT *, j = arg_max(j, (round(pip, 6), -j)) OVER (PARTITION BY locus) AS is_lead FROM l)
  SELECT s.pop, m.locus, s.j AS variant, round(m.pip, 6) AS pip, s.j % 10 = 0 AS causal, m.is_lead AS lead FROM ss s JOIN m ON s.j = m.j""")
def h20_locus_track(spark, sf):
    ss = _sumstats(spark, sf).withColumn("variant", F.col("j")).withColumn("locus", F.floor((F.col("j") - 1) / 20)).select("pop", "locus", "variant", "stat")
    pips = ss.groupBy("locus", "variant").agg(r(F.sum(F.abs("stat"))).alias("pip"))
    truth = pips.filter("variant % 10 = 0").select("locus", "variant")
    return V.manhattan_locus(ss, pips, truth, ["locus"]).select("pop", "locus", "variant", "pip", "causal", "lead")
