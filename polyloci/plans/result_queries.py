"""Queries of the result-grid, cohort, classification, policy and stream families (C9, D8-D12, E26-E31, F, G, H10-H19, I, J, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import cohort as H
from ..operators import finemap as I
from ..operators import policy as P
from ..operators import results as R
from ..operators import tiles as L
from ..streaming import status as ST
from .bindings import GENO, GRID, LCG, geno, grid, query, r, table
from .variant_queries import _LD, _SS, _ld, _sumstats, tiles

# ---- fine-mapping


_PIP = f"""{_SS}, tau AS (SELECT pop, max(beta_hat * beta_hat) AS t FROM ss GROUP BY pop),
lb AS (SELECT (j - 1) // 20 AS locus, j, sum(0.5::DOUBLE * ln((1.0::DOUBLE / n) / (1.0::DOUBLE / n + t)) + 0.5::DOUBLE * beta_hat * beta_hat * n * t / (1.0::DOUBLE / n + t)) AS lbf FROM ss JOIN tau ON ss.pop = tau.pop GROUP BY j),
pip AS (SELECT locus, j, lbf, exp(lbf - max(lbf) OVER (PARTITION BY locus)) / sum(exp(lbf)) OVER (PARTITION BY locus) * exp(max(lbf) OVER (PARTITION BY locus)) AS pip FROM lb)"""


def _pips(spark, sf):
    ss = _sumstats(spark, sf).withColumn("locus", F.floor((F.col("j") - 1) / 20))
    tau = ss.groupBy("pop").agg(F.max(F.col("beta_hat") * F.col("beta_hat")).alias("tau_sq")).crossJoin(ss.select("locus").distinct())
    return I.single_effect_pip(ss, tau, ["locus"])


@query(f"WITH {_PIP} SELECT locus, j, round(lbf, 5) AS lbf, round(pip, 6) AS pip FROM pip")
def i1_single_effect_pip(spark, sf):
    return _pips(spark, sf).select("locus", "j", r("lbf", 5).alias("lbf"), r("pip").alias("pip"))


@query(f"""WITH {_PIP}, m AS (SELECT locus, j, pip, coalesce(sum(pip) OVER (PARTITION BY locus ORDER BY round(pip, 9) DESC, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM pip) SELECT locus, j, round(pip, 6) AS pip FROM m WHERE b <= 0.9""")
def i2_credible_set(spark, sf):
    x = I.credible_set(_pips(spark, sf), ["locus"], 0.9, digits=9)
    return x.select("locus", "j", r("pip").alias("pip"))


@query("""SELECT l_orderkey, CASE WHEN max(l_discount * 10) >= 1 THEN 1.0 ELSE round(1 - exp(sum(CASE WHEN l_discount * 10 < 1 THEN ln(1 - l_discount * 10) END)), 9) END::DOUBLE AS pip FROM lineitem GROUP BY l_orderkey""")
def i3_overall_pip(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("alpha", F.col("l_discount") * 10)
    return I.overall_pip(x, ["l_orderkey"]).select("l_orderkey", r("pip", 9).alias("pip"))


@query()
def i4_fit_multi_effect(spark, sf):
    """No SQL: iterative. Tested on constructed loci and, with one effect, against I1."""
    ss = _sumstats(spark, sf).withColumn("locus", F.floor((F.col("j") - 1) / 20).cast("int"))
    return I.fit_multi_effect(ss, L.ld_tiles(tiles(spark, sf), ["pop", "locus"]), ["locus"], ["locus"])


_MEM = "mem AS (SELECT locus, pop AS component, j AS variant FROM (SELECT DISTINCT locus, pop, j FROM geno) WHERE (j * 7 + pop) % 4 = 0)"


def _members(spark, sf):
    g = geno(spark, sf).select("locus", F.col("pop").alias("component"), F.col("j").alias("variant")).distinct()
    return g.filter((F.col("variant") * 7 + F.col("component")) % 4 == 0)


@query(f"""WITH {_LD}, {_MEM}, p AS (SELECT a.locus, a.component, c.pop, min(abs(c.r)) AS m FROM mem a JOIN mem b ON a.locus = b.locus AND a.component = b.component AND a.variant < b.variant JOIN c ON c.locus = a.locus AND c.i = a.variant AND c.j = b.variant GROUP BY ALL) SELECT locus, component, round(max(m), 6) AS purity FROM p GROUP BY locus, component""")
def i5_purity(spark, sf):
    x = I.purity(_members(spark, sf), _ld(spark, sf), ["locus", "component"], ["locus"])
    return x.select("locus", "component", r("purity").alias("purity"))


@query(f"""WITH {_LD}, {_MEM}, p AS (SELECT a.locus, a.component, a.variant, b.variant AS v2, max(abs(c.r)) AS m FROM mem a JOIN mem b ON a.locus = b.locus AND a.component = b.component AND a.variant < b.variant JOIN c ON c.locus = a.locus AND c.i = a.variant AND c.j = b.variant GROUP BY ALL) SELECT locus, component, round(min(m), 6) AS purity FROM p GROUP BY locus, component""")
def i5_purity_pairwise(spark, sf):
    x = I.purity(_members(spark, sf), _ld(spark, sf), ["locus", "component"], ["locus"], pairwise=True)
    return x.select("locus", "component", r("purity").alias("purity"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'execution_failure' WHEN o_custkey % 11 = 0 THEN 'invalid_output' WHEN o_orderstatus = 'P' THEN 'nonconverged' WHEN o_custkey % 4 > 0 THEN 'converged_cs' ELSE 'converged_no_cs' END AS fit_status FROM orders")
def i6_fit_status(spark, sf):
    o = table(spark, sf, "orders")
    x = o.select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, "x").alias("error"), (F.col("o_custkey") % 11 > 0).alias("valid"), (F.col("o_orderstatus") != "P").alias("converged"), (F.col("o_custkey") % 4).alias("n_credible_sets"))
    return I.fit_status(x).select("o_orderkey", "fit_status")


@query("""SELECT o_custkey % 50 AS locus, count(*) AS n, min(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS min_p_0, min(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) AS min_p_1 FROM orders GROUP BY 1""")
def i7_result_table(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("locus"), (F.col("o_orderkey") % 2).alias("pop"), F.col("o_totalprice").alias("p"))
    return I.result_table(o.groupBy("locus").agg(F.count("*").alias("n")), o, ["locus"], [0, 1])


@query(f"""WITH {_PIP}, a AS (SELECT s.pop, (s.j - 1) // 20 AS locus, sum(pip * exp(least(0.5::DOUBLE * beta_hat * beta_hat * s.n, 500))) AS bf FROM ss s JOIN pip ON pip.j = s.j GROUP BY ALL) SELECT locus, pop, round(bf / (1 + bf), 6) AS prob, bf / (1 + bf) > 0.8 AS called FROM a""")
def i8_pop_causal_prob(spark, sf):
    ss = _sumstats(spark, sf)
    lbf = ss.select(F.floor((F.col("j") - 1) / 20).alias("locus"), F.col("j").alias("variant"), "pop", (0.5 * F.col("beta_hat") * F.col("beta_hat") * F.col("n")).alias("lbf"))
    sets = _pips(spark, sf).select("locus", F.col("j").alias("variant"), F.col("pip").alias("alpha"))
    return I.pop_causal_prob(sets, lbf, ["locus"]).select("locus", "pop", r("prob").alias("prob"), "called")


_FIT = """p AS (SELECT o_orderkey AS k, l_linenumber AS v, max(l_discount * 10) AS pip FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL), t AS (SELECT o_orderkey AS k, 1 + o_custkey % 3 AS v FROM orders UNION SELECT o_orderkey, 9 FROM orders WHERE o_custkey % 2 = 0)"""


@query(f"""WITH {_FIT}, j AS (SELECT coalesce(p.k, t.k) AS k, p.v, pip, t.v IS NOT NULL AS c FROM p FULL JOIN t ON p.k = t.k AND p.v = t.v), s AS (SELECT p.k, p.v % 2 AS comp, count(*) AS size, count(t.v) AS hit FROM p LEFT JOIN t ON p.k = t.k AND p.v = t.v WHERE pip > 0.3 GROUP BY ALL),
  g AS (SELECT k, count(*) AS n_credible_sets, count_if(hit > 0) AS n_cs_containing_causal, sum(hit)::BIGINT AS n_causal_captured, avg((1 + comp) / 4.0::DOUBLE) AS mp FROM s GROUP BY k)
  SELECT j.k AS o_orderkey, any_value(ok) AS converged, count_if(c) AS n_causal, count_if(c AND j.v IS NULL) AS n_excluded_causal, round(max(CASE WHEN c AND ok THEN coalesce(pip, 0) END), 9) AS causal_pip_max, round(avg(CASE WHEN c AND ok AND j.v IS NOT NULL THEN pip END), 9) AS causal_pip_mean_eligible,
  round(max(CASE WHEN ok THEN coalesce(pip, 0) END), 9) AS top_pip, count_if(c AND ok AND pip > 0.5) AS n_true_pip50, count_if(NOT c AND ok AND pip > 0.5) AS n_false_pip50, count_if(c AND ok AND pip > 0.9) AS n_true_pip90, round(any_value(mp), 9) AS mean_cs_purity,
  coalesce(any_value(n_credible_sets), 0) AS n_credible_sets, coalesce(any_value(n_cs_containing_causal), 0) AS n_cs_containing_causal, coalesce(any_value(n_causal_captured), 0) AS n_causal_captured, coalesce(any_value(n_causal_captured), 0) > 0 AS any_causal_captured FROM j JOIN (SELECT o_orderkey AS k, o_orderstatus <> 'P' AS ok FROM orders) f ON f.k = j.k LEFT JOIN g ON j.k = g.k GROUP BY j.k""")
def f14_score_fits(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    pips = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", F.col("l_linenumber").cast("long").alias("variant")).agg(F.max(F.col("l_discount") * 10).alias("pip"))
    truth = o.select("o_orderkey", (1 + F.col("o_custkey") % 3).alias("variant")).union(o.filter("o_custkey % 2 = 0").select("o_orderkey", F.lit(9).cast("long"))).distinct()
    sets = pips.filter("pip > 0.3").select("o_orderkey", (F.col("variant") % 2).alias("component"), "variant").withColumn("purity", (1 + F.col("component")) / 4.0)
    x = I.score_fits(pips, sets, truth, ["o_orderkey"], o.select("o_orderkey", (F.col("o_orderstatus") != "P").alias("converged")))
    rounded = [r(c, 9).alias(c) for c in ("causal_pip_max", "causal_pip_mean_eligible", "top_pip", "mean_cs_purity")]
    return x.select("o_orderkey", "converged", "n_causal", "n_excluded_causal", *rounded, "n_true_pip50", "n_false_pip50", "n_true_pip90", "n_credible_sets", "n_cs_containing_causal", "n_causal_captured", "any_causal_captured")


_GV = f"{GENO}, gv AS (SELECT sample, site, pop, y, sum(((j * (1 + pop)) % 5 - 2)::DOUBLE * dosage) AS gv FROM geno GROUP BY ALL)"


def _gv(spark, sf):
    g = geno(spark, sf).withColumnRenamed("j", "variant")
    e = g.select("variant", "pop").distinct().withColumn("effect", ((F.col("variant") * (1 + F.col("pop"))) % 5 - 2).cast("double"))
    return I.genetic_value(g, e, ["sample", "site", "pop", "y"], ["variant", "pop"])


@query(f"WITH {_GV} SELECT site, pop, count(*) AS n, round(var_pop(gv) / var_pop(y), 3) AS h2 FROM gv GROUP BY site, pop")
def e26_empirical_h2(spark, sf):
    return I.empirical_h2(_gv(spark, sf), ["site", "pop"]).select("site", "pop", "n", r("h2", 3).alias("h2"))


@query("""SELECT l_returnflag, count(*) AS n, round(quantile_cont(e, 0.5), 9) AS median, round(quantile_cont(e, 0.95), 9) AS p95, round(max(e), 9) AS largest, round(avg(CASE WHEN e <= 0.25 THEN 1.0 ELSE 0.0 END), 9) AS share_pass FROM (SELECT l_returnflag, abs(l_discount - 0.05) / 0.05 AS e FROM lineitem) GROUP BY 1""")
def e27_h2_calibration(spark, sf):
    x = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_discount").alias("h2"), F.lit(0.05).alias("target"))
    x = I.h2_calibration(x, ["l_returnflag"], 0.25)
    return x.select("l_returnflag", "n", *[r(c, 9).alias(c) for c in ("median", "p95", "largest", "share_pass")])


@query("""WITH e AS (SELECT l_suppkey, l_partkey, avg(CASE WHEN l_returnflag = 'A' THEN l_discount END) AS a, avg(CASE WHEN l_returnflag = 'N' THEN l_discount END) AS b, avg(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS c FROM lineitem GROUP BY 1, 2), k AS (SELECT * FROM e WHERE a <> 0 AND b <> 0 AND c <> 0)
  SELECT l_suppkey % 10 AS target, count(*) AS n, round(CASE WHEN count(*) > 1 THEN corr(a, b) END, 6) AS r_A_N, round(CASE WHEN count(*) > 1 THEN corr(a, c) END, 6) AS r_A_R, round(CASE WHEN count(*) > 1 THEN corr(b, c) END, 6) AS r_N_R FROM k GROUP BY 1""")
def e28_effect_correlation(spark, sf):
    e = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("target"), "l_suppkey", "l_partkey", F.col("l_returnflag").alias("pop"), F.col("l_discount").alias("effect"))
    x = I.effect_correlation(e, ["target"], ["A", "N", "R"], variant=["l_suppkey", "l_partkey"])
    return x.select("target", "n", *[r(c).alias(c) for c in ("r_A_N", "r_A_R", "r_N_R")])


@query("""SELECT 'orders' AS name, (SELECT count(*) FROM orders)::DOUBLE AS observed, 10 * (SELECT count(*) FROM customer)::DOUBLE AS expected, (SELECT count(*) FROM orders) = 10 * (SELECT count(*) FROM customer) AS ok UNION ALL SELECT 'orphans', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))::DOUBLE, 0.0, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) = 0""")
def e29_invariants(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    orphans = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return I.invariants([("orders", o.agg(F.count("*")), 10 * table(spark, sf, "customer").count()), ("orphans", orphans.agg(F.count("*")), 0)])


@query("""SELECT l_returnflag, count_if(l_tax <= 0.04) AS n_match, max(l_tax) AS worst, quantile_cont(l_tax, 0.5) AS median, round(avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END), 9) AS share_off FROM lineitem GROUP BY 1""")
def e31_summarise_checks(spark, sf):
    x = I.summarise_checks(table(spark, sf, "lineitem"), ["l_returnflag"], "l_tax", 0.04)
    return x.select("l_returnflag", "n_match", "worst", "median", r("share_off", 9).alias("share_off"))


# ---- result grids


@query("""SELECT o_orderkey, c_mktsegment AS truth, len(string_split(c_mktsegment, 'U'))::INT AS n_ids FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 > 0) ON o_custkey = c_custkey""")
def d8_join_truth(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    m = table(spark, sf, "customer").filter("c_custkey % 5 > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("truth"), F.regexp_replace("c_mktsegment", "U", ",").alias("causal_snp_ids"))
    return R.join_truth(o, m, ["k"]).select("o_orderkey", "truth", F.when(F.col("causal_ids").isNotNull(), F.size("causal_ids")).alias("n_ids"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 19 > 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 1.001 ELSE o_totalprice * 1.000001 END AS p FROM orders WHERE o_orderkey % 23 > 0)
  SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE concat_ws(',', CASE WHEN a.s <> b.s THEN 's' END, CASE WHEN a.k % 5 = 0 THEN 'p' END) END AS reasons FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s OR a.k % 5 = 0""")
def d9_parity(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    a = o.filter(k % 19 > 0).select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    b = o.filter(k % 23 > 0).select("o_orderkey", F.when(k % 7 == 0, "x").otherwise(F.col("o_orderstatus")).alias("s"), F.when(k % 5 == 0, F.col("o_totalprice") * 1.001).otherwise(F.col("o_totalprice") * 1.000001).alias("p"))
    return R.parity(a, b, ["o_orderkey"], ["s"], ["p"]).select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH s AS (SELECT l_orderkey, l_returnflag, string_agg(DISTINCT l_linenumber::VARCHAR, '-' ORDER BY l_linenumber::VARCHAR) AS m FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(DISTINCT m, '|' ORDER BY m) AS sets FROM s GROUP BY l_orderkey""")
def d9_set_signature(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("component"), F.col("l_linenumber").cast("string").alias("snp_id"))
    joined = F.array_sort(F.transform("sets", lambda m: F.array_join(m, "-")))
    return R.set_signature(x, ["l_orderkey"]).select("l_orderkey", F.array_join(joined, "|").alias("sets"))


@query(f"WITH {GRID} SELECT locus, arm, architecture, count(*) AS n FROM grid WHERE (locus, architecture) IN (SELECT (locus, architecture) FROM grid WHERE region < 9 OR arm = 0 GROUP BY locus, architecture HAVING count(DISTINCT arm) = 2) AND (region < 9 OR arm = 0) GROUP BY ALL")
def d10_pair_arms(spark, sf):
    x = grid(spark, sf).filter("region < 9 OR arm = 0")
    return R.pair_arms(x, ["locus", "architecture"]).groupBy("locus", "arm", "architecture").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def d11_attach(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return R.attach(table(spark, sf, "customer"), n, ["c_nationkey"]).select("c_custkey", "n_name")


@query(f"WITH {GRID} SELECT locus, architecture, replicate, cutoff AS policy FROM (SELECT *, causal_pip AS purity FROM grid) JOIN (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) p(cutoff) ON purity >= cutoff")
def c9_apply_policies(spark, sf):
    pol = table(spark, sf, "region").filter("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, 0.5).otherwise(0.9).alias("cutoff")).withColumn("policy", F.col("cutoff"))
    return R.apply_policies(grid(spark, sf).withColumn("purity", F.col("causal_pip")), pol).select("locus", "architecture", "replicate", "policy")


_ROLL = "count(*) AS n, round(avg(CASE WHEN captured THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS power, round(avg(n_sets), 9) AS mean_sets, quantile_cont(best_size, 0.5)::DOUBLE AS median_size, round(avg(causal_pip), 9) AS mean_causal_pip, round(sum(n_true_sets) / sum(n_sets), 9)::DOUBLE AS coverage, round(avg(CASE WHEN NOT converged THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS nonconverged"


def _rolled(df, by):
    return df.select(*by, "n", *[r(c, 9).alias(c) for c in ("power", "mean_sets", "median_size", "mean_causal_pip", "coverage", "nonconverged")])


@query(f"WITH {GRID} SELECT architecture, h2, {_ROLL} FROM grid GROUP BY architecture, h2")
def f1_rollup_results(spark, sf):
    by = ["architecture", "h2"]
    return _rolled(R.rollup_results(grid(spark, sf), by), by)


def _boot(rows: str, by: str, draws: int) -> str:
    """SQL of the cluster bootstrap over rows (by, cluster, num, den)."""
    keys = [k.strip() for k in by.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    cols = lambda a: ", ".join(f"{a}.{k}" for k in keys)
    x = "((((draw * 7919 + slot * 104729 + 17) % 2147483647) * 48271 + 12345) % 2147483647 * 48271 + slot) % 2147483647"
    return f"""tot AS (SELECT {by}, cluster, sum(num)::DOUBLE AS num, sum(den)::DOUBLE AS den, row_number() OVER (PARTITION BY {by} ORDER BY cluster) - 1 AS rk, count(*) OVER (PARTITION BY {by}) AS nc FROM {rows} GROUP BY {by}, cluster),
pt AS (SELECT {by}, count(*) AS n_clusters, sum(num) / sum(den) AS ratio FROM tot GROUP BY {by}),
dr AS (SELECT {cols('p')}, draw, ({x}) % p.n_clusters AS rk FROM pt p, range(0, {draws}) a(draw), LATERAL (SELECT unnest(range(0, p.n_clusters)) AS slot)),
rt AS (SELECT {cols('d')}, d.draw, sum(num) / sum(den) AS ratio FROM dr d JOIN tot t ON {on('d', 't')} AND d.rk = t.rk GROUP BY {cols('d')}, d.draw),
bq AS (SELECT {by}, quantile_cont(ratio, 0.025) AS lo, quantile_cont(ratio, 0.975) AS hi FROM rt GROUP BY {by}),
boot AS (SELECT {cols('pt')}, n_clusters, round(ratio, 9) AS ratio, round(least(lo, ratio), 9) AS lo, round(greatest(hi, ratio), 9) AS hi FROM pt JOIN bq ON {on('pt', 'bq')})"""


def _booted(df, *by):
    return df.select(*by, "n_clusters", r("ratio", 9).alias("ratio"), r("lo", 9).alias("lo"), r("hi", 9).alias("hi"))


@query(f"WITH {GRID}, rws AS (SELECT architecture, region AS cluster, n_true_sets AS num, n_sets AS den FROM grid), {_boot('rws', 'architecture', 2000)} SELECT * FROM boot")
def f2_clustered_ratio(spark, sf):
    return _booted(R.clustered_ratio(grid(spark, sf), "n_true_sets", "n_sets", "region", ["architecture"], 2000), "architecture")


def _metrics():
    return {
        "power_any": (F.col("captured").cast("double"), F.lit(1.0)),
        "causal_recall": (F.col("n_caught"), F.col("n_causal")),
        "cs_coverage": (F.col("n_true_sets"), F.col("n_sets")),
        "fdr95": (F.col("n_false_pip95"), F.col("n_false_pip95") + F.col("n_true_pip95")),
    }


_MROWS = """unnest([{'m': 'power_any', 'num': captured::INT::DOUBLE, 'den': 1.0::DOUBLE}, {'m': 'causal_recall', 'num': n_caught::DOUBLE, 'den': n_causal::DOUBLE},
  {'m': 'cs_coverage', 'num': n_true_sets::DOUBLE, 'den': n_sets::DOUBLE}, {'m': 'fdr95', 'num': n_false_pip95::DOUBLE, 'den': (n_false_pip95 + n_true_pip95)::DOUBLE}]) AS x"""


@query(f"WITH {GRID}, r0 AS (SELECT stratum, region AS cluster, {_MROWS} FROM grid), rws AS (SELECT stratum, cluster, x.m AS metric, x.num AS num, x.den AS den FROM r0), {_boot('rws', 'stratum, metric', 2000)} SELECT * FROM boot")
def f3_f6_metric_summary(spark, sf):
    return _booted(R.metric_summary(grid(spark, sf), _metrics(), "region", ["stratum"]), "stratum", "metric")


@query(f"""WITH {GRID}, g AS (SELECT locus, architecture, any_value(region) AS region, arm, avg(causal_pip) AS v FROM grid GROUP BY locus, architecture, arm), rws AS (SELECT a.arm, a.region AS cluster, a.v - b.v AS num, 1.0 AS den FROM g a JOIN g b ON a.locus = b.locus AND a.architecture = b.architecture WHERE a.arm = 1 AND b.arm = 0), {_boot('rws', 'arm', 2000)} SELECT * FROM boot""")
def f4_paired_differences(spark, sf):
    g = grid(spark, sf)
    x = R.pair_arms(g, ["locus", "architecture"]).groupBy("locus", "architecture", "region", "arm").agg(F.avg("causal_pip").alias("v"))
    return _booted(R.paired_differences(x, ["locus", "architecture"], "v", "arm", 0, "region"), "arm")


@query(f"""WITH {GRID}, r0 AS (SELECT region AS cluster, arm, {_MROWS} FROM grid), t AS (SELECT cluster, arm, x.m AS metric, sum(x.num) AS num, sum(x.den) AS den FROM r0 GROUP BY ALL), rws AS (SELECT DISTINCT 1 AS one, cluster, 1.0 AS num, 1.0 AS den FROM t), {_boot('rws', 'one', 2000)},
  rr AS (SELECT metric, d.draw, sum(CASE WHEN arm = 1 THEN t.num END) / sum(CASE WHEN arm = 1 THEN t.den END) - sum(CASE WHEN arm = 0 THEN t.num END) / sum(CASE WHEN arm = 0 THEN t.den END) AS v FROM dr d JOIN tot o ON d.rk = o.rk JOIN t ON t.cluster = o.cluster GROUP BY ALL),
  pp AS (SELECT metric, sum(CASE WHEN arm = 0 THEN num END) / sum(CASE WHEN arm = 0 THEN den END) AS a, sum(CASE WHEN arm = 1 THEN num END) / sum(CASE WHEN arm = 1 THEN den END) AS b FROM t GROUP BY metric)
  SELECT pp.metric, round(a, 9) AS first, round(b, 9) AS second, round(b - a, 9) AS difference, round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.975), 9) AS hi FROM pp JOIN rr ON pp.metric = rr.metric GROUP BY ALL""")
def f5_paired_method_summary(spark, sf):
    x = R.paired_method_summary(grid(spark, sf), _metrics(), "arm", (0, 1), "region")
    return x.select("metric", *[r(c, 9).alias(c) for c in ("first", "second", "difference", "lo", "hi")])


# A candidate with no set at all has no coverage.
@query(f"""WITH {GRID}, c AS (SELECT n_sets || '-' || region AS candidate, avg(CASE WHEN captured THEN 1.0::DOUBLE ELSE 0 END) AS power, avg(CASE WHEN causal_pip > 0.95::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS yield, count(*) AS n_instances, count(DISTINCT locus) AS n_loci,
  CASE WHEN sum(n_sets) > 0 THEN sum(n_true_sets) / sum(n_sets) END AS coverage, sum(n_false_pip95) / sum(n_false_pip95 + n_true_pip95) AS fdr FROM grid GROUP BY 1),
  e AS (SELECT *, coalesce(coverage >= 0.6, FALSE) AND coalesce(fdr, 0) <= 0.2 AS eligible, candidate IN ('1-1', '1-5') AS solo FROM c)
  SELECT candidate, n_instances, n_loci, round(yield, 9) AS yield, round(coverage, 9)::DOUBLE AS coverage, eligible, solo, row_number() OVER (ORDER BY eligible DESC, power DESC, solo DESC, candidate)::INT AS rank FROM e""")
def f7_rank_candidates(spark, sf):
    x = grid(spark, sf).withColumn("candidate", F.concat_ws("-", "n_sets", "region"))
    return R.rank_candidates(x, "candidate", ["1-1", "1-5"], 0.6, 0.2).select("candidate", "n_instances", "n_loci", r("yield", 9).alias("yield"), r("coverage", 9).alias("coverage"), "eligible", "solo", "rank")


@query(f"WITH {GRID} SELECT arm, architecture, count(*) AS n, round(sum(n_caught) / sum(n_causal), 9)::DOUBLE AS recall, round(avg(best_size), 9) AS mean_size, sum(n_true_pip95)::BIGINT AS true_pip95, round(sum(runtime_s), 4) AS runtime_s FROM grid GROUP BY arm, architecture")
def f8_pilot_summary(spark, sf):
    return R.pilot_summary(grid(spark, sf), ["arm", "architecture"]).select("arm", "architecture", "n", r("recall", 9).alias("recall"), r("mean_size", 9).alias("mean_size"), "true_pip95", r("runtime_s", 4).alias("runtime_s"))


@query(f"""WITH {GRID}, o AS (SELECT architecture, unnest([CASE WHEN n_sets > 0 AND NOT failed THEN 'returned' END, CASE WHEN converged AND n_sets = 0 AND NOT failed THEN 'converged_no_cs' END, CASE WHEN NOT converged AND NOT failed THEN 'nonconverged' END, CASE WHEN failed THEN 'error' END]) AS o FROM grid)
  SELECT architecture, outcome, count_if(o = outcome) AS n FROM o, (VALUES ('returned'), ('converged_no_cs'), ('nonconverged'), ('error')) t(outcome) GROUP BY ALL""")
def f9_outcome_counts(spark, sf):
    return R.outcome_counts(grid(spark, sf), ["architecture"])


@query(f"WITH {GRID} SELECT architecture, quantile_cont(best_size, 0.25)::DOUBLE AS q25, quantile_cont(best_size, 0.5)::DOUBLE AS q50, quantile_cont(best_size, 0.75)::DOUBLE AS q75, quantile_cont(best_size, 0.95)::DOUBLE AS q95 FROM grid GROUP BY architecture")
def f9_resolution(spark, sf):
    return R.resolution(grid(spark, sf), ["architecture"], "best_size")


@query(f"WITH {GRID} SELECT architecture, sum(n_true_pip95)::BIGINT AS true_all, sum(n_false_pip95)::BIGINT AS false_all, sum(CASE WHEN n_sets = 1 THEN n_true_pip95 END)::BIGINT AS true_single, sum(CASE WHEN n_sets = 1 THEN n_false_pip95 END)::BIGINT AS false_single FROM grid GROUP BY architecture")
def f9_confident_counts(spark, sf):
    return R.confident_counts(grid(spark, sf), ["architecture"])


@query(f"WITH {GRID}, x AS (SELECT locus, architecture, {_ROLL} FROM grid GROUP BY locus, architecture) SELECT locus, architecture, n, power, coverage FROM x WHERE n >= 60")
def f10_power_coverage(spark, sf):
    x = R.power_coverage(grid(spark, sf), ["locus", "architecture"], 60)
    return x.select("locus", "architecture", "n", r("power", 9).alias("power"), r("coverage", 9).alias("coverage"))


@query(f"WITH {GRID} SELECT arm, floor(log10(runtime_s))::INT AS decade, count(*) AS n, round(sum(runtime_s), 4) AS total FROM grid WHERE runtime_s > 0 GROUP BY ALL")
def f11_runtime_profile(spark, sf):
    return R.runtime_profile(grid(spark, sf), ["arm"]).select("arm", "decade", "n", r("total", 4).alias("total"))


@query(f"WITH {GRID} SELECT arm, ((causal_pip > 0.1)::INT + (causal_pip > 0.3)::INT + (causal_pip > 0.5)::INT + (causal_pip > 0.7)::INT + (causal_pip > 0.9)::INT + (causal_pip > 0.95)::INT)::INT AS bin, count(*) AS n, round(avg(CASE WHEN locus % 4 = 1 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS contamination FROM grid GROUP BY ALL")
def f12_contamination_bins(spark, sf):
    x = R.contamination_bins(grid(spark, sf).withColumn("inconsistent", F.col("locus") % 4 == 1), ["arm"], "causal_pip")
    return x.select("arm", "bin", "n", r("contamination", 9).alias("contamination"))


@query(f"WITH {GRID} SELECT arm, count(*) AS n, round(quantile_cont(runtime_s, 0.5), 6) AS p50, round(quantile_cont(runtime_s, 0.9), 6) AS p90, round(quantile_cont(runtime_s, 0.99), 6) AS p99, round(avg(runtime_s), 6) AS mean, round(max(runtime_s), 6) AS largest, round(avg(runtime_s) * 100000 / 32 / 3600, 6) AS projected_hours FROM grid GROUP BY arm")
def f11_runtime_cost(spark, sf):
    x = R.runtime_cost(grid(spark, sf), ["arm"], 100_000, 32)
    return x.select("arm", "n", *[r(c).alias(c) for c in ("p50", "p90", "p99", "mean", "largest", "projected_hours")])


@query(f"WITH {GRID}, x AS (SELECT architecture, {_ROLL} FROM grid WHERE h2 = (SELECT min(h2) FROM grid) GROUP BY architecture) SELECT architecture, n, coverage FROM x")
def f13_weakest_signal(spark, sf):
    return R.weakest_signal(grid(spark, sf), ["architecture"]).select("architecture", "n", r("coverage", 9).alias("coverage"))


@query(f"""WITH {GRID} SELECT architecture, round(avg(CASE WHEN stratum = 0 THEN captured::INT END), 9) AS s0, round(avg(CASE WHEN stratum = 1 THEN captured::INT END), 9) AS s1, round(avg(CASE WHEN stratum = 2 THEN captured::INT END), 9) AS s2 FROM grid GROUP BY architecture""")
def f13_pivot_power(spark, sf):
    x = R.pivot_power(grid(spark, sf), ["architecture"], "stratum", [0, 1, 2])
    return x.select("architecture", *[r(F.col(f"`{k}`"), 9).alias(f"s{k}") for k in range(3)])


@query(f"WITH {GRID} SELECT arm, count(*) AS n, round(quantile_cont(causal_pip, 0.5), 9) AS median, round(avg(CASE WHEN causal_pip > 0.8 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS share_called, any_value(people) AS cohort_n FROM grid LEFT JOIN (SELECT c_nationkey % 2 AS a, count(*) AS people FROM customer GROUP BY 1) ON a = arm GROUP BY arm")
def f24_pop_probability(spark, sf):
    people = table(spark, sf, "customer").groupBy((F.col("c_nationkey") % 2).cast("long").alias("arm")).agg(F.count("*").alias("n"))
    x = R.pop_probability(grid(spark, sf).withColumn("prob", F.col("causal_pip")), ["arm"], cohort=people, pop="arm")
    return x.select("arm", "n", r("median", 9).alias("median"), r("share_called", 9).alias("share_called"), "cohort_n")


@query(f"WITH {GRID} SELECT architecture, h2, stratum, count(*) AS n FROM grid GROUP BY ALL")
def f25_design_counts(spark, sf):
    return R.design_counts(grid(spark, sf), ["architecture", "h2", "stratum"])


@query("SELECT l_returnflag, least(floor(l_discount * 5 * 20), 9)::INT AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def f25_maf_spectrum(spark, sf):
    return R.maf_spectrum(table(spark, sf, "lineitem").withColumn("maf", F.col("l_discount") * 5), ["l_returnflag"])


@query("SELECT l_returnflag, round(avg(CASE WHEN l_discount / 4 < 0.005 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS under_005, round(avg(CASE WHEN l_discount / 4 < 0.01 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS under_01, round(avg(CASE WHEN l_discount / 4 < 0.05 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS under_05 FROM lineitem GROUP BY 1")
def f25_rare_shares(spark, sf):
    x = R.rare_shares(table(spark, sf, "lineitem").withColumn("maf", F.col("l_discount") / 4), ["l_returnflag"])
    return x.select("l_returnflag", *[r(c, 9).alias(c) for c in ("under_005", "under_01", "under_05")])


@query(f"WITH {GRID}, rws AS (SELECT h2, n_causal, region AS cluster, n_caught AS num, n_causal AS den FROM grid), {_boot('rws', 'h2, n_causal', 2000)} SELECT * FROM boot")
def f26_recall_curves(spark, sf):
    return _booted(R.clustered_ratio(grid(spark, sf).withColumn("den", F.col("n_causal")), "n_caught", "den", "region", ["h2", "n_causal"]), "h2", "n_causal")


@query(f"""WITH {GRID}, r0 AS (SELECT stratum, architecture, region AS cluster, best_size, unnest([{{'m': 'power', 'num': captured::INT::DOUBLE, 'den': 1.0::DOUBLE}}, {{'m': 'yield', 'num': n_sets::DOUBLE, 'den': 1.0::DOUBLE}}, {{'m': 'coverage', 'num': n_true_sets::DOUBLE, 'den': n_sets::DOUBLE}}]) AS x FROM grid),
  rws AS (SELECT stratum, architecture, cluster, x.m AS metric, x.num AS num, x.den AS den FROM r0), {_boot('rws', 'stratum, architecture, metric', 2000)}, sz AS (SELECT stratum, architecture, quantile_cont(best_size, 0.5)::DOUBLE AS median_size FROM grid GROUP BY ALL)
  SELECT boot.*, median_size FROM boot JOIN sz ON boot.stratum = sz.stratum AND boot.architecture = sz.architecture""")
def f26_stratum_panels(spark, sf):
    x = R.stratum_panels(grid(spark, sf), ["stratum", "architecture"], "region")
    return x.select("stratum", "architecture", "metric", "n_clusters", r("ratio", 9).alias("ratio"), r("lo", 9).alias("lo"), r("hi", 9).alias("hi"), "median_size")


@query("SELECT p_partkey % 5 AS chrom, count(*) AS n, round(corr(p_size, p_retailprice), 6) AS r FROM part GROUP BY 1")
def f25_size_divergence(spark, sf):
    p = table(spark, sf, "part").withColumn("chrom", F.col("p_partkey") % 5)
    return R.size_divergence(p, ["chrom"], "p_size", "p_retailprice").select("chrom", "n", r("r").alias("r"))


@query("""WITH c AS (SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY n_regionkey), 9)::DOUBLE AS share FROM c""")
def f25_composition(spark, sf):
    x = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return H.composition(x, ["n_regionkey", "c_mktsegment"]).select("n_regionkey", "c_mktsegment", "n", r("share", 9).alias("share"))


@query("""WITH p AS (SELECT n_regionkey AS site, count(*) AS n, count(DISTINCT c_mktsegment) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), b AS (SELECT n_regionkey AS site, count(*) AS b, count_if(s_suppkey % 3 = 0) AS f FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
  SELECT p.site, n AS n_people, k AS n_ancestries, coalesce(b, 0) AS n_blocks, coalesce(f, 0) AS n_flipped FROM p LEFT JOIN b ON p.site = b.site""")
def e25_site_summary(spark, sf):
    n = table(spark, sf, "nation")
    people = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("site"), F.col("c_mktsegment").alias("pop"))
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("site"), (F.col("s_suppkey") % 3 == 0).alias("flip"))
    return H.site_summary(people, s, s)


@query(f"""WITH {GRID}, g AS (SELECT locus, architecture, any_value(region) AS region, arm, avg(captured::INT) AS v FROM grid GROUP BY locus, architecture, arm), rws AS (SELECT a.arm, a.region AS cluster, a.v - b.v AS num, 1.0 AS den FROM g a JOIN g b ON a.locus = b.locus AND a.architecture = b.architecture WHERE a.arm = 1 AND b.arm = 0), {_boot('rws', 'arm', 2000)} SELECT arm, n_clusters, round(100 * ratio, 6) AS ratio, round(100 * lo, 6) AS lo, round(100 * hi, 6) AS hi FROM boot""")
def f13_power_gain(spark, sf):
    g = grid(spark, sf).groupBy("locus", "architecture", "region", "arm").agg(F.avg(F.col("captured").cast("double")).alias("power"))
    x = R.power_gain(g, ["locus", "architecture"], "arm", 0, "region")
    return x.select("arm", "n_clusters", r("ratio").alias("ratio"), r("lo").alias("lo"), r("hi").alias("hi"))


# ---- integrity


@query("""SELECT (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)) AS n_duplicate,
  (SELECT count(*) FROM (SELECT o_orderkey, unnest([1, 2]) AS l FROM orders EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem)) AS n_missing,
  (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem EXCEPT SELECT o_orderkey, unnest([1, 2]) FROM orders)) AS n_extra, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS n_error""")
def g2_check_grid(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("error", F.when(F.col("l_returnflag") == "R", "x"))
    want = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(F.lit(1), F.lit(2))).alias("l_linenumber"))
    return R.check_grid(li, want, ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, n_nationkey, r_regionkey FROM customer, nation, region")
def g3_expected_grid(spark, sf):
    return R.expected_grid(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "nation").select("n_nationkey"), table(spark, sf, "region").select("r_regionkey"))


@query("""WITH m AS (SELECT page_id AS path, sha256(coalesce(html, '')) AS h FROM pages), b AS (SELECT path, CASE WHEN path % 7 = 0 THEN 'x' ELSE h END AS h FROM m WHERE path % 11 > 0 UNION ALL SELECT -path, h FROM m WHERE path % 13 = 1)
  SELECT coalesce(m.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra' ELSE 'differs' END AS state FROM m FULL JOIN b ON m.path = b.path WHERE m.path IS NULL OR b.path IS NULL OR m.h <> b.h""")
def g4_diff_manifest(spark, sf):
    k = F.col("path")
    m = table(spark, sf, "pages").select(F.col("page_id").alias("path"), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("sha256"))
    b = m.filter(k % 11 > 0).withColumn("sha256", F.when(k % 7 == 0, "x").otherwise(F.col("sha256"))).unionByName(m.filter(k % 13 == 1).withColumn("path", -k))
    return P.diff_manifest(m, b)


def _tree(lines: str) -> str:
    """The tree of fingerprint() over rows (k, o, l) up to two levels, which is FAN squared lines a group."""
    leaves = f"SELECT k, r // {P.FAN} AS b, sha256(string_agg(l, chr(10) ORDER BY r)) AS d FROM (SELECT k, l, row_number() OVER (PARTITION BY k ORDER BY o, l) - 1 AS r FROM ({lines})) GROUP BY 1, 2"
    return f"b AS ({leaves}), t AS (SELECT k, CASE WHEN count(*) = 1 THEN min(d) ELSE sha256(string_agg(d, chr(10) ORDER BY b)) END AS d FROM b GROUP BY k)"


@query(f"WITH {_tree("SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS o, l_orderkey || ':' || l_linenumber AS l FROM lineitem")} SELECT k AS l_suppkey, d AS fingerprint FROM t")
def g5_fingerprint(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return P.fingerprint(li, ["l_suppkey"], "o", F.concat_ws(":", "l_orderkey", "l_linenumber"))


@query(f"""WITH m AS (SELECT doc_id::VARCHAR AS path, source AS parent, strlen(coalesce(text, ''))::BIGINT AS size, sha256(coalesce(text, '')) AS h FROM documents),
  {_tree("SELECT parent AS k, path AS o, path || ' ' || h AS l FROM m")}, z AS (SELECT parent, sum(size)::BIGINT AS size FROM m GROUP BY 1) SELECT parent AS path, size, d AS sha256 FROM z JOIN t ON parent IS NOT DISTINCT FROM k""")
def g6_bundle_ids(spark, sf):
    d = table(spark, sf, "documents")
    return P.bundle_ids(P.content_manifest(d, "doc_id", F.coalesce("text", F.lit("")), F.col("source")))


# Nested paths: a document lies in <source>/<language>/<last digit>.
_PATH = "coalesce(source, 'none') || '/' || coalesce(lang, 'und') || '/' || doc_id % 10 || '/' || doc_id"
_FILES = f"files AS (SELECT {_PATH} AS path, strlen(coalesce(text, ''))::BIGINT AS size, sha256(coalesce(text, '')) AS h FROM documents)"


def _bundles() -> str:
    """The directories above `files`, three levels and the root."""
    up = lambda p: f"CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') WHEN {p} <> '' THEN '' END"
    ctes = [f"l4 AS (SELECT path, {up('path')} AS parent, string_split(path, '/')[-1] AS name, 4 AS depth, FALSE AS is_bundle, size, h AS id, h AS checksum FROM files)"]
    for d in (3, 2, 1, 0):
        ctes.append(f"l{d} AS (SELECT parent AS path, {up('parent')} AS parent, string_split(parent, '/')[-1] AS name, {d} AS depth, TRUE AS is_bundle, sum(size)::BIGINT AS size, sha256(string_agg(name || chr(0) || id || chr(10), '' ORDER BY name)) AS id, sha256(string_agg(checksum, '' ORDER BY checksum)) AS checksum FROM (SELECT parent AS p, * FROM l{d + 1}) GROUP BY parent)")
    return ", ".join(ctes)


def _nested(spark, sf):
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("und")), F.col("doc_id") % 10, F.col("doc_id"))
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", path.alias("path"), F.octet_length(text).cast("long").alias("size"), F.sha2(text.cast("binary"), 256).alias("sha256"))


@query(f"WITH {_FILES}, {_bundles()} SELECT * FROM l4 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0")
def g6_content_tree(spark, sf):
    return P.content_tree(_nested(spark, sf))


@query(f"""WITH {_FILES}, now AS (SELECT path, CASE WHEN path LIKE '%7' THEN 'x' ELSE h END AS h FROM files WHERE path NOT LIKE '%/3/%' AND path NOT LIKE '%11' UNION ALL SELECT path || '-copy', h FROM files WHERE path LIKE '%42' UNION ALL SELECT 'new/' || path, h FROM files WHERE path LIKE '%55'),
  a AS (SELECT path, h FROM files UNION ALL SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/'), NULL FROM files, range(0, 4) t(k)),
  b AS (SELECT path, h FROM now UNION ALL SELECT DISTINCT array_to_string(s[1:k], '/'), NULL FROM (SELECT string_split(path, '/') AS s FROM now), range(0, 6) t(k) WHERE k < len(s)),
  j AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' WHEN a.h <> b.h THEN 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path)
  SELECT path, state FROM j WHERE state IS NOT NULL AND CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END NOT IN (SELECT path FROM j WHERE state IS NOT NULL)""")
def g6_verify_tree(spark, sf):
    files, p = _nested(spark, sf), F.col("path")
    now = files.filter(~p.like("%/3/%") & ~p.like("%11")).withColumn("sha256", F.when(p.like("%7"), "x").otherwise(F.col("sha256")))
    now = now.unionByName(files.filter(p.like("%42")).withColumn("path", F.concat("path", F.lit("-copy")))).unionByName(files.filter(p.like("%55")).withColumn("path", F.concat(F.lit("new/"), "path")))
    return P.verify_tree(P.content_tree(files), now)


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def g7_check_split(spark, sf):
    return H.check_split(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "F", "P")


# ---- cohorts


@query("""WITH p AS (SELECT DISTINCT user_id, event_type FROM events) SELECT a.event_type AS site_a, b.event_type AS site_b, count(*) AS n_shared FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL""")
def g1_site_overlaps(spark, sf):
    return H.site_overlaps(table(spark, sf, "events"), "user_id", "event_type")


_CAP = "cap AS (SELECT c_nationkey AS cell, count(*) AS capacity FROM customer GROUP BY 1)"


def _cap(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("cell")).agg(F.count("*").alias("capacity"))


@query(f"""WITH {_CAP}, x AS (SELECT *, capacity * tt // (sum(capacity) OVER ())::BIGINT AS b, capacity * tt % (sum(capacity) OVER ())::BIGINT AS rest FROM cap, (SELECT count(*) // 3 AS tt FROM customer)), k AS (SELECT *, row_number() OVER (ORDER BY rest DESC, cell) AS rk, tt - (sum(b) OVER ())::BIGINT AS lft FROM x) SELECT cell, capacity, b + (rk <= lft)::INT AS quota FROM k""")
def h10_allocate(spark, sf):
    return H.allocate(_cap(spark, sf), table(spark, sf, "customer").count() // 3, "cell")


@query(f"""WITH {_CAP} SELECT cell, capacity, greatest(0, least(capacity, (SELECT count(*) // 3 FROM customer) - coalesce(sum(capacity) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS quota FROM cap""")
def h10_allocate_priority(spark, sf):
    return H.allocate_priority(_cap(spark, sf), table(spark, sf, "customer").count() // 3, ["cell"])


@query(f"""WITH k AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {LCG.format('c_custkey', 5)}, c_custkey) - 1 AS rk FROM customer) SELECT c_custkey, c_nationkey AS pop, CASE WHEN rk < 10 THEN 's0' WHEN rk < 25 THEN 's1' ELSE 's2' END AS site FROM k WHERE rk < 30""")
def h11_assign_individuals(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("pop"))
    quota = people.select("pop").distinct().withColumn("q", F.explode(F.array(*[F.struct(F.lit(s).alias("site"), F.lit(n).alias("quota")) for s, n in (("s0", 10), ("s1", 15), ("s2", 5))]))).select("pop", "q.*")
    return H.assign_individuals(people, quota, "c_custkey", 5, strict=False)


@query(f"""WITH k AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {LCG.format('c_custkey', 9)}, c_custkey) AS rk FROM customer) SELECT c_custkey, c_nationkey FROM k WHERE rk <= 5 + c_nationkey % 3""")
def h12_compose_cohort(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    quota = people.select("c_nationkey").distinct().withColumn("quota", 5 + F.col("c_nationkey") % 3)
    return H.compose_cohort(people, quota, "c_custkey", 9, ["c_nationkey"], strict=False)  # small tables have too few in some cells


@query(f"""WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY {LCG.format('c_custkey', 2)}, c_custkey) - 1 AS rk FROM customer) SELECT c_custkey, CASE WHEN rk < 300 THEN 'a' WHEN rk < 800 THEN 'b' ELSE 'c' END AS site FROM k WHERE rk < 1000""")
def h13_split_sites(spark, sf):
    return H.split_sites(table(spark, sf, "customer").select("c_custkey"), [("a", 300), ("b", 500), ("c", 200)], "c_custkey", 2)


@query(f"""WITH p AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS k, min(o_orderpriority) AS lab FROM orders GROUP BY 1), g AS (SELECT *, count(*) OVER (PARTITION BY lab) AS n, row_number() OVER (PARTITION BY lab ORDER BY {LCG.format('o_custkey', 4)}, o_custkey) AS rk FROM p WHERE k = 1),
  t AS (SELECT *, greatest(1, round_even(n * 0.2, 0)) AS te FROM g), s AS (SELECT o_custkey, CASE WHEN n < 3 THEN 'excluded' WHEN rk <= te THEN 'test' WHEN rk <= te + greatest(1, round_even((n - te) * 0.1, 0)) THEN 'validation' ELSE 'train' END AS split FROM t)
  SELECT o_orderkey, coalesce(split, 'excluded') AS split FROM orders LEFT JOIN s ON orders.o_custkey = s.o_custkey""")
def h14_patient_holdout(spark, sf):
    return H.patient_holdout(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", 4).select("o_orderkey", "split")


@query("""WITH l AS (SELECT o_orderpriority AS lab, count(*) AS n, row_number() OVER (ORDER BY o_orderpriority) - 1 AS k FROM orders GROUP BY 1), w AS (SELECT lab, n, s, n * (1 / (1 + (s + k) % 4)::DOUBLE) / sum(1 / (1 + (s + k) % 4)::DOUBLE) OVER (PARTITION BY lab) AS sh FROM l, range(0, 4) t(s)),
  b AS (SELECT *, floor(sh) AS b, row_number() OVER (PARTITION BY lab ORDER BY round(sh - floor(sh), 9) DESC, s) AS rk FROM w) SELECT lab AS o_orderpriority, s::INT AS site, (b + (rk <= n - sum(b) OVER (PARTITION BY lab))::INT)::BIGINT AS quota FROM b""")
def h15_skewed_quotas(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return H.skewed_quotas(n, 4, 1.0, "o_orderpriority")


@query()
def h15_partition_sites(spark, sf):
    """No SQL: label preferences are drawn. Tested for capacities, class minimum, skew and repeatability."""
    people = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return H.partition_sites(people, "c_custkey", "c_mktsegment", 0.5, 0.1, 7, minimum=1)


@query(f"""WITH l AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {LCG.format('c_custkey', 6)}, c_custkey) AS rk FROM customer) SELECT o_orderkey FROM orders WHERE o_orderkey % 10 < 3 AND o_custkey IN (SELECT c_custkey FROM l WHERE rk <= 8)""")
def h17_sample_instances(spark, sf):
    loci = table(spark, sf, "customer").select(F.col("c_custkey").alias("locus"), F.col("c_mktsegment").alias("stratum"))
    m = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("locus"), (F.col("o_orderkey") % 10).alias("replicate"))
    return H.sample_instances(loci, m, 8, 3, "locus", 6).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey % 7 = 3")
def h18_shard(spark, sf):
    return H.shard(table(spark, sf, "part"), 3, 7, "p_partkey").select("p_partkey")


@query("""WITH f AS (SELECT DISTINCT o_orderpriority AS a, o_orderstatus AS b, n AS c FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT DISTINCT o_orderstatus FROM orders), (SELECT DISTINCT n_regionkey AS n FROM nation)) SELECT * FROM f WHERE (a <> '1-URGENT')::INT + (b <> 'F')::INT + (c <> 0)::INT <= 1""")
def h19_design_grid(spark, sf):
    o, n = table(spark, sf, "orders"), table(spark, sf, "nation")
    return H.design_grid(o.select(F.col("o_orderpriority").alias("a")).distinct(), o.select(F.col("o_orderstatus").alias("b")).distinct(), n.select(F.col("n_regionkey").alias("c")).distinct(), "extended", ("1-URGENT", "F", 0))


@query("""WITH c AS (SELECT c_custkey AS p, count(DISTINCT c_mktsegment) AS k, min(c_mktsegment) AS lab FROM customer WHERE c_custkey % 9 > 0 GROUP BY 1), f AS (SELECT o_orderkey, o_custkey, k, lab, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rk FROM orders LEFT JOIN c ON o_custkey = p)
  SELECT o_orderkey, CASE WHEN k IS NULL THEN 'no_case' WHEN lab NOT IN ('BUILDING', 'MACHINERY') THEN 'class' WHEN rk > 1 THEN 'second_sample' ELSE 'ok' END AS reason FROM f""")
def d12_select_cohort(spark, sf):
    files = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("patient"))
    cases = table(spark, sf, "customer").filter("c_custkey % 9 > 0").select(F.col("c_custkey").alias("patient"), F.col("c_mktsegment").alias("label"))
    return H.select_cohort(files, cases, ["BUILDING", "MACHINERY"], "patient", "o_orderkey", "label").select("o_orderkey", "reason")


# ---- classification

_FEAT = f"{GENO}, feat AS (SELECT sample, label, j, v, sample % 5 > 0 AS train FROM geno)"


@query(f"WITH {_FEAT}, s AS (SELECT j, count(v) AS n, var_pop(v) AS var FROM feat WHERE train GROUP BY j) SELECT j AS feature, n, round(var, 9) AS variance, row_number() OVER (ORDER BY round(var, 9) DESC, j)::INT AS rank FROM s QUALIFY rank <= 20")
def f15_select_panel(spark, sf):
    x = geno(spark, sf).filter("sample % 5 > 0").select(F.col("j").alias("feature"), F.col("v").alias("value"))
    return C.select_panel(x, 20).select("feature", "n", r("variance", 9).alias("variance"), "rank")


@query("""WITH n AS (SELECT c_nationkey, count_if(c_custkey % 5 > 0) AS n FROM customer GROUP BY 1) SELECT c_custkey, CASE WHEN n >= 50 THEN c.c_nationkey::VARCHAR ELSE 'other' END AS class FROM customer c JOIN n ON c.c_nationkey = n.c_nationkey""")
def f16_collapse_classes(spark, sf):
    x = table(spark, sf, "customer").withColumn("train", F.col("c_custkey") % 5 > 0)
    return C.collapse_classes(x, 50, "c_nationkey", "train").select("c_custkey", "class")


@query("""WITH g AS (SELECT s, o FROM (SELECT DISTINCT o_orderstatus AS s FROM orders), (SELECT DISTINCT o_orderpriority AS o FROM orders)), c AS (SELECT o_orderstatus AS s, o_orderpriority AS o, count(*) AS c FROM orders GROUP BY ALL), n AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1)
  SELECT g.s AS o_orderstatus, g.o AS o_orderpriority, round(coalesce(n / ((SELECT count(DISTINCT o_orderpriority) FROM orders) * c), 0), 9)::DOUBLE AS weight FROM g JOIN n ON g.s = n.s LEFT JOIN c ON g.s = c.s AND g.o = c.o""")
def f17_class_weights(spark, sf):
    return C.class_weights(table(spark, sf, "orders"), "o_orderpriority", ["o_orderstatus"]).select("o_orderstatus", "o_orderpriority", r("weight", 9).alias("weight"))


_LOGIT = """lg AS (SELECT o_orderkey, o_custkey % 3 AS y, o_orderkey % 2 AS model, [(o_orderkey % 17) / 4.0::DOUBLE, (o_custkey % 13) / 3.0::DOUBLE, (o_orderkey % 5)::DOUBLE] AS z FROM orders),
pr AS (SELECT *, list_position(z, list_max(z)) - 1 AS pred, 1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS conf FROM lg)"""


def _logits(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = table(spark, sf, "orders").select("o_orderkey", (c % 3).alias("y"), (k % 2).alias("model"), F.array(k % 17 / 4.0, c % 13 / 3.0, (k % 5).cast("double")).alias("logits"))
    return C.softmax_columns(x)


@query(f"""WITH {_LOGIT}, o AS (SELECT model, count(*) AS n, avg((pred = y)::INT) AS accuracy, avg((conf >= 0.9)::INT) AS confident_rate, avg(CASE WHEN conf >= 0.9 THEN (pred = y)::INT END) AS confident_accuracy FROM pr GROUP BY model),
  t AS (SELECT model, y AS k, count(*) AS t, sum((pred = y)::INT) AS tp FROM pr GROUP BY ALL), p AS (SELECT model, pred AS k, count(*) AS p FROM pr GROUP BY ALL),
  f AS (SELECT coalesce(t.model, p.model) AS model, avg(tp / t) AS ba, sum(2 * coalesce(tp, 0) / (coalesce(t, 0) + coalesce(p, 0))) / 3 AS mf FROM t FULL JOIN p ON t.model = p.model AND t.k = p.k GROUP BY 1),
  b AS (SELECT model, least(floor(conf * 15), 14) AS bin, count(*) AS m, avg(conf) AS c, avg((pred = y)::INT) AS a FROM pr GROUP BY ALL), e AS (SELECT model, sum(m * abs(a - c)) / sum(m) AS ece FROM b GROUP BY model)
  SELECT o.model, n, round(accuracy, 9) AS accuracy, round(confident_rate, 9) AS confident_rate, round(confident_accuracy, 9) AS confident_accuracy, round(ba, 9) AS balanced_accuracy, round(mf, 9) AS macro_f1, round(ece, 9) AS ece FROM o JOIN f ON o.model = f.model JOIN e ON o.model = e.model""")
def f18_classification_metrics(spark, sf):
    x = C.classification_metrics(_logits(spark, sf), ["model"])
    return x.select("model", "n", *[r(c, 9).alias(c) for c in ("accuracy", "confident_rate", "confident_accuracy", "balanced_accuracy", "macro_f1", "ece")])


@query(f"WITH {_LOGIT} SELECT model, y, pred::INT AS pred, count(*) AS n FROM pr GROUP BY ALL")
def f18_confusion(spark, sf):
    return C.confusion(_logits(spark, sf), ["model"])


@query(f"WITH {_LOGIT} SELECT model, y, count(*) AS n, round(avg((pred = y)::INT), 9) AS recall FROM pr GROUP BY ALL")
def f18_class_recall(spark, sf):
    return C.class_recall(_logits(spark, sf), ["model"]).select("model", "y", "n", r("recall", 9).alias("recall"))


@query(f"""WITH {_LOGIT}, tg AS (SELECT unnest([{', '.join(repr(t) + '::DOUBLE' for t in C.temperature_grid())}]) AS t), nl AS (SELECT t, avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / t)))) + list_max(z) / t - z[y + 1] / t) AS nll FROM lg, tg GROUP BY t)
  SELECT round(arg_min(t, (round(nll, 12), t)), 9) AS temperature, round(min(nll), 9) AS nll FROM nl""")
def f19_fit_temperature(spark, sf):
    return C.fit_temperature(_logits(spark, sf)).select(r("temperature", 9).alias("temperature"), r("nll", 9).alias("nll"))


@query()
def f20_balanced_accuracy_interval(spark, sf):
    """No SQL: binomial draws. Tested against the same draws in NumPy."""
    return C.balanced_accuracy_interval(C.confusion(_logits(spark, sf), []))


@query("""SELECT c_nationkey, round(avg(CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END) - avg(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END), 6) AS gap FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey % 2) = 2""")
def f21_arm_gap(spark, sf):
    x = table(spark, sf, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 2).alias("arm")).agg(F.avg("c_acctbal").alias("v"))
    return C.arm_gap(x, ["c_nationkey"], "arm", "v", (0, 1)).select("c_nationkey", r("gap").alias("gap"))


@query("SELECT n_regionkey, count_if(c_mktsegment = 'BUILDING') AS building, count_if(c_mktsegment = 'MACHINERY') AS machinery FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def f21_site_class_counts(spark, sf):
    x = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    x = x.groupBy("n_regionkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.count("c_custkey")).na.fill(0)
    return x.select("n_regionkey", F.col("BUILDING").alias("building"), F.col("MACHINERY").alias("machinery"))


@query("""WITH e AS (SELECT label % 3 AS round, unnest(range(0, 64)) AS pos, embedding, 1 + vec_id % 4 AS w FROM embeddings) SELECT round, pos::INT AS pos, round(sum(w * embedding[pos + 1]::DOUBLE) / sum(w), 9) AS value FROM e GROUP BY ALL""")
def f22_fed_average(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("label") % 3).alias("round"), F.col("embedding").cast("array<double>").alias("params"), (1 + F.col("vec_id") % 4).alias("w"))
    return C.fed_average(e, ["round"], weight="w").select("round", "pos", r("value", 9).alias("value"))


_DOT = " + ".join(["w0", *(f"w{i} * x[{i}]" for i in range(1, 14))])
_STEP = ", ".join(f"w{i} - 0.5 * sum(e * {f'x[{i}]' if i else 1}) / count(*) AS w{i}" for i in range(14))
_MEAN = ", ".join(f"CASE WHEN it % 20 = 0 THEN sum(w{i} * n) OVER (PARTITION BY it) / sum(n) OVER (PARTITION BY it) ELSE w{i} END AS w{i}" for i in range(14))
_WS = ", ".join(f"w{i}" for i in range(14))


@query(f"""WITH RECURSIVE e AS (SELECT label % 3 AS site, list_transform(embedding[1:13], lambda v: v::DOUBLE) AS x, (label % 2)::DOUBLE AS y, vec_id % 5 = 0 AS test FROM embeddings),
  fit AS (SELECT site, 0 AS it, {", ".join(f"0.0::DOUBLE AS w{i}" for i in range(14))} FROM (SELECT DISTINCT site FROM e WHERE NOT test)
    UNION ALL SELECT site, it, {_MEAN} FROM (SELECT site, it + 1 AS it, count(*) AS n, {_STEP} FROM (SELECT f.*, x, 1 / (1 + exp(-({_DOT}))) - y AS e FROM fit f JOIN e ON f.site = e.site WHERE it < 60 AND NOT test) GROUP BY site, it, {_WS}))
  SELECT (it // 20)::INT AS round, count(*) AS n_test, round(avg(CASE WHEN (({_DOT}) > 0) = (y > 0) THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM (SELECT DISTINCT it, {_WS} FROM fit WHERE it % 20 = 0 AND site = (SELECT min(site) FROM e)), e WHERE test GROUP BY it""")
def f23_fed_logistic(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("label") % 3).alias("site"), F.slice("embedding", 1, 13).cast("array<double>").alias("x"), (F.col("label") % 2).alias("y"), (F.col("vec_id") % 5 == 0).alias("test"))
    return C.fed_logistic(e, 3).withColumn("accuracy", r("accuracy", 9))


@query(f"WITH {_FEAT} SELECT label, j, count(v) AS n, round(avg(v), 9) AS mean FROM feat GROUP BY label, j")
def f27_class_feature_means(spark, sf):
    return C.class_feature_means(geno(spark, sf), "label", "j", "v").select("label", "j", "n", r("mean", 9).alias("mean"))


@query()
def f27_panel_pca(spark, sf):
    """No SQL: an eigenproblem. Tested against NumPy."""
    return C.panel_pca(geno(spark, sf), "sample", "j", "v")[0]


@query("""WITH s AS (SELECT n_regionkey::VARCHAR AS site, count(*) AS n, avg(c_acctbal) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT site, n, round(bal, 6) AS bal FROM s UNION ALL SELECT 'total', sum(n)::BIGINT, round(sum(n * bal) / sum(n), 6) FROM s""")
def f28_site_cohorts(spark, sf):
    x = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("site")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("bal"))
    return C.with_total(x, "site", ["n"], {"bal": "n"}).select("site", "n", r("bal").alias("bal"))


@query("SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 6) AS f, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 6) AS o FROM orders GROUP BY 1")
def f28_round_table(spark, sf):
    x = C.round_table(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O"])
    return x.select("o_orderpriority", r("F").alias("f"), r("O").alias("o"))


# ---- data use

_CODES = [P.NO_METHODS, P.RESEARCH_TYPE, P.NON_COMMERCIAL, P.NON_PROFIT_ONLY, P.NON_PROFIT_NON_COMMERCIAL, P.PUBLICATION, P.COLLABORATION, P.ETHICS, P.GEOGRAPHY, P.MORATORIUM, P.TIME_LIMIT, P.USER, P.PROJECT, P.INSTITUTION, P.RETURN, P.GENETIC_ONLY, P.CLINICAL_CARE, P.NO_ANCESTRY, "DUO:0000001"]
_PERMISSIONS = [P.UNRESTRICTED, P.GENERAL, P.HEALTH, P.DISEASE, P.POPULATION, "none"]
_FLAGS = ["non_commercial", "not_for_profit_organisation", "publication_agreed", "collaboration_agreed", "moratorium_accepted", "return_to_resource_agreed"]
_FIELDS = ["geography", "requester", "project", "institution"]
_PURPOSES = [["DUO:0000038"], ["DUO:0000037", "DUO:0000038"], ["DUO:0000032"], ["DUO:0000038", "DUO:0000032"], ["DUO:0000031"], []]


def _profiles(spark, sf):
    """A part is a dataset with one permission and the modifiers that its key picks; values come in three kinds."""
    k = F.col("p_partkey")
    texts = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    kind = lambda i, a, b, c: F.when((k + i) % 3 == 0, a).when((k + i) % 3 == 1, b).otherwise(c)
    value = lambda i: kind(i, texts(), texts(" 2030-01-01 "), texts("31-12-2020")) if _CODES[i] == P.TIME_LIMIT else kind(i, texts(), texts("", "Alpha"), texts("beta", "gamma"))
    mods = F.array(*[F.when(k % (i + 5) == 0, F.struct(F.lit(c).alias("id"), value(i).alias("value"))) for i, c in enumerate(_CODES)])
    permission = F.element_at(texts(*_PERMISSIONS), (k % 6 + 1).cast("int"))
    return table(spark, sf, "part").select(k.alias("dataset_id"), permission.alias("permission"), texts("Asthma ").alias("permission_value"), F.array_compact(mods).alias("modifiers"))


def _requests(spark, sf):
    k = F.col("n_nationkey")
    own = F.col("request_id")
    field = lambda i: F.when((own + i) % 4 == 0, "alpha").when((own + i) % 4 == 1, "Beta").when((own + i) % 4 == 2, "")
    purposes = F.element_at(F.array(*[F.array(*[F.lit(p) for p in own]).cast("array<string>") for own in _PURPOSES]), (k % 6 + 1).cast("int"))
    some = F.when(k % 3 == 0, F.array(F.lit(P.RESEARCH_TYPE), F.lit(P.TIME_LIMIT), F.lit(P.INSTITUTION), F.lit(P.ETHICS)))
    x = table(spark, sf, "nation").select(k.alias("request_id"), F.when(k % 2 == 0, "asthma").when(k % 3 == 0, "gout").alias("disease"), F.when(k % 4 > 0, "yes").alias("ethics_approval"), purposes.alias("purposes"), some.alias("acknowledged"))
    return x.withColumns({**{f: field(i) for i, f in enumerate(_FIELDS)}, **{f: own % (i + 2) > 0 for i, f in enumerate(_FLAGS)}})


def _duo_sql() -> str:
    """The rules over (dataset, request, rule) rows, in plain SQL."""
    lists = lambda rows: ", ".join("[" + ", ".join(f"'{p}'" for p in own) + "]::VARCHAR[]" for own in rows)
    flags = ", ".join(f"n_nationkey % {i + 2} > 0 AS {f}" for i, f in enumerate(_FLAGS))
    fields = ", ".join(f"CASE (n_nationkey + {i}) % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE '' END AS {f}" for i, f in enumerate(_FIELDS))
    inside = lambda codes: f"len(pu) > 0 AND len(list_filter(pu, lambda x: x NOT IN ({', '.join(repr(c) for c in codes)}))) = 0"
    yes = lambda ok: f"CASE WHEN {ok} THEN 0 ELSE 2 END"
    among = "".join(f" WHEN id = '{c}' THEN CASE v WHEN 0 THEN 1 WHEN 1 THEN {yes(f + " = 'alpha'")} ELSE {yes(f + " = 'beta'")} END" for c, f in P.COMPARED.items())
    said = "".join(f" WHEN id = '{c}' THEN {yes(' AND '.join(own))}" for c, own in P.ATTESTED.items())
    ancestry = ", ".join(repr(c) for c in P.ANCESTRY)
    return f"""codes AS (SELECT unnest(range(0, {len(_CODES)})) AS i, unnest({[*_CODES]}) AS id),
rq AS (SELECT n_nationkey AS q, CASE WHEN n_nationkey % 2 = 0 THEN 'asthma' WHEN n_nationkey % 3 = 0 THEN 'gout' ELSE '' END AS disease, n_nationkey % 4 > 0 AS approved, [{lists(_PURPOSES)}][n_nationkey % 6 + 1] AS pu, n_nationkey % 3 = 0 AS ack, {fields}, {flags} FROM nation),
rules AS (SELECT p_partkey AS d, q, CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN {yes(inside(P.BIOMEDICAL))} WHEN 3 THEN {yes("disease = 'asthma'")} WHEN 4 THEN {yes(inside(P.ANCESTRY))} ELSE 2 END AS level FROM part, rq
  UNION ALL SELECT d, q, CASE WHEN level = 1 AND ack AND id IN ('{P.RESEARCH_TYPE}', '{P.TIME_LIMIT}', '{P.INSTITUTION}', '{P.ETHICS}') THEN 0 ELSE level END FROM (
    SELECT d, q, ack, id, CASE WHEN id = '{P.NO_METHODS}' THEN {yes(f"NOT list_contains(pu, '{P.METHODS}')")} WHEN id = '{P.GENETIC_ONLY}' THEN {yes(inside([P.GENETIC]))}
      WHEN id = '{P.NO_ANCESTRY}' THEN {yes(f"len(list_filter(pu, lambda x: x IN ({ancestry}))) = 0")} WHEN id = '{P.ETHICS}' THEN {yes("approved")}{said}{among}
      WHEN id = '{P.TIME_LIMIT}' THEN CASE v WHEN 1 THEN 0 ELSE 1 END WHEN id = '{P.CLINICAL_CARE}' THEN 0 ELSE 1 END AS level
    FROM (SELECT p_partkey AS d, id, (p_partkey + i) % 3 AS v FROM part, codes WHERE p_partkey % (i + 5) = 0) m, rq)),
dd AS (SELECT d AS dataset_id, q AS request_id, CASE max(level) WHEN 2 THEN 'denied' WHEN 1 THEN 'undetermined' ELSE 'permitted' END AS decision FROM rules GROUP BY d, q)"""


_DUO = _duo_sql()


@query(f"WITH {_DUO} SELECT dataset_id, request_id, decision FROM dd")
def k1_evaluate_data_use(spark, sf):
    return P.evaluate_data_use(_profiles(spark, sf), _requests(spark, sf), "2025-06-01").select("dataset_id", "request_id", "decision")


@query(f"WITH {_DUO} SELECT request_id, dataset_id, count(*) OVER (PARTITION BY request_id) AS n_blocking FROM dd WHERE decision <> 'permitted'")
def k2_blocking(spark, sf):
    return P.blocking(P.evaluate_data_use(_profiles(spark, sf), _requests(spark, sf), "2025-06-01"))


# ---- streams


def _beats(df):
    return df.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("site"), (~F.col("event_type").isin("error", "purchase")).alias("online"), F.when(F.col("event_type") == "error", "x").alias("error"), F.col("event_id"), F.col("value"))


def _stream(spark, sf, name="events"):
    t = table(spark, sf, name)
    return spark.readStream.schema(t.schema).parquet(f"{sf.rstrip('/')}/{name}.parquet*")


_BEAT = "bt AS (SELECT ts, user_id % 5 AS site, event_type NOT IN ('error', 'purchase') AS online, event_type = 'error' AS err, value, event_id FROM events)"


@query(f"""WITH {_BEAT} SELECT time_bucket(INTERVAL '1 hour', ts) AS start, site, count(*) AS n, count_if(online) AS up, CASE WHEN count_if(online) = count(*) THEN 'online' WHEN count_if(err) = count(*) THEN 'unknown' WHEN count_if(online) > 0 THEN 'degraded' ELSE 'offline' END AS status FROM bt GROUP BY ALL""")
def j1_site_status(spark, sf):
    out = ST.run_available(ST.site_status(_beats(_stream(spark, sf))), "j1_site_status", "complete")
    return out.select("start", "site", "n", "up", "status")


@query("SELECT user_id % 50 AS round, count(DISTINCT event_type)::INT AS sites, count(*) AS samples, round(max(value), 6) AS slowest, count(DISTINCT event_type) = 5 AS complete FROM events GROUP BY 1")
def j2_round_progress(spark, sf):
    e = _stream(spark, sf).select((F.col("user_id") % 50).alias("round"), F.col("event_type").alias("site"), F.lit(1).alias("num_samples"), F.col("value").alias("train_time_sec"))
    out = ST.run_available(ST.round_progress(e, 5), "j2_round_progress", "complete")
    return out.select("round", "sites", "samples", r("slowest").alias("slowest"), "complete")


@query(f"WITH {_BEAT} SELECT site AS k, round(sum(value), 4) AS value, count(*) AS n_blocks FROM bt GROUP BY 1")
def j3_stream_pool(spark, sf):
    e = _beats(_stream(spark, sf)).withColumn("k", F.col("site")).withColumn("block", F.col("event_id"))
    e = e.unionByName(e)  # each block comes twice
    out = ST.run_available(ST.stream_pool(e, ["k"], "value"), "j3_stream_pool", "complete")
    return out.select("k", r("value", 4).alias("value"), "n_blocks")


@query("SELECT user_id % 50 AS round, count(DISTINCT event_type)::INT AS sites, count(*) AS samples, round(max(value), 6) AS slowest, count(DISTINCT event_type) = 5 AS complete FROM events GROUP BY 1")
def j2_round_progress_updates(spark, sf):
    e = _stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 50).alias("round"), F.col("event_type").alias("site"), F.lit(1).alias("num_samples"), F.col("value").alias("train_time_sec"))
    parts, _ = ST.run_keyed(ST.round_parts(e, "1 day", "30 days"), "j2_round_progress_updates", ["start", "round"])
    return ST.rounds_of(parts, 5).select("round", "sites", "samples", r("slowest").alias("slowest"), "complete")


@query(f"WITH {_BEAT} SELECT site AS k, round(sum(value), 4) AS value, count(*) AS n_blocks FROM bt GROUP BY 1")
def j3_stream_pool_updates(spark, sf):
    e = _beats(_stream(spark, sf)).withColumn("k", F.col("site")).withColumn("block", F.col("event_id"))
    parts, _ = ST.run_keyed(ST.pool_parts(e.unionByName(e), ["k"], "value", "1 day", "30 days"), "j3_stream_pool_updates", ["start", "k"])
    return ST.pool_of(parts, ["k"], "value").select("k", r("value", 4).alias("value"), "n_blocks")
