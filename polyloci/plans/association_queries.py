"""Queries of the association family (B, C6, D1, E1-E9, H1-H3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.sweep import SINGULAR
from ..operators import association as A
from .bindings import ASSOC, GENO, assoc, geno, query, r, table

#: About the mean price: taken from y once, for the whole study.
SHIFT = 35000.0

def _taken_out(source: str, terms: int, pairs: dict[str, tuple[str, str]]) -> str:
    """Rows of `source` with their first terms taken out one by one, as one that is explained by those before it takes out
    nothing. h{i}{j}: sums of products of the terms; a letter and i: those of a term with what is kept; pairs: sums of what
    is kept, by two of these letters."""
    letters = sorted({x for p in pairs.values() for x in p})
    sql = f"SELECT *, {', '.join(f'h{k}{k} AS own{k}' for k in range(terms))} FROM {source}"
    for k in range(terms):
        less = lambda out, x, y: f"CASE WHEN h{k}{k} > {SINGULAR}::DOUBLE * own{k} THEN {out} - {x} * {y} / h{k}{k} ELSE {out} END AS {out}"  # noqa: B023, E731
        new = [less(out, f"{x}{k}", f"{y}{k}") for out, (x, y) in pairs.items()]
        for i in range(k + 1, terms):
            new += [less(f"{x}{i}", f"h{k}{i}", f"{x}{k}") for x in letters] + [less(f"h{i}{j}", f"h{k}{i}", f"h{k}{j}") for j in range(i, terms)]
        sql = f"SELECT * REPLACE ({', '.join(new)}) FROM ({sql})"
    return sql


# Three covariates, of which the third is constant at each site.
_SUMS = ", ".join([*(f"sum(c{i} * c{j}) AS h{i}{j}" for i in range(4) for j in range(i, 4)), *(f"sum(g * c{i}) AS a{i}, sum(y * c{i}) AS d{i}" for i in range(4))])
LINEAR = f"""{ASSOC}, x AS (SELECT site, variant, dosage::DOUBLE AS g, y - {SHIFT} AS y, 1.0::DOUBLE AS c0, c1, c2, site::DOUBLE AS c3 FROM assoc),
m AS (SELECT site, variant, count(*) AS n, sum(g * g) AS gg, sum(g * y) AS gy, sum(y * y) AS yy, {_SUMS} FROM x GROUP BY site, variant),
t AS ({_taken_out("m", 4, {"gg": ("a", "a"), "gy": ("a", "d"), "yy": ("d", "d")})}),
lin AS (SELECT site, variant, n, CASE WHEN gg > 1e-9 THEN gy / gg END AS beta, CASE WHEN n > 5 AND gg > 1e-9 THEN sqrt(greatest(yy - gy * gy / gg, 0) / (n - 5) / gg) END AS se, n - 5 AS dof FROM t)"""


def _linear(spark, sf):
    return A.gwas_linear(assoc(spark, sf).withColumn("c3", F.col("site")), covs=("c1", "c2", "c3"), y_shift=SHIFT)


@query(f"""WITH {LINEAR}, meta AS (SELECT variant, count(*) AS n_sites, sum(beta / (se * se)) / sum(1 / (se * se)) AS beta, sqrt(1 / sum(1 / (se * se))) AS se FROM lin WHERE se > 0 GROUP BY variant),
  k AS (SELECT *, beta / se AS stat, row_number() OVER (ORDER BY round(abs(beta / se), 6) DESC, variant) AS rank FROM meta)
  SELECT variant, n_sites, round(beta, 4) AS beta, round(se, 4) AS se, round(stat, 5) AS stat, rank::INT AS rank FROM k WHERE rank <= 100""")
def gwas_meta_hits(spark, sf):
    """The flagship: per-site linear association, inverse-variance pooling, the strongest variants."""
    m = A.meta_ivw(_linear(spark, sf), ["variant"])
    m = m.withColumn("order", -F.round(F.abs("stat"), 6)).withColumn("trait", F.lit(1))
    top = A.hits_table(m, -1e9, 100, ["trait"], ["variant"], p="order")
    return top.select("variant", "n_sites", r("beta", 4).alias("beta"), r("se", 4).alias("se"), r("stat", 5).alias("stat"), "rank")


@query(f"WITH {LINEAR} SELECT site, variant, n, round(beta, 4) AS beta, round(se, 4) AS se, round(coalesce(CASE WHEN se <> 0 THEN beta / se END, 0), 5) AS stat, dof FROM lin")
def e2_gwas_linear(spark, sf):
    return _linear(spark, sf).select("site", "variant", "n", r("beta", 4).alias("beta"), r("se", 4).alias("se"), r("stat", 5).alias("stat"), "dof")


@query(f"""WITH {LINEAR} SELECT variant, count_if(se > 0) AS n_sites, round(sum(CASE WHEN se > 0 THEN beta / (se * se) END) / sum(CASE WHEN se > 0 THEN 1 / (se * se) END), 4) AS beta, round(sqrt(1 / sum(CASE WHEN se > 0 THEN 1 / (se * se) END)), 4) AS se FROM lin GROUP BY variant""")
def e5_meta_ivw(spark, sf):
    return A.meta_ivw(_linear(spark, sf), ["variant"]).select("variant", "n_sites", r("beta", 4).alias("beta"), r("se", 4).alias("se"))


@query(f"""WITH {GENO} SELECT site, j, locus, count(*) AS n, count_if(missing) AS n_missing, round(least(avg(CASE WHEN NOT missing THEN dosage END) / 2, 1 - avg(CASE WHEN NOT missing THEN dosage END) / 2), 8) AS maf,
  round(sum(CASE WHEN NOT missing THEN dosage::DOUBLE ELSE m END), 6) AS total FROM (SELECT *, avg(CASE WHEN NOT missing THEN dosage END) OVER (PARTITION BY site, j) AS m FROM geno) GROUP BY site, j, locus""")
def e1_impute_dosage(spark, sf):
    g = geno(spark, sf).withColumn("dosage", F.when(~F.col("missing"), F.col("dosage")))
    x = A.impute_dosage(g, ["site", "j"])
    return x.groupBy("site", "j", "locus").agg(F.count("*").alias("n"), F.count_if("missing").alias("n_missing"), r(F.first("maf"), 8).alias("maf"), r(F.sum("dosage_imputed")).alias("total"))


# The error function by its series exp(-x^2) sum x^(2n + 1) / gamma(n + 3/2), whose terms are positive; for x up to 6 or so.
_TWO_SIDED = "CASE WHEN {0} = 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 200), lambda n: exp(-{0} * {0} / 2 + (2 * n + 1) * ln(abs({0}) / sqrt(2.0::DOUBLE)) - lgamma(n + 1.5)))) END"
_COFACTORS = """{0}11 * {0}22 - {0}12 * {0}12 AS c00, {0}02 * {0}12 - {0}01 * {0}22 AS c01, {0}01 * {0}12 - {0}02 * {0}11 AS c02, {0}00 * {0}22 - {0}02 * {0}02 AS c11, {0}01 * {0}02 - {0}00 * {0}12 AS c12,
  {0}00 * {0}11 - {0}01 * {0}01 AS c22, {0}00 * ({0}11 * {0}22 - {0}12 * {0}12) + {0}01 * ({0}02 * {0}12 - {0}01 * {0}22) + {0}02 * ({0}01 * {0}12 - {0}02 * {0}11) AS det"""
_MU = "greatest(least(1 / (1 + exp(-(b0 + b1 * {0}.c1 + b2 * {0}.c2))), 1 - 1e-8::DOUBLE), 1e-8::DOUBLE) AS mu"
_WEIGHTED = "sum(w) AS h00, sum(w * c1) AS h01, sum(w * c2) AS h02, sum(w * c1 * c1) AS h11, sum(w * c1 * c2) AS h12, sum(w * c2 * c2) AS h22"

# Newton's method by twelve steps, which is more than it takes.
NEWTON = f"""{ASSOC}, same AS (SELECT site, c1, c2, count(*) AS n, sum(CASE WHEN is_case THEN 1.0::DOUBLE ELSE 0 END) AS y FROM assoc GROUP BY ALL),
fit AS (SELECT site, 0 AS it, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM (SELECT DISTINCT site FROM same)
  UNION ALL SELECT site, it + 1, b0 + (c00 * s0 + c01 * s1 + c02 * s2) / det, b1 + (c01 * s0 + c11 * s1 + c12 * s2) / det, b2 + (c02 * s0 + c12 * s1 + c22 * s2) / det
  FROM (SELECT *, {_COFACTORS.format("h")} FROM (SELECT site, it, b0, b1, b2, sum(e) AS s0, sum(e * c1) AS s1, sum(e * c2) AS s2, {_WEIGHTED}
    FROM (SELECT *, y - n * mu AS e, n * mu * (1 - mu) AS w FROM (SELECT f.*, s.c1, s.c2, s.n, s.y, {_MU.format("s")} FROM fit f JOIN same s ON f.site = s.site WHERE it < 12)) GROUP BY site, it, b0, b1, b2))),
sums AS (SELECT site, variant, count(*) AS n, sum(w * g * g) AS gg, sum(g * r) AS gr, sum(w * g) AS a0, sum(w * g * c1) AS a1, sum(w * g * c2) AS a2, sum(r) AS d0, sum(r * c1) AS d1, sum(r * c2) AS d2, {_WEIGHTED}
    FROM (SELECT site, variant, g, c1, c2, y - mu AS r, mu * (1 - mu) AS w FROM (SELECT a.site, variant, dosage::DOUBLE AS g, c1, c2, CASE WHEN is_case THEN 1.0::DOUBLE ELSE 0 END AS y, {_MU.format("a")} FROM assoc a JOIN fit ON a.site = fit.site AND it = 12)) GROUP BY site, variant)"""


@query(f"""WITH RECURSIVE {NEWTON}, sc AS (SELECT site, variant, n, gr AS u, CASE WHEN gg > 1e-9 THEN gg END AS info, coalesce(CASE WHEN gg > 1e-9 THEN gr / sqrt(gg) END, 0) AS z FROM ({_taken_out("sums", 3, {"gg": ("a", "a"), "gr": ("a", "d")})}))
  SELECT site, variant, n, round(u / info, 6) + 0 AS beta, round(1 / sqrt(info), 6) AS se, round(z, 6) + 0 AS stat, CASE WHEN info IS NOT NULL THEN round(exp(greatest(least(u / info, 50), -50)), 6) END AS odds_ratio, round({_TWO_SIDED.format("z")}, 6) AS p FROM sc""")
def e3_e4_logistic_score(spark, sf):
    df = assoc(spark, sf).withColumnRenamed("is_case", "case")
    out = A.gwas_score(A.null_mean(df, A.fit_null(df)))
    return out.withColumn("p", S.p_chi2(F.col("stat") * F.col("stat"))).select("site", "variant", "n", *[r(c).alias(c) for c in ("beta", "se", "stat", "odds_ratio", "p")])


@query(f"""WITH {ASSOC} SELECT site, round(sum(y * c1) / sum(c1), 4) AS mean, round(sum(c1), 2) AS total_weight FROM assoc GROUP BY site""")
def e6_weighted_mean(spark, sf):
    return A.weighted_mean(assoc(spark, sf), "y", "c1", ["site"]).select("site", r("mean", 4).alias("mean"), r("total_weight", 2).alias("total_weight"))


@query(f"""WITH {ASSOC}, p AS (SELECT site, greatest(c2 / 1000, 1e-9) AS p FROM assoc) SELECT site, count_if(p < 0.00005) AS n_hits, round(max(-log10(p)), 6) AS max_neglog10_p FROM p GROUP BY site""")
def e7_hit_summary(spark, sf):
    x = assoc(spark, sf).withColumn("p", F.greatest(F.col("c2") / 1000, F.lit(1e-9)))
    return A.hit_summary(x, 0.00005, ["site"]).select("site", "n_hits", r("max_neglog10_p").alias("max_neglog10_p"))


_PGS = f"""{GENO}, w AS (SELECT j, ((j % 7) - 3)::DOUBLE AS weight, j % 2 = 0 AS flip FROM range(1, 61) t(j) WHERE j % 7 <> 3),
d AS (SELECT sample, site, label, y, g.j, weight, flip, CASE WHEN missing THEN avg(CASE WHEN NOT missing THEN dosage END) OVER (PARTITION BY g.j) ELSE dosage END AS d FROM geno g JOIN w ON g.j = w.j),
pgs AS (SELECT sample, label, y, sum(weight * CASE WHEN flip THEN 2 - d ELSE d END) AS raw FROM d GROUP BY sample, label, y)"""


def _pgs(spark, sf):
    g = geno(spark, sf).withColumn("dosage", F.when(~F.col("missing"), F.col("dosage"))).withColumnRenamed("j", "variant")
    w = g.select("variant").distinct().select("variant", ((F.col("variant") % 7) - 3).cast("double").alias("weight"), (F.col("variant") % 2 == 0).alias("flip"))
    return A.polygenic_score(g, w, ["sample", "label", "y"])


@query(f"WITH {_PGS} SELECT sample, round(raw, 6) AS raw, round((raw - avg(raw) OVER (PARTITION BY label)) / stddev_pop(raw) OVER (PARTITION BY label), 6) AS z FROM pgs")
def e8_b11_polygenic_score(spark, sf):
    x = S.zscore(_pgs(spark, sf), "raw", ["label"], "z", strict=True)
    return x.select("sample", r("raw").alias("raw"), r("z").alias("z"))


@query(f"WITH {_PGS} SELECT label, count(*) AS n, round(regr_r2(y, raw), 6) AS r2 FROM pgs GROUP BY label")
def e9_r_squared(spark, sf):
    return A.r_squared(_pgs(spark, sf), "raw", "y", ["label"]).select("label", "n", r("r2").alias("r2"))


@query(f"""WITH {_PGS}, x AS (SELECT label, y, raw AS g, (sample % 11)::DOUBLE AS a, (sample % 7)::DOUBLE AS b FROM pgs),
  m AS (SELECT label, y - avg(y) OVER w AS y, g - avg(g) OVER w AS g, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM x WINDOW w AS (PARTITION BY label)),
  k AS (SELECT label, y AS y0, b - a * sum(a * b) OVER w / sum(a * a) OVER w AS b, g - a * sum(a * g) OVER w / sum(a * a) OVER w AS g, y - a * sum(a * y) OVER w / sum(a * a) OVER w AS y FROM m WINDOW w AS (PARTITION BY label)),
  t AS (SELECT label, y0, g - b * sum(b * g) OVER w / sum(b * b) OVER w AS g, y - b * sum(b * y) OVER w / sum(b * b) OVER w AS y FROM k WINDOW w AS (PARTITION BY label))
  SELECT label, count(*) AS n, round(1 - (sum(y * y) - sum(g * y) * sum(g * y) / sum(g * g)) / sum(y0 * y0), 6) AS r2 FROM t GROUP BY label""")
def e9_r_squared_given(spark, sf):
    x = _pgs(spark, sf).withColumn("c1", F.col("sample") % 11).withColumn("c2", F.col("sample") % 7)
    return A.r_squared_given(x, "raw", ("c1", "c2"), "y", ["label"]).select("label", "n", r("r2").alias("r2"))


@query()
def e9_auroc_given(spark, sf):
    """No SQL: the logistic fit is iterative. Tested against Newton's method in NumPy."""
    x = assoc(spark, sf).withColumn("score", F.col("y") / 10_000)
    return A.auroc_given(x, "score", ("c1", "c2"), "is_case", "site")


@query(f"""WITH {ASSOC}, a AS (SELECT site, c1, is_case, count(*) AS k FROM assoc GROUP BY ALL)
  SELECT p.site, round(sum(p.k * n.k * CASE WHEN p.c1 > n.c1 THEN 1.0 WHEN p.c1 = n.c1 THEN 0.5 ELSE 0 END) / sum(p.k * n.k), 9)::DOUBLE AS auroc
  FROM (SELECT * FROM a WHERE is_case) p JOIN (SELECT * FROM a WHERE NOT is_case) n ON p.site = n.site GROUP BY p.site""")
def e9_auroc(spark, sf):
    return A.auroc(assoc(spark, sf), "c1", "is_case", ["site"]).select("site", r("auroc", 9).alias("auroc"))


@query(f"""WITH {ASSOC}, p AS (SELECT site, variant, min(c2 + c1 / 1000) AS p FROM assoc GROUP BY site, variant), k AS (SELECT *, count_if(p < 0.0011) OVER (PARTITION BY site) AS h, row_number() OVER (PARTITION BY site ORDER BY p, variant) AS rank FROM p)
  SELECT site, variant, round(p, 9) AS p, rank::INT AS rank, CASE WHEN h > 0 THEN 'significant' ELSE 'top' END AS hit_set FROM k WHERE (h > 0 AND p < 0.0011) OR (h = 0 AND rank <= 20)""")
def h1_hits_table(spark, sf):
    p = assoc(spark, sf).groupBy("site", "variant").agg(F.min(F.col("c2") + F.col("c1") / 1000).alias("p"))
    return A.hits_table(p, 0.0011, 20, ["site"], ["variant"]).select("site", "variant", r("p", 9).alias("p"), "rank", "hit_set")


_MAN = "v AS (SELECT l_orderkey * 10 + l_linenumber AS variant, (l_suppkey % 5)::INT AS chrom, l_partkey * 1000 AS bp FROM lineitem)"


@query(f"""WITH {_MAN}, e AS (SELECT chrom, max(bp) AS hi FROM v GROUP BY chrom), s AS (SELECT chrom, hi, coalesce(sum(hi + 1000000) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM e)
  SELECT variant, v.chrom, st + bp AS x, st + hi / 2 AS tick FROM v JOIN s ON v.chrom = s.chrom""")
def h2_manhattan(spark, sf):
    v = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("variant"), (F.col("l_suppkey") % 5).cast("int").alias("chrom"), (F.col("l_partkey") * 1000).alias("bp"))
    return A.manhattan_points(v).select("variant", "chrom", "x", "tick")


@query(f"""WITH {ASSOC}, p AS (SELECT site, variant, avg(c2) AS p FROM assoc GROUP BY site, variant), k AS (SELECT site, variant, round(p, 9) AS p, row_number() OVER (PARTITION BY site ORDER BY round(p, 9), variant) AS rank, count(*) OVER (PARTITION BY site) AS n FROM p)
  SELECT site, variant, rank::INT AS rank, round(-log10((rank - 0.5) / n), 9) AS expected, round(-log10(greatest(p, 2.2250738585072014e-308)), 6) AS observed FROM k WHERE rank <= 50""")
def h3_qq_points(spark, sf):
    p = assoc(spark, sf).groupBy("site", "variant").agg(r(F.avg("c2"), 9).alias("p"))
    return A.qq_points(p, 50, by=["site"], order=["variant"]).select("site", "variant", "rank", r("expected", 9).alias("expected"), r("observed").alias("observed"))


@query("""SELECT c_custkey, c_acctbal, o_n, (c_custkey % 5 <> 0) AS has_cov FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS o_n FROM orders GROUP BY o_custkey HAVING count(*) > 0) ON c_custkey = o_custkey WHERE o_n IS NOT NULL""")
def d1_assemble_samples(spark, sf):
    c = table(spark, sf, "customer")
    fam = c.select(F.col("c_custkey").alias("iid"))
    pheno = c.select(F.col("c_custkey").alias("iid"), "c_acctbal")
    ev = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("iid")).agg(F.count("*").alias("o_n"))
    cov = c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("iid"), F.lit(True).alias("cov"))
    x = A.assemble_samples(fam, pheno, ev, cov, ["iid"]).filter("o_n IS NOT NULL")
    return x.select(F.col("iid").alias("c_custkey"), "c_acctbal", "o_n", F.coalesce("cov", F.lit(False)).alias("has_cov"))


@query("""SELECT 'o_n' AS "column", count_if(o_n IS NULL) AS n_missing FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS o_n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
  UNION ALL SELECT 'c_acctbal', count_if(c_acctbal IS NULL) FROM customer""")
def d1_missing_by_column(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("o_n"))
    return A.missing_by_column(table(spark, sf, "customer").join(o, "c_custkey", "left"), ["o_n", "c_acctbal"])


@query("""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 23 WHEN 'A' THEN 24 ELSE 7 END AS chrom, (CASE l_returnflag WHEN 'R' THEN 23 WHEN 'A' THEN 24 ELSE 7 END) || ':' || l_partkey AS key,
  round(CASE WHEN l_tax > 0 THEN l_discount / l_tax ELSE -1 END, 9) AS ratio, round(-log10(greatest(l_discount, 2.2250738585072014e-308)), 6) AS nlp,
  round(exp(greatest(least((l_discount - 0.05) * 10, 50), -50)), 9) AS odds, round(least(l_discount * 10, 1 - l_discount * 10), 9) AS maf, CASE WHEN l_linestatus = 'O' THEN 2 - l_linenumber % 3 ELSE l_linenumber % 3 END AS d FROM lineitem""")
def b1_b2_b5_b7_b8_b9_b10_scalars(spark, sf):
    li = table(spark, sf, "lineitem")
    chrom = S.normalize_chr(F.when(F.col("l_returnflag") == "R", " x ").when(F.col("l_returnflag") == "A", "chrY").otherwise("7"))
    return li.select(
        "l_orderkey", "l_linenumber", chrom.alias("chrom"), S.chr_pos(chrom, F.col("l_partkey")).alias("key"), r(S.safe_div(F.col("l_discount"), F.col("l_tax"), F.lit(-1.0)), 9).alias("ratio"),
        r(S.neglog10(F.col("l_discount"))).alias("nlp"), r(S.odds_ratio((F.col("l_discount") - 0.05) * 10), 9).alias("odds"), r(S.maf(F.col("l_discount") * 10), 9).alias("maf"),
        S.flip_dosage(F.col("l_linenumber") % 3, F.col("l_linestatus") == "O").alias("d"),
    )


@query("""SELECT o_orderkey, (1 + o_orderkey % 5)::INT AS ncsl, (o_custkey % 9 + 1) / 1000.0::DOUBLE AS h2, (o_orderkey % 11) / 10.0::DOUBLE AS rg, 'L' || o_custkey AS locus_id, (o_orderkey % 100)::INT AS replicate FROM orders""")
def b3_b4_parse_ids(spark, sf):
    o = table(spark, sf, "orders")
    arch = F.concat(F.lit("ncsl"), (1 + F.col("o_orderkey") % 5).cast("string"), F.lit("_h2-"), ((F.col("o_custkey") % 9 + 1) / 1000.0).cast("string"), F.lit("_rg"), ((F.col("o_orderkey") % 11) / 10.0).cast("string"))
    x = o.select("o_orderkey", F.concat(F.lit("L"), "o_custkey", F.lit("_"), arch, F.lit("_rep"), F.col("o_orderkey") % 100).alias("instance"))
    return S.parse_architecture(S.split_instance(x)).select("o_orderkey", "ncsl", "h2", "rg", "locus_id", "replicate")


# Student's tail by the series of the incomplete beta function at t^2 / (df + t^2), whose terms are positive.
@query(f"""WITH x AS (SELECT DISTINCT l_discount, l_quantity, round((l_discount - 0.05) * 100, 6) AS z, l_quantity + 1.0::DOUBLE AS df FROM lineitem), y AS (SELECT *, z * z / (df + z * z) AS y FROM x),
  p AS (SELECT *, {_TWO_SIDED.format("z")} AS pn, CASE WHEN z = 0 THEN 1.0 ELSE 1 - exp(0.5 * ln(y) + df / 2 * ln(1 - y) + lgamma(df / 2 + 0.5) - lgamma(0.5) - lgamma(df / 2)) * 2 * list_sum(list_transform(range(0, 1500), lambda n: exp(lgamma(df / 2 + 0.5 + n) + lgamma(1.5) - lgamma(df / 2 + 0.5) - lgamma(1.5 + n) + n * ln(y)))) END AS pt FROM y)
  SELECT l_orderkey, l_linenumber, round(pn, 8) AS p_norm, round(pt, 8) AS p_t, round(pn, 8) AS p_chi2 FROM lineitem l JOIN p ON l.l_discount = p.l_discount AND l.l_quantity = p.l_quantity""")
def b6_tail_probabilities(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("z", F.round((F.col("l_discount") - 0.05) * 100, 6)).withColumn("df", F.col("l_quantity") + 1)
    return x.select("l_orderkey", "l_linenumber", r(S.p_norm(F.col("z")), 8).alias("p_norm"), r(S.p_t(F.col("z"), F.col("df")), 8).alias("p_t"), r(S.p_chi2(F.col("z") * F.col("z")), 8).alias("p_chi2"))


@query("""SELECT count(*) AS n_rows, count_if(NOT (v >= 0 AND v <= 1)) AS n_out_of_range, count_if(trim(t) = '') AS n_blank, (count(*) - count(DISTINCT (s, t)))::BIGINT AS n_duplicate
  FROM (SELECT value / 100 AS v, user_id AS s, event_type AS t FROM events)""")
def b12_validate_betas(spark, sf):
    e = table(spark, sf, "events").select((F.col("value") / 100).alias("beta"), F.col("user_id").alias("sample_id"), F.col("event_type").alias("cpg_id"))
    return S.validate_betas(e)


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS c, CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 4 END AS k, (o_orderkey % 101) / 100.0::DOUBLE AS p, CASE WHEN o_orderkey % 13 = 0 THEN 'x' END AS e, o_custkey % 3 > 0 AS v FROM orders)
  SELECT o_orderkey, coalesce(c, FALSE) AS captured, coalesce(k > 0, FALSE) AS returned_cs, e IS NOT NULL AS failed, p > 0.5 AS pip50, p > 0.95 AS pip95, e IS NULL AND NOT v AS nonconverged, coalesce(k = 1, FALSE) AS single_cs FROM x""")
def b13_outcome_flags(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("any_causal_captured"), F.when(c % 7 > 0, c % 4).alias("n_credible_sets"),
        (k % 101 / 100.0).alias("causal_pip_max"), F.when(k % 13 == 0, "x").alias("error"), (c % 3 > 0).alias("converged"),
    )
    return S.outcome_flags(x).select("o_orderkey", "captured", "returned_cs", "failed", "pip50", "pip95", "nonconverged", "single_cs")


@query("""SELECT o_orderkey, o_custkey / 4.0::DOUBLE AS beta_EUR, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 7)::DOUBLE END AS beta_AFR, NULL::DOUBLE AS beta_CSA FROM orders""")
def b14_split_per_pop(spark, sf):
    text = F.concat((F.col("o_custkey") / 4.0).cast("string"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(","), F.col("o_orderkey") % 7)).otherwise(",NA"))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("b")).withColumns(S.split_per_pop("b", ["EUR", "AFR", "CSA"], "beta")).drop("b")


@query("""SELECT o_orderkey, 's' || k AS site, p::INT AS position, ((o_orderkey + k + p) % 50) / 100.0::DOUBLE AS maf FROM orders, range(0, 2) a(k), range(0, 2) b(p)""")
def b15_explode_site_maf(spark, sf):
    num = lambda k, p: ((F.col("o_orderkey") + k + p) % 50 / 100.0).cast("string")
    js = F.concat(F.lit('{"s0": ['), num(0, 0), F.lit(","), num(0, 1), F.lit('], "s1": ['), num(1, 0), F.lit(","), num(1, 1), F.lit("]}"))
    return S.explode_site_maf(table(spark, sf, "orders").select("o_orderkey", js.alias("per_site_mafs_json"))).select("o_orderkey", "site", "position", "maf")


@query("""SELECT o_orderkey, 'a' AS site, o_totalprice AS h2 FROM orders UNION ALL SELECT o_orderkey, 'b', o_totalprice / 2 FROM orders""")
def b16_melt_h2(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("empirical_h2_a"), (F.col("o_totalprice") / 2).alias("empirical_h2_b"))
    return S.melt(o, ["o_orderkey"], "empirical_h2_", "site", "h2")
