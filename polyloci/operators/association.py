"""Per-site association tests, meta-analysis, polygenic scores and what is shown of them.

A site is a grouping column. Tests are moments: one aggregation of sums of products per (site, variant), from which
covariates are swept in batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.lineage import cut
from ..functions.ranks import running_within
from ..functions.rounds import by_group, codes, gathered, in_rounds, summed
from ..functions.scalars import TINY, neglog10, odds_ratio, safe_div
from ..functions.sweep import least_squares

#: Sites up to this number have their covariate sums joined by broadcast.
BROADCAST_SITES = 10_000


def side(df: DataFrame, most: int = BROADCAST_SITES) -> DataFrame:
    """df for a broadcast join, if it has few rows; otherwise Spark chooses the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def check_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def assemble_samples(fam: DataFrame, pheno: DataFrame, evaluation: DataFrame, cov: DataFrame, key: list[str]) -> DataFrame:
    """Fam left-joined one-to-one with two phenotype tables and covariates; an error names a table with repeated keys."""
    for name, df in (("fam", fam), ("pheno", pheno), ("evaluation", evaluation), ("cov", cov)):
        if not check_unique(df, key).isEmpty():
            raise ValueError(f"{name}: keys {key} are not unique")
    return fam.join(pheno, key, "left").join(evaluation, key, "left").join(cov, key, "left")


def missing_by_column(df: DataFrame, cols: list[str]) -> DataFrame:
    """How many rows lack a value, by column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], cols, "column", "n_missing")


def impute_dosage(df: DataFrame, by: list[str], dosage: str = "dosage") -> DataFrame:
    """Adds dosage_imputed (the group's mean where missing) and maf of the observed calls."""
    means = df.groupBy(*by).agg(F.avg(dosage).alias("__mean"))
    out = df.join(means, by)
    af = F.col("__mean") / 2
    return out.withColumn("dosage_imputed", F.coalesce(F.col(dosage).cast("double"), F.col("__mean"))).withColumn("maf", F.least(af, 1 - af)).drop("__mean")


def gwas_linear(df: DataFrame, site: str = "site", variant: str = "variant", g: str = "dosage", y: str = "y", covs: Sequence[str] = ("c1", "c2"), y_shift: float = 0.0) -> DataFrame:
    """Linear association of y with each variant's dosage at each site, given an intercept and any number of covariates.

    Columns: site, variant, n, beta, se, stat, dof. Dosages must be imputed. Rows without y, dosage or covariates are left
    out. A covariate that others explain at a site, as one that is constant there, changes nothing but dof, which counts all
    of them. A variant without variance left has null beta and se and stat 0. y_shift, one constant for the whole study, is
    taken from y first: it cancels exactly and keeps digits.
    """
    m = least_squares(df, [site, variant], [F.col(c) for c in covs], F.col(g), F.col(y).cast("double") - y_shift)
    xx = F.when(F.col("xx") > 1e-9, F.col("xx"))
    m = m.withColumn("dof", F.col("n") - len(covs) - 2).withColumn("beta", F.col("xy") / xx)
    rss = F.greatest(F.col("yy") - F.col("xy") * F.col("xy") / xx, F.lit(0.0))
    m = m.withColumn("se", F.when(F.col("dof") > 0, F.sqrt(safe_div(rss, F.col("dof").cast("double")) / xx)))
    return m.select(site, variant, "n", "beta", "se", F.coalesce(safe_div(F.col("beta"), F.col("se"), F.lit(0.0)), F.lit(0.0)).alias("stat"), "dof")


def fit_null(df: DataFrame, site: str = "site", case: str = "case", covs: Sequence[str] = ("c1", "c2"), iterations: int = 25, tol: float = 1e-8, tasks: int | None = None) -> DataFrame:
    """E3 (action): covariate-only logistic model of each site by iteratively reweighted least squares.

    Rows of equal covariates are counted once. All iterations are one stage: its tasks keep their rows on disk, and exchange each site's
    small normal equations in every iteration. A covariate that others explain has the smallest coefficients that fit. Rows
    that lack a value are left out. Returns (site, b0, b1, ..).
    """
    k, s = len(covs) + 1, F.col(site)
    x = df.select(s.alias("__site"), F.col(case).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(covs)]).dropna()
    x = x.groupBy("__site", *[f"c{i}" for i in range(k - 1)]).agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("y"))
    upper = np.triu_indices(k)

    def work(rows):
        sites = sorted(set().union(*gathered({v for b in rows for v in b.column("__site").unique().to_pylist()})))
        at = {v: i for i, v in enumerate(sites)}
        beta = np.zeros((len(sites), k))

        def equations(b):
            of, n, y = codes(b.column("__site"), at), b.column("n").to_numpy(), b.column("y").to_numpy()
            c = np.column_stack([np.ones(len(n)), *[b.column(f"c{i}").to_numpy() for i in range(k - 1)]])
            mu = np.clip(1 / (1 + np.exp(-np.einsum("ij,ij->i", c, beta[of]))), 1e-8, 1 - 1e-8)
            w = n * mu * (1 - mu)
            return by_group(of, len(sites), np.hstack([c * (y - n * mu)[:, None], c[:, upper[0]] * c[:, upper[1]] * w[:, None]]))

        for _ in range(iterations):
            sums = summed(sum(map(equations, rows), np.zeros((len(sites), k + len(upper[0])))))
            moved = 0.0
            for i in range(len(sites)):
                h = np.zeros((k, k))
                h[upper] = sums[i, k:]
                step = np.linalg.lstsq(h + np.triu(h, 1).T, sums[i, :k], rcond=None)[0]
                beta[i] += step
                moved = max(moved, float(np.abs(step).max()))
            if moved < tol:
                break
        yield from ((v, *beta[i].tolist()) for i, v in enumerate(sites))

    schema = T.StructType([T.StructField(site, df.schema[site].dataType), *[T.StructField(f"b{i}", T.DoubleType()) for i in range(k)]])
    return in_rounds(x, work, schema, tasks)


def null_mean(df: DataFrame, null: DataFrame, site: str = "site", covs: tuple[str, ...] = ("c1", "c2")) -> DataFrame:
    """df with mu of its site's null model, within [1e-8, 1 - 1e-8]."""
    eta = reduce(lambda a, b: a + b, [F.col("b0"), *[F.col(f"b{i + 1}") * F.col(c) for i, c in enumerate(covs)]])
    mu = F.greatest(F.least(1 / (1 + F.exp(-eta)), F.lit(1 - 1e-8)), F.lit(1e-8))
    return df.join(side(null), site).withColumn("mu", mu).drop(*[f"b{i}" for i in range(len(covs) + 1)])


def gwas_score(df: DataFrame, site: str = "site", variant: str = "variant", g: str = "dosage", case: str = "case", covs: Sequence[str] = ("c1", "c2")) -> DataFrame:
    """Logistic score test of each variant at each site, from rows with mu of the null model.

    Columns: site, variant, n, beta, se, stat and odds_ratio. The intercept and any number of covariates are taken out one by
    one; one that those before it explain takes out nothing. A variant without information left has null beta and se and
    stat 0.
    """
    w = F.col("mu") * (1 - F.col("mu"))
    m = least_squares(df, [site, variant], [F.col(c) for c in covs], F.col(g), (F.col(case).cast("double") - F.col("mu")) / w, w)
    info = F.when(F.col("xx") > 1e-9, F.col("xx"))
    m = m.withColumn("beta", F.col("xy") / info).withColumn("se", 1 / F.sqrt(info))
    return m.select(site, variant, "n", "beta", "se", safe_div(F.col("beta"), F.col("se"), F.lit(0.0)).alias("stat"), odds_ratio(F.col("beta")).alias("odds_ratio"))


def meta_ivw(df: DataFrame, by: list[str], beta: str = "beta", se: str = "se") -> DataFrame:
    """E5: fixed-effect meta-analysis by inverse variance. Sites without a usable beta or se weigh nothing, and where none
    is usable beta and se are null and stat 0."""
    ok = F.col(beta).isNotNull() & ~F.isnan(beta) & F.col(se).isNotNull() & ~F.isnan(se) & (F.col(se) > 0)
    w = F.when(ok, 1 / (F.col(se) * F.col(se)))
    m = df.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * F.col(beta)).alias("wb"), F.count(w).alias("n_sites"))
    m = m.withColumn("beta", safe_div(F.col("wb"), F.col("w"))).withColumn("se", F.sqrt(safe_div(F.lit(1.0), F.col("w"))))
    return m.select(*by, "n_sites", "beta", "se", safe_div(F.col("beta"), F.col("se"), F.lit(0.0)).alias("stat"))


def weighted_mean(df: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    """Weighted mean over rows that have both, and the total weight."""
    ok = F.col(value).isNotNull() & F.col(weight).isNotNull()
    m = df.groupBy(*by).agg(F.sum(F.when(ok, F.col(value) * F.col(weight))).alias("vw"), F.sum(F.when(ok, F.col(weight))).cast("double").alias("w"))
    return m.select(*by, safe_div(F.col("vw"), F.col("w")).alias("mean"), F.col("w").alias("total_weight"))


def hit_summary(df: DataFrame, threshold: float, by: list[str], p: str = "p") -> DataFrame:
    """Rows below the threshold, and the largest -log10 p, by group."""
    return df.groupBy(*by).agg(F.count_if(F.col(p) < threshold).alias("n_hits"), F.max(neglog10(F.col(p))).alias("max_neglog10_p"))


def polygenic_score(geno: DataFrame, weights: DataFrame, sample: list[str], variant: str = "variant", by: list[str] | None = None) -> DataFrame:
    """Sum of weight times dosage, missing dosages at their group's mean; weights have variant, weight and flip.

    Rows: sample, raw. Standardise with zscore(strict=True), which fails where scores don't vary.
    """
    known = weights.filter("weight <> 0").select(variant, "weight", "flip")
    g = geno.join(side(known), variant)
    mean = g.groupBy(variant, *(by or [])).agg(F.avg("dosage").alias("__mean"))
    g = g.join(mean, [variant, *(by or [])])
    d = F.coalesce(F.col("dosage").cast("double"), F.col("__mean"))
    return g.groupBy(*sample).agg(F.sum(F.col("weight") * F.when(F.col("flip"), 2 - d).otherwise(d)).alias("raw"))


def r_squared(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """R squared of a linear fit of y on a score, from moments."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return ok.groupBy(*by).agg(F.count("*").alias("n"), F.regr_r2(F.col(y), F.col(x)).alias("r2"))


def r_squared_given(df: DataFrame, score: str, covs: Sequence[str], y: str, by: list[str]) -> DataFrame:
    """R squared of a linear fit of y on an intercept, covariates of any number and rank, and a score. Rows that lack a value
    are left out; null where y doesn't vary."""
    m = least_squares(df, by, [F.col(c) for c in covs], F.col(score), F.col(y))
    left = F.col("yy") - F.coalesce(safe_div(F.col("xy") * F.col("xy"), F.when(F.col("xx") > 1e-9, F.col("xx"))), F.lit(0.0))
    return m.select(*by, "n", (1 - safe_div(left, F.when(F.col("y0") > 1e-9, F.col("y0")))).alias("r2"))


def auroc_given(df: DataFrame, score: str, covs: tuple[str, ...], case: str, site: str) -> DataFrame:
    """E9 (action): area under the ROC curve of the probabilities of a logistic fit of the case on covariates and a score."""
    terms = (*covs, score)
    x = df.dropna(subset=[site, case, *terms])
    return auroc(null_mean(x, fit_null(x, site, case, terms), site, terms), "mu", case, [site])


def auroc(df: DataFrame, score: str, case: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve by ranks, ties at their average rank; null without both classes.

    Rows are counted by distinct score, and the counts run up over ranges of (group, score): no task holds a group.
    """
    c = df.filter(F.col(score).isNotNull() & F.col(case).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(case)).alias("pos"), F.count_if(~F.col(case)).alias("neg"))
    c = running_within(c, by, [score], {"upto": "neg"})
    m = c.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return m.select(*by, "n_pos", "n_neg", safe_div(F.col("u"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auroc"))


def hits_table(df: DataFrame, threshold: float, k: int, trait: list[str], order: list[str], p: str = "p") -> DataFrame:
    """H1: a trait's significant rows, or its k rows with the smallest p if there are none, with rank and hit_set.

    The k smallest are cut within tasks before they meet; a trait has significant rows if and only if the first of them is.
    """
    w = W.partitionBy(*trait).orderBy(F.col(p).asc_nulls_last(), *order)
    hits = df.filter(F.col(p) < threshold).withColumn("rank", F.row_number().over(w)).withColumn("hit_set", F.lit("significant"))
    top = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    top = top.withColumn("__least", F.min(p).over(W.partitionBy(*trait))).filter(~F.coalesce(F.col("__least") < threshold, F.lit(False))).drop("__least")
    return hits.unionByName(top.withColumn("hit_set", F.lit("top")))


def manhattan_points(df: DataFrame, chrom: str = "chrom", bp: str = "bp", gap: int = 1_000_000) -> DataFrame:
    """H2: adds x, a position over all chromosomes with a gap between two, and tick, the middle of the chromosome."""
    ends = df.groupBy(chrom).agg(F.max(bp).alias("__end"))
    before = F.sum(F.col("__end") + gap).over(W.partitionBy(F.lit(1)).orderBy(chrom).rowsBetween(W.unboundedPreceding, -1))
    ends = ends.withColumn("__start", F.coalesce(before, F.lit(0)))  # one row per chromosome
    out = df.join(side(ends), chrom)
    return out.withColumn("x", F.col("__start") + F.col(bp)).withColumn("tick", F.col("__start") + F.col("__end") / 2).drop("__start", "__end")


def qq_points(df: DataFrame, k: int, p: str = "p", by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """H3: the k smallest p of each group with the -log10 expected of their rank among all rows of the group."""
    by = by or []
    n = df.filter(F.col(p).isNotNull()).groupBy(*by).agg(F.count("*").alias("__n"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(p, *(order or [])))
    top = df.filter(F.col(p).isNotNull()).withColumn("rank", rank).filter(F.col("rank") <= k)
    out = top.join(side(n), by) if by else top.crossJoin(n)
    return out.withColumn("expected", -F.log10((F.col("rank") - 0.5) / F.col("__n"))).withColumn("observed", neglog10(F.greatest(F.col(p), F.lit(TINY)))).drop("__n")
