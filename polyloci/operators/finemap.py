"""Fine-mapping inference and its scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.dealing import dealt
from ..functions.ranks import running_within
from .tiles import tiles_of_pairs


def single_effect_pip(ss: DataFrame, tau: DataFrame, by: list[str], pop: str = "pop", variant: str = "j", n: str = "n") -> DataFrame:
    """Log Bayes factor of each variant, added over ancestries, and its posterior with equal priors.

    ss: by, pop, variant, beta_hat, n; tau: by, pop, tau_sq. v2 = 1 / n.
    """
    x = ss.join(tau, [*by, pop])
    v2, b, t = 1 / F.col(n), F.col("beta_hat"), F.col("tau_sq")
    lbf = 0.5 * F.log(v2 / (v2 + t)) + 0.5 * b * b / v2 * t / (v2 + t)
    s = x.groupBy(*by, variant).agg(F.sum(lbf).alias("lbf"))
    return softmax(s, by, "lbf", "pip")


def softmax(df: DataFrame, by: list[str], col: str, out: str) -> DataFrame:
    """Adds out, exp(col) as a share of its group's total; a group is a locus's variants."""
    w = W.partitionBy(*by)
    x = df.withColumn("__e", F.exp(F.col(col) - F.max(col).over(w)))
    return x.withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def credible_set(df: DataFrame, by: list[str], level: float, alpha: str = "pip", order: str = "j", p: str | None = None, threshold: float = 1e-5, digits: int | None = None) -> DataFrame:
    """Variants by falling posterior until the mass before them exceeds the level; with p, sets without a variant at or
    below the threshold are dropped; with digits, posteriors that agree to so many are ties, but count as they are. The mass runs
    over ranges of (group, posterior): no task holds a group."""
    rank = F.col(alpha) if digits is None else F.round(alpha, digits)
    x = running_within(df, by, [rank.desc(), F.col(order)], {"mass_before": alpha}, include=False).filter(F.col("mass_before") <= level)
    if p:
        ok = x.groupBy(*by).agg(F.min(p).alias("__p")).filter(F.col("__p") <= threshold)
        x = x.join(ok, by, "left_semi")
    return x.drop("mass_before")


def overall_pip(df: DataFrame, by: list[str], alpha: str = "alpha") -> DataFrame:
    """1 - product of (1 - alpha) over components; 1 where some alpha is 1; null if any alpha is no probability."""
    bad = F.max((F.col(alpha).isNull() | F.isnan(alpha) | (F.col(alpha) < 0) | (F.col(alpha) > 1)).cast("int"))
    one = F.max((F.col(alpha) == 1).cast("int"))
    logs = F.sum(F.when((F.col(alpha) >= 0) & (F.col(alpha) < 1), F.log1p(-F.col(alpha))))
    return df.groupBy(*by).agg(bad.alias("bad"), one.alias("one"), logs.alias("s")).select(*by, F.when(F.col("bad") == 1, None).when(F.col("one") == 1, 1.0).otherwise(1 - F.exp("s")).alias("pip"))


FIT = "component int, variant int, alpha double, sigma2 double, iterations int, status string"


def ibss(beta: list[np.ndarray], ld: list[np.ndarray], n: list[float], tau: list[float], effects: int = 10, tol: float = 1e-6, most: int = 1000) -> tuple[np.ndarray, float, int, bool]:
    """Iterative Bayesian stepwise selection for several ancestries with shared effects: alpha, sigma2, rounds, converged."""
    s, m = len(beta), len(beta[0])
    alpha = np.full((effects, m), 1.0 / m)
    mean = np.zeros((s, effects, m))
    second = np.zeros((s, effects, m))
    sigma2 = np.ones(s)
    last = -np.inf
    for it in range(1, most + 1):
        kl = 0.0
        for k in range(effects):
            total = np.zeros(m)
            parts = []
            for a in range(s):
                r = beta[a] - ld[a] @ (mean[a].sum(0) - mean[a, k])
                v2 = sigma2[a] / n[a]
                lam = 0.5 * np.log(v2 / (v2 + tau[a])) + 0.5 * r * r / v2 * tau[a] / (v2 + tau[a])
                total += lam
                parts.append((r, v2))
            e = np.exp(total - total.max())
            alpha[k] = e / e.sum()
            kl += float((alpha[k] * np.log(np.maximum(alpha[k] * m, 1e-300))).sum())
            for a, (r, v2) in enumerate(parts):
                phi2 = 1.0 / (1.0 / v2 + 1.0 / tau[a])
                mu = phi2 * r / v2
                mean[a, k] = alpha[k] * mu
                second[a, k] = alpha[k] * (mu * mu + phi2)
                kl += float((alpha[k] * 0.5 * ((mu * mu + phi2) / tau[a] - 1 - np.log(phi2 / tau[a]))).sum())
        bound = -kl
        for a in range(s):
            b = mean[a].sum(0)
            each = sum(float(mean[a, k] @ ld[a] @ mean[a, k]) for k in range(effects))
            erss = n[a] * (1 - 2 * float(b @ beta[a]) + float(b @ ld[a] @ b) - each + float(second[a].sum()))
            sigma2[a] = min(max(erss / n[a], 1e-6), 2.0)
            bound += -0.5 * n[a] * np.log(2 * np.pi * sigma2[a]) - 0.5 * erss / sigma2[a]
        if abs(bound - last) < tol:
            return alpha, float(sigma2.mean()), it, True
        last = bound
    return alpha, float(sigma2.mean()), most, False


#: Instances of a locus that one task fits, with the locus's LD read once.
TASK_FITS = 8


def fit_multi_effect(ss: DataFrame, ld: DataFrame, by: list[str], ld_by: list[str], pop: str = "pop", effects: int = 10, tol: float = 1e-6, most: int = 1000, task_fits: int = TASK_FITS) -> DataFrame:
    """I4: one joint fit per group of `by`, all of them independent; LD is shared by the groups of a locus.

    ss: by, pop, j, beta_hat, n. ld: ld_by, pop and tiles of correlations, or pairs i <= j with r. Returns by and FIT: alpha by
    component and variant. Status is converged or nonconverged. A locus's instances are dealt by hash to as many groups as
    have about `task_fits` each, and each group gets the locus's tiles once; a locus without LD gives no rows.
    """
    extra = [c for c in by if c not in ld_by]
    tiles = ld if "block" in ld.columns else tiles_of_pairs(ld, [*ld_by, pop], "r")
    loci = ss.select(*by).distinct().groupBy(*ld_by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / task_fits)).cast("int").alias("__groups"))
    dealt = F.pmod(F.xxhash64(*extra), F.col("__groups")).cast("int") if extra else F.lit(0)
    own = ss.select(*by, pop, "j", "beta_hat", "n").join(loci, ld_by).withColumn("__group", dealt).drop("__groups")
    shared = tiles.join(loci, ld_by).withColumn("__group", F.explode(F.sequence(F.lit(0), F.col("__groups") - 1))).drop("__groups")
    types = dict(ss.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], FIT])
    columns = [*by, "component", "variant", "alpha", "sigma2", "iterations", "status"]

    def run(s, t):
        mats: dict = {}
        for p, part in t.groupby(pop):
            known = np.unique(np.concatenate([np.asarray(v) for v in part["vi"]]))
            mats[p] = known, np.eye(len(known))
            for vi, vj, block in zip(part["vi"], part["vj"], part["block"], strict=True):
                i, j = np.searchsorted(known, vi), np.searchsorted(known, vj)
                r = np.frombuffer(block).reshape(len(i), len(j))
                mats[p][1][np.ix_(i, j)] = r
                mats[p][1][np.ix_(j, i)] = r.T
        out = []
        for key, one in (s.groupby(extra) if extra else [((), s)]) if len(t) else []:
            axis = np.unique(one["j"])
            beta, own_ld, ns, tau = [], [], [], []
            for p, part in one.groupby(pop):
                b = np.zeros(len(axis))
                b[np.searchsorted(axis, part["j"])] = part["beta_hat"]
                mat = np.eye(len(axis))
                if p in mats:
                    both, x, y = np.intersect1d(axis, mats[p][0], return_indices=True)
                    mat[np.ix_(x, x)] = mats[p][1][np.ix_(y, y)]
                beta.append(b)
                own_ld.append(mat)
                ns.append(float(part["n"].max()))
                tau.append(max(float((b * b).max()), 1e-12))
            alpha, sigma2, rounds, ok = ibss(beta, own_ld, ns, tau, min(effects, len(axis)), tol, most)
            k, v = np.meshgrid(np.arange(alpha.shape[0]), axis, indexing="ij")
            f = pd.DataFrame({"component": k.ravel(), "variant": v.ravel(), "alpha": alpha.ravel()})
            f["sigma2"], f["iterations"], f["status"] = sigma2, rounds, "converged" if ok else "nonconverged"
            for c in by:
                f[c] = one[c].iloc[0]
            out.append(f)
        if not out:
            kinds = {"component": "int32", "variant": "int32", "alpha": float, "sigma2": float, "iterations": "int32", "status": object}
            return pd.DataFrame({c: pd.Series([], dtype=kinds.get(c, s[c].dtype if c in by else None)) for c in columns})
        rows = pd.concat(out)[columns]
        return rows.astype({c: object for c in columns if not pd.api.types.is_numeric_dtype(rows[c])})  # strings in one chunk

    keys = [*ld_by, "__group"]
    return own.groupBy(*keys).cogroup(shared.groupBy(*keys)).applyInPandas(run, schema)


def purity(members: DataFrame, ld: DataFrame, key: list[str], ld_by: list[str], pop: str = "pop", pairwise: bool = False) -> DataFrame:
    """Purity of credible sets. Members: key, variant. By set: largest over ancestries of the least |r| over all pairs; an
    ancestry counts if it has all pairs. Pairwise: least over pairs of the largest |r| of an ancestry that has the pair."""
    a = members.select(*key, F.col("variant").alias("i"))
    b = members.select(*key, F.col("variant").alias("j"))
    pairs = a.join(b, key).filter("i < j")
    n = members.groupBy(*key).agg((F.count("*") * (F.count("*") - 1) / 2).alias("n_pairs"))
    r = ld.filter("i < j").select(*ld_by, pop, "i", "j", F.abs("r").alias("r"))
    x = pairs.join(r, [*ld_by, "i", "j"])
    if pairwise:
        m = x.groupBy(*key, "i", "j").agg(F.max("r").alias("r")).groupBy(*key).agg(F.min("r").alias("p"), F.count("*").alias("k"))
    else:
        m = x.groupBy(*key, pop).agg(F.min("r").alias("p"), F.count("*").alias("k")).join(n, key).filter("k = n_pairs").groupBy(*key).agg(F.max("p").alias("p"), F.max("k").alias("k"))
    full = (F.col("k") == F.col("n_pairs")) | F.lit(not pairwise)
    return n.join(m, key, "left").select(*key, F.when(F.col("n_pairs") == 0, 1.0).when(F.col("p").isNotNull() & full, F.col("p")).otherwise(0.0).alias("purity"))


def fit_status(df: DataFrame) -> DataFrame:
    """fit_status from error, valid, converged and n_credible_sets."""
    s = F.when(F.col("error").isNotNull(), "execution_failure").when(~F.col("valid"), "invalid_output").when(~F.col("converged"), "nonconverged")
    return df.withColumn("fit_status", s.when(F.col("n_credible_sets") > 0, "converged_cs").otherwise("converged_no_cs"))


def score_fits(pips: DataFrame, sets: DataFrame, truth: DataFrame, key: list[str], fits: DataFrame | None = None) -> DataFrame:
    """fits against truth. pips: key, variant, pip; sets: key, component, variant and, if known, purity; truth: key, variant;
    fits: key, converged, or None if all that have a pip did.

    A fit that did not converge has no probabilities: its causal and top pips are null and it finds nothing. Of one that
    did, a true variant that the fit left out counts with PIP 0 in causal_pip_max and causal_pip_mean and not in
    causal_pip_mean_eligible. Cutoffs are strict.
    """
    t = truth.withColumn("causal", F.lit(True))
    if fits is None:
        fits = pips.groupBy(*key).agg((F.count("pip") > 0).alias("converged"))
    p = pips.withColumn("__in", F.lit(True)).join(t, [*key, "variant"], "full").join(fits.select(*key, "converged"), key, "full")
    p = p.withColumn("converged", F.coalesce("converged", F.lit(False))).withColumn("pip", F.when(F.col("converged"), F.col("pip")))
    causal, known = F.coalesce("causal", F.lit(False)), F.col("__in").isNotNull()
    zero = F.when(causal & F.col("converged"), F.coalesce("pip", F.lit(0.0)))
    cols = [
        F.max("converged").alias("converged"), F.count_if(causal).alias("n_causal"), F.count_if(causal & known).alias("n_eligible_causal"), F.count_if(causal & ~known).alias("n_excluded_causal"),
        F.max(zero).alias("causal_pip_max"), F.avg(zero).alias("causal_pip_mean"), F.avg(F.when(known, zero)).alias("causal_pip_mean_eligible"),
        F.coalesce(F.max("pip"), F.when(F.max("converged"), 0.0)).alias("top_pip"),
    ]
    for name, x in (("50", 0.5), ("90", 0.9), ("95", 0.95)):
        cols += [F.count_if(causal & (F.col("pip") > x)).alias(f"n_true_pip{name}"), F.count_if(~causal & (F.col("pip") > x)).alias(f"n_false_pip{name}")]
    base = p.groupBy(*key).agg(*cols)
    m = sets.join(t, [*key, "variant"], "left")
    pure = F.first("purity") if "purity" in sets.columns else F.lit(None).cast("double")
    per = m.groupBy(*key, "component").agg(F.count("*").alias("size"), F.count("causal").alias("true_in_set"), pure.alias("purity"))
    s = per.groupBy(*key).agg(
        F.count("*").alias("n_credible_sets"), F.count_if(F.col("true_in_set") > 0).alias("n_cs_containing_causal"), F.min(F.when(F.col("true_in_set") > 0, F.col("size"))).alias("best_cs_size"),
        F.sum("size").alias("total_cs_snps"), F.avg("purity").alias("mean_cs_purity"), F.min("purity").alias("min_cs_purity"),
    )
    caught = m.filter("causal").groupBy(*key).agg(F.count_distinct("variant").alias("n_causal_captured"))
    out = base.join(s, key, "left").join(caught, key, "left").na.fill(0, ["n_credible_sets", "n_cs_containing_causal", "n_causal_captured", "total_cs_snps"])
    return out.withColumn("any_causal_captured", F.col("n_causal_captured") > 0)


def result_table(scores: DataFrame, ss: DataFrame, keys: list[str], pops: list, p: str = "p", pop: str = "pop") -> DataFrame:
    """Result rows with the least p of each ancestry."""
    m = ss.groupBy(*keys).pivot(pop, pops).agg(F.min(p))
    return scores.join(m.select(*keys, *[F.col(f"`{x}`").alias(f"min_p_{x}") for x in pops]), keys, "left")


def pop_causal_prob(sets: DataFrame, lbf: DataFrame, key: list[str], pop: str = "pop", call: float = 0.8) -> DataFrame:
    """I8: posterior that a set is causal in an ancestry, from the alpha-weighted Bayes factor against even odds."""
    x = sets.join(lbf, [*[k for k in key if k in lbf.columns], "variant"])
    m = x.groupBy(*key, pop).agg(F.sum(F.col("alpha") * F.exp(F.least("lbf", F.lit(500.0)))).alias("bf"))
    return m.select(*key, pop, (F.col("bf") / (1 + F.col("bf"))).alias("prob")).withColumn("called", F.col("prob") > call)


def genetic_value(geno: DataFrame, effects: DataFrame, by: list[str], on: list[str]) -> DataFrame:
    """Each person's sum of effect times dosage; effects are keyed by `on` (variant, ancestry)."""
    return geno.join(effects, on).groupBy(*by).agg(F.sum(F.col("effect") * F.col("dosage")).alias("gv"))


def empirical_h2(df: DataFrame, by: list[str], gv: str = "gv", y: str = "y") -> DataFrame:
    """Variance of the genetic value over variance of the phenotype."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), (F.var_pop(gv) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("h2"))


def h2_calibration(df: DataFrame, by: list[str], tolerance: float, h2: str = "h2", target: str = "target") -> DataFrame:
    """Relative error of h2: median, 95 % and largest, and the share within the tolerance."""
    e = df.withColumn("__e", F.abs(F.col(h2) - F.col(target)) / F.col(target))
    return e.groupBy(*by).agg(F.count("__e").alias("n"), F.percentile("__e", 0.5).alias("median"), F.percentile("__e", 0.95).alias("p95"), F.max("__e").alias("largest"), F.avg((F.col("__e") <= tolerance).cast("double")).alias("share_pass"))


def effect_correlation(df: DataFrame, by: list[str], pops: list, pop: str = "pop", variant: str | list[str] = "variant") -> DataFrame:
    """E28 (action): correlation of effects between pairs of ancestries over variants that have an effect in all of them; null under 2,
    NaN where effects don't vary. Several rows of a variant and ancestry count as their mean."""
    key = [*by, *([variant] if isinstance(variant, str) else variant)]
    x = dealt(df.select(*key, pop, "effect"), key)
    wide = x.groupBy(*key).agg(*[F.avg(F.when(F.col(pop) == p, F.col("effect"))).alias(str(p)) for p in pops])
    for p in pops:
        wide = wide.filter(F.col(f"`{p}`").isNotNull() & (F.col(f"`{p}`") != 0))
    varies = lambda c: F.min(c) < F.max(c)
    cor = []
    for a, b in [(F.col(f"`{a}`"), F.col(f"`{b}`")) for i, a in enumerate(pops) for b in pops[i + 1 :]]:
        r = F.when(varies(a) & varies(b), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b))).otherwise(F.lit(float("nan")))
        cor.append(F.when(F.count("*") >= 2, r))
    names = [f"r_{a}_{b}" for i, a in enumerate(pops) for b in pops[i + 1 :]]
    return wide.groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(n) for c, n in zip(cor, names, strict=True)])


def invariants(rows: list[tuple[str, DataFrame, float]]) -> DataFrame:
    """(name, observed, expected, ok), from one-row, one-column tables."""
    out = None
    for name, df, expected in rows:
        one = df.select(F.lit(name).alias("name"), F.col(df.columns[0]).cast("double").alias("observed"), F.lit(float(expected)).alias("expected"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ok", F.abs(F.col("observed") - F.col("expected")) <= 1e-9)


def summarise_checks(df: DataFrame, by: list[str], error: str, tolerance: float) -> DataFrame:
    """Matches, worst and median error, and the share off, by group."""
    return df.groupBy(*by).agg(F.count_if(F.col(error) <= tolerance).alias("n_match"), F.max(error).alias("worst"), F.percentile(error, 0.5).alias("median"), F.avg((F.col(error) > tolerance).cast("double")).alias("share_off"))
