"""Result grids: rollups, cluster bootstrap, comparisons, rankings and the integrity of grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import safe_div
from .association import side
from .variants import LCG, MERSENNE


def join_truth(results: DataFrame, manifest: DataFrame, key: list[str], causal: str = "causal_snp_ids") -> DataFrame:
    """Results with their truth, null where unknown, and its causal ids as an array."""
    return results.join(manifest, key, "left").withColumn("causal_ids", F.split(causal, ","))


def parity(a: DataFrame, b: DataFrame, key: list[str], exact: list[str], near: list[str], rtol: float = 2e-5, atol: float = 1e-12) -> DataFrame:
    """Keys whose rows differ between two grids, with reasons. Sets to compare are columns of sorted arrays in `exact`."""
    x = a.select(*key, F.lit(True).alias("__a"), *[F.col(c).alias(f"a_{c}") for c in exact + near])
    y = b.select(*key, F.lit(True).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in exact + near])
    j = x.join(y, key, "full")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    reasons = [F.when(F.col("__b").isNull(), F.lit("missing")), F.when(F.col("__a").isNull(), F.lit("extra"))]
    reasons += [F.when(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in exact]
    off = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > atol + rtol * F.abs(F.col(f"b_{c}"))
    reasons += [F.when(both & (F.coalesce(off(c), F.lit(False)) | (F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull())), F.lit(c)) for c in near]
    return j.select(*key, F.array_compact(F.array(*reasons)).alias("reasons")).filter(F.size("reasons") > 0)


def set_signature(sets: DataFrame, key: list[str], component: str = "component", member: str = "snp_id") -> DataFrame:
    """Credible sets of a fit whatever their numbers: a sorted array of sorted arrays."""
    one = sets.groupBy(*key, component).agg(F.sort_array(F.collect_set(member)).alias("m"))
    return one.groupBy(*key).agg(F.sort_array(F.collect_set("m")).alias("sets"))


def pair_arms(df: DataFrame, key: list[str], arm: str = "arm") -> DataFrame:
    """Rows whose key every arm has."""
    n = df.select(arm).distinct().count()
    return df.join(df.groupBy(*key).agg(F.count_distinct(arm).alias("k")).filter(F.col("k") == n), key, "left_semi")


def attach(df: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """Many-to-one attach; repeated keys of dim are an error."""
    if not dim.groupBy(*on).count().filter("count > 1").isEmpty():
        raise ValueError(f"{on} are not unique")
    return df.join(side(dim), on)


def rollup_results(df: DataFrame, by: list[str]) -> DataFrame:
    """power, mean number of sets, median best size, mean causal PIP, coverage and nonconverged share by cell."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col("captured").cast("double")).alias("power"), F.avg("n_sets").alias("mean_sets"),
        F.percentile("best_size", 0.5).alias("median_size"), F.avg("causal_pip").alias("mean_causal_pip"),
        safe_div(F.sum("n_true_sets").cast("double"), F.sum("n_sets").cast("double")).alias("coverage"),
        F.avg((~F.col("converged")).cast("double")).alias("nonconverged"),
    )


def _draw(seed: Column | int, draw: Column, slot: Column, n: Column) -> Column:
    """A cluster's rank for a slot of a draw, by arithmetic that other engines can repeat."""
    x = (draw * F.lit(7919) + slot * F.lit(104729) + seed) % MERSENNE
    x = (x * F.lit(LCG) + F.lit(12345)) % MERSENNE
    x = (x * F.lit(LCG) + slot) % MERSENNE
    return F.pmod(x, n)


def bootstrap_draws(df: DataFrame, cluster: str, by: list[str], draws: int, seed: int = 17) -> DataFrame:
    """How often each cluster is drawn: (by, draw, cluster, times). Made once and shared between metrics and methods.

    Slots are explode()d and counted by rank, so the largest table is draws times clusters, whatever the rows.
    """
    c = df.select(*by, cluster).distinct()
    rank = F.row_number().over(W.partitionBy(*by).orderBy(cluster) if by else W.partitionBy(F.lit(1)).orderBy(cluster)) - 1
    c = c.withColumn("rank", rank)
    n = c.groupBy(*by).agg(F.count("*").alias("n"))
    slots = n.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select(*by, "n", "draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"))
    picked = slots.select(*by, "draw", _draw(F.lit(seed), F.col("draw").cast("long"), F.col("slot"), F.col("n")).cast("int").alias("rank"))
    times = picked.groupBy(*by, "draw", "rank").agg(F.count("*").alias("times"))
    return times.join(c, [*by, "rank"]).select(*by, "draw", cluster, "times")


def clustered_ratio(df: DataFrame, num: str, den: str, cluster: str, by: list[str], draws: int = 2000, seed: int = 17) -> DataFrame:
    """F2: sum(num) / sum(den) with the 2.5 and 97.5 % quantiles over resampled clusters, widened to hold the ratio. Bounds are
    null with fewer than two clusters or nothing to divide by; draws with nothing to divide by are left out."""
    totals = df.groupBy(*by, cluster).agg(F.sum(num).cast("double").alias("num"), F.sum(den).cast("double").alias("den"))
    point = totals.groupBy(*by).agg(F.count("*").alias("n_clusters"), safe_div(F.sum("num"), F.sum("den")).alias("ratio"))
    d = bootstrap_draws(totals, cluster, by, draws, seed).join(totals, [*by, cluster])
    d = d.groupBy(*by, "draw").agg(F.sum(F.col("times") * F.col("num")).alias("num"), F.sum(F.col("times") * F.col("den")).alias("den"))
    d = d.withColumn("r", safe_div(F.col("num"), F.col("den")))
    q = d.groupBy(*by).agg(F.percentile("r", 0.025).alias("lo"), F.percentile("r", 0.975).alias("hi"))
    out = point.join(q, by) if by else point.crossJoin(q)
    ok = (F.col("n_clusters") >= 2) & F.col("ratio").isNotNull()
    return out.select(*by, "n_clusters", "ratio", F.when(ok, F.least("lo", "ratio")).alias("lo"), F.when(ok, F.greatest("hi", "ratio")).alias("hi"))


def metric_rows(df: DataFrame, metrics: dict[str, tuple[Column, Column]], keep: list[str]) -> DataFrame:
    """One row per metric with its numerator and denominator: what F3, F5 and F6 resample together."""
    parts = F.array(*[F.struct(F.lit(k).alias("metric"), n.cast("double").alias("num"), d.cast("double").alias("den")) for k, (n, d) in metrics.items()])
    return df.select(*keep, F.explode(parts).alias("m")).select(*keep, "m.*")


def metric_summary(df: DataFrame, metrics: dict[str, tuple[Column, Column]], cluster: str, by: list[str], draws: int = 2000) -> DataFrame:
    """every metric's ratio with its cluster interval, by group."""
    return clustered_ratio(metric_rows(df, metrics, [*by, cluster]), "num", "den", cluster, [*by, "metric"], draws)


def paired_differences(df: DataFrame, key: list[str], value: str, arm: str, reference, cluster: str, draws: int = 2000) -> DataFrame:
    """mean difference of each arm from the reference over the same keys, with a paired cluster interval. Repeated or
    unpaired keys are an error."""
    if not df.groupBy(*key, arm).count().filter("count > 1").isEmpty():
        raise ValueError("keys are not unique")
    ref = df.filter(F.col(arm) == reference).select(*key, F.col(value).alias("__ref"))
    x = df.filter(F.col(arm) != reference).join(ref, key, "left")
    if not x.filter(F.col("__ref").isNull()).isEmpty():
        raise ValueError("some keys have no reference")
    x = x.withColumn("d", F.col(value).cast("double") - F.col("__ref").cast("double")).withColumn("one", F.lit(1.0))
    return clustered_ratio(x, "d", "one", cluster, [arm], draws)


def paired_method_summary(df: DataFrame, metrics: dict[str, tuple[Column, Column]], method: str, methods: tuple[str, str], cluster: str, draws: int = 2000) -> DataFrame:
    """difference of two methods' ratios with quantiles over draws of clusters that both share; null if a draw fails."""
    rows = metric_rows(df, metrics, [method, cluster])
    t = rows.groupBy("metric", cluster, method).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    d = bootstrap_draws(df, cluster, [], draws).join(t, cluster)
    d = d.groupBy("metric", "draw").pivot(method, list(methods)).agg(F.sum(F.col("times") * F.col("num")).alias("num"), F.sum(F.col("times") * F.col("den")).alias("den"))
    ratio = lambda m: safe_div(F.col(f"`{m}_num`"), F.col(f"`{m}_den`"))
    d = d.withColumn("x", ratio(methods[1]) - ratio(methods[0]))
    q = d.groupBy("metric").agg(F.percentile("x", 0.025).alias("lo"), F.percentile("x", 0.975).alias("hi"))
    p = t.groupBy("metric").pivot(method, list(methods)).agg(F.sum("num").alias("num"), F.sum("den").alias("den")).select("metric", ratio(methods[0]).alias("first"), ratio(methods[1]).alias("second"))
    return p.join(q, "metric").select("metric", "first", "second", (F.col("second") - F.col("first")).alias("difference"), "lo", "hi")


def rank_candidates(df: DataFrame, by: str, solo: list, coverage: float = 0.93, fdr: float = 0.05) -> DataFrame:
    """candidates from their result rows (captured, causal_pip, locus, n_true_sets, n_sets, n_true_pip95, n_false_pip95): power,
    yield, n_instances, n_loci, coverage, fdr, eligible, solo and rank.

    Those that pass the screen come first, then power, then those in `solo`, then name. A candidate without confident variants
    has no false ones; one without a set has no coverage and doesn't pass.
    """
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    found = F.sum("n_true_pip95") + F.sum("n_false_pip95")
    x = df.groupBy(by).agg(
        share(F.col("captured")).alias("power"), share(F.col("causal_pip") > 0.95).alias("yield"), F.count("*").alias("n_instances"), F.count_distinct("locus").alias("n_loci"),
        safe_div(F.sum("n_true_sets").cast("double"), F.sum("n_sets").cast("double")).alias("coverage"), safe_div(F.sum("n_false_pip95").cast("double"), found.cast("double")).alias("fdr"),
    )
    x = x.withColumn("eligible", F.coalesce(F.col("coverage") >= coverage, F.lit(False)) & (F.coalesce("fdr", F.lit(0.0)) <= fdr)).withColumn("solo", F.col(by).isin(*solo))
    order = [F.desc("eligible"), F.desc("power"), F.desc("solo"), F.col(by)]
    return x.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))  # a row a candidate


def pilot_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """F8: recall, coverage, mean size, confident counts and run time by arm and method."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), safe_div(F.sum("n_caught").cast("double"), F.sum("n_causal").cast("double")).alias("recall"), safe_div(F.sum("n_true_sets").cast("double"), F.sum("n_sets").cast("double")).alias("coverage"), F.avg("best_size").alias("mean_size"), F.sum("n_true_pip95").alias("true_pip95"), F.sum("runtime_s").alias("runtime_s"))


OUTCOMES = ("returned", "converged_no_cs", "nonconverged", "error")


def outcome_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """rows by outcome and cell, 0 included: returned sets, converged without a set, not converged, error. A fit that did not
    converge and yet returned sets is in two of them."""
    ok, some = ~F.col("failed"), F.col("n_sets") > 0
    n = (ok & some, ok & F.col("converged") & ~some, ok & ~F.col("converged"), F.col("failed"))
    wide = df.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in zip(OUTCOMES, n, strict=True)])
    return wide.unpivot(by, list(OUTCOMES), "outcome", "n")


def resolution(df: DataFrame, by: list[str], value: str, points: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """quantiles of a value by cell."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in points]))
    return df.groupBy(*by).agg(q.alias("q")).select(*by, *[F.col("q")[i].alias(f"q{round(100 * p)}") for i, p in enumerate(points)])


def confident_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """confident true and false variants over all rows and over rows with a single set."""
    one = F.col("n_sets") == 1
    return df.groupBy(*by).agg(F.sum("n_true_pip95").alias("true_all"), F.sum("n_false_pip95").alias("false_all"), F.sum(F.when(one, F.col("n_true_pip95"))).alias("true_single"), F.sum(F.when(one, F.col("n_false_pip95"))).alias("false_single"))


def power_coverage(df: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    """yield against coverage of cells with enough rows."""
    return rollup_results(df, by).filter(F.col("n") >= least).select(*by, "n", "power", "coverage")


def runtime_profile(df: DataFrame, by: list[str], value: str = "runtime_s") -> DataFrame:
    """rows and total time by decade of run time. Quantiles and cost: runtime_cost()."""
    return df.filter(F.col(value) > 0).groupBy(*by, F.floor(F.log10(value)).cast("int").alias("decade")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def runtime_cost(df: DataFrame, by: list[str], instances: int, workers: int = 1, value: str = "runtime_s") -> DataFrame:
    """quantiles of run time, and the hours that `instances` more would take on `workers` at the mean."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.5, 0.9, 0.99)]))
    x = df.groupBy(*by).agg(F.count("*").alias("n"), q.alias("q"), F.avg(value).alias("mean"), F.max(value).alias("largest"))
    return x.select(*by, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99"))], "mean", "largest", (F.col("mean") * instances / workers / 3600).alias("projected_hours"))


def contamination_bins(df: DataFrame, by: list[str], pip: str = "pip", flag: str = "inconsistent") -> DataFrame:
    """share of instances with an inconsistently coded causal variant, by bin of confidence."""
    edges = (0.1, 0.3, 0.5, 0.7, 0.9, 0.95)
    b = reduce(lambda acc, e: acc + (F.col(pip) > e).cast("int"), edges, F.lit(0))
    return df.withColumn("bin", b).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("contamination"))


def weakest_signal(df: DataFrame, by: list[str]) -> DataFrame:
    """coverage at the smallest h2."""
    least = df.agg(F.min("h2").alias("__h2"))
    return rollup_results(df.join(F.broadcast(least), F.col("h2") == F.col("__h2")), by).select(*by, "n", "coverage")


def pivot_power(df: DataFrame, rows: list[str], over: str, values: list) -> DataFrame:
    """power by row and, across, architecture."""
    return df.groupBy(*rows).pivot(over, values).agg(F.avg(F.col("captured").cast("double")))


def check_grid(df: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """One row: repeated, missing and extra keys of a grid, and rows with an error."""
    k = df.select(*key)
    dup = k.groupBy(*key).count().filter("count > 1").agg(F.count("*").alias("n_duplicate"))
    missing = expected.select(*key).exceptAll(k.distinct()).agg(F.count("*").alias("n_missing"))
    extra = k.distinct().exceptAll(expected.select(*key)).agg(F.count("*").alias("n_extra"))
    err = df.agg(F.count_if(F.col("error").isNotNull()).alias("n_error"))
    return dup.crossJoin(missing).crossJoin(extra).crossJoin(err)  # four one-row tables


def expected_grid(*parts: DataFrame) -> DataFrame:
    """All combinations of small lists of keys."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def apply_policies(sets: DataFrame, policies: DataFrame) -> DataFrame:
    """Sets under each purity policy: those at or above its cutoff."""
    return sets.join(F.broadcast(policies), F.col("purity") >= F.col("cutoff")).drop("cutoff")


def design_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """rows of each cell of the design."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def maf_spectrum(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """variants by frequency bin over [0, 0.5]."""
    return df.groupBy(*by, F.least(F.floor(F.col("maf") * 2 * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def rare_shares(df: DataFrame, by: list[str]) -> DataFrame:
    """shares of variants under .005, .01 and .05."""
    s = lambda t: F.avg((F.col("maf") < t).cast("double"))
    return df.groupBy(*by).agg(s(0.005).alias("under_005"), s(0.01).alias("under_01"), s(0.05).alias("under_05"))


def pop_probability(df: DataFrame, by: list[str], prob: str = "prob", call: float = 0.8, cohort: DataFrame | None = None, pop: str = "pop") -> DataFrame:
    """median probability and the share that is called, by ancestry, with the people of each ancestry where cohort (pop, n)
    is given."""
    if cohort is not None:
        known = cohort.select(pop, F.col("n").alias("cohort_n"))
        return pop_probability(df, by, prob, call).join(side(known), pop, "left")
    return df.groupBy(*by).agg(F.count(prob).alias("n"), F.percentile(prob, 0.5).alias("median"), F.avg((F.col(prob) > call).cast("double")).alias("share_called"))


def size_divergence(df: DataFrame, by: list[str], size: str, divergence: str) -> DataFrame:
    """correlation of two properties of loci, such as window size or LD strength and divergence."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.corr(size, divergence).alias("r"))


def stratum_panels(df: DataFrame, by: list[str], cluster: str, draws: int = 2000) -> DataFrame:
    """power, yield of sets, coverage with cluster intervals and median set size by stratum and design."""
    metrics = {"power": (F.col("captured").cast("double"), F.lit(1.0)), "yield": (F.col("n_sets"), F.lit(1.0)), "coverage": (F.col("n_true_sets"), F.col("n_sets"))}
    size = df.groupBy(*by).agg(F.percentile("best_size", 0.5).alias("median_size"))
    return metric_summary(df, metrics, cluster, by, draws).join(size, by)


def power_gain(df: DataFrame, key: list[str], arm: str, reference, cluster: str, draws: int = 2000) -> DataFrame:
    """gain in power of each arm over a reference arm in percentage points, over the keys that all arms ran."""
    x = pair_arms(df, key, arm)
    d = paired_differences(x, key, "power", arm, reference, cluster, draws)
    return d.select(arm, "n_clusters", *[(100 * F.col(c)).alias(c) for c in ("ratio", "lo", "hi")])
