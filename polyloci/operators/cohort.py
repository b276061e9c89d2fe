"""Cohorts: overlap of sites, quotas, reproducible assignment and hold-outs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ranks import rank_within
from .association import side
from .variants import order_key


def site_overlaps(df: DataFrame, person: str, site: str = "site") -> DataFrame:
    """G1: people that two sites share, by pair of sites."""
    x = df.select(person, site).distinct().groupBy(person).agg(F.sort_array(F.collect_set(site)).alias("s")).filter(F.size("s") > 1)
    first = x.select("s", F.posexplode("s").alias("p", "site_a"))
    pair = first.select("site_a", F.explode(F.slice("s", F.col("p") + 2, F.size("s"))).alias("site_b"))
    return pair.groupBy("site_a", "site_b").agg(F.count("*").alias("n_shared"))


def allocate(capacity: DataFrame, total: int, cell: str, size: str = "capacity") -> DataFrame:
    """A total dealt to cells in proportion to capacity, the leftover to the largest remainders. A total above the capacity
    of all cells fails the job."""
    w = W.partitionBy(F.lit(1))
    x = capacity.withColumn("__all", F.sum(size).over(w))
    x = x.withColumn("__base", F.floor(F.col(size) * total / F.col("__all")))
    x = x.withColumn("__rest", F.col(size) * total - F.col("__base") * F.col("__all"))
    x = x.withColumn("__left", F.lit(total) - F.sum("__base").over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.desc("__rest"), cell)))
    quota = (F.col("__base") + (F.col("__r") <= F.col("__left")).cast("long")).cast("long")
    return x.select(*capacity.columns, F.when(F.col("__all") >= total, quota).otherwise(_too_much(total, F.col("__all"))).alias("quota"))


def _too_much(total: int, available) -> Column:
    return F.raise_error(F.concat(F.lit(f"requested {total}, available "), available.cast("string"))).cast("long")


def allocate_priority(capacity: DataFrame, total: int, order: list[str], size: str = "capacity") -> DataFrame:
    """A total dealt to cells in order until it is used up. A total above the capacity of all cells fails the job."""
    every = W.partitionBy(F.lit(1))
    before = F.coalesce(F.sum(size).over(every.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = capacity.withColumn("__all", F.sum(size).over(every))
    quota = F.greatest(F.lit(0), F.least(F.col(size), F.lit(total) - before)).cast("long")
    return x.withColumn("quota", F.when(F.col("__all") >= total, quota).otherwise(_too_much(total, F.col("__all")))).drop("__all")


def assign_individuals(people: DataFrame, quota: DataFrame, person: str, seed: int, pop: str = "pop", site: str = "site", strict: bool = True) -> DataFrame:
    """Disjoint sites with exact counts by (site, pop): people in a reproducible order, cut by cumulative quotas in site
    order. A shortage is an error if strict."""
    if strict:
        have = people.groupBy(pop).agg(F.count("*").alias("have"))
        need = quota.groupBy(pop).agg(F.sum("quota").alias("need"))
        if not need.join(have, pop, "left").filter(F.coalesce("have", F.lit(0)) < F.col("need")).isEmpty():
            raise ValueError("an ancestry has too few people")
    upto = F.sum("quota").over(W.partitionBy(pop).orderBy(site))
    q = quota.withColumn("__hi", upto).withColumn("__lo", F.col("__hi") - F.col("quota")).select(F.col(pop).alias("__pop"), site, "__lo", "__hi")
    x = rank_within(people.withColumn("__k", order_key(F.col(person).cast("long"), seed)), [pop], ["__k", person], "__r").select(*people.columns, "__r")
    return x.join(side(q), (F.col(pop) == F.col("__pop")) & (F.col("__r") >= F.col("__lo")) & (F.col("__r") < F.col("__hi"))).drop("__pop", "__lo", "__hi", "__r")


def compose_cohort(people: DataFrame, quota: DataFrame, person: str, seed: int, by: list[str], strict: bool = True) -> DataFrame:
    """The first `quota` people of each cell in an order that doesn't depend on the quota, so smaller cohorts are nested. A
    cell with fewer people than its quota is an error if strict."""
    if strict:
        have = people.groupBy(*by).agg(F.count("*").alias("__have"))
        if not quota.join(have, by, "left").filter(F.coalesce("__have", F.lit(0)) < F.col("quota")).isEmpty():
            raise ValueError("a cell has fewer people than its quota")
    x = rank_within(people.withColumn("__k", order_key(F.col(person).cast("long"), seed)), by, ["__k", person], "__r")
    return x.join(side(quota), by).filter(F.col("__r") < F.col("quota")).drop("__r", "__r_n", "__k", "quota")


def split_sites(people: DataFrame, sizes: list[tuple[str, int]], person: str, seed: int, buckets: int = 256) -> DataFrame:
    """Sites of fixed sizes in a reproducible random order of all people.

    The order is by a hash; ranks are counted within buckets of it and moved up by the buckets before, so no window holds
    all people. What the sizes don't cover is left out.
    """
    key = order_key(F.col(person).cast("long"), seed)
    x = people.withColumn("__k", key).withColumn("__b", F.floor(F.col("__k") * buckets / 2147483647))
    n = x.groupBy("__b").agg(F.count("*").alias("__n"))
    n = n.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy(F.lit(1)).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    r = F.row_number().over(W.partitionBy("__b").orderBy("__k", person)) - 1
    x = x.withColumn("__r", r).join(F.broadcast(n), "__b").withColumn("__rank", F.col("__before") + F.col("__r"))  # `buckets` rows
    site, at = F.lit(None).cast("string"), 0
    for name, size in sizes:
        site = F.when(F.col("__rank").between(at, at + size - 1), name).otherwise(site)
        at += size
    return x.withColumn("site", site).filter(F.col("site").isNotNull()).drop("__k", "__b", "__n", "__before", "__r", "__rank")


def patient_holdout(df: DataFrame, patient: str, label: str, seed: int) -> DataFrame:
    """Adds split: a fifth of each label's patients to test, a tenth of the rest to validation, rounded half to even, one at least of each; labels
    with under three patients, and patients with two labels, are marked `excluded`."""
    p = df.groupBy(patient).agg(F.count_distinct(label).alias("k"), F.min(label).alias("__label"))
    good = p.filter("k = 1")
    good = rank_within(good.withColumn("__k", order_key(F.col(patient).cast("long"), seed)), ["__label"], ["__k", patient], "__r")
    good = good.withColumn("n", F.col("__r_n")).withColumn("r", F.col("__r") + 1)
    test = F.greatest(F.lit(1), F.bround(F.col("n") * 0.2, 0))
    val = F.greatest(F.lit(1), F.bround((F.col("n") - test) * 0.1, 0))
    split = F.when(F.col("n") < 3, "excluded").when(F.col("r") <= test, "test").when(F.col("r") <= test + val, "validation").otherwise("train")
    good = good.select(patient, split.alias("split"))
    return df.join(good, patient, "left").withColumn("split", F.coalesce("split", F.lit("excluded")))


def skewed_quotas(labels: DataFrame, sites: int, skew: float, label: str, size: str = "n") -> DataFrame:
    """Quota of each (site, label): weight 1 / (1 + (site + rank of label) mod sites) ** skew, largest remainders; then H11."""
    rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(label)) - 1
    x = labels.withColumn("__k", rank).withColumn("site", F.explode(F.sequence(F.lit(0), F.lit(sites - 1))))
    x = x.withColumn("__w", 1 / F.pow(1 + (F.col("site") + F.col("__k")) % sites, F.lit(skew)))
    w = W.partitionBy(label)
    share = F.col(size) * F.col("__w") / F.sum("__w").over(w)
    x = x.withColumn("__share", share).withColumn("__base", F.floor("__share"))
    x = x.withColumn("__r", F.row_number().over(w.orderBy(F.desc(F.round(F.col("__share") - F.col("__base"), 9)), "site")))
    left = F.col(size) - F.sum("__base").over(w)
    return x.withColumn("quota", (F.col("__base") + (F.col("__r") <= left).cast("long")).cast("long")).select(label, "site", "quota")


def site_capacities(n: int, small_fraction: float, sites: int = 4) -> list[int]:
    """People of each site: the last has a small share, the others the rest in equal parts, the first ones one more."""
    if n < sites:
        raise ValueError(f"{sites} sites need at least {sites} people")
    small = max(1, min(n - sites + 1, round(n * small_fraction)))
    rest, over = divmod(n - small, sites - 1)
    return [rest + (i < over) for i in range(sites - 1)] + [small]


def capacity_quotas(counts: dict[str, int], capacities: list[int], preference: dict[str, list[float]], minimum: int = 0) -> list[tuple[str, int, int]]:
    """(label, site, quota) that use up all people and fill all capacities, `minimum` of each label at each site at
    least. What is left of a label goes to sites by preference times free capacity. A table of labels by sites."""
    if minimum < 0:
        raise ValueError("the class minimum must not be negative")
    if sum(counts.values()) != sum(capacities):
        raise ValueError("capacities must add up to the number of people")
    if min(capacities) < minimum * len(counts):
        raise ValueError("a site's capacity is too small for the class minimum")
    free = [c - minimum * len(counts) for c in capacities]
    out = []
    for label, n in sorted(counts.items()):
        left = n - minimum * len(capacities)
        if left < 0:
            raise ValueError(f"label {label!r} has too few people for the class minimum at all sites")
        quota = [minimum] * len(capacities)
        while left:
            weight = [p * f for p, f in zip(preference[label], free, strict=True)]
            weight = weight if sum(weight) > 0 else free
            give = [min(f, int(left * w / sum(weight))) for w, f in zip(weight, free, strict=True)]
            if not any(give):
                give[max(range(len(weight)), key=weight.__getitem__)] = 1
            quota, free = [q + g for q, g in zip(quota, give, strict=True)], [f - g for f, g in zip(free, give, strict=True)]
            left -= sum(give)
        out += [(label, site, q) for site, q in enumerate(quota)]
    return out


def partition_sites(people: DataFrame, person: str, label: str, alpha: float, small_fraction: float, seed: int, minimum: int = 0, sites: int = 4) -> DataFrame:
    """Adds site, from 0: label counts skewed by a Dirichlet preference for each label, within fixed capacities of the
    sites, the last of them small, and with a least count of each label at each site. The driver sees one count a label."""
    counts = {r[0]: r[1] for r in people.groupBy(label).count().collect()}
    rows = np.random.default_rng(seed).dirichlet(np.full(sites, alpha), size=len(counts)).tolist() if counts else []
    quotas = capacity_quotas(counts, site_capacities(sum(counts.values()), small_fraction, sites), dict(zip(sorted(counts), rows, strict=True)), minimum)
    quota = people.sparkSession.createDataFrame(quotas, f"`{label}` {dict(people.dtypes)[label]}, site int, quota long")
    return assign_individuals(people, quota, person, seed, label)


def median_panel(df: DataFrame, score: str, tie: str) -> DataFrame:
    """The locus with the median score of each stratum, the upper one of an even number."""
    x = rank_within(df, ["stratum"], [score, tie], "__r")
    return x.filter(F.col("__r") == F.floor(F.col("__r_n") / 2)).drop("__r", "__r_n")


def sample_instances(loci: DataFrame, manifest: DataFrame, k: int, replicates: int, locus: str, seed: int) -> DataFrame:
    """Manifest rows of k loci of each stratum, in a reproducible order, with replicate below a bound."""
    r = F.row_number().over(W.partitionBy("stratum").orderBy(order_key(F.col(locus).cast("long"), seed), locus))
    chosen = loci.withColumn("__r", r).filter(F.col("__r") <= k).select(locus)
    return manifest.filter(F.col("replicate") < replicates).join(chosen, locus, "left_semi")


def shard(df: DataFrame, i: int, n: int, rank: str) -> DataFrame:
    """Every n-th row by a rank column."""
    return df.filter(F.pmod(F.col(rank), F.lit(n)) == i)


def design_grid(a: DataFrame, b: DataFrame, c: DataFrame, mode: str, base: tuple) -> DataFrame:
    """Combinations of three factors: all of them (full), those that differ from a base point in one factor (extended), or
    the base point's first factor alone (minimal)."""
    full = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).distinct()
    off = [(F.col(x) != v).cast("int") for x, v in zip(full.columns, base, strict=True)]
    n = off[0] + off[1] + off[2]
    return full if mode == "full" else full.filter(n <= 1) if mode == "extended" else full.filter((n - off[0]) == 0)


def select_cohort(files: DataFrame, cases: DataFrame, allowed: list[str], patient: str, sample: str, label: str) -> DataFrame:
    """Files joined to cases with a reason each: no case, class not allowed, several labels, or a second sample of a
    patient; `ok` otherwise."""
    c = cases.groupBy(patient).agg(F.count_distinct(label).alias("k"), F.min(label).alias(label))
    x = files.join(c, patient, "left").withColumn("__r", F.row_number().over(W.partitionBy(patient).orderBy(sample)))
    reason = F.when(F.col("k").isNull(), "no_case").when(F.col("k") > 1, "several_labels").when(~F.col(label).isin(*allowed), "class").when(F.col("__r") > 1, "second_sample").otherwise("ok")
    return x.withColumn("reason", reason).drop("k", "__r")


def check_cohort(selected: DataFrame, allowed: list[str], label: str, least: int = 20) -> DataFrame:
    """D12 (action): (label, n) of the patients that select_cohort() took; a class with fewer than `least` is an error."""
    n = selected.filter("reason = 'ok'").groupBy(label).agg(F.count("*").alias("n"))
    found = {r[0]: r[1] for r in n.filter(F.col(label).isin(*allowed)).collect()}  # a row a class
    if short := [c for c in allowed if found.get(c, 0) < least]:
        raise ValueError(f"classes {short} have fewer than {least} patients")
    return n


def check_split(df: DataFrame, key: str, phase: str, a: str, b: str) -> DataFrame:
    """Keys that are in both phases; there must be none."""
    return df.filter(F.col(phase) == a).select(key).intersect(df.filter(F.col(phase) == b).select(key))


def site_summary(people: DataFrame, blocks: DataFrame, variants: DataFrame, site: str = "site", pop: str = "pop") -> DataFrame:
    """People, ancestries, moment blocks and flipped variants of each site; a site without blocks or flips has 0."""
    n = people.groupBy(site).agg(F.count("*").alias("n_people"), F.count_distinct(pop).alias("n_ancestries"))
    b = blocks.groupBy(site).agg(F.count("*").alias("n_blocks"))
    v = variants.groupBy(site).agg(F.count_if(F.col("flip")).alias("n_flipped"))
    return n.join(b, site, "left").join(v, site, "left").na.fill(0, ["n_blocks", "n_flipped"])


def composition(df: DataFrame, by: list[str]) -> DataFrame:
    """people of each cell and their share of the first key's people."""
    c = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = c.groupBy(by[0]).agg(F.sum("n").alias("__all"))
    return c.join(side(total), by[0]).withColumn("share", F.col("n") / F.col("__all")).drop("__all")
