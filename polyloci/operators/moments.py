"""Additive genotype and phenotype moments, pooled LD and summary statistics, LD of loci, and masked sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from ..functions.scalars import safe_div
from .association import side


def geno_moments(geno: DataFrame, by: list[str], sample: str = "sample", j: str = "j", rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """G = X'X as rows (by, i <= j, g) and (by, j, u, n), from raw whole dosages without missing values; others fail the job.

    One row per sample holds its dosages. Gram blocks of an Arrow batch of samples, `rows` at a time, are added up by
    Spark, so a pair of variants is a row once for each batch, not for each sample. Sums of whole numbers are exact.
    """
    x = geno.groupBy(*by, sample).agg(F.array_sort(F.collect_list(F.struct(F.col(j).cast("int").alias("j"), F.col("dosage").cast("double").alias("d")))).alias("x"))
    x = x.select(*by, F.col("x.j").alias("js"), F.col("x.d").alias("d"))
    fields = [f for f in x.schema if f.name in by]
    schema = T.StructType([*fields, T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("g", T.LongType())])

    def gram(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            pdf["__axis"] = [tuple(v) for v in pdf["js"]]
            for key, part in pdf.groupby([*by, "__axis"], sort=False, dropna=False):
                axis = np.array(key[-1])
                total = np.zeros((len(axis), len(axis)))
                for s in range(0, len(part), rows):
                    m = np.stack(part["d"].iloc[s : s + rows].to_list())
                    total += m.T @ m
                if not np.array_equal(total, np.rint(total)):
                    raise ValueError(f"{key[:-1]}: X'X is not whole: dosages are not counts, or some are missing")
                a, b = np.triu_indices(len(axis))
                first = batch.slice(int(part.index[0]), 1)
                cols = [pa.repeat(first.column(c)[0], len(a)) for c in by] + [pa.array(axis[a], pa.int32()), pa.array(axis[b], pa.int32()), pa.array(np.rint(total[a, b]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=[*by, "i", "j", "g"])

    g = x.mapInArrow(gram, schema).groupBy(*by, "i", "j").agg(F.sum("g").alias("g"))
    whole = F.when(F.col("dosage") == F.floor("dosage"), F.col("dosage").cast("long")).otherwise(F.raise_error(F.lit("dosages are not whole numbers, or some are missing")).cast("long"))
    u = geno.groupBy(*by, F.col(j).cast("int").alias("j")).agg(F.sum(whole).alias("u"), F.count("dosage").alias("n"))
    return g, u


def pheno_moments(geno: DataFrame, pheno: DataFrame, by: list[str], sample: str = "sample", j: str = "j") -> tuple[DataFrame, DataFrame]:
    """c = X'y as (by, j, c) and (by, q = 1'y, w = y'y, n). Samples without y are an error."""
    if not geno.select(sample).distinct().join(pheno.filter(F.col("y").isNotNull()), sample, "left_anti").isEmpty():
        raise ValueError("some samples have no phenotype")
    c = geno.join(pheno, sample).groupBy(*by, j).agg(F.sum(F.col("dosage") * F.col("y")).alias("c"))
    one = geno.select(*by, sample).distinct().join(pheno, sample)
    return c, one.groupBy(*by).agg(F.sum("y").alias("q"), F.sum(F.col("y") * F.col("y")).alias("w"), F.count("*").alias("n"))


def pool(df: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Moments added up over sites."""
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])


def plan_columns(manifest: DataFrame, min_n: int, pop: str = "pop", site: str = "site") -> DataFrame:
    """Ancestries with at least min_n people over all sites, with the sites that contribute."""
    return manifest.groupBy(pop).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.col(site).cast("string"))), ",").alias("sites")).filter(F.col("n") >= min_n)


def pooled_ld(g: DataFrame, u: DataFrame, by: list[str]) -> DataFrame:
    """(by, i <= j, r) of pooled moments: population correlation; 0 without variance, 1 on the diagonal."""
    d = g.filter("i = j").select(*by, F.col("i").alias("j"), F.col("g").alias("__gg"))
    s = u.join(d, [*by, "j"]).select(*by, "j", "n", (F.col("u") / F.col("n")).alias("mean"), (F.col("__gg") / F.col("n") - (F.col("u") / F.col("n")) ** 2).alias("var"))
    s = cut(s)
    some = F.broadcast if s.count() <= 50_000 else lambda x: x
    a = s.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("j").alias("__i"), F.col("mean").alias("mi"), F.col("var").alias("vi"), "n")
    b = s.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("j").alias("__j"), F.col("mean").alias("mj"), F.col("var").alias("vj"))
    on_a = (F.col("i") == F.col("__i")) & _all([F.col(c) == F.col(f"__{c}") for c in by])
    on_b = (F.col("j") == F.col("__j")) & _all([F.col(c) == F.col(f"_b_{c}") for c in by])
    x = g.join(some(a), on_a).join(some(b), on_b)
    r = (F.col("g") / F.col("n") - F.col("mi") * F.col("mj")) / F.sqrt(F.col("vi") * F.col("vj"))
    ok = (F.col("vi") > 1e-12) & (F.col("vj") > 1e-12)
    return x.select(*by, "i", "j", F.when(F.col("i") == F.col("j"), 1.0).when(ok, r).otherwise(0.0).alias("r"))


def _all(conds):
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def pooled_sumstats(u: DataFrame, diag: DataFrame, c: DataFrame, scalars: DataFrame, by: list[str]) -> DataFrame:
    """Beta, se, stat, dof, and the standardised effect, from pooled moments; variants without variance go."""
    x = u.select(*by, "j", "u").join(diag.select(*by, "j", "g"), [*by, "j"]).join(c.select(*by, "j", "c"), [*by, "j"]).join(side(scalars), by)
    n = F.col("n").cast("double")
    x = x.withColumn("sxx", F.col("g") - F.col("u") * F.col("u") / n).withColumn("sxy", F.col("c") - F.col("u") * F.col("q") / n).withColumn("syy", F.col("w") - F.col("q") * F.col("q") / n)
    x = x.filter((F.col("sxx") > 1e-9) & (n >= 3)).withColumn("beta", F.col("sxy") / F.col("sxx"))
    rss = F.greatest(F.col("syy") - F.col("beta") * F.col("sxy"), F.lit(0.0))
    x = x.withColumn("se", F.sqrt(rss / (n - 2) / F.col("sxx"))).withColumn("stat", safe_div(F.col("beta"), F.col("se"), F.lit(0.0)))
    return x.select(*by, "j", "n", "beta", "se", "stat", (F.col("n") - 2).alias("dof"), safe_div(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")), F.lit(0.0)).alias("beta_hat"))


def tau_sq(ss: DataFrame, by: list[str]) -> DataFrame:
    """Prior variance, the largest squared standardised effect."""
    return ss.groupBy(*by).agg(F.max(F.col("beta_hat") * F.col("beta_hat")).alias("tau_sq"))


def centered_moments(g: DataFrame, u: DataFrame, by: list[str]) -> DataFrame:
    """X'X - uu'/n by pair of variants."""
    a = u.select(*by, F.col("j").alias("i"), F.col("u").alias("ui"), "n")
    b = u.select(*by, "j", F.col("u").alias("uj"))
    return g.join(a, [*by, "i"]).join(b, [*by, "j"]).select(*by, "i", "j", (F.col("g") - F.col("ui") * F.col("uj") / F.col("n")).alias("sxx"))


def ld_divergence(r2: DataFrame, by: list[str], site: str = "site") -> DataFrame:
    """Frobenius distance between two sites' r2 over both triangles, averaged over pairs of sites."""
    a = r2.select(*by, F.col(site).alias("sa"), "i", "j", F.col("r2").alias("ra"))
    b = r2.select(*by, F.col(site).alias("sb"), "i", "j", F.col("r2").alias("rb"))
    x = a.join(b, [*by, "i", "j"]).filter("sa < sb")
    times = F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    d = x.groupBy(*by, "sa", "sb").agg(F.sqrt(F.sum(times * (F.col("ra") - F.col("rb")) ** 2)).alias("d"))
    return d.groupBy(*by).agg(F.avg("d").alias("divergence"), F.count("*").alias("n_pairs"))


def ld_strength(r2: DataFrame, by: list[str], site: str = "site") -> DataFrame:
    """Mean off-diagonal r2 of each site, averaged over sites."""
    return r2.filter("i <> j").groupBy(*by, site).agg(F.avg("r2").alias("m")).groupBy(*by).agg(F.avg("m").alias("mean_r2"))


def qc_maf(df: DataFrame, by: list[str], min_n: int) -> DataFrame:
    """Variants, median frequency and the share above 0.05 of groups with enough people."""
    return df.filter(F.col("n") >= min_n).groupBy(*by).agg(F.count("*").alias("n_variants"), F.percentile("maf", 0.5).alias("median_maf"), F.avg((F.col("maf") > 0.05).cast("double")).alias("share_common"))


def ld_decay(r2: DataFrame, max_bp: int, bins: int, by: list[str]) -> DataFrame:
    """Mean r2 by distance bin, pairs at one position included; bins without pairs have a null mean. r2 has i, j, bp_i, bp_j."""
    dist = F.abs(F.col("bp_j") - F.col("bp_i"))
    x = r2.filter((F.col("i") != F.col("j")) & (dist <= max_bp)).withColumn("bin", F.least(F.floor(dist * bins / max_bp), F.lit(bins - 1)).cast("int"))
    m = x.groupBy(*by, "bin").agg(F.avg("r2").alias("mean_r2"), F.count("*").alias("n_pairs"))
    grid = r2.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(m, [*by, "bin"], "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)).cast("long"))


def qc_divergence(df: DataFrame, by: str = "stratum") -> DataFrame:
    """Least, median and largest divergence by stratum."""
    return df.groupBy(by).agg(F.min("divergence").alias("least"), F.percentile("divergence", 0.5).alias("median"), F.max("divergence").alias("largest"))


def ld_sanity(ld: DataFrame, by: list[str]) -> DataFrame:
    """Worst deviation of the diagonal from 1, largest |r|, share of |r| > 1, nulls."""
    return ld.groupBy(*by).agg(F.max(F.when(F.col("i") == F.col("j"), F.abs(F.col("r") - 1))).alias("diagonal"), F.max(F.abs("r")).alias("largest"), F.avg((F.abs("r") > 1 + 1e-9).cast("double")).alias("share_above"), F.count_if(F.col("r").isNull()).alias("n_null"))


def uplink_cost(loci: DataFrame, width: int, m: str = "n_variants") -> DataFrame:
    """Bytes of a block of moments against bytes of its summary statistics."""
    return loci.withColumn("moment_bytes", F.lit(width) * F.col(m) * F.col(m)).withColumn("summary_bytes", F.lit(3 * width) * F.col(m))


RING = 1 << 64
FRACTION_BITS = 20


def mask_moments(df: DataFrame, sites: list[str], secret: str, site: str = "site", element: str = "element", value: str = "value") -> DataFrame:
    """Fixed-point values with a mask for each other site, added by the earlier and taken by the later one, in Z / 2^64.

    Columns: site, element, masked DECIMAL(20, 0). Without all sites' rows the values tell nothing.
    """
    own, name = F.col(site).cast("string"), F.col(element).cast("string")
    ring = F.lit(str(RING)).cast("decimal(21,0)")
    total = F.bround(F.col(value).cast("double") * (1 << FRACTION_BITS), 0).cast("decimal(38,0)")
    for i, a in enumerate(sites):
        for b in sites[i + 1 :]:
            digest = F.sha2(F.concat_ws("|", F.lit(secret), F.lit(a), F.lit(b), name), 256)
            m = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
            total = total + F.when(own == a, m).when(own == b, -m).otherwise(0)
    return df.select(site, element, F.pmod(total.cast("decimal(38,0)"), ring).cast("decimal(20,0)").alias("masked"))


def secure_sum(masked: DataFrame, sites: list[str], site: str = "site", element: str = "element") -> DataFrame:
    """The sum of each element that all sites sent once; others have a null value and complete false."""
    ring = F.lit(str(RING)).cast("decimal(38,0)")
    s = masked.groupBy(element).agg(F.sum(F.col("masked").cast("decimal(38,0)")).alias("t"), F.count_distinct(site).alias("k"), F.count("*").alias("n"))
    t = F.pmod(F.col("t"), ring)
    signed = F.when(t >= F.lit(str(RING // 2)).cast("decimal(38,0)"), t - ring).otherwise(t)
    ok = (F.col("k") == len(sites)) & (F.col("n") == len(sites))
    return s.select(element, ok.alias("complete"), F.when(ok, signed.cast("double") / (1 << FRACTION_BITS)).alias("value"))
