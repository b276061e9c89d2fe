"""Column to Column functions: keys, guarded arithmetic, tail probabilities, dosage and frequency arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Smallest probability that is reported, the least normal double. Fixed value.
TINY = 2.2250738585072014e-308
#: Chromosome names with numbers of their own. Fixed values.
CHROMOSOMES = {"X": 23, "Y": 24, "XY": 25, "MT": 26, "M": 26}


def normalize_chr(c: Column) -> Column:
    """B1: chromosome as an INT; X, Y, XY, MT and M have numbers, a leading `chr` is dropped, anything else is null."""
    name = F.regexp_replace(F.upper(F.trim(c)), "^CHR", "")
    named = F.create_map(*[F.lit(x) for kv in CHROMOSOMES.items() for x in kv])
    return F.coalesce(F.try_element_at(named, name), name.try_cast("int"))


def chr_pos(chrom: Column, pos: Column) -> Column:
    """B2: `chrom:pos`."""
    return F.concat_ws(":", chrom.cast("string"), pos.cast("string"))


def parse_architecture(df: DataFrame, col: str = "architecture_id") -> DataFrame:
    """Adds ncsl, h2 and rg read from `ncsl{n}_h2-{x}_rg{y}`; all null if the id doesn't have that form."""
    form = r"^ncsl(\d+)_h2-([0-9.eE+-]+)_rg(-?[0-9.]+)$"
    part = lambda i, t: F.when(F.col(col).rlike(form), F.regexp_extract(col, form, i).try_cast(t))
    return df.withColumns({"ncsl": part(1, "int"), "h2": part(2, "double"), "rg": part(3, "double")})


def split_instance(df: DataFrame, col: str = "instance") -> DataFrame:
    """Adds locus_id, architecture_id and replicate; the replicate follows the last `_rep`."""
    form = r"^([^_]+)_(.*)_rep(\d+)$"
    part = lambda i: F.when(F.col(col).rlike(form), F.regexp_extract(col, form, i))
    return df.withColumns({"locus_id": part(1), "architecture_id": part(2), "replicate": part(3).try_cast("int")})


def safe_div(a: Column, b: Column, default: Column | None = None) -> Column:
    """A / b where b > 0, else the default (null unless given). NaN counts as no value."""
    ok = (b > 0) & ~F.isnan(b.cast("double"))
    return F.when(ok, a / b).otherwise(default if default is not None else F.lit(None).cast("double"))


def _two_sided(z: pd.Series) -> pd.Series:
    out = [math.erfc(abs(v) / math.sqrt(2.0)) if v == v else math.nan for v in z.to_numpy(float)]
    return pd.Series(np.clip(out, TINY, 1.0)).where(z.notna().to_numpy())


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by Lentz's method, for whole arrays; each entry stops by itself."""
    guard = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(x), 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    h, live = d.copy(), np.ones(len(x), bool)
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / guard(1.0 + num * d)
            c = 1.0 + num / guard(c)
            h = np.where(live, h * d * c, h)
        live &= np.abs(d * c - 1.0) >= 1e-15
        if not live.any():
            break
    return h


def _log_gamma(v: np.ndarray) -> np.ndarray:
    known, at = np.unique(v, return_inverse=True)
    return np.array([math.lgamma(k) for k in known])[at]


def t_tails(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tails of Student's t: the regularised incomplete beta function at df / (df + t^2). NaN where t or df is
    none, or df is not above 0."""
    out = np.full(len(t), np.nan)
    ok = ~np.isnan(t) & (df > 0)
    n, x = df[ok], df[ok] / (df[ok] + t[ok] * t[ok])
    p, inside = np.ones(len(x)), (x < 1.0)
    a, x = n[inside] / 2.0, x[inside]
    b = np.full(len(a), 0.5)
    with np.errstate(divide="ignore"):
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - math.lgamma(0.5) + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1.0) / (a + b + 2.0)
    fraction = _beta_fraction(np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1.0 - x))
    p[inside] = np.where(low, front * fraction / a, 1.0 - front * fraction / b)
    out[ok] = np.clip(p, TINY, 1.0)
    return out


@F.pandas_udf(T.DoubleType())
def p_norm(z: pd.Series) -> pd.Series:
    """Two-sided normal tail, within [TINY, 1]."""
    return _two_sided(z)


@F.pandas_udf(T.DoubleType())
def p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t."""
    return pd.Series(t_tails(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def p_chi2(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return _two_sided(x.clip(lower=0) ** 0.5)


def neglog10(p: Column) -> Column:
    """-log10 p, with p at least TINY; null stays null."""
    return F.when(p.isNotNull(), -F.log10(F.greatest(p, F.lit(TINY))))


def odds_ratio(beta: Column) -> Column:
    """exp(beta), the exponent within +-50; null stays null."""
    return F.when(beta.isNotNull(), F.exp(F.greatest(F.least(beta, F.lit(50.0)), F.lit(-50.0))))


def maf(af: Column) -> Column:
    """The smaller of an allele's frequency and its complement."""
    return F.least(af, F.lit(1.0) - af)


def flip_dosage(d: Column, flip: Column) -> Column:
    """Dosage of the other allele where flip is true."""
    return F.when(flip, F.lit(2) - d).otherwise(d)


def zscore(df: DataFrame, col: str, by: list[str], out: str, strict: bool = False) -> DataFrame:
    """Value standardised within groups by the population SD; 0 where that is 0, or an error if strict."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    sd, mean = F.stddev_pop(col).over(w), F.avg(col).over(w)
    zero = F.raise_error(F.lit(f"{col} does not vary")).cast("double") if strict else F.lit(0.0)
    return df.withColumn(out, F.when(sd > 0, (F.col(col) - mean) / sd).when(F.col(col).isNotNull(), zero))


def split_per_pop(col: str, pops: list[str], prefix: str) -> dict[str, Column]:
    """A comma list as one DOUBLE per ancestry, null where the list is short or an entry is no number."""
    return {f"{prefix}_{p}": F.try_element_at(F.split(col, ","), F.lit(i + 1)).try_cast("double") for i, p in enumerate(pops)}


def explode_site_maf(df: DataFrame, col: str = "per_site_mafs_json") -> DataFrame:
    """A JSON map of site to frequencies as rows (site, position, maf)."""
    parsed = df.withColumn("__m", F.from_json(col, "map<string,array<double>>"))
    sites = parsed.select("*", F.explode("__m").alias("site", "__v")).drop("__m")
    return sites.select("*", F.posexplode("__v").alias("position", "maf")).drop("__v")


def melt(df: DataFrame, ids: list[str], prefix: str, name: str, value: str) -> DataFrame:
    """Columns `<prefix><name>` as rows."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    return df.unpivot(ids, cols, name, value).withColumn(name, F.substring(name, len(prefix) + 1, 10_000))


def validate_betas(df: DataFrame, value: str = "beta", ids: tuple[str, ...] = ("sample_id", "cpg_id")) -> DataFrame:
    """One row of counts: out of [0, 1], blank ids, and rows beyond the first of an (ids) key."""
    blank = F.lit(False)
    for c in ids:
        blank = blank | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    per = df.groupBy(*ids).agg(F.count("*").alias("__n"), F.count_if(~F.col(value).between(0.0, 1.0)).alias("__bad"), F.count_if(blank).alias("__blank"))
    return per.agg(F.sum("__n").alias("n_rows"), F.sum("__bad").alias("n_out_of_range"), F.sum("__blank").alias("n_blank"), F.sum(F.col("__n") - 1).alias("n_duplicate"))


def outcome_flags(df: DataFrame) -> DataFrame:
    """Captured, returned_cs, failed, pip50, pip95, nonconverged and single_cs of a result row; unknown counts as no."""
    no = lambda c: F.coalesce(c, F.lit(False))
    failed = F.coalesce(F.col("error").isNotNull() & (F.col("error") != ""), F.lit(False))
    return df.withColumns(
        {
            "captured": no(F.col("any_causal_captured")),
            "returned_cs": no(F.col("n_credible_sets") > 0),
            "failed": failed,
            "pip50": no(F.col("causal_pip_max") > 0.5),
            "pip95": no(F.col("causal_pip_max") > 0.95),
            "nonconverged": ~failed & ~no(F.col("converged")),
            "single_cs": no(F.col("n_credible_sets") == 1),
        }
    )
