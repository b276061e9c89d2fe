"""Variant selection, allele harmonisation, windows and loci."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.dealing import dealt
from ..functions.lineage import cut
from ..functions.ranks import in_ranges, rank_within, running_over
from ..functions.scalars import normalize_chr
from .association import side

LCG, MERSENNE = 48271, 2147483647


def order_key(id_col: Column, seed: int = 0) -> Column:
    """A reproducible random order of LONG ids, by arithmetic that any engine can repeat."""
    return (F.pmod(id_col, F.lit(MERSENNE)) * LCG + seed) % MERSENNE


def in_window(df: DataFrame, chrom, start: int, end: int) -> DataFrame:
    """Variants of a chromosome in a closed window."""
    return df.filter((F.col("chrom") == chrom) & F.col("bp").between(start, end))


def filter_maf(df: DataFrame, threshold: float, u: str = "u", n: str = "n", min_mac: int = 0) -> DataFrame:
    """Pooled frequency filter on allele counts, with a slack of 1e-10."""
    mac = F.least(F.col(u), 2 * F.col(n) - F.col(u))
    return df.filter((mac >= 2 * F.col(n) * threshold - 1e-10) & (mac >= min_mac))


def filter_maf_any_site(df: DataFrame, threshold: float, variant: list[str], maf: str = "maf") -> DataFrame:
    """Variants whose frequency is above the threshold at some site."""
    return df.groupBy(*variant).agg(F.max(maf).alias("max_maf")).filter(F.col("max_maf") > threshold)


def drop_incomplete(df: DataFrame, by: list[str], variant: str) -> tuple[DataFrame, DataFrame]:
    """C4: rows of variants without a missing dosage in their group, and how many variants each group lost."""
    state = df.groupBy(*by, variant).agg((F.count_if(F.col("dosage").isNull()) == 0).alias("complete"))
    kept = df.join(state.filter("complete"), [*by, variant], "left_semi")
    return kept, state.groupBy(*by).agg(F.count_if(~F.col("complete")).alias("n_incomplete"))


def sample_variants(df: DataFrame, fraction: float, seed: int, variant: str = "variant", by: list[str] | None = None) -> DataFrame:
    """round(fraction * n) distinct variants of each group, one at least, in a reproducible order."""
    by = by or []
    v = df.select(*by, variant).distinct()
    v = v.withColumn("__k", order_key(F.col(variant).cast("long"), seed)).withColumn("__all", F.lit(1))
    v = rank_within(v, by or ["__all"], ["__k", variant], "__r")
    return v.filter(F.col("__r") < F.greatest(F.lit(1), F.round(F.col("__r_n") * fraction))).select(*by, variant)


def ancestry_specific(df: DataFrame, high: float, low: float, variant: list[str], maf: str = "maf") -> DataFrame:
    """Variants common at one site and rare at another."""
    return df.groupBy(*variant).agg(F.bool_or(F.col(maf) > high).alias("common"), F.bool_or(F.col(maf) < low).alias("rare")).filter("common AND rare").select(*variant)


def harmonize_variants(bim: DataFrame, ref: DataFrame, strict: bool = False) -> DataFrame:
    """Adds status (ok, swap, absent, incompatible) and flip, against a reference with snp_id, bp, a1, a2."""
    r = side(ref.select("snp_id", F.col("bp").alias("__bp"), F.upper("a1").alias("__a1"), F.upper("a2").alias("__a2")))
    x = bim.join(r, "snp_id", "left")
    a1, a2 = F.upper("a1"), F.upper("a2")
    status = (
        F.when(F.col("__bp").isNull(), "absent")
        .when(F.col("__bp") != F.col("bp"), "incompatible")
        .when((a1 == F.col("__a1")) & (a2 == F.col("__a2")), "ok")
        .when((a1 == F.col("__a2")) & (a2 == F.col("__a1")), "swap")
        .otherwise("incompatible")
    )
    x = x.withColumn("status", status).drop("__bp", "__a1", "__a2")
    if strict:
        fail = F.raise_error(F.concat(F.lit("variant "), F.col("snp_id"), F.lit(": "), F.col("status"))).cast("string")
        x = x.withColumn("status", F.when(F.col("status").isin("ok", "swap"), F.col("status")).otherwise(fail))
    return x.withColumn("flip", F.col("status") == "swap")


def harmonize_sumstats(ss: DataFrame, ref: DataFrame) -> DataFrame:
    """D3: summary statistics on the reference's alleles: a swap changes the sign of beta and stat; others are left out."""
    x = harmonize_variants(ss, ref).filter(F.col("status").isin("ok", "swap"))
    sign = F.when(F.col("flip"), -1.0).otherwise(1.0)
    a1, a2 = F.col("a1"), F.col("a2")
    return x.withColumns({"beta": F.col("beta") * sign, "stat": F.col("stat") * sign, "a1": F.when(F.col("flip"), a2).otherwise(a1), "a2": F.when(F.col("flip"), a1).otherwise(a2)}).drop("status")


def check_variant_axis(df: DataFrame, site: str = "site", ordinal: str = "vidx", first=None) -> DataFrame:
    """For each site, how its variants by position differ from those of the first site."""
    lead = df.agg(F.min(site)).first()[0] if first is None else first
    cols = ["snp_id", "a1", "a2"]
    base = df.filter(F.col(site) == lead).select(F.col(ordinal).alias("__o"), *[F.col(c).alias(f"__{c}") for c in cols])
    sites = side(df.filter(F.col(site) != lead).select(site).distinct())
    want = base.crossJoin(sites)
    own = df.filter(F.col(site) != lead).select(F.col(site).alias("__site"), F.col(ordinal).alias("__ord"), *cols)
    j = want.join(own, (F.col(site) == F.col("__site")) & (F.col("__o") == F.col("__ord")), "full")
    same = F.col("snp_id") == F.col("__snp_id")
    equal = same & (F.col("a1") == F.col("__a1")) & (F.col("a2") == F.col("__a2"))
    swap = same & (F.col("a1") == F.col("__a2")) & (F.col("a2") == F.col("__a1"))
    return j.groupBy(F.coalesce(site, "__site").alias(site)).agg(
        F.count_if(F.col("__ord").isNull()).alias("n_missing"), F.count_if(F.col("__o").isNull()).alias("n_extra"),
        F.count_if(~same).alias("n_other_variant"), F.count_if(swap).alias("n_swapped"), F.count_if(same & ~equal & ~swap).alias("n_other_alleles"),
    )


def prepare_scores(scores: DataFrame, bim: DataFrame) -> DataFrame:
    """D5 and C7 (action): scoring weights for a variant table: chromosomes as numbers, kept where the variant is known, weights of one
    (position, allele) added up, and only alleles the variant has. Columns: snp_id, chrom, bp, weight, flip (A2 counted)."""
    s = scores.select(normalize_chr(F.col("hm_chr")).alias("chrom"), F.col("hm_pos").cast("long").alias("bp"), F.upper("effect_allele").alias("ea"), F.col("effect_weight").cast("double").alias("w")).dropna()
    b = bim.select("snp_id", normalize_chr(F.col("chrom")).alias("chrom"), "bp", F.upper("a1").alias("a1"), F.upper("a2").alias("a2"))
    s = dealt(s, ["chrom", "bp"], scores).groupBy("chrom", "bp", "ea").agg(F.sum("w").alias("weight"))
    return s.join(b, ["chrom", "bp"]).filter(F.col("ea").isin(F.col("a1"), F.col("a2"))).select("snp_id", "chrom", "bp", "ea", "weight", (F.col("ea") == F.col("a2")).alias("flip"))


def common_variants(df: DataFrame, key: list[str], site: str = "site") -> DataFrame:
    """Keys present at every site of the table."""
    n = df.select(site).distinct().count()
    return df.groupBy(*key).agg(F.count_distinct(site).alias("__n")).filter(F.col("__n") == n).drop("__n")


#: Windows and variants that are matched at once, and variants of a task.
BLOCK_WINDOWS, BLOCK_VARIANTS, TASK_VARIANTS = 128, 1_024, 50_000


def assign_windows(variants: DataFrame, windows: DataFrame, bucket: int, chrom: str = "chrom", bp: str = "bp", keep: list[str] | None = None) -> DataFrame:
    """D7 (action): (variant, window) pairs for closed, possibly overlapping windows; `keep` are the columns to return, or None for all.

    Both tables are dealt and sorted by position buckets. Where they meet, blocks of a bucket's variants are matched with blocks of
    its windows in order of start, and pairs come block by block, in it variant by variant in order of position: neighbours have
    nearly the same short list, and a task has few enough variants for a file's dictionary. So files of the pairs, which may grow
    with the square of the tables, take a fraction of a byte a pair, also where a variant has thousands of windows."""
    own, other = list(variants.columns), [c for c in windows.columns if c != chrom]
    own, other = ([c for c in x if keep is None or c in keep] for x in (own, other))
    tasks = max(variants.sparkSession.sparkContext.defaultParallelism, ceil(variants.count() / TASK_VARIANTS))
    spread = F.explode(F.sequence(F.floor(F.col("start_bp") / bucket), F.floor(F.col("end_bp") / bucket)))
    w = windows.filter(F.col(chrom).isNotNull()).select(F.col(chrom).alias("chrom"), spread.alias("bucket"), F.lit(0).alias("kind"), F.col("start_bp").alias("lo"), F.col("end_bp").alias("hi"), *[F.col(c).alias(f"w{i}") for i, c in enumerate(other)])
    v = variants.filter(F.col(chrom).isNotNull() & F.col(bp).isNotNull()).select(F.col(chrom).alias("chrom"), F.floor(F.col(bp) / bucket).alias("bucket"), F.lit(1).alias("kind"), F.col(bp).alias("lo"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(own)])
    x = w.unionByName(v, allowMissingColumns=True).repartition(tasks, "chrom", "bucket").sortWithinPartitions("chrom", "bucket", "kind", "lo", "hi")
    schema = T.StructType([*[T.StructField(c, variants.schema[c].dataType) for c in own], *[T.StructField(c, windows.schema[c].dataType) for c in other]])
    ours, theirs = [f"v{i}" for i in range(len(own))], [f"w{i}" for i in range(len(other))]

    def run(batches):
        cell, held = None, []
        for batch in batches:
            key = list(zip(*[batch[c].to_pylist() for c in ("chrom", "bucket", "kind")], strict=True))
            cuts = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
            for i, j in zip(cuts, cuts[1:]):
                part, at = batch.slice(i, j - i), key[i][:2]
                if at != cell:
                    cell, held = at, []
                if key[i][2] == 0:
                    held.append(part)
                elif held:
                    held = [pa.Table.from_batches(held).combine_chunks().to_batches()[0]] if len(held) > 1 else held
                    yield from _pairs(part, held[0], ours, theirs, schema.names)

    return x.mapInArrow(run, schema)


def _pairs(variants: pa.RecordBatch, windows: pa.RecordBatch, ours: list[str], theirs: list[str], names: list[str]):
    """Batches of the pairs of a bucket's variants, by position, and its windows, by start."""
    pos, start, end = (np.asarray(c) for c in (variants["lo"], windows["lo"], windows["hi"]))
    for a in range(0, len(pos), BLOCK_VARIANTS):
        p = pos[a : a + BLOCK_VARIANTS, None]
        for b in range(0, len(start), BLOCK_WINDOWS):
            s, e = start[b : b + BLOCK_WINDOWS], end[b : b + BLOCK_WINDOWS]
            i, j = np.nonzero((s <= p) & (p <= e))
            if len(i):
                columns = [*[variants[c].take(pa.array(i + a)) for c in ours], *[windows[c].take(pa.array(j + b)) for c in theirs]]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def flip_flags(bims: DataFrame, truth: DataFrame, key: list[str], causal: str = "causal_snp_ids") -> DataFrame:
    """Truth keys with inconsistent, true if any causal variant is coded differently at two sites."""
    odd = bims.groupBy("snp_id").agg(F.count_distinct("a1").alias("n")).filter("n > 1").select("snp_id", F.lit(True).alias("odd"))
    ids = truth.select(*key, F.explode(F.split(causal, ",")).alias("snp_id"))
    return ids.join(odd, "snp_id", "left").groupBy(*key).agg(F.bool_or(F.coalesce("odd", F.lit(False))).alias("inconsistent"))


def union_variants(df: DataFrame, pops: list, variant: list[str], pop: str = "pop") -> DataFrame:
    """One row per variant, eligible_<pop> for each ancestry, and conflict if its position or alleles disagree."""
    has = [F.coalesce(F.bool_or(F.col(pop) == p), F.lit(False)).alias(f"eligible_{p}") for p in pops]
    return df.groupBy(*variant).agg(*has, (F.count_distinct("bp", "a1", "a2") > 1).alias("conflict"))


def check_inputs(ss: DataFrame, ld: DataFrame, by: list[str], ordinal: str = "j") -> DataFrame:
    """How a statistics table and an LD variant list differ in order, alleles and duplicates, by group."""
    x = ss.select(*by, F.col(ordinal).alias("__o"), F.struct("snp_id", "a1", "a2").alias("s"))
    y = ld.select(*by, F.col(ordinal).alias("__o"), F.struct("snp_id", "a1", "a2").alias("l"))
    j = x.join(y, [*by, "__o"], "full")
    dup = ss.groupBy(*by, "snp_id").agg((F.count("*") - 1).alias("d")).groupBy(*by).agg(F.sum("d").alias("n_duplicate"))
    out = j.groupBy(*by).agg(F.count_if(F.col("s").isNull() | F.col("l").isNull()).alias("n_unmatched"), F.count_if(F.col("s") != F.col("l")).alias("n_different"))
    return out.join(dup, by, "left")


def borrow_ld(ss: DataFrame, ld: DataFrame, lender: str, borrower: str, key: list[str]) -> DataFrame:
    """One site's statistics with another site's LD, on the variants both have."""
    a = ss.filter(F.col("site") == borrower).drop("site")
    b = ld.filter(F.col("site") == lender).drop("site")
    return a.join(b, key)


def candidate_windows(variants: DataFrame, size: int, step: int) -> DataFrame:
    """H4: windows [start, start + size] every `step` over each chromosome's range; the last is cut at the end."""
    ends = variants.groupBy("chrom").agg(F.min("bp").alias("lo"), F.max("bp").alias("hi"))
    starts = ends.select("chrom", "hi", F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("start_bp"))
    return starts.select("chrom", "start_bp", F.least(F.col("start_bp") + size, F.col("hi")).alias("end_bp"))


def stratify(df: DataFrame, score: str, tie: list[str]) -> DataFrame:
    """H5: terciles by score: n div 3 low, n div 3 high, the rest medium."""
    x = rank_within(df.withColumn("__all", F.lit(1)), ["__all"], [score, *tie], "__r")
    third = F.floor(F.col("__r_n") / 3)
    name = F.when(F.col("__r") < third, "low").when(F.col("__r") >= F.col("__r_n") - third, "high").otherwise("medium")
    return x.withColumn("stratum", name).select(*df.columns, "stratum")


def sample_strata(df: DataFrame, k: int, key: str, seed: int, strict: bool = True) -> DataFrame:
    """H5: k rows of each stratum in a reproducible order; a short stratum is an error if strict."""
    if strict and not df.groupBy("stratum").count().filter(F.col("count") < k).isEmpty():
        raise ValueError(f"a stratum has fewer than {k} rows")
    x = rank_within(df.withColumn("__k", order_key(F.col(key).cast("long"), seed)), ["stratum"], ["__k", key], "__r")
    return x.filter(F.col("__r") < k).select(*df.columns)


#: Connected runs of up to so many windows are decided in one task.
TASK_WINDOWS = 100_000


def islands(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds `name`, the number from 1 of a window's connected run of overlapping windows within `by`, from left to right. The
    furthest end so far and the numbers run over ranges of (by, start): no task holds a chromosome."""
    order = ["start_bp", "end_bp"]
    x = running_over(in_ranges(df, by, order), by, order, {"__end": "end_bp"}, include=False, largest=True)
    x = x.withColumn("__new", F.when(F.col("__end").isNull() | (F.col("start_bp") > F.col("__end")), 1).otherwise(0))
    # Of equal windows only the first can begin a run; it has to be counted before the others.
    return running_over(x, by, [*order, F.desc("__new")], {name: "__new"}).drop("__end", "__new", "__p")


def drop_overlaps(df: DataFrame, bucket: int, priority: list[str], key: str, within: list[str] | None = None, task_windows: int = TASK_WINDOWS) -> DataFrame:
    """H6: greedy choice of non-overlapping windows, best priority first.

    A chromosome of up to `task_windows` windows is decided one by one in order of priority within a task. Larger ones are cut
    into islands, which don't meet and are decided side by side in the same way; only islands of more than `task_windows`
    windows are decided in passes over the cluster, see _drop_in_passes().
    """
    within = within or []
    rows = df.select(F.col(key).alias("k"), "chrom", "start_bp", "end_bp", *within, F.struct(*priority, key).alias("p"))
    by = ["chrom", *within]
    matched = lambda cols: reduce(lambda a, b: a & b, [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in cols])
    renamed = lambda df, cols: cut(df.groupBy(*cols).agg(F.count("*").alias("n")).filter(F.col("n") > task_windows).select(*[F.col(c).alias(f"__{c}") for c in cols]))
    large = renamed(rows, by)

    def choose(batches):
        label, starts, ends = None, [], []
        for batch in batches:
            lost = []
            columns = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
            for i, (start, end, *island) in enumerate(zip(*columns, strict=True)):
                if island != label:
                    label, starts, ends = island, [], []
                at = bisect_right(starts, end)  # kept windows don't overlap: the last that starts by `end` ends last
                if at and ends[at - 1] >= start:
                    lost.append(i)
                else:
                    at = bisect_right(starts, start)
                    starts.insert(at, start)
                    ends.insert(at, end)
            if lost:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lost))], schema=pa.schema([batch.schema.field(0)]))

    small, passed = rows.withColumn("island", F.lit(0).cast("long")), None
    if not large.isEmpty():
        parts = cut(islands(rows.join(large, matched(by), "left_semi"), by, "island"))
        long_ones = renamed(parts, [*by, "island"])
        passed = _drop_in_passes(parts.join(long_ones, matched([*by, "island"]), "left_semi").drop("island"), bucket, within)
        small = small.join(large, matched(by), "left_anti").unionByName(parts.join(long_ones, matched([*by, "island"]), "left_anti"))
    small = small.repartition(*by, "island").sortWithinPartitions(*by, "island", "p")
    dropped = small.select("k", "start_bp", "end_bp", *by, "island").mapInArrow(choose, T.StructType([rows.schema["k"]]))
    dropped = dropped.unionByName(passed) if passed is not None else dropped
    return df.join(dropped.select(F.col("k").alias(key)), key, "left_anti")


def _drop_in_passes(rows: DataFrame, bucket: int, within: list[str]) -> DataFrame:
    """The windows k that a greedy choice by p drops. In each pass the live windows that beat all live neighbours they overlap are
    kept and these neighbours drop out with their overlaps: the same choice as one by one, as priorities with the key are
    unique. There are as many passes as the longest falling chain of neighbours."""
    spread = rows.withColumn("b", F.explode(F.sequence(F.floor(F.col("start_bp") / bucket), F.floor(F.col("end_bp") / bucket))))
    a, b = spread.alias("a"), spread.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ["chrom", "b"]] + [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in within]
    hit = (F.col("a.k") != F.col("b.k")) & (F.col("a.start_bp") <= F.col("b.end_bp")) & (F.col("b.start_bp") <= F.col("a.end_bp"))
    cond = reduce(lambda x, y: x & y, [hit, *on])
    edges = cut(a.join(b, cond).select(F.col("a.k").alias("k"), F.col("b.k").alias("other"), (F.col("b.p") < F.col("a.p")).alias("beaten")).distinct())
    dropped = rows.select("k").limit(0)
    while not edges.isEmpty():
        won = edges.groupBy("k").agg(F.max("beaten").alias("beaten")).filter(~F.col("beaten")).select(F.col("k").alias("other"))
        lost = cut(edges.join(won, "other", "left_semi").select("k").distinct())
        dropped = dropped.unionByName(lost)
        edges = cut(edges.join(lost, "k", "left_anti").join(lost.select(F.col("k").alias("other")), "other", "left_anti"))
    return dropped


def drop_overlaps_by_extremeness(df: DataFrame, bucket: int, score: str, key: str) -> DataFrame:
    """H6: greedy choice of non-overlapping windows in two passes: within each stratum the most extreme first (highest of
    high, lowest of low, otherwise closest to the stratum's median), then over all strata by rank / size of the stratum.
    Ties take the stratum's name, then the key."""
    x = rank_within(df, ["stratum"], [score, key], "__r")
    middle = (F.col("__r") == F.floor((F.col("__r_n") - 1) / 2)) | (F.col("__r") == F.floor(F.col("__r_n") / 2))
    x = x.join(side(x.filter(middle).groupBy("stratum").agg(F.avg(score).alias("__median"))), "stratum").drop("__r", "__r_n")
    far = F.when(F.col("stratum") == "high", -F.col(score)).when(F.col("stratum") == "low", F.col(score)).otherwise(F.abs(F.col(score) - F.col("__median")))
    x = rank_within(x.withColumn("__far", far), ["stratum"], ["__far", key], "__r").withColumn("__priority", F.col("__r") / F.col("__r_n"))
    first = drop_overlaps(x, bucket, ["__priority"], key, within=["stratum"])
    return drop_overlaps(first, bucket, ["__priority", "stratum"], key).select(*df.columns)


def region_ids(df: DataFrame) -> DataFrame:
    """H7: connected runs of overlapping windows: region is numbered within the chromosome."""
    return islands(df, ["chrom"], "region")


def region_stratum(df: DataFrame) -> DataFrame:
    """H7: a region's stratum, the commonest among its windows; ties take the name that sorts first."""
    c = df.groupBy("chrom", "region", "stratum").agg(F.count("*").alias("n"))
    best = F.row_number().over(W.partitionBy("chrom", "region").orderBy(F.desc("n"), "stratum"))
    return c.withColumn("__r", best).filter("__r = 1").select("chrom", "region", "stratum")


def split_regions(df: DataFrame, seed: int) -> DataFrame:
    """H7: adds region, and split: `development` for a third of the regions of each stratum, one at least, in a reproducible
    order, `evaluation` for the rest. A stratum of fewer than two regions is an error."""
    x = region_ids(df)
    regions = region_stratum(x).withColumn("__k", order_key(F.col("chrom").cast("long") * 1_000_003 + F.col("region"), seed))
    ranked = rank_within(regions, ["stratum"], ["__k", "chrom", "region"], "__r")
    few = ranked.filter("__r_n < 2").select("stratum").first()
    if few is not None:
        raise ValueError(f"stratum {few[0]} has fewer than two separate regions")
    first = F.col("__r") < F.greatest(F.lit(1), F.floor(F.col("__r_n") / 3))
    ranked = ranked.select("chrom", "region", F.when(first, "development").otherwise("evaluation").alias("split"))
    return x.join(ranked, ["chrom", "region"])


def ld_prune(edges: DataFrame, variants: DataFrame, by: list[str], threshold: float, window: int) -> DataFrame:
    """H8: from left to right a variant is kept unless its r2 with one of the last `window` kept reaches the threshold.

    variants: by, j. edges: by, i, j, r2 with i < j. Sequential within a group: a grouped-map step over the edges that
    reach the threshold, which are sparse.
    """
    strong = edges.filter(F.col("r2") >= threshold).groupBy(*by, "j").agg(F.collect_list("i").alias("near"))
    rows = variants.select(*by, "j").join(strong, [*by, "j"], "left")

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j")
        kept: list[int] = []
        out = []
        for j, near in zip(pdf["j"], pdf["near"], strict=True):
            recent = set(kept[-window:])
            ok = near is None or not recent.intersection(near)
            if ok:
                kept.append(j)
            out.append(ok)
        return pdf[out][[*by, "j"]]

    return rows.groupBy(*by).applyInPandas(keep, variants.select(*by, "j").schema)


def even_stride(df: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """H9: k rows of each group at even places from its first to its last in order; all rows of a group of at most k."""
    w = W.partitionBy(*by)
    x = df.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(order)) - 1)
    step = (F.col("__n") - 1) / max(1, k - 1)
    guess = F.floor(F.col("__r") / step)
    there = lambda i: (i >= 0) & (i < k) & (F.bround(i * step, 0) == F.col("__r"))
    taken = there(guess - 1) | there(guess) | there(guess + 1) | there(guess + 2)
    return x.filter((F.col("__n") <= k) | (taken if k > 1 else F.col("__r") == 0)).drop("__n", "__r")


def pick_tags(variants: DataFrame, edges: DataFrame, by: list[str], k: int, threshold: float, window: int) -> DataFrame:
    """H9: groups of at most k are kept whole; others get max(2 k, k + 50) even places, LD pruning, then k even places."""
    x = variants.withColumn("__n", F.count("*").over(W.partitionBy(*by)))
    few, many = x.filter(F.col("__n") <= k).drop("__n"), x.filter(F.col("__n") > k).drop("__n")
    first = even_stride(many, by, "j", max(2 * k, k + 50))
    return few.unionByName(even_stride(ld_prune(edges, first, by, threshold, window), by, "j", k))


def manhattan_locus(ss: DataFrame, pips: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """A locus's variants with -log10 p by ancestry, joint PIP, truth flag and the lead variant."""
    x = ss.join(pips, [*key, "variant"]).join(truth.withColumn("causal", F.lit(True)), [*key, "variant"], "left")
    lead = F.max_by("variant", F.struct("pip", -F.col("variant"))).over(W.partitionBy(*key))
    return x.withColumn("causal", F.coalesce("causal", F.lit(False))).withColumn("lead", F.col("variant") == lead)
