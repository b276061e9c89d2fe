"""Readers with fixed schemas, and writers, of the files a study uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BIM = {"chrom": "string", "snp_id": "string", "cm": "double", "bp": "long", "a1": "string", "a2": "string"}
FAM = {c: "string" for c in ("fid", "iid", "father", "mother", "sex", "pheno")}
INSTANCE = {"FID": "string", "IID": "string", "y": "double"}
MANIFEST = "FID string, IID string, superpopulation string"
LOCI = "locus_id string, window_id string, chrom string, start_bp long, end_bp long, divergence_score double, stratum string, n_variants_in_window long, n_tag_snps long"


def _columns(df: DataFrame, fields: dict[str, str], site: str | None) -> DataFrame:
    part = F.split(F.trim("value"), r"\s+")
    out = df.filter(F.trim("value") != "").select("*", *[F.try_element_at(part, F.lit(i + 1)).try_cast(t).alias(c) for i, (c, t) in enumerate(fields.items())]).drop("value")
    return out.withColumn("site", F.lit(site)) if site else out


def read_bim(spark: SparkSession, path: str, site: str | None = None, strict: bool = False) -> DataFrame:
    """A1: a variant table without header. Its row order is the order in the packed file: join it to read_bed() on vidx through
    numbered_lines(). Strict (action): a line that lacks a column or a number is an error; otherwise bad_rows() lists them."""
    if strict:
        require_good(bad_rows(spark, path, BIM))
    return _columns(spark.read.text(path), BIM, site)


def read_fam(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """A2: a sample table without header."""
    return _columns(spark.read.text(path), FAM, site)


def with_line_numbers(lines: DataFrame, name: str = "line") -> DataFrame:
    """Rows of spark.read.text() with `file` and a line number from 1, however files are cut into tasks.

    Lines are numbered within their piece of a file and moved up by the lines of the pieces before; there is a row for each
    piece, which is broadcast.
    """
    x = lines.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    pieces = x.groupBy("file", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    pieces = pieces.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    x = x.join(F.broadcast(pieces), ["file", "__block"])
    return x.withColumn(name, F.col("__before") + F.col("__id") - F.col("__first") + 1).drop("__block", "__id", "__first", "__before")


def numbered_lines(spark: SparkSession, path: str, fields: dict[str, str], index: str) -> DataFrame:
    """A1 and A2 with the row number from 0, blank lines counted; numbers don't depend on how the file is cut."""
    lines = with_line_numbers(spark.read.text(path), index)
    return _columns(lines.withColumn(index, F.col(index) - 1), fields, None).drop("file")


def bad_rows(spark: SparkSession, path: str, fields: dict[str, str], checks: dict[str, Column] | None = None, missing: tuple[str, ...] = ("NA", "NaN", "nan"), where: Column | None = None) -> DataFrame:
    """(file, line, reason, value) of lines that lack a column, have a number that can't be read, or don't meet
    the check of a column, a condition on its value. `missing` stands for null. where: the lines to look at, by columns."""
    part = F.split(F.trim("value"), r"\s+")
    x = with_line_numbers(spark.read.text(path)).filter(F.trim("value") != "")
    raw = [F.try_element_at(part, F.lit(i + 1)).alias(f"__raw_{c}") for i, c in enumerate(fields)]
    x = x.select("file", "line", "value", *raw).withColumns({c: F.when(~F.col(f"__raw_{c}").isin(*missing), F.col(f"__raw_{c}")).try_cast(t) for c, t in fields.items()})
    if where is not None:
        x = x.filter(where)
    reason = F.lit(None).cast("string")
    for c, check in reversed((checks or {}).items()):
        reason = F.when(F.col(c).isNotNull() & ~F.coalesce(check, F.lit(False)), F.lit(f"{c} out of range")).otherwise(reason)
    for c in reversed(fields):
        unread = F.col(c).isNull() & ~F.col(f"__raw_{c}").isin(*missing)
        reason = F.when(F.col(f"__raw_{c}").isNull(), F.lit(f"no {c}")).when(unread, F.lit(f"{c} is no {fields[c]}")).otherwise(reason)
    return x.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("file", "line", "reason", "value")


def require_good(bad: DataFrame, show: int = 5) -> None:
    """(action) An error that names the first bad rows by file and line, and says how many there are."""
    n = bad.count()
    if n:
        first = [f"{r['file']}:{r['line']}: {r['reason']}" for r in bad.orderBy("file", "line").limit(show).collect()]
        raise ValueError(f"{n} bad rows; " + "; ".join(first))


BETA = {"cpg_id": "string", "beta": "double"}


def bad_betas(spark: SparkSession, path: str) -> DataFrame:
    """bad_rows() of probe tables: a probe's beta must be NA or lie within [0, 1]; lines of other probes are passed over."""
    return bad_rows(spark, path, BETA, {"beta": F.col("beta").between(0, 1)}, where=F.col("cpg_id").rlike(r"^cg\d+$"))


def read_pheno(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A4: phenotypes or covariates as CSV with header; NA is null."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="NA")


def read_tsv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A5: a tab-separated table that must have some columns; an error names those it lacks."""
    df = spark.read.csv(path, sep="\t", header=True)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return df


def read_scores(spark: SparkSession, path: str, schema: str = "rsID string, hm_chr string, hm_pos long, effect_allele string, other_allele string, effect_weight double") -> DataFrame:
    """A scoring file, gzip or plain, with `#` lines skipped."""
    return spark.read.schema(schema).csv(path, sep="\t", comment="#", header=True, enforceSchema=False)


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """Phenotype files FID, IID, y; the instance is the file's name. bad_rows(.., INSTANCE, where=FID is not "FID") lists what
    can't be read."""
    df = spark.read.text(path).withColumn("instance", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1))
    return _columns(df.filter(~F.col("value").startswith("FID")), INSTANCE, None)


def read_betas(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Probe tables, one file per sample: probes `cg<digits>` only, NA as null. Strict (action): bad_betas() are an error."""
    if strict:
        require_good(bad_betas(spark, path))
    df = spark.read.text(path).withColumn("sample_id", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))
    out = _columns(df, {"cpg_id": "string", "beta": "double"}, None)
    return out.filter(F.col("cpg_id").rlike(r"^cg\d+$"))


def same_probes(betas: DataFrame) -> DataFrame:
    """Probes that some file lacks or has twice."""
    n = betas.select("sample_id").distinct().count()
    return betas.groupBy("cpg_id").agg(F.count("*").alias("rows"), F.count_distinct("sample_id").alias("files")).filter((F.col("rows") != n) | (F.col("files") != n))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """People of a site."""
    return spark.read.schema(MANIFEST).csv(path, sep="\t", header=True)


def read_loci(spark: SparkSession, path: str) -> DataFrame:
    """Selected loci."""
    return spark.read.schema(LOCI).csv(path, sep="\t", header=True)


def write_table(df: DataFrame, path: str, fmt: str, partition: list[str] | None = None) -> None:
    """A11 (action): csv.gz, tsv or parquet."""
    w = df.write.partitionBy(*partition) if partition else df.write
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.option("header", "true").option("sep", "\t" if fmt == "tsv" else ",").option("compression", "gzip" if fmt == "csv.gz" else "none").csv(path)


def six_digits(c: Column) -> Column:
    """A number with six significant digits."""
    size = F.floor(F.log10(F.abs(c))).cast("int")
    scale = F.pow(F.lit(10.0), F.lit(5) - size)
    return F.when(c == 0, 0.0).otherwise(F.round(c * scale) / scale)


def write_sumstats(df: DataFrame, path: str, numbers: list[str]) -> None:
    """A12 (action): summary statistics at six significant digits."""
    write_table(df.withColumns({c: six_digits(F.col(c)) for c in numbers}), path, "tsv")


def write_ld(ld: DataFrame, variants: DataFrame, path: str) -> None:
    """A13 (action): an LD panel as the upper triangle and its variant list, both by ancestry and locus, in order of j."""
    ld.repartition("pop", "locus").sortWithinPartitions("pop", "locus", "i", "j").write.partitionBy("pop", "locus").parquet(f"{path}/ld")
    variants.repartition("pop", "locus").sortWithinPartitions("pop", "locus", "j").write.partitionBy("pop", "locus").parquet(f"{path}/variants")


def merge_parts(spark: SparkSession, path: str, n: int, key: list[str], schema) -> DataFrame:
    """Parts written as part=0 .. part=n-1, all required, in key order."""
    df = spark.read.schema(schema).parquet(path)
    have = {r[0] for r in df.select("part").distinct().collect()}  # at most the number of parts
    if have != set(range(n)):
        raise ValueError(f"parts missing: {sorted(set(range(n)) - have)}, extra: {sorted(have - set(range(n)))}")
    return df.orderBy(*key)
