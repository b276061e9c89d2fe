"""A10: output tables of many fits. Each file states its own columns, or that it has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import split_per_pop

#: Columns that a table must have, by kind of file.
REQUIRED = {"summary": ["CS_ID"], "cs": ["CS_ID", "SNP"], "snp": ["SNP"]}
#: Comma lists with a value for each ancestry, and their names in the result.
LISTS = {"BETA": "beta", "SE": "se", "-LOG10P": "log10p", "REF_FRQ": "frq"}
MISSING = ["NA", "NaN", "nan", ""]


def scan_outputs(spark: SparkSession, root: str, name: str = "cs") -> DataFrame:
    """(instance, kind, value): the text of <root>/<instance>/<name>.summary, .cs and .snp, plain or, where there is no plain
    one, gzip. A file is a row: the tables of one fit. Spark passes over a file without a byte, as if it were not there."""
    x = spark.read.text(f"{root.rstrip('/')}/*/{name}.*", wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    part = rf"/([^/]+)/{name}\.(summary|cs|snp)(\.gz)?$"
    x = x.withColumns({"instance": F.regexp_extract("p", part, 1), "kind": F.regexp_extract("p", part, 2), "gz": F.regexp_extract("p", part, 3)}).filter("kind <> ''")
    return x.withColumn("n", F.row_number().over(W.partitionBy("instance", "kind").orderBy("gz"))).filter("n = 1").select("instance", "kind", "value")


def file_status(files: DataFrame) -> DataFrame:
    """files with lines, header and status: table, empty, null (converged without a set), fail (not converged), or unreadable: a
    required column is not there, names are repeated, or a row has more cells than names."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: (x != "") & ~x.startswith("#"))
    x = files.withColumn("lines", lines).withColumn("header", F.split(F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit("")), "\t"))
    has_all = F.lit(False)
    for kind, names in REQUIRED.items():
        has_all = has_all | ((F.col("kind") == kind) & (F.size(F.array_except(F.array(*[F.lit(n) for n in names]), "header")) == 0))
    ragged = F.exists("lines", lambda x: F.size(F.split(x, "\t")) > F.size("header")) | (F.size(F.array_distinct("header")) < F.size("header"))
    status = F.when(F.size("lines") == 0, "empty").when(F.array_contains("header", "FAIL"), "fail").when(F.array_contains("header", "NULL"), "null")
    return x.withColumn("status", status.when(~has_all | ragged, "unreadable").when(F.size("lines") == 1, "empty").otherwise("table"))


def _text(name: str) -> Column:
    cell = F.try_element_at("row", F.lit(name))
    return F.when(~cell.isin(*MISSING), cell)


def _number(name: str, kind: str = "double") -> Column:
    return _text(name).try_cast("double").cast(kind)


def harvest_outputs(files: DataFrame, truth: DataFrame, pops: list[str]) -> dict[str, DataFrame]:
    """A10: sets, members and variants of all fits, and files with the status of each file. files: instance, kind, value; truth:
    instance, snp, one row a true variant or one with a null snp.

    sets: one row a credible set with its true members, which come from the member table. variants: those of fits that have
    a set, with their probability over all components; null where one is missing. Files of instances without truth have
    the status no_truth and give no rows; so do those that are no table. NA and what is no number are null.
    """
    known = truth.select("instance").distinct().withColumn("known", F.lit(True))
    x = file_status(files).join(known, "instance", "left").withColumn("status", F.when(F.col("known").isNull(), "no_truth").otherwise(F.col("status")))
    rows = x.filter("status = 'table'").select("instance", "kind", "header", F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line"))
    cells = F.split("line", "\t")
    padded = F.concat(cells, F.array_repeat(F.lit(None).cast("string"), F.size("header") - F.size(cells)))
    rows = rows.select("instance", "kind", F.map_from_arrays("header", padded).alias("row"))
    causal = truth.filter("snp IS NOT NULL").select("instance", "snp", F.lit(True).alias("is_causal")).distinct()
    no = F.lit(False)

    def lists(df: DataFrame) -> DataFrame:
        for column, name in LISTS.items():
            df = df.withColumn(f"__{name}", F.try_element_at("row", F.lit(column)))
            df = df.withColumns(split_per_pop(f"__{name}", pops, name)).drop(f"__{name}")
        return df.drop("row")

    members = rows.filter("kind = 'cs'").select("instance", _number("CS_ID", "long").alias("cs_id"), _text("SNP").alias("snp"), _number("BP", "long").alias("bp"), _number("CS_PIP").alias("cs_pip"), _number("OVRL_PIP").alias("ovrl_pip"), "row")
    members = lists(members.join(causal, ["instance", "snp"], "left").withColumn("is_causal", F.coalesce("is_causal", no)))
    hits = members.filter("is_causal").groupBy("instance", "cs_id").agg(F.count_distinct("snp").alias("n_causal_in_cs"), F.array_join(F.array_sort(F.collect_set("snp")), ",").alias("causal_snps_in_cs"))
    probs = [_number(f"POST-HOC_PROB_POP{i}").alias(f"prob_causal_{p}") for i, p in enumerate(pops, 1)]
    sets = rows.filter("kind = 'summary'").select("instance", _number("CS_ID", "long").alias("cs_id"), _number("CS_LENGTH", "long").alias("cs_length"), _number("CS_PURITY").alias("cs_purity"), _number("MAX_PIP").alias("max_pip"), _text("MAX_PIP_SNP").alias("max_pip_snp"), _number("BP", "long").alias("bp"), *probs, "row")
    top = causal.select("instance", F.col("snp").alias("max_pip_snp"), F.col("is_causal").alias("top_is_causal"))
    sets = lists(sets.join(hits, ["instance", "cs_id"], "left").join(top, ["instance", "max_pip_snp"], "left"))
    sets = sets.withColumn("n_causal_in_cs", F.coalesce("n_causal_in_cs", F.lit(0))).withColumn("contains_causal", F.col("n_causal_in_cs") > 0).withColumn("top_is_causal", F.coalesce("top_is_causal", no)).na.fill("", ["causal_snps_in_cs"])
    pips = F.transform(F.filter(F.map_entries("row"), lambda e: e["key"].startswith("PIP(")), lambda e: e["value"].try_cast("double"))
    variants = rows.filter("kind = 'snp'").join(sets.select("instance").distinct(), "instance", "left_semi").select("instance", _text("SNP").alias("snp"), _number("BP", "long").alias("bp"), pips.alias("pips")).filter(F.size("pips") > 0)
    pip = 1 - F.aggregate("pips", F.lit(1.0), lambda acc, p: acc * (1 - p))
    variants = variants.withColumn("pip", pip).drop("pips").join(causal, ["instance", "snp"], "left").withColumn("is_causal", F.coalesce("is_causal", no))
    return {"sets": sets, "members": members, "variants": variants, "files": x.select("instance", "kind", "status")}
