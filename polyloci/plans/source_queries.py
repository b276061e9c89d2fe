"""Sources and sinks: a given table is written as a study's file and read back through the reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import new_path
from ..sources import readers as S
from .bindings import query, r, table


@query("SELECT (p_partkey % 5 + 1)::VARCHAR AS chrom, p_partkey::VARCHAR AS snp_id, p_size / 4.0::DOUBLE AS cm, p_partkey * 1000 AS bp, 'A' AS a1, 'G' AS a2, 's' AS site FROM part")
def a1_variant_table(spark, sf):
    path, k = new_path(spark, "bim"), F.col("p_partkey")
    table(spark, sf, "part").select(F.concat_ws("\t", k % 5 + 1, k, F.col("p_size") / 4, k * 1000, F.lit("A"), F.lit("G"))).write.text(path)
    return S.read_bim(spark, path, "s")


@query("SELECT c_nationkey::VARCHAR AS fid, c_custkey::VARCHAR AS iid, '0' AS father, '0' AS mother, (1 + c_custkey % 2)::VARCHAR AS sex, '-9' AS pheno FROM customer")
def a2_sample_table(spark, sf):
    path, zero = new_path(spark, "fam"), F.lit("0")
    table(spark, sf, "customer").select(F.concat_ws(" ", "c_nationkey", "c_custkey", zero, zero, 1 + F.col("c_custkey") % 2, F.lit("-9"))).write.text(path)
    return S.read_fam(spark, path)


@query("SELECT c_nationkey::VARCHAR AS FID, c_custkey::VARCHAR AS IID, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS BMI FROM customer")
def a4_phenotypes(spark, sf):
    path = new_path(spark, "pheno")
    bmi = F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal")).alias("BMI")
    table(spark, sf, "customer").select(F.col("c_nationkey").alias("FID"), F.col("c_custkey").alias("IID"), bmi).write.csv(path, header=True, nullValue="NA")
    return S.read_pheno(spark, path, "FID string, IID string, BMI double")


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier")
def a5_strict_tsv(spark, sf):
    path = new_path(spark, "tsv")
    S.write_table(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, "tsv")
    return S.read_tsv(spark, path, ["s_suppkey", "s_name", "s_nationkey"])


@query("SELECT p_partkey::VARCHAR AS rsID, (p_partkey % 5 + 1)::VARCHAR AS hm_chr, p_partkey * 1000 AS hm_pos, 'A' AS effect_allele, 'G' AS other_allele, p_retailprice AS effect_weight FROM part")
def a6_scoring_file(spark, sf):
    path, k = new_path(spark, "scores"), F.col("p_partkey")
    x = table(spark, sf, "part").select(k.alias("rsID"), (k % 5 + 1).alias("hm_chr"), (k * 1000).alias("hm_pos"), F.lit("A").alias("effect_allele"), F.lit("G").alias("other_allele"), F.col("p_retailprice").alias("effect_weight"))
    x.write.csv(path, sep="\t", header=True, compression="gzip")
    return S.read_scores(spark, path)


@query("SELECT c_nationkey::VARCHAR AS FID, c_custkey::VARCHAR AS IID, c_mktsegment AS superpopulation FROM customer")
def a9_site_manifest(spark, sf):
    path = new_path(spark, "manifest")
    S.write_table(table(spark, sf, "customer").select(F.col("c_nationkey").alias("FID"), F.col("c_custkey").alias("IID"), F.col("c_mktsegment").alias("superpopulation")), path, "tsv")
    return S.read_manifest(spark, path)


@query("SELECT 'L' || p_partkey AS locus_id, 'W' || p_partkey AS window_id, (p_partkey % 5)::VARCHAR AS chrom, p_partkey * 10 AS start_bp, p_partkey * 10 + p_size AS end_bp, p_retailprice AS divergence_score, p_brand AS stratum, p_size::BIGINT AS n_variants_in_window, (p_size // 2)::BIGINT AS n_tag_snps FROM part")
def a9_loci(spark, sf):
    path, k = new_path(spark, "loci"), F.col("p_partkey")
    x = table(spark, sf, "part").select(F.concat(F.lit("L"), k).alias("locus_id"), F.concat(F.lit("W"), k).alias("window_id"), (k % 5).alias("chrom"), (k * 10).alias("start_bp"), (k * 10 + F.col("p_size")).alias("end_bp"), F.col("p_retailprice").alias("divergence_score"), F.col("p_brand").alias("stratum"), F.col("p_size").alias("n_variants_in_window"), F.floor(F.col("p_size") / 2).alias("n_tag_snps"))
    S.write_table(x, path, "tsv")
    return S.read_loci(spark, path)


@query("SELECT 'csv.gz' AS kind, o_orderkey, round(o_totalprice, 6) AS o_totalprice, o_orderpriority FROM orders UNION ALL SELECT 'tsv', o_orderkey, round(o_totalprice, 6), o_orderpriority FROM orders UNION ALL SELECT 'parquet', o_orderkey, round(o_totalprice, 6), o_orderpriority FROM orders")
def a11_result_sink(spark, sf):
    x = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    out = None
    for kind in ("csv.gz", "tsv", "parquet"):
        path = new_path(spark, "results")
        S.write_table(x, path, kind)
        back = spark.read.schema(x.schema)
        back = back.parquet(path) if kind == "parquet" else back.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
        back = back.select(F.lit(kind).alias("kind"), "o_orderkey", r("o_totalprice").alias("o_totalprice"), "o_orderpriority")
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT o_orderkey, CASE WHEN v = 0 THEN 0.0 ELSE round(v * pow(10.0::DOUBLE, 5 - floor(log10(abs(v))))) / pow(10.0::DOUBLE, 5 - floor(log10(abs(v)))) END AS beta FROM (SELECT o_orderkey, (o_totalprice / 7.0 - 20000)::DOUBLE AS v FROM orders)")
def a12_sumstats_sink(spark, sf):
    path = new_path(spark, "sumstats")
    S.write_sumstats(table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 7.0 - 20000).alias("beta")), path, ["beta"])
    return spark.read.schema("o_orderkey long, beta double").csv(path, sep="\t", header=True)


@query("SELECT 'ld' AS kind, l_linenumber AS pop, (l_suppkey % 5)::INT AS locus, l_orderkey AS i, l_partkey AS j, round(l_discount, 6) AS value FROM lineitem UNION ALL SELECT 'variants', p_size::INT % 7, (p_partkey % 5)::INT, 0, p_partkey, round(p_retailprice, 6) FROM part")
def a13_ld_panel(spark, sf):
    path = new_path(spark, "panel")
    ld = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("pop"), (F.col("l_suppkey") % 5).alias("locus"), F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_discount").alias("value"))
    variants = table(spark, sf, "part").select((F.col("p_size") % 7).alias("pop"), (F.col("p_partkey") % 5).alias("locus"), F.lit(0).cast("long").alias("i"), F.col("p_partkey").alias("j"), F.col("p_retailprice").alias("value"))
    S.write_ld(ld, variants, path)
    read = lambda kind: spark.read.parquet(f"{path}/{kind}").select(F.lit(kind).alias("kind"), F.col("pop").cast("int").alias("pop"), F.col("locus").cast("int").alias("locus"), "i", "j", r("value").alias("value"))
    return read("ld").unionByName(read("variants"))


@query("SELECT o_orderkey, o_custkey, (o_orderkey % 4)::INT AS part FROM orders")
def a14_merge_parts(spark, sf):
    path = new_path(spark, "parts")
    x = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 4).cast("int").alias("part"))
    S.write_table(x, path, "parquet", ["part"])
    return S.merge_parts(spark, path, 4, ["o_orderkey"], "o_orderkey long, o_custkey long, part int")


@query("""SELECT (row_number() OVER (ORDER BY p_partkey) - 1) % 1000000000 AS vidx, p_partkey::VARCHAR AS snp_id, p_partkey * 1000 AS bp FROM part""")
def a1_numbered_lines(spark, sf):
    path, k = new_path(spark, "bim"), F.col("p_partkey")
    lines = table(spark, sf, "part").orderBy("p_partkey").select(F.concat_ws(" ", k % 5 + 1, k, F.lit(0), k * 1000, F.lit("A"), F.lit("G")))
    lines.coalesce(1).write.text(path)  # one file, as its order is the order of the genotypes
    return S.numbered_lines(spark, path, S.BIM, "vidx").select("vidx", "snp_id", "bp")


@query("SELECT 'y is no double' AS reason, 'f' || c_custkey || ' i' || c_custkey || ' 1.5.' || c_custkey AS value FROM customer WHERE c_custkey % 7 = 1 UNION ALL SELECT 'no IID', 'f' || c_custkey FROM customer WHERE c_custkey % 7 = 2")
def a7_bad_rows(spark, sf):
    path, k = new_path(spark, "instances"), F.col("c_custkey")
    y = F.when(k % 7 == 1, F.concat(F.lit("1.5."), k)).when(k % 7 == 3, F.lit("NA")).otherwise(F.col("c_acctbal").cast("string"))
    own = F.concat(F.lit("f"), k)
    table(spark, sf, "customer").select((k % 10).alias("instance"), F.when(k % 7 == 2, own).otherwise(F.concat_ws(" ", own, F.concat(F.lit("i"), k), y)).alias("value")).write.partitionBy("instance").text(path)
    return S.bad_rows(spark, f"{path}/*", S.INSTANCE).select("reason", "value")


@query("""SELECT 'sets' AS kind, (s_nationkey)::VARCHAR AS instance, (1 + s_suppkey % 2)::VARCHAR AS key, round(max(s_suppkey % 50) / 50.0::DOUBLE, 9) AS value, max((s_suppkey % 11 = 0)::INT) = 1 AS causal FROM supplier WHERE s_nationkey % 5 = 0 AND s_suppkey % 3 = 0 GROUP BY 2, 3
  UNION ALL SELECT 'members', s_nationkey::VARCHAR, 's' || s_suppkey, round((s_suppkey % 50) / 50.0::DOUBLE, 9), s_suppkey % 11 = 0 FROM supplier WHERE s_nationkey % 5 = 0 AND s_suppkey % 3 = 0
  UNION ALL SELECT 'variants', s_nationkey::VARCHAR, 's' || s_suppkey, round(1 - (1 - (s_suppkey % 50) / 100.0::DOUBLE) * (1 - (s_suppkey % 7) / 10.0::DOUBLE), 9), s_suppkey % 11 = 0 FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 5 = 0 AND s_suppkey % 3 = 0)
  UNION ALL SELECT 'files', n::VARCHAR, k, NULL, CASE WHEN n % 5 = 0 THEN TRUE END FROM (SELECT DISTINCT s_nationkey AS n FROM supplier), (VALUES ('summary'), ('cs'), ('snp')) t(k)
    WHERE n % 5 > 0 OR k = 'snp' OR n IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)""")
def a10_harvest(spark, sf):
    """A nation is a fit, a supplier a variant; of the fits some converged without sets, some failed and some left an empty file."""
    from ..sources.harvest import harvest_outputs

    path, k, n = new_path(spark, "fits"), F.col("s_suppkey"), F.col("s_nationkey")
    x = table(spark, sf, "supplier").select(k, n)
    snp = F.concat(F.lit("s"), k)
    body = lambda header, line, keep=F.lit(True): F.concat(F.lit(header), F.array_join(F.array_sort(F.collect_list(F.when(keep, line))), ""))
    files = x.groupBy(n.alias("instance")).agg(
        F.map_from_arrays(
            F.array(F.lit("cs"), F.lit("snp")),
            F.array(
                body("# members\nCS_ID\tSNP\tCS_PIP\tBETA\n", F.concat_ws("\t", 1 + k % 2, snp, k % 50 / 50.0, F.lit("0.5,NA\n")), k % 3 == 0),
                body("SNP\tBP\tPIP(CS1)\tPIP(CS2)\n", F.concat_ws("\t", snp, k * 10, k % 50 / 100.0, F.concat((k % 7 / 10.0).cast("string"), F.lit("\n")))),
            ),
        ).alias("f"),
        F.count_if(k % 3 == 0).alias("members"),
    )
    sets = x.filter(k % 3 == 0).groupBy(n.alias("instance"), (1 + k % 2).alias("cs")).agg((F.max(k % 50) / 50.0).alias("top"))
    sets = sets.groupBy("instance").agg(F.concat(F.lit("MAX_PIP\tCS_ID\n"), F.array_join(F.collect_list(F.concat("top", F.lit("\t"), "cs", F.lit("\n"))), "")).alias("summary"))
    mark = F.when(F.col("instance") % 5 == 1, "NULL\n").when(F.col("instance") % 5 == 2, "FAIL\n").when(F.col("instance") % 5 == 3, "SNP\tCS_ID\n")
    files = files.join(sets, "instance", "left").select("instance", "members", F.explode(F.map_concat("f", F.create_map(F.lit("summary"), F.coalesce("summary", F.lit("CS_ID\n"))))).alias("kind", "value"))
    files.select("instance", "kind", F.coalesce(mark, F.col("value")).alias("value")).repartition("instance", "kind").write.partitionBy("instance", "kind").option("lineSep", "\n").text(path)
    back = spark.read.schema("value string, instance string, kind string").text(path, wholetext=True).select("instance", "kind", "value")
    truth = x.filter(n % 5 != 4).select(n.cast("string").alias("instance"), F.when(k % 11 == 0, snp).alias("snp"))
    got = harvest_outputs(back, truth, ["EUR", "AFR"])
    row = lambda name, key, value, causal: got[name].select(F.lit(name).alias("kind"), "instance", key.cast("string").alias("key"), value.alias("value"), causal.alias("causal"))
    status = got["files"].filter("status <> 'empty' OR instance % 5 > 0").select(F.lit("files").alias("kind"), "instance", F.col("kind").alias("key"), F.lit(None).cast("double").alias("value"), F.when(F.col("status") == "table", True).alias("causal"))
    out = row("sets", F.col("cs_id"), r("max_pip", 9), F.col("contains_causal")).unionByName(row("members", F.col("snp"), r("cs_pip", 9), F.col("is_causal")))
    return out.unionByName(row("variants", F.col("snp"), r("pip", 9), F.col("is_causal"))).unionByName(status)
