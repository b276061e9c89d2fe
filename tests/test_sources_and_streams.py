import gzip

import pytest
from pyspark.sql import functions as F

from polyloci.sources import readers as R
from polyloci.sources.bed import MAGIC, read_bed
from polyloci.streaming import status as ST

CODE = {2: 0, None: 1, 1: 2, 0: 3}


def write_bed(path, rows):
    out = bytearray(MAGIC)
    for row in rows:
        for s in range(0, len(row), 4):
            out.append(sum(CODE[d] << (2 * k) for k, d in enumerate(row[s : s + 4])))
    path.write_bytes(bytes(out))


def test_packed_genotypes(spark, tmp_path):
    rows = [[(i * 7 + s) % 4 if (i * 7 + s) % 4 < 3 else None for s in range(10)] for i in range(23)]
    write_bed(tmp_path / "x.bed", rows)
    path = f"file://{tmp_path}/x.bed"
    assert {r["vidx"]: r["dosages"] for r in read_bed(spark, path, 10, 23).collect()} == dict(enumerate(rows))
    some = read_bed(spark, path, 10, 23, indexes=[20, 3], allele=2).collect()
    assert {r["vidx"]: r["dosages"] for r in some} == {k: [None if d is None else 2 - d for d in rows[k]] for k in (3, 20)}
    (tmp_path / "bad.bed").write_bytes(b"abc123")
    with pytest.raises(Exception, match="no packed genotype file"):
        read_bed(spark, f"file://{tmp_path}/bad.bed", 10, 1).collect()


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.bim").write_text("1 rs1 0 100 A G\n 1\trs2  0.5 200 C T \n\nX rs3 0 x A G\n")
    assert [tuple(r) for r in R.read_bim(spark, f"{tmp_path}/a.bim").collect()] == [("1", "rs1", 0.0, 100, "A", "G"), ("1", "rs2", 0.5, 200, "C", "T"), ("X", "rs3", 0.0, None, "A", "G")]
    got = R.numbered_lines(spark, f"{tmp_path}/a.bim", R.BIM, "vidx").select("vidx", "snp_id").collect()
    assert [(r["vidx"], r["snp_id"]) for r in got] == [(0, "rs1"), (1, "rs2"), (3, "rs3")]
    (tmp_path / "a.fam").write_text("f i 0 0 1 -9\n")
    assert R.read_fam(spark, f"{tmp_path}/a.fam", "s").first()["site"] == "s"
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    assert R.read_tsv(spark, f"{tmp_path}/t.tsv", ["a"]).count() == 1
    with pytest.raises(ValueError, match="no column c, d"):
        R.read_tsv(spark, f"{tmp_path}/t.tsv", ["a", "c", "d"])
    with gzip.open(tmp_path / "s.txt.gz", "wt") as f:
        f.write("#note\nrsID\thm_chr\thm_pos\teffect_allele\tother_allele\teffect_weight\nrs1\t1\t5\tA\tG\t0.5\n")
    assert R.read_scores(spark, f"{tmp_path}/s.txt.gz").first()["effect_weight"] == 0.5


def test_many_files(spark, tmp_path):
    d = tmp_path / "i"
    d.mkdir()
    for n in ("L1_a_rep0", "L1_a_rep1"):
        (d / f"{n}.pheno").write_text("FID IID y\nf1 i1 1.5\nf2 i2 NA\n")
    rows = {(r["instance"], r["IID"]): r["y"] for r in R.read_instances(spark, str(d)).collect()}
    assert rows == {(n, i): y for n in ("L1_a_rep0", "L1_a_rep1") for i, y in (("i1", 1.5), ("i2", None))}
    b = tmp_path / "b"
    b.mkdir()
    (b / "s1.txt").write_text("cg01 0.5\ncg02 NA\nrs9 0.1\n")
    (b / "s2.txt").write_text("cg01 0.25\n")
    betas = R.read_betas(spark, str(b))
    assert betas.count() == 3 and [r["cpg_id"] for r in R.same_probes(betas).collect()] == ["cg02"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 123456.789, "a"), (2, 0.000123456789, "b"), (3, 0.0, "c")], "k int, v double, s string")
    R.write_sumstats(df, f"{tmp_path}/ss", ["v"])
    assert [r["v"] for r in spark.read.csv(f"{tmp_path}/ss", sep="\t", header=True, schema="k int, v double, s string").orderBy("k").collect()] == [123457.0, 0.000123457, 0.0]
    R.write_table(df, f"{tmp_path}/gz", "csv.gz")
    assert spark.read.csv(f"{tmp_path}/gz", header=True).count() == 3
    ld = spark.createDataFrame([("a", 1, 0, 1, 0.5)], "pop string, locus int, i int, j int, r double")
    v = spark.createDataFrame([("a", 1, 0, "rs1")], "pop string, locus int, j int, snp string")
    R.write_ld(ld, v, f"{tmp_path}/ld")
    assert spark.read.parquet(f"{tmp_path}/ld/ld").count() == 1 and spark.read.parquet(f"{tmp_path}/ld/variants").count() == 1
    df.withColumn("part", F.col("k") - 1).write.partitionBy("part").parquet(f"{tmp_path}/parts")
    assert [r["k"] for r in R.merge_parts(spark, f"{tmp_path}/parts", 3, ["k"], "k int, v double, s string, part int").collect()] == [1, 2, 3]
    with pytest.raises(ValueError, match="parts missing"):
        R.merge_parts(spark, f"{tmp_path}/parts", 4, ["k"], "k int, v double, s string, part int")


def test_streams_equal_batches(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=7 * i), i % 3, i % 4 != 0, "x" if i % 8 == 0 else None, i // 2, i % 3, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, site long, online boolean, error string, block long, k long, value double")
    assert {r["status"] for r in ST.site_status(df).collect()} <= {"online", "degraded", "offline", "unknown"}
    pooled = {r["k"]: (r["value"], r["n_blocks"]) for r in ST.stream_pool(df.unionByName(df), ["k"], "value").collect()}
    assert sum(n for _, n in pooled.values()) == 60
    done = ST.round_progress(df.select((F.col("block") % 2).alias("round"), "site", F.lit(1).alias("num_samples"), F.col("value").alias("train_time_sec")), 3)
    assert all(r["complete"] for r in done.collect())
