import datetime as dt
import gzip
import random

import pytest
from pyspark.sql import functions as F

from polyloci.sources import harvest as X
from polyloci.sources import readers as R
from polyloci.streaming import status as ST

T0 = dt.datetime(2024, 1, 1)


def test_line_numbers_do_not_depend_on_the_cut(spark, tmp_path):
    for name, n in (("a.bim", 500), ("b.bim", 3), ("c.bim", 0)):
        (tmp_path / name).write_text("".join("\n" if i % 50 == 7 else f"1 rs{i} 0 {i} A G\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = R.numbered_lines(spark, str(tmp_path), R.BIM, "vidx").collect()
            assert len(got) == 493 and all(r["vidx"] == r["bp"] for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bad_rows_by_file_and_line(spark, tmp_path):
    (tmp_path / "a.bim").write_text("1 rs1 0 100 A G\n\n1 rs2 x 200 C T\nX rs3 0 NA A G\n1 rs4 0\n")
    bad = [(r["file"].rsplit("/", 1)[1], r["line"], r["reason"]) for r in R.bad_rows(spark, f"{tmp_path}/a.bim", R.BIM).orderBy("line").collect()]
    assert bad == [("a.bim", 3, "cm is no double"), ("a.bim", 5, "no bp")]
    with pytest.raises(ValueError, match=r"2 bad rows; .*a.bim:3: cm is no double; .*a.bim:5: no bp"):
        R.read_bim(spark, f"{tmp_path}/a.bim", strict=True)
    assert R.read_bim(spark, f"{tmp_path}/a.bim").count() == 4
    (tmp_path / "good.bim").write_text("1 rs1 0 100 A G\n")
    assert R.read_bim(spark, f"{tmp_path}/good.bim", strict=True).count() == 1


def test_betas_out_of_range(spark, tmp_path):
    (tmp_path / "s1.txt").write_text("cg01 0.5\ncg02 NA\nrs9 7\ncg03 1\n")
    assert R.read_betas(spark, str(tmp_path), strict=True).count() == 3
    (tmp_path / "s2.txt").write_text("cg01 1.01\ncg02 -0.5\ncg03 inf\ncg04 abc\ncg05 NaN\ncg06\n")
    got = {(r["line"], r["reason"]) for r in R.bad_betas(spark, str(tmp_path)).collect()}
    assert got == {(1, "beta out of range"), (2, "beta out of range"), (3, "beta out of range"), (4, "beta is no double"), (6, "no beta")}
    with pytest.raises(ValueError, match=r"5 bad rows; .*s2.txt:1: beta out of range"):
        R.read_betas(spark, str(tmp_path), strict=True)


def test_harvest_of_files_that_differ(spark, tmp_path):
    def put(instance, **files):
        (tmp_path / instance).mkdir()
        for kind, text in files.items():
            (tmp_path / instance / f"cs.{kind}").write_text(text)

    put("L1_rep0", summary="CS_ID\tCS_LENGTH\tCS_PURITY\tMAX_PIP\tMAX_PIP_SNP\tBP\tBETA\tPOST-HOC_PROB_POP1\n1\t2\t0.9\t0.8\trs1\t100\t0.5,NA\t0.7\n2\t1\tNA\t0.99\trs5\t500\t1,2\t0.1\n",
        cs="#made by a tool\nSNP\tCS_ID\tCS_PIP\nrs1\t1\t0.8\nrs2\t1\t0.15\nrs5\t2\t0.99\n", snp="BP\tSNP\tPIP(CS1)\tPIP(CS2)\n100\trs1\t0.8\t0.1\n200\trs2\t0.15\t0\n300\trs3\tNA\t0\n")
    put("L1_rep1", summary="NULL\n", cs="NULL\n", snp="SNP\tBP\nrs1\t100\n")
    put("L1_rep2", summary="FAIL\n", cs="FAIL\n")
    put("L1_rep3", summary="", cs="CS_ID\tSNP\n", snp="SNP\tSNP\nrs1\trs1\n")
    put("L1_rep4", summary="A\tB\n1\t2\n", cs="CS_ID\tSNP\n1\trs2\textra\n")
    put("other", summary="CS_ID\n1\n")
    with gzip.open(tmp_path / "L1_rep2" / "cs.snp.gz", "wt") as f:
        f.write("SNP\nrs1\n")
    with gzip.open(tmp_path / "L1_rep1" / "cs.snp.gz", "wt") as f:
        f.write("ignored, as there is a plain one\n")
    truth = spark.createDataFrame([("L1_rep0", "rs2"), ("L1_rep0", "rs5"), ("L1_rep0", "rs9"), *[(f"L1_rep{i}", None) for i in range(1, 5)]], "instance string, snp string")
    got = X.harvest_outputs(X.scan_outputs(spark, str(tmp_path)), truth, ["EUR", "AFR"])
    status = {(r["instance"][-4:], r["kind"]): r["status"] for r in got["files"].collect()}
    assert status == {
        ("rep0", "summary"): "table", ("rep0", "cs"): "table", ("rep0", "snp"): "table", ("rep1", "summary"): "null", ("rep1", "cs"): "null", ("rep1", "snp"): "table", ("rep2", "summary"): "fail", ("rep2", "cs"): "fail",
        ("rep2", "snp"): "table", ("rep3", "cs"): "empty", ("rep3", "snp"): "unreadable", ("rep4", "summary"): "unreadable", ("rep4", "cs"): "unreadable", ("ther", "summary"): "no_truth",
    }
    one, two = got["sets"].orderBy("cs_id").collect()
    assert (one["instance"], one["cs_length"], one["cs_purity"], one["beta_EUR"], one["beta_AFR"], one["prob_causal_EUR"], one["prob_causal_AFR"]) == ("L1_rep0", 2, 0.9, 0.5, None, 0.7, None)
    assert (one["n_causal_in_cs"], one["contains_causal"], one["causal_snps_in_cs"], one["top_is_causal"]) == (1, True, "rs2", False)
    assert (two["cs_purity"], two["top_is_causal"], two["n_causal_in_cs"]) == (None, True, 1)
    assert {(r["snp"], r["cs_id"], r["is_causal"], r["bp"]) for r in got["members"].collect()} == {("rs1", 1, False, None), ("rs2", 1, True, None), ("rs5", 2, True, None)}
    pips = {r["snp"]: (r["pip"], r["is_causal"], r["bp"]) for r in got["variants"].collect()}
    assert pips["rs1"][0] == pytest.approx(0.82) and pips["rs2"] == (pytest.approx(0.15), True, 200) and pips["rs3"][0] is None


def stream_of(spark, tmp_path, rows, schema, batches):
    """A stream of `batches` files in order, one a micro-batch."""
    each = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * each : (i + 1) * each], schema).coalesce(1).write.json(f"{tmp_path}/in/{i:03d}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
    return files.json(f"{tmp_path}/in/*")


SCHEMA = "ts timestamp, site long, block long, round long, num_samples long, train_time_sec double, value double, k long"


def events(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = T0 + dt.timedelta(minutes=i - rng.randint(0, 25))  # up to 25 minutes late
        rows.append((ts, i % 4, i // 4, i // 40, 1 + i % 7, float(i % 11), float(i), i % 3))
        if rng.random() < 0.2:
            rows.append(rows[-1])  # repeated
    return rows


@pytest.mark.parametrize("every", [2, 100])
def test_updates_by_key_equal_the_batch(spark, tmp_path, every):
    rows = events(1)
    batch = spark.createDataFrame(rows, SCHEMA)
    stream = stream_of(spark, tmp_path, rows, SCHEMA, 6)
    parts, seen = ST.run_keyed(ST.round_parts(stream, "20 minutes", "2 hours"), "rounds", ["start", "round"], every)
    assert seen["batches"] >= 6 and seen["dropped"] == 0
    assert sorted(map(tuple, ST.rounds_of(parts, 4).collect())) == sorted(map(tuple, ST.round_progress(batch, 4).collect()))
    parts, seen = ST.run_keyed(ST.pool_parts(stream, ["k"], "value", "20 minutes", "2 hours"), "pool", ["start", "k"], every)
    assert seen["dropped"] == 0
    assert sorted(map(tuple, ST.pool_of(parts, ["k"], "value").collect())) == sorted(map(tuple, ST.stream_pool(batch, ["k"], "value").collect()))


def test_what_comes_behind_the_watermark_is_counted(spark, tmp_path):
    rows = sorted(events(2))
    late = [(T0 - dt.timedelta(days=9), 1, 9999, 0, 1000, 1.0, 1.0, 0)]
    stream = stream_of(spark, tmp_path, rows + late, SCHEMA, 5)
    parts, seen = ST.run_keyed(ST.round_parts(stream, "20 minutes", "5 minutes"), "rounds", ["start", "round"])
    want = {tuple(r) for r in ST.round_progress(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    assert seen["dropped"] >= 1 and {tuple(r) for r in ST.rounds_of(parts, 4).collect()} == want
