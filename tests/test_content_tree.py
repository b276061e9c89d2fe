import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from polyloci.operators import policy as P


def sha(b):
    return hashlib.sha256(b).hexdigest()


def files_of(spark, root):
    x = P.scan_files(spark, str(root))
    return x.select(F.regexp_replace("path", f"^file:(//)?{root}/", "").alias("path"), F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"))


def expected(root: Path, at: Path | None = None):
    """{path: (id, checksum, size)} of a directory, by recursion."""
    at = at or root
    out, ids, sums, size = {}, {}, [], 0
    for p in at.iterdir():
        if p.is_dir():
            out |= expected(root, p)
        else:
            data = p.read_bytes()
            out[str(p.relative_to(root))] = (sha(data), sha(data), len(data))
        i, c, n = out[str(p.relative_to(root))]
        ids[p.name] = i
        sums.append(c)
        size += n
    name = "" if at == root else str(at.relative_to(root))
    out[name] = (sha(b"".join(n.encode() + b"\0" + ids[n].encode() + b"\n" for n in sorted(ids))), sha("".join(sorted(sums)).encode()), size)
    return out


@pytest.fixture
def bundle(tmp_path):
    for path, text in {"manifest.tsv": "a\tb\n", "bed": "x", "phenotypes/L0_rep0.pheno": "1\n", "phenotypes/L0_rep1.pheno": "2\n", "phenotypes/deep/er/one": "", "loci.csv": "x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def test_tree_of_a_directory(spark, bundle):
    got = {r["path"]: (r["id"], r["checksum"], r["size"]) for r in P.content_tree(files_of(spark, bundle)).collect()}
    assert got == expected(bundle)
    assert got == {r["path"]: (r["id"], r["checksum"], r["size"]) for r in P.content_tree(files_of(spark, bundle).repartition(5)).collect()}


def test_one_byte_and_one_file_change_the_root(spark, bundle):
    root = lambda: P.content_tree(files_of(spark, bundle)).filter("path = ''").first()["id"]
    first = root()
    (bundle / "phenotypes/L0_rep0.pheno").write_text("3\n")
    second = root()
    (bundle / "phenotypes/new").write_text("")
    assert len({first, second, root()}) == 3


def test_verification_both_ways_and_all_the_way_down(spark, bundle):
    recorded = P.content_tree(files_of(spark, bundle))
    problems = lambda: {tuple(r) for r in P.verify_tree(recorded, files_of(spark, bundle)).collect()}
    assert problems() == set()
    (bundle / "manifest.tsv").write_text("tampered\n")
    (bundle / "phenotypes/L0_rep1.pheno").write_text("tampered\n")
    (bundle / "leftover.tsv").write_text("from another run\n")
    (bundle / "loci.csv").unlink()
    (bundle / "phenotypes/deep/er/one").unlink()
    (bundle / "phenotypes/also/new").mkdir(parents=True)
    (bundle / "phenotypes/also/new/file").write_text("")
    assert problems() == {("manifest.tsv", "changed"), ("phenotypes/L0_rep1.pheno", "changed"), ("leftover.tsv", "extra"), ("loci.csv", "missing"), ("phenotypes/deep", "missing"), ("phenotypes/also", "extra")}


def test_a_record_that_does_not_hash_to_its_id(spark, bundle):
    recorded = P.content_tree(files_of(spark, bundle))
    forged = recorded.withColumn("id", F.when(F.col("path") == "phenotypes/L0_rep0.pheno", "0").otherwise(F.col("id")))
    assert {tuple(r) for r in P.verify_tree(forged, files_of(spark, bundle)).collect()} == {("phenotypes/L0_rep0.pheno", "changed"), ("phenotypes", "record")}


def test_a_file_in_place_of_a_directory(spark, bundle):
    recorded = P.content_tree(files_of(spark, bundle))
    now = files_of(spark, bundle).filter("path NOT LIKE 'phenotypes/%'").unionByName(spark.createDataFrame([("phenotypes", 1, "0")], "path string, size int, sha256 string"))
    assert {tuple(r) for r in P.verify_tree(recorded, now).collect()} == {("phenotypes", "changed")}


def test_wide_directories_and_clashes(spark):
    wide = spark.range(50).select(F.concat(F.lit("d/f"), "id").alias("path"), F.lit(1).alias("size"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("sha256"))
    a, b = (P.content_tree(wide, fan=4).filter("path = ''").first()["id"] for _ in range(2))
    assert a == b != P.content_tree(wide.filter("path <> 'd/f7'"), fan=4).filter("path = ''").first()["id"]
    assert P.verify_tree(P.content_tree(wide, fan=4), wide, fan=4).count() == 0
    assert P.content_tree(wide, excluded=("d",)).count() == 0
    with pytest.raises(ValueError, match="twice"):
        P.content_tree(wide.unionByName(wide.limit(1)))
    clash = spark.createDataFrame([("a", 1, "x"), ("a/b", 1, "y")], "path string, size int, sha256 string")
    with pytest.raises(ValueError, match="both"):
        P.content_tree(clash)


def test_a_wide_directory_is_hashed_as_a_narrow_one(spark):
    wide = spark.range(200).select(F.concat(F.when(F.col("id") < 150, "a/f").otherwise("b/é"), "id").alias("path"), F.lit(1).alias("size"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("sha256"))
    got = {r["path"]: (r["id"], r["checksum"], r["size"]) for r in P.content_tree(wide, fan=4).collect()}
    for d, ids in (("a", range(150)), ("b", range(150, 200))):
        kids = sorted((f"{'f' if d == 'a' else 'é'}{i}".encode(), sha(str(i).encode())) for i in ids)
        assert got[d] == (sha(b"".join(n + b"\0" + i.encode() + b"\n" for n, i in kids)), sha("".join(sorted(i for _, i in kids)).encode()), len(kids))
