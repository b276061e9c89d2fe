import corpus_pipeline as C
from polyloci.llm.queries import table


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    names, n = docs.columns, docs.count()
    first = docs.unionByName(docs.limit(50).selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars"))
    assert [name for name, _ in C.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    kept = C.language_id(spark, first, sf)
    assert kept.columns == names and kept.count() >= 0.99 * first.count()
    once = C.exact_dedup(spark, kept, sf)
    assert once.columns == names and once.count() == once.selectExpr("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t").distinct().count()
    near = C.near_dedup(spark, once, sf)
    assert near.columns == names and near.count() <= once.count()
    clean = C.decontamination(spark, near, sf)
    items = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    assert clean.columns == names
    texts = [r["text"] for r in clean.collect()]
    assert not any(i in t for i in items for t in texts) and len(texts) > 0.85 * n
    assert {r["doc_id"] for r in C.packing(spark, clean, sf).select("doc_id").distinct().collect()} == {r["doc_id"] for r in clean.collect()}


def test_whole_run(spark, small):
    out = C.run(spark, small)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def written(docs, spark, folder):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    table(spark, "/root/testdata/sf0.001", "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_whole_run_on_odd_rows(spark, odd_docs, tmp_path):
    sf = written(odd_docs, spark, tmp_path)
    docs = table(spark, sf, "documents")
    counts = [docs.count()]
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)
    texts = [r["text"] for r in docs.collect()]
    assert all(t and t.strip() for t in texts) and len({t.lower() for t in texts}) == len(texts)
    out = C.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in docs.collect()}


def test_whole_run_on_no_rows(spark, no_docs, tmp_path):
    assert C.run(spark, written(no_docs, spark, tmp_path)).count() == 0
