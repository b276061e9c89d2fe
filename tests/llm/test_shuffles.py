import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyloci.llm import binary_output as B
from polyloci.llm.bpe_tokens import WordBpe
from polyloci.llm.feistel import permute, permuted, unpermute
from polyloci.llm.queries import op2_token_id_output, table, tokenizer_path
from polyloci.llm.sharding import assign_shards


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 1025])
def test_permutation_is_one_to_one_and_the_same_everywhere(spark, n):
    places = [permute(x, n, 99) for x in range(n)]
    assert sorted(places) == list(range(n))
    assert [unpermute(y, n, 99) for y in places] == list(range(n))
    assert [r[0] for r in spark.range(n).orderBy("id").select(permuted(F.col("id"), n, 99)).collect()] == places


def test_permutation_mixes():
    places = np.array([permute(x, 5000, 1) for x in range(5000)])
    assert abs(np.corrcoef(np.arange(5000), places)[0, 1]) < 0.05
    assert (places != np.array([permute(x, 5000, 2) for x in range(5000)])).mean() > 0.99


def test_shards_of_odd_rows(spark, odd_docs, no_docs):
    rows = assign_shards(odd_docs, shards=4).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd_docs.collect())
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(4)) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    again = assign_shards(odd_docs.repartition(7), shards=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert assign_shards(no_docs).count() == 0


def check_output(rows, texts, sequence):
    """Each id of each document is in one piece, the pieces of a sequence follow one another, and files say what rows say."""
    bpe = WordBpe.opened(tokenizer_path())
    got, taken, read = Counter(), {}, {}
    for r in rows:
        if (r["path"], r["byte_offset"]) not in read:
            read[r["path"], r["byte_offset"]] = B.read_slots(r["path"], r["byte_offset"] // (2 * sequence), 1, sequence)[0]
        whole = read[r["path"], r["byte_offset"]]
        ids = whole[r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"] and len(ids) == r["length"]
        got[r["doc_id"]] += len(ids)
        taken.setdefault(r["slot"], []).append((r["offset"], r["length"], len(whole)))
    for own in taken.values():
        own.sort()
        assert [o for o, _, _ in own] == [sum(n for _, n, _ in own[:i]) for i in range(len(own))] and sum(n for _, n, _ in own) == own[0][2]
    want = Counter()
    for doc, text in texts:
        want[doc] += len(bpe.ids(text)) // 4 + 1
    assert got == want and sorted(taken) == list(range(len(taken)))
    return taken


def test_shards_are_written_whole_and_read_back(spark, odd_docs, no_docs, tmp_path):
    bpe = WordBpe.opened(tokenizer_path())
    rows = B.write_training_order(odd_docs, tokenizer_path(), f"file://{tmp_path}/a", sequence=64).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    taken = check_output(rows, docs, 64)
    assert sum(own[0][2] < 64 for own in taken.values()) <= odd_docs.rdd.getNumPartitions()
    pieces = sorted((r["start"], r["slot"], r["offset"], r["length"], r["path"], r["byte_offset"]) for r in rows if r["doc_id"] == 5)
    ids = np.concatenate([B.read_slots(path, at // 128, 1, 64)[0][offset : offset + length] for _, _, offset, length, path, at in pieces])
    assert ids.astype("<u4").tobytes() == bpe.ids(next(t for d, t in docs if d == 5)) + np.array([1], "<u4").tobytes()
    assert B.write_training_order(no_docs, tokenizer_path(), f"file://{tmp_path}/b").count() == 0


def test_slots_are_one_permutation_of_all_sequences(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "SHARD_SEQUENCES", 100)
    docs = table(spark, small, "documents")
    rows = B.write_training_order(docs, tokenizer_path(), f"file://{tmp_path}/c").collect()
    again = B.write_training_order(docs, tokenizer_path(), f"file://{tmp_path}/d").collect()
    assert sorted(tuple(r)[:8] for r in rows) == sorted(tuple(r)[:8] for r in again)
    n = max(r["slot"] for r in rows) + 1
    assert sorted({B.row_at(r["slot"], n) for r in rows}) == list(range(n))
    assert all(r["shard"] == r["slot"] // 100 and r["byte_offset"] == r["slot"] % 100 * 1024 for r in rows)
    sizes = {r["path"].removeprefix("file://"): min(100, n - 100 * r["shard"]) * 1024 for r in rows}
    assert {p: Path(p).stat().st_size for p in sizes} == sizes
    spread = {}
    for r in rows:
        spread.setdefault(r["doc_id"], []).append(r["shard"])
    assert len(set(max(spread.values(), key=len))) > len(sizes) // 2


def test_output_query_covers_every_document(spark, small):
    rows = op2_token_id_output(spark, small).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in table(spark, small, "documents").collect()}
    assert sorted({r["slot"] for r in rows}) == list(range(max(r["slot"] for r in rows) + 1))
