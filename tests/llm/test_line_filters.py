import numpy as np
import pyarrow as pa

from polyloci.llm import line_dedup as L

from .test_duplicates import plain_lines


def batch(texts):
    """The lines as rows of one bucket, which they reach by their first word."""
    x = L.Lines("".join(f"{t}\n" for t in texts).encode(), None)
    bits, at = x.parity()
    n = np.zeros(x.n, np.int64)
    cols = [pa.array(n + 7), pa.array(x.size.astype(np.int64) << 32), pa.array(x.key), L._binaries(bits, np.diff(at)), pa.array((n - 1).astype(np.int32)), pa.array(n)]
    return pa.RecordBatch.from_arrays(cols, ["key", "at", "class", "parity", "own", "head"]), x


def test_long_lines_without_partner_stay(spark):
    """Sets of 180 words that have little in common: 64 bits of parity let nearly all of them pass."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.choice(100_000, 180, False)) for _ in range(60)]
    near = " ".join(texts[0].split()[:-20] + [f"z{i}" for i in range(18)])
    rows, x = batch([*texts, near])
    passed = [k for b in L._members(iter([rows.slice(0, 30), rows.slice(30)])) for k in b.column(1).to_pylist()]
    assert set(passed) >= {int(x.key[0]), int(x.key[-1])} and len(passed) < 6


def test_links_across_widths_of_parity(spark):
    """Lines around the sizes at which parities get wider, and near copies of them that have another width."""
    rng = np.random.default_rng(2)
    docs = []
    for n in (60, 64, 65, 70, 120, 128, 129, 140, 260):
        words = [f"v{i}" for i in rng.choice(3000, n, False)]
        for cut in (0, 1, n // 20, n // 10, n // 5, n // 5 + 1):
            docs.append((len(docs), " ".join(words[cut:] + [f"x{len(docs)}"] * (cut % 2))))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {(r["doc_id"], r["line"]): (r["links"], r["kept"]) for r in L.line_duplicates(frame).collect()} == plain_lines(docs)


def test_order_of_words_alike_in_their_upper_bits():
    word = np.array([5, 3, 5, 4, 3, 1 << 63], np.uint64)
    line = np.zeros(6, int)
    rank = np.array([1, 1, 1, 1, 1, 0], np.uint8)
    assert word[L.by_rank(word, rank, line, 1)].tolist() == [1 << 63, 3, 3, 4, 5, 5]


def test_words_alike_in_their_first_bytes():
    """Words of all lengths around 8, 16 and 24 bytes, that differ in one byte, at any place of the text."""
    words = sorted({"a" * n + c for n in range(26) for c in ("", "b", "\u00e9", "c" * 9)} - {""})
    hashes = L.line_words(" ".join(words).encode())[0]
    assert len(set(hashes.tolist())) == len(words)
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert L.line_words(f"x\n {w}".encode())[0].tolist()[1] == h == L.line_words(w.encode())[0].tolist()[0]


def test_postings_travel_in_blocks(spark, monkeypatch):
    """Tasks send a row for each part and PART_POSTS postings, not for each posting, and every posting arrives once."""
    monkeypatch.setattr(L, "PART_POSTS", 500)
    rng = np.random.default_rng(3)
    docs = [(i, "\n".join(" ".join(f"w{j}" for j in rng.choice(400, 20, False)) for _ in range(5))) for i in range(60)]
    source = spark.createDataFrame(docs, "id long, text string").selectExpr("id", "text", "xxhash64(text) AS text_hash").coalesce(1)
    lines = L._lines(source, spark.sparkContext.broadcast(L.word_counts(source.select("text"))))
    classes = lines.select("class", "size", "parity", "prefix")
    expected = [(r["class"], k, p) for r in classes.collect() for p, k in enumerate(r["prefix"]) if k]
    none = np.zeros(0, np.int64)
    rows = L._parts(classes, 3, none, none).collect()
    assert len(expected) == 1500 and len(rows) <= 3 * 3
    got = []
    for r in rows:
        posts = pa.ipc.read_record_batch(pa.py_buffer(bytes(r["posts"])), L.POSTS).to_pylist()
        assert {(int(L._mixed(np.array([x["key"]]).view(np.uint64))[0]) % 3) for x in posts} == {r["part"]}
        got += [(x["class"], x["key"], x["at"] & 0xFFFFFFFF) for x in posts]
    assert sorted(got) == sorted(expected)


def test_only_lines_of_the_map_are_parted(spark, monkeypatch):
    source = spark.createDataFrame([(None, "a b\nc d\n\ne f"), (7, "a b\nc d"), (8, None)], "id long, text string").selectExpr("id", "text", "xxhash64(text) AS text_hash")
    place = source.filter("id IS NULL").selectExpr("id", "text_hash", "1 AS line").withColumn("cell", L.place_cell()).first()["cell"]
    wanted = np.zeros((1 << L.PLACE_BITS) // 64, np.uint64)
    wanted[place >> 6] = np.uint64(1 << (place & 63))
    counts = np.ones((L.CELL_ROWS, 1 << L.CELL_BITS), np.uint8)
    rows = L._sets(source, spark.sparkContext.broadcast(wanted), spark.sparkContext.broadcast(counts)).collect()
    x = L.Lines(b"c d\n", counts)
    assert [(r["class"], bytes(r["words"])) for r in rows] == [(int(x.key[0]), x.word.tobytes())]
