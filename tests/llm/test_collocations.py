import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from polyloci.llm import collocations as C
from polyloci.llm.misra_gries import Summary, capacity, combined


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least, top, inside=80, longest=4):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    phrases = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in phrases.items():
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        longer = [b for (x, q), b in phrases.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * b >= inside * a for b in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def found(spark, rows, parts=3, **options):
    docs = spark.createDataFrame([(i, t, x, "a", "b") for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, words string").repartition(parts)
    return sorted(tuple(r) for r in C.collocations(docs, **options).collect())


@pytest.mark.parametrize("size", [1, 5, 40])
def test_summaries_lose_no_frequent_key(size):
    rng = np.random.default_rng(size)
    keys = rng.zipf(1.3, 20_000).astype(np.uint64) % np.uint64(3000)
    least = 100
    summary = Summary(capacity(len(keys), least), pending=64)
    for part in np.array_split(keys, size):
        summary.merge(*np.unique(part, return_counts=True))
    exact = Counter(keys.tolist())
    held = set(summary.at_least(least).tolist())
    assert {k for k, c in exact.items() if c >= least} <= held
    assert len(summary.keys) <= summary.size and summary.lost < least
    assert all(exact[k] - summary.lost <= c <= exact[k] for k, c in zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))


def test_combined_counts():
    keys, counts = combined(np.array([5, 1, 5, 2], np.uint64), np.array([1, 2, 3, 4]))
    assert keys.tolist() == [1, 2, 5] and counts.tolist() == [2, 4, 4]


def test_words_of_any_length_are_told_apart():
    words = [b"x" * n for n in range(1, 60)] + [b"x" * 16 + b"y", b"y" + b"x" * 16, b"\0", b"\0\0", "é".encode(), b"a\xa0b"]
    w = C.Words(np.frombuffer(b" \t".join(words) + b"\n", np.uint8))
    assert [w.joined(i, 1) for i in range(len(w))] == words and len(set(w.hash.tolist())) == len(words)
    assert w.joined(0, 3) == b"x xx xxx"


def test_packed_keys():
    keys = np.concatenate((np.sort(np.random.default_rng(0).integers(0, 2**32, 500, dtype=np.uint32)), np.array([0, 2**32 - 1, 5], np.uint32)))
    for own in (keys, keys[:1], keys[:0]):
        assert np.array_equal(C.unpack_keys(C.pack_keys(own), len(own)), own)


def test_parts_end_with_a_break(monkeypatch):
    monkeypatch.setattr(C, "PART_BYTES", 7)
    texts = ["ab cd. ef\n", "\n", "no break in this one\n", "x,y,z\n"]
    batch = pa.RecordBatch.from_arrays([pa.array(["skipped\n", *texts])], ["text"]).slice(1)
    parts = list(C._parts(batch))
    assert b"".join(p.tobytes() for p, _ in parts).decode() == "".join(texts) and all(p.tobytes()[-1:] in b".,\n" for p, _ in parts)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "and", "new", "york", "city", "a" * 9, "b" * 20, "été", "x y"]
    def text():
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "! "]) for _ in range(rng.randint(0, 60)))
    rows = [(text(), rng.choice(["en", "fr", None])) for _ in range(150)] + [("New York City, " * 200, "en")] * 3
    for least, top in ((30, 2000), (3, 50), (200, 5)):
        want = brute(rows, least, top)
        assert want and found(spark, rows, least=least, top=top) == want


def test_small_parts_summaries_and_maps_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(" ".join(rng.choice("abcdef") for _ in range(50)), "en") for _ in range(60)]
    want = brute(rows, 20, 2000)
    for name, value in (("PART_BYTES", 64), ("MOST_HASHES", 50), ("MOST_PHRASES", 20), ("MOST_COUNTED", 60), ("MAP_BITS", 9), ("LEAST_PARTS", 2)):
        monkeypatch.setattr(C, name, value)
    assert found(spark, rows, least=20) == want


def test_odd_rows_and_none(spark, odd_docs, no_docs):
    rows = [(r["text"], r["lang"]) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in C.collocations(odd_docs, least=2).collect()) == brute(rows, 2, 2000)
    assert C.collocations(no_docs).count() == 0
    assert C.collocations(odd_docs, least=10**6).count() == 0


def test_other_lengths(spark):
    rows = [("a b c d e f " * 10, "en")] * 3
    for longest in (2, 3, 5):
        assert found(spark, rows, least=10, longest=longest) == brute(rows, 10, 2000, longest=longest)
