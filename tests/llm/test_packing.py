import functools
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polyloci.llm import packing as P
from polyloci.llm.bpe_tokens import WordBpe
from polyloci.llm.queries import op1_packing, table, tokenizer_path


@functools.cache
def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def reference_ids(text):
    t = reference_tokenizer()
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check_pieces(rows, texts):
    """rows must cover each text's ids exactly once and lie gapless in their sequences."""
    want = Counter()
    for doc, text in texts:
        want[doc] += len(reference_ids(text))
    got = Counter()
    by_seq = {}
    for r in rows:
        got[r["doc_id"]] += r["length"]
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= P.CAPACITY


def test_query_against_the_library(spark, small):
    rows = op1_packing(spark, small).collect()
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    check_pieces(rows, docs)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, text in docs:
        ids, at = reference_ids(text), 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    total = sum(r["length"] for r in rows)
    assert total / (len({r["sequence_id"] for r in rows}) * P.CAPACITY) > 0.98


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = P.pack_documents(odd_docs, tokenizer_path(), with_ids=True).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert P.pack_documents(no_docs, tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["Don't I'LL it's 12 34½ ³ ok", "Σας ΑΣ", "日本 hello", "a\x85b", "  ", "İstanbul", "été <|endoftext|> x", "we're'd''s _a_b", "x\u2028y"])
def test_tokens_of_unusual_texts(text):
    assert WordBpe.opened(tokenizer_path()).ids(text) == reference_ids(text)[:-1].tobytes()


def test_tokens_of_every_latin_character():
    own = WordBpe.opened(tokenizer_path())
    for i in range(0x20, 0x250):
        for text in (f"a{chr(i)}b", chr(i), f"x {chr(i)}{chr(i)} y"):
            assert own.ids(text) == reference_ids(text)[:-1].tobytes(), hex(i)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([chr(i) for i in [*range(0x20, 0x250), 9, 10, 13]] + ["<|endoftext|>", "<|STARTOFTEXT|>", "don't"]), max_size=30).map("".join))
def test_tokens_of_random_texts(text):
    assert WordBpe.opened(tokenizer_path()).ids(text) == reference_ids(text)[:-1].tobytes()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_histogram_packing_keeps_every_length(histogram):
    patterns = P.pack_histogram(histogram, 64)
    got = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 64
        for length in pattern:
            got[length] += count
    assert got == Counter(histogram)
    ranks = Counter()
    for length, _, n, _, _, _ in P.slots(patterns):
        ranks[length] += n
    assert ranks == Counter(histogram)


def test_lengths_just_over_half_are_cut_shorter():
    longest = P.plan_cut({1100: 1000}, 2048)
    assert longest < 2048
    shorter = P.pack_histogram(P._recut({1100: 1000}, 2048, longest), 2048)
    assert P.padding_share(shorter, 2048) < P.padding_share(P.pack_histogram({1100: 1000}, 2048), 2048) / 5
    assert P.cuts(5000, 2048, 512) == [(0, 2048), (2048, 2048), (4096, 512), (4608, 392)]


def test_many_texts_at_once(monkeypatch):
    """Contractions after letters, marks, at the end and the start of texts; numbers, Latin-1 letters and spaces, pre-tokens of
    8, 16 and more bytes, texts that go through the library, and a table that starts anew all the time."""
    import random

    from polyloci.llm import bpe_tokens as T

    random.seed(4)
    signs = "ab'strevlmdé \n\t0189²½.,!-\xa0ÀßªŸ\x85<|"
    texts = ["".join(random.choice(signs[:n]) for _ in range(random.randint(0, 60))) for n in (len(signs), len(signs) - 4, 18) for _ in range(400)]
    texts += [None, "", " ", "'", "''s", "x's 're'll ve'd", "'second", "a'", "'s", "Ünïcode Straße", "<|EndOfText|> it's", "日本 it's", "e\u0301t\u00e9"]
    texts += [c * n for c in "aé." for n in (7, 8, 9, 15, 16, 17, 40)] + ["it's " * 1000]
    for words, together in ((T.Remembered.WORDS, T.TOGETHER), (150, 60)):
        monkeypatch.setattr(T.Remembered, "WORDS", words)
        monkeypatch.setattr(T, "TOGETHER", together)
        own = WordBpe(tokenizer_path())
        for text, ids in zip(texts, own.many(texts), strict=True):
            assert ids.tolist() == reference_ids(text)[:-1].tolist(), text
