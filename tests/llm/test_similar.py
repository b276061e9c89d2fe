from collections import Counter
from fractions import Fraction

import corpus_pipeline as C
import numpy as np
import pytest

from polyloci.llm import jaccard as J
from polyloci.llm import simhash as S
from polyloci.llm.queries import table

DOC = "doc_id long, text string"


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.translate(str.maketrans("\t\n\r\x0b\x0c", "     ")).split(" ") if w]


def plain_set(text, n=5):
    words = plain_words(text)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def plain_groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def plain_pairs(docs):
    """Pairs of documents with Jaccard of 0.8 or more, found over shared shingles."""
    sets = [plain_set(t) for _, t in docs]
    holders, pairs = {}, []
    for i, s in enumerate(sets):
        shared = Counter(j for h in s or [None] for j in holders.get(h, []))
        pairs += [(i, j) for j, n in shared.items() if not s or 5 * n >= 4 * (len(s) + len(sets[j]) - n)]
        for h in s or [None]:
            holders.setdefault(h, []).append(i)
    return pairs


def heads(docs, root):
    least = {}
    for (d, _), r in zip(docs, root, strict=True):
        least[r] = min(d, least.get(r, d))
    return set(least.values())


def plain_kept(docs, radius):
    """What drop_similar() keeps, by its definition: all pairs within the radius, their groups, all pairs of a group."""
    fps = np.array([S.set_fingerprint(t, 1) for _, t in docs], np.uint64)
    close = [(i, int(j)) for i in range(len(docs)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius)]
    group = plain_groups(len(docs), close)
    pairs = [(i, j) for i, j in plain_pairs(docs) if group[i] == group[j]]
    return heads(docs, plain_groups(len(docs), pairs))


def edited(seed, copies, words=150):
    rng = np.random.default_rng(seed)
    docs = []
    for _ in range(3):
        base = [f"w{x}" for x in rng.integers(0, 5000, words)]
        for _ in range(copies):
            own = list(base)
            for at in rng.integers(0, len(own), rng.integers(0, 9)):
                own[at] = f"v{rng.integers(0, 5000)}"
            docs.append((len(docs), "this opening stands in front of every text there is " + " ".join(own[: rng.integers(words - 20, words + 1)])))
    return docs + [(len(docs) + i, t) for i, t in enumerate(["", " ", None, "a b", "A  B", "a b c"])]


def test_set_fingerprint_of_words():
    import xxhash

    text = "the cat saw the dog and The bird"
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(plain_words(text))]
    assert S.set_fingerprint(text, 1) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert S.set_fingerprint(None, 1) == S.set_fingerprint(" \n", 1) == 0


def test_pipeline_stage_and_its_recall(spark):
    """As defined, and nearly all groups of texts with Jaccard of 0.8 or more: at least 0.9 of what these would drop."""
    sf = "/root/testdata/sf0.01"
    once = C.exact_dedup(spark, table(spark, sf, "documents"), sf)
    docs = [(r["doc_id"], r["text"]) for r in once.collect()]
    kept = {r["doc_id"] for r in C.near_dedup(spark, once, sf).collect()}
    assert kept == plain_kept(docs, 7)
    whole = heads(docs, plain_groups(len(docs), plain_pairs(docs)))
    assert len(docs) > len(whole) and len(docs) - len(kept) >= 0.9 * (len(docs) - len(whole))


@pytest.mark.parametrize(("rows", "copies"), [(2048, 50), (13, 50), (40, 120)])
def test_crowds_near_the_threshold(spark, rows, copies, monkeypatch):
    """Edited copies on both sides of 0.8, in groups that are compared whole or dealt into chunks."""
    monkeypatch.setattr(J, "CHUNK_ROWS", rows)
    docs = edited(rows, copies)
    want = plain_kept(docs, 7)
    assert 8 < len(want) < len(docs) - 10
    rows = S.drop_similar(spark.createDataFrame(docs, DOC)).collect()
    assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)


def test_pairs_within_chunks():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, (4, 60)).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base[i % 4], 54, replace=False), rng.integers(0, 1 << 62, rng.integers(0, 6)).astype(np.uint64)])) for i in range(80)] + [np.zeros(0, np.uint64)] * 2
    t = Fraction(4, 5)
    true = {(i, j) for i in range(len(sets)) for j in range(i) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    found = J.spanning_pairs(sets, t)
    assert {(max(p), min(p)) for p in found} <= true and len(found) < len(sets)
    same = [plain_groups(len(sets), x) for x in (found, true)]
    assert all((same[0][i] == same[0][j]) == (same[1][i] == same[1][j]) for i in range(len(sets)) for j in range(i))
    roots = np.arange(70)
    assert {(70 + g, h) for g, h in J.visiting_pairs(sets[:70], roots, sets[70:], np.arange(70, 82), t)} == {(i, j) for i, j in true if i >= 70 > j}


def test_odd_rows(odd_docs, no_docs):
    left = S.drop_similar(odd_docs)
    assert left.columns == odd_docs.columns and S.drop_similar(no_docs).count() == 0
    assert {r["doc_id"] for r in left.collect()} == {1, 2, 5, 6}


def test_wide_radius_is_probed():
    bits = np.random.default_rng(0).integers(0, 2, (500, 64))
    for radius in (8, 11, 14):
        plan = S.plan_probes(bits.T @ bits, 500, radius)
        assert S.probe_masks(plan) and all(e <= len(g) for g, e in plan)
