import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from polyloci.llm import line_dedup as L
from polyloci.llm import simhash as S
from polyloci.llm.components import components
from polyloci.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from polyloci.llm.queries import op5_simhash_near_dedup, op6_exact_dedup, op8_line_dedup, table


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups_of_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.collect()
    groups = defaultdict(list)
    for r in docs:
        groups[lowered(r["text"])].append(r["doc_id"])
    largest = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = Counter((r["doc_id"], largest[lowered(r["text"])], len(groups[lowered(r["text"])])) for r in docs)
    rows = exact_duplicates(odd_docs, every_hash=True).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows) == want
    assert sum(r["kept"] for r in rows) == len(groups)
    left = drop_exact_duplicates(odd_docs)
    assert left.columns == odd_docs.columns and Counter(lowered(r["text"]) for r in left.collect()) == Counter(list(groups))
    assert all((r["row_sha"], r["gone_id"], r["Row_Hash"], r["a.b"]) == ("sha", "gone", "hash", "dot") for r in left.collect())
    assert exact_duplicates(no_docs).count() == 0 and drop_exact_duplicates(no_docs).count() == 0


def test_exact_query(spark, small):
    docs = {r["doc_id"]: lowered(r["text"]) for r in table(spark, small, "documents").collect()}
    rows = op6_exact_dedup(spark, small).collect()
    assert len(rows) == len(docs)
    assert all(docs[r["doc_id"]] == docs[r["keep_id"]] and r["kept"] == (r["doc_id"] == r["keep_id"]) for r in rows)


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered(text).encode())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_near_duplicates_against_all_pairs(spark, small):
    docs = table(spark, small, "documents").collect()
    fps = [plain_fingerprint(r["text"]) for r in docs]
    want = {r["doc_id"]: (format(f, "016x"), c) for r, f, c in zip(docs, fps, plain_components([r["doc_id"] for r in docs], fps, 3), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op5_simhash_near_dedup(spark, small).collect()} == want


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.collect()
    fps = [plain_fingerprint(r["text"]) for r in docs]
    want = Counter((r["doc_id"], format(f, "016x"), c) for r, f, c in zip(docs, fps, plain_components([r["doc_id"] for r in docs], fps, 3), strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(odd_docs).collect()) == want
    left = S.drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    assert Counter(plain_fingerprint(r["text"]) for r in left.collect()) == Counter(set(fps))
    assert all((r["row_sha"], r["gone_id"], r["Row_Hash"]) == ("sha", "gone", "hash") for r in left.collect())
    assert S.near_duplicates(no_docs).count() == 0 and S.drop_near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("radius", [2, 3, 5])
def test_links_in_crowded_buckets(spark, radius, monkeypatch):
    """Fingerprints crowd around few centres; buckets are cut in blocks."""
    monkeypatch.setattr(S, "BLOCK", 40)
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 62, 5)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 6))) for c in centres for _ in range(60)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    root = {r["id"]: r["root"] for r in components(S.near_links(nodes, radius)).collect()}
    assert [root.get(f, f) for f in fps] == plain_components(fps, fps, radius)


def test_probes_cover_the_radius():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64))
    for radius in (1, 3, 4):
        plan = S.plan_probes(bits.T @ bits, 500, radius)
        assert sum(e + 1 for _, e in plan) == radius + 1
        assert len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)


def test_components_of_a_path_and_a_star(spark, monkeypatch):
    from polyloci.llm import components as C

    for most in (0, 100_000):
        monkeypatch.setattr(C, "BROADCAST_EDGES", most)
        edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
        got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_lines(docs):
    """(doc, line) -> (links, kept), by comparing all classes."""
    rows, first = [], {}
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        for n, line in enumerate((t or "").split("\n")):
            w = frozenset(re.findall(r"[^\t\n\x0b\x0c\r ]+", line))
            rows.append((d, n, w))
            if w:
                first.setdefault(w, (d, n))
    near = {w: [v for v in first if v != w and 9 * len(v & w) >= 4 * (len(v) + len(w))] for w in first}
    return {(d, n): (len(near[w]) if w else 0, not w or (first[w] == (d, n) and all(first[v] > (d, n) for v in near[w]))) for d, n, w in rows}


@pytest.mark.parametrize("block", [3, 4096])
def test_lines_against_all_pairs(spark, small, block, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", block)
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    docs = docs[:30] + [(10_000 + i, " ".join(f"w{j}" for j in range(12) if j != i % 12) + f" z{i % 3}") for i in range(30)] + [(20_000, None), (20_001, "\n \n"), (20_002, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["doc_id"], r["line"]): (r["links"], r["kept"]) for r in L.line_duplicates(frame).collect()} == plain_lines(docs)


def test_lines_of_odd_rows(spark, odd_docs, no_docs, small):
    rows = L.line_duplicates(odd_docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd_docs.collect() for _ in (r["text"] or "").split("\n"))
    assert L.line_duplicates(no_docs).count() == 0
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    assert op8_line_dedup(spark, small).count() == sum(len(t.split("\n")) for _, t in docs)
