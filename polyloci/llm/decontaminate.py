"""Operator 10, benchmark decontamination by q-gram lemma filtering with banded verification.

Texts are compared in a normal form: letters and digits in lower case, every run of other characters as one space.
An item of n characters is found where a stretch of a document is within k = floor(edit_rate * n) edits of it. By the
q-gram lemma such a stretch keeps at least n - q + 1 - k * q of the item's q-grams, all on diagonals (document
position minus item position) that differ by at most k. Diagonals are cut into bands of 2 * (k + 1), one every k + 1,
so each stretch lies wholly in some band: bands with fewer shared q-grams are dropped, the rest are aligned.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passed_through, slices

Q = 8
EDIT_RATE = 0.1
#: Items indexed and broadcast at once: at most this many characters of items, however large the benchmark is.
BLOCK_CHARS = 2_000_000
#: Characters of text taken at once, in one or many documents; longer documents go in overlapping windows, which are
#: larger where items are long (see _windows).
WINDOW = 1 << 17
#: Candidates aligned at once, and numbers in each array of an alignment; one candidate may take more.
ROWS, CELLS = 512, 1 << 21
_FILTER_BITS = 20
_MULT = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, item_id long, begin long, finish long, edits int, item_chars int"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 2**16: lower case where that is one character, and whether it is a letter or digit."""
    lower = np.arange(1 << 16, dtype=np.uint32)
    word = np.zeros(1 << 16, dtype=bool)
    for i in range(1 << 16):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        word[i] = c.isalnum()
        if len(c.lower()) == 1:
            lower[i] = ord(c.lower())
    return lower, word


_CASE: list = []


def normal_form(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points in normal form, and where each was in `codes`. A leading space is dropped."""
    if not _CASE:
        _CASE.extend(_tables())
    lower, is_word = _CASE
    small = codes < 1 << 16
    at = np.where(small, codes, 0)
    word = np.where(small, is_word[at], True)
    keep = word.copy()
    keep[1:] |= word[:-1]
    if len(keep):
        keep[0] = word[0]
    where = np.flatnonzero(keep)
    out = np.where(word[where], np.where(small[where], lower[at[where]], codes[where]), 32).astype(np.uint32)
    return out, where


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every stretch of q code points."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    one = codes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        if q == Q:
            h, step, factor = one, 1, _MULT
            while step < Q:
                h = h[:-step] * factor + h[step:]
                factor = factor * factor
                step *= 2
        else:
            h = one[: len(one) - q + 1]
            for i in range(1, q):
                h = h * _MULT + one[i : len(one) - q + 1 + i]
        h = h * _MULT
    return h ^ (h >> np.uint64(29))


def gram_size(n: int, k: int) -> int:
    """The longest q, up to Q, for which k edits leave one of n characters' q-grams whole: n - q + 1 - k * q >= 1."""
    return min(Q, n // (k + 1))


def item_codes(text: str | None) -> np.ndarray:
    codes, _ = normal_form(code_points(text or ""))
    return codes[:-1] if len(codes) and codes[-1] == 32 else codes


def indexes(items: list[tuple[int, str]], edit_rate: float) -> list[Index]:
    """One index for each size of q-grams that the items need; items without letters or digits are left out."""
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item_id, text in items:
        codes = item_codes(text)
        if len(codes):
            by_size.setdefault(gram_size(len(codes), int(edit_rate * len(codes))), []).append((item_id, codes))
    return [Index(own, edit_rate, q) for q, own in sorted(by_size.items())]


class Index:
    """The q-grams of some benchmark items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], edit_rate: float, q: int):
        self.q = q
        hashes, which, offsets = [], [], []
        self.ids, self.codes, self.budget, self.least = [], [], [], []
        for item_id, codes in items:
            n = len(codes)
            k = int(edit_rate * n)
            h = gram_hashes(codes, q)
            hashes.append(h)
            which.append(np.full(len(h), len(self.ids)))
            offsets.append(np.arange(len(h)))
            self.ids.append(item_id)
            self.codes.append(codes)
            self.budget.append(k)
            self.least.append(n - q + 1 - k * q)
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        w = np.concatenate([*which, np.zeros(0, np.int64)])
        o = np.concatenate([*offsets, np.zeros(0, np.int64)])
        _, place, times = np.unique(h, return_inverse=True, return_counts=True)
        keep = self._without_frequent(w, times[place] if len(h) else times)
        h, w, o = h[keep], w[keep], o[keep]
        order = np.argsort(h, kind="stable")
        self.hashes, self.which, self.offsets = h[order], w[order], o[order]
        self.budget, self.least = np.array(self.budget, np.int64), np.array(self.least, np.int64)
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.quick = np.zeros(1 << _FILTER_BITS, bool)
        self.quick[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def _without_frequent(self, which: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Which q-grams to index. An item's most frequent ones go, each lowering its least count by one, so that no
        match is lost; at least a third of the least count stays."""
        keep = np.ones(len(which), bool)
        for i, start in enumerate(np.searchsorted(which, np.arange(len(self.ids)))):
            own = times[start : start + len(self.codes[i]) - self.q + 1]
            order = np.argsort(-own, kind="stable")[: self.least[i] - max(1, min(self.least[i], 3 + self.least[i] // 3))]
            order = order[own[order] > 1]
            keep[start + order] = False
            self.least[i] -= len(order)
        return keep

    @property
    def reach(self) -> int:
        """Characters by which windows must overlap so that no stretch is cut in all of them."""
        return int((self.length + 4 * (self.budget + 1)).max()) if self.ids else 0


def candidate_bands(codes: np.ndarray, doc_of: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, first diagonal) of each band that keeps enough q-grams. doc_of: the document of each character."""
    none = (np.zeros(0, np.int64),) * 3
    h = gram_hashes(codes, ix.q)
    at = np.flatnonzero(ix.quick[h >> np.uint64(64 - _FILTER_BITS)])
    if not len(at):
        return none
    lo = np.searchsorted(ix.hashes, h[at], "left")
    n = np.searchsorted(ix.hashes, h[at], "right") - lo
    real = (n > 0) & (doc_of[at] == doc_of[at + ix.q - 1])
    at, lo, n = at[real], lo[real], n[real]
    if not len(at):
        return none
    entry = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    at = np.repeat(at, n)
    item, off, doc = ix.which[entry], ix.offsets[entry], doc_of[at]
    band = (at - off) // half_of(ix, item)  # band b covers diagonals [b * half, (b + 2) * half): each hit is in two
    base = int(band.min()) - 1
    span = int(band.max()) - base + 1
    keys = np.concatenate([item * span + (band - base), item * span + (band - 1 - base)])
    runs = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
    enough = np.diff(np.append(first, len(runs))) >= ix.least[runs[first] // span]
    runs = runs[first[enough]]  # bands with enough hits, counting repeats and whatever document they are in
    if not len(runs):
        return none
    at_run = np.minimum(np.searchsorted(runs, keys), len(runs) - 1)
    hit = np.flatnonzero(runs[at_run] == keys)
    one = hit % len(at)
    # Distinct (band, document, place in the item), as one number each; then their count by band and document.
    docs, places = int(doc.max()) + 1, int(off.max()) + 1
    hits = np.unique((at_run[hit] * docs + doc[one]) * places + off[one]) // places
    start = np.flatnonzero(np.concatenate(([True], hits[1:] != hits[:-1])))
    count = np.diff(np.append(start, len(hits)))
    run, doc = hits[start] // docs, hits[start] % docs
    item, band = runs[run] // span, runs[run] % span + base
    ok = count >= ix.least[item]
    return doc[ok], item[ok], band[ok] * half_of(ix, item[ok])


def half_of(ix: Index, item: np.ndarray) -> np.ndarray:
    """Half of a band's width: the edit budget plus one."""
    return ix.budget[item] + 1


def align(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, diagonal: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best alignment of each item within its band: edits, first and last-plus-one position.

    Column c of row i stands for the document position diagonal - k + i + c; costs and start positions share one
    number (edits * 2**40 + start), so that the least edits win and, among these, the earliest start.
    """
    one = 1 << 40
    far = np.int64(1) << 58
    k = ix.budget[item]
    width = int((2 * (k + 1) + 2 * k).max()) + 1
    cols = np.arange(width)
    own = cols[None, :] < (2 * (k + 1) + 2 * k + 1)[:, None]
    first = diagonal - k
    n = ix.length[item]
    pattern = np.full((len(item), int(n.max())), 0, np.uint32)
    for r, i in enumerate(item):
        pattern[r, : n[r]] = ix.codes[i]
    pos = first[:, None] + cols[None, :]
    inside = own & (pos >= lo[:, None]) & (pos <= hi[:, None])
    cost = np.where(inside, pos, far)  # nothing of the item is aligned yet: a start anywhere is free
    best = np.where(n == 0, 0, far)
    end = np.zeros(len(item), np.int64)
    last = len(codes) - 1
    for i in range(pattern.shape[1]):
        # row i + 1, column c: position first + (i + 1) + c is the end of the stretch
        pos = first[:, None] + (i + 1) + cols[None, :]
        inside = own & (pos >= lo[:, None]) & (pos <= hi[:, None])
        same = codes[np.clip(pos - 1, 0, last)] == pattern[:, i][:, None]
        move = cost + np.where(same, 0, one)
        move = np.where(pos - 1 >= lo[:, None], move, far)
        drop = np.full_like(cost, far)
        drop[:, :-1] = cost[:, 1:] + one  # the item's character is missing in the text
        cost = np.minimum(np.minimum(move, drop), far)
        cost = np.where(inside, cost, far)
        step = cols[None, :] * one  # further characters of the text
        cost = np.minimum(np.minimum.accumulate(cost - step, axis=1) + step, far)
        cost = np.where(inside, cost, far)
        done = n == i + 1
        if done.any():
            c = cost[done].argmin(1)
            best[done] = cost[done, c]
            end[done] = first[done] + (i + 1) + c
    return best >> 40, best & (one - 1), end


def _windows(texts: list[str], reach: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(document, window, normal form, place in the text) of each text, in windows that overlap by `reach`.

    Windows are twice the reach at least, so that a stretch of any item lies whole in one, wherever it is.
    """
    window = max(WINDOW, 2 * reach)
    for d, text in enumerate(texts):
        codes, where = normal_form(code_points(text))
        start = 0
        while True:
            yield d, start, codes[start : start + window], where[start : start + window]
            if start + window >= len(codes):
                break
            start += window - reach


def _batches(item: np.ndarray, ix: Index) -> Iterator[np.ndarray]:
    """Places in `item` to align at once: items of like length together, so that a long one widens no other's arrays."""
    wide = np.maximum(ix.length[item], 4 * ix.budget[item] + 3)
    order = np.argsort(wide, kind="stable")
    start = 0
    while start < len(order):
        some = wide[order[start : start + ROWS]]
        fit = int((some * np.arange(1, len(some) + 1) <= CELLS).sum())
        yield order[start : start + max(1, fit)]
        start += max(1, fit)


def find_items(texts: list[str], ixs: list[Index]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, item id, begin, finish, edits, item characters), in code points of the texts."""
    for ix in ixs:
        yield from _find_items(texts, ix)


def _find_items(texts: list[str], ix: Index) -> Iterator[tuple[int, int, int, int, int, int]]:
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def flush(group: list) -> None:
        codes = np.concatenate([g[2] for g in group])
        where = np.concatenate([g[3] for g in group])
        sizes = np.array([len(g[2]) for g in group])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        if len(codes) < ix.q:
            return
        doc, item, diagonal = candidate_bands(codes, np.repeat(np.arange(len(group)), sizes), ix)
        for part in _batches(item, ix):
            d, it = doc[part], item[part]
            edits, begin, end = align(codes, starts[d], starts[d] + sizes[d], it, diagonal[part], ix)
            for j in np.flatnonzero((edits <= ix.budget[it]) & (end > begin)):
                span = (int(edits[j]), int(where[begin[j]]), int(where[end[j] - 1]) + 1)
                found.setdefault((group[d[j]][0], int(it[j])), []).append(span)

    group, size = [], 0
    for g in _windows(texts, ix.reach):
        group.append(g)
        size += len(g[2])
        if size >= WINDOW:
            flush(group)
            group, size = [], 0
    if group:
        flush(group)
    for (d, it), spans in sorted(found.items()):
        taken: list[tuple[int, int]] = []  # disjoint and in order
        for edits, begin, finish in sorted(set(spans)):
            at = bisect.bisect_left(taken, (begin, finish))
            if (at == 0 or taken[at - 1][1] <= begin) and (at == len(taken) or taken[at][0] >= finish):
                taken.insert(at, (begin, finish))
                yield d, ix.ids[it], begin, finish, edits, int(ix.length[it])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_CHARS characters (or one item), one block at the driver at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("long"), text_col).filter(F.col(text_col).isNotNull())
    for item_id, text in rows.orderBy(item_col, text_col).toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every stretch of a document that is an item up to floor(edit_rate * its length) edits (SCHEMA).

    begin and finish are code points of the original text; stretches of one item in one document don't overlap, and
    the ones with fewest edits are kept. Null and empty texts and items match nothing. Items that are short for their
    budget, those under 8 characters among them, are looked for by shorter q-grams: the lemma holds for every length,
    and one of a few characters is found wherever these stand, within words too. Repeated documents and items give repeated rows. Ids may be null. Other columns are ignored.

    The documents are read once for each block of items and never shuffled. A block's index is broadcast; its size is
    bounded by BLOCK_CHARS, and a larger benchmark takes more blocks.
    """
    out = None
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    for block in _blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            ix = indexes(shared.value, edit_rate)
            for batch in slices(batches):
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = [(ids[d], *rest) for d, *rest in find_items(texts, ix)]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    types = [pa.int64()] * 4 + [pa.int32()] * 2
                    names = ["doc_id", "item_id", "begin", "finish", "edits", "item_chars"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        part = source.mapInArrow(search, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item; columns unchanged.

    Decided row by row where the text is read, so that nothing is joined or shuffled and neither null nor repeated ids
    matter. A benchmark of more than one block is applied one block after another.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast(block)

        def clean(batches, shared=shared):
            ix = indexes(shared.value, EDIT_RATE)
            for batch in slices(batches):
                texts = [t or "" for t in batch.column(at).to_pylist()]
                bad = {d for d, *_ in find_items(texts, ix)}
                yield batch.filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_()))

        docs = passed_through(docs, clean)
    return docs
