"""Exact Jaccard similarity of word shingles within groups of candidate texts.

A group is compared whole in one task while it is small. A larger one is dealt at random into chunks, more than once;
the links found so join most of what belongs together. The texts that are then still outside their group's largest
component, and only these, visit every chunk. So each pair of a group is either compared or already connected, and
links grow with texts, not with pairs.
"""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, slices, stored
from .components import components

SEED = 42
#: Bytes of text split at once.
SPAN = 4 << 20
#: Texts, and bytes of their sets, compared in one piece.
CHUNK_ROWS, CHUNK_BYTES = 2048, 16 << 20
#: Random deals of a large group before the last one, which leaves nothing out.
DEALS = 3


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted XXH64 hashes (seed 42) of the text's word shingles, A-Z lower-cased; a text of fewer words is one."""
    from xxhash import xxh64_intdigest

    data = (text or "").encode("utf-8", "surrogatepass").lower()
    runs: list[np.ndarray] = []
    held: list[bytes] = []
    start = 0
    while start < len(data):
        stop = min(len(data), start + SPAN)
        while stop < len(data) and data[stop] not in b" \t\n\r\x0b\x0c":
            stop += 1
        tokens = held + data[start:stop].split()
        if len(tokens) >= words:
            shingles = set(tokens) if words == 1 else list(map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)))
            runs.append(np.unique(np.fromiter(map(xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64, len(shingles))))
        held = tokens[-(words - 1) :] if words > 1 else []
        start = stop
    if not runs and held:
        runs.append(np.array([xxh64_intdigest(b" ".join(held), SEED)], np.uint64))
    return np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)


class _Chunk:
    """Sets that are compared with one another, their members numbered."""

    def __init__(self, sets: list[np.ndarray], t: Fraction):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.end = np.cumsum(self.size)
        _, code = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
        self.code, self.mark, self.t = code, np.zeros(len(code) + 1, bool), t

    def members(self, i: int) -> np.ndarray:
        return self.code[self.end[i] - self.size[i] : self.end[i]]

    def gathered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members of some rows one after another, and where each row ends."""
        size = self.size[rows]
        end = np.cumsum(size)
        return self.code[np.arange(int(size.sum())) + np.repeat(self.end[rows] - end, size)], end

    def similar(self, x: int, rows: np.ndarray, code: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the gathered rows have at least the similarity to row x."""
        own = self.members(x)
        self.mark[own] = True
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.mark[code])))
        self.mark[own] = False
        shared = total[end] - total[end - self.size[rows]]
        p, q = self.t.numerator, self.t.denominator
        return shared * (p + q) >= (self.size[x] + self.size[rows]) * p


def spanning_pairs(sets: list[np.ndarray], t: Fraction) -> list[tuple[int, int]]:
    """Similar pairs that connect all that similar pairs connect; fewer than there are sets."""
    chunk, links = _Chunk(sets, t), []
    rest = np.arange(len(sets))
    rows = rest
    code, end = chunk.gathered(rows)
    alive = np.ones(len(sets), bool)
    front: list[int] = []
    while True:
        rest = rows[alive[rows]]
        if not len(rest):
            return links
        if 2 * len(rest) < len(rows):
            rows = rest
            code, end = chunk.gathered(rows)
        x = front.pop() if front else int(rest[0])
        alive[x] = False
        hit = rows[chunk.similar(x, rows, code, end) & alive[rows]]
        alive[hit] = False
        links += [(x, int(y)) for y in hit]
        front += hit.tolist()


def visiting_pairs(home: list[np.ndarray], home_root: np.ndarray, guests: list[np.ndarray], guest_root: np.ndarray, t: Fraction) -> list[tuple[int, int]]:
    """(guest, home) pairs that are similar, one for each root that a guest meets and that isn't its own."""
    chunk, links = _Chunk(home + guests, t), []
    rows = np.arange(len(home))
    code, end = chunk.gathered(rows)
    for g, own in enumerate(guest_root):
        hit = np.flatnonzero(chunk.similar(len(home) + g, rows, code, end) & (home_root != own))
        _, first = np.unique(home_root[hit], return_index=True)
        links += [(g, int(h)) for h in hit[first]]
    return links


def _compared(batches, t: Fraction):
    """mapInArrow over (key, node, root, guest, items) sorted by key: links (a, b) within each key."""
    at, held = None, []

    def out():
        home = [r for r in held if not r[2]]
        guests = [r for r in held if r[2]]
        sets = [np.frombuffer(r[3], np.uint64) for r in home]
        if guests:
            roots = [np.array([r[1] for r in rows], np.int64) for rows in (home, guests)]
            found = [(guests[i][0], home[j][0]) for i, j in visiting_pairs(sets, roots[0], [np.frombuffer(r[3], np.uint64) for r in guests], roots[1], t)]
        else:
            found = [(home[i][0], home[j][0]) for i, j in spanning_pairs(sets, t)]
        if found:
            ab = np.array(found, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    for batch in slices(batches):
        for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != at:
                if len(held) > 1:
                    yield from out()
                at, held = key, []
            held.append(row)
    if len(held) > 1:
        yield from out()


def text_sets(docs: DataFrame, texts: DataFrame, words: int, text_col: str) -> DataFrame:
    """(node, grp, n, items) of the texts asked for by (node, grp), node being the text's xxhash64; stored."""

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            new = []
            for i, h in enumerate(batch.column(0).to_pylist()):
                if h not in seen:
                    seen.add(h)
                    new.append(i)
            if len(seen) > 400_000:
                seen.clear()
            part = batch.take(pa.array(new, pa.int64()))
            sets = [shingle_set(x, words) for x in part.column(2).to_pylist()]
            n, items = pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, items], ["node", "grp", "n", "items"])

    side = F.broadcast(texts) if texts.count() <= BROADCAST_ROWS else texts
    rows = docs.select(F.xxhash64(text_col).alias("node"), F.col(text_col).alias("__text")).join(side, "node").select("node", "grp", "__text")
    return stored(rows.mapInArrow(run, "node long, grp long, n long, items binary").dropDuplicates(["node"]), "shingle_sets")


def similar_links(sets: DataFrame, t: Fraction) -> DataFrame:
    """Links (a, b) of nodes that connect all pairs of one group with at least the similarity t; checkpointed.

    sets: (node, grp, n, items), stored. Where most texts of a large group are like no other of it, the last deal
    compares nearly all of its pairs; the others take time in proportion to their texts and chunks.
    """
    pieces = F.greatest(F.ceil(F.count("*") / F.lit(CHUNK_ROWS)), F.ceil(F.sum("n") * 8 / F.lit(CHUNK_BYTES))).cast("int")
    large = cut(sets.groupBy("grp").agg(pieces.alias("pieces")).filter("pieces > 1"))
    many = large.count()
    side = F.broadcast(large) if many <= BROADCAST_ROWS else large
    none = F.lit(0).cast("long")

    def deal(rows: DataFrame) -> DataFrame:
        dealt = rows.select("key", "node", "root", "guest", "items").repartition("key").sortWithinPartitions("key")
        return cut(dealt.mapInArrow(lambda batches: _compared(batches, t), "a long, b long"))

    whole = sets.join(side, "grp", "left_anti") if many else sets
    links = deal(whole.select(F.xxhash64("grp").alias("key"), "node", none.alias("root"), F.lit(False).alias("guest"), "items"))
    if not many:
        return links
    split = sets.join(side, "grp")
    place = F.pmod(F.xxhash64("node", F.lit(0)), F.col("pieces"))
    for k in range(DEALS):
        key = F.xxhash64("grp", F.pmod(F.xxhash64("node", F.lit(k)), F.col("pieces")))
        links = links.unionByName(deal(split.select(key.alias("key"), "node", none.alias("root"), F.lit(False).alias("guest"), "items")))
    found = components(links).withColumnRenamed("id", "node")
    rooted = split.select("node", "grp", "pieces").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = cut(rooted)
    main = rooted.groupBy("grp", "root").count().groupBy("grp").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    away = cut(rooted.join(F.broadcast(main) if many <= BROADCAST_ROWS else main, "grp").filter("root <> main").select("node", "root", "pieces"))
    if away.isEmpty():
        return links
    home = sets.join(rooted, ["node", "grp"]).select(F.xxhash64("grp", place).alias("key"), "node", "root", F.lit(False).alias("guest"), "items")
    guests = sets.join(away, "node").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    guests = guests.select(F.xxhash64("grp", F.col("at").cast("long")).alias("key"), "node", "root", F.lit(True).alias("guest"), "items")
    return links.unionByName(deal(home.unionByName(guests)))
