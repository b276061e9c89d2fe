"""Operator 13, phrase collocation mining: frequent phrases by Misra-Gries summaries per hash partition, counted exactly in a
second pass, then scored against their best cut.

Texts are cut into pieces and words, and every phrase of up to four words within a piece is a 64-bit hash of its language and
words, all in NumPy. (1) Each task combines its phrases by hash and sends them as blocks by hash partition, after their
masses. A partition's blocks are merged into one summary of more counters than mass / least, so that no phrase of `least`
occurrences can be lost. What survives is a bit map. Words come first, then pairs of surviving words, then longer
phrases of surviving pairs: a phrase is no more frequent than its parts. (2) A last pass over the texts counts the survivors,
by their words and not by their hashes, so a collision of hashes can only let through a phrase that is dropped later.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .misra_gries import Summary, capacity, combined

LEAST, LONGEST, TOP, INSIDE_PERCENT = 30, 4, 2000, 80
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Texts are worked on in parts of so many bytes, cut after a break: about 40 bytes of arrays a byte of text.
PART_BYTES = 2 << 20
#: Phrases a task holds before it writes them out: as hashes, as Python objects, and as rows of a table of some 40 bytes each.
MOST_HASHES, MOST_PHRASES, MOST_COUNTED = 2_000_000, 100_000, 1_200_000
#: Bits of a survivor map: about 16 a survivor, and no more than 2**MAP_BITS (32 MB). Beyond that the map only lets more through.
MAP_BITS = 28
#: Hash partitions: a power of two near the number of input partitions, so that a summary stays as small as a task's input.
LEAST_PARTS, MOST_PARTS = 1 << 6, 1 << 16
RANK_GROUPS = (1024, 32, 1)

#: keys: 32 bits of each hash after those that name the partition, by ascending count and then key, packed; counts: (count, keys
#: with it). Two phrases with the same bits count as one here, which can only let more survive. A row without keys tells the
#: mass of a block and comes before all blocks.
BLOCKS = "part int, keys binary, counts binary, mass long"
COUNTED = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrase", pa.binary()), ("words", pa.int32()), ("count", pa.int64())])

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(SPACES)], _CLASS[list(BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
_ODD, _ODD2, _MIX, _HALF = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 32))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _HALF)
    h *= _MIX
    h ^= h >> _HALF
    h *= _MIX
    h ^= h >> _HALF
    return h


def pack_keys(keys: np.ndarray) -> bytes:
    """32-bit keys that mostly ascend, as their differences, byte by byte of all, compressed: some 2.3 bytes a key."""
    steps = np.diff(keys, prepend=keys.dtype.type(0)).astype("<u4")
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpack_keys(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * count, codec="zstd", asbytes=True), np.uint8).reshape(4, count)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


class Words:
    """The words of a buffer of whole pieces: bytes in lower case, starts, ends, the piece and the hash of each word."""

    def __init__(self, data: np.ndarray):
        self.data = _LOWER[data]
        kind = _CLASS[data]
        inside = kind == 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        if len(edge) % 2:
            edge = np.concatenate((edge, [len(data)]))
        self.start, self.end = edge[0::2], edge[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.start]
        size = self.end - self.start
        wide = np.concatenate((self.data, np.zeros(8, np.uint8)))
        eight = np.ndarray(len(data) + 1, "<u8", wide.data, strides=(1,))  # eight bytes from each place on
        h = _mixed((eight[self.start] & _LOW_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD)
        at, rest = 8, np.flatnonzero(size > 8)
        while len(rest):
            more = eight[self.start[rest] + at] & _LOW_BYTES[np.minimum(size[rest] - at, 8)]
            h[rest] = _mixed(h[rest] * _ODD + more)
            at += 8
            rest = rest[size[rest] > at]
        self.hash = h

    def __len__(self) -> int:
        return len(self.start)

    def joined(self, first: int, words: int) -> bytes:
        """So many words from word `first` on, with single spaces."""
        return b" ".join(self.data[self.start[first] : self.end[first + words - 1]].tobytes().split())


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts of a batch, each of which ends with a break, in parts that end with one; and the rows' starts in the part."""
    text = batch.column(0)
    wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
    ends = np.frombuffer(text.buffers()[1], wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    at = 0
    while at < len(data):
        to = min(at + PART_BYTES, len(data))
        while to < len(data) and _CLASS[data[to - 1]] != 2:
            more = np.flatnonzero(_CLASS[data[to : to + PART_BYTES]] == 2)
            to = to + int(more[0]) + 1 if len(more) else min(to + PART_BYTES, len(data))
        yield data[at:to], ends[:-1] - at
        at = to


class Languages:
    """Each language's 64-bit hash, kept while few are known."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, names: list[str]) -> np.ndarray:
        if len(self.known) > 10_000:
            self.known.clear()
        for x in names:
            if x not in self.known:
                self.known[x] = int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.array([self.known[x] for x in names], np.uint64)


def _grams(batch: pa.RecordBatch, languages: Languages) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """Words of the parts of a batch, the row that each word is in, and the hash of each with its language."""
    own = languages.hashes(batch.column(1).to_pylist())
    for data, starts in _parts(batch):
        words = Words(data)
        of = np.repeat(np.arange(len(starts)), np.diff(np.searchsorted(words.start, starts), append=len(words)))
        yield words, of, _mixed(words.hash ^ own[of])


def _longer(hashes: np.ndarray, words: Words, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word phrases at some words, from those (one for each of `at`) of the phrases a word shorter."""
    return _mixed(hashes * _ODD + words.hash[at + n - 1])


def _within(words: Words, at: np.ndarray, n: int) -> np.ndarray:
    """Is there a piece with n words from these words on?"""
    last = np.minimum(at + n - 1, len(words) - 1)
    return (at + n <= len(words)) & (words.piece[at] == words.piece[last])


class SurvivorMap:
    """A bit map over the first bits of a hash. Holds every survivor, and lets some others through."""

    def __init__(self, bits: int, data: np.ndarray):
        self.shift, self.data = np.uint64(64 - bits), data

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        cell = hashes >> self.shift
        return (self.data[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _surviving(words: Words, single: np.ndarray, maps: dict[int, SurvivorMap], lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, words, hashes) of the phrases of each length whose known parts survive, in ascending length."""
    at, hashes = np.arange(len(words)), single
    for n in range(1, max(lengths) + 1):
        if n > 1:
            # Both phrases of n - 1 words, from this word and from the next one on, are among those left.
            left = np.zeros(len(words) + 1, bool)
            left[at] = True
            ok = left[at + 1] & _within(words, at, n)
            at, hashes = at[ok], _longer(hashes[ok], words, at[ok], n)
        if n in maps:
            ok = maps[n].holds(hashes)
            at, hashes = at[ok], hashes[ok]
        if n in lengths:
            yield n, at, hashes


def _summaries(docs: DataFrame, maps, lengths: tuple[int, ...], part_bits: int) -> DataFrame:
    """BLOCKS: the tasks' combined counts of phrases of these lengths, by hash partition."""

    def run(batches):
        languages, known = Languages(), maps.value if maps else {}
        waiting, rows = [], 0

        def out(keys, counts):
            edges = np.searchsorted(keys, np.arange(1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits))
            edges = np.append(edges, len(keys)).tolist()
            short = (keys >> np.uint64(32 - part_bits)).astype(np.uint32)
            rows = []
            for part, (start, end) in enumerate(zip(edges, edges[1:], strict=False)):
                if start < end:
                    own = counts[start:end]
                    order = np.argsort(own, kind="stable")
                    value, run = np.unique(own, return_counts=True)
                    rows.append((part, pack_keys(short[start:end][order]), np.stack((value, run)).astype("<u4").tobytes(), int(own.sum())))
            rows += [(part, None, None, mass) for part, _, _, mass in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["part", "keys", "counts", "mass"])

        for batch in batches:
            for words, _, single in _grams(batch, languages):
                for _, _, hashes in _surviving(words, single, known, lengths):
                    waiting.append(np.unique(hashes, return_counts=True))
                    rows += len(waiting[-1][0])
                if rows >= MOST_HASHES:
                    keys, counts = combined(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                    waiting, rows = [(keys, counts)], len(keys)
                    if rows >= MOST_HASHES // 2:
                        yield out(keys, counts)
                        waiting, rows = [], 0
        if rows:
            yield out(*combined(*(np.concatenate(x) for x in zip(*waiting, strict=True))))

    return docs.mapInArrow(run, BLOCKS)


def _survivors(grams: DataFrame, least: int, part_bits: int) -> SurvivorMap:
    """Merges the blocks of each hash partition into one summary, and maps what may occur `least` times.

    The masses of a partition's blocks come before the blocks, so that its summary has its capacity from the start. The driver
    sees one map of at most 2**MAP_BITS bits, in compressed slices, and keeps about 16 bits of it for each survivor.
    """
    own = MAP_BITS - part_bits

    def run(batches):
        part, mass, summary = None, 0, None

        def out():
            keys = summary.at_least(least)
            held = np.zeros(1 << own, np.uint8)
            held[keys >> np.uint32(32 - own)] = 1
            packed = pa.compress(np.packbits(held, bitorder="little").tobytes(), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([packed], pa.binary())], ["part", "n", "held"])

        for batch in batches:
            for p, keys, counts, more in zip(*(batch.column(i) for i in range(4)), strict=True):
                if p.as_py() != part:
                    if summary:
                        yield out()
                    part, mass, summary = p.as_py(), 0, None
                if not keys.is_valid:
                    mass += more.as_py()
                    continue
                summary = summary or Summary(capacity(mass, least))
                value, run = np.frombuffer(counts.as_buffer(), "<u4").reshape(2, -1).astype(np.int64)
                summary.merge(unpack_keys(keys.as_py(), int(run.sum())), np.repeat(value, run))
        if summary:
            yield out()

    dealt = grams.repartition("part").sortWithinPartitions("part", F.col("keys").isNotNull())
    slices = dealt.mapInArrow(run, "part int, n long, held binary").collect()
    bits = min(MAP_BITS, max(part_bits + 3, (16 * sum(r["n"] for r in slices)).bit_length()))
    data = np.zeros(1 << (bits - 3), np.uint8)
    each, fold = 1 << (bits - part_bits - 3), 1 << (MAP_BITS - bits)
    for r in slices:
        held = np.unpackbits(np.frombuffer(pa.decompress(r["held"], 1 << (own - 3), codec="zstd", asbytes=True), np.uint8), bitorder="little")
        data[r["part"] * each : (r["part"] + 1) * each] = np.packbits(held.reshape(-1, fold).max(1), bitorder="little")
    return SurvivorMap(bits, data)


def _added(tables: list[pa.Table]) -> pa.Table:
    """The tables as one, each phrase of a language once."""
    rows = pa.concat_tables(tables).group_by(["part", "lang", "phrase", "words"]).aggregate([("count", "sum")])
    return rows.rename_columns(["count" if c == "count_sum" else c for c in rows.column_names]).select(COUNTED.names)


def _packed(rows: pa.Table) -> pa.RecordBatch:
    """One row a hash partition, with its phrases in ascending order, compressed."""
    rows = rows.sort_by([("part", "ascending"), ("lang", "ascending"), ("phrase", "ascending")]).combine_chunks()
    part = rows["part"].to_numpy()
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    blobs = []
    for start, end in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
        sink = pa.BufferOutputStream()
        own = pa.concat_tables([rows.slice(start, end - start)]).combine_chunks()
        with pa.ipc.new_stream(sink, COUNTED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(own)
        blobs.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(blobs, pa.binary())], ["part", "rows"])


def _exact(docs: DataFrame, maps, longest: int, least: int, part_bits: int) -> DataFrame:
    """(lang, phrase, words, count): exact counts of surviving phrases by their words, from `least` on, and of all words of a
    language (as the phrase of no words). Tasks send their counts packed by hash partition."""

    def count(batches):
        languages, known = Languages(), maps.value
        found: dict[tuple, list] = {}
        totals: dict[str, int] = {}
        tables: list[pa.Table] = []
        shift = 64 - part_bits

        def close():
            rows = [(key >> shift, lang, phrase, n, count) for (key, _), (count, phrase, lang, n) in found.items()]
            rows += [(0, x, b"", 0, c) for x, c in totals.items()]
            found.clear()
            totals.clear()
            if rows:
                tables.append(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), COUNTED.types, strict=True)], schema=COUNTED))

        for batch in batches:
            names = batch.column(1).to_pylist()
            for words, of, single in _grams(batch, languages):
                for row, count in zip(*(x.tolist() for x in np.unique(of, return_counts=True)), strict=True):
                    totals[names[row]] = totals.get(names[row], 0) + count
                other = _mixed(words.hash * _ODD2)  # a second hash: 128 bits tell phrases apart within a task
                for n, at, hashes in _surviving(words, single, known, tuple(range(1, longest + 1))):
                    if not len(at):
                        continue
                    second = other[at].copy()
                    for i in range(1, n):
                        second = _mixed(second * _ODD2 + other[at + i])
                    order = np.lexsort((second, hashes))
                    a, b = hashes[order], second[order]
                    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                    count = np.diff(first, append=len(a))
                    for key, key2, c, i in zip(a[first].tolist(), b[first].tolist(), count.tolist(), at[order[first]].tolist(), strict=True):
                        row = found.get((key, key2))
                        if row is None:
                            found[key, key2] = [c, words.joined(i, n), names[of[i]], n]
                        else:
                            row[0] += c
                if len(found) >= MOST_PHRASES or len(totals) >= MOST_PHRASES:
                    close()
                    if sum(len(t) for t in tables) >= MOST_COUNTED:
                        tables = [_added(tables)]
                        if len(tables[0]) >= MOST_COUNTED * 3 // 4:
                            yield _packed(tables.pop())
        close()
        if tables:
            yield _packed(_added(tables))

    def add(batches):
        part, tables = None, []

        def out():
            rows = _added(tables)
            rows = rows.filter((pc.field("count") >= least) | (pc.field("words") == 0)).select(["lang", "phrase", "words", "count"])
            return rows.combine_chunks().to_batches()

        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != part:
                    if tables:
                        yield from out()
                    part, tables = p, []
                tables.append(pa.ipc.open_stream(blob.as_buffer()).read_all())
                if sum(len(t) for t in tables) >= MOST_COUNTED:
                    tables = [_added(tables)]
        if tables:
            yield from out()

    packed = docs.mapInArrow(count, "part int, rows binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(add, "lang string, phrase binary, words int, count long")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, words, count): every phrase of 1 to `longest` words with `least` occurrences in its language or more,
    and for each language a row of no words with the number of all its words."""
    spark = docs.sparkSession
    own = docs.select(F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    parts = min(max(own.rdd.getNumPartitions(), LEAST_PARTS), MOST_PARTS)
    part_bits = (parts - 1).bit_length()
    maps: dict[int, SurvivorMap] = {}
    for lengths in [(n,) for n in range(1, min(longest, 2) + 1)] + ([tuple(range(3, longest + 1))] if longest > 2 else []):
        sent = spark.sparkContext.broadcast(dict(maps)) if maps else None
        found = _survivors(_summaries(own, sent, lengths, part_bits), least, part_bits)
        maps |= dict.fromkeys(lengths, found)
    counted = _exact(own, spark.sparkContext.broadcast(maps), longest, least, part_bits)
    return stored(counted.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "count"), "phrases")


def _first_words(words: Column, k: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(1), k), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside_percent: int = INSIDE_PERCENT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The `top` phrases of 2 to `longest` words of each language: lang, rank (from 1), phrase, a (its occurrences), l and r
    (those of the parts of its lowest-scoring cut), n (all words of the language), score = floor(2000000 a / (l + r)).

    A-Z count as lower case; pieces end at ``.,;:!?`` and line breaks, words at spaces and tabs, and a phrase lies within a
    piece. Occurrences may overlap. A phrase is left out where a longer one that contains it has `inside_percent` of its
    occurrences or more. Order: score, then a, descending, then phrase in byte order. Null text is empty, null lang is
    `und`; repeated rows count again; ids and other columns are not read; an empty table, or one without a phrase that
    is frequent enough, gives no rows. A piece of any length is worked on whole, by one task.
    """
    counts = phrase_counts(docs, least, longest, text_col, lang_col)
    grams = counts.filter("words > 0").select("lang", "phrase", F.col("count").alias("a"), "words")
    long_ones = grams.filter("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = long_ones.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _first_words(F.col("w"), F.col("k")).alias("__left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ").alias("__right"))
    side = lambda part, n: grams.select(F.col("lang"), F.col("phrase").alias(part), F.col("a").alias(n))
    cuts = cuts.join(side("__left", "l"), ["lang", "__left"]).join(side("__right", "r"), ["lang", "__right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("product", wide("a") * F.lit(2_000_000).cast("decimal(7,0)")).withColumn("sum", wide("l") + wide("r"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("product div sum").alias("score"), "k", "a", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "cut.*").drop("k")

    inner = long_ones.filter("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("from"), F.col("size")), " ").alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside_percent))
    # The first `top` of many hash groups of a language, then of few, then of the language: no task ranks a whole language.
    order, ranked = [F.desc("score"), F.desc("a"), "phrase"], kept
    for groups in RANK_GROUPS:
        some = F.pmod(F.xxhash64("phrase"), F.lit(groups))
        ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("lang", some).orderBy(*order))).filter(F.col("rank") <= top)
    n = counts.filter("words = 0").select("lang", F.col("count").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
