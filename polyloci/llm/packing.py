"""Operator 1, packing by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most `capacity` ids. The histogram of piece lengths (at most `capacity` numbers) is
all that the driver needs: lengths are placed longest first, each into the shortest pack that is open, and what changes
are counts of packing patterns. Pieces then find their pattern, sequence and offset by their rank among the pieces of
their length.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe_tokens import END_OF_TEXT, WordBpe
from .common import cut as cut_lineage
from .common import slices

CAPACITY = 2048
#: Pieces are cut shorter, halving the longest length, while more than this share of the places would be padding.
MOST_PADDING = 0.01
#: Ranks within a length are counted in groups; about this many groups in all, so that none is large.
RANK_GROUPS = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(tokens: int, capacity: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences first, then pieces of at most `longest`."""
    full = tokens // capacity * capacity
    return [(s, capacity) for s in range(0, full, capacity)] + [(s, min(longest, tokens - s)) for s in range(full, tokens, longest)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, longest: int | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece (PIECES), with its ids as an array if asked for. Null text is empty: one piece with the end id."""
    longest = longest or capacity

    def encode(batches):
        bpe = WordBpe.opened(tokenizer_path)
        end = np.array([END_OF_TEXT], "<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for doc, own in zip(batch.column(0).to_pylist(), bpe.many(batch.column(1).to_pylist()), strict=True):
                ids = own.astype("<u4").tobytes() + end
                n = len(ids) // 4
                for s, k in cuts(n, capacity, longest):
                    own = ids[4 * s : 4 * (s + k)]
                    rows.append((doc, s, k, zlib.crc32(own), n, *([np.frombuffer(own, "<u4").astype("<i4")] if with_ids else [])))
            if rows:
                cols = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:5]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.array([r[5] for r in rows], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return source.mapInArrow(encode, PIECES + (", ids array<int>" if with_ids else ""))


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, count) of packs that hold every length of the histogram; patterns are lengths, longest first."""
    open_packs: list[tuple[int, tuple[int, ...], int]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_packs and open_packs[0][0] + length <= capacity:
                total, pattern, count = heapq.heappop(open_packs)
                taken = min(left, count)
                if count > taken:
                    heapq.heappush(open_packs, (total, pattern, count - taken))
                heapq.heappush(open_packs, (total + length, (*pattern, length), taken))
                left -= taken
            else:  # all open packs are too full: new ones take as many pieces of this length as they hold
                each = min(left, capacity // length)
                heapq.heappush(open_packs, (each * length, (length,) * each, left // each))
                left %= each
    merged: dict[tuple[int, ...], int] = {}
    for _, pattern, count in open_packs:
        merged[pattern] = merged.get(pattern, 0) + count
    return sorted(merged.items(), reverse=True)


def padding_share(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> float:
    """Share of padding; a sequence whose ids are a power of two in number isn't padded."""
    used = sum(sum(p) * c for p, c in patterns)
    size = sum((sum(p) if sum(p) & (sum(p) - 1) == 0 else capacity) * c for p, c in patterns)
    return 1 - used / size if size else 0.0


def _recut(histogram: dict[int, int], capacity: int, longest: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for n, c in histogram.items():
        for _, k in cuts(n, capacity, longest):
            out[k] = out.get(k, 0) + c
    return out


def plan_cut(histogram: dict[int, int], capacity: int) -> int:
    """The longest piece below a whole sequence: capacity if that leaves little padding, else the first half that does."""
    tried = []
    longest = capacity
    while longest >= max(16, capacity // 64):
        share = padding_share(pack_histogram(_recut(histogram, capacity, longest), capacity), capacity)
        if share <= MOST_PADDING:
            return longest
        tried.append((share, -longest))
        longest //= 2
    return -min(tried)[1] if tried else capacity


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Ranks to places: (length, first rank, ranks, pieces of that length in the pattern, first sequence, offset)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            out.append((length, used.get(length, 0), each * count, each, sequence, offset))
            used[length] = used.get(length, 0) + each * count
            offset += each * length
        sequence += count
    return out


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """pieces with `rank`, from 0 among the pieces of their length, whatever the partitioning.

    A common length may hold a third of all pieces: lengths get groups in proportion to their counts, ranks are taken
    within a group and moved up by the counts of the groups before.
    """
    spark, total = pieces.sparkSession, max(1, sum(histogram.values()))
    groups = spark.createDataFrame([(k, max(1, RANK_GROUPS * c // total)) for k, c in histogram.items()], "length long, __groups long")
    mixed = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("__groups")).alias("__group")
    grouped = pieces.join(F.broadcast(groups), "length").select(*pieces.columns, mixed)
    sizes = sorted(tuple(r) for r in grouped.groupBy("length", "__group").count().collect())  # at most RANK_GROUPS + capacity rows
    firsts, before = [], {}
    for length, group, count in sizes:
        firsts.append((length, group, before.get(length, 0)))
        before[length] = before.get(length, 0) + count
    firsts = spark.createDataFrame(firsts, "length long, __group long, __first long")
    inside = F.row_number().over(W.partitionBy("length", "__group").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")).cast("long") - 1
    out = grouped.withColumn("__inside", inside).join(F.broadcast(firsts), ["length", "__group"])
    return out.withColumn("rank", F.col("__first") + F.col("__inside")).drop("__group", "__first", "__inside")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place: PIECES, then sequence_id and offset (and ids, if asked for).

    Each id, the end id of each document included, lies in exactly one piece. Offsets are gapless from 0 within a
    sequence; sequence ids are gapless from 0. Null texts count as empty and give one piece with the end id alone. Ids
    may be null or repeated: rows are kept apart. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    encode = lambda longest: cut_lineage(token_pieces(docs, tokenizer_path, capacity, longest, with_ids, id_col, text_col))
    pieces = encode(capacity)
    count = lambda: {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # noqa: E731  at most `capacity` rows
    histogram = count()
    longest = plan_cut(histogram, capacity)
    if longest != capacity:
        pieces = encode(longest)
        histogram = count()
    places = spark.createDataFrame(slots(pack_histogram(histogram, capacity)), "length long, first long, ranks long, each long, sequence long, base long")
    p, r = places.alias("p"), ranked(pieces, histogram).alias("r")
    found = r.join(F.broadcast(p), (F.col("r.length") == F.col("p.length")) & (F.col("r.rank") >= F.col("p.first")) & (F.col("r.rank") < F.col("p.first") + F.col("p.ranks")))
    nth = F.col("r.rank") - F.col("p.first")
    names = [F.col(f"r.{c}").alias(c) for c in pieces.columns]
    return found.select(
        *names,
        (F.col("p.sequence") + F.floor(nth / F.col("p.each"))).cast("long").alias("sequence_id"),
        (F.col("p.base") + nth % F.col("p.each") * F.col("r.length")).alias("offset"),
    )
