"""Operator 8, line dedup by an exact set-similarity join with prefix, positional and length filters.

A line is the set of its words. Lines of equal sets are one class. Words are ordered by rarity; two classes with Jaccard
similarity of at least 0.8 share a word among the first n - ceil(0.8 n) + 1 of both, have sizes within that ratio, and
have enough words left after the first word they share. Classes with any partner that passes, and whose words' parities
don't rule it out, come to the bucket of that word with their whole sets. Classes are sent to the buckets in blocks of many
postings, which are sorted where they arrive. There pairs are verified and counted, each in
the bucket of the first word that both share: what leaves a bucket is a count for each class, never a list of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffles_removed, stored

#: Similarity of at least NUM / DEN.
NUM, DEN = 4, 5
#: Word counts are kept in two rows of 2**CELL_BITS cells; a word's count is the smaller of its two cells'. Any order of
#: words gives the same result, so the size can be fixed: 16 MB are broadcast.
CELL_BITS, CELL_ROWS = 23, 2
_CELL_BLOCK = 1 << 16
#: Cells of the map of lines whose sets need verification, 16 MB; fixed too, and a collision only sends more sets.
PLACE_BITS = 27
#: Postings that are sorted at once, some 20 MB, on average: words are dealt to as many parts as that takes.
PART_POSTS = 300_000
#: Classes that share a word are compared in one piece up to this number, beyond it in blocks, two by two.
BLOCK = 4096
CHUNK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _MIX = 0x100000001B3, 0x9E3779B97F4A7C15
#: Masks of the lowest 0 to 8 bytes of a number.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def line_words(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(64-bit hash of each word, its line, number of lines). Lines end with a line feed; words are parted by ASCII space."""
    b = np.frombuffer(data, np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.concatenate(([0] if len(b) and not space[0] else [], edge, [len(b)] if len(b) and not space[-1] else [])).astype(np.int64)
    start, end = edge[::2], edge[1::2]
    feeds = np.flatnonzero(b == 10)
    eight = np.ndarray(len(b) + 1, "<u8", buffer=data + bytes(8), strides=(1,))  # the eight bytes from each place on
    left = end - start
    h = left.astype(np.uint64) * np.uint64(_BASE)
    which, at = slice(None), start
    while len(at):
        h[which] = (h[which] ^ (eight[at] & _LOWEST[np.minimum(left, 8)])) * np.uint64(_MIX)
        h[which] ^= h[which] >> np.uint64(32)
        more = np.flatnonzero(left > 8)
        which = more if isinstance(which, slice) else which[more]
        at, left = at[more] + 8, left[more] - 8
    h *= np.uint64(_MIX)
    h ^= h >> np.uint64(29)
    ends = np.searchsorted(start, feeds)
    line = np.repeat(np.arange(len(feeds) + 1), np.diff(ends, prepend=0, append=len(start)))
    return h, line, len(feeds)


def cells(word: np.ndarray, row: int) -> np.ndarray:
    return (word >> np.uint64(64 - CELL_BITS if row == 0 else 64 - 2 * CELL_BITS) & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)


def code(count: np.ndarray) -> np.ndarray:
    """A count in a byte, on a logarithmic scale: 0 for none, 1 for one, and so on up to 255 for some 290,000 and more."""
    return np.where(count > 0, np.minimum(255, 1 + np.rint(14 * np.log2(np.maximum(count, 1)))), 0).astype(np.uint8)


def rarity(word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The code of each word's count, or of a larger one."""
    out = counts[0][cells(word, 0)]
    for row in range(1, CELL_ROWS):
        out = np.minimum(out, counts[row][cells(word, row)])
    return out


def by_rank(word: np.ndarray, rank: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """The order by line, rank and word: by one number that has the word's upper bits, where these tell all words apart."""
    bits = int(lines).bit_length() + 8
    with np.errstate(over="ignore"):
        key = (line.astype(np.uint64) << np.uint64(8) | rank.astype(np.uint64)) << np.uint64(64 - bits) | word >> np.uint64(bits)
    order = np.argsort(key)
    key, sorted_word = key[order], word[order]
    if ((key[1:] == key[:-1]) & (sorted_word[1:] != sorted_word[:-1])).any():
        order = np.lexsort((word, rank, line))
    return order


class Lines:
    """The lines of some texts with their sets of words, ordered by rank within a line."""

    def __init__(self, data: bytes, counts: np.ndarray | None):
        word, line, self.n = line_words(data)
        rank = np.zeros(len(word), np.uint8) if counts is None else rarity(word, counts)
        order = by_rank(word, rank, line, self.n)
        word, line, rank = word[order], line[order], rank[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (line[1:] != line[:-1])
        self.word, self.line, self.rank = word[new], line[new], rank[new]
        self.first = np.searchsorted(self.line, np.arange(self.n))
        self.size = np.diff(np.append(self.first, len(self.line)))
        with np.errstate(over="ignore"):
            mixed = (self.word ^ (self.word >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
            ends = np.append(self.first[1:], len(self.line))
            key = total[ends] - total[self.first] if self.n else np.zeros(0, np.uint64)
            key = (key ^ (key >> np.uint64(30))) * np.uint64(_MIX) + self.size.astype(np.uint64)
        self.key = key.view(np.int64)

    def parity(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets by line): bit b of a set is the parity of the number of words that fall to it. Sets of over 64 and 128
        words have 128 and 256 bits instead of 64, which fold to fewer by exclusive or of their halves."""
        wide = 1 + (self.size > 64) + 2 * (self.size > 128)
        base = np.concatenate(([0], np.cumsum(wide)))
        bit = (self.word >> np.uint64(7)).astype(np.int64) & (64 * wide[self.line] - 1)
        odd = np.bincount(64 * base[self.line] + bit, minlength=64 * int(base[-1])) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little"), 8 * base


def _chunks(batch, column: int = 1):
    """(rows, data) of texts in pieces of about CHUNK bytes; each text ends with a line feed. A text isn't cut."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(batch.column(column).to_pylist()):
        data = (text or "").encode("utf-8", "surrogatepass") + b"\n"
        rows.append(i)
        parts.append(data)
        size += len(data)
        if size >= CHUNK:
            yield rows, parts
            rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def prefix_lengths(size: np.ndarray) -> np.ndarray:
    return size - -(-size * NUM // DEN) + 1


def word_counts(docs: DataFrame) -> np.ndarray:
    """Codes of how often the words of each cell occur, over all texts. Tasks send the cells they met, in blocks; a block is
    added up in one place, and the driver gets one byte a cell."""
    blocks = (1 << CELL_BITS) // _CELL_BLOCK

    def count(batches):
        total = np.zeros((CELL_ROWS, 1 << CELL_BITS), np.int32)
        for batch in batches:
            for _, parts in _chunks(batch, 0):
                word, _, _ = line_words(b"".join(parts))
                for row in range(CELL_ROWS):
                    met = np.sort(cells(word, row).astype(np.int32))  # cells in order: memory is walked, not jumped about in
                    start = np.flatnonzero(np.diff(met, prepend=-1))
                    total[row][met[start]] += np.diff(start, append=len(met)).astype(np.int32)
        for row in range(CELL_ROWS):
            for b in range(blocks):
                part = total[row, b * _CELL_BLOCK : (b + 1) * _CELL_BLOCK]
                met = np.flatnonzero(part)
                if len(met):
                    yield pa.RecordBatch.from_arrays([pa.array([row * blocks + b], pa.int32()), pa.array([met.astype("<u2").tobytes()], pa.binary()), pa.array([part[met].astype("<u4").tobytes()], pa.binary())], ["block", "cells", "counts"])

    def add(batches):
        block, total = None, np.zeros(_CELL_BLOCK, np.int64)

        def done():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([code(total).tobytes()], pa.binary())], ["block", "codes"])

        for batch in batches:
            for k, met, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != block:
                    if block is not None:
                        yield done()
                    block, total = k, np.zeros(_CELL_BLOCK, np.int64)
                total[np.frombuffer(met, "<u2")] += np.frombuffer(n, "<u4")
        if block is not None:
            yield done()

    met = docs.mapInArrow(count, "block int, cells binary, counts binary").repartition("block").sortWithinPartitions("block")
    out = np.zeros((CELL_ROWS, 1 << CELL_BITS), np.uint8)
    for k, codes in met.mapInArrow(add, "block int, codes binary").collect():  # CELL_ROWS * 2**CELL_BITS bytes in all
        row, b = divmod(k, blocks)
        out[row, b * _CELL_BLOCK : (b + 1) * _CELL_BLOCK] = np.frombuffer(codes, np.uint8)
    return out


def _lists(values: np.ndarray, line: np.ndarray, there: np.ndarray | None, n: int | None = None) -> pa.Array:
    """The values of each line as a list; null where it is not there, or else where it has none."""
    count = np.bincount(line, minlength=len(there) if n is None else n)
    offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()), mask=pa.array(count == 0 if there is None else ~there))


def _binaries(data: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


LINES = "id long, text_hash long, line long, class long, size int, parity binary, prefix array<long>, common array<long>"


def _lines(docs: DataFrame, counts) -> DataFrame:
    """One row per line of every text. Only where the class is new to the task: prefix, its rarest words without those that
    occur once in all texts and so can't be shared, 0 in their place, and common, those that may occur over BLOCK times."""

    def run(batches):
        seen: set[int] = set()
        often = int(code(np.array([BLOCK]))[0])
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for rows, parts in _chunks(batch):
                x = Lines(b"".join(parts), counts.value)
                per = np.array([p.count(b"\n") for p in parts])
                row = np.repeat(np.array(rows), per)
                nth = np.arange(x.n) - np.repeat(np.cumsum(per) - per, per)
                length = prefix_lengths(x.size)
                words = np.where(x.rank > 1, x.word, np.uint64(0)).view(np.int64)
                new = np.zeros(x.n, bool)
                for i in np.flatnonzero(x.size).tolist():
                    if (k := int(x.key[i])) not in seen:
                        seen.add(k)
                        new[i] = True
                own = new[x.line] & (np.arange(len(words)) - x.first[x.line] < length[x.line])
                many = own & (x.rank >= often)
                prefix, common = _lists(words[own], x.line[own], new), _lists(words[many], x.line[many], None, x.n)
                bits, at = x.parity()
                kept = np.repeat(new, np.diff(at))
                parity = _binaries(bits[kept], np.where(new, np.diff(at), 0))
                if len(seen) > 400_000:
                    seen.clear()
                cols = [pa.array([ids[r] for r in row], pa.int64()), pa.array([hashes[r] for r in row], pa.int64()), pa.array(nth), pa.array(x.key), pa.array(x.size.astype(np.int32)), parity, prefix, common]
                yield pa.RecordBatch.from_arrays(cols, ["id", "text_hash", "line", "class", "size", "parity", "prefix", "common"])

    return docs.mapInArrow(run, LINES)


def _parity_words(column: pa.Array) -> np.ndarray:
    """Parities of 64, 128 and 256 bits as rows of four numbers, zeros where there are fewer."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint64, count=int(at[-1]))
    out, wide = np.zeros((len(column), 4), np.uint64), np.diff(at)
    for k in range(4):
        has = wide > k
        out[has, k] = flat[at[:-1][has] + k]
    return out


def _parity_allows(parity: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether the sets of rows i and j may share as many words as needed: a bit in which they differ is a word that only one has.
    Sizes rise, so that row i's bits are as many as both have."""
    ok = np.ones(len(i), bool)
    for over, cols in ((0, ((0, 1, 2, 3),)), (64, ((0, 2), (1, 3))), (128, ((0,), (1,), (2,), (3,)))):
        at = np.flatnonzero(ok & (size[i] > over))
        if not len(at):
            break
        a, b = i[at], j[at]
        off = np.zeros(len(at), np.int64)
        for c in cols:
            x = parity[a, c[0]] ^ parity[b, c[0]]
            for k in c[1:]:
                x ^= parity[a, k] ^ parity[b, k]
            off += np.bitwise_count(x)
        ok[at] = (size[a] + size[b] - off) // 2 >= need[at]
    return ok


def with_partner(key: np.ndarray, size: np.ndarray, pos: np.ndarray, cls: np.ndarray, parity: np.ndarray, own: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Which rows pass the length, positional and parity filters with some other class of their key. Rows are sorted by key,
    then size; rows of one block (own, if not negative) meet elsewhere, and so do rows that have the first word of both
    (head, 0 where there is none before the key) in common."""
    out = np.zeros(len(key), bool)
    d, live = 1, np.arange(max(0, len(key) - 1))
    while len(live):
        i = live[live + d < len(key)]
        j = i + d
        near = (key[i] == key[j]) & (DEN * size[i] >= NUM * size[j])  # sizes rise within a key: no later row fits either
        i, j = i[near], j[near]
        live = i
        need = -(-NUM * (size[i] + size[j]) // (NUM + DEN))
        ok = (cls[i] != cls[j]) & ((own[i] < 0) | (own[i] != own[j])) & ((head[i] == 0) | (head[i] != head[j]))
        ok &= np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need
        ok[ok] = _parity_allows(parity, size, i[ok], j[ok], need[ok])
        out[i[ok]] = True
        out[j[ok]] = True
        d += 1
    return out


POSTS = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("class", pa.int64()), ("parity", pa.binary()), ("own", pa.int32()), ("head", pa.int64())])


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
        return x ^ (x >> np.uint64(29))


def _posts(batch, hot: np.ndarray, blocks: np.ndarray) -> list[pa.Array]:
    """The postings of classes (class, size, parity, prefix) as columns of POSTS; at is the size and the position in one number.
    head is the class's first word that is not alone in all texts; most similar classes share it, and then need to meet in no
    other bucket. Words of `hot` have several buckets, one for each two of their blocks of classes."""
    cls, size = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
    word, count = batch.column(3).flatten().to_numpy(), np.diff(batch.column(3).offsets.to_numpy())
    row = np.repeat(np.arange(len(count)), count)
    pos = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    there = word != 0
    key, row, pos = word[there], row[there], pos[there]
    begins = np.diff(row, prepend=-1) != 0
    first = np.zeros(len(count), np.int64)
    first[row[begins]] = key[begins]
    head = np.where(key != first[row], first[row], 0)
    own = np.full(len(key), -1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        n = np.where(hot[at] == key, blocks[at], 1)
        mine = (_mixed(cls.view(np.uint64))[row] % n.astype(np.uint64)).astype(np.int64)
        copy = np.repeat(np.arange(len(key)), n)
        other = np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)
        key, row, pos, head, n, mine = (x[copy] for x in (key, row, pos, head, n, mine))
        pair = (np.minimum(mine, other) << 32 | np.maximum(mine, other)).astype(np.uint64)
        key = np.where(n > 1, _mixed(_mixed(pair) ^ key.view(np.uint64)).view(np.int64), key)
        own = np.where(mine != other, mine, -1)  # two classes of one block meet in the bucket of that block alone
    return [pa.array(key), pa.array(size[row] << 32 | pos), pa.array(cls[row]), batch.column(2).take(pa.array(row)), pa.array(own.astype(np.int32)), pa.array(head)]


def _parts(classes: DataFrame, parts: int, hot: np.ndarray, blocks: np.ndarray) -> DataFrame:
    """(part, posts): the postings of all classes, with those of a bucket in one part; a row holds many, in Arrow's format."""
    shared = classes.sparkSession.sparkContext.broadcast((hot, blocks))

    def run(batches):
        held, number = [], 0

        def out():
            table = pa.Table.from_batches(held).combine_chunks()
            part = (_mixed(table.column(0).to_numpy().view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            table = table.take(pa.array(np.argsort(part, kind="stable"))).combine_chunks().to_batches()[0]
            end = np.cumsum(np.bincount(part, minlength=parts))
            there = np.flatnonzero(np.diff(end, prepend=0))
            blobs = [table.slice(a, b - a).serialize().to_pybytes() for a, b in zip([0, *end[there][:-1].tolist()], end[there].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "posts"])

        for batch in batches:
            held.append(pa.RecordBatch.from_arrays(_posts(batch, *shared.value), schema=POSTS))
            number += held[-1].num_rows
            if number >= PART_POSTS:
                yield out()
                held.clear()
                number = 0
        if number:
            yield out()

    return classes.mapInArrow(run, "part int, posts binary")


def _part_members(batches):
    """mapInArrow over (part, posts) sorted by part: _members() of each part."""
    at, held = None, []
    for batch in batches:
        for part, posts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part != at:
                yield from _members(held)
                at, held = part, []
            held.append(pa.ipc.read_record_batch(posts.as_buffer(), POSTS))
    yield from _members(held)


def _members(batches):
    """Of postings (POSTS), in any order, the rows (key, class, pos, own) that need verification in their bucket."""
    table = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    key = table.column(0).to_numpy()
    order = np.argsort(key)
    again = np.flatnonzero(np.diff(key[order]) == 0)
    shared = np.zeros(len(key), bool)
    shared[again] = shared[again + 1] = True
    order = order[shared]  # words of one class alone are done with
    order = order[np.lexsort((table.column(1).to_numpy()[order], key[order]))]
    key, at, cls, own, head = (table.column(c).to_numpy()[order].astype(np.int64) for c in (0, 1, 2, 4, 5))
    parity = np.concatenate([_parity_words(c) for c in table.column(3).chunks])[order]
    pos = at & 0xFFFFFFFF
    ok = with_partner(key, at >> 32, pos, cls, parity, own, head)
    yield pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array(cls[ok]), pa.array(pos[ok].astype(np.int32)), pa.array(own[ok].astype(np.int32))], ["key", "class", "pos", "own"])


def _place_cell(ids: np.ndarray, hashes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The cell of a line's place, as in place_cell()."""
    return ((hashes.view(np.uint64) >> np.uint64(64 - PLACE_BITS)).astype(np.int64) ^ ids ^ line) & ((1 << PLACE_BITS) - 1)


def place_cell() -> Column:
    cell = F.shiftrightunsigned("text_hash", 64 - PLACE_BITS).bitwiseXOR(F.coalesce("id", F.lit(0))).bitwiseXOR(F.col("line").cast("long"))
    return cell.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _sets(docs: DataFrame, wanted, counts) -> DataFrame:
    """(class, words) of the lines whose place's cell is set in the map `wanted`, words by rank; a class may come more than once.
    Other lines aren't parted into words."""

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column(0).fill_null(0).to_numpy(), batch.column(2).to_numpy()
            for rows, parts in _chunks(batch):
                per = np.array([p.count(b"\n") for p in parts])
                row, n = np.repeat(np.array(rows), per), int(per.sum())
                cell = _place_cell(ids[row], hashes[row], np.arange(n) - np.repeat(np.cumsum(per) - per, per))
                hit = np.flatnonzero((wanted.value[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1))
                if not len(hit):
                    continue
                data = b"".join(parts)
                end = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
                start = np.concatenate(([0], end[:-1]))
                x = Lines(b"".join([data[a:b] for a, b in zip(start[hit].tolist(), end[hit].tolist(), strict=True)]), counts.value)
                yield pa.RecordBatch.from_arrays([pa.array(x.key, pa.int64()), _binaries(x.word.view(np.uint8), 8 * x.size)], ["class", "words"])

    return docs.mapInArrow(run, "class long, words binary")


def few_links(words: list[list[int]], pos: list[int], own: list[int]) -> list[tuple[int, int]]:
    """Pairs of a small bucket that are similar and share no word before the bucket's, by plain sets."""
    sets = [frozenset(w) for w in words]
    out = []
    for j in range(1, len(sets)):
        for i in range(j):
            n, m = len(sets[i]), len(sets[j])
            if (own[i] < 0 or own[i] != own[j]) and DEN * n >= NUM * m and DEN * m >= NUM * n:
                if (NUM + DEN) * len(sets[i] & sets[j]) >= NUM * (n + m) and set(words[i][: pos[i]]).isdisjoint(words[j][: pos[j]]):
                    out.append((i, j))
    return out


def many_links(words: list[np.ndarray], pos: np.ndarray, own: np.ndarray):
    """As few_links(), for any number of rows sorted by size: for each row, the later ones that it links to."""
    size = np.array([len(w) for w in words], np.int64)
    start = np.concatenate(([0], np.cumsum(size)))
    _, code = np.unique(np.concatenate(words), return_inverse=True)
    early = np.arange(len(code)) - np.repeat(start[:-1], size) < np.repeat(pos, size)
    mark, first = np.zeros(len(code) + 1, bool), np.zeros(len(code) + 1, bool)
    for i in range(len(words) - 1):
        stop = int(np.searchsorted(size, size[i] * DEN // NUM, "right"))
        if stop <= i + 1:
            continue
        mine = code[start[i] : start[i + 1]]
        mark[mine] = True
        first[mine[: pos[i]]] = True
        part = slice(start[i + 1], start[stop])
        at = start[i + 1 : stop] - start[i + 1]
        shared = np.add.reduceat(mark[code[part]], at, dtype=np.int32)
        ok = (NUM + DEN) * shared >= NUM * (size[i] + size[i + 1 : stop])
        if own[i] >= 0:
            ok &= own[i + 1 : stop] != own[i]
        if ok.any():
            ok &= ~np.logical_or.reduceat(first[code[part]] & early[part], at)
        mark[mine] = False
        first[mine[: pos[i]]] = False
        hit = np.flatnonzero(ok)
        if len(hit):
            yield i, hit + i + 1


#: Buckets of up to so many classes are verified by plain sets.
FEW = 24
COUNTED = "class long, links long, has_id boolean, id long, text_hash long, line long"


def _counted(batches):
    """mapInArrow over (key, size, class, pos, own, words, has_id, id, text_hash, line) sorted by key and size: for each class
    with links in the bucket, how many, and the earliest place of the classes linked to (COUNTED)."""
    at, held = None, []

    def few():
        least: dict[int, tuple] = {}
        links: dict[int, int] = {}
        for pair in few_links([np.frombuffer(r[4], np.uint64).tolist() for r in held], [r[2] for r in held], [r[3] for r in held]):
            for i, j in (pair, pair[::-1]):
                links[i] = links.get(i, 0) + 1
                least[i] = min(least.get(i, held[j][5:9]), held[j][5:9])
        return [(held[i][1], n, *least[i]) for i, n in links.items()]

    def out():
        if len(held) <= FEW:
            return few()
        cls = np.array([r[1] for r in held], np.int64)
        pos, own = np.array([r[2] for r in held]), np.array([r[3] for r in held])
        words = [np.frombuffer(r[4], np.uint64) for r in held]
        place = np.empty(len(held), np.int64)
        place[np.lexsort([np.array([r[c] for r in held], np.int64) for c in (8, 7, 6, 5)])] = np.arange(len(held))
        links, least = np.zeros(len(held), np.int64), np.full(len(held), len(held))
        for i, hit in many_links(words, pos, own):
            links[i] += len(hit)
            links[hit] += 1
            least[i] = min(least[i], place[hit].min())
            least[hit] = np.minimum(least[hit], place[i])
        who = np.empty(len(held), np.int64)
        who[place] = np.arange(len(held))
        return [(int(cls[i]), int(links[i]), *held[who[least[i]]][5:9]) for i in np.flatnonzero(links)]

    def batch_of(rows):
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["class", "links", "has_id", "id", "text_hash", "line"])

    for batch in batches:
        found = []
        for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != at:
                if len(held) > 1:
                    found += out()
                at, held = key, []
            held.append(row)
        if found:
            yield batch_of(found)
    if len(held) > 1 and (found := out()):
        yield batch_of(found)


def class_links(docs: DataFrame, lines: DataFrame, counts, firsts: DataFrame) -> DataFrame:
    """(class, links, other) of the classes with links: the number of classes with similarity of at least NUM / DEN, and the
    earliest place of these; checkpointed. firsts: (class, first), the place of each class."""
    spark = docs.sparkSession
    hot = lines.filter("common IS NOT NULL").select("class", F.explode("common").alias("key"))
    hot = cut(hot.groupBy("key").agg(F.count("*").alias("count")).filter(F.col("count") > BLOCK))
    # At most one of BLOCK postings' words; a posting goes to as many buckets as its word's classes have blocks.
    hot = hot.select("key", F.ceil(F.col("count") / F.lit(BLOCK)).alias("blocks"), (F.col("count") * (F.ceil(F.col("count") / F.lit(BLOCK)) - 1)).alias("more")).orderBy("key").toArrow()
    classes = lines.filter("prefix IS NOT NULL").select("class", "size", "parity", "prefix")
    number = (classes.agg(F.sum(F.size("prefix"))).first()[0] or 0) + int(hot["more"].to_numpy().sum())
    parts = -(-number // PART_POSTS) or 1
    posts = _parts(classes, parts, hot["key"].to_numpy(), hot["blocks"].to_numpy())
    # A class may come from several tasks, and so more than once to a bucket.
    with shuffles_removed(spark):
        found = posts.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_part_members, "key long, class long, pos int, own int")
        member = stored(found.distinct(), "members")
    known = member.select("class").distinct().join(firsts, "class").select("class", "first.*")
    with shuffles_removed(spark):
        known = stored(known, "verified")
    bits = known.withColumn("cell", place_cell()).groupBy(F.shiftright("cell", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(cell & 63))")).alias("bits")).toArrow()  # at most 2**PLACE_BITS / 64 rows
    wanted = np.zeros((1 << PLACE_BITS) // 64, np.uint64)
    if bits.num_rows:
        wanted[bits["at"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    sets = _sets(docs, spark.sparkContext.broadcast(wanted), counts).dropDuplicates(["class"])
    placed = sets.join(known, "class").select("class", "words", F.octet_length("words").alias("size"), F.col("id").isNotNull().alias("has_id"), F.coalesce("id", F.lit(0)).alias("id"), "text_hash", "line")
    both = member.join(placed, "class").select("key", "size", "class", "pos", "own", "words", "has_id", "id", "text_hash", "line")
    found = both.repartition("key").sortWithinPartitions("key", "size").mapInArrow(_counted, COUNTED)
    other = F.struct(F.when(F.col("has_id"), F.col("id")).alias("id"), "text_hash", "line")
    return cut(found.groupBy("class").agg(F.sum("links").alias("links"), F.min(other).alias("other")))


def line_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of every document: id_col, line (from 0), class_id, links, kept.

    Lines end with a line feed; a null text counts as one empty line. class_id is a hash of the set of words, links the
    number of other classes with similarity of at least 0.8, and kept is false where an earlier line, by id and line
    number, has the same set or a similar one, whether that line is itself kept or not. Lines without words have class
    null, no links, and are kept. Null ids sort first; of repeated rows, the one with the smaller text hash comes first,
    and rows equal in both count as one place. Other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    counts = spark.sparkContext.broadcast(word_counts(source.select("text")))
    lines = stored(_lines(source, counts), "lines")
    place = F.struct("id", "text_hash", "line")
    with shuffles_removed(spark):
        firsts = stored(lines.filter("size > 0").groupBy("class").agg(F.min(place).alias("first")), "classes")
    found = class_links(source, lines, counts, firsts)
    info = firsts.join(found, "class", "left").select("class", "first", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce(F.col("other") < F.col("first"), F.lit(False)).alias("later"))
    empty = F.col("size") == 0
    out = lines.select("id", "text_hash", "line", "class", "size").join(info, "class", "left")
    return out.select(
        F.col("id").alias(id_col), "line",
        F.when(~empty, F.col("class")).alias("class_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("links")).cast("long").alias("links"),
        (empty | ((F.col("first") == place) & ~F.col("later"))).alias("kept"),
    )
