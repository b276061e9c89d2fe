"""Operator 5, SimHash near-dedup with a generalised pigeonhole over partitions of correlated bits.

Two fingerprints within `radius` bits differ by at most t_i bits in some partition i if the (t_i + 1) add up to
radius + 1. Bits that go together are put in one partition, and the t_i (-1: not looked at) are set by dynamic
programming on the candidate counts that the bits' joint frequencies over all fingerprints predict. A partition with
t_i > 0 is probed with t_i of its bits masked out, in every way, so both sides of a link meet in one bucket.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, fresh, slices, without
from .components import components
from .jaccard import SEED, SPAN, shingle_set, similar_links, text_sets

BITS = 64
#: Relative costs of writing one probe and of comparing one candidate pair.
PROBE, VERIFY = 300.0, 1.0
#: Buckets up to this size are compared in one piece; larger ones are cut in blocks, compared two by two.
BLOCK = 2048


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of XXH64 (seed 42) of the text's word shingles, repeats included, A-Z lower-cased; 0 without words.

    A text of fewer words is one shingle. Bit b is 1 if it is set in over half of the hashes.
    """
    from xxhash import xxh64_intdigest

    data = (text or "").encode("utf-8", "surrogatepass").lower()
    ones, total = np.zeros(BITS, np.int64), 0
    held: list[bytes] = []
    start = 0
    while start < len(data) or start == 0:
        stop = min(len(data), start + SPAN)
        while stop < len(data) and data[stop] not in b" \t\n\r\x0b\x0c":
            stop += 1
        tokens = held + data[start:stop].split()
        if len(tokens) >= words:
            shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
            h = np.fromiter(map(xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64, len(tokens) - words + 1)
            for s in range(0, len(h), 1 << 16):
                part = h[s : s + (1 << 16)]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
            total += len(h)
        held = tokens[-(words - 1) :] if words > 1 else []
        start = stop
        if stop >= len(data):
            break
    if not total:
        if not held:
            return 0
        return xxh64_intdigest(b" ".join(held), SEED)
    return int(sum(1 << b for b in range(BITS) if 2 * ones[b] > total))


def set_fingerprint(text: str | None, words: int) -> int:
    """As fingerprint(), but each shingle counts once, however often it occurs."""
    h = shingle_set(text, words)
    ones = np.zeros(BITS, np.int64)
    for s in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[s : s + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """(id, fp, text_hash) of every row; fp is the fingerprint's 64 bits as a signed LONG. once: of sets of shingles."""
    one = set_fingerprint if once else fingerprint

    def run(batches):
        for batch in slices(batches):
            fp = np.array([one(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], ["id", "fp", "text_hash"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col), F.xxhash64(text_col).alias("text_hash"))
    return source.mapInArrow(run, "id long, fp long, text_hash long")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set, for all i and j; 64 x 64 numbers from all rows."""

    def run(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for s in range(0, len(bits), 1 << 20):
                total += (bits[s : s + (1 << 20)].T @ bits[s : s + (1 << 20)]).astype(np.int64)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "n"])

    out = np.zeros((BITS, BITS), np.int64)
    for i, j, n in fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        out[i, j] = n
    return out


def group_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in partitions of nearly equal width: each starts with a free bit and takes the bits most correlated to it."""
    p = np.diag(counts) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((counts / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        seed = max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))
        group = [seed]
        free.discard(seed)
        while len(group) < width:
            best = max(free, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            free.discard(best)
        out.append(group)
    return out


def agreement(counts: np.ndarray, n: int, group: list[int]) -> np.ndarray:
    """For each bit of a group, in order: the chance that two fingerprints agree on it, given that they agree on the
    bit before it that it depends on most."""
    p = np.diag(counts) / max(n, 1)
    alone = p**2 + (1 - p) ** 2
    out = []
    for at, b in enumerate(group):
        best = alone[b]
        for a in group[:at]:
            both = counts[a, b] / max(n, 1)
            cells = np.array([both, p[a] - both, p[b] - both, 1 - p[a] - p[b] + both])
            best = max(best, (cells**2).sum() / alone[a])
        out.append(min(1.0, best))
    return np.array(out)


def plan_probes(counts: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition looked at, of the cheapest way to find all links within the radius."""
    best: tuple[float, list] = (math.inf, [])
    n = max(n, 2)  # an empty table would make all plans cost nothing
    for parts in range(1, radius + 2):
        groups = group_bits(counts, n, parts)
        cost = []
        for g in groups:
            agree = agreement(counts, n, g)
            pairs = n * (n - 1) / 2 * agree.prod()
            row = [0.0]  # threshold -1
            loose = 1.0  # sum over masks of 1 / product of the masked bits' agreement
            sums = [1.0] + [0.0] * radius
            for a in agree:
                for e in range(radius, 0, -1):
                    sums[e] += sums[e - 1] / a
            for e in range(radius + 1):
                loose = sums[e]
                # no probe masks out more bits than there are: such a threshold must not look free
                row.append(PROBE * n * math.comb(len(g), e) + VERIFY * pairs * loose if e <= len(g) else math.inf)
            cost.append(row)
        # least[s]: cost and thresholds of the partitions so far, with sum of (threshold + 1) = s
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            after: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in least.items():
                for e in range(-1, radius + 1 - s):
                    option = (c + row[e + 1], [*chosen, e])
                    if s + e + 1 not in after or option < after[s + e + 1]:
                        after[s + e + 1] = option
            least = after
        c, chosen = least[radius + 1]
        if c < best[0]:
            best = (c, [(g, e) for g, e in zip(groups, chosen, strict=True) if e >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def probe_masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """The bits each probe keeps."""
    return [_signed(sum(1 << b for b in set(g) - set(left))) for g, e in plan for left in itertools.combinations(g, e)]


def _near(a: np.ndarray, b: np.ndarray | np.uint64, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def spanning_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within the buckets of sorted keys; fewer than there are rows."""
    links: list[tuple[int, int]] = []
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    for s, n in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
        rest = fps[s : s + n]
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                hit = _near(rest, x, radius)
                if hit.any():
                    links += [(int(x), int(y)) for y in rest[hit]]
                    front += list(rest[hit])
                    rest = rest[~hit]
    few = np.repeat(sizes <= 32, sizes)
    keys, fps = keys[few], fps[few]
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def find(x):
        while x in parent:
            x = parent[x]
        return x

    for d in range(1, 32):
        if d >= len(keys):
            break
        near = np.flatnonzero((keys[d:] == keys[:-d]) & _near(fps[d:], fps[:-d], radius))
        for i in near:
            x, y = (keys[i], int(fps[i])), (keys[i], int(fps[i + d]))
            a, b = find(x), find(y)
            if a != b:
                parent[a] = b
                links.append((x[1], y[1]))
    return links


def _links(batches, radius: int):
    """mapInArrow over (key, fp) sorted by key: links (a, b)."""
    held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(k, f):
        found = spanning_links(k, f, radius) if len(k) > 1 else []
        if found:
            ab = np.array(found, np.uint64).view(np.int64)
            return [pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])]
        return []

    for batch in batches:
        k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(k):
            continue
        last = int(np.searchsorted(k, k[-1], "left"))
        yield from out(k[:last], f[:last])
        held_k, held_f = k[last:], f[last:]
    yield from out(held_k, held_f)


def near_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect all that lie within `radius` bits of one another.

    Not every close pair is listed, but each is connected by links within one bucket: groups of any size give links in
    proportion to their members.
    """
    n = nodes.count()
    masks = probe_masks(plan_probes(bit_counts(nodes), n, radius))
    keyed = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    entries = nodes.select("fp", F.explode(keyed).alias("key"))
    hot = cut(entries.groupBy("key").count().filter(F.col("count") > BLOCK))
    many = hot.count()
    if many:
        side = F.broadcast(hot) if many <= 10_000 else hot
        blocks = F.ceil(F.col("count") / F.lit(BLOCK)).cast("int")
        entries = entries.join(side, "key", "left").withColumn("blocks", F.coalesce(blocks, F.lit(1)))
        entries = entries.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        entries = entries.select("fp", F.when(F.col("blocks") > 1, pair).otherwise(F.col("key")).alias("key"))
    dealt = entries.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp")
    return dealt.mapInArrow(lambda batches: _links(batches, radius), "a long, b long")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def labels(rows: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, fp, text_hash, root, component_id) of every row; root is the component's least fp by links(nodes)."""
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(nodes)).withColumnRenamed("id", "fp")
    member = cut(found.join(nodes, "fp"))
    heads = cut(member.groupBy("root").agg(F.min("least").alias("head")))
    heads = cut(member.select("fp", "root").join(heads, "root").select("fp", "root", "head"))
    label = cut(nodes.join(heads, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("head", "least").alias("component_id")))
    return rows.join(label, "fp")


def labelled(docs: DataFrame, words: int, radius: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, text_hash, root, component_id) of every row; root is the component's least fingerprint."""
    return labels(cut(fingerprints(docs, words, id_col, text_col)), lambda nodes: near_links(nodes, radius))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, fingerprint (16 hex digits), component_id.

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest id that can be reached over
    links, the document's own included. Null and empty texts have fingerprint 0, which links like any other. Null ids
    are kept and never are a component's id unless it has no other. Repeated rows fall in one component. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = labelled(docs, words, radius, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, the one with the smallest id; columns unchanged.

    Where several rows of a component share that id, the one with the least text hash stays, and one of rows that
    repeat both. Rows are matched by id and text hash, so other rows of a repeated id are not touched.
    """
    return drop_labelled(docs, cut(labelled(docs, words, radius, id_col, text_col)), id_col, text_col)


def drop_labelled(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows that `rows` (as of labels, checkpointed) has in a component but not at its head."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    ident, digest, row_digest = (fresh(docs, x) for x in ("gone_id", "gone_hash", "row_hash"))
    head = F.col("id").eqNullSafe(F.col("component_id"))
    heads = rows.filter(head).groupBy("root", "component_id").agg(F.min("text_hash").alias("least"), F.count("*").alias("n")).filter("n > 1")
    heads = cut(heads)
    lost = rows.filter(~head).select(F.col("id").alias(ident), F.col("text_hash").alias(digest))
    marked = docs.withColumn(row_digest, F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col(ident)) & F.col(row_digest).eqNullSafe(F.col(digest))
    if heads.isEmpty():
        return without(marked, cut(lost.distinct()), same).select(*names)
    more = rows.filter(head).alias("r").join(heads.alias("h"), (F.col("r.root") == F.col("h.root")) & (F.col("r.text_hash") != F.col("h.least")))
    lost = lost.unionByName(more.select(F.col("r.id").alias(ident), F.col("r.text_hash").alias(digest)))
    first = heads.select(F.col("component_id").alias(ident), F.col("least").alias(digest))
    again = marked.join(first, same, "left_semi").dropDuplicates([id_col, row_digest])
    out = without(marked, cut(lost.unionByName(first).distinct()), same)
    return out.unionByName(again).select(*names)


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of similar texts, the one with the smallest id; columns unchanged.

    Candidates are texts whose SimHash of distinct words differs in at most `radius` bits, and what such links connect.
    Within these, texts link where the Jaccard similarity of their sets of `words`-word shingles is at least
    `similarity`, which is computed exactly. An edited word changes `words` shingles but one word, so fingerprints of
    words keep near copies much closer than those of shingles do. Null, empty and blank texts have no shingle and link
    to one another. Which row of a repeated id stays is as in drop_near_duplicates. An empty table gives no rows.
    """
    rows = cut(fingerprints(docs, 1, id_col, text_col, once=True))
    nodes = cut(rows.groupBy("fp").agg(F.count("*").alias("n")))
    found = components(near_links(nodes.select("fp"), radius)).withColumnRenamed("id", "fp")
    grouped = nodes.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("grp"), "n")
    several = cut(grouped.groupBy("grp").agg(F.sum("n").alias("n")).filter("n > 1").select("grp"))
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    grouped = cut(grouped.select("fp", "grp").join(several, "grp", "left_semi"))
    near = cut(rows.join(grouped, "fp").select("id", F.col("text_hash").alias("fp"), "text_hash", "grp"))
    texts = cut(near.select(F.col("text_hash").alias("node"), "grp").distinct())
    links = similar_links(text_sets(docs, texts, words, text_col), Fraction(str(similarity)))
    return drop_labelled(docs, cut(labels(near.drop("grp"), lambda _: links)), id_col, text_col)
