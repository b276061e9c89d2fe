"""Operator 12, conversation prefix trie: conversations that begin alike share nodes, and totals of subtrees are rolled up by
centroid decomposition of the parent edges.

A node is a distinct sequence of first turns. Its key is the exclusive or of 128-bit hashes of (position, turn), so keys of
all prefixes come from a running sum that Spark takes over ranges of rows, and a conversation may have any number of turns.
A node is named by its smallest member and its depth; the path from a node to the root is then the prefixes of that member,
and no edge is ever walked.

Rollup: the mass of a node, the prefixes of its members from the node's depth on, is known from one aggregation, and falls
from a node to its children by what ends there. In every component with too many nodes for one task, the deepest node with
over half of the mass is its centroid. The totals of what lies below it are added to all nodes from the centroid to the
component's top; the centroid goes, its children become tops of their own, and the rest stays one component with less than
half of the mass. Small components go on in the same way within a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small_side, stored

#: Components of up to so many nodes are rolled up within a task.
TASK_NODES = 4096
#: Ids of conversations that are joined into one string; longer lists are hashed block after block.
BLOCK = 4096


def by_ranges(df: DataFrame, by: str, order: list[str], parts: int | None = None) -> DataFrame:
    """df dealt by ranges of (by, order), with the range of a row as __p; checkpointed, so that ranges stay as they are."""
    keys = [by, *order]
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return cut(dealt.withColumn("__p", F.spark_partition_id()))


#: What running() can total: an aggregate, and how two totals are put together.
SUM = (F.sum, lambda a, b: a + b)
XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def running(df: DataFrame, by: str, order: list[str], totals: dict[str, tuple]) -> DataFrame:
    """df with running totals within `by` along `order`, up to and including a row: name -> (SUM or XOR, LONG column).

    Ranges are totalled by themselves; only groups that lie in several ranges need what comes before a range, and there are at
    most two rows of those for each range, so that they are broadcast whatever the input's size. No task holds a group.
    """
    x = by_ranges(df, by, order)
    within = W.partitionBy(by, "__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    per = x.groupBy(by, "__p").agg(*[kind[0](c).alias(f"__{n}") for n, (kind, c) in totals.items()])
    per = per.withColumn("__ranges", F.count("*").over(W.partitionBy(by))).filter("__ranges > 1")
    before = W.partitionBy(by).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    earlier = [F.coalesce(kind[0](f"__{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n, (kind, _) in totals.items()]
    per = per.select(F.col(by).alias("__by"), F.col("__p").alias("__q"), *earlier)
    out = x.select("*", *[kind[0](c).over(within).alias(n) for n, (kind, c) in totals.items()])
    out = out.join(F.broadcast(per), (F.col(by) == F.col("__by")) & (F.col("__p") == F.col("__q")), "left")
    for n, (kind, _) in totals.items():
        out = out.withColumn(n, kind[1](F.col(n), F.coalesce(F.col(f"__before_{n}"), F.lit(0))))
    return out.drop("__by", "__p", "__q", *[f"__before_{n}" for n in totals])


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, pos, digest, words): each conversation's turns in order, from 0. Null turn numbers come first; equal ones follow the
    SHA-256 of role and text. Null role and text are empty. Rows without a conversation id belong to none and are left out."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.select(
        F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), F.unhex(F.sha2(F.encode(whole, "UTF-8"), 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    ).filter("c IS NOT NULL")
    one = turns.withColumn("one", F.lit(1).cast("long"))
    return cut(running(one, "c", ["turn", "digest"], {"pos": (SUM, "one")}).select("c", (F.col("pos") - 1).alias("pos"), "digest", "words"))


def shared_histories(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on a common history: (c, pos, digest, words) of the new turns, and (c, len) of all conversations.

    Conversation c takes the first h turns of conversation c - c % every, h = crc32(c in decimal) % most, as many as there are,
    then its own turns after its first h.
    """
    convs = turns.groupBy("c").agg(F.count("*").alias("size"))
    convs = convs.withColumn("base", F.expr(f"c - c % {every}")).withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % most)
    bases = convs.select(F.col("c").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(bases, "base", "left").withColumn("t", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = cut(convs.select("c", "base", "h", "t", (F.col("t") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("len")))
    first = turns.filter(F.col("pos") < most - 1).withColumnRenamed("c", "base")  # a few turns of a conversation
    taken = convs.join(first, "base").filter("pos < h").select("c", "pos", "digest", "words", "len")
    own = turns.join(convs, "c").filter("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("t")).alias("pos"), "digest", "words", "len")
    return taken.unionByName(own), convs.select("c", "len")


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, d, k1, k2, len, words): a row for each turn, with the key of the sequence of first d turns that it ends."""
    hashes = [F.xxhash64(F.lit(i), "pos", "digest").alias(f"g{i}") for i in (1, 2)]
    keyed = running(turns.select("c", "pos", "len", "words", *hashes), "c", ["pos"], {"k1": (XOR, "g1"), "k2": (XOR, "g2")})
    return cut(keyed.select("c", (F.col("pos") + 1).alias("d"), "k1", "k2", "len", "words"))


def trie(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, nodes). paths (c, d, m, len): m is the smallest member of the node that conversation c passes at depth d, from the
    root, depth 0, on. nodes (m, d, up, n_convs, mass, n_ends, words), up the smallest member of the parent."""
    sums = [F.min("c").alias("m"), F.count("*").alias("n_convs"), F.sum(F.col("len") - F.col("d") + 1).alias("mass"), F.count_if(F.col("len") == F.col("d")).alias("n_ends")]
    shared = stored(rows.groupBy("d", "k1", "k2").agg(*sums).filter("n_convs > 1"), "shared")
    found = rows.join(small_side(shared), ["d", "k1", "k2"], "left").select(
        "c", "d", F.coalesce("m", "c").alias("m"), "len", "words", F.coalesce("n_convs", F.lit(1)).alias("n_convs"),
        F.coalesce("mass", F.col("len") - F.col("d") + 1).alias("mass"), F.coalesce("n_ends", (F.col("len") == F.col("d")).cast("long")).alias("n_ends"),
    )
    found = stored(found, "prefixes")
    root = convs.select("c", F.lit(0).cast("long").alias("d"), F.col("len"), F.lit(0).cast("long").alias("words")).agg(*sums).filter("n_convs > 0")
    least = root.first()  # one row
    top = F.lit(least["m"] if least else None).cast("long")
    paths = found.select("c", "d", "m", "len").unionByName(convs.select("c", F.lit(0).cast("long").alias("d"), top.alias("m"), "len"))
    # A node is the row of its smallest member; its parent is that member's row one turn earlier.
    nodes = found.filter("c = m").drop("c", "len")
    parents = found.select(F.col("c").alias("m"), (F.col("d") + 1).alias("d"), F.col("m").alias("up"))
    nodes = nodes.join(parents, ["m", "d"], "left").withColumn("up", F.coalesce("up", top))
    root = root.select("m", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("words"), "n_convs", "mass", "n_ends", F.lit(None).cast("long").alias("up"))
    return paths, stored(nodes.unionByName(root), "nodes")


def centroid_sums(parents: Sequence[int], weights: Sequence[Sequence[int]]) -> list[list[int]]:
    """Totals over subtrees of a tree of few nodes, by centroid decomposition. parents: the place of each node's parent, -1 for
    the top, which comes first; weights: lists with a value for each node."""
    n = len(parents)
    children: list[list[int]] = [[] for _ in range(n)]
    for v in range(1, n):
        children[parents[v]].append(v)
    sums = [[0] * n for _ in weights]
    gone = bytearray(n)
    size = [1] * n
    tops = [0] if n else []
    while tops:
        top = tops.pop()
        order = [top]
        for v in order:
            order.extend(u for u in children[v] if not gone[u])
        for v in order:
            size[v] = 1
        for v in order[:0:-1]:
            size[parents[v]] += size[v]
        centroid, heavy = top, top
        while heavy is not None:
            centroid = heavy
            heavy = next((u for u in children[centroid] if not gone[u] and 2 * size[u] > len(order)), None)
        below = [centroid]
        for v in below:
            below.extend(u for u in children[v] if not gone[u])
        for total, own in zip(sums, weights, strict=True):
            more = sum(own[v] for v in below)
            v = centroid
            while v != top:
                total[v] += more
                v = parents[v]
            total[top] += more
        gone[centroid] = 1
        tops.extend(u for u in children[centroid] if not gone[u])
        if centroid != top:
            tops.append(top)
    return sums


def _within_tasks(state: DataFrame, values: list[str]) -> DataFrame:
    """(m, d, sums): the rest of the rollup of components that a task can hold."""
    names = [f"sum_{v}" for v in values]
    schema = "m long, d long, " + ", ".join(f"{n} long" for n in names)

    def run(batches):
        label, held = None, []

        def out():
            at = {(m, d): i for i, (m, d, *_) in enumerate(held)}
            parents = [-1] + [at[row[2], row[1] - 1] for row in held[1:]]
            k = len(values)
            sums = centroid_sums(parents, [[row[3 + i] for row in held] for i in range(k)])
            return [(row[0], row[1], *(row[3 + k + i] + sums[i][j] for i in range(k))) for j, row in enumerate(held)]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["m", "d", *names])

        ready = []
        for batch in batches:
            for tm, td, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tm, td) != label:
                    if held:
                        ready += out()
                    label, held = (tm, td), []
                    if len(ready) >= TASK_NODES:
                        yield batch_of(ready)
                        ready = []
                held.append(row)
        if held:
            ready += out()
        if ready:
            yield batch_of(ready)

    dealt = state.select("tm", "td", "m", "d", "up", *values, *names).repartition("tm", "td").sortWithinPartitions("tm", "td", "d")
    return dealt.mapInArrow(run, schema)


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], task_nodes: int = TASK_NODES) -> DataFrame:
    """(m, d, sum_<value>): for every node the totals of LONG columns over its subtree, itself included. The number of rounds
    over the whole cluster grows with the logarithm of the mass, whatever the tree's shape."""
    names = [f"sum_{v}" for v in values]
    root = nodes.filter("d = 0").first()  # one row
    top = [F.lit(root["m"] if root else None).cast("long").alias("tm"), F.lit(0).cast("long").alias("td")]
    state = nodes.select("m", "d", "up", "mass", *values, *[F.lit(0).cast("long").alias(n) for n in names], *top)
    done: list[DataFrame] = []
    quiet: list[DataFrame] = []
    while True:
        state = cut(state)
        sizes = state.groupBy("tm", "td").agg(F.count("*").alias("nodes"), F.max(F.when((F.col("m") == F.col("tm")) & (F.col("d") == F.col("td")), F.col("mass"))).alias("total"))
        large = cut(sizes.filter(F.col("nodes") > task_nodes).drop("nodes"))
        if large.isEmpty():
            quiet.append(state)
            break
        side = small_side(large)
        quiet.append(state.join(side, ["tm", "td"], "left_anti"))
        active = state.join(side, ["tm", "td"])
        # Nodes with over half of the mass lie on one path from the top.
        centre = active.filter(F.col("mass") * 2 > F.col("total")).groupBy("tm", "td").agg(F.max_by(F.struct(F.col("m").alias("cm"), F.col("d").alias("cd"), F.col("mass").alias("cmass")), "d").alias("x"))
        centre = cut(centre.select("tm", "td", "x.*"))
        active = active.drop("total").join(small_side(centre), ["tm", "td"])
        # The node just below the centroid's depth that a node descends from, by the path of the node's smallest member.
        passed = paths.select(F.col("c").alias("m"), (F.col("d") - 1).alias("cd"), F.col("m").alias("child"))
        above = paths.select(F.col("c").alias("m"), F.col("d").alias("cd"), F.col("m").alias("at"))
        active = active.join(above, ["m", "cd"], "left").join(passed, ["m", "cd"], "left")
        is_centre = (F.col("m") == F.col("cm")) & (F.col("d") == F.col("cd"))
        active = cut(active.withColumn("below", (F.col("d") > F.col("cd")) & (F.col("at") == F.col("cm"))).withColumn("centre", is_centre).drop("at"))
        totals = active.filter("below OR centre").groupBy("tm", "td").agg(*[F.sum(v).alias(f"add_{v}") for v in values])
        step = centre.join(totals, ["tm", "td"]).join(paths.select(F.col("c").alias("cm"), F.col("d").alias("pd"), F.col("m").alias("pm")), "cm").filter("pd BETWEEN td AND cd")
        step = step.select(F.col("pm").alias("m"), F.col("pd").alias("d"), *[f"add_{v}" for v in values], F.when(F.col("pd") < F.col("cd"), F.col("cmass")).otherwise(0).alias("less"))
        active = active.join(cut(step), ["m", "d"], "left")
        for v in values:
            active = active.withColumn(f"sum_{v}", F.col(f"sum_{v}") + F.coalesce(f"add_{v}", F.lit(0)))
        active = active.withColumn("mass", F.col("mass") - F.coalesce("less", F.lit(0)))
        active = cut(active.withColumn("tm", F.when(F.col("below"), F.col("child")).otherwise(F.col("tm"))).withColumn("td", F.when(F.col("below"), F.col("cd") + 1).otherwise(F.col("td"))))
        done.append(active.filter("centre").select("m", "d", *names))
        state = active.filter("NOT centre").select("m", "d", "up", "mass", *values, *names, "tm", "td")
    rest = quiet[0]
    for q in quiet[1:]:
        rest = rest.unionByName(q)
    out = _within_tasks(rest, values)
    for d in done:
        out = out.unionByName(d)
    return out


def member_digests(ends: DataFrame, block: int = BLOCK) -> DataFrame:
    """(m, d, sha): SHA-256 of the ascending, comma-joined ids c of each node. ends: (m, d, c, n_ends).

    A list of over `block` ids is cut into blocks in order, by many tasks, and one task lets the blocks flow through the hash,
    one at a time; SHA-256 can't be taken in parts.
    """
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids")
    digest = lambda ids: F.sha2(F.encode(ids, "UTF-8"), 256)
    few = ends.filter(F.col("n_ends") <= block).groupBy("m", "d").agg(joined).select("m", "d", digest(F.col("ids")).alias("sha"))
    x = by_ranges(ends.filter(F.col("n_ends") > block).select("m", "d", "c"), "m", ["d", "c"])
    place = F.row_number().over(W.partitionBy("m", "d", "__p").orderBy("c")) - 1
    blocks = x.withColumn("b", F.floor(place / block)).groupBy("m", "d", "__p", "b").agg(F.min("c").alias("first"), joined)

    def run(batches):
        key, h = None, None
        for batch in batches:
            rows = []
            for m, d, _, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (m, d) != key:
                    if h:
                        rows.append((*key, h.hexdigest()))
                    key, h = (m, d), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(("m", "d", "sha"), r, strict=True)) for r in rows])
        if h:
            yield pa.RecordBatch.from_pylist([{"m": key[0], "d": key[1], "sha": h.hexdigest()}])

    many = blocks.select("m", "d", "first", "ids").repartition("m", "d").sortWithinPartitions("m", "d", "first").mapInArrow(run, "m long, d long, sha string")
    return few.unionByName(many)


def prefix_trie(turns: DataFrame, convs: DataFrame, task_nodes: int = TASK_NODES, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of conversations: conv_id (its smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves (childless nodes in its subtree), saved_tokens (over its subtree, the words of a node's last
    turn times its members but one), ends_sha256 (of the ids of members that end there).

    turns: (c, pos, digest, words, len), positions gapless from 0; convs: (c, len), turnless conversations too. A conversation
    of any length and a node of any number of members or children is spread over tasks. Without a conversation there is
    no node, not even a root.
    """
    paths, nodes = trie(prefixes(turns), convs)
    children = nodes.filter("d > 0").groupBy(F.col("up").alias("m"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["m", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    nodes = stored(nodes, "weighted")
    sums = rollup(nodes, paths, ["leaf", "saved"], task_nodes)
    ended = paths.filter("d = len").select("m", "d", "c").join(small_side(nodes.filter("n_ends > 1").select("m", "d", "n_ends")), ["m", "d"], "left")
    shas = member_digests(ended.withColumn("n_ends", F.coalesce("n_ends", F.lit(1))), block)
    out = nodes.join(sums, ["m", "d"]).join(shas, ["m", "d"], "left")
    return out.select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("sum_leaf").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
