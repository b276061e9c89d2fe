import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from polyloci.llm.prefix_trie import centroid_sums, ordered_turns, prefix_trie, shared_histories

SCHEMA = "conv_id long, turn long, role string, text string, pos string, c string, len string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, tie), (role, text)))
    turns = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    out, children, totals = [], defaultdict(int), defaultdict(lambda: [0, 0])
    for key in nodes:
        if key:
            children[key[:-1]] += 1
    for key, members in nodes.items():
        saved = (len(members) - 1) * len(re.findall("[^\x20\x09-\x0d]+", key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            totals[key[:d]][0] += key not in children
            totals[key[:d]][1] += saved
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(rebuilt[c]) == len(key)))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), children[key], *totals[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)
    out = prefix_trie(*shared_histories(ordered_turns(df)), **options)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def generated(seed, n=90):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 300), n):
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c\td e", "", None, "é ü"])) for t in range(rng.randint(1, 6))]
    return rows


@pytest.mark.parametrize("seed", range(20))
def test_centroid_sums_of_any_tree(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 60)
    parents = [-1] + [v - 1 if seed % 4 == 0 else 0 if seed % 4 == 1 else rng.randrange(v) for v in range(1, n)]
    own = [[rng.randint(0, 9) for _ in range(n)] for _ in range(2)]
    want = [list(w) for w in own]
    for w in want:
        for v in range(n - 1, 0, -1):
            w[parents[v]] += w[v]
    assert centroid_sums(parents, own) == want


@pytest.mark.parametrize("task_nodes", [1, 4, 4096])
def test_equals_brute_force(spark, task_nodes):
    rows = generated(task_nodes)
    assert found(spark, rows, task_nodes=task_nodes, block=3) == brute(rows)


def test_a_long_conversation_and_a_hot_one(spark):
    rows = [(20, t, "user", f"turn {t % 7}") for t in range(400)]  # one conversation with most turns
    rows += [(c, t, "user", "same words again") for c in range(100, 160) for t in range(4)]  # many equal ones
    rows += [(c, 0, "user", "hello") for c in range(200, 230)]
    rng = random.Random(1)
    rng.shuffle(rows)
    assert found(spark, rows, task_nodes=16, block=7) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (5, None, None, None), (5, None, "user", "b"), (5, 2, "user", None), (5, 2, "user", "a"), (5, 2, "user", "a"), (25, 7, "u", "w " * 50_000), (-3, 1, "", ""), (-3, 0, "a", "b")]
    assert found(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert found(spark, []) == []
