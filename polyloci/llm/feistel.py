"""Keyed Feistel permutation of [0, n) with cycle walking, as Spark columns, as plain Python and as DuckDB SQL.

The domain is laid out as an a x b grid with a = ceil(sqrt(n)) and b = ceil(n / a), so fewer than a cells lie
outside [0, n) and cycle walking almost never takes a second step. Rounds change the two coordinates in turn:
left = (left + f(right)) mod a, then right = (right + f(left)) mod b. The round function uses only products
below 2**62, so it gives the same value in Spark, Python and DuckDB.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647
ROUNDS = 8
#: Steps of cycle walking beyond the first. A row that is still outside fails the job and is never misplaced.
WALK = 24


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def round_keys(key: int) -> list[int]:
    return [(key % PRIME * 48271 + 69621 * (i + 1) ** 3) % PRIME for i in range(ROUNDS)]


def permute(x: int, n: int, key: int) -> int:
    """The place of row x among n rows."""
    a, b = grid(n)
    while True:
        left, right = x // b, x % b
        for i, k in enumerate(round_keys(key)):
            if i % 2 == 0:
                left = (left + _mix(right, k)) % a
            else:
                right = (right + _mix(left, k)) % b
        x = left * b + right
        if x < n:
            return x


def unpermute(y: int, n: int, key: int) -> int:
    """The row that permute() puts at place y."""
    a, b = grid(n)
    while True:
        left, right = y // b, y % b
        for i, k in reversed(list(enumerate(round_keys(key)))):
            if i % 2 == 0:
                left = (left - _mix(right, k)) % a
            else:
                right = (right - _mix(left, k)) % b
        y = left * b + right
        if y < n:
            return y


def _mix(v: int, k: int) -> int:
    t = (v + k) % PRIME
    return ((t * t + k) % PRIME * 48271 + v) % PRIME


def permuted(x: Column, n: int, key: int) -> Column:
    """permute() of a LONG column of row numbers in [0, n), with native functions only."""
    a, b = grid(n)
    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(key)])
    lit = lambda v: F.lit(v).cast("long")

    def mix(v: Column, k: Column) -> Column:
        t = (v + k) % lit(PRIME)
        return ((t * t + k) % lit(PRIME) * lit(48271) + v) % lit(PRIME)

    def turn(acc: Column, i: Column) -> Column:
        left, right, k = acc["left"], acc["right"], F.element_at(keys, i + 1)
        even = i % 2 == 0
        return F.struct(
            F.when(even, (left + mix(right, k)) % lit(a)).otherwise(left).alias("left"),
            F.when(even, right).otherwise((right + mix(left, k)) % lit(b)).alias("right"),
        )

    def once(v: Column) -> Column:
        start = F.struct(F.floor(v / lit(b)).cast("long").alias("left"), (v % lit(b)).alias("right"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: acc["left"] * lit(b) + acc["right"])

    steps = min(a * b - n, WALK)
    y = once(x)
    if steps > 0:
        y = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), y, lambda acc, _: F.when(acc < lit(n), acc).otherwise(once(acc)))
    return F.when(y < lit(n), y).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def permuted_sql(source: str, x: str, key: int, walks: int = 6) -> str:
    """CTEs of DuckDB SQL that add "place" to the rows of `source` with row number `x`; the last is named placed."""
    keys = round_keys(key)
    mix = lambda v, k: f"((({v} + {k}) % {PRIME} * (({v} + {k}) % {PRIME}) + {k}) % {PRIME} * 48271 + {v}) % {PRIME}"
    out = [
        f"grid AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT count(*) AS n, greatest(1, ceil(sqrt(count(*)))::BIGINT) AS a FROM {source}))",
        f"walk0 AS (SELECT s.*, g.n, g.a, g.b, s.{x} AS place FROM {source} s CROSS JOIN grid g)",
    ]
    for w in range(walks):
        inside = "FALSE" if w == 0 else "place < n"
        out.append(f"w{w}r0 AS (SELECT *, place // b AS lft, place % b AS rgt FROM walk{w})")
        for i, k in enumerate(keys):
            change = f"(lft + {mix('rgt', k)}) % a AS lft" if i % 2 == 0 else f"(rgt + {mix('lft', k)}) % b AS rgt"
            out.append(f"w{w}r{i + 1} AS (SELECT * REPLACE ({change}) FROM w{w}r{i})")
        out.append(f"walk{w + 1} AS (SELECT * EXCLUDE (lft, rgt) REPLACE (CASE WHEN {inside} THEN place ELSE lft * b + rgt END AS place) FROM w{w}r{ROUNDS})")
    out.append(f"placed AS (SELECT * FROM walk{walks})")
    return ",\n".join(out)
