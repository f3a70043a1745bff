"""A keyed permutation of 0 to n - 1 as expressions: an epoch's shuffle without a sort.

A number is taken as (left, right) on a grid of just over n cells. Feistel rounds
add a hash of one half to the other, which can be undone, so the whole is a
bijection of the grid; a number that falls outside of n is sent on until it lies
inside, which is a bijection of 0 to n - 1 (cycle walking).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
#: A grid of n cells has less than sqrt(n) + 1 more, so walks this long don't come about by chance at any n; one is an error.
WALK = 64


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permuted(index: Column, n: int, seed: int, epoch: int = 0) -> Column:
    """Where ``index`` stands in the permutation of ``seed`` and ``epoch``."""
    a, b = grid(n)
    number = lambda k, half: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), k.cast("string"), half.cast("string"))), 1, 12), 16, 10).cast("long")
    pair = lambda left, right: F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))

    def one(s: Column, k: Column) -> Column:
        """Even rounds change the left half, odd ones the right half."""
        return F.when(k % 2 == 0, pair((s["left"] + number(k, s["right"])) % a, s["right"])).otherwise(pair(s["left"], (s["right"] + number(k, s["left"])) % b))

    def mixed(x: Column) -> Column:
        return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), pair(F.floor(x / b), x % b), one, lambda s: s["left"] * b + s["right"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), mixed(index.cast("long")), lambda x, _: F.when(x < n, x).otherwise(mixed(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a walk through the grid did not end")).cast("long"))


def permuted_sql(rows: str, n: str, seed: int, epoch: int = 0) -> str:
    """(i, place) of ``rows`` (i), as DuckDB SQL; ``n`` is a scalar subquery."""
    one = "SELECT i, x // b AS l, x % b AS r, a, b, n FROM {}"
    for k in range(ROUNDS):
        half = lambda h: f"('0x' || substr(md5('{seed}:{epoch}:{k}:' || {h}), 1, 12))::BIGINT"  # noqa: B023, E731
        l, r = (f"(l + {half('r')}) % a", "r") if k % 2 == 0 else ("l", f"(r + {half('l')}) % b")
        one = f"SELECT i, {l} AS l, {r} AS r, a, b, n FROM ({one})"
    one = f"SELECT i, l * b + r AS x, a, b, n FROM ({one})"
    size = f"SELECT n, a, greatest(1, (n + a - 1) // a)::BIGINT AS b FROM (SELECT n, greatest(1, floor(sqrt(greatest(n - 1, 0)::DOUBLE)) + 1)::BIGINT AS a FROM (SELECT {n}::BIGINT AS n))"
    return f"""SELECT i, x AS place FROM (WITH RECURSIVE g AS ({size}), s AS (SELECT i::BIGINT AS i, i::BIGINT AS x, a, b, n FROM ({rows}), g),
      w AS ({one.format("s")} UNION ALL {one.format("(SELECT * FROM w WHERE x >= n)")}) SELECT i, x FROM w WHERE x < n)"""
