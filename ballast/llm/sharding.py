"""Sharding by minimax contiguous partition (operator 9).

Documents with equal texts are one atomic group. Groups are ordered by a 64-bit
hash of their text (texts of one hash count as one group). The smallest capacity
for which a greedy pass over the ordered sizes needs no more shards than asked
for is found by binary search, and the order is cut there.

The sizes don't pass through the driver: it gets the sums of ``RANGES`` hash
ranges, over which it bounds the capacity and with it the places where cuts may
fall; only ranges at such places are split into finer ones by a further job,
until each of them is one group. The capacity is then the smallest over groups.

Slots count up within a shard by offsets of hash blocks, so no window holds a
whole shard or a whole group of copies.

Defined results: null text counts as empty (size 8, crc32 of no bytes). A null id
is an id. Repeated rows get slots of their own. Very long texts are groups like
any others. An empty table gives an empty result; shards may stay empty when
there are fewer groups than shards. Extra columns pass through; columns named as
results are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballast.llm.common import discard, unused, written

RANGES = 1 << 16
SLOT_BLOCKS = 4096


def greedy(ends: np.ndarray, whole: np.ndarray, capacity: int, most: int | None = None) -> list[int] | None:
    """Greedy cuts as positions in the summed sizes; None if more than ``most`` shards are needed or a whole piece is too large.

    A cut may fall anywhere inside a piece that isn't ``whole``.
    """
    cuts, done, total = [], 0, int(ends[-1]) if len(ends) else 0
    while done + capacity < total:
        i = int(np.searchsorted(ends, done + capacity, side="right"))
        at = done + capacity if not whole[i] else int(ends[i - 1]) if i else 0
        if at <= done or most is not None and len(cuts) + 2 > most:
            return None
        cuts.append(at)
        done = at
    return cuts


def least_capacity(ends: np.ndarray, whole: np.ndarray, n_shards: int) -> int:
    if not len(ends):
        return 0
    sizes = np.diff(ends, prepend=0)
    low = max(-(-int(ends[-1]) // n_shards), int(sizes[whole].max()) if whole.any() else 1)
    high = int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if greedy(ends, whole, mid, n_shards) is None else (low, mid)
    return low


def undecided(ends: np.ndarray, single: np.ndarray, n_shards: int) -> np.ndarray:
    """Pieces of several groups in which a cut of the best partition may fall."""
    low, high = least_capacity(ends, single, n_shards), least_capacity(ends, np.ones(len(ends), bool), n_shards)
    last = greedy(ends, single, high)
    found, done = np.zeros(len(ends), bool), 0
    for k in range(n_shards - 1):  # the earliest and latest place of each cut
        if done + low >= int(ends[-1]):
            break
        i = int(np.searchsorted(ends, done + low, side="right"))
        j = int(np.searchsorted(ends, last[k], side="right")) if k < len(last) else len(ends) - 1
        found[i : j + 1] = True
        done = max(done, int(ends[i - 1]) if i else 0)
    return np.flatnonzero(found & ~single)


def cut_hashes(groups: DataFrame, n_shards: int, ranges: int = RANGES) -> tuple[int, list[int]]:
    """(capacity, the first hash of each later shard) over groups (h, bytes)."""
    sums = lambda df, key: df.groupBy(*key).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high"))
    range_of = lambda c: F.floor(F.col(c) / F.lit(float(2**64 // ranges)))
    pieces = sums(groups, [range_of("h")]).select("low", "high", "bytes").toPandas().sort_values("low")  # at most ``ranges`` + 1 rows
    while True:
        low, high = pieces["low"].to_numpy(np.int64), pieces["high"].to_numpy(np.int64)
        ends = np.cumsum(pieces["bytes"].to_numpy(np.int64))
        open_ = undecided(ends, low == high, n_shards) if len(pieces) else []
        if not len(open_):
            break
        # Each of these ranges becomes finer ones, at most ``ranges`` and two each in all.
        parts = max(2, ranges // len(open_))
        at = [(int(low[k]), int(high[k]), max(1, -(-(int(high[k]) - int(low[k]) + 1) // parts))) for k in open_]
        # They are at most as many as ranges that a cut may fall into; each lies in one of the first ranges, by which it is joined.
        bounds = groups.sparkSession.createDataFrame(at, "from long, to long, step long").withColumn("range", range_of("from"))
        inside = groups.withColumn("range", range_of("h")).join(F.broadcast(bounds), "range").filter((F.col("h") >= F.col("from")) & (F.col("h") <= F.col("to")))
        finer = sums(inside, ["from", F.floor((F.col("h") - F.col("from")) / F.col("step"))]).select("low", "high", "bytes").toPandas()
        rest = np.ones(len(pieces), bool)
        rest[open_] = False
        pieces = type(pieces)({c: np.concatenate([pieces[c].to_numpy(np.int64)[rest], finer[c].to_numpy(np.int64)]) for c in ("low", "high", "bytes")}).sort_values("low")
    whole = np.ones(len(ends), bool)
    capacity = least_capacity(ends, whole, n_shards)
    cuts = greedy(ends, whole, capacity) or []
    return capacity, [int(low[np.searchsorted(ends, c, side="right")]) for c in cuts]


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text: str = "text", ranges: int = RANGES) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``."""
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    h, block, before = unused([*docs.columns, "size", "shard"], "_h", "_block", "_before")
    t = F.coalesce(F.col(text), F.lit(""))
    sized = docs.withColumns({"size": F.octet_length(t).cast("long") + 8, "text_crc32": F.crc32(t.cast("binary")), h: F.xxhash64(t)})
    groups = written(sized.groupBy(F.col(h).alias("h")).agg(F.sum("size").alias("bytes")), "groups")
    _, cuts = cut_hashes(groups, n_shards, ranges)
    discard(groups)
    # Less than ``n_shards`` comparisons, no join.
    number = sum([(F.col(h) >= F.lit(c)).cast("int") for c in cuts], F.lit(0))
    placed = sized.withColumns({"shard": number, block: F.pmod(F.xxhash64(F.col(id_col), F.col(h)), F.lit(SLOT_BLOCKS))})
    # At most ``n_shards`` times ``SLOT_BLOCKS`` rows.
    counts = placed.groupBy("shard", block).agg(F.count(F.lit(1)).alias(before))
    starts = counts.withColumn(before, F.coalesce(F.sum(before).over(Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("shard", block).orderBy(F.col(id_col), h))
    return (
        placed.join(starts, ["shard", block])
        .withColumns({"slot": F.col(before) + rank - 1, "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
        .select(*docs.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    )


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
