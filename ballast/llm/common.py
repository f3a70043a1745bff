"""Shared folder, file and byte-buffer helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[int, tuple[weakref.ref, str]] = {}

#: Bytes of text that one numpy step works on; bounds a Python worker's memory.
STEP_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where the session names none, a folder is made on one machine (a local
    master, as in tests); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='ballast-')}"
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(found)] = (weakref.ref(found), path)
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        held, path = _WRITTEN.pop(id(df), (None, None))
        if held is not None and held() is df:
            fs, top = open_fs(path)
            fs.delete_dir(top)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes not to clash with ``columns`` (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI; works on executors for any store pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and each row's offsets (n + 1). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, at - at[0]


def row_steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges [i, j) of about ``most`` bytes each (a longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def random_table(seed: int) -> np.ndarray:
    """A fixed random 64-bit value for each byte value."""
    return np.random.default_rng(seed).integers(1, 2**64 - 1, 256, dtype=np.uint64)


class RollingHash:
    """Polynomial fingerprints mod 2**64 of any substrings of a byte array, by prefix sums."""

    def __init__(self, seed: int):
        self.table = random_table(seed)
        self.base = int(self.table[7]) | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, flat: np.ndarray) -> np.ndarray:
        self._grow(len(flat) + 1)
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(self.table[flat] * self.up[: len(flat)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads polynomial fingerprints over all 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def block_starts(blocks: DataFrame, keys: list[str], index: str, value: str, start: str, fan: int = 1024) -> DataFrame:
    """Adds ``start``: the sum of ``value`` over the earlier blocks of the same keys, by two levels of at most ``fan``-row windows.

    ``blocks`` has one row per (keys, index). No window spans all blocks of a key.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    blocks = blocks.withColumn("_up", F.floor(F.col(index) / fan))
    up = blocks.groupBy(*keys, "_up").agg(F.sum(value).alias("_sum"))
    up = up.withColumn("_from", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_up").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*keys, "_up").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(up, [*keys, "_up"])
        .withColumn(start, F.col("_in") + F.col("_from"))
        .drop("_up", "_in", "_from")
    )
