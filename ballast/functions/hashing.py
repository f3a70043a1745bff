"""The one source of randomness: hashes of a seed and keys, the same in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def order_key(*of: Column | str, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in of]))


def uniform(*of: Column | str, seed: int = SEED) -> Column:
    """A number in [0, 1) of 52 bits."""
    return F.conv(F.substring(order_key(*of, seed=seed), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def hash_rank(df: DataFrame, by: list[str], key: Column, tie: list[str], into: str = "rn", value: str | None = None, size: str | None = None) -> DataFrame:
    """Adds the rank from 1 by (key, tie) in each group of ``by``; with ``value``, also its running sum before the row (``before``), with ``size``, also the group's rows.

    ``key`` is a hex digest. Its first three digits cut every group into 4096
    buckets; bucket offsets are added to ranks within a bucket, so no task holds
    a whole group however large it is.
    """
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, 3))
    sums = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(value) if value else F.lit(0)).alias("_s"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_bucket").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_sum"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    match = F.col("_bucket") == F.col("_at")
    for c in by:
        match &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    inner = Window.partitionBy(*by, "_bucket").orderBy("_key", *tie)
    out = keyed.join(starts, match).withColumn(into, (F.row_number().over(inner) + F.col("_rows")).cast("long"))
    if value:
        out = out.withColumn("before", F.coalesce(F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_sum"))
    if size:
        out = out.withColumn(size, F.col("_all"))
    return out.drop("_key", "_bucket", "_at", "_all", "_rows", "_sum", *[f"_{c}" for c in by])
