"""Weighted draws with and without replacement, and their shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballast.functions.hashing import SEED, hash_rank, order_key, uniform
from ballast.functions.permutation import permuted
from ballast.functions.running import running

SCALE = 10**6
CELLS = 1024


def integer_cdf(df: DataFrame, id_col: str, weight: str, seed: int = SEED) -> tuple[DataFrame, int]:
    """(rows with ``low`` and ``high`` in hash order, total) of weights rounded to millionths, so bounds are exact in any order of addition."""
    units = df.select(id_col, F.round(F.col(weight) * SCALE).cast("long").alias("_w")).filter("_w > 0")
    total = units.agg(F.sum("_w")).first()[0] or 0
    ranked = hash_rank(units, [], order_key(id_col, seed=seed), [id_col], value="_w")
    return ranked.select(id_col, F.col("before").alias("low"), (F.col("before") + F.col("_w")).alias("high")), int(total)


def weighted_draws(df: DataFrame, id_col: str, weight: str, draws: int, seed: int = SEED, cells: int = CELLS) -> DataFrame:
    """(draw, id): draws with replacement in proportion to weight.

    A draw meets the interval of the running sum it falls into. Intervals are
    spread over the equal cells they touch, so this is a hash join and not a
    comparison of all draws with all rows.
    """
    spark: SparkSession = df.sparkSession
    cdf, total = integer_cdf(df, id_col, weight, seed)
    width = max(1, -(-total // cells))
    at = spark.range(draws).select(F.col("id").alias("draw"), F.floor(uniform(F.lit("draw"), "id", seed=seed) * F.lit(float(total))).cast("long").alias("at"))
    at = at.withColumn("cell", F.floor(F.col("at") / width))
    pieces = cdf.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    return at.join(pieces, "cell").filter("at >= low AND at < high").select("draw", id_col)


def once_key(id_col: str, weight: str, seed: int = SEED) -> Column:
    """-ln(u) / weight: the smallest keys are a weighted draw without replacement."""
    return F.round(-F.log(F.greatest(uniform(F.lit("once"), id_col, seed=seed), F.lit(1e-300))) / F.col(weight), 9)


def without_replacement(df: DataFrame, id_col: str, weight: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows by exponential keys (smallest -ln(u) / weight): a top-n, merged from each task's top-n."""
    return df.filter(F.col(weight) > 0).select(id_col, once_key(id_col, weight, seed).alias("key")).orderBy("key", id_col).limit(n)


def shard_sizes(n: int, world: int, num_samples: int | None = None, replacement: bool = True, drop_last: bool = True) -> tuple[int, int]:
    """(draws of a rank, draws in all) of an epoch over ``n`` rows.

    Without a number of draws, each rank gets its share of the rows, rounded
    down with ``drop_last`` and up without. Without replacement there are no more
    draws than rows: ranks are cut to equal size with ``drop_last``, and without
    it all rows are drawn once, so that the last ranks may get one row less.
    """
    each = (n // world if drop_last else -(-n // world)) if num_samples is None else num_samples
    if not replacement and each * world > n:
        return (n // world, n // world * world) if drop_last else (each, n)
    return each, each * world


def distributed_draws(df: DataFrame, id_col: str, weight: str, world: int, epoch: int = 0, num_samples: int | None = None, replacement: bool = True, drop_last: bool = True, seed: int = SEED) -> DataFrame:
    """(draw, rank, position, id) of an epoch: one draw for all ranks, seeded by seed + epoch and dealt by stride.

    With replacement the draws are ``weighted_draws``; without it they are the
    rows in the order of exponential keys, rows of positive weight alone.
    """
    seed += epoch
    n = df.count()
    _, total = shard_sizes(n, world, num_samples, replacement, drop_last)
    if replacement:
        drawn = weighted_draws(df, id_col, weight, total, seed)
    else:
        keyed = df.filter(F.col(weight) > 0).select(id_col, once_key(id_col, weight, seed).alias("_key"))
        drawn = running(keyed, "_key", [id_col], {"draw": F.lit(1)}).select((F.col("draw") - 1).alias("draw"), id_col).filter(F.col("draw") < total)
    return drawn.select(F.col("draw").cast("long").alias("draw"), (F.col("draw") % world).cast("int").alias("rank"), F.floor(F.col("draw") / world).alias("position"), id_col)


def shuffled_shards(df: DataFrame, index: str, n: int, world: int, epoch: int = 0, drop_last: bool = False, shuffle: bool = True, seed: int = SEED) -> DataFrame:
    """``df`` with ``rank`` and ``position``: an epoch's permutation of rows numbered 0 to n - 1, dealt by stride; neither sorted nor shuffled.

    Ranks are of equal size: the rows at the end are left out with ``drop_last``,
    else those at the front stand at the end again, as often as it takes.
    """
    at = permuted(F.col(index), n, seed, epoch) if shuffle else F.col(index).cast("long")
    total = n // world * world if drop_last else -(-n // world) * world
    # A row's places: its own, and those n, 2n, ... further on that the padding reaches.
    places = F.transform(F.sequence(F.lit(0), F.lit(max(0, -(-total // max(n, 1)) - 1))), lambda k: F.col("_at") + k * n)
    return df.withColumn("_at", at).withColumn("_at", F.explode(places)).filter(F.col("_at") < total).withColumns({"rank": (F.col("_at") % world).cast("int"), "position": F.floor(F.col("_at") / world)}).drop("_at")


def rank_shards(draws: DataFrame, world: int) -> DataFrame:
    return draws.withColumn("rank", (F.col("draw") % world).cast("int"))


def batches(df: DataFrame, position: str, size: int, drop_last: bool = False) -> DataFrame:
    """Adds ``batch_id`` from a stored position; with ``drop_last`` only full batches stay."""
    out = df.withColumn("batch_id", F.floor(F.col(position) / size).cast("long"))
    return out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("batch_id"))).filter(F.col("_n") == size).drop("_n") if drop_last else out
