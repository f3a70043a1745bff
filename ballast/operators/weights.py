"""Chunks, the fallback partition, cluster-size weights, and their checks and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.running import keyed_rank

OUTLIER_WEIGHT = 0.001
CHUNK = 128

#: Weight of a member of a cluster of ``n`` rows.
STRATEGIES = {
    "inverse_cluster_size": lambda n: F.lit(1.0) / n,
    "inverse_sqrt_cluster_size": lambda n: F.lit(1.0) / F.sqrt(n),
    "uniform": lambda n: F.lit(1.0),
}


def chunked(df: DataFrame, index: str, size: int = CHUNK, into: str = "chunk") -> DataFrame:
    """Consecutive chunks by a stored row index: no window and no shuffle."""
    return df.withColumn(into, F.floor(F.col(index) / size).cast("long"))


def fallback_partition(df: DataFrame, index: str, embedding: str = "embedding", quantile: float = 0.7) -> DataFrame:
    """Two clusters in each chunk: above the quantile of the first dimension or not; halves if that gives one cluster only."""
    cut = df.groupBy("chunk").agg(F.percentile(F.col(embedding)[0].cast("double"), quantile).alias("_cut"), F.count(F.lit(1)).alias("_size"))
    first = df.join(cut, "chunk").withColumn("_above", (F.col(embedding)[0].cast("double") > F.col("_cut")).cast("int"))
    each = Window.partitionBy("chunk")
    half = F.row_number().over(each.orderBy(index)) > F.floor(F.col("_size") / 2)
    one = F.min("_above").over(each) == F.max("_above").over(each)
    return first.withColumn("cluster", F.when(one, half.cast("int")).otherwise(F.col("_above"))).drop("_cut", "_size", "_above")


def cluster_weights(df: DataFrame, index: str, strategy: str = "inverse_cluster_size", outlier_weight: float = OUTLIER_WEIGHT, outlier_chunk: int = 2) -> DataFrame:
    """Adds ``weight`` and ``updated`` (the cluster, or for outliers a new id for every ``outlier_chunk`` of them in order).

    Windows are over (chunk, cluster); a chunk has a fixed number of rows.
    """
    members = F.count(F.lit(1)).over(Window.partitionBy("chunk", "cluster"))
    top = F.max("cluster").over(Window.partitionBy("chunk"))
    rank = F.row_number().over(Window.partitionBy("chunk", "cluster").orderBy(index)) - 1
    return df.withColumns(
        {
            "weight": F.when(F.col("cluster") < 0, F.lit(outlier_weight)).otherwise(STRATEGIES[strategy](members.cast("double"))),
            "updated": F.when(F.col("cluster") < 0, F.greatest(top, F.lit(-1)) + 1 + F.floor(rank / outlier_chunk)).otherwise(F.col("cluster")).cast("long"),
        }
    )


def cluster_stats(df: DataFrame) -> DataFrame:
    """For each chunk: clusters, outliers and their ratio, mean and population deviation of cluster sizes."""
    sizes = df.groupBy("chunk", "cluster").agg(F.count(F.lit(1)).alias("n"))
    real = F.when(F.col("cluster") >= 0, F.col("n"))
    out = F.coalesce(F.sum(F.when(F.col("cluster") < 0, F.col("n"))), F.lit(0))
    return sizes.groupBy("chunk").agg(
        F.count(real).alias("clusters"), out.alias("outliers"), F.round(out / F.sum("n"), 8).alias("outlier_ratio"),
        F.round(F.coalesce(F.avg(real), F.lit(0.0)), 8).alias("mean_size"), F.round(F.coalesce(F.stddev_pop(real), F.lit(0.0)), 8).alias("std_size"),
    )


def weight_stats(df: DataFrame, weight: str = "weight") -> DataFrame:
    w = F.col(weight)
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(w), 8).alias("mean"), F.round(F.stddev_pop(w), 8).alias("std"), F.round(F.min(w), 8).alias("least"), F.round(F.max(w), 8).alias("most"), F.count_distinct(w).alias("n_unique"))


def weight_flags(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Counts of weights that aren't usable: not a number, infinite, negative, zero; and whether the sum is zero."""
    w = F.col(weight)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.isnan(w)).alias("n_nan"), F.count_if(F.abs(w) == float("inf")).alias("n_inf"),
        F.count_if(w < 0).alias("n_negative"), F.count_if(w == 0).alias("n_zero"), (F.coalesce(F.sum(w), F.lit(0.0)) == 0).alias("zero_sum"),
    )


def class_weights(df: DataFrame, class_col: str) -> DataFrame:
    """Total by class count, one row for each class."""
    counts = df.groupBy(F.col(class_col).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("class", "n", F.round(F.sum("n").over(Window.partitionBy()) / F.col("n"), 8).alias("weight"))


def normalized(df: DataFrame, weight: Column, into: str = "share") -> DataFrame:
    """Adds the weight by the sum of all; the sum is one row, joined by broadcast."""
    total = df.agg(F.sum(weight).alias("_total"))
    share = F.when(F.col("_total") == 0, F.raise_error(F.lit("weights sum to zero"))).otherwise(weight / F.col("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(into, share).drop("_total")


def align(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """Multiset equi-join: the k-th row of a key on the left meets the k-th on the right; what is unmatched stays with nulls.

    Orders are numbers. Ranks of a hot key come from many tasks, and the join
    spreads its rows by their rank.
    """
    left, right = keyed_rank(left, keys, left_order, "_k"), keyed_rank(right, keys, right_order, "_k")
    return left.join(right, [*keys, "_k"], "full_outer").drop("_k")
