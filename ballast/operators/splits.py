"""Stratified splits, long-tail reduction and class-aware samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.hashing import SEED, hash_rank, order_key

TRAIN, VAL = 0.7, 0.15
RETAIN, DECAY = 0.7, 0.5


def stratified_split(df: DataFrame, id_col: str, class_col: str, train: float = TRAIN, val: float = VAL, seed: int = SEED) -> DataFrame:
    """Adds ``split``: of every class the first ``floor(n * train)`` rows in hash order, then ``floor(n * val)``, the rest is test."""
    ranked = hash_rank(df, [class_col], order_key(id_col, seed=seed), [id_col], size="_size")
    a, b = F.floor(F.col("_size") * F.lit(train)), F.floor(F.col("_size") * F.lit(val))
    return ranked.withColumn("split", F.when(F.col("rn") <= a, "train").when(F.col("rn") <= a + b, "val").otherwise("test")).drop("rn", "_size")


def class_index(df: DataFrame, class_col: str) -> DataFrame:
    """(class, class_id): rank of the class among the sorted names, from 0. The class dimension alone is ordered, not the rows."""
    names = df.filter(F.col(class_col).isNotNull()).select(F.col(class_col).alias("class")).distinct()
    return names.withColumn("class_id", (F.row_number().over(Window.orderBy("class")) - 1).cast("int"))


def retention(n: Column, index: Column, share: float = RETAIN, decay: float = DECAY) -> Column:
    """Rows that class ``index`` keeps of ``n``: a share that halves from class to class, one at least; an empty class keeps none."""
    kept = F.floor(n * (F.lit(share) * F.pow(F.lit(decay), index)))
    return F.when(n > 0, F.greatest(F.lit(1), kept)).otherwise(F.lit(0)).cast("long")


def long_tail(df: DataFrame, id_col: str, class_col: str, seed: int = SEED) -> DataFrame:
    """The rows that remain after exponential reduction by class index."""
    ranked = hash_rank(df, [class_col], order_key(id_col, seed=seed + 1), [id_col], size="_size")
    index = class_index(df, class_col).withColumnRenamed("class", "_class")
    return ranked.join(index, ranked[class_col] == index["_class"]).filter(F.col("rn") <= retention(F.col("_size"), F.col("class_id"))).drop("_class", "_size", "rn", "class_id")


def head_per_class(df: DataFrame, id_col: str, class_col: str, k: int, seed: int = SEED) -> DataFrame:
    return hash_rank(df, [class_col], order_key(id_col, seed=seed), [id_col]).filter(F.col("rn") <= k).drop("rn")


def class_coverage(df: DataFrame, id_col: str, class_col: str, least: int, cap: int, seed: int = SEED) -> DataFrame:
    """At least ``least`` rows of every class, filled up to ``cap`` from the rest in hash order; an error if the cap is too small."""
    ranked = hash_rank(df, [class_col], order_key(id_col, seed=seed), [id_col])
    first = ranked.filter(F.col("rn") <= least).drop("rn")
    n = first.count()
    if n > cap:
        raise ValueError(f"{n} rows are needed to cover all classes, more than {cap}")
    rest = hash_rank(ranked.filter(F.col("rn") > least).drop("rn"), [], order_key(id_col, seed=seed), [id_col])
    return first.unionByName(rest.filter(F.col("rn") <= cap - n).drop("rn"))


def sample_share(df: DataFrame, id_col: str, share: float, seed: int = SEED) -> DataFrame:
    """``floor(n * share)`` rows in hash order."""
    n = df.count()
    return hash_rank(df, [], order_key(id_col, seed=seed), [id_col]).filter(F.col("rn") <= int(n * share)).drop("rn")
