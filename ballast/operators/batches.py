"""Diagnostics of label batches: divergence from uniform, coverage, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.running import running

EPS = 1e-10


def histogram(df: DataFrame, classes: DataFrame, batch: str = "batch_id", label: str = "label") -> DataFrame:
    """(batch, label, n) with zero counts kept; ``classes`` is the small class dimension, one row for each class."""
    counts = df.groupBy(batch, label).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select(batch).distinct().crossJoin(F.broadcast(classes.select(label)))  # class dimension only
    return grid.join(counts, [batch, label], "left").select(batch, label, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def uniform_count(n: Column, index: Column, classes: Column) -> Column:
    """Integer counts of an even split, the remainder to the lowest class numbers."""
    return F.floor(n / classes) + F.when(index < n % classes, 1).otherwise(0)


def divergence(hist: DataFrame, batch: str = "batch_id", label: str = "label") -> DataFrame:
    """For each batch: rows, KL divergence from the even integer split, entropy, entropy by its maximum."""
    each = Window.partitionBy(batch)
    h = hist.withColumns({"_total": F.sum("n").over(each), "_c": F.count(F.lit(1)).over(each), "_i": F.row_number().over(each.orderBy(label)) - 1})
    even = uniform_count(F.col("_total"), F.col("_i"), F.col("_c"))
    share = lambda x: (x / F.col("_total") + F.lit(EPS)) / (1 + F.col("_c") * F.lit(EPS))
    h = h.withColumns({"_p": share(F.col("n")), "_q": share(even)})
    entropy = -F.sum(F.col("_p") * F.log("_p"))
    c = F.max("_c")
    return h.groupBy(batch).agg(
        F.sum("n").alias("rows"), F.round(F.sum(F.col("_p") * F.log(F.col("_p") / F.col("_q"))), 8).alias("kl"),
        F.round(entropy, 8).alias("entropy"), F.round(F.when(c > 1, entropy / F.log(c.cast("double"))).otherwise(1.0), 8).alias("entropy_share"),
    )


def improvement(before: Column, after: Column) -> Column:
    """Percent by which ``after`` lies below ``before``; null where ``before`` is about zero."""
    return F.when(F.abs(before) > 1e-8, F.round((1 - after / before) * 100, 6))


def concentration(counts: DataFrame, value: str = "n") -> DataFrame:
    """One row for each distinct value, ascending: items, draws, and their running shares.

    Equal values are added up first, so there is one row for each distinct value
    and not one for each item.
    """
    groups = counts.filter(F.col(value) >= 0).groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("items"))
    drawn = F.col("x") * F.col("items")
    total = groups.agg(F.sum("items").alias("_all"), F.sum(drawn).alias("_drawn"))
    up = running(groups, "x", [], {"_items": F.col("items"), "_draws": drawn}).crossJoin(F.broadcast(total))  # one row
    return up.select("x", "items", F.round(F.col("_items") / F.col("_all"), 8).alias("item_share"), F.round(F.col("_draws") / F.col("_drawn"), 8).alias("draw_share"))


def lorenz_points(counts: DataFrame, value: str, tie: str) -> DataFrame:
    """(place, item_share, draw_share): a point for each item in the order of its value, and the origin; nothing where all values are zero. Negative values don't count."""
    kept = counts.filter(F.col(value) >= 0).select(F.col(value).alias("x"), F.col(tie).alias("tie"))
    up = running(kept, "x", ["tie"], {"_items": F.lit(1), "_draws": F.col("x")})
    total = kept.agg(F.count(F.lit(1)).alias("_all"), F.sum("x").alias("_drawn")).filter("_drawn > 0")
    points = up.crossJoin(F.broadcast(total)).select(F.col("_items").alias("place"), F.round(F.col("_items") / F.col("_all"), 8).alias("item_share"), F.round(F.col("_draws") / F.col("_drawn"), 8).alias("draw_share"))  # one row
    return points.unionByName(total.select(F.lit(0).cast("long").alias("place"), F.lit(0.0).alias("item_share"), F.lit(0.0).alias("draw_share")))


def gini(counts: DataFrame, value: str = "n") -> DataFrame:
    """2 sum(i x_i) / (n sum(x)) - (n + 1) / n over ascending values; null if empty or all zero."""
    groups = counts.filter(F.col(value) >= 0).groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    ranks = running(groups, "x", [], {"_to": F.col("c")}).withColumn("_r", F.col("c") * (F.col("_to") - F.col("c")) + F.col("c") * (F.col("c") + 1) / 2)
    n, s = F.sum("c").cast("double"), F.sum(F.col("x") * F.col("c")).cast("double")
    return ranks.agg(F.when(s > 0, F.round(2 * F.sum(F.col("x") * F.col("_r")) / (n * s) - (n + 1) / n, 8)).alias("gini"))


def ecdf(kl: DataFrame, value: str = "kl", tie: str = "batch_id") -> DataFrame:
    """(tie, value, y): the share of rows up to each, ties in steps of their own."""
    total = kl.agg(F.count(F.lit(1)).alias("_all"))
    ranks = running(kl, value, [tie], {"_rn": F.lit(1)}).crossJoin(F.broadcast(total))  # one row
    return ranks.select(tie, value, F.round(F.col("_rn") / F.col("_all"), 8).alias("y"))


def rolling_mean(kl: DataFrame, width: int, batch: str = "batch_id") -> DataFrame:
    """Mean of the last ``width`` batches, full windows only; fewer batches give one mean.

    Every batch is sent to the ``width`` windows that hold it, which are then averaged.
    """
    total = kl.agg(F.count(F.lit(1)).alias("_all"))
    ranks = running(kl, batch, [], {"_rn": F.lit(1)}).crossJoin(F.broadcast(total))  # one row
    last = F.least(F.col("_rn") + width - 1, F.col("_all"))
    held = ranks.select("kl", "_all", F.explode(F.sequence(F.col("_rn"), last)).alias("x"))
    means = held.groupBy(F.col("x").cast("long").alias("x")).agg(F.avg("kl").alias("_m"), F.max("_all").alias("_all"))
    return means.filter((F.col("x") >= width) | ((F.col("_all") < width) & (F.col("x") == F.col("_all")))).select("x", F.round("_m", 7).alias("mean"))
