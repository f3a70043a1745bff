"""Classification metrics and losses as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9


def confusion(df: DataFrame, true: str, pred: str, classes: int) -> DataFrame:
    """(y_true, y_pred, n) for all ``classes`` x ``classes`` cells."""
    cells = df.sparkSession.range(classes * classes).select(F.floor(F.col("id") / classes).alias("y_true"), (F.col("id") % classes).alias("y_pred"))
    counts = df.groupBy(F.col(true).cast("long").alias("y_true"), F.col(pred).cast("long").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def normalized_confusion(cells: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("y_true"))
    return cells.select("y_true", "y_pred", F.when(total > 0, F.round(F.col("n") / total, 8)).otherwise(0.0).alias("share"))


def per_class(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class, absent ones included."""
    diagonal = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    rows = cells.groupBy(F.col("y_true").alias("class")).agg(F.sum("n").alias("support"), F.sum(diagonal).alias("tp"))
    cols = cells.groupBy(F.col("y_pred").alias("class")).agg(F.sum("n").alias("predicted"))
    p, r = F.col("tp") / (F.col("predicted") + F.lit(EPS)), F.col("tp") / (F.col("support") + F.lit(EPS))
    return rows.join(cols, "class").select("class", "support", F.round(p, 8).alias("precision"), F.round(r, 8).alias("recall"), F.round(2 * p * r / (p + r + F.lit(EPS)), 8).alias("f1"))


def accuracy(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg((F.col(true) == F.col(pred)).cast("double")), F.lit(0.0)), 8).alias("accuracy"))


def balanced_accuracy(cells: DataFrame) -> DataFrame:
    """Mean recall over all classes; absent ones count as 0."""
    return per_class(cells).agg(F.round(F.avg("recall"), 6).alias("balanced_accuracy"))


def top_k(scores: DataFrame, id_col: str, true: str, score: str, klass: str, k: int) -> DataFrame:
    """Share of rows whose true class is among the ``k`` best scores; long form, one row for each (id, class)."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(score).desc(), F.col(klass)))
    hits = scores.withColumn("_r", rank).filter(F.col(klass) == F.col(true))
    return hits.agg(F.round(F.coalesce(F.avg((F.col("_r") <= k).cast("double")), F.lit(0.0)), 8).alias("top_k"))


def log_softmax(scores: Column, klass: Column) -> Column:
    """Log probability of a class under an array of scores, shifted by the largest."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.get(scores, klass) - top - F.log(total)


def losses(df: DataFrame, scores: str, true: str, gamma: float = 2.0, alpha: float = 1.0) -> DataFrame:
    """Adds cross-entropy (``ce``) and focal loss (``focal``)."""
    logp = log_softmax(F.col(scores), F.col(true))
    return df.withColumn("ce", -logp).withColumn("focal", F.lit(alpha) * F.pow(1 - F.exp(-F.col("ce")), F.lit(gamma)) * F.col("ce"))


def smoothed(ce: Column, scores: Column, smoothing: float) -> Column:
    """Cross-entropy against labels that give ``smoothing`` of their mass to all classes evenly."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    spread = top + F.log(F.aggregate(F.transform(scores, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)) - total / F.size(scores)
    return (1 - smoothing) * ce + smoothing * spread


def weighted_loss(df: DataFrame, scores: str, true: str, weight: str, smoothing: float = 0.0) -> DataFrame:
    """Mean and sum of every sample's loss times its weight; the mean is over the samples, not over the weights."""
    loss = smoothed(F.col("ce"), F.col(scores), smoothing) * F.col(weight)
    return losses(df, scores, true).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(loss), 8).alias("mean_loss"), F.round(F.sum(loss), 6).alias("sum_loss"))


def loss_and_accuracy(df: DataFrame, scores: str, true: str, *by: str) -> DataFrame:
    """Rows, summed loss and hits of each batch in one pass; the first of equal scores counts as the guess."""
    hit = F.array_position(scores, F.array_max(scores)) - 1 == F.col(true)
    return losses(df, scores, true).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ce"), 6).alias("loss"), F.count_if(hit).alias("hits"))
