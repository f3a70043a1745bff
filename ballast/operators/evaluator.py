"""Evaluations of several models and data loaders side by side, each from one scan, as long reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.running import running
from ballast.operators import batches

EPS = 1e-9


def cells(predictions: DataFrame, model: str, true: str, pred: str, loss: str) -> DataFrame:
    """(model, y_true, y_pred, n, loss): the one scan; all else comes from these few rows for each model."""
    return predictions.groupBy(F.col(model).alias("model"), F.col(true).cast("long").alias("y_true"), F.col(pred).cast("long").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"), F.sum(loss).alias("loss"))


def evaluated(predictions: DataFrame, model: str, true: str, pred: str, loss: str, classes: int) -> DataFrame:
    """(model, metric, class, guess, value): loss, accuracy, balanced accuracy, precision, recall, F1 and support of every class, and the confusion matrix.

    Totals for each model, true class, guessed class and cell are grouping sets
    over the cells. Classes without rows are there with zeros and count in the
    balanced accuracy; a model without rows isn't there.
    """
    sums = cells(predictions, model, true, pred, loss)
    hit = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    m, t, p = F.col("model"), F.col("y_true"), F.col("y_pred")
    sets = sums.groupingSets([[m], [m, t], [m, p], [m, t, p]], m, t, p).agg(F.grouping_id().alias("gid"), F.sum("n").alias("n"), F.sum("loss").alias("loss"), hit.alias("hits"))
    whole = sets.filter("gid = 3").select("model", "n", "loss", "hits")
    grid = whole.select("model", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(classes - 1).cast("long"))).alias("class"))
    own = sets.filter("gid = 1").select("model", F.col("y_true").alias("class"), F.col("n").alias("support"), F.col("hits").alias("tp"))
    guessed = sets.filter("gid = 2").select("model", F.col("y_pred").alias("class"), F.col("n").alias("predicted"))
    counts = grid.join(own, ["model", "class"], "left").join(guessed, ["model", "class"], "left").fillna(0, ["support", "tp", "predicted"])
    precision, recall = F.col("tp") / (F.col("predicted") + F.lit(EPS)), F.col("tp") / (F.col("support") + F.lit(EPS))
    each = counts.select("model", "class", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + F.lit(EPS))).alias("f1"), F.col("support").cast("double").alias("support"))
    long = each.unpivot(["model", "class"], ["precision", "recall", "f1", "support"], "metric", "value").select("model", "metric", "class", F.lit(None).cast("long").alias("guess"), "value")
    balanced = each.groupBy("model").agg(F.avg("recall").alias("balanced_accuracy"))
    scores = whole.join(balanced, "model").select("model", (F.col("loss") / F.col("n")).alias("loss"), (F.col("hits") / F.col("n")).alias("accuracy"), "balanced_accuracy")
    total = scores.unpivot("model", ["loss", "accuracy", "balanced_accuracy"], "metric", "value").select("model", "metric", F.lit(None).cast("long").alias("class"), F.lit(None).cast("long").alias("guess"), "value")
    confusion = sets.filter("gid = 0").select("model", F.lit("confusion").alias("metric"), F.col("y_true").alias("class"), F.col("y_pred").alias("guess"), F.col("n").cast("double").alias("value"))
    return total.unionByName(long).unionByName(confusion).withColumn("value", F.round("value", 6))


def summary(report: DataFrame, best_only: bool = False) -> DataFrame:
    """(experiment, checkpoint, accuracy, balanced_accuracy, is_best) of a report whose models are named experiment/checkpoint.

    The best checkpoint has the largest balanced accuracy, the first name on ties.
    """
    wide = report.filter(F.col("metric").isin("accuracy", "balanced_accuracy")).groupBy("model").pivot("metric", ["accuracy", "balanced_accuracy"]).agg(F.first("value"))
    name = F.split("model", "/", 2)
    rows = wide.select(name[0].alias("experiment"), name[1].alias("checkpoint"), "accuracy", "balanced_accuracy")
    top = rows.groupBy(F.col("experiment").alias("_of")).agg(F.min_by("checkpoint", F.struct(-F.col("balanced_accuracy"), F.col("checkpoint"))).alias("_best"))
    seen = rows.join(top, F.col("experiment") == F.col("_of")).withColumn("is_best", F.col("checkpoint") == F.col("_best")).drop("_of", "_best")
    return seen.filter("is_best") if best_only else seen


def side_by_side(draws: DataFrame, classes: DataFrame, loader: str, first: str, second: str) -> DataFrame:
    """(metric, ``first``, ``second``): batches of two loaders compared; ``draws`` has (loader, batch_id, sample, label).

    Mean and deviation of the divergence from even classes, mean entropy and its
    share of the largest, different samples, and by how many percent the second
    loader's divergence lies below the first one's.
    """
    key = F.struct(F.col(loader).alias("loader"), F.col("batch_id").alias("batch_id"))
    hist = batches.histogram(draws.select(key.alias("batch"), "label"), classes, "batch")
    each = batches.divergence(hist, "batch").select(F.col("batch.loader").alias("loader"), "kl", "entropy", "entropy_share")
    totals = each.groupBy("loader").agg(F.count(F.lit(1)).cast("double").alias("batches"), F.avg("kl").alias("mean_kl"), F.stddev_pop("kl").alias("std_kl"), F.avg("entropy").alias("mean_entropy"), F.avg("entropy_share").alias("mean_entropy_share"))
    seen = draws.groupBy(F.col(loader).alias("loader"), "sample").agg(F.count(F.lit(1)).alias("n")).groupBy("loader").agg(F.count(F.lit(1)).cast("double").alias("samples"), F.max("n").cast("double").alias("most_drawn"))
    wide = totals.join(seen, "loader")
    names = [c for c in wide.columns if c != "loader"]
    both = wide.unpivot("loader", names, "metric", "value").groupBy("metric").pivot("loader", [first, second]).agg(F.first("value"))
    better = both.filter("metric = 'mean_kl'").select(F.lit("improvement_percent").alias("metric"), F.lit(None).cast("double").alias(first), batches.improvement(F.col(first), F.col(second)).alias(second))
    return both.unionByName(better).select("metric", *[F.round(c, 6).alias(c) for c in (first, second)])


def cumulative_coverage(draws: DataFrame, loader: str, of: str) -> DataFrame:
    """(batch_id, n_unique, union): of one loader's batches, different samples in each and in all up to it."""
    own = draws.filter(F.col(loader) == of)
    fresh = own.groupBy("sample").agg(F.min("batch_id").alias("batch_id")).groupBy("batch_id").agg(F.count(F.lit(1)).alias("new"))
    each = own.groupBy("batch_id").agg(F.count_distinct("sample").alias("n_unique")).join(fresh, "batch_id", "left")
    return running(each, "batch_id", [], {"union": F.coalesce("new", F.lit(0))}).select("batch_id", "n_unique", "union")
