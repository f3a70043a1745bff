"""The full separability report of several feature sets at once: the set is one more grouping key of every step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.operators.separability import EPS, doubles, squared_distance


def feature_reports(df: DataFrame, of: str, dims: int, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(set, metric, value): rows, classes, scatter within classes (macro, micro, mean distance), between them (macro, weighted), distances of centers (mean, least), Davies-Bouldin with and without epsilon, Fisher ratio.

    One pass gives the centers of all classes and sets, a second one the scatter
    around them; the rest works on a row for each class. Metrics that need two
    classes are null for a set of one.
    """
    rows = df.select(F.col(of).alias("set"), F.col(label).alias("label"), doubles(embedding).alias("v"))
    centers = rows.groupBy("set", "label").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("v")[i]) for i in range(dims)]).alias("s"))
    centers = centers.select("set", "label", "n", "s", F.transform("s", lambda x: x / F.col("n")).alias("c"))
    whole = centers.groupBy("set").agg(F.sum("n").alias("all"), F.array(*[F.sum(F.col("s")[i]) / F.sum("n") for i in range(dims)]).alias("g"))
    # A row for each class of each set: Spark broadcasts it if it is small.
    d2 = rows.join(centers.select("set", "label", "c"), ["set", "label"]).select("set", "label", squared_distance(F.col("v"), F.col("c")).alias("d2"))
    scatter = d2.groupBy("set", "label").agg(F.avg("d2").alias("msd"), F.avg(F.sqrt("d2")).alias("md"))
    each = centers.join(scatter, ["set", "label"]).join(whole, "set").withColumn("b2", squared_distance(F.col("c"), F.col("g")))
    within = each.groupBy("set").agg(
        F.sum("n").cast("double").alias("rows"), F.count(F.lit(1)).cast("double").alias("classes"), F.avg("msd").alias("intra_macro"), (F.sum(F.col("n") * F.col("msd")) / F.sum("n")).alias("intra_micro"),
        F.avg("md").alias("intra_distance"), F.avg("b2").alias("inter_macro"), (F.sum(F.col("n") * F.col("b2")) / F.sum("n")).alias("inter_weighted"),
    )
    a = each.select("set", F.col("label").alias("a"), F.col("c").alias("ca"), F.col("md").alias("sa"))
    b = each.select("set", F.col("label").alias("b"), F.col("c").alias("cb"), F.col("md").alias("sb"))
    pairs = a.join(b, "set").filter("a <> b").withColumn("m", F.sqrt(squared_distance(F.col("ca"), F.col("cb"))))  # classes of one set
    spread = F.col("sa") + F.col("sb")
    worst = pairs.groupBy("set", "a").agg(F.max(spread / (F.col("m") + F.lit(EPS))).alias("r"), F.max(F.when(F.col("m") > 0, spread / F.col("m"))).alias("q"), F.avg("m").alias("m"), F.min("m").alias("least"))
    between = worst.groupBy("set").agg(F.avg("r").alias("dbi"), F.avg(F.coalesce("q", F.lit(0.0))).alias("dbi_plain"), F.avg("m").alias("center_mean"), F.min("least").alias("center_least"))
    wide = within.join(between, "set", "left").withColumn("fisher", F.col("inter_weighted") / (F.col("intra_micro") + F.lit(EPS)))
    return wide.unpivot("set", [c for c in wide.columns if c != "set"], "metric", "value").withColumn("value", F.round("value", 7))
