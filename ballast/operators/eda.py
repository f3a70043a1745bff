"""Class distributions, imbalance, overlap between splits and integrity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_distribution(df: DataFrame, class_col: str, size: str, *by: str) -> DataFrame:
    return df.groupBy(*by, F.col(class_col).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))


def class_percentage(counts: DataFrame) -> DataFrame:
    """Share of each class in percent, rounded half up; counts are one row for each class."""
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("class", "n", F.when(total > 0, F.round(100.0 * F.col("n") / total, 2)).otherwise(0.0).alias("percentage"))


def imbalance(counts: DataFrame) -> DataFrame:
    """Largest by smallest class; infinite if one is empty, 1 without classes."""
    ratio = F.when(F.count(F.lit(1)) == 0, F.lit(1.0)).when(F.min("n") == 0, F.lit(float("inf"))).otherwise(F.round(F.max("n") / F.min("n"), 2))
    return counts.agg(F.count(F.lit(1)).alias("classes"), ratio.alias("imbalance_ratio"))


def imbalance_by(counts: DataFrame, group: str) -> DataFrame:
    """(group, classes, ratio, infinite) of (group, class, n): largest by smallest class. A group whose only row has no class has ratio 1; one with an empty class has none and is ``infinite``."""
    of = F.when(F.col("class").isNotNull(), F.col("n"))
    classes, least = F.count(of), F.min(of)
    ratio = F.when(classes == 0, F.lit(1.0)).when(least > 0, F.round(F.max(of) / least, 2))
    return counts.groupBy(group).agg(classes.alias("classes"), ratio.alias("ratio"), F.coalesce(least == 0, F.lit(False)).alias("infinite"))


def imbalance_per_class(counts: DataFrame) -> DataFrame:
    return counts.select("class", "n", F.round(F.max("n").over(Window.partitionBy()) / F.col("n"), 6).alias("ratio"))


def dataset_totals(df: DataFrame, class_col: str, size: str) -> DataFrame:
    names = F.sort_array(F.collect_set(class_col))
    return df.agg(F.count(F.lit(1)).alias("items"), F.round(F.sum(size) / F.lit(1048576.0), 2).alias("mib"), F.size(names).cast("long").alias("classes"), F.array_join(names, ",").alias("names"))


def digest(content: Column) -> Column:
    """What stands for a content in reports and overlaps: narrow enough to be dealt out in its place."""
    return F.sha1(content.cast("binary"))


def content_overlap(df: DataFrame, split: str, content: str, path: str) -> DataFrame:
    """One row for each content hash that two splits share, with the first path on either side."""
    return digest_overlap(df.withColumn("_digest", digest(F.col(content))), split, "_digest", path)


def digest_overlap(df: DataFrame, split: str, hashed: str, path: str) -> DataFrame:
    """``content_overlap`` of rows that bring the digest of their content.

    The sides are reduced to one row for each (split, hash) first, so copies don't multiply.
    """
    firsts = df.filter(F.col(hashed).isNotNull()).groupBy(F.col(split).alias("split"), F.col(hashed).alias("hash")).agg(F.min(path).alias("path"))
    a = firsts.select(F.col("split").alias("split_a"), "hash", F.col("path").alias("path_a"))
    b = firsts.select(F.col("split").alias("split_b"), "hash", F.col("path").alias("path_b"))
    return a.join(b, "hash").filter("split_a < split_b")


def integrity_report(df: DataFrame, split: str, hashed: str) -> DataFrame:
    """Files, different contents, missing ones and contents that two splits share, from (split, digest of the content) in one pass."""
    each = df.groupBy(F.col(split).alias("split"), F.col(hashed).alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    contents = each.groupBy("hash").agg(F.sum("n").alias("n"), F.count("split").alias("splits"))
    none, pairs = F.col("hash").isNull(), (F.col("splits") * (F.col("splits") - 1) / 2).cast("long")
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("long")
    found = contents.agg(total(F.col("n")).alias("total_files"), F.count("hash").alias("checked"), total(F.when(none, F.col("n"))).alias("missing"), total(F.when(~none, pairs)).alias("overlaps"))
    return found.withColumn("passed", F.col("overlaps") == 0)


def dataset_root(folders: DataFrame, dataset: str, folder: str) -> DataFrame:
    """Where a dataset's splits stand: directly in it (an empty root), else in split_0, else in the first split folder."""
    name = F.col(folder)
    return folders.groupBy(dataset).agg(
        F.when(F.max(name.isin("train", "val", "test")), "").when(F.max(name == "split_0"), "split_0").otherwise(F.coalesce(F.min(F.when(name.startswith("split_"), name)), F.lit(""))).alias("root")
    )


def kind_of(text: Column) -> Column:
    """boolean, long, double or string: the first that the text can be read as."""
    return F.when(F.lower(text).isin("true", "false"), "boolean").when(text.try_cast("long").isNotNull(), "long").when(text.try_cast("double").isNotNull(), "double").otherwise("string")


#: Suffixes of image files, and those that data sets of a name's beginning have.
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg"]
SUFFIXES_OF = {"daa_": [".png"], "statefarm_": [".jpg", ".jpeg"]}


def _suffix(file: Column) -> Column:
    return F.regexp_extract(file, r"(\.[^./]+)$", 1)


def expected_suffix(file: Column, dataset: Column) -> Column:
    """Whether the suffix, in any case, is one that a data set of this name has; any image's without a known name."""
    suffix, name = F.lower(_suffix(file)), F.lower(dataset)
    found = suffix.isin(IMAGE_SUFFIXES)
    for begin, own in SUFFIXES_OF.items():
        found = F.when(name.startswith(begin), suffix.isin(own)).otherwise(found)
    return found


def listed_suffix(file: Column, listed: list[str] = IMAGE_SUFFIXES) -> Column:
    """Whether the suffix is on the list as it is written."""
    return _suffix(file).isin(listed)
