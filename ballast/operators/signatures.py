"""File contents that aren't what their name says: signatures as a lookup by suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.operators.eda import content_overlap

#: First bytes of image formats by suffix, in hexadecimal.
SIGNATURES = [
    (".png", "89504E470D0A1A0A"), (".jpg", "FFD8FF"), (".jpeg", "FFD8FF"), (".gif", "474946383761"), (".gif", "474946383961"), (".bmp", "424D"),
    (".tif", "49492A00"), (".tif", "4D4D002A"), (".tiff", "49492A00"), (".tiff", "4D4D002A"), (".webp", "52494646"),
]
LONGEST = 8


def with_signature(files: DataFrame, path: str, content: str) -> DataFrame:
    """``files`` with ``corrupt``: the content is empty or begins with none of the signatures of its suffix. A suffix without known signatures is never corrupt; nor is content that is missing."""
    known = files.sparkSession.createDataFrame(SIGNATURES, "_suffix string, _hex string").groupBy("_suffix").agg(F.collect_list("_hex").alias("_known"))  # a handful of rows
    head = F.hex(F.substring(F.col(content).cast("binary"), 1, LONGEST))
    named = files.withColumns({"_of": F.lower(F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1)), "_head": head})
    joined = named.join(F.broadcast(known), F.col("_of") == F.col("_suffix"), "left")
    right = F.exists("_known", lambda s: F.startswith("_head", s))
    return joined.withColumn("corrupt", F.coalesce(F.col("_known").isNotNull() & F.col("_head").isNotNull() & ~right, F.lit(False))).drop("_of", "_head", "_suffix", "_known")


def image_integrity(files: DataFrame, split: str, path: str, content: str) -> DataFrame:
    """One row: files, different contents checked, corrupt and missing ones, contents that splits share; passed if none is corrupt or shared."""
    marked = with_signature(files, path, content)
    totals = marked.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_distinct(F.sha1(F.when(~F.col("corrupt"), F.col(content).cast("binary")))).alias("checked"),
        F.count_if("corrupt").alias("corrupt"), F.count_if(F.col(content).isNull()).alias("missing"),
    )
    shared = content_overlap(marked.filter(~F.col("corrupt")), split, content, path).agg(F.count(F.lit(1)).alias("overlaps"))
    return totals.crossJoin(F.broadcast(shared)).withColumn("passed", (F.col("corrupt") == 0) & (F.col("overlaps") == 0))  # one row each
