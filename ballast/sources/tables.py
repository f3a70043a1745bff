"""Readers and writers: tables, class folders, weight tables, reports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.sources.annotation_files import annotations  # noqa: F401  a reader like the others here

WEIGHTS = ["image_path", "weight"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); only a local master may lack one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def class_folders(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """(path, class, chunk, size) of the files below ``root``: class/file or class/chunk/file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    # The reader's paths may differ from ``root`` in how scheme and authority are written.
    base = re.sub("/+", "/", re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", root)).rstrip("/") + "/"
    inner = F.split(F.substr("path", F.locate(base, "path") + len(base)), "/")
    known = files.withColumn("_p", inner).filter(F.size("_p").isin(2, 3))
    if suffixes:
        known = known.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([s.lower() for s in suffixes]))
    return known.select("path", F.col("_p")[0].alias("class"), F.when(F.size("_p") == 3, F.col("_p")[1]).alias("chunk"), "size")


def save_weights(df: DataFrame, path: str, source: str, form: str = "parquet") -> None:
    out = df.withColumn("source", F.lit(source))
    if form == "csv":
        out.write.csv(path, header=True, mode="overwrite")
    else:
        out.write.parquet(path, mode="overwrite")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(path)
    missing = [c for c in WEIGHTS if c not in found.columns]
    if missing:
        raise ValueError(f"a weight table needs {', '.join(missing)}")
    return found


def save_report(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite")


def save_split(df: DataFrame, path: str, split: str = "split", class_col: str = "class") -> None:
    df.write.partitionBy(split, class_col).parquet(path, mode="overwrite")
