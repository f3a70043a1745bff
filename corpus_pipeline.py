"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result to the shared folder and reads it back as the next stage's input.

Defined results of all stages: nulls in any column, empty and very long texts,
repeated rows and empty tables are taken as the operators define it. All columns
of ``docs`` pass with each row's own values, whatever their names: columns that
the operator doesn't read are renamed while it runs. Only the last stage adds
columns (those of ``sharding.shard``, which replace columns of these names).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm import decontam, mixing, neardup, quality, sharding
from ballast.llm.common import written

#: SQL cannot express near-dedup and decontamination over whole tables in time; a test compares run() with plain versions of the stages.
ORACLE_SQL = None


def _apart(docs: DataFrame, read: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` over ``docs``, its columns outside of ``read`` under names of their own; gives the columns of ``docs``."""
    names = {c: c if c in read else f"carried_{k}_" for k, c in enumerate(docs.columns)}
    done = stage(docs.toDF(*names.values()))
    return done.select(*[F.col(n).alias(c) for c, n in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among these."""
    return _apart(docs, ["text", "lang"], lambda d: quality.judge(d).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id. Rows without id are documents of their own."""
    return _apart(docs, ["doc_id", "text"], neardup.keep_first)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _apart(docs, ["text"], lambda d: decontam.scan(d, benchmark).filter(~F.col("contaminated")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to the limit; no document is dropped. Repeats are rows like any others, as a stage returns the columns of ``docs`` alone."""
    return _apart(docs, ["doc_id", "text", "source"], mixing.mix)


def final_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot; equal texts, repeats included, share a shard."""
    return sharding.shard(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("final_shards", final_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
