"""The registered queries of the domain's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ballast.plans import batches, datasets, details, evaluation, ingestion, reports, studies, weighting  # noqa: F401  they fill the registry
from ballast.plans.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_default"](spark, sf_dir)
