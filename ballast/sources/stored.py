"""Narrow intermediate tables in the shared folder: written once, read as often as needed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ballast.sources.tables import scratch


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later passes read columns and not the query."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
