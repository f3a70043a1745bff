"""Nested arrays flattened as far as their schema says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType


def depth(kind: DataType) -> int:
    return 1 + depth(kind.elementType) if isinstance(kind, ArrayType) else 0


def flat_vector(df: DataFrame, column: str) -> Column:
    """A column of arrays of any depth as one array of scalars for each row; a scalar is an array of one."""
    levels = depth(df.schema[column].dataType)
    out = F.col(column) if levels else F.array(column)
    for _ in range(levels - 1):
        out = F.flatten(out)
    return out


def flat_rows(df: DataFrame, column: str, place: str = "place") -> DataFrame:
    """A row for each scalar inside ``column``, with ``place``, the positions that lead to it. Empty lists give no row; null elements do."""
    levels = depth(df.schema[column].dataType)
    out = df.withColumn(place, F.array().cast("array<int>"))
    others = [c for c in df.columns if c != column]
    for _ in range(levels):
        out = out.select(*others, place, F.posexplode(column).alias("_at", column)).withColumn(place, F.concat(place, F.array("_at"))).drop("_at")
    return out.select(*df.columns, place)
