"""Weights for a feature table: taken from a weight table that still stands for it, or computed and written as one.

A weight table is a folder of data with a manifest beside it, which is written
last and so commits it: the settings, a checksum of the features, rows and a
checksum of the weights, and a summary observed while the data was written. A
table may stand in only if settings and features are the same and the data are
what the manifest says.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballast.operators import checks, clustering, weights

COMPUTED, TABLE = "computed", "table"


@dataclass(frozen=True)
class Settings:
    batch: int = weights.CHUNK
    least: int = 25
    metric: str = "cosine"
    epsilon: float = 0.0
    single: bool = False
    quantile: float = 0.7
    strategy: str = "inverse_cluster_size"
    outlier_weight: float = weights.OUTLIER_WEIGHT
    outlier_chunk: int = 2


def features_checksum(features: DataFrame, index: str, embedding: str) -> dict:
    """Rows and an order-free checksum, from one pass with a row of result."""
    h = F.xxhash64(index, embedding)
    n, x, s = features.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()
    return {"rows": n, "xor": x or 0, "sum": s or 0}


def _weight_totals(index: str) -> dict:
    h = F.xxhash64(index, "weight", "cluster", "updated")
    return {"rows": F.count(F.lit(1)), "xor": F.coalesce(F.bit_xor(h), F.lit(0))}


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The committed manifest of a weight table; None if there is none or it can't be read."""
    try:
        lines = [r[0] for r in spark.read.text(f"{path}/manifest").collect()]
        return json.loads("".join(lines))
    except (AnalysisException, ValueError):
        return None


def standing(spark: SparkSession, path: str, settings: Settings, checksum: dict, index: str) -> DataFrame | None:
    """The weights of ``path`` if they stand for these features and settings."""
    found = manifest(spark, path)
    if not found or found.get("settings") != asdict(settings) or found.get("features") != checksum:
        return None
    try:
        table = spark.read.parquet(f"{path}/{found['data']}")
        totals = table.agg(*[c.alias(n) for n, c in _weight_totals(index).items()]).first().asDict()
    except AnalysisException:
        return None
    return table if totals == found["weights"] else None


def computed(features: DataFrame, index: str, embedding: str, settings: Settings) -> DataFrame:
    """(index, chunk, cluster, updated, weight) by clustering every chunk."""
    chunks = weights.chunked(features.select(index, embedding), index, settings.batch)
    found = clustering.cluster_chunks(chunks, index, embedding, settings.least, quantile=settings.quantile, metric=settings.metric, epsilon=settings.epsilon, single=settings.single)
    return weights.cluster_weights(found, index, settings.strategy, settings.outlier_weight, settings.outlier_chunk).select(index, "chunk", "cluster", "updated", "weight")


def build_weights(features: DataFrame, path: str, settings: Settings = Settings(), index: str = "vec_id", embedding: str = "embedding", train_batch: int | None = None, extraction_batch: int | None = None) -> tuple[DataFrame, str]:
    """(weights, ``table`` or ``computed``): policy checks, then the table at ``path`` if it stands, else clustering and a new table there."""
    spark = features.sparkSession
    checks.coupled(settings.batch if train_batch is None else train_batch, settings.batch, settings.batch if extraction_batch is None else extraction_batch)
    checksum = features_checksum(features, index, embedding)
    if not checksum["rows"]:
        raise ValueError("there are no features to weigh")
    table = standing(spark, path, settings, checksum, index)
    if table is not None:
        return table, TABLE
    data = f"data-{uuid.uuid4().hex}"
    lead = F.min(index).over(Window.partitionBy("chunk", "cluster")) == F.col(index)
    out = checks.usable_weights(computed(features, index, embedding, settings)).withColumn("_lead", lead & (F.col("cluster") >= 0))
    w = F.col("weight")
    summary = {"clusters": F.count_if("_lead"), "outliers": F.count_if(F.col("cluster") < 0), "mean": F.avg(w), "std": F.stddev_pop(w), "least": F.min(w), "most": F.max(w), "total": F.sum(w)}
    rules = {"weights and features differ in length": lambda t: t["rows"] == checksum["rows"], "weights sum to zero": lambda t: (t["total"] or 0) > 0}
    totals = checks.written_checked(out, lambda df: df.drop("_lead").write.parquet(f"{path}/{data}"), _weight_totals(index) | summary, rules)
    said = {"settings": asdict(settings), "features": checksum, "data": data, "weights": {k: totals[k] for k in _weight_totals(index)}, "summary": {k: totals[k] for k in summary}}
    spark.createDataFrame([(json.dumps(said, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return spark.read.parquet(f"{path}/{data}"), COMPUTED
