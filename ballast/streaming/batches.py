"""Batch diagnostics over an unbounded stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream of the Parquet files of one table; event times become time-zoned, as watermarks need."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, label: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, label, n) of each time window; state is dropped once the watermark has passed."""
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", width), label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), label, "n")


def run_available(counts: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop.

    In append mode the sink is a Parquet folder with exactly-once commits of
    closed windows; in complete mode each batch puts the whole result, open
    windows included, in place of the last one.
    """
    if mode == "complete":

        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        counts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return
    counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
