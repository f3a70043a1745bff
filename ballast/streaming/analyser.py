"""A running analyser over micro-batches: which samples have been seen, how often, and with which weight first.

The set of seen samples, the counter and the map of first weights are one keyed
state: a row for each sample, held by the tasks of its key and restored from the
checkpoint. No driver or task holds all samples. On a cluster with many samples,
set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider, so
that state lies on disk.

Defined results: rows of one micro-batch count in the order of their position,
micro-batches in the order of arrival. Rows without sample are one sample of their
own. A null weight is no first weight: the first one that is there counts.
Rows without batch belong to none and are not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UPDATES = "sample string, batch_id long, n long, fresh boolean, total long, first_batch long, first_weight double"
STATE = "total long, first_batch long, first_weight double"
#: Rows are dealt to more tasks, and not to larger ones, above about so many a task.
TASK_ROWS = 1 << 18


def _update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A row for each batch in which the sample has come since the last micro-batch."""
    total, first_batch, first_weight = state.get if state.exists else (0, None, None)
    batches: dict[int, tuple[int, float, float | None]] = {}  # rows, and the weight at the least position that has one
    for part in parts:  # some of the sample's rows of one micro-batch, so that no task holds them all
        for batch, position, weight in zip(part["batch_id"].tolist(), part["position"].tolist(), part["weight"].tolist()):
            n, at, known = batches.get(batch, (0, float("inf"), None))
            if not pd.isna(weight) and (known is None or position < at):
                at, known = position if position == position else float("inf"), weight
            batches[batch] = (n + 1, at, known)
    out = []
    for batch, (n, _, weight) in sorted(batches.items(), key=lambda b: b[0]):
        fresh = first_batch is None
        first_batch = batch if fresh else first_batch
        first_weight = weight if first_weight is None else first_weight
        total += n
        out.append((key[0], batch, n, fresh, total, first_batch, first_weight))
    state.update((total, first_batch, first_weight))
    yield pd.DataFrame(out, columns=["sample", "batch_id", "n", "fresh", "total", "first_batch", "first_weight"])


def sample_updates(stream: DataFrame) -> DataFrame:
    """Updates of a stream of (sample, batch_id, position, weight)."""
    rows = stream.select(F.col("sample").cast("string").alias("sample"), F.col("batch_id").cast("long").alias("batch_id"), F.col("position").cast("long").alias("position"), F.col("weight").cast("double").alias("weight"))
    return rows.filter(F.col("batch_id").isNotNull()).groupBy("sample").applyInPandasWithState(_update, UPDATES, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(updates: DataFrame, path: str, checkpoint: str) -> None:
    """Takes what has arrived, one micro-batch after the other, and stops; files of updates are committed exactly once."""
    query = updates.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def sample_states(updates: DataFrame) -> DataFrame:
    """(sample, n, first_batch, first_weight): the state of each sample after all updates. Totals only grow, and what is first never changes once it is there, so plain maxima (no sort) give the last state."""
    return updates.groupBy("sample").agg(F.max("total").alias("n"), F.max("first_batch").alias("first_batch"), F.max("first_weight").alias("first_weight"))


def coverage(updates: DataFrame) -> DataFrame:
    """(batch_id, rows, n_unique, n_new): of each batch, its samples and those never seen before; a batch may have come in several micro-batches. Rows without sample can be new, but are none of the samples counted in a batch. ``updates`` is counted first, so have it stored."""
    dealt = updates.repartition(max(1, -(-updates.count() // TASK_ROWS)), "batch_id", "sample")
    each = dealt.groupBy("batch_id", "sample").agg(F.sum("n").alias("n"), F.max("fresh").alias("fresh"))
    return each.groupBy("batch_id").agg(F.sum("n").alias("rows"), F.count("sample").alias("n_unique"), F.count_if("fresh").alias("n_new"))
