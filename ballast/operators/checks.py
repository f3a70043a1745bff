"""Checks that stop the job: on rows inside the plan, on totals beside the write.

A row check is part of the plan, so it runs in the pass that reads the rows
anyway. A check on totals is observed during a write; the write counts as done
only when its caller has seen the totals pass, so nothing that failed is taken
for a result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def guarded(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df``, reading which fails with the rule's message at the first row for which it doesn't hold (null counts as not)."""
    for message, rule in rules.items():
        df = df.filter(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
    return df


def aligned(features: DataFrame, labels: DataFrame, paths: DataFrame, index: str) -> DataFrame:
    """The three tables of a feature bundle side by side; a row that one of them lacks stops the job."""
    seen = [df.withColumn(f"_in{k}", F.lit(True)) for k, df in enumerate((features, labels, paths))]
    joined = seen[0].join(seen[1], index, "full_outer").join(seen[2], index, "full_outer")
    names = ("features", "labels", "paths")
    return guarded(joined, {f"features, labels and paths differ in length: a row has no {n}": F.col(f"_in{k}") for k, n in enumerate(names)}).drop("_in0", "_in1", "_in2")


def labels_in_range(df: DataFrame, label: str, classes: int) -> DataFrame:
    if classes <= 0:
        raise ValueError("the number of classes must be positive")
    return guarded(df, {f"a label lies outside of 0 to {classes - 1}": (F.col(label) >= 0) & (F.col(label) < classes)})


def whole_labels(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``label`` as long; a label that isn't a whole number, or is missing, stops the job. Text is trimmed; 3.0 is 3."""
    text = F.trim(F.col(label).cast("string"))
    real = text.try_cast("double")
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long")).when(real == F.floor(real), real.try_cast("long"))
    return guarded(df.withColumn(label, whole), {"a label isn't a whole number": F.col(label).isNotNull()})


def usable_weights(df: DataFrame, weight: str = "weight") -> DataFrame:
    w = F.col(weight)
    return guarded(df, {"a weight is null or not a number": w.isNotNull() & ~F.isnan(w), "a weight is infinite": F.abs(w) < float("inf"), "a weight is negative": w >= 0})


def coupled(train: int, clustering: int, extraction: int | None) -> int:
    """The one batch size of training, clustering and extraction."""
    if train != clustering:
        raise ValueError(f"training takes batches of {train}, clustering of {clustering}: set both to the same number")
    if extraction is None:
        raise ValueError("the batch size of the extraction is not known, so it can't be compared with that of training")
    if extraction != train:
        raise ValueError(f"features were extracted in batches of {extraction}, training takes batches of {train}")
    return train


def written_checked(df: DataFrame, write: Callable[[DataFrame], None], totals: dict[str, Column], rules: dict[str, Callable[[dict], bool]]) -> dict:
    """Writes ``df`` and gives ``totals`` over its rows from the same pass; raises if one of ``rules`` on them fails."""
    seen = Observation()
    write(df.observe(seen, *[c.alias(n) for n, c in totals.items()]))
    found = seen.get
    for message, rule in rules.items():
        if not rule(found):
            raise ValueError(message)
    return found
