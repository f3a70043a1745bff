"""Bookkeeping of epochs, checkpoints, trials and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_so_far(log: DataFrame, run: str, epoch: str, value: str) -> DataFrame:
    """Adds ``is_best``: strictly better than all earlier epochs of its run."""
    before = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(value).over(before)
    return log.withColumn("is_best", best.isNull() | (F.col(value) > best))


def best_checkpoint(log: DataFrame, run: str, epoch: str, value: str) -> DataFrame:
    """Best epoch of each run, the first on ties; missing values are skipped."""
    return log.filter(F.col(value).isNotNull()).groupBy(run).agg(F.max_by(epoch, F.struct(F.col(value), -F.col(epoch))).alias("best_epoch"), F.max(value).alias("best_value"))


def keep_last(log: DataFrame, run: str, epoch: str, n: int) -> DataFrame:
    """The newest ``n`` checkpoints of each run."""
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(run).orderBy(F.col(epoch).desc()))).filter(F.col("_r") <= n).drop("_r")


def early_stop(log: DataFrame, run: str, epoch: str, value: str, patience: int, min_delta: float = 0.0) -> DataFrame:
    """The epoch at which each run would stop (null: never): an ordered fold over a run's epochs."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("long").alias("e"), F.col(value).cast("double").alias("v"))))
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).cast("long").alias("wait"), F.lit(None).cast("long").alias("stop"))

    def step(s: Column, x: Column) -> Column:
        better = x["v"] > s["best"] + F.lit(min_delta)
        wait = F.when(better, F.lit(0)).otherwise(s["wait"] + 1).cast("long")
        return F.struct(F.when(better, x["v"]).otherwise(s["best"]).alias("best"), wait.alias("wait"), F.coalesce(s["stop"], F.when(wait >= patience, x["e"])).alias("stop"))

    return log.groupBy(run).agg(F.aggregate(rows, start, step, lambda s: s["stop"]).alias("stop_epoch"))


#: Where a trial's parameter stands in a configuration; later rows win over earlier ones.
TRIAL_PATHS = [
    ("learning_rate", "optimizer.lr"), ("learning_rate", "scheduler.start_lr"), ("weight_decay", "optimizer.weight_decay"), ("initial_lr", "optimizer.lr"), ("initial_lr", "scheduler.start_lr"),
    ("end_lr", "scheduler.end_lr"), ("optimizer", "optimizer.name"), ("scheduler", "scheduler.name"), ("batch_size", "dataloader.batch_size"), ("dropout", "model.dropout"),
]

#: What an optimizer needs (its default) and what it can't take (null).
OPTIMIZER_NEEDS = {
    "SGD": {"betas": None, "eps": None, "amsgrad": None, "momentum": "0.9", "dampening": "0.0", "nesterov": "false"},
    "ADAM": {"dampening": None, "nesterov": None, "betas": "[0.9, 0.999]", "eps": "1e-8", "amsgrad": "false"},
    "ADAMW": {"dampening": None, "nesterov": None, "betas": "[0.9, 0.999]", "eps": "1e-8", "amsgrad": "false"},
}


def trial_config(base: DataFrame, trials: DataFrame) -> DataFrame:
    """(trial, path, value): the base configuration (path, value) under each trial's parameters (trial, key, value).

    Unknown parameters have no path and no effect. A trial that names an
    optimizer loses the settings this one can't take and gets the defaults it
    needs; other trials keep the base's. A trial without known parameters is the base.
    """
    spark = trials.sparkSession
    paths = spark.createDataFrame([(k, f, i) for i, (k, f) in enumerate(TRIAL_PATHS)], "key string, path string, _order int")
    needs = spark.createDataFrame([(o, f"optimizer.{k}", v) for o, all_ in OPTIMIZER_NEEDS.items() for k, v in all_.items()], "_name string, path string, _need string")
    named = F.when(F.col("path") == "optimizer.name", F.upper("value")).otherwise(F.col("value"))
    own = trials.join(F.broadcast(paths), "key").groupBy("trial", "path").agg(F.max_by("value", "_order").alias("value")).select("trial", "path", named.alias("_own"))
    needed = own.filter("path = 'optimizer.name'").select("trial", F.col("_own").alias("_name")).join(F.broadcast(needs), "_name").select("trial", "path", "_need", F.lit(True).alias("_ruled"))
    of_base = trials.select("trial").distinct().crossJoin(base.select("path", F.col("value").alias("_base")))  # a configuration's settings, for each trial
    merged = of_base.join(own, ["trial", "path"], "full").join(needed, ["trial", "path"], "full")
    value = F.coalesce("_own", "_base")
    stays = F.col("_ruled").isNull() | F.col("_need").isNotNull()
    return merged.filter(stays).select("trial", "path", F.coalesce(value, F.col("_need")).alias("value"))


def duration_text(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS."""
    s = seconds.cast("long")
    pad = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.concat_ws(":", pad(F.floor(s / 3600)), pad(F.floor(s % 3600 / 60)), pad(s % 60))


def scheduled(batches: DataFrame, index: str, rate: float, scale: int = 1, floor: float = 0.05, step: int = 10, gamma: float = 0.5) -> DataFrame:
    """``batches`` with the rate of each under cosine, stepped and linear schedules over all batches there are; the base rate grows with the number of workers (``scale``)."""
    last = batches.agg(F.greatest(F.max(index), F.lit(1)).alias("_last"))
    x, base = F.col(index) / F.col("_last"), F.lit(rate * scale)
    cosine = base * (F.lit(floor) + F.lit(0.5) * F.lit(1 - floor) * (1 + F.cos(F.lit(math.pi) * x)))
    stepped = base * F.pow(F.lit(gamma), F.floor(F.col(index) / step))
    return batches.crossJoin(F.broadcast(last)).withColumns({"cosine": F.round(cosine, 9), "stepped": F.round(stepped, 9), "linear": F.round(base * (1 - x), 9)}).drop("_last")  # one row


def spanned_space(values: DataFrame) -> DataFrame:
    """(param, n_values, kind, least, most) of (param, value) rows: a parameter whose values are all numbers has a range, any other is a choice."""
    number = F.col("value").try_cast("double")
    each = values.filter(F.col("value").isNotNull()).groupBy("param")
    return each.agg(
        F.count_distinct("value").alias("n_values"), F.when(F.count(F.lit(1)) == F.count(number), "number").otherwise("choice").alias("kind"),
        F.round(F.min(number), 6).alias("least"), F.round(F.max(number), 6).alias("most"),
    )


def _parts_of(seconds: Column) -> tuple[Column, Column, Column]:
    whole = F.floor(seconds)
    return F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60


def duration_words(seconds: Column) -> Column:
    """1 hours, 1 minutes, 5 seconds."""
    h, m, s = _parts_of(seconds)
    return F.concat(h, F.lit(" hours, "), m, F.lit(" minutes, "), s, F.lit(" seconds"))


def remaining_text(seconds: Column) -> Column:
    """ETA: 1h 1m 5s, without parts that are zero; 0s if all are."""
    h, m, s = _parts_of(seconds)
    part = lambda x, unit: F.when(x > 0, F.concat(x, F.lit(unit)))
    found = F.concat_ws(" ", part(h, "h"), part(m, "m"), part(s, "s"))
    return F.concat(F.lit("ETA: "), F.when(found == "", F.lit("0s")).otherwise(found))


def capped(batches: DataFrame, index: str, most: int | None) -> DataFrame:
    """Batches 0 to ``most`` - 1, or all without a positive cap."""
    return batches if most is None or most <= 0 else batches.filter(F.col(index) < most)


def saved(log: DataFrame, epoch: str, every: int, best_only: bool = False) -> DataFrame:
    """Epochs at which a checkpoint may be kept: every n-th, or all where only the best is kept."""
    return log if best_only else log.filter((F.col(epoch) + 1) % every == 0)


def shown_parameters(parameters: Column, prefix: str = "config/") -> Column:
    """A map without private keys, the prefix of the others removed."""
    public = F.map_filter(parameters, lambda k, _: ~k.startswith("_"))
    return F.transform_keys(public, lambda k, _: F.when(k.startswith(prefix), F.substring(k, len(prefix) + 1, 1 << 20)).otherwise(k))


def metric_line(df: DataFrame) -> Column:
    """``name: value`` of all float columns with four places, comma-joined."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")]
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.format_string("%.4f", F.col(c))) for c in floats])


#: Most rows that a grid may have.
GRID = 1_000_000


def grid(*sides: DataFrame, most: int = GRID) -> DataFrame:
    """All combinations of the rows of ``sides``, which are counted first; more than ``most`` combinations are an error."""
    size = math.prod(side.limit(most + 1).count() for side in sides)
    if size > most:
        raise ValueError(f"a grid of more than {most} combinations")
    out = sides[0]
    for side in sides[1:]:
        out = out.crossJoin(F.broadcast(side))  # counted
    return out
