"""Search spaces of many studies at once: rows of settings against the known parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.operators.checks import guarded

#: Known parameters (name, kind, low, high, choices) and their default ranges.
KNOWN = [
    ("learning_rate", "log", 1e-5, 5e-2, None), ("weight_decay", "log", 1e-6, 1e-3, None), ("initial_lr", "log", 1e-5, 5e-2, None), ("end_lr", "log", 1e-7, 1e-3, None),
    ("optimizer", "choice", None, None, ["ADAM"]), ("scheduler", "choice", None, None, ["CosineAnnealingLR"]), ("batch_size", "integer", 16.0, 64.0, None), ("dropout", "uniform", 0.0, 0.5, None),
]
#: Those of the weighting.
WEIGHTING = [("min_cluster_size", "integer", 10.0, 50.0, None), ("outlier_weight", "log", 0.0001, 0.01, None)]
#: The space of a study without settings, and that around a good estimate.
DEFAULT = [("learning_rate", "log", 1e-5, 5e-2, None), ("weight_decay", "log", 1e-6, 1e-3, None), ("optimizer", "choice", None, None, ["ADAM", "SGD"])]
NARROW = [("learning_rate", "log", 1e-4, 1e-2, None), ("weight_decay", "log", 1e-5, 1e-4, None), ("optimizer", "choice", None, None, ["ADAM"])]

_SCHEMA = "name string, _kind string, _low double, _high double, _choices array<string>"


def _valid(space: DataFrame) -> DataFrame:
    """``space``, whose reading fails at a range that isn't one."""
    ranged = F.col("kind") != "choice"
    rules = {
        "a parameter is set twice in one study": F.col("_times") == 1,
        "a range's low end must lie below its high end": ~ranged | (F.col("low") < F.col("high")),
        "a range on a log scale must be positive": (F.col("kind") != "log") | (F.col("low") > 0),
        "a choice needs values": ranged | (F.size("choices") > 0),
    }
    return guarded(space, rules).select("study", "name", "kind", "low", "high", "choices")


def _merged(settings: DataFrame, known: list[tuple], all_of_them: bool) -> DataFrame:
    """Settings over the defaults of ``known``; ``all_of_them``: a study also has the known parameters that it doesn't set."""
    spark = settings.sparkSession
    defaults = F.broadcast(spark.createDataFrame(known, _SCHEMA))  # a fixed list
    own = settings.groupBy("study", "name").agg(F.count(F.lit(1)).alias("_times"), *[F.first(c).alias(c) for c in ("low", "high", "log", "choices")])
    if all_of_them:
        grid = settings.select("study").distinct().crossJoin(defaults)
        named = own.withColumnsRenamed({"study": "_study", "name": "_name"})
        joined = grid.join(named, F.col("study").eqNullSafe(F.col("_study")) & (F.col("name") == F.col("_name")), "left")
    else:
        joined = own.join(defaults, "name")
    number = F.col("_kind").isin("log", "uniform")
    kind = F.when(number & F.col("log").isNotNull(), F.when(F.col("log"), "log").otherwise("uniform")).when((F.col("_kind") == "integer") & F.col("choices").isNotNull(), "choice").otherwise(F.col("_kind"))
    space = joined.select("study", "name", kind.alias("kind"), F.coalesce("_times", F.lit(1)).alias("_times"), F.coalesce("low", "_low").alias("low"), F.coalesce("high", "_high").alias("high"), F.coalesce("choices", "_choices").alias("choices"))
    ranged = F.col("kind") != "choice"
    return space.withColumns({"low": F.when(ranged, F.col("low")), "high": F.when(ranged, F.col("high")), "choices": F.when(~ranged, F.col("choices"))})


def configured(settings: DataFrame, weighting: bool = False) -> DataFrame:
    """(study, name, kind, low, high, choices) of settings (study, name, low, high, log, choices); null: the default.

    A study has the known parameters that it names, those of the weighting only
    with ``weighting``. Unknown names have no effect, and a study that names none
    of the known has the default space. Integer ranges with choices are choices.
    """
    space = _valid(_merged(settings, KNOWN + (WEIGHTING if weighting else []), all_of_them=False))
    bare = settings.select("study").distinct().join(space.select(F.col("study").alias("_has")).distinct(), F.col("study").eqNullSafe(F.col("_has")), "left_anti")
    default = settings.sparkSession.createDataFrame(DEFAULT, "name string, kind string, low double, high double, choices array<string>")
    return space.unionByName(bare.crossJoin(F.broadcast(default)))  # a fixed list


def narrowed(bounds: DataFrame) -> DataFrame:
    """The space around a good estimate for each study of ``bounds`` (as settings): rates within them, an optimizer only where there is a choice of several."""
    space = _valid(_merged(bounds, NARROW, all_of_them=True))
    return space.filter((F.col("kind") != "choice") | (F.size("choices") > 1))


def described(space: DataFrame) -> DataFrame:
    """Each parameter of each study beside the study's number of parameters; choices as text."""
    counts = space.groupBy(F.col("study").alias("_of")).agg(F.count(F.lit(1)).alias("parameters"))
    return space.join(counts, F.col("study").eqNullSafe(F.col("_of"))).select("study", "parameters", "name", "kind", "low", "high", F.array_join("choices", "|").alias("choices"))
