"""Search spaces, schedules, grids, summaries and edge cases of reports on planted rows."""

import math

import pytest
from pyspark.sql import functions as F

from ballast.operators import batches, checks, eda, evaluator, experiments, schedules, search

SETTINGS = "study string, name string, low double, high double, log boolean, choices array<string>"


def spaces(df):
    return {(r["study"], r["name"]): (r["kind"], r["low"], r["high"], r["choices"]) for r in df.collect()}


def test_settings_over_defaults(spark):
    rows = [("a", "learning_rate", 0.001, None, False, None), ("a", "batch_size", None, None, None, ["8", "16"]), ("a", "outlier_weight", None, 0.5, None, None), ("b", "other", 1.0, 2.0, None, None), (None, "dropout", None, 0.2, None, None)]
    settings = spark.createDataFrame(rows, SETTINGS)
    plain = spaces(search.configured(settings))
    assert plain[("a", "learning_rate")] == ("uniform", 0.001, 0.05, None)
    assert plain[("a", "batch_size")] == ("choice", None, None, ["8", "16"])
    assert ("a", "outlier_weight") not in plain and plain[(None, "dropout")] == ("uniform", 0.0, 0.2, None)
    assert {n for s, n in plain if s == "b"} == {"learning_rate", "weight_decay", "optimizer"}  # the default space
    assert spaces(search.configured(settings, weighting=True))[("a", "outlier_weight")] == ("log", 0.0001, 0.5, None)
    assert {(r["study"], r["parameters"]) for r in search.described(search.configured(settings)).collect()} == {("a", 2), ("b", 3), (None, 1)}


def test_narrow_space_has_an_optimizer_only_with_a_choice(spark):
    rows = [("a", "learning_rate", 0.0005, 0.002, None, None), ("b", "optimizer", None, None, None, ["SGD", "ADAM"])]
    found = spaces(search.narrowed(spark.createDataFrame(rows, SETTINGS)))
    assert {n for s, n in found if s == "a"} == {"learning_rate", "weight_decay"} and found[("a", "learning_rate")] == ("log", 0.0005, 0.002, None)
    assert found[("b", "optimizer")] == ("choice", None, None, ["SGD", "ADAM"]) and found[("b", "learning_rate")] == ("log", 1e-4, 1e-2, None)
    assert search.narrowed(spark.createDataFrame([], SETTINGS)).count() == 0


@pytest.mark.parametrize(
    "row, message",
    [
        (("a", "dropout", 0.7, None, None, None), "low end"),
        (("a", "learning_rate", 0.0, None, None, None), "positive"),
        (("a", "optimizer", None, None, None, []), "needs values"),
    ],
)
def test_spaces_that_are_none_stop_the_job(spark, row, message):
    with pytest.raises(Exception, match=message):
        search.configured(spark.createDataFrame([row], SETTINGS)).collect()


def test_a_parameter_set_twice_stops_the_job(spark):
    with pytest.raises(Exception, match="twice"):
        search.configured(spark.createDataFrame([("a", "dropout", 0.1, 0.2, None, None)] * 2, SETTINGS)).collect()


def restarts(epochs, rate, first, growth):
    """Step by step, as a training loop has it."""
    out, at, length = [], 0, first
    for _ in range(epochs):
        out.append(rate / 2 * (1 + math.cos(math.pi * at / length)))
        at += 1
        if at == length:
            at, length = 0, length * growth
    return out


@pytest.mark.parametrize("first, growth, direct", [(10, 2, False), (10, 2, True), (1, 3, False), (4, 1, False), (3, 3, True)])
def test_restarts_step_by_step(spark, first, growth, direct):
    log = spark.range(200).select(F.lit("r").alias("run"), F.col("id").alias("epoch"))
    got = schedules.scheduled(log, "run", "epoch", {"x": lambda e, n: schedules.restarted(e, 0.3, first, growth, direct=direct)}).orderBy("epoch").collect()
    assert [r["x"] for r in got] == pytest.approx(restarts(200, 0.3, first + direct, growth), abs=1e-9)


def test_schedules_run_over_their_own_runs_epochs(spark):
    log = spark.createDataFrame([("a", 0), ("a", 4), (None, 0), (None, 1)], "run string, epoch long")
    rates = {"linear": lambda e, n: schedules.linear(e, n, 1.0, 0.0), "cosine": lambda e, n: schedules.cosine(e, n, 1.0), "decayed": lambda e, n: schedules.exponential(e, 1.0, 2.0)}
    got = {(r["run"], r["epoch"]): r for r in schedules.scheduled(log, "run", "epoch", rates).collect()}
    assert got[("a", 4)]["linear"] == pytest.approx(0.2) and got[(None, 1)]["linear"] == 0.5 and got[(None, 1)]["cosine"] == 0.5
    assert got[("a", 4)]["decayed"] == pytest.approx(math.exp(-8), abs=1e-10)


def test_scale_factor():
    assert schedules.scale_factor(False, 3.0, 8) == 1.0 and schedules.scale_factor(True, 3.0, 8) == 3.0
    assert schedules.scale_factor(True, None, 8) == 8.0 and schedules.scale_factor(True) == 1.0
    with pytest.raises(ValueError, match="positive"):
        schedules.scale_factor(True, -1.0)
    with pytest.raises(ValueError, match="at least one"):
        schedules.restarted(F.lit(1), 0.1, first=0)


def test_grids_are_counted_first(spark):
    sides = spark.range(3).toDF("a"), spark.range(4).toDF("b"), spark.range(2).toDF("c")
    assert experiments.grid(*sides).distinct().count() == 24 == experiments.grid(*sides, most=24).count()
    with pytest.raises(ValueError, match="more than 23"):
        experiments.grid(*sides, most=23)
    assert experiments.grid(sides[0], spark.range(0).toDF("b")).count() == 0


def test_lorenz_points_start_at_the_origin(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 0), (4, -5)], "id long, n long")
    got = [tuple(r) for r in batches.lorenz_points(df, "n", "id").orderBy("place").collect()]
    assert got == [(0, 0.0, 0.0), (1, round(1 / 3, 8), 0.0), (2, round(2 / 3, 8), 0.25), (3, 1.0, 1.0)]
    assert batches.lorenz_points(df.filter("n = 0"), "n", "id").count() == 0 == batches.lorenz_points(df.filter("n > 9"), "n", "id").count()


def test_imbalance_of_empty_classes_and_of_none(spark):
    rows = [("a", "x", 9), ("a", "y", 4), ("b", "x", 9), ("b", "y", 0), ("c", None, 7), ("d", "x", 2), ("d", None, 50), ("e", "x", 0)]
    got = {r["g"]: (r["classes"], r["ratio"], r["infinite"]) for r in eda.imbalance_by(spark.createDataFrame(rows, "g string, class string, n long"), "g").collect()}
    assert got == {"a": (2, 2.25, False), "b": (2, None, True), "c": (0, 1.0, False), "d": (1, 1.0, False), "e": (1, None, True)}


def test_whole_labels(spark):
    texts = spark.createDataFrame([(" 3 ",), ("4.0",), ("-2",), ("9007199254740993",), ("1e3",)], "label string")
    assert [r[0] for r in checks.whole_labels(texts, "label").collect()] == [3, 4, -2, 9007199254740993, 1000]
    assert [r[0] for r in checks.whole_labels(spark.createDataFrame([(2.0,)], "label double"), "label").collect()] == [2]
    for bad in ("2.5", "x", "", None, "NaN", "Infinity", "99999999999999999999"):
        with pytest.raises(Exception, match="whole number"):
            checks.whole_labels(spark.createDataFrame([(bad,)], "label string"), "label").collect()


def test_summary_marks_the_first_of_equal_checkpoints(spark):
    rows = [("e/b", "accuracy", 0.5), ("e/b", "balanced_accuracy", 0.4), ("e/a", "accuracy", 0.3), ("e/a", "balanced_accuracy", 0.4), ("f/x/1", "accuracy", 0.2), ("f/x/1", "balanced_accuracy", 0.1), ("f/x/1", "loss", 3.0)]
    report = spark.createDataFrame(rows, "model string, metric string, value double")
    got = {(r["experiment"], r["checkpoint"]): (r["accuracy"], r["is_best"]) for r in evaluator.summary(report).collect()}
    assert got == {("e", "a"): (0.3, True), ("e", "b"): (0.5, False), ("f", "x/1"): (0.2, True)}
    assert evaluator.summary(report, best_only=True).count() == 2
