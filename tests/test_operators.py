"""Hand-made cases of the domain's own operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.operators import annotations, batches, clustering, eda, experiments, metrics, sampling, separability, splits, weights
from ballast.plans import evaluation
from ballast.sources import tables


def test_planted_blobs_are_found():
    r = np.random.default_rng(1)
    centers = np.eye(16)[:3] * 10
    x = np.concatenate([c + r.normal(0, 0.3, (40, 16)) for c in centers])
    labels = clustering.density_labels(x, 10)
    assert sorted(np.bincount(labels + 1)[1:].tolist()) == [40, 40, 40] or (np.bincount(labels + 1)[1:] >= 38).all()
    for k in range(3):
        assert len(set(labels[40 * k : 40 * k + 40]) - {-1}) == 1


def test_small_or_scattered_chunks_have_no_cluster():
    assert (clustering.density_labels(np.ones((1, 4)), 5) == -1).all()
    assert (clustering.density_labels(np.random.default_rng(0).normal(size=(8, 4)), 25) == -1).all()


def test_weights_of_clusters_and_outliers(spark):
    df = spark.createDataFrame([(i, 0, c) for i, c in enumerate([0, 0, 1, -1, -1, -1])], "i long, chunk long, cluster int")
    got = [tuple(r) for r in weights.cluster_weights(df, "i").orderBy("i").select("weight", "updated").collect()]
    assert got == [(0.5, 0), (0.5, 0), (1.0, 1), (0.001, 2), (0.001, 2), (0.001, 3)]


def test_fallback_with_a_constant_dimension_halves(spark):
    df = spark.createDataFrame([(i, 0, [1.0, float(i)]) for i in range(6)], "i long, chunk long, embedding array<float>")
    assert [r["cluster"] for r in weights.fallback_partition(df, "i").orderBy("i").collect()] == [0, 0, 0, 1, 1, 1]


def test_retention_and_truncation(spark):
    got = spark.range(10).select(splits.retention(F.lit(100), F.col("id")).alias("k")).collect()
    assert [r["k"] for r in got] == [70, 35, 17, 8, 4, 2, 1, 1, 1, 1]
    df = spark.range(90).withColumn("c", F.lit("x"))
    n = {r["split"]: r["count"] for r in splits.stratified_split(df, "id", "c").groupBy("split").count().collect()}
    assert n == {"train": 62, "val": 13, "test": 15}


def test_null_classes_split_too(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(40)], "id long, c string")
    assert splits.stratified_split(df, "id", "c").count() == 40


def test_coverage_cap_too_small(spark):
    df = spark.createDataFrame([(i, f"c{i % 4}") for i in range(40)], "id long, c string")
    with pytest.raises(ValueError):
        splits.class_coverage(df, "id", "c", 3, 11)


def test_alignment_pairs_repeats_and_shows_both_failures(spark):
    left = spark.createDataFrame([("p", 0), ("p", 1), ("q", 2)], "path string, i long")
    right = spark.createDataFrame([("p", 10), ("p", 11), ("r", 12)], "path string, j long")
    got = {tuple(r) for r in weights.align(left, right, ["path"], "i", "j").collect()}
    assert got == {("p", 0, 10), ("p", 1, 11), ("q", 2, None), ("r", None, 12)}


def test_metrics_examples(spark):
    df = spark.createDataFrame(list(zip([0, 1, 1, 0, 2], [0, 1, 2, 0, 1])), "t int, p int")
    cells = metrics.confusion(df, "t", "p", 3)
    assert [r["n"] for r in cells.orderBy("y_true", "y_pred").collect()] == [2, 0, 0, 0, 1, 1, 0, 1, 0]
    assert metrics.balanced_accuracy(cells).first()[0] == pytest.approx(0.5, abs=1e-6)
    long = spark.createDataFrame([(i, t, c, s) for i, (t, row) in enumerate(zip([1, 0], [[0.1, 0.3, 0.6], [0.2, 0.5, 0.3]])) for c, s in enumerate(row)], "i int, t int, c int, s double")
    assert metrics.top_k(long, "i", "t", "s", "c", 2).first()[0] == 0.5


def test_gini_and_rolling_mean(spark):
    g = lambda xs: batches.gini(spark.createDataFrame([(x,) for x in xs], "n long")).first()[0]
    assert g([1, 1, 1, 1]) == 0 and g([0, 0, 0, 4]) == 0.75 and g([0, 0]) is None
    kl = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 6.0)], "batch_id long, kl double")
    assert [tuple(r) for r in batches.rolling_mean(kl, 10).collect()] == [(3, 3.0)]


def test_even_counts(spark):
    got = spark.range(10).select(batches.uniform_count(F.lit(1024), F.col("id"), F.lit(10)).alias("n")).collect()
    assert [r["n"] for r in got] == [103] * 4 + [102] * 6


def test_overlap_of_renamed_content(spark):
    df = spark.createDataFrame([("train", "a", "x"), ("test", "b", "x"), ("test", "c", "y"), ("train", "d", None), ("test", "e", None)], "split string, path string, content string")
    assert [tuple(r) for r in eda.content_overlap(df, "split", "content", "path").select("path_a", "path_b").collect()] == [("b", "a")]


def test_draws_follow_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "id long, w double")
    n = {r["id"]: r["count"] for r in sampling.weighted_draws(df, "id", "w", 4000).groupBy("id").count().collect()}
    assert sum(n.values()) == 4000 and 3 not in n and 0.2 < n[1] / 4000 < 0.3


def test_early_stop_with_least_gain(spark):
    log = spark.createDataFrame([("a", e, v) for e, v in enumerate([1.0, 1.05, 1.08, 1.5, 1.5, 1.5])], "run string, e long, v double")
    assert experiments.early_stop(log, "run", "e", "v", 2, 0.1).first()["stop_epoch"] == 2


def test_paths_and_times(spark):
    row = spark.range(1).select(annotations.normal_path(F.lit("a//b/./../c")).alias("a"), annotations.normal_path(F.lit("../x")).alias("b"), annotations.normal_path(F.lit("/../x")).alias("c"), experiments.duration_text(F.lit(3665)).alias("d"), annotations.file_candidates(F.lit("./a\\b.mp4")).alias("e")).first()
    assert tuple(row) == ("a/c", "../x", "/x", "01:01:05", ["a/b.mp4"])


def test_weight_table_and_folders(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5)], "image_path string, weight double")
    tables.save_weights(df, str(tmp_path / "w"), "test")
    assert tables.read_weights(spark, str(tmp_path / "w")).first()["source"] == "test"
    tables.save_weights(df.select("weight"), str(tmp_path / "v"), "test")
    with pytest.raises(ValueError):
        tables.read_weights(spark, str(tmp_path / "v"))
    for p in ("cat/1.png", "cat/k/2.PNG", "dog/3.txt"):
        (tmp_path / "img" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / p).write_bytes(b"x")
    got = {(r["class"], r["chunk"]) for r in tables.class_folders(spark, str(tmp_path / "img"), [".png"]).collect()}
    assert got == {("cat", None), ("cat", "k")}
    for root in (f"file://{tmp_path}/img", f"file:{tmp_path}/img/", f"{tmp_path}//img"):  # other ways to write it
        assert {(r["class"], r["chunk"]) for r in tables.class_folders(spark, root, [".png"]).collect()} == got
    (tmp_path / "a.csv").write_text("participant_id,file_id,annotation_id,frame_start,frame_end,activity,chunk_id\np,f,1,0,9,eat,\np,f,2,0\n")
    assert [r["chunk_id"] for r in tables.annotations(spark, str(tmp_path / "a.csv")).collect()] == ["0"]


def test_every_event_has_its_duration(spark, tmp_path):
    spark.createDataFrame([(0,), (19_999,), (20_000,), (123_456,)], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in evaluation.format_duration(spark, str(tmp_path)).collect()}
    assert got == {(0, "00:00:00"), (19_999, "38:53:13"), (20_000, "38:53:20"), (123_456, "240:03:12")}


def test_neighbours_search_all_rows_for_all_queries(spark):
    df = spark.range(6000).select(F.col("id"), F.col("id").alias("label"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("embedding"))
    got = separability.neighbours(df, df, "id", 1)
    assert tuple(got.agg(F.count(F.lit(1)), F.count_if(F.col("label") == F.col("vote"))).first()) == (6000, 6000)


def test_neighbours_against_brute_force_with_ties(spark, monkeypatch):
    monkeypatch.setattr(separability, "BLOCK", 40)
    r = np.random.default_rng(3)
    x, label = r.integers(0, 3, (200, 3)).astype(float), r.integers(0, 4, 200).tolist()
    df = spark.createDataFrame([(i, label[i], x[i].tolist()) for i in range(200)], "id long, label long, embedding array<float>")
    want = {}
    for i in range(60):
        near = sorted(range(60, 200), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:7]
        votes = [label[j] for j in near]
        want[i] = (label[i], min(set(votes), key=lambda c: (-votes.count(c), c)))
    got = separability.neighbours(df.filter("id < 60"), df.filter("id >= 60"), "id", 7)
    assert {t["q"]: (t["label"], t["vote"]) for t in got.collect()} == want
    assert separability.neighbours(df, df.filter("id < 0"), "id", 7).count() == 0
    assert separability.neighbours(df.filter("id < 2"), df.filter("id < 3"), "id", 7).count() == 2


def test_clustering_checks_and_options():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 0.01, (30, 2)), r.normal(0, 0.01, (30, 2)) + [0.5, 0], r.normal(0, 0.01, (30, 2)) + [9, 9]])
    for bad in ([], np.ones(3), np.ones((2, 2, 2))):
        with pytest.raises(ValueError):
            clustering.density_labels(bad, 2)
    with pytest.raises(ValueError):
        clustering.density_labels(x, 10, metric="nearest")
    by = lambda **o: clustering.density_labels(x, 10, metric=" Euclidean ", **o)
    assert {frozenset(by()[k : k + 30]) for k in (0, 30)} and by()[0] != by()[30]
    wide = by(epsilon=2.0)
    assert wide[0] == wide[30] >= 0 and wide[0] != wide[60]
    blob = x[:30]
    assert (clustering.density_labels(blob, 20, metric="euclidean") == -1).all()
    assert (clustering.density_labels(blob, 20, metric="euclidean", single=True) == 0).sum() > 20
    assert (clustering.density_labels(x, 10, metric=lambda a, b: np.abs(a[:, None, 0] - b[None, :, 0])) >= 0).any()


def test_resolved_paths_and_names(spark):
    listing = spark.createDataFrame([(p,) for p in ["a/x.mp4", "b/c/y.avi", "b/y.wmv", "a/y.wmv", "d/z.tar.mkv", "e/w.txt"]], "path string")
    ids = spark.createDataFrame([(i,) for i in ["./a\\\\x".replace("\\\\", "\\"), "q/y", "z.tar", "w.txt", "none", "", "a/x.mp4"]], "f string")
    got = {r["f"]: r["resolved"] for r in annotations.resolved_paths(ids, listing, "f", "path").collect()}
    assert got == {"./a\\x": "a/x.mp4", "q/y": "a/y.wmv", "z.tar": "d/z.tar.mkv", "w.txt": "e/w.txt", "none": "none.mp4", "": ".mp4", "a/x.mp4": "a/x.mp4"}


def test_class_columns_of_headers(spark):
    from ballast.sources.annotation_files import class_columns

    headers = [("named", ["id", " Action "]), ("sixth", list("abcdef")), ("best", ["class", "label", "Activity", "action"]), ("none", ["id"]), ("empty", []), ("nothing", None), ("twice", ["x", "label", "LABEL"])]
    got = {r["f"]: (r["position"], r["name"]) for r in class_columns(spark.createDataFrame(headers, "f string, h array<string>"), "f", "h").collect()}
    assert got == {"named": (1, " Action "), "sixth": (5, "f"), "best": (2, "Activity"), "none": (-1, None), "empty": (-1, None), "nothing": (-1, None), "twice": (1, "label")}


def test_trial_config_normalises_the_optimizer(spark):
    from ballast.operators import experiments

    base = spark.createDataFrame([("optimizer.name", "ADAM"), ("optimizer.betas", "[0.5, 0.9]"), ("optimizer.lr", "1")], "path string, value string")
    trials = spark.createDataFrame([("a", "optimizer", "sgd"), ("a", "initial_lr", "3"), ("a", "learning_rate", "2"), ("b", "optimizer", "adam"), ("c", "other", "9"), ("d", "learning_rate", "2")], "trial string, key string, value string")
    got = {}
    for r in experiments.trial_config(base, trials).collect():
        got.setdefault(r["trial"], {})[r["path"]] = r["value"]
    assert got["a"] == {"optimizer.name": "SGD", "optimizer.lr": "3", "scheduler.start_lr": "3", "optimizer.momentum": "0.9", "optimizer.dampening": "0.0", "optimizer.nesterov": "false"}
    assert got["b"] == {"optimizer.name": "ADAM", "optimizer.lr": "1", "optimizer.betas": "[0.5, 0.9]", "optimizer.eps": "1e-8", "optimizer.amsgrad": "false"}
    assert got["c"] == {"optimizer.name": "ADAM", "optimizer.lr": "1", "optimizer.betas": "[0.5, 0.9]"}
    assert got["d"] == {"optimizer.name": "ADAM", "optimizer.lr": "2", "scheduler.start_lr": "2", "optimizer.betas": "[0.5, 0.9]"}
