"""Queries on predictions, embeddings' separability and experiment logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ballast.operators import experiments, metrics, separability, splits
from ballast.plans.base import query
from ballast.operators.weights import CHUNK
from ballast.sources.tables import table

DIMS = 64
CELLS = "SELECT t.c AS y_true, p.c AS y_pred, count(l.doc_id) AS n FROM range(2) t(c) CROSS JOIN range(2) p(c) LEFT JOIN labels l ON l.quality = t.c AND l.toxic = p.c GROUP BY t.c, p.c"
PRF = f"""SELECT class, support, round(tp / (predicted + 1e-9::DOUBLE), 8) AS precision, round(tp / (support + 1e-9::DOUBLE), 8) AS recall,
round(2 * (tp / (predicted + 1e-9::DOUBLE)) * (tp / (support + 1e-9::DOUBLE)) / (tp / (predicted + 1e-9::DOUBLE) + tp / (support + 1e-9::DOUBLE) + 1e-9::DOUBLE), 8) AS f1
FROM (SELECT y_true AS class, sum(n)::BIGINT AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END)::BIGINT AS tp FROM ({CELLS}) GROUP BY y_true)
JOIN (SELECT y_pred AS class, sum(n)::BIGINT AS predicted FROM ({CELLS}) GROUP BY y_pred) USING (class)"""


def _cells(spark, d):
    return metrics.confusion(table(spark, d, "labels"), "quality", "toxic", 2)


@query("confusion", CELLS)
def confusion(spark, d):
    return _cells(spark, d)


@query("confusion_norm", f"SELECT y_true, y_pred, CASE WHEN sum(n) OVER (PARTITION BY y_true) > 0 THEN round(n::DOUBLE / sum(n) OVER (PARTITION BY y_true), 8) ELSE 0.0::DOUBLE END AS share FROM ({CELLS})")
def confusion_norm(spark, d):
    return metrics.normalized_confusion(_cells(spark, d))


@query("accuracy", "SELECT count(*) AS n, round(coalesce(avg((quality = toxic)::INT), 0.0), 8) AS accuracy FROM labels")
def accuracy(spark, d):
    return metrics.accuracy(table(spark, d, "labels"), "quality", "toxic")


@query("per_class_prf", PRF)
def per_class_prf(spark, d):
    return metrics.per_class(_cells(spark, d))


@query("balanced_accuracy", f"SELECT round(avg(recall), 6) AS balanced_accuracy FROM ({PRF})")
def balanced_accuracy(spark, d):
    return metrics.balanced_accuracy(_cells(spark, d))


@query("named_metrics", f"SELECT 'recall_class_' || class || ': ' || printf('%.4f', recall) AS line FROM ({PRF})")
def named_metrics(spark, d):
    return metrics.per_class(_cells(spark, d)).select(F.concat(F.lit("recall_class_"), F.col("class").cast("string"), F.lit(": "), F.format_string("%.4f", F.col("recall"))).alias("line"))


@query("evaluator_by_model", "SELECT doc_id % 3 AS model, count(*) AS n, round(avg((quality = toxic)::INT), 8) AS accuracy FROM labels GROUP BY doc_id % 3")
def evaluator_by_model(spark, d):
    return table(spark, d, "labels").groupBy((F.col("doc_id") % 3).alias("model")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("quality") == F.col("toxic")).cast("double")), 8).alias("accuracy"))


@query(
    "weighted_mean_loss",
    "SELECT round(sum(loss * n) / sum(n), 7) AS weighted, round(avg(loss), 7) AS batch_mean FROM (SELECT event_id // 64 AS b, avg(value) AS loss, count(*) AS n FROM events GROUP BY event_id // 64)",
)
def weighted_mean_loss(spark, d):
    b = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 64)).agg(F.avg("value").alias("loss"), F.count(F.lit(1)).alias("n"))
    return b.agg(F.round(F.sum(F.col("loss") * F.col("n")) / F.sum("n"), 7).alias("weighted"), F.round(F.avg("loss"), 7).alias("batch_mean"))


E64 = f"SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range({DIMS})) AS i FROM embeddings"
CENTERS = f"SELECT label, i, avg(x) AS c, count(*) AS n FROM ({E64}) GROUP BY label, i"
OWN = f"SELECT e.vec_id, e.label, sum((x - c) * (x - c)) AS d2 FROM ({E64}) e JOIN ({CENTERS}) m ON e.label = m.label AND e.i = m.i GROUP BY e.vec_id, e.label"
INTRA = f"SELECT label, count(*) AS n, avg(d2) AS msd, avg(sqrt(d2)) AS md FROM ({OWN}) GROUP BY label"
PAIRS = f"SELECT a.label AS a, b.label AS b, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS distance FROM ({CENTERS}) a JOIN ({CENTERS}) b ON a.i = b.i AND a.label < b.label GROUP BY a.label, b.label"
GLOBAL = f"SELECT i, avg(x) AS g FROM ({E64}) GROUP BY i"
INTER = f"SELECT label, max(n) AS n, sum((c - g) * (c - g)) AS d2 FROM ({CENTERS}) JOIN ({GLOBAL}) USING (i) GROUP BY label"
DBI = f"SELECT avg(worst) AS dbi FROM (SELECT p.a, max((sa.md + sb.md) / (distance + 1e-12::DOUBLE)) AS worst FROM (SELECT a, b, distance FROM ({PAIRS}) UNION ALL SELECT b, a, distance FROM ({PAIRS})) p JOIN ({INTRA}) sa ON p.a = sa.label JOIN ({INTRA}) sb ON p.b = sb.label GROUP BY p.a)"


def _emb(spark, d):
    return table(spark, d, "embeddings")


def _inter(spark, d):
    e = _emb(spark, d)
    whole = e.agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(DIMS)]).alias("g"))
    return separability.centroids(e, DIMS).crossJoin(F.broadcast(whole)).select("label", "n", separability.squared_distance(F.col("centroid"), F.col("g")).alias("d2"))  # one row


def _intra(spark, d):
    return separability.intra_scatter(_emb(spark, d), separability.centroids(_emb(spark, d), DIMS).select("label", "centroid"))


@query("centroids", f"SELECT label, i::INTEGER AS dim, round(c, 8) AS value, n FROM ({CENTERS})")
def centroids(spark, d):
    c = separability.centroids(_emb(spark, d), DIMS)
    return c.select("label", "n", F.posexplode("centroid").alias("dim", "value")).select("label", "dim", F.round("value", 8).alias("value"), "n")


@query("intra_scatter", f"SELECT label, n, round(msd, 8) AS msd, round(md, 8) AS md FROM ({INTRA})")
def intra_scatter(spark, d):
    return _intra(spark, d).select("label", "n", F.round("msd", 8).alias("msd"), F.round("md", 8).alias("md"))


@query("inter_scatter", f"SELECT round(avg(d2), 8) AS macro, round(sum(n * d2) / sum(n), 8) AS weighted FROM ({INTER})")
def inter_scatter(spark, d):
    return _inter(spark, d).agg(F.round(F.avg("d2"), 8).alias("macro"), F.round(F.sum(F.col("n") * F.col("d2")) / F.sum("n"), 8).alias("weighted"))


@query("center_distances", f"SELECT a, b, round(distance, 8) AS distance FROM ({PAIRS})")
def center_distances(spark, d):
    return separability.center_pairs(separability.centroids(_emb(spark, d), DIMS)).select("a", "b", F.round("distance", 8).alias("distance"))


@query("dbi", f"SELECT round(dbi, 7) AS dbi FROM ({DBI})")
def dbi(spark, d):
    pairs = separability.center_pairs(separability.centroids(_emb(spark, d), DIMS))
    return separability.davies_bouldin(_intra(spark, d), pairs).select(F.round("dbi", 7).alias("dbi"))


@query("fisher", f"SELECT round((SELECT sum(n * d2) / sum(n) FROM ({INTER})) / ((SELECT sum(n * msd) / sum(n) FROM ({INTRA})) + 1e-12::DOUBLE), 8) AS fisher")
def fisher(spark, d):
    inter = _inter(spark, d).agg((F.sum(F.col("n") * F.col("d2")) / F.sum("n")).alias("inter"))
    intra = _intra(spark, d).agg((F.sum(F.col("n") * F.col("msd")) / F.sum("n")).alias("intra"))
    return inter.crossJoin(F.broadcast(intra)).select(F.round(F.col("inter") / (F.col("intra") + F.lit(1e-12)), 8).alias("fisher"))  # one row each


@query(
    "separability_report",
    f"SELECT round(avg(msd), 8) AS intra_macro, round(sum(n * msd) / sum(n), 8) AS intra_micro, (SELECT round(avg(distance), 8) FROM ({PAIRS})) AS center_mean, (SELECT round(min(distance), 8) FROM ({PAIRS})) AS center_min, (SELECT round(dbi, 7) FROM ({DBI})) AS dbi FROM ({INTRA})",
)
def separability_report(spark, d):
    intra = _intra(spark, d).agg(F.round(F.avg("msd"), 8).alias("intra_macro"), F.round(F.sum(F.col("n") * F.col("msd")) / F.sum("n"), 8).alias("intra_micro"))
    pairs = separability.center_pairs(separability.centroids(_emb(spark, d), DIMS)).agg(F.round(F.avg("distance"), 8).alias("center_mean"), F.round(F.min("distance"), 8).alias("center_min"))
    return intra.crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(dbi(spark, d)))  # one row each


@query(
    "feature_quality",
    f"SELECT dbi > 2.0 AS warn_dbi, (SELECT sum(n * msd) / sum(n) FROM ({INTRA})) / {DIMS} > 1.0 AS warn_intra, (SELECT sum(n * d2) / sum(n) FROM ({INTER})) / {DIMS} < 0.01 AS warn_inter FROM ({DBI})",
)
def feature_quality(spark, d):
    parts = separability_report(spark, d).select((F.col("dbi") > 2.0).alias("warn_dbi"), (F.col("intra_micro") / DIMS > 1.0).alias("warn_intra"))
    return parts.crossJoin(F.broadcast(inter_scatter(spark, d).select((F.col("weighted") / DIMS < 0.01).alias("warn_inter"))))  # one row each


NEAREST = f"SELECT vec_id, arg_min(label, lpad((round(d, 12) * 1e12)::BIGINT::VARCHAR, 18, '0') || ':' || lpad(label::VARCHAR, 4, '0')) AS nearest FROM (SELECT e.vec_id, m.label, sum((x - c) * (x - c)) AS d FROM ({E64}) e JOIN ({CENTERS}) m ON e.i = m.i GROUP BY e.vec_id, m.label) GROUP BY vec_id"


@query("nearest_centroid", NEAREST)
def nearest_centroid(spark, d):
    return separability.nearest_centroid(_emb(spark, d).select("vec_id", "embedding"), separability.centroids(_emb(spark, d), DIMS), "vec_id")


@query("nearest_centroid_accuracy", f"SELECT round(avg((label = nearest)::INT), 8) AS accuracy FROM embeddings JOIN ({NEAREST}) USING (vec_id)")
def nearest_centroid_accuracy(spark, d):
    return nearest_centroid(spark, d).join(_emb(spark, d).select("vec_id", "label"), "vec_id").agg(F.round(F.avg((F.col("label") == F.col("nearest")).cast("double")), 8).alias("accuracy"))


HELD = "SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.8::DOUBLE) AS train FROM embeddings"


@query(
    "knn_accuracy",
    f"""WITH h AS ({HELD}), p AS (SELECT q.vec_id AS q, q.label, o.label AS lo, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], o.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 12), o.vec_id) AS r FROM h q JOIN h o ON o.train AND NOT q.train),
    v AS (SELECT q, label, lo, count(*) AS n FROM p WHERE r <= 10 GROUP BY ALL)
    SELECT count(*) AS queries, round(avg((label = vote)::INT), 8) AS accuracy FROM (SELECT q, label, arg_min(lo, (100 - n) * 1000 + lo) AS vote FROM v GROUP BY q, label)""",
)
def knn_accuracy(spark, d):
    held = splits.stratified_split(_emb(spark, d), "vec_id", "label", 0.8, 0.0)
    votes = separability.neighbours(held.filter("split = 'test'"), held.filter("split = 'train'"), "vec_id", 10)
    return votes.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg((F.col("label") == F.col("vote")).cast("double")), 8).alias("accuracy"))


@query(
    "silhouette",
    """WITH s AS (SELECT * FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 5000), p AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM s a JOIN s b ON a.vec_id <> b.vec_id),
    m AS (SELECT i, li, lj, avg(dist) AS m FROM p GROUP BY ALL)
    SELECT CASE WHEN (SELECT count(*) > 1 AND min(n) > 1 FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) THEN round(avg((b - a) / greatest(a, b)), 7) END AS silhouette FROM (SELECT i, max(m) FILTER (WHERE li = lj) AS a, min(m) FILTER (WHERE li <> lj) AS b FROM m GROUP BY i)""",
)
def silhouette(spark, d):
    return separability.silhouette(_emb(spark, d), "vec_id")


UNIT = f"SELECT vec_id, i::INTEGER AS dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12::DOUBLE), 7) AS value FROM ({E64})"


@query("l2_normalize", UNIT)
def l2_normalize(spark, d):
    e = _emb(spark, d).select("vec_id", F.posexplode(separability.unit(separability.doubles("embedding"))).alias("dim", "value"))
    return e.select("vec_id", "dim", F.round("value", 7).alias("value"))


@query(
    "pairwise_cosine",
    "SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a.embedding::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(b.embedding::DOUBLE[], lambda x: x * x)))), 7) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id // 128 = b.vec_id // 128 AND a.vec_id < b.vec_id",
)
def pairwise_cosine(spark, d):
    """Distances within the chunks that are clustered: pairs grow with the rows, not with their square."""
    v = _emb(spark, d).select(F.floor(F.col("vec_id") / CHUNK).alias("chunk"), F.col("vec_id").alias("a"), separability.unit(separability.doubles("embedding")).alias("ea"))
    w = v.select("chunk", F.col("a").alias("b"), F.col("ea").alias("eb"))
    return v.join(w, "chunk").filter("a < b").select("a", "b", F.round(1 - separability.dot(F.col("ea"), F.col("eb")), 7).alias("distance"))


SCORES = "SELECT vec_id, label, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE, embedding[4]::DOUBLE, embedding[5]::DOUBLE, embedding[6]::DOUBLE, embedding[7]::DOUBLE, embedding[8]::DOUBLE, embedding[9]::DOUBLE, embedding[10]::DOUBLE] AS s FROM embeddings"
CE = f"SELECT vec_id, -(s[label + 1] - list_max(s) - ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s)))))) AS ce FROM ({SCORES})"


def _scores(spark, d):
    return _emb(spark, d).select("vec_id", "label", F.slice(separability.doubles("embedding"), 1, 10).alias("s"))


@query("topk_accuracy", f"SELECT round(avg((r <= 3)::INT), 8) AS top_k FROM (SELECT vec_id, label, c, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, c) AS r FROM (SELECT vec_id, label, unnest(s) AS x, unnest(range(10)) AS c FROM ({SCORES}))) WHERE c = label")
def topk_accuracy(spark, d):
    long = _scores(spark, d).select("vec_id", "label", F.posexplode("s").alias("c", "x"))
    return metrics.top_k(long, "vec_id", "label", "x", "c", 3)


@query("cross_entropy", f"SELECT vec_id, round(ce, 8) AS ce FROM ({CE})")
def cross_entropy(spark, d):
    return metrics.losses(_scores(spark, d), "s", "label").select("vec_id", F.round("ce", 8).alias("ce"))


@query("focal_loss", f"SELECT vec_id, round(pow(1 - exp(-ce), 2.0) * ce, 8) AS focal FROM ({CE})")
def focal_loss(spark, d):
    return metrics.losses(_scores(spark, d), "s", "label").select("vec_id", F.round("focal", 8).alias("focal"))


@query("compare_feature_sets", f"SELECT vec_id % 2 AS set_name, round(avg(d2), 8) AS msd FROM ({OWN}) GROUP BY vec_id % 2")
def compare_feature_sets(spark, d):
    c = separability.centroids(_emb(spark, d), DIMS).select("label", "centroid")
    own = _emb(spark, d).join(F.broadcast(c), "label")
    return own.groupBy((F.col("vec_id") % 2).alias("set_name")).agg(F.round(F.avg(separability.squared_distance(separability.doubles("embedding"), F.col("centroid"))), 8).alias("msd"))


TRAIN64 = f"SELECT h.label, i, avg(x) AS c FROM ({E64}) e JOIN ({HELD}) h USING (vec_id) WHERE h.train GROUP BY h.label, i"


@query(
    "nearest_centroid_holdout",
    f"""SELECT count(*) AS queries, round(avg((label = nearest)::INT), 8) AS accuracy FROM (SELECT vec_id, label, arg_min(c_label, round(d, 12) * 1000 + c_label / 1000.0) AS nearest FROM (
    SELECT e.vec_id, h.label, m.label AS c_label, sum((x - c) * (x - c)) AS d FROM ({E64}) e JOIN ({HELD}) h ON e.vec_id = h.vec_id AND NOT h.train JOIN ({TRAIN64}) m ON e.i = m.i GROUP BY ALL) GROUP BY vec_id, label)""",
)
def nearest_centroid_holdout(spark, d):
    held = splits.stratified_split(_emb(spark, d), "vec_id", "label", 0.8, 0.0)
    test = held.filter("split = 'test'").select("vec_id", "label", "embedding")
    near = separability.nearest_centroid(test, separability.centroids(held.filter("split = 'train'"), DIMS), "vec_id")
    return test.select("vec_id", "label").join(near, "vec_id").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg((F.col("label") == F.col("nearest")).cast("double")), 8).alias("accuracy"))


@query(
    "nearest_centroid_cosine",
    f"""SELECT vec_id, arg_min(label, round(1 - dots / (greatest(sqrt(xx), 1e-12) * greatest(sqrt(cc), 1e-12)), 12) * 1000 + label / 1e9) AS nearest FROM (
    SELECT e.vec_id, m.label, sum(x * c) AS dots, sum(x * x) AS xx, sum(c * c) AS cc FROM ({E64}) e JOIN ({CENTERS}) m ON e.i = m.i GROUP BY e.vec_id, m.label) GROUP BY vec_id""",
)
def nearest_centroid_cosine(spark, d):
    return separability.nearest_by_cosine(_emb(spark, d).select("vec_id", "embedding"), separability.centroids(_emb(spark, d), DIMS), "vec_id")


@query(
    "pair_overlap",
    """WITH n AS (SELECT count(*) AS n FROM embeddings), r AS (SELECT a, b + (b >= a)::INTEGER AS b FROM (SELECT ('0x' || substr(md5('42:a:' || i), 1, 13))::BIGINT % n AS a, ('0x' || substr(md5('42:b:' || i), 1, 13))::BIGINT % (n - 1) AS b FROM range(30000) t(i), n)),
    p AS (SELECT x.label = y.label AS same, round(sqrt(list_sum(list_transform(list_zip(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS d FROM r JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b),
    m AS (SELECT quantile_cont(d, 0.5) AS m FROM p WHERE NOT same)
    SELECT round(max(m), 7) AS median_inter, round(avg(CASE WHEN same THEN (d > m)::INT END), 8) AS overlap FROM p, m""",
)
def pair_overlap(spark, d):
    return separability.pair_overlap(_emb(spark, d), "vec_id")


@query("weighted_ce", f"SELECT count(*) AS n, round(avg(l), 8) AS mean_loss, round(sum(l), 6) AS sum_loss FROM (SELECT (0.9::DOUBLE * ce + 0.1::DOUBLE * (list_max(s) + ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) - list_sum(s) / 10)) / (1 + vec_id % 5) AS l FROM ({CE}) JOIN ({SCORES}) USING (vec_id))")
def weighted_ce(spark, d):
    weighted = _scores(spark, d).withColumn("w", F.lit(1.0) / (1 + F.col("vec_id") % 5))
    return metrics.weighted_loss(weighted, "s", "label", "w", smoothing=0.1)


@query("batch_loss_accuracy", f"SELECT vec_id // 128 AS batch, count(*) AS n, round(sum(ce), 6) AS loss, count(*) FILTER (WHERE list_position(s, list_max(s)) - 1 = label) AS hits FROM ({CE}) JOIN ({SCORES}) USING (vec_id) GROUP BY 1")
def batch_loss_accuracy(spark, d):
    return metrics.loss_and_accuracy(_scores(spark, d).withColumn("batch", F.floor(F.col("vec_id") / CHUNK).cast("long")), "s", "label", "batch")


BASE_CONFIG = [("optimizer.name", "SGD"), ("optimizer.lr", "0.001"), ("optimizer.momentum", "0.8"), ("optimizer.nesterov", "true"), ("scheduler.name", "cosine"), ("scheduler.start_lr", "0.001"), ("dataloader.batch_size", "128")]
_BASE = ", ".join(f"('{p}', '{v}')" for p, v in BASE_CONFIG)


@query(
    "trial_config",
    f"""WITH t AS (SELECT event_type AS trial, count(*) AS n FROM events GROUP BY event_type),
    cfg AS (SELECT trial, n, CASE WHEN n % 3 = 0 THEN 'SGD' WHEN n % 3 = 1 THEN 'ADAMW' END AS opt, (32 * (1 + n % 4))::VARCHAR AS bs, ('0.' || (1 + n % 9)::VARCHAR) AS lr, CASE WHEN n % 2 = 0 THEN '0.05' END AS first_lr FROM t),
    merged AS (SELECT trial, opt, path, CASE path WHEN 'optimizer.name' THEN coalesce(opt, value) WHEN 'optimizer.lr' THEN coalesce(first_lr, lr) WHEN 'scheduler.start_lr' THEN coalesce(first_lr, lr) WHEN 'dataloader.batch_size' THEN bs ELSE value END AS value FROM cfg, (VALUES {_BASE}) b(path, value)),
    adam AS (SELECT trial, opt, path, value FROM cfg, (VALUES ('optimizer.betas', '[0.9, 0.999]'), ('optimizer.eps', '1e-8'), ('optimizer.amsgrad', 'false')) x(path, value) WHERE opt = 'ADAMW'),
    sgd AS (SELECT trial, 'optimizer.dampening' AS path, '0.0' AS value FROM cfg WHERE opt = 'SGD')
    SELECT trial, path, value FROM merged WHERE NOT (coalesce(opt, '') = 'ADAMW' AND path = 'optimizer.nesterov') UNION ALL SELECT trial, path, value FROM adam UNION ALL SELECT trial, path, value FROM sgd""",
)
def trial_config(spark, d):
    """Configurations of one trial for each event type, whose parameters come from its counts; 'unknown' has no place in a configuration."""
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("trial")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    values = {
        "optimizer": F.when(n % 3 == 0, "sgd").when(n % 3 == 1, "AdamW"), "batch_size": (32 * (1 + n % 4)).cast("string"), "learning_rate": F.concat(F.lit("0."), (1 + n % 9).cast("string")),
        "initial_lr": F.when(n % 2 == 0, "0.05"), "unknown": F.lit("1"),
    }
    trials = t.select("trial", F.explode(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])).alias("key", "value")).filter("value IS NOT NULL")
    return experiments.trial_config(spark.createDataFrame(BASE_CONFIG, "path string, value string"), trials)


LOG = "SELECT event_type AS run, (event_id // 100)::BIGINT AS epoch, round(avg(value), 6) AS metric FROM events GROUP BY ALL"


def _log(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.floor(F.col("event_id") / 100).cast("long").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("metric"))


@query("epoch_metrics", LOG)
def epoch_metrics(spark, d):
    return _log(spark, d)


@query("best_so_far", f"SELECT *, coalesce(metric > max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM ({LOG})")
def best_so_far(spark, d):
    return experiments.best_so_far(_log(spark, d), "run", "epoch", "metric")


@query("best_checkpoint", f"SELECT run, epoch AS best_epoch, metric AS best_value FROM ({LOG}) QUALIFY row_number() OVER (PARTITION BY run ORDER BY metric DESC, epoch) = 1")
def best_checkpoint(spark, d):
    return experiments.best_checkpoint(_log(spark, d), "run", "epoch", "metric")


@query("keep_last_n", f"SELECT * FROM ({LOG}) QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) <= 3")
def keep_last_n(spark, d):
    return experiments.keep_last(_log(spark, d), "run", "epoch", 3)


@query(
    "early_stop",
    f"""WITH l AS ({LOG}), b AS (SELECT *, coalesce(metric > max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM l),
    g AS (SELECT *, sum(up::INT) OVER (PARTITION BY run ORDER BY epoch) AS grp FROM b), w AS (SELECT *, row_number() OVER (PARTITION BY run, grp ORDER BY epoch) - 1 AS wait FROM g)
    SELECT run, min(epoch) FILTER (WHERE wait >= 4) AS stop_epoch FROM w GROUP BY run""",
)
def early_stop(spark, d):
    return experiments.early_stop(_log(spark, d), "run", "epoch", "metric", 4)


@query("experiment_comparison", f"SELECT run, count(*) AS epochs, max(metric) AS best, arg_max(metric, epoch) AS last FROM ({LOG}) GROUP BY run")
def experiment_comparison(spark, d):
    return _log(spark, d).groupBy("run").agg(F.count(F.lit(1)).alias("epochs"), F.max("metric").alias("best"), F.max_by("metric", "epoch").alias("last"))


@query("trial_table", f"SELECT run AS trial_id, epoch AS training_iteration, metric, metric * 100 AS percent, rank() OVER (ORDER BY metric DESC, run, epoch)::INTEGER AS place FROM ({LOG}) QUALIFY place <= 10")
def trial_table(spark, d):
    top = _log(spark, d).orderBy(F.col("metric").desc(), "run", "epoch").limit(10)
    return top.select(F.col("run").alias("trial_id"), F.col("epoch").alias("training_iteration"), "metric", (F.col("metric") * 100).alias("percent"), F.rank().over(Window.orderBy(F.col("metric").desc(), "run", "epoch")).alias("place"))


@query("grid_product", "SELECT a.event_type AS optimizer, b.lang AS schedule, rate FROM (SELECT DISTINCT event_type FROM events) a CROSS JOIN (SELECT DISTINCT lang FROM documents) b CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.01::DOUBLE]) AS rate)")
def grid_product(spark, d):
    a = table(spark, d, "events").select(F.col("event_type").alias("optimizer")).distinct()
    b = table(spark, d, "documents").select(F.col("lang").alias("schedule")).distinct()
    return experiments.grid(a, b, spark.createDataFrame([(0.1,), (0.01,)], "rate double"))


@query("format_duration", "SELECT event_id, lpad((event_id * 7 // 3600)::VARCHAR, greatest(2, length((event_id * 7 // 3600)::VARCHAR))::INTEGER, '0') || ':' || lpad((event_id * 7 % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((event_id * 7 % 60)::VARCHAR, 2, '0') AS text FROM events")
def format_duration(spark, d):
    return table(spark, d, "events").select("event_id", experiments.duration_text(F.col("event_id") * 7).alias("text"))


@query("json_safe", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events")
def json_safe(spark, d):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    safe = F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), safe.alias("value"))
