"""Reports: several models from one scan, two loaders side by side, schedules over the batches of a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.functions.permutation import permuted, permuted_sql
from ballast.operators import annotations, evaluator, experiments, metrics, sampling, separability
from ballast.plans.base import query
from ballast.sources.tables import table

CLASSES = 10
#: Three models: each takes the scores of ten other dimensions.
GUESSES = " UNION ALL ".join(
    f"SELECT 'm{m}' AS model, label AS t, list_position(s, list_max(s)) - 1 AS p, -(s[label + 1] - list_max(s) - ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s)))))) AS ce FROM (SELECT label, list_transform(embedding[{m * 10 + 1}:{m * 10 + 10}], lambda x: x::DOUBLE) AS s FROM embeddings)"
    for m in range(3)
)
CELLS = f"SELECT model, t, p, count(*) AS n, sum(ce) AS loss FROM ({GUESSES}) GROUP BY ALL"
BY_CLASS = f"""SELECT m.model, c.c AS class, coalesce(support, 0) AS support, coalesce(tp, 0) / (coalesce(predicted, 0) + 1e-9::DOUBLE) AS precision, coalesce(tp, 0) / (coalesce(support, 0) + 1e-9::DOUBLE) AS recall
FROM (SELECT DISTINCT model FROM cells) m CROSS JOIN range({CLASSES}) c(c)
LEFT JOIN (SELECT model, t AS c, sum(n) AS support, sum(n) FILTER (WHERE t = p) AS tp FROM cells GROUP BY ALL) a ON m.model = a.model AND c.c = a.c
LEFT JOIN (SELECT model, p AS c, sum(n) AS predicted FROM cells GROUP BY ALL) b ON m.model = b.model AND c.c = b.c"""


@query(
    "evaluator_report",
    f"""WITH cells AS MATERIALIZED ({CELLS}), k AS MATERIALIZED (SELECT *, 2 * precision * recall / (precision + recall + 1e-9::DOUBLE) AS f1 FROM ({BY_CLASS})),
    r AS (
      SELECT model, 'confusion' AS metric, t::BIGINT AS class, p::BIGINT AS guess, n::DOUBLE AS value FROM cells
      UNION ALL SELECT model, 'loss', NULL, NULL, sum(loss) / sum(n) FROM cells GROUP BY model
      UNION ALL SELECT model, 'accuracy', NULL, NULL, coalesce(sum(n) FILTER (WHERE t = p), 0)::DOUBLE / sum(n) FROM cells GROUP BY model
      UNION ALL SELECT model, 'balanced_accuracy', NULL, NULL, avg(recall) FROM k GROUP BY model
      UNION ALL SELECT model, 'precision', class, NULL, precision FROM k UNION ALL SELECT model, 'recall', class, NULL, recall FROM k
      UNION ALL SELECT model, 'f1', class, NULL, f1 FROM k UNION ALL SELECT model, 'support', class, NULL, support::DOUBLE FROM k)
    SELECT model, metric, class, guess, round(value, 6) AS value FROM r""",
)
def evaluator_report(spark, d):
    """Loss, accuracies, class metrics and confusion of three models over all rows."""
    models = F.array(*[F.struct(F.lit(f"m{m}").alias("model"), F.slice(separability.doubles("embedding"), m * 10 + 1, 10).alias("s")) for m in range(3)])
    each = table(spark, d, "embeddings").select("label", F.explode(models).alias("m")).select("label", "m.model", "m.s")
    guess = F.array_position("s", F.array_max("s")) - 1
    return evaluator.evaluated(metrics.losses(each, "s", "label").withColumn("p", guess), "model", "label", "p", "ce", CLASSES)


BATCH = 32
N = "(SELECT count(*) FROM embeddings)"
#: A row's weight is one by the rows of its label, in millionths; the order of the running sum is that of the draws' hashes.
WEIGHTED = f"""(WITH w AS (SELECT vec_id, label, round(1.0::DOUBLE / count(*) OVER (PARTITION BY label) * 1000000)::BIGINT AS w, md5('42:' || vec_id) AS k FROM embeddings),
c AS (SELECT vec_id, label, sum(w) OVER (ORDER BY k, vec_id) - w AS low, sum(w) OVER (ORDER BY k, vec_id) AS high, sum(w) OVER () AS total FROM w),
u AS (SELECT i AS draw, floor(('0x' || substr(md5('42:draw:' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * (SELECT max(total) FROM c)::DOUBLE)::BIGINT AS pos FROM range({N}) r(i))
SELECT 'weighted' AS loader, draw // {BATCH} AS batch_id, vec_id AS sample, label FROM u JOIN c ON pos >= low AND pos < high)"""
LOADED = f"(SELECT 'baseline' AS loader, place // {BATCH} AS batch_id, vec_id AS sample, label FROM ({permuted_sql('SELECT vec_id AS i FROM embeddings', N, 42)}) JOIN embeddings ON vec_id = i UNION ALL {WEIGHTED})"


def _loaded(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    n = e.count()
    baseline = e.select(F.lit("baseline").alias("loader"), F.floor(permuted(F.col("vec_id"), n, sampling.SEED) / BATCH).alias("batch_id"), F.col("vec_id").alias("sample"), "label")
    sizes = e.groupBy(F.col("label").alias("of")).agg(F.count(F.lit(1)).alias("size"))
    w = e.join(F.broadcast(sizes), F.col("label") == F.col("of")).select("vec_id", (F.lit(1.0) / F.col("size")).alias("w"))  # a row for each class
    drawn = sampling.weighted_draws(w, "vec_id", "w", n).join(e, "vec_id")
    return baseline.unionByName(drawn.select(F.lit("weighted").alias("loader"), F.floor(F.col("draw") / BATCH).alias("batch_id"), F.col("vec_id").alias("sample"), "label"))


@query(
    "loader_comparison",
    f"""WITH l AS MATERIALIZED (SELECT * FROM {LOADED}), k AS (SELECT DISTINCT label FROM embeddings),
    h AS (SELECT b.loader, b.batch_id, k.label, count(l.label) AS n FROM (SELECT DISTINCT loader, batch_id FROM l) b CROSS JOIN k LEFT JOIN l ON l.loader = b.loader AND l.batch_id = b.batch_id AND l.label = k.label GROUP BY ALL),
    s AS (SELECT *, sum(n) OVER (PARTITION BY loader, batch_id)::BIGINT AS total, count(*) OVER (PARTITION BY loader, batch_id) AS c, row_number() OVER (PARTITION BY loader, batch_id ORDER BY label) - 1 AS i FROM h),
    p AS (SELECT loader, batch_id, c, (n::DOUBLE / total + 1e-10::DOUBLE) / (1 + c * 1e-10::DOUBLE) AS p, ((total // c + CASE WHEN i < total % c THEN 1 ELSE 0 END)::DOUBLE / total + 1e-10::DOUBLE) / (1 + c * 1e-10::DOUBLE) AS q FROM s),
    e AS (SELECT loader, batch_id, round(sum(p * ln(p / q)), 8) AS kl, round(-sum(p * ln(p)), 8) AS entropy, round(CASE WHEN max(c) > 1 THEN -sum(p * ln(p)) / ln(max(c)::DOUBLE) ELSE 1.0 END, 8) AS entropy_share FROM p GROUP BY ALL),
    t AS (SELECT loader, count(*)::DOUBLE AS batches, avg(kl) AS mean_kl, stddev_pop(kl) AS std_kl, avg(entropy) AS mean_entropy, avg(entropy_share) AS mean_entropy_share FROM e GROUP BY loader),
    u AS (SELECT loader, count(*)::DOUBLE AS samples, max(n)::DOUBLE AS most_drawn FROM (SELECT loader, sample, count(*) AS n FROM l GROUP BY ALL) GROUP BY loader),
    w AS (UNPIVOT (SELECT * FROM t JOIN u USING (loader)) ON batches, mean_kl, std_kl, mean_entropy, mean_entropy_share, samples, most_drawn INTO NAME metric VALUE value),
    v AS (SELECT metric, max(value) FILTER (WHERE loader = 'baseline') AS baseline, max(value) FILTER (WHERE loader = 'weighted') AS weighted FROM w GROUP BY metric)
    SELECT metric, round(baseline, 6) AS baseline, round(weighted, 6) AS weighted FROM (SELECT * FROM v UNION ALL SELECT 'improvement_percent', NULL, CASE WHEN abs(baseline) > 1e-8 THEN (1 - weighted / baseline) * 100 END FROM v WHERE metric = 'mean_kl')""",
)
def loader_comparison(spark, d):
    """A uniform epoch beside a weighted one: divergence, entropy and coverage of their batches."""
    return evaluator.side_by_side(_loaded(spark, d), table(spark, d, "embeddings").select("label").distinct(), "loader", "baseline", "weighted")


@query(
    "loader_coverage",
    f"""SELECT b.batch_id, n_unique, (sum(coalesce(f.new, 0)) OVER (ORDER BY b.batch_id))::BIGINT AS "union" FROM (SELECT batch_id, count(DISTINCT sample) AS n_unique FROM {LOADED} WHERE loader = 'weighted' GROUP BY batch_id) b
    LEFT JOIN (SELECT batch_id, count(*) AS new FROM (SELECT sample, min(batch_id) AS batch_id FROM {LOADED} WHERE loader = 'weighted' GROUP BY sample) GROUP BY batch_id) f USING (batch_id)""",
)
def loader_coverage(spark, d):
    """The union of samples up to each batch of the weighted epoch."""
    return evaluator.cumulative_coverage(_loaded(spark, d), "loader", "weighted")


@query(
    "batch_schedules",
    """SELECT batch_id, n, round(0.4::DOUBLE * (0.05::DOUBLE + 0.5::DOUBLE * (1 - 0.05::DOUBLE) * (1 + cos(pi() * batch_id / greatest(last, 1)))), 9) AS cosine,
    round(0.4::DOUBLE * pow(0.5::DOUBLE, batch_id // 10), 9) AS stepped, round(0.4::DOUBLE * (1 - batch_id::DOUBLE / greatest(last, 1)), 9) AS linear
    FROM (SELECT event_id // 64 AS batch_id, count(*) AS n, max(max(event_id // 64)) OVER () AS last FROM events GROUP BY 1)""",
)
def batch_schedules(spark, d):
    """Learning rates of every batch of the log, scaled by four workers; the schedules run over the batches that there are."""
    b = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 64).alias("batch_id")).agg(F.count(F.lit(1)).alias("n"))
    return experiments.scheduled(b, "batch_id", 0.1, scale=4)


@query(
    "search_space_of_trials",
    """SELECT param, count(DISTINCT value) AS n_values, CASE WHEN count(*) = count(TRY_CAST(value AS DOUBLE)) THEN 'number' ELSE 'choice' END AS kind, round(min(TRY_CAST(value AS DOUBLE)), 6) AS least, round(max(TRY_CAST(value AS DOUBLE)), 6) AS most
    FROM (SELECT 'type' AS param, event_type AS value FROM events UNION ALL SELECT 'value', round(value::DOUBLE, 2)::VARCHAR FROM events UNION ALL SELECT 'user', (user_id % 5)::VARCHAR FROM events) WHERE value IS NOT NULL GROUP BY param""",
)
def search_space_of_trials(spark, d):
    """The search space that a log of trials spans: for each parameter its values and range."""
    e = table(spark, d, "events")
    trials = e.select(F.col("event_type").alias("type"), F.round(F.col("value").cast("double"), 2).cast("string").alias("value"), (F.col("user_id") % 5).cast("string").alias("user"))
    return experiments.spanned_space(trials.unpivot([], ["type", "value", "user"], "param", "value"))


PARTS = "(SELECT event_id, event_id * 7 // 3600 AS h, event_id * 7 % 3600 // 60 AS m, event_id * 7 % 60 AS s FROM events)"


@query(
    "durations_in_words",
    f"SELECT event_id, h || ' hours, ' || m || ' minutes, ' || s || ' seconds' AS words, 'ETA: ' || CASE WHEN h + m + s = 0 THEN '0s' ELSE concat_ws(' ', CASE WHEN h > 0 THEN h || 'h' END, CASE WHEN m > 0 THEN m || 'm' END, CASE WHEN s > 0 THEN s || 's' END) END AS eta FROM {PARTS}",
)
def durations_in_words(spark, d):
    return table(spark, d, "events").select("event_id", experiments.duration_words(F.col("event_id") * 7).alias("words"), experiments.remaining_text(F.col("event_id") * 7).alias("eta"))


#: Turns as extractions: those of an even conversation whose page isn't there fail, and a failed one has no frames.
TAKEN = "SELECT c.role AS activity, p.page_id IS NOT NULL AS ok, CASE WHEN p.page_id IS NOT NULL THEN greatest(0, least(length(text) % 90 + 1, 48)) ELSE 0 END AS frames FROM conversations c LEFT JOIN (SELECT DISTINCT page_id FROM pages) p ON c.conv_id * 2 = p.page_id"


@query("extraction_outcome", f"SELECT activity, count(*) AS annotations, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failed, coalesce(sum(frames), 0)::BIGINT AS frames FROM ({TAKEN}) GROUP BY ROLLUP (activity)")
def extraction_outcome(spark, d):
    """Successes, failures and frames of each class, and of all."""
    there = table(spark, d, "pages").select("page_id").distinct().withColumn("ok", F.lit(True))
    taken = table(spark, d, "conversations").join(there, F.col("conv_id") * 2 == F.col("page_id"), "left")
    return annotations.outcome(taken.select(F.col("role").alias("activity"), F.coalesce("ok", F.lit(False)).alias("ok"), F.greatest(F.lit(0), F.least(F.length("text") % 90 + 1, F.lit(48))).alias("frames")))


#: Source files by split and class, and the binary copy of them: one class has lost every 19th file.
SOURCE = "SELECT doc_id, doc_id % 3 AS split, lang FROM documents WHERE lang IS NOT NULL"
DEST = f"SELECT doc_id, split, CASE WHEN lang = 'en' THEN 'zero' ELSE 'one' END AS target FROM ({SOURCE}) WHERE NOT (lang = 'en' AND doc_id % 19 = 0)"


@query(
    "conversion_counts",
    f"""SELECT split, target, source, coalesce(dest, 0) AS dest, source = coalesce(dest, 0) AS verified FROM (SELECT split, CASE WHEN lang = 'en' THEN 'zero' ELSE 'one' END AS target, count(*) AS source FROM ({SOURCE}) GROUP BY ALL)
    LEFT JOIN (SELECT split, target, count(*) AS dest FROM ({DEST}) GROUP BY ALL) USING (split, target)""",
)
def conversion_counts(spark, d):
    """Files of each split and target class before and after a conversion, and whether they are as many."""
    source = table(spark, d, "documents").filter(F.col("lang").isNotNull()).select("doc_id", (F.col("doc_id") % 3).alias("split"), F.when(F.col("lang") == "en", "zero").otherwise("one").alias("target"), "lang")
    dest = source.filter(~((F.col("lang") == "en") & (F.col("doc_id") % 19 == 0)))
    return annotations.conversion_counts(source, dest, ["split", "target"])
