"""Queries on studies: search spaces, schedules of runs, summaries of tests, and edge cases of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.operators import batches, checks, eda, evaluator, metrics, schedules, search, separability
from ballast.plans.base import query
from ballast.plans.batches import FREQ, _freq
from ballast.plans.evaluation import LOG, _log
from ballast.plans.reports import CLASSES
from ballast.sources.tables import table

#: Users' event types as studies: settings follow from the counts of a study. One study sets no known parameter.
COUNTS = "SELECT event_type || '-' || (user_id % 8) AS study, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY 1"
SETTINGS = f"""(WITH t AS ({COUNTS}) SELECT study, 'learning_rate' AS name, NULL::DOUBLE AS low, round(0.01::DOUBLE + n / 1000000.0::DOUBLE, 9) AS high, NULL::BOOLEAN AS log, NULL::VARCHAR AS choices FROM t WHERE n % 7 > 0
UNION ALL SELECT study, 'weight_decay', NULL, NULL, n % 2 = 0, NULL FROM t WHERE n % 7 > 0 UNION ALL SELECT study, 'dropout', 0.1, NULL, NULL, NULL FROM t WHERE n % 3 = 0 AND n % 7 > 0
UNION ALL SELECT study, 'batch_size', NULL, (64 + users)::DOUBLE, NULL, CASE WHEN n % 2 = 0 THEN '32|64' END FROM t WHERE n % 7 > 0 UNION ALL SELECT study, 'optimizer', NULL, NULL, NULL, 'ADAM|SGD' FROM t WHERE n % 7 > 0
UNION ALL SELECT study, 'min_cluster_size', NULL, (30 + n % 10)::DOUBLE, NULL, NULL FROM t WHERE n % 7 > 0 UNION ALL SELECT study, 'unknown', 1.0, 2.0, NULL, NULL FROM t)"""
KNOWN = ", ".join(f"('{name}', '{kind}', {low or 0.0 if kind != 'choice' else 'NULL'}::DOUBLE, {high or 'NULL'}::DOUBLE, {repr('|'.join(choices)) if choices else 'NULL'})" for name, kind, low, high, choices in search.KNOWN)
WEIGHTING = ", ".join(f"('{name}', '{kind}', {low}::DOUBLE, {high}::DOUBLE, NULL)" for name, kind, low, high, _ in search.WEIGHTING)


def _space_sql(known: str) -> str:
    return f"""WITH s AS MATERIALIZED (SELECT * FROM {SETTINGS}), k(name, kind0, low0, high0, choices0) AS (VALUES {known}),
    m AS (SELECT study, name, CASE WHEN kind0 IN ('log', 'uniform') AND log IS NOT NULL THEN CASE WHEN log THEN 'log' ELSE 'uniform' END WHEN kind0 = 'integer' AND choices IS NOT NULL THEN 'choice' ELSE kind0 END AS kind,
      coalesce(low, low0) AS low, coalesce(high, high0) AS high, coalesce(choices, choices0) AS choices FROM s JOIN k USING (name)),
    r AS (SELECT study, name, kind, CASE WHEN kind <> 'choice' THEN low END AS low, CASE WHEN kind <> 'choice' THEN high END AS high, CASE WHEN kind = 'choice' THEN choices END AS choices FROM m
      UNION ALL SELECT study, d.* FROM (SELECT DISTINCT study FROM s WHERE study NOT IN (SELECT study FROM m)), (VALUES ('learning_rate', 'log', 1e-5::DOUBLE, 5e-2::DOUBLE, NULL), ('weight_decay', 'log', 1e-6::DOUBLE, 1e-3::DOUBLE, NULL), ('optimizer', 'choice', NULL, NULL, 'ADAM|SGD')) d(name, kind, low, high, choices))
    SELECT study, count(*) OVER (PARTITION BY study) AS parameters, name, kind, low, high, choices FROM r"""


def _settings(spark, d):
    e = table(spark, d, "events").filter("event_type IS NOT NULL AND user_id IS NOT NULL")
    t = e.groupBy(F.concat("event_type", F.lit("-"), (F.col("user_id") % 8).cast("string")).alias("study")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    n, none = F.col("n"), F.lit(None)
    one = lambda name, there, low=none, high=none, log=none, choices=none: F.when(there, F.struct(F.lit(name).alias("name"), low.cast("double").alias("low"), high.cast("double").alias("high"), log.cast("boolean").alias("log"), choices.cast("array<string>").alias("choices")))
    some = n % 7 > 0
    rows = F.array(
        one("learning_rate", some, high=F.round(0.01 + n / 1000000.0, 9)), one("weight_decay", some, log=n % 2 == 0), one("dropout", (n % 3 == 0) & some, low=F.lit(0.1)),
        one("batch_size", some, high=64 + F.col("users"), choices=F.when(n % 2 == 0, F.array(F.lit("32"), F.lit("64")))), one("optimizer", some, choices=F.array(F.lit("ADAM"), F.lit("SGD"))),
        one("min_cluster_size", some, high=30 + n % 10), one("unknown", F.lit(True), low=F.lit(1.0), high=F.lit(2.0)),
    )
    return t.select("study", F.explode(F.array_compact(rows)).alias("s")).select("study", "s.*")


@query("search_space_info", _space_sql(KNOWN))
def search_space_info(spark, d):
    """Every study's parameters, from its settings and the defaults."""
    return search.described(search.configured(_settings(spark, d)))


@query("search_space_extended", _space_sql(f"{KNOWN}, {WEIGHTING}"))
def search_space_extended(spark, d):
    """As ``search_space_info``, with the weighting's parameters."""
    return search.described(search.configured(_settings(spark, d), weighting=True))


@query(
    "search_space_narrow",
    f"""WITH t AS ({COUNTS}), r AS (SELECT study, 'learning_rate' AS name, 'log' AS kind, 1e-4::DOUBLE AS low, round(0.001::DOUBLE + n / 1000000.0::DOUBLE, 9) AS high, NULL AS choices FROM t
    UNION ALL SELECT study, 'weight_decay', 'log', 1e-5, 1e-4, NULL FROM t UNION ALL SELECT study, 'optimizer', 'choice', NULL, NULL, 'ADAM|SGD' FROM t WHERE n % 2 = 0)
    SELECT study, count(*) OVER (PARTITION BY study) AS parameters, name, kind, low, high, choices FROM r""",
)
def search_space_narrow(spark, d):
    """Rates near a good estimate of each study; an optimizer only where there is more than one."""
    n = table(spark, d, "events").filter("event_type IS NOT NULL AND user_id IS NOT NULL").groupBy(F.concat("event_type", F.lit("-"), (F.col("user_id") % 8).cast("string")).alias("study")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None)
    rate = F.struct(F.lit("learning_rate").alias("name"), none.cast("double").alias("low"), F.round(0.001 + F.col("n") / 1000000.0, 9).alias("high"), none.cast("boolean").alias("log"), none.cast("array<string>").alias("choices"))
    several = F.struct(F.lit("optimizer").alias("name"), none.cast("double").alias("low"), none.cast("double").alias("high"), none.cast("boolean").alias("log"), F.array(F.lit("ADAM"), F.lit("SGD")).alias("choices"))
    bounds = n.select("study", F.explode(F.array_compact(F.array(rate, F.when(F.col("n") % 2 == 0, several)))).alias("s")).select("study", "s.*")
    return search.described(search.narrowed(bounds))


RATE = 0.1


@query(
    "lr_schedules",
    f"""SELECT run, epoch, round(0.0::DOUBLE + 0.05::DOUBLE * (1 + cos(pi() * epoch / n)), 10) AS cosine, round(0.1::DOUBLE * pow(0.95::DOUBLE, epoch), 10) AS exponential, round(0.1::DOUBLE * exp(-1.5::DOUBLE * epoch), 10) AS decayed,
    round(0.1::DOUBLE * pow(0.5::DOUBLE, epoch // 10), 10) AS stepped, round(0.1::DOUBLE + (0.001::DOUBLE - 0.1::DOUBLE) * epoch / n, 10) AS linear FROM (SELECT *, max(epoch) OVER (PARTITION BY run) + 1 AS n FROM ({LOG}))""",
)
def lr_schedules(spark, d):
    """Rates of every epoch of every run in the log, over as many epochs as its run has."""
    rates = {
        "cosine": lambda e, n: schedules.cosine(e, n, RATE), "exponential": lambda e, n: schedules.exponential(e, RATE, 0.95), "decayed": lambda e, n: schedules.exponential(e, RATE, 1.5),
        "stepped": lambda e, n: schedules.stepped(e, RATE, 10, 0.5), "linear": lambda e, n: schedules.linear(e, n, RATE, 0.001),
    }
    return schedules.scheduled(_log(spark, d), "run", "epoch", rates).drop("metric")


def _restart_sql(first: int) -> str:
    return f"round(0.2::DOUBLE * (1 + cos(pi() * (epoch - {first} * (pow(2, floor(log2(epoch / {first}.0::DOUBLE + 1))) - 1)) / ({first} * pow(2, floor(log2(epoch / {first}.0::DOUBLE + 1)))))), 10)"


@query("lr_restarts", f"SELECT run, epoch, {_restart_sql(10)} AS restarted, {_restart_sql(11)} AS direct, round(0.2::DOUBLE * (1 + cos(pi() * (epoch % 10) / 10)), 10) AS even, round(0.4::DOUBLE * pow(0.1::DOUBLE, epoch // 20), 10) AS stepped FROM ({LOG})")
def lr_restarts(spark, d):
    """Restarts with cycles that double, one epoch later where called directly, and with even cycles; the base rate is that of four workers."""
    rate = RATE * schedules.scale_factor(True, world=4)
    rates = {
        "restarted": lambda e, n: schedules.restarted(e, rate), "direct": lambda e, n: schedules.restarted(e, rate, direct=True), "even": lambda e, n: schedules.restarted(e, rate, growth=1),
        "stepped": lambda e, n: schedules.stepped(e, rate, 20, 0.1),
    }
    return schedules.scheduled(_log(spark, d), "run", "epoch", rates).drop("metric")


#: Two experiments (halves of the rows) with three checkpoints each (scores of ten other dimensions).
HALVES = " UNION ALL ".join(
    f"SELECT CASE vec_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS experiment, 'm{m}' AS checkpoint, label AS t, list_position(s, list_max(s)) - 1 AS p FROM (SELECT vec_id, label, list_transform(embedding[{m * 10 + 1}:{m * 10 + 10}], lambda x: x::DOUBLE) AS s FROM embeddings)" for m in range(3)
)


@query(
    "test_summary",
    f"""WITH g AS MATERIALIZED ({HALVES}), a AS (SELECT experiment, checkpoint, round(avg((t = p)::INT), 6) AS accuracy FROM g GROUP BY ALL),
    b AS (SELECT experiment, checkpoint, round(sum(tp / (n + 1e-9::DOUBLE)) / {CLASSES}, 6) AS balanced_accuracy FROM (SELECT experiment, checkpoint, t, count(*) AS n, count(*) FILTER (WHERE t = p) AS tp FROM g GROUP BY ALL) GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY balanced_accuracy DESC, checkpoint) = 1 AS is_best FROM a JOIN b USING (experiment, checkpoint)""",
)
def test_summary(spark, d):
    """All checkpoints of two experiments with their accuracies, the best of each marked."""
    half = F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd")
    models = F.array(*[F.struct(F.concat(half, F.lit(f"/m{m}")).alias("model"), F.slice(separability.doubles("embedding"), m * 10 + 1, 10).alias("s")) for m in range(3)])
    each = table(spark, d, "embeddings").select("label", F.explode(models).alias("m")).select("label", "m.model", "m.s")
    guess = F.array_position("s", F.array_max("s")) - 1
    return evaluator.summary(evaluator.evaluated(metrics.losses(each, "s", "label").withColumn("p", guess), "model", "label", "p", "ce", CLASSES))


@query(
    "lorenz_points",
    f"""WITH f AS MATERIALIZED (SELECT n, row_number() OVER (ORDER BY n, doc_id) AS place, sum(n) OVER (ORDER BY n, doc_id) AS up, sum(n) OVER () AS drawn, count(*) OVER () AS items FROM ({FREQ}))
    SELECT place, round(place::DOUBLE / items, 8) AS item_share, round(up::DOUBLE / drawn, 8) AS draw_share FROM f UNION ALL SELECT 0, 0.0, 0.0 WHERE (SELECT count(*) FROM f) > 0""",
)
def lorenz_points(spark, d):
    """A point of the curve for each item that was drawn, from the origin on."""
    return batches.lorenz_points(_freq(spark, d), "n", "doc_id")


#: Classes of a source with the number of its longer texts, which may be none.
LONGER = "SELECT source, lang AS class, count(*) FILTER (WHERE n_chars >= 600) AS n FROM documents GROUP BY ALL"


@query("imbalance_by_source", f"SELECT source, count(class) AS classes, CASE WHEN count(class) = 0 THEN 1.0 WHEN min(n) FILTER (WHERE class IS NOT NULL) > 0 THEN round(max(n) FILTER (WHERE class IS NOT NULL)::DOUBLE / min(n) FILTER (WHERE class IS NOT NULL), 2) END::DOUBLE AS ratio, coalesce(min(n) FILTER (WHERE class IS NOT NULL) = 0, false) AS infinite FROM ({LONGER}) GROUP BY source")
def imbalance_by_source(spark, d):
    """Imbalance within every source, empty classes and sources without classes included."""
    counts = table(spark, d, "documents").groupBy("source", F.col("lang").alias("class")).agg(F.count_if(F.col("n_chars") >= 600).alias("n"))
    return eda.imbalance_by(counts, "source")


@query("whole_labels", "SELECT vec_id, label::BIGINT AS label FROM embeddings")
def whole_labels(spark, d):
    """Labels that come as text (padded, or with a zero fraction) as whole numbers."""
    label = F.col("label").cast("string")
    text = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit(" "), label)).when(F.col("vec_id") % 3 == 1, F.concat(label, F.lit(".0"))).otherwise(label)
    return checks.whole_labels(table(spark, d, "embeddings").select("vec_id", text.alias("label")), "label")
