"""Queries on batches of labels: divergence, coverage, concentration, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ballast.functions.running import quantiles, running
from ballast.operators import batches, sampling
from ballast.plans.base import query
from ballast.plans.weighting import DRAWS, _draws
from ballast.sources.tables import scratch, table
from ballast.streaming import analyser
from ballast.streaming import batches as stream

SIZE = 64
#: Streams arrive in so many pieces, or in more, so that a piece of consecutive events has about so many rows at most.
PIECES, PIECE_ROWS = 6, 1 << 21
EVENTS = f"SELECT event_id, user_id, event_type AS label, (event_id // {SIZE})::BIGINT AS batch_id FROM events"
HIST = f"""SELECT b.batch_id, c.label, count(e.label) AS n FROM (SELECT DISTINCT batch_id FROM ({EVENTS})) b CROSS JOIN (SELECT DISTINCT label FROM ({EVENTS})) c
LEFT JOIN ({EVENTS}) e ON e.batch_id = b.batch_id AND e.label = c.label GROUP BY b.batch_id, c.label"""
SHARES = f"""SELECT batch_id, label, n, total, c, even, (n::DOUBLE / total + 1e-10::DOUBLE) / (1 + c * 1e-10::DOUBLE) AS p, (even::DOUBLE / total + 1e-10::DOUBLE) / (1 + c * 1e-10::DOUBLE) AS q
FROM (SELECT *, total // c + CASE WHEN i < total % c THEN 1 ELSE 0 END AS even FROM (SELECT *, sum(n) OVER (PARTITION BY batch_id)::BIGINT AS total, count(*) OVER (PARTITION BY batch_id) AS c, row_number() OVER (PARTITION BY batch_id ORDER BY label) - 1 AS i FROM ({HIST})))"""
KL = f"""SELECT batch_id, sum(n)::BIGINT AS "rows", round(sum(p * ln(p / q)), 8) AS kl, round(-sum(p * ln(p)), 8) AS entropy, round(CASE WHEN max(c) > 1 THEN -sum(p * ln(p)) / ln(max(c)::DOUBLE) ELSE 1.0 END, 8) AS entropy_share FROM ({SHARES}) GROUP BY batch_id"""


def _events(spark, d):
    return sampling.batches(table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("label")), "event_id", SIZE)


def _hist(spark, d):
    e = _events(spark, d)
    return batches.histogram(e, e.select("label").distinct())


def _kl(spark, d):
    return batches.divergence(_hist(spark, d))


@query("batch_histogram", HIST)
def batch_histogram(spark, d):
    return _hist(spark, d)


@query("batch_kl", f"SELECT batch_id, kl FROM ({KL})")
def batch_kl(spark, d):
    return _kl(spark, d).select("batch_id", "kl")


@query("batch_entropy", f'SELECT batch_id, "rows", entropy, entropy_share FROM ({KL})')
def batch_entropy(spark, d):
    return _kl(spark, d).select("batch_id", "rows", "entropy", "entropy_share")


@query("kl_summary", f"SELECT count(*) AS batches, round(avg(kl), 7) AS mean, round(stddev_pop(kl), 7) AS std, min(kl) AS least, max(kl) AS most FROM ({KL})")
def kl_summary(spark, d):
    return _kl(spark, d).agg(F.count(F.lit(1)).alias("batches"), F.round(F.avg("kl"), 7).alias("mean"), F.round(F.stddev_pop("kl"), 7).alias("std"), F.min("kl").alias("least"), F.max("kl").alias("most"))


@query("kl_improvement", f"SELECT CASE WHEN abs(a) > 1e-8 THEN round((1 - b / a) * 100, 4) END AS improvement FROM (SELECT avg(kl) FILTER (WHERE batch_id % 2 = 0) AS a, avg(kl) FILTER (WHERE batch_id % 2 = 1) AS b FROM ({KL}))")
def kl_improvement(spark, d):
    both = _kl(spark, d).agg(F.avg(F.when(F.col("batch_id") % 2 == 0, F.col("kl"))).alias("a"), F.avg(F.when(F.col("batch_id") % 2 == 1, F.col("kl"))).alias("b"))
    return both.select(F.round(batches.improvement(F.col("a"), F.col("b")), 4).alias("improvement"))


@query("batch_unique", f"SELECT batch_id, count(DISTINCT user_id) AS n_unique FROM ({EVENTS}) GROUP BY batch_id")
def batch_unique(spark, d):
    return _events(spark, d).groupBy("batch_id").agg(F.count_distinct("user_id").alias("n_unique"))


@query(
    "cumulative_unique",
    f"""SELECT b.batch_id, sum(u) OVER (ORDER BY b.batch_id)::BIGINT AS cum_batch_unique, sum(coalesce(f, 0)) OVER (ORDER BY b.batch_id)::BIGINT AS cum_true_unique
    FROM (SELECT batch_id, count(DISTINCT user_id) AS u FROM ({EVENTS}) GROUP BY batch_id) b
    LEFT JOIN (SELECT first AS batch_id, count(*) AS f FROM (SELECT user_id, min(batch_id) AS first FROM ({EVENTS}) GROUP BY user_id) GROUP BY first) n ON b.batch_id = n.batch_id""",
)
def cumulative_unique(spark, d):
    e = _events(spark, d)
    fresh = e.groupBy("user_id").agg(F.min("batch_id").alias("batch_id")).groupBy("batch_id").agg(F.count(F.lit(1)).alias("f"))
    each = e.groupBy("batch_id").agg(F.count_distinct("user_id").alias("u")).join(fresh, "batch_id", "left")
    up = running(each, "batch_id", [], {"cum_batch_unique": F.col("u"), "cum_true_unique": F.coalesce("f", F.lit(0))})
    return up.select("batch_id", "cum_batch_unique", "cum_true_unique")


FREQ = f"SELECT d.doc_id, count(*) AS n, any_value(n_chars) AS weight FROM ({DRAWS}) r JOIN documents d ON r.doc_id = d.doc_id GROUP BY d.doc_id"


def _freq(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("weight"))
    return _draws(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(w, "doc_id")


@query("path_frequency", FREQ)
def path_frequency(spark, d):
    return _freq(spark, d)


@query("weight_frequency_corr", f"SELECT CASE WHEN stddev_pop(n) > 0 AND stddev_pop(weight) > 0 THEN round(corr(n, weight), 7) END AS r FROM ({FREQ})")
def weight_frequency_corr(spark, d):
    return _freq(spark, d).agg(F.when((F.stddev_pop("n") > 0) & (F.stddev_pop("weight") > 0), F.round(F.corr("n", "weight"), 7)).alias("r"))


@query("kl_rolling", f"SELECT rn::BIGINT AS x, round(m, 7) AS mean FROM (SELECT row_number() OVER (ORDER BY batch_id) AS rn, count(*) OVER () AS n, avg(kl) OVER (ORDER BY batch_id ROWS 9 PRECEDING) AS m FROM ({KL})) WHERE rn >= 10 OR (n < 10 AND rn = n)")
def kl_rolling(spark, d):
    return batches.rolling_mean(_kl(spark, d), 10)


@query("kl_ecdf", f"SELECT batch_id, kl, round(row_number() OVER (ORDER BY kl, batch_id)::DOUBLE / count(*) OVER (), 8) AS y FROM ({KL})")
def kl_ecdf(spark, d):
    return batches.ecdf(_kl(spark, d).select("batch_id", "kl"))


@query("kl_histogram", f"SELECT bin, count(*) AS n FROM (SELECT least(floor(kl / 0.01::DOUBLE), 19)::BIGINT AS bin FROM ({KL})) GROUP BY bin")
def kl_histogram(spark, d):
    return _kl(spark, d).groupBy(F.least(F.floor(F.col("kl") / F.lit(0.01)), F.lit(19)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("kl_box", f"SELECT round(quantile_cont(kl, 0.25), 7) AS q1, round(quantile_cont(kl, 0.5), 7) AS q2, round(quantile_cont(kl, 0.75), 7) AS q3 FROM ({KL})")
def kl_box(spark, d):
    cuts = quantiles(_kl(spark, d), "kl", [0.25, 0.5, 0.75])
    return spark.createDataFrame([tuple(cuts)], "q1 double, q2 double, q3 double").select(*[F.round(c, 7).alias(c) for c in ("q1", "q2", "q3")])


@query(
    "lorenz",
    f"""SELECT x, items, round(sum(items) OVER (ORDER BY x)::DOUBLE / sum(items) OVER (), 8) AS item_share, round(sum(x * items) OVER (ORDER BY x)::DOUBLE / sum(x * items) OVER (), 8) AS draw_share
    FROM (SELECT n AS x, count(*) AS items FROM ({FREQ}) GROUP BY n)""",
)
def lorenz(spark, d):
    return batches.concentration(_freq(spark, d))


@query("gini", f"SELECT round(2 * sum(i * n) / (count(*)::DOUBLE * sum(n)) - (count(*) + 1)::DOUBLE / count(*), 8) AS gini FROM (SELECT n, row_number() OVER (ORDER BY n, doc_id) AS i FROM ({FREQ}))")
def gini(spark, d):
    return batches.gini(_freq(spark, d))


@query("class_deviation", f"SELECT label, round(avg(abs(n::DOUBLE / total - even::DOUBLE / total)), 8) AS deviation FROM ({SHARES}) GROUP BY label")
def class_deviation(spark, d):
    each = Window.partitionBy("batch_id")
    h = _hist(spark, d).withColumns({"t": F.sum("n").over(each), "c": F.count(F.lit(1)).over(each), "i": F.row_number().over(each.orderBy("label")) - 1})
    even = batches.uniform_count(F.col("t"), F.col("i"), F.col("c"))
    return h.groupBy("label").agg(F.round(F.avg(F.abs(F.col("n") / F.col("t") - even / F.col("t"))), 8).alias("deviation"))


@query("mean_batch_dist", f"SELECT label, round(avg(n::DOUBLE / total), 8) AS share FROM ({SHARES}) GROUP BY label")
def mean_batch_dist(spark, d):
    h = _hist(spark, d).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("batch_id")))
    return h.groupBy("label").agg(F.round(F.avg("p"), 8).alias("share"))


@query("label_range_check", "SELECT min(label) AS least, max(label) AS most, count(*) > 0 AND min(label) >= 0 AND max(label) < 10 AS valid FROM embeddings")
def label_range_check(spark, d):
    e = table(spark, d, "embeddings")
    return e.agg(F.min("label").alias("least"), F.max("label").alias("most"), ((F.count(F.lit(1)) > 0) & (F.min("label") >= 0) & (F.max("label") < 10)).alias("valid"))


@query("batch_cap", f"SELECT batch_id, count(*) AS n FROM ({EVENTS}) WHERE batch_id < 5 GROUP BY batch_id")
def batch_cap(spark, d):
    return _events(spark, d).filter("batch_id < 5").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_daily_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    """Counts by day through a stream that is run to its end, open windows included."""
    return _streamed_days(spark, d)


DAILY = "SELECT event_id, user_id, event_type AS label, strftime(date_trunc('day', ts), '%Y-%m-%d') AS batch_id FROM events"


@query("stream_batch_kl", f"SELECT batch_id AS day, \"rows\", kl, entropy FROM ({KL.replace(EVENTS, DAILY)})")
def stream_batch_kl(spark, d):
    """Divergence of each day's event types, from the counts that a stream gives."""
    counts = _streamed_days(spark, d).withColumnRenamed("event_type", "label")
    hist = counts.select("day").distinct().crossJoin(F.broadcast(counts.select("label").distinct())).join(counts, ["day", "label"], "left")  # class dimension only
    return batches.divergence(hist.select("day", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "day").select("day", "rows", "kl", "entropy")


#: Samples are users; a row's weight is its value, one in seven has none.
SEEN = f"SELECT event_id, user_id::VARCHAR AS sample, (event_id // {SIZE})::BIGINT AS batch_id, CASE WHEN event_id % 7 <> 0 THEN value::DOUBLE END AS weight FROM events"


def _updates(spark, d):
    """Events that arrive in pieces, in the order of their ids: a run takes each piece as one micro-batch and goes on from the last one's checkpoint, with more files there."""
    at = scratch(spark, "analyser")
    e = sampling.batches(table(spark, d, "events").select("event_id", "user_id", "value").filter("event_id IS NOT NULL"), "event_id", SIZE)
    rows = e.select(F.col("user_id").alias("sample"), "batch_id", F.col("event_id").alias("position"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("weight"))
    n = rows.count()
    pieces = max(PIECES, -(-n // PIECE_ROWS))
    each = max(1, -(-n // (pieces * analyser.TASK_ROWS)))  # tasks that write one piece
    # Ranges follow the rows and not the ids, whose gaps may be wide; an id that often comes is dealt by sample.
    placed = rows.repartitionByRange(pieces * each, "position", "sample").withColumn("piece", F.floor(F.spark_partition_id() / each).cast("int"))
    placed.write.partitionBy("piece").parquet(f"{at}/pieces")  # one shuffle for all pieces
    for k in range(pieces):
        spark.read.schema(placed.schema).parquet(f"{at}/pieces").filter(F.col("piece") == k).drop("piece").write.mode("append").parquet(f"{at}/in")
        arrived = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        analyser.run_available(analyser.sample_updates(arrived), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


@query(
    "stream_sample_states",
    f"SELECT sample, count(*) AS n, min(batch_id) AS first_batch, arg_min(weight, event_id) FILTER (WHERE weight IS NOT NULL) AS first_weight FROM ({SEEN}) GROUP BY sample",
)
def stream_sample_states(spark, d):
    """Sampling counts and first-seen weights of all samples, from state kept across micro-batches and restarts."""
    return analyser.sample_states(_updates(spark, d))


@query(
    "stream_coverage",
    f"""SELECT b.batch_id, b."rows", n_unique, coalesce(n_new, 0) AS n_new, (sum(n_unique) OVER (ORDER BY b.batch_id))::BIGINT AS cum_batch_unique, (sum(coalesce(n_new, 0)) OVER (ORDER BY b.batch_id))::BIGINT AS cum_true_unique
    FROM (SELECT batch_id, count(*) AS "rows", count(DISTINCT sample) AS n_unique FROM ({SEEN}) GROUP BY batch_id) b
    LEFT JOIN (SELECT first AS batch_id, count(*) AS n_new FROM (SELECT sample, min(batch_id) AS first FROM ({SEEN}) GROUP BY sample) GROUP BY first) f USING (batch_id)""",
)
def stream_coverage(spark, d):
    """Each batch's samples and new samples, and the union of samples up to it, from the same state."""
    each = analyser.coverage(_updates(spark, d))
    return running(each, "batch_id", [], {"cum_batch_unique": F.col("n_unique"), "cum_true_unique": F.col("n_new")})


def _streamed_days(spark, d):
    at = scratch(spark, "stream")
    schema = table(spark, d, "events").schema
    counts = stream.windowed_counts(stream.event_stream(spark, d, "events", schema), "event_type")
    stream.run_available(counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n"), f"{at}/out", f"{at}/state", "complete")
    return spark.read.parquet(f"{at}/out")
