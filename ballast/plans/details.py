"""Queries on rules of detail: feature set reports, file rules, caps, report limits, and text lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.functions.hashing import hash_rank
from ballast.operators import annotations, eda, experiments, feature_report, splits
from ballast.plans.base import query
from ballast.plans.batches import KL, _kl
from ballast.plans.datasets import OVERLAP, _split_digests
from ballast.plans.evaluation import DIMS, LOG, _log
from ballast.plans.weighting import WEIGHTED, _weighted
from ballast.sources.tables import save_weights, scratch, table

X = f"SELECT vec_id % 2 AS k, label, unnest(embedding)::DOUBLE AS x, unnest(range({DIMS})) AS i, vec_id FROM embeddings"


@query(
    "feature_set_reports",
    f"""WITH x AS MATERIALIZED ({X}), c AS MATERIALIZED (SELECT k, label, i, avg(x) AS c, count(*) AS n FROM x GROUP BY ALL), g AS (SELECT k, i, avg(x) AS g FROM x GROUP BY ALL),
    d AS (SELECT x.k, x.label, vec_id, sum((x - c) * (x - c)) AS d2 FROM x JOIN c ON x.k = c.k AND x.label = c.label AND x.i = c.i GROUP BY ALL),
    s AS MATERIALIZED (SELECT k, label, count(*) AS n, avg(d2) AS msd, avg(sqrt(d2)) AS md FROM d GROUP BY ALL),
    b AS (SELECT c.k, c.label, max(n) AS n, sum((c - g) * (c - g)) AS b2 FROM c JOIN g ON c.k = g.k AND c.i = g.i GROUP BY ALL),
    p AS (SELECT a.k, a.label AS a, b.label AS b, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m FROM c a JOIN c b ON a.k = b.k AND a.i = b.i AND a.label <> b.label GROUP BY ALL),
    w AS (SELECT p.k, p.a, max((sa.md + sb.md) / (m + 1e-12::DOUBLE)) AS r, max(CASE WHEN m > 0 THEN (sa.md + sb.md) / m END) AS q, avg(m) AS m, min(m) AS least FROM p JOIN s sa ON p.k = sa.k AND p.a = sa.label JOIN s sb ON p.k = sb.k AND p.b = sb.label GROUP BY ALL),
    t AS (SELECT s.k, sum(s.n)::DOUBLE AS "rows", count(*)::DOUBLE AS classes, avg(msd) AS intra_macro, sum(s.n * msd) / sum(s.n) AS intra_micro, avg(md) AS intra_distance, avg(b2) AS inter_macro, sum(s.n * b2) / sum(s.n) AS inter_weighted FROM s JOIN b ON s.k = b.k AND s.label = b.label GROUP BY s.k),
    u AS (SELECT k, avg(r) AS dbi, avg(coalesce(q, 0)) AS dbi_plain, avg(m) AS center_mean, min(least) AS center_least FROM w GROUP BY k),
    z AS (SELECT t.*, dbi, dbi_plain, center_mean, center_least, inter_weighted / (intra_micro + 1e-12::DOUBLE) AS fisher FROM t LEFT JOIN u USING (k))
    SELECT CASE k WHEN 0 THEN 'even' ELSE 'odd' END AS "set", metric, round(value, 7) AS value FROM (UNPIVOT z ON COLUMNS(* EXCLUDE k) INTO NAME metric VALUE value)""",
)
def feature_set_reports(spark, d):
    """Even and odd rows as two feature sets, all metrics of both from one pipeline."""
    return feature_report.feature_reports(table(spark, d, "embeddings").withColumn("set", F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd")), "set", DIMS)


BINS = 20


@query(
    "kl_density",
    f"""SELECT b.bin, round(low + b.bin * width, 6) AS "from", coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * width), 5) AS density FROM (SELECT min(kl) AS low, (max(kl) - min(kl)) / {BINS} AS width, count(*)::DOUBLE AS total FROM ({KL})) CROSS JOIN range({BINS}) b(bin)
    LEFT JOIN (SELECT least(floor((kl - low) / width), {BINS - 1})::BIGINT AS bin, count(*) AS n FROM ({KL}), (SELECT min(kl) AS low, (max(kl) - min(kl)) / {BINS} AS width FROM ({KL})) GROUP BY ALL) h USING (bin)""",
)
def kl_density(spark, d):
    """The density of divergences over bins of one width, empty ones included."""
    kl = _kl(spark, d).select("kl")
    ends = kl.agg(F.min("kl").alias("low"), ((F.max("kl") - F.min("kl")) / BINS).alias("width"), F.count(F.lit(1)).cast("double").alias("total"))
    binned = kl.crossJoin(F.broadcast(ends)).groupBy(F.least(F.floor((F.col("kl") - F.col("low")) / F.col("width")), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row
    grid = spark.range(BINS).withColumnRenamed("id", "bin").crossJoin(F.broadcast(ends))
    n = F.coalesce("n", F.lit(0))
    return grid.join(binned, "bin", "left").select("bin", F.round(F.col("low") + F.col("bin") * F.col("width"), 6).alias("from"), n.alias("n"), F.round(n / (F.col("total") * F.col("width")), 5).alias("density"))


#: Files of four data sets, whose suffixes come in both cases.
LISTED = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'DAA_front' WHEN 1 THEN 'statefarm_all' WHEN 2 THEN 'other' END AS dataset, (['a.png', 'b.JPG', 'c.jpeg', 'd.PNG', 'e.txt', 'f'])[doc_id % 6 + 1] AS file FROM documents"


@query(
    "expected_files",
    f"""SELECT doc_id, CASE WHEN starts_with(lower(dataset), 'daa_') THEN x = '.png' WHEN starts_with(lower(dataset), 'statefarm_') THEN x IN ('.jpg', '.jpeg') ELSE x IN ('.png', '.jpg', '.jpeg') END AS expected, s IN ('.png', '.jpg', '.jpeg') AS listed
    FROM (SELECT *, lower(regexp_extract(file, '(\\.[^./]+)$', 1)) AS x, regexp_extract(file, '(\\.[^./]+)$', 1) AS s FROM ({LISTED}))""",
)
def expected_files(spark, d):
    """Whether a file's suffix is what its data set's name leads one to expect, and whether it is on a list that minds the case."""
    i = F.col("doc_id")
    dataset = F.when(i % 4 == 0, "DAA_front").when(i % 4 == 1, "statefarm_all").when(i % 4 == 2, "other")
    names = F.array(*[F.lit(x) for x in ("a.png", "b.JPG", "c.jpeg", "d.PNG", "e.txt", "f")])
    files = table(spark, d, "documents").select("doc_id", dataset.alias("dataset"), F.get(names, (i % 6).cast("int")).alias("file"))
    return files.select("doc_id", eda.expected_suffix(F.col("file"), F.col("dataset")).alias("expected"), eda.listed_suffix(F.col("file")).alias("listed"))


@query("first_class_relabel", "SELECT doc_id, CASE WHEN class_id = 0 THEN 'non_distracted' ELSE 'distracted' END AS \"binary\" FROM documents JOIN (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS class_id FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) USING (lang)")
def first_class_relabel(spark, d):
    """Classes c0, c1, ...: the first is one side, all others are the other."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    named = docs.join(splits.class_index(docs, "lang").withColumnRenamed("class", "lang"), "lang").select("doc_id", F.concat(F.lit("c"), F.col("class_id")).alias("name"))
    return named.select("doc_id", F.when(annotations.relabel_set(F.col("name"), ["c0"]) == 0, "non_distracted").otherwise("distracted").alias("binary"))


CAPS = [None, -1, 0, 3, 10**9]


@query("batch_caps", f"SELECT coalesce(cap::VARCHAR, 'none') AS cap, count(*) AS batches FROM (SELECT unnest([NULL, -1, 0, 3, 1000000000]) AS cap), (SELECT DISTINCT batch_id FROM ({KL})) WHERE cap IS NULL OR cap <= 0 OR batch_id < cap GROUP BY ALL")
def batch_caps(spark, d):
    """How many batches are analysed under each cap: all without one, else no more than asked for."""
    each = _kl(spark, d).select("batch_id")
    parts = [experiments.capped(each, "batch_id", cap).agg(F.count(F.lit(1)).alias("batches")).select(F.lit("none" if cap is None else str(cap)).alias("cap"), "batches") for cap in CAPS]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


@query("saved_checkpoints", f"SELECT run, epoch, metric, coalesce(metric > max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM ({LOG}) WHERE (epoch + 1) % 5 = 0")
def saved_checkpoints(spark, d):
    """Every fifth epoch is saved; only those can be the best so far."""
    return experiments.best_so_far(experiments.saved(_log(spark, d), "epoch", 5), "run", "epoch", "metric").select("run", "epoch", "metric", "is_best")


@query("candidate_names", "SELECT doc_id, array_to_string(CASE WHEN source = lang THEN [source, 'x'] WHEN lang IS NULL THEN [source, 'x'] ELSE [source, lang, 'x'] END, ',') AS names FROM documents WHERE source IS NOT NULL")
def candidate_names(spark, d):
    """Candidates in order, each once, where it came first."""
    found = F.array_distinct(F.array_compact(F.array("source", "lang", "source", F.lit("x"), "lang", F.lit("x"))))
    return table(spark, d, "documents").filter(F.col("source").isNotNull()).select("doc_id", F.array_join(found, ",").alias("names"))


@query("overlap_sample", f"SELECT split_a, split_b, hash, n FROM (SELECT *, row_number() OVER (PARTITION BY split_a, split_b ORDER BY hash) AS rn, count(*) OVER (PARTITION BY split_a, split_b) AS n FROM ({OVERLAP})) WHERE rn <= 50")
def overlap_sample(spark, d):
    """The first 50 shared contents of each pair of splits, as a report lists them, beside their number."""
    shared = eda.digest_overlap(_split_digests(spark, d), "split", "digest", "doc_id").select("split_a", "split_b", "hash")
    counts = shared.groupBy(F.col("split_a").alias("a"), F.col("split_b").alias("b")).agg(F.count(F.lit(1)).alias("n"))  # a row for each pair of splits
    ranked = hash_rank(shared, ["split_a", "split_b"], F.col("hash"), ["hash"]).filter("rn <= 50")
    return ranked.join(F.broadcast(counts), (F.col("split_a") == F.col("a")) & (F.col("split_b") == F.col("b"))).select("split_a", "split_b", "hash", "n")


@query(
    "trial_parameters",
    "SELECT event_id, 'type=' || event_type || ';user=' || user_id AS shown FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL",
)
def trial_parameters(spark, d):
    """Parameters of a trial without private keys (a leading underscore), their prefix removed."""
    e = table(spark, d, "events").filter("event_type IS NOT NULL AND user_id IS NOT NULL")
    raw = F.create_map(F.lit("config/type"), F.col("event_type"), F.lit("_rank"), F.lit("0"), F.lit("config/user"), F.col("user_id").cast("string"), F.lit("_seed"), F.lit("1"))
    shown = experiments.shown_parameters(raw)
    return e.select("event_id", F.array_join(F.transform(F.sort_array(F.map_entries(shown)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("shown"))


@query("metric_lines", f"SELECT run, 'best: ' || printf('%.4f', max(metric)) || ', last: ' || printf('%.4f', arg_max(metric, epoch)) AS line FROM ({LOG}) GROUP BY run")
def metric_lines(spark, d):
    """Float metrics of a run as one line of four places; others (epochs, names) are left out."""
    wide = _log(spark, d).groupBy("run").agg(F.max("metric").alias("best"), F.count(F.lit(1)).alias("epochs"), F.max_by("metric", "epoch").alias("last"))
    return wide.select("run", experiments.metric_line(wide).alias("line"))


PLANNED = "SELECT conv_id, turn, role, (turn * 10)::INTEGER AS s, (turn * 10 + length(text) % 90)::INTEGER AS e FROM conversations"


@query("extraction_plan", f"SELECT conv_id, turn, 'out/' || role || '/' || conv_id || '_cam_' || role || '_frames_' || s || '_' || e || '_ann_' || turn || '_chunk_0' AS folder, greatest(0, least(e - s + 1, 48))::BIGINT AS frames, sum(greatest(0, least(e - s + 1, 48))) OVER (PARTITION BY role)::BIGINT AS of_class FROM ({PLANNED})")
def extraction_plan(spark, d):
    """Where each annotation's frames go and how many there are, beside its class's total."""
    c = table(spark, d, "conversations")
    rows = c.select("conv_id", "turn", "role", (F.col("turn") * 10).cast("int").alias("s"), (F.col("turn") * 10 + F.length("text") % 90).cast("int").alias("e"))
    name = annotations.chunk_name(F.col("conv_id"), F.concat(F.lit("cam/"), F.col("role")), F.col("s"), F.col("e"), F.col("turn"), F.lit(None))
    plan = annotations.frame_plan(rows, "s", "e", 48).withColumn("folder", F.concat(F.lit("out/"), F.col("role"), F.lit("/"), name))
    totals = plan.groupBy(F.col("role").alias("of")).agg(F.sum("frames").alias("of_class"))  # a row for each class
    return plan.join(F.broadcast(totals), F.col("role") == F.col("of")).select("conv_id", "turn", "folder", "frames", "of_class")


@query("weights_csv", f"SELECT 'img_' || lpad(vec_id::VARCHAR, 6, '0') AS image_path, round(weight, 10) AS weight, 'export' AS source FROM ({WEIGHTED})")
def weights_csv(spark, d):
    """The weight table as comma-separated text with a header, read back."""
    at = scratch(spark, "weights-csv")
    rows = _weighted(spark, d).select(F.concat(F.lit("img_"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("image_path"), F.round("weight", 10).alias("weight"))
    save_weights(rows, at, "export", "csv")
    return spark.read.csv(at, header=True, schema="image_path string, weight double, source string")
