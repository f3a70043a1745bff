"""Queries on datasets: classes, splits, overlap, mappings, annotations, paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ballast.functions.hashing import hash_rank, order_key
from ballast.operators import annotations, eda, splits, weights
from ballast.plans.base import query
from ballast.sources.tables import table

COUNTS = "SELECT lang AS class, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY lang"
SPLIT = """SELECT doc_id, lang, n_chars, text, source, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + b THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rn,
      floor(count(*) OVER (PARTITION BY lang) * 0.7::DOUBLE) AS a, floor(count(*) OVER (PARTITION BY lang) * 0.15::DOUBLE) AS b FROM documents)"""
INDEX = "SELECT lang AS class, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS class_id FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)"
TAIL = f"""SELECT doc_id, lang FROM (
  SELECT doc_id, t.lang, class_id, count(*) OVER (PARTITION BY t.lang) AS n, row_number() OVER (PARTITION BY t.lang ORDER BY md5('43:' || doc_id), doc_id) AS rn
  FROM (SELECT * FROM ({SPLIT}) WHERE split = 'train') t JOIN ({INDEX}) i ON t.lang = i.class)
WHERE rn <= greatest(1, floor(n * (0.7::DOUBLE * pow(0.5::DOUBLE, class_id))))"""


def _docs(spark, d):
    return table(spark, d, "documents")


def _counts(spark, d):
    return eda.class_distribution(_docs(spark, d), "lang", "n_chars")


def _split(spark, d):
    return splits.stratified_split(_docs(spark, d), "doc_id", "lang")


def _split_digests(spark, d):
    """(doc_id, lang, digest, split): texts are hashed where they are read, so that the split deals out their digests only."""
    rows = _docs(spark, d).select("doc_id", "lang", eda.digest(F.col("text")).alias("digest"))
    return splits.stratified_split(rows, "doc_id", "lang")


@query("class_distribution", COUNTS)
def class_distribution(spark, d):
    return _counts(spark, d)


@query("class_percentage", f"SELECT class, n, round(100.0::DOUBLE * n / sum(n) OVER (), 2) AS percentage FROM ({COUNTS})")
def class_percentage(spark, d):
    return eda.class_percentage(_counts(spark, d))


@query("imbalance_ratio", f"SELECT count(*) AS classes, round(max(n)::DOUBLE / min(n), 2) AS imbalance_ratio FROM ({COUNTS})")
def imbalance_ratio(spark, d):
    return eda.imbalance(_counts(spark, d))


@query("imbalance_per_class", f"SELECT class, n, round(max(n) OVER ()::DOUBLE / n, 6) AS ratio FROM ({COUNTS})")
def imbalance_per_class(spark, d):
    return eda.imbalance_per_class(_counts(spark, d))


@query("stratified_split", f"SELECT doc_id, lang, split FROM ({SPLIT})")
def stratified_split(spark, d):
    return splits.stratified_split(_docs(spark, d).select("doc_id", "lang"), "doc_id", "lang")


@query("split_class_counts", f"SELECT split, lang AS class, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM ({SPLIT}) GROUP BY split, lang")
def split_class_counts(spark, d):
    return eda.class_distribution(_split(spark, d), "lang", "n_chars", "split")


@query("dataset_totals", "SELECT count(*) AS items, round(sum(n_chars) / 1048576.0::DOUBLE, 2) AS mib, count(DISTINCT lang) AS classes, array_to_string(list_sort(list(DISTINCT lang)), ',') AS names FROM documents")
def dataset_totals(spark, d):
    return eda.dataset_totals(_docs(spark, d), "lang", "n_chars")


@query("dataset_type", "SELECT source, CASE WHEN count(DISTINCT lang) = 2 AND bool_or(lang = 'en') THEN 'binary' ELSE 'multiclass' END AS dataset_type FROM documents GROUP BY source")
def dataset_type(spark, d):
    names = F.collect_set("lang")
    return _docs(spark, d).groupBy("source").agg(F.when((F.size(names) == 2) & F.array_contains(names, "en"), "binary").otherwise("multiclass").alias("dataset_type"))


@query(
    "eda_summary_rollup",
    """SELECT dataset, class, count(*) AS n FROM (SELECT 'documents' AS dataset, lang AS class FROM documents UNION ALL SELECT 'events', event_type FROM events UNION ALL SELECT 'orders', o_orderpriority FROM orders)
    GROUP BY ROLLUP (dataset, class)""",
)
def eda_summary_rollup(spark, d):
    parts = [table(spark, d, t).select(F.lit(t).alias("dataset"), F.col(c).alias("class")) for t, c in (("documents", "lang"), ("events", "event_type"), ("orders", "o_orderpriority"))]
    return parts[0].union(parts[1]).union(parts[2]).rollup("dataset", "class").agg(F.count(F.lit(1)).alias("n"))


@query("longtail_train", TAIL)
def longtail_train(spark, d):
    return splits.long_tail(_split(spark, d).filter("split = 'train'").select("doc_id", "lang"), "doc_id", "lang")


@query(
    "retention_table",
    f"SELECT class, class_id, n, CASE WHEN n > 0 THEN greatest(1, floor(n * (0.7::DOUBLE * pow(0.5::DOUBLE, class_id))))::BIGINT ELSE 0 END AS kept FROM ({COUNTS}) JOIN ({INDEX}) USING (class)",
)
def retention_table(spark, d):
    counts = _counts(spark, d).join(splits.class_index(_docs(spark, d), "lang"), "class")
    return counts.select("class", "class_id", "n", splits.retention(F.col("n"), F.col("class_id")).alias("kept"))


@query(
    "variant_manifest",
    f"""SELECT 'balanced' AS variant, split, lang AS class, count(*) AS n FROM ({SPLIT}) GROUP BY ALL
    UNION ALL SELECT 'imbalanced', 'train', lang, count(*) FROM ({TAIL}) GROUP BY lang
    UNION ALL SELECT 'imbalanced', split, lang, count(*) FROM ({SPLIT}) WHERE split <> 'train' GROUP BY split, lang""",
)
def variant_manifest(spark, d):
    split = _split(spark, d).select("doc_id", "lang", "split")
    tail = splits.long_tail(split.filter("split = 'train'"), "doc_id", "lang")
    parts = split.withColumn("variant", F.lit("balanced")).unionByName(tail.unionByName(split.filter("split <> 'train'")).withColumn("variant", F.lit("imbalanced")))
    return parts.groupBy("variant", "split", F.col("lang").alias("class")).agg(F.count(F.lit(1)).alias("n"))


BINARY = "CASE WHEN lang = 'en' THEN 'non_distracted' ELSE 'distracted' END"


@query(
    "binary_variants",
    f"""WITH c AS (SELECT 'balanced_binary' AS variant, split, {BINARY} AS class, count(*) AS n FROM ({SPLIT}) GROUP BY ALL
    UNION ALL SELECT 'imbalanced_binary', 'train', {BINARY} AS class, count(*) FROM ({TAIL}) GROUP BY ALL
    UNION ALL SELECT 'imbalanced_binary', split, {BINARY} AS class, count(*) FROM ({SPLIT}) WHERE split <> 'train' GROUP BY split, class)
    SELECT variant, split, class, n, sum(n) OVER (PARTITION BY variant, split)::BIGINT AS total FROM c""",
)
def binary_variants(spark, d):
    """Counts of the two binary data sets made from the balanced and the imbalanced one, with each split's total."""
    counts = variant_manifest(spark, d).withColumn("class", F.when(annotations.relabel_set(F.col("class"), ["en"]) == 0, "non_distracted").otherwise("distracted"))
    counts = counts.groupBy(F.concat("variant", F.lit("_binary")).alias("variant"), "split", "class").agg(F.sum("n").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("variant", "split")))


@query("balanced_pool", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) AS rn FROM events) WHERE rn <= 20")
def balanced_pool(spark, d):
    return splits.head_per_class(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type", 20)


@query(
    "class_coverage_sample",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents),
    l AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM r WHERE rn > 3)
    SELECT doc_id, lang FROM r WHERE rn <= 3 UNION ALL SELECT doc_id, lang FROM l WHERE rn <= 40 - (SELECT count(*) FROM r WHERE rn <= 3)""",
)
def class_coverage_sample(spark, d):
    return splits.class_coverage(_docs(spark, d).select("doc_id", "lang"), "doc_id", "lang", 3, 40)


@query("integrity_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= floor(n * 0.1::DOUBLE)")
def integrity_sample(spark, d):
    return splits.sample_share(_docs(spark, d).select("doc_id"), "doc_id", 0.1)


@query(
    "holdout_split",
    """SELECT vec_id, label, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
    FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)""",
)
def holdout_split(spark, d):
    return splits.stratified_split(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 0.8, 0.0)


ZERO = ["view", "click"]
MAPPING = [("first", ["standard", "economy anodized steel"]), ("second", ["promo", "small"])]
FUZZY = """SELECT p_partkey, p_type, CASE WHEN t IN ('standard', 'economy anodized steel') OR contains(t, 'standard') OR contains(t, 'economy anodized steel') OR contains('standard', t) OR contains('economy anodized steel', t) THEN 'first'
 WHEN t IN ('promo', 'small') OR contains(t, 'promo') OR contains(t, 'small') OR contains('promo', t) OR contains('small', t) THEN 'second' ELSE 'other' END AS "binary" FROM (SELECT *, lower(trim(p_type)) AS t FROM part)"""


@query("binary_relabel_set", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS label FROM events")
def binary_relabel_set(spark, d):
    return table(spark, d, "events").select("event_id", annotations.relabel_set(F.col("event_type"), ZERO).alias("label"))


@query("binary_relabel_fuzzy", FUZZY)
def binary_relabel_fuzzy(spark, d):
    return annotations.relabel_fuzzy(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", MAPPING, "other")


@query("binary_counts", f'SELECT "binary", count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 8) AS share FROM ({FUZZY}) GROUP BY "binary"')
def binary_counts(spark, d):
    counts = binary_relabel_fuzzy(spark, d).groupBy("binary").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 8))


@query("custom_mapping", "SELECT DISTINCT event_type AS class, CASE WHEN event_type IN ('view', 'click') THEN 'non_distracted' ELSE 'distracted' END AS binary_class FROM events")
def custom_mapping(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("class")).distinct().withColumn("binary_class", F.when(F.col("class").isin(ZERO), "non_distracted").otherwise("distracted"))


@query("class_index", INDEX)
def class_index(spark, d):
    return splits.class_index(_docs(spark, d), "lang")


@query("complement_classes", "SELECT DISTINCT event_type AS class FROM events WHERE event_type NOT IN ('view', 'click')")
def complement_classes(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("class")).distinct().join(F.broadcast(spark.createDataFrame([(z,) for z in ZERO], "class string")), "class", "left_anti")


@query("union_classes", "SELECT event_type AS class FROM events UNION SELECT lang FROM documents")
def union_classes(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("class")).union(_docs(spark, d).select("lang")).distinct()


@query("missing_classes", f"SELECT DISTINCT source FROM documents EXCEPT SELECT source FROM ({SPLIT}) WHERE split = 'val'")
def missing_classes(spark, d):
    return _docs(spark, d).select("source").distinct().subtract(_split(spark, d).filter("split = 'val'").select("source"))


@query("ordered_dedupe", "SELECT source, min(doc_id) AS first_id FROM documents GROUP BY source")
def ordered_dedupe(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.min("doc_id").alias("first_id"))


OVERLAP = f"""WITH f AS (SELECT split, sha1(text) AS hash, min(doc_id) AS path FROM ({SPLIT}) WHERE text IS NOT NULL GROUP BY split, sha1(text))
SELECT a.hash, a.split AS split_a, a.path AS path_a, b.split AS split_b, b.path AS path_b FROM f a JOIN f b ON a.hash = b.hash AND a.split < b.split"""


@query("content_overlap", OVERLAP)
def content_overlap(spark, d):
    return eda.digest_overlap(_split_digests(spark, d), "split", "digest", "doc_id")


@query(
    "integrity_report",
    f"SELECT count(*) AS total_files, count(DISTINCT sha1(text)) AS checked, count(*) FILTER (WHERE text IS NULL) AS missing, (SELECT count(*) FROM ({OVERLAP})) AS overlaps, (SELECT count(*) FROM ({OVERLAP})) = 0 AS passed FROM documents",
)
def integrity_report(spark, d):
    return eda.integrity_report(_split_digests(spark, d), "split", "digest")


@query(
    "conversion_verify",
    f"SELECT split, count(*) AS planned, count(DISTINCT source || '/' || (doc_id % 100)) AS distinct_dest, count(*) - count(DISTINCT source || '/' || (doc_id % 100)) AS collisions FROM ({SPLIT}) GROUP BY split",
)
def conversion_verify(spark, d):
    dest = F.count_distinct(F.concat_ws("/", "source", (F.col("doc_id") % 100).cast("string")))
    return _split(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("planned"), dest.alias("distinct_dest"), (F.count(F.lit(1)) - dest).alias("collisions"))


@query("filename_collisions", "SELECT source, doc_id % 100 AS name, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def filename_collisions(spark, d):
    return _docs(spark, d).groupBy("source", (F.col("doc_id") % 100).alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("sequential_names", "SELECT doc_id, lang, 'img_' || lpad((row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1)::VARCHAR, 6, '0') AS name FROM documents")
def sequential_names(spark, d):
    ranked = hash_rank(_docs(spark, d).select("doc_id", "lang"), ["lang"], order_key("doc_id"), ["doc_id"])
    return ranked.select("doc_id", "lang", F.concat(F.lit("img_"), F.lpad((F.col("rn") - 1).cast("string"), 6, "0")).alias("name"))


@query("pool_union_dedupe", f"SELECT lang, doc_id % 50 AS name, max_by(split, (split = 'test')::INT * 1000000000 + doc_id) AS split, count(*) AS n FROM ({SPLIT}) GROUP BY ALL")
def pool_union_dedupe(spark, d):
    last = F.max_by("split", (F.col("split") == "test").cast("long") * 1000000000 + F.col("doc_id"))
    return _split(spark, d).groupBy("lang", (F.col("doc_id") % 50).alias("name")).agg(last.alias("split"), F.count(F.lit(1)).alias("n"))


@query("extension_filter", "SELECT page_id, url FROM pages WHERE lower(regexp_extract(url, '(\\.[^./]+)$', 1)) IN ('.html', '.htm', '')")
def extension_filter(spark, d):
    return table(spark, d, "pages").select("page_id", "url").filter(F.lower(F.regexp_extract("url", r"(\.[^./]+)$", 1)).isin(".html", ".htm", ""))


@query("path_class", "SELECT page_id, split_part(url, '/', -1) AS name, split_part(url, '/', -2) AS parent FROM pages")
def path_class(spark, d):
    parts = F.split("url", "/")
    return table(spark, d, "pages").select("page_id", F.element_at(parts, -1).alias("name"), F.get(parts, F.size(parts) - 2).alias("parent"))


@query("canonical_path", "SELECT doc_id, '/data/' || source || '/' || doc_id AS path FROM documents")
def canonical_path(spark, d):
    raw = F.concat(F.lit("/data//./"), F.col("source"), F.lit("/x/.././"), F.col("doc_id").cast("string"), F.lit("/"))
    return _docs(spark, d).select("doc_id", annotations.normal_path(raw).alias("path"))


ROOTS = "SELECT DISTINCT lang AS dataset, CASE WHEN lang IN ('de', 'en') AND doc_id % 3 > 0 THEN 'split_' || (doc_id % 3) WHEN lang = 'fr' THEN 'split_' || (doc_id % 4) WHEN lang = 'de' THEN 'train' ELSE 'other' END AS folder FROM documents WHERE lang IS NOT NULL"


@query("dataset_root", f"SELECT dataset, CASE WHEN bool_or(folder IN ('train', 'val', 'test')) THEN '' WHEN bool_or(folder = 'split_0') THEN 'split_0' ELSE coalesce(min(folder) FILTER (WHERE starts_with(folder, 'split_')), '') END AS root FROM ({ROOTS}) GROUP BY dataset")
def dataset_root(spark, d):
    i = F.col("doc_id")
    part = lambda n: F.concat(F.lit("split_"), (i % n).cast("string"))
    folder = F.when(F.col("lang").isin("de", "en") & (i % 3 > 0), part(3)).when(F.col("lang") == "fr", part(4)).when(F.col("lang") == "de", "train").otherwise("other")
    folders = _docs(spark, d).filter(F.col("lang").isNotNull()).select(F.col("lang").alias("dataset"), folder.alias("folder")).distinct()
    return eda.dataset_root(folders, "dataset", "folder")


@query("path_match", "SELECT split_part(url, '/', 3) AS host, arg_min(page_id, lpad((length(url) - length(replace(url, '/', '')))::VARCHAR, 4, '0') || url || ':' || lpad(page_id::VARCHAR, 12, '0')) AS page_id FROM pages GROUP BY 1")
def path_match(spark, d):
    depth = F.lpad((F.length("url") - F.length(F.replace("url", F.lit("/"), F.lit("")))).cast("string"), 4, "0")
    key = F.concat(depth, F.col("url"), F.lit(":"), F.lpad(F.col("page_id").cast("string"), 12, "0"))
    return table(spark, d, "pages").groupBy(F.get(F.split("url", "/"), 2).alias("host")).agg(F.min_by("page_id", key).alias("page_id"))


ANN = "SELECT conv_id, turn, role, (turn * 10)::INTEGER AS s, (turn * 10 + length(text) % 90)::INTEGER AS e FROM conversations"


def _annotations(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", (F.col("turn") * 10).cast("int").alias("s"), (F.col("turn") * 10 + F.length("text") % 90).cast("int").alias("e"))


PLAN = f"SELECT *, greatest(0, least(e - s + 1, 48))::BIGINT AS frames FROM ({ANN})"


@query("annotation_plan", PLAN)
def annotation_plan(spark, d):
    return annotations.frame_plan(_annotations(spark, d), "s", "e", 48)


@query("extraction_stats", f"SELECT role AS activity, count(*) AS annotations, sum(frames)::BIGINT AS frames, count(*) FILTER (WHERE frames >= 48) AS capped FROM ({PLAN}) GROUP BY role")
def extraction_stats(spark, d):
    return annotation_plan(spark, d).groupBy(F.col("role").alias("activity")).agg(F.count(F.lit(1)).alias("annotations"), F.sum("frames").alias("frames"), F.count_if(F.col("frames") >= 48).alias("capped"))


@query("missing_videos", "SELECT conv_id, count(*) AS turns FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = c.conv_id) GROUP BY conv_id")
def missing_videos(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("conv_id"))
    return table(spark, d, "conversations").join(pages, "conv_id", "left_anti").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))


@query("file_candidates", "SELECT source, unnest([source || x FOR x IN ['', '.mp4', '.avi', '.mov', '.mkv', '.m4v', '.mpg', '.mpeg', '.wmv']]) AS candidate FROM (SELECT DISTINCT source FROM documents)")
def file_candidates(spark, d):
    name = F.concat(F.lit("./"), F.col("source"))
    return _docs(spark, d).select("source").distinct().select("source", F.explode(annotations.file_candidates(name)).alias("candidate"))


@query("chunk_dir_names", f"SELECT conv_id, turn, conv_id || '_' || role || '_x_frames_' || s || '_' || e || '_ann_' || turn || '_chunk_0' AS name FROM ({ANN})")
def chunk_dir_names(spark, d):
    a = _annotations(spark, d)
    return a.select("conv_id", "turn", annotations.chunk_name(F.col("conv_id"), F.concat("role", F.lit("/x")), F.col("s"), F.col("e"), F.col("turn"), F.lit(None)).alias("name"))


#: A listing with files at their exact names, in other folders, and at two depths.
FILES = "SELECT DISTINCT CASE WHEN page_id % 4 = 0 THEN 'cam/v' || page_id || '.avi' WHEN page_id % 4 = 1 THEN 'old/x/v' || page_id || '.mkv' WHEN page_id % 4 = 2 THEN 'b/v' || page_id || '.mp4' ELSE 'y/z/v' || page_id || '.mov' END AS path FROM pages UNION SELECT 'a/v' || page_id || '.wmv' FROM pages WHERE page_id % 8 = 1"


@query(
    "video_resolution",
    f"""SELECT id AS file_id, coalesce((SELECT min(path) FROM ({FILES}) f WHERE f.path = i.name || '.avi'),
    (SELECT arg_min(path, lpad((length(path) - length(replace(path, '/', '')))::VARCHAR, 3, '0') || path) FROM ({FILES}) f WHERE split_part(path, '/', -1) IN (SELECT split_part(i.name, '/', -1) || x FROM (SELECT unnest(['.mp4', '.avi', '.mov', '.mkv', '.m4v', '.mpg', '.mpeg', '.wmv']) AS x))), i.name || '.mp4') AS resolved
    FROM (SELECT DISTINCT './cam\\v' || conv_id AS id, 'cam/v' || conv_id AS name FROM conversations) i""",
)
def video_resolution(spark, d):
    p = F.col("page_id")
    at = F.when(p % 4 == 0, F.concat(F.lit("cam/v"), p, F.lit(".avi"))).when(p % 4 == 1, F.concat(F.lit("old/x/v"), p, F.lit(".mkv"))).when(p % 4 == 2, F.concat(F.lit("b/v"), p, F.lit(".mp4"))).otherwise(F.concat(F.lit("y/z/v"), p, F.lit(".mov")))
    pages = table(spark, d, "pages")
    listing = pages.select(at.alias("path")).union(pages.filter("page_id % 8 = 1").select(F.concat(F.lit("a/v"), p, F.lit(".wmv"))))
    ids = table(spark, d, "conversations").select(F.concat(F.lit("./cam\\v"), F.col("conv_id")).alias("file_id"))
    return annotations.resolved_paths(ids, listing, "file_id", "path")


@query("class_weights", "SELECT event_type AS class, count(*) AS n, round(sum(count(*)) OVER ()::DOUBLE / count(*), 8) AS weight FROM events GROUP BY event_type")
def class_weights(spark, d):
    return weights.class_weights(table(spark, d, "events"), "event_type")


@query("normalized_weights", "SELECT doc_id, round(n_chars::DOUBLE / (SELECT sum(n_chars) FROM documents), 10) AS share FROM documents")
def normalized_weights(spark, d):
    return weights.normalized(_docs(spark, d).select("doc_id", "n_chars"), F.col("n_chars")).select("doc_id", F.round("share", 10).alias("share"))


@query("content_hashes", "SELECT doc_id, sha1(text) AS sha1, substr(md5(source), 1, 16) AS url_key, sha256(text) AS sha256 FROM documents")
def content_hashes(spark, d):
    return _docs(spark, d).select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"), F.substring(F.md5(F.col("source").cast("binary")), 1, 16).alias("url_key"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("relative_path", "SELECT page_id, CASE WHEN page_id % 3 > 0 THEN split_part(url, '/', -1) ELSE substr(url, length('https://') + 1) END AS path FROM pages WHERE starts_with(url, 'https://')")
def relative_path(spark, d):
    base = F.when(F.col("page_id") % 3 > 0, F.lit("/data")).otherwise(F.lit("https:/"))
    return table(spark, d, "pages").filter(F.col("url").startswith("https://")).select("page_id", annotations.relative_path(F.col("url"), base).alias("path"))


@query("split_from_filename", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM documents")
def split_from_filename(spark, d):
    split = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "val").otherwise("test")
    return _docs(spark, d).select("doc_id", annotations.split_of_name(F.concat(F.lit("part."), split, F.lit(".csv"))).alias("split"))


@query("manifest_type", "SELECT source, contains(source || '_imbalanced_' || lang, 'imbalanced') AS imbalanced, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY source, lang UNION ALL SELECT source, false, count(*) FROM documents WHERE lang IS NULL GROUP BY source")
def manifest_type(spark, d):
    name = F.concat("source", F.when(F.col("lang").isNull(), "_balanced").otherwise(F.concat(F.lit("_imbalanced_"), F.col("lang"))))
    kinds = _docs(spark, d).groupBy("source", name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.select("source", F.contains("name", F.lit("imbalanced")).alias("imbalanced"), "n")


@query("type_coercion", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'true' WHEN event_id % 4 = 1 THEN event_id::VARCHAR WHEN event_id % 4 = 2 THEN (event_id // 2) || '.5' ELSE event_type END AS raw, CASE event_id % 4 WHEN 0 THEN 'boolean' WHEN 1 THEN 'long' WHEN 2 THEN 'double' ELSE 'string' END AS kind FROM events")
def type_coercion(spark, d):
    """The narrowest type that an argument's text can be read as."""
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, "true").when(i % 4 == 1, i.cast("string")).when(i % 4 == 2, F.concat(F.floor(i / 2).cast("string"), F.lit(".5"))).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", raw.alias("raw")).withColumn("kind", eda.kind_of(F.col("raw")))


@query("map_json_roundtrip", "SELECT lang AS class, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def map_json_roundtrip(spark, d):
    """Class counts as one map, written as JSON and read back; one entry for each class."""
    counts = _docs(spark, d).filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    text = counts.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "n"))))).alias("json"))
    return text.select(F.explode(F.from_json("json", "map<string,long>")).alias("class", "n"))
