"""Queries on what comes in: annotation files with faults, file signatures, nested columns, path prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.functions.nested import flat_rows, flat_vector
from ballast.operators import annotations, signatures, splits
from ballast.plans.base import query
from ballast.sources.annotation_files import FIELDS, annotation_rows, class_columns
from ballast.sources.tables import class_folders, scratch, table

#: Turns as annotation rows; every 11th ends before the class, every 13th has a start that is no number, every 17th an end with a point, every 5th no chunk.
NOTED = """SELECT 'vp' || conv_id AS participant_id, 'run/' || role AS file_id, turn::VARCHAR AS annotation_id, turn * 10 AS s, turn * 10 + length(text) % 90 AS e, role || ', "' || turn || '"' AS activity, conv_id * 31 + turn AS k FROM conversations"""
PROBLEM = "CASE WHEN k % 11 = 0 THEN 'fields' WHEN k % 13 = 0 THEN 'frame_start' WHEN k % 17 = 0 THEN 'frame_end' END"


def _annotation_file(spark, d) -> str:
    """Lines of a file with a header in each part, written as they are."""
    k = F.col("conv_id") * 31 + F.col("turn")
    start, end = (F.col("turn") * 10).cast("string"), (F.col("turn") * 10 + F.length("text") % 90).cast("string")
    fields = [
        F.concat(F.lit("vp"), F.col("conv_id")), F.concat(F.lit("run/"), F.col("role")), F.col("turn").cast("string"),
        F.when(k % 13 == 0, F.concat(F.lit("x"), start)).otherwise(F.concat(F.lit(" "), start)), F.when(k % 17 == 0, F.concat(end, F.lit(".5"))).otherwise(end),
    ]
    activity = F.concat(F.lit('"'), F.col("role"), F.lit(', ""'), F.col("turn"), F.lit('"""'))
    line = F.when(k % 11 == 0, F.concat_ws(",", *fields)).when(k % 5 == 0, F.concat_ws(",", *fields, activity)).otherwise(F.concat_ws(",", *fields, activity, (k % 3).cast("string"), F.lit("more")))
    at = scratch(spark, "annotations")
    table(spark, d, "conversations").select(line.alias(",".join(FIELDS))).write.csv(at, header=True, sep="\u0002", quote="\u0003")
    return at


@query(
    "annotation_file_rows",
    f"""SELECT participant_id, file_id, annotation_id, s::INTEGER AS frame_start, e::INTEGER AS frame_end, activity, CASE WHEN k % 5 = 0 THEN '0' ELSE (k % 3)::VARCHAR END AS chunk_id
    FROM ({NOTED}) WHERE {PROBLEM} IS NULL""",
)
def annotation_file_rows(spark, d):
    """The usable rows of an annotation file with short rows, numbers that aren't whole, and quotes."""
    rows = annotation_rows(spark, _annotation_file(spark, d))
    return rows.filter(F.col("problem").isNull()).drop("n_fields", "problem")


@query("annotation_file_problems", f"SELECT coalesce({PROBLEM}, 'none') AS problem, CASE WHEN k % 11 = 0 THEN 5 WHEN k % 5 = 0 THEN 6 ELSE 8 END::INTEGER AS n_fields, count(*) AS n FROM ({NOTED}) GROUP BY ALL")
def annotation_file_problems(spark, d):
    rows = annotation_rows(spark, _annotation_file(spark, d))
    return rows.groupBy(F.coalesce("problem", F.lit("none")).alias("problem"), "n_fields").agg(F.count(F.lit(1)).alias("n"))


#: A header for each source: columns of several names, in an order that depends on the source.
HEADERS = "SELECT DISTINCT source, CASE ascii(source[-1]) % 4 WHEN 0 THEN ['id', 'Label', ' action '] WHEN 1 THEN ['a', 'b', 'c', 'd', 'e', source] WHEN 2 THEN ['class', 'x', 'ACTIVITY', 'label'] ELSE ['id', 'file'] END AS header FROM documents WHERE source IS NOT NULL"


@query(
    "class_columns",
    f"""SELECT source, CASE ascii(source[-1]) % 4 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE -1 END::INTEGER AS "position", CASE ascii(source[-1]) % 4 WHEN 0 THEN ' action ' WHEN 1 THEN source WHEN 2 THEN 'ACTIVITY' END AS name FROM ({HEADERS})""",
)
def class_columns_(spark, d):
    kind = F.ascii(F.right("source", F.lit(1))) % 4
    text = lambda *names: F.array(*[F.lit(n) for n in names])
    header = F.when(kind == 0, text("id", "Label", " action ")).when(kind == 1, F.array(*[F.lit(c) for c in "abcde"], F.col("source"))).when(kind == 2, text("class", "x", "ACTIVITY", "label")).otherwise(text("id", "file"))
    headers = table(spark, d, "documents").filter(F.col("source").isNotNull()).select("source").distinct().withColumn("header", header)
    return class_columns(headers, "source", "header")


#: Pages as image files of three splits: every 9th has another format's first bytes, every 17th none at all.
IMAGES = """SELECT page_id, page_id % 3 AS split, page_id % 17 = 0 AS missing, page_id % 17 <> 0 AND page_id % 9 = 0 AS corrupt, sha256(coalesce(html, '')) || page_id % 4 AS content FROM pages"""
SHARED = f"SELECT count(*) AS n FROM (SELECT DISTINCT split, content FROM ({IMAGES}) WHERE NOT missing AND NOT corrupt) a JOIN (SELECT DISTINCT split, content FROM ({IMAGES}) WHERE NOT missing AND NOT corrupt) b ON a.content = b.content AND a.split < b.split"


def _images(spark, d):
    i = F.col("page_id")
    suffix = F.when(i % 4 == 0, ".png").when(i % 4 == 1, ".JPG").when(i % 4 == 2, ".gif").otherwise(".webp")
    own = F.when(i % 4 == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(i % 4 == 1, F.unhex(F.lit("FFD8FFE0"))).when(i % 4 == 2, F.unhex(F.lit("474946383961"))).otherwise(F.unhex(F.lit("52494646")))
    head = F.when(i % 9 == 0, F.unhex(F.lit("00FFD8FF"))).otherwise(own)
    body = F.sha2(F.coalesce("html", F.lit("")), 256).cast("binary")
    return table(spark, d, "pages").select("page_id", (i % 3).cast("string").alias("split"), F.concat(F.lit("img_"), i, suffix).alias("path"), F.when(i % 17 != 0, F.concat(head, body)).alias("content"))


@query("corrupt_files", f"SELECT page_id, corrupt FROM ({IMAGES})")
def corrupt_files(spark, d):
    return signatures.with_signature(_images(spark, d), "path", "content").select("page_id", "corrupt")


@query(
    "image_integrity",
    f"""SELECT count(*) AS total_files, count(DISTINCT content) FILTER (WHERE NOT missing AND NOT corrupt) AS checked, count(*) FILTER (WHERE corrupt) AS corrupt, count(*) FILTER (WHERE missing) AS missing,
    ({SHARED}) AS overlaps, count(*) FILTER (WHERE corrupt) = 0 AND ({SHARED}) = 0 AS passed FROM ({IMAGES})""",
)
def image_integrity(spark, d):
    return signatures.image_integrity(_images(spark, d), "split", "path", "content")


@query(
    "flat_rows",
    r"""SELECT conv_id, turn AS line, i - 1 AS place_in_turn, ws[i] AS word FROM (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS turn, string_split(coalesce(text, ''), ' ') AS ws FROM conversations), unnest(range(1, len(ws) + 1)) x(i)""",
)
def flat_rows_(spark, d):
    """Conversations as nested lists (turns of words), flattened by their schema with the positions that lead to each word."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.split(F.coalesce("text", F.lit("")), " ").alias("ws"))))
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda t: t["ws"]).alias("word"))
    flat = flat_rows(nested, "word")
    return flat.select("conv_id", F.get("place", F.lit(0)).alias("line"), F.get("place", F.lit(1)).cast("long").alias("place_in_turn"), "word")


@query("flat_vectors", "SELECT vec_id, len(embedding)::INTEGER AS dims, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 6) AS weighted FROM embeddings")
def flat_vectors(spark, d):
    """Vectors kept as blocks of rows of four, flattened to two dimensions for all rows."""
    fours = F.transform(F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / 4)), lambda k: F.slice("embedding", (k * 4 + 1).cast("int"), 4))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("fours") - 1) / 4)), lambda k: F.slice("fours", (k * 4 + 1).cast("int"), 4))
    nested = table(spark, d, "embeddings").filter(F.size("embedding") > 0).withColumn("fours", fours).select("vec_id", blocks.alias("blocks"))
    v = nested.select("vec_id", flat_vector(nested, "blocks").alias("v"))
    total = F.aggregate(F.transform("v", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return v.select("vec_id", F.size("v").alias("dims"), F.round(total, 6).alias("weighted"))


@query(
    "prefixed_paths",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'data/set/train/p' || page_id WHEN 1 THEN '/abs/p' || page_id WHEN 2 THEN 'data/set/p' || page_id ELSE 'data/set/data/setting/p' || page_id END AS path FROM pages""",
)
def prefixed_paths(spark, d):
    """Paths below a data folder unless they are absolute or stand there already."""
    i, n = F.col("page_id"), F.concat(F.lit("p"), F.col("page_id"))
    raw = F.when(i % 4 == 0, F.concat(F.lit("./train//x/../"), n)).when(i % 4 == 1, F.concat(F.lit("/abs/./"), n)).when(i % 4 == 2, F.concat(F.lit("data//set/"), n)).otherwise(F.concat(F.lit("data/setting/"), n))
    return table(spark, d, "pages").select("page_id", annotations.prefixed_path(raw, "data/set/").alias("path"))


@query(
    "class_folder_tree",
    """SELECT class, dense_rank() OVER (ORDER BY class) - 1 AS class_id, chunk, bytes FROM (
    SELECT 'kind=' || role AS class, CASE WHEN role <> 'user' THEN 'part=' || turn % 3 END AS chunk, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM conversations WHERE role IS NOT NULL AND turn IS NOT NULL GROUP BY ALL)""",
)
def class_folder_tree(spark, d):
    """A tree of class folders, some with chunk folders below, written and indexed without reading a file; classes are numbered by name."""
    root = scratch(spark, "classes")
    turns = table(spark, d, "conversations").filter("role IS NOT NULL AND turn IS NOT NULL").select(F.col("role").alias("kind"), (F.col("turn") % 3).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    turns.filter("kind = 'user'").drop("part").write.partitionBy("kind").text(root, lineSep="\n")
    turns.filter("kind <> 'user'").write.mode("append").partitionBy("kind", "part").text(root, lineSep="\n")
    found = class_folders(spark, root, [".txt"]).groupBy("class", "chunk").agg(F.sum("size").alias("bytes"))
    return found.join(splits.class_index(found, "class"), "class").select("class", F.col("class_id").cast("long").alias("class_id"), "chunk", "bytes")
