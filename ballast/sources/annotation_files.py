"""Annotation files: rows with their true field count, and what is wrong with those that can't be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["participant_id", "file_id", "annotation_id", "frame_start", "frame_end", "activity", "chunk_id"]
LEAST_FIELDS = 6

#: Names of the class column, the best one first; without any of them it is the sixth column.
CLASS_NAMES = ["activity", "action", "label", "class"]


def _whole(text: Column) -> Column:
    """A field as a whole number, or null: digits with a sign and white space around, nothing else."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(F.regexp_replace(text, r"[\s+]", "")).try_cast("int"))


def annotation_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows after each file's header, parsed, with ``n_fields`` and ``problem``: null, ``fields`` or the name of a field that is no whole number.

    Quoted fields may hold separators, doubled quotes and line breaks. A row that
    isn't wide enough has nulls for what it lacks; fields after the seventh are
    left out. A missing or empty chunk is '0'.
    """
    fields = ", ".join(f"`{c}` string" for c in FIELDS)
    raw = spark.read.option("columnPruning", False).csv(path, schema=f"{fields}, _record string", header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_record", quote='"', escape='"', multiLine=True, emptyValue="")
    # Rows of another width come with their text: its separators outside of quotes are counted.
    bare = F.regexp_replace("_record", r'(^|,)"(?:[^"]|"")*+"', "$1")
    n = F.when(F.col("_record").isNull(), len(FIELDS)).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1).cast("int")
    # Within a row's width, nothing between separators is an empty field.
    raw = raw.withColumn("_n", n).withColumns({c: F.when(F.col("_n") > k, F.coalesce(c, F.lit(""))) for k, c in enumerate(FIELDS)})
    n = F.col("_n")
    start, end = _whole(F.col("frame_start")), _whole(F.col("frame_end"))
    problem = F.when(n < LEAST_FIELDS, "fields").when(start.isNull(), "frame_start").when(end.isNull(), "frame_end")
    return raw.select(
        *FIELDS[:3], start.alias("frame_start"), end.alias("frame_end"), "activity",
        F.when(n >= LEAST_FIELDS, F.coalesce(F.nullif("chunk_id", F.lit("")), F.lit("0"))).alias("chunk_id"), n.alias("n_fields"), problem.alias("problem"),
    )


def annotations(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Usable annotation rows. Rows with fewer than six fields go; one whose frames are no whole numbers stops the job, or goes too unless ``strict``."""
    rows = annotation_rows(spark, path).filter("n_fields >= 6")
    good = F.col("problem").isNull()
    if strict:
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a whole number: "), F.col("problem"))).cast("boolean"))
    return rows.filter(good).drop("n_fields", "problem")


def class_columns(headers: DataFrame, of: str, header: str) -> DataFrame:
    """(of, position, name): where the class stands in each array of column names, by the best known name, else the sixth; position -1 if there is neither.

    Column names are rows with a rank; the smallest rank and position wins.
    """
    names = headers.select(of, F.posexplode_outer(header).alias("position", "name"))
    known = F.array_position(F.array(*[F.lit(c) for c in CLASS_NAMES]), F.lower(F.trim("name")))
    rank = F.when(known > 0, known).when(F.col("position") == LEAST_FIELDS - 1, len(CLASS_NAMES) + 1)
    best = names.groupBy(of).agg(F.min(F.struct(F.coalesce(rank, F.lit(99)).alias("rank"), "position", "name")).alias("best"))
    found = F.col("best.rank") < 99
    return best.select(of, F.when(found, F.col("best.position")).otherwise(-1).alias("position"), F.when(found, F.col("best.name")).alias("name"))
