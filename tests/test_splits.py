"""Splits deal out digests in place of contents, and no class is dealt to one task."""

import contextlib
import io
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ballast.functions.hashing import hash_rank, order_key
from ballast.operators import splits
from ballast.plans import registry
from tests.oracle import differs


def exchanges(df) -> list[str]:
    """The sections of the plan's exchanges, with the columns that they deal out."""
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain("formatted")
    return re.findall(r"^\(\d+\) Exchange\n(?:.+\n)+", said.getvalue(), re.M)


@pytest.mark.parametrize("name", ["integrity_report", "content_overlap", "overlap_sample"])
def test_no_text_is_dealt_out(spark, sf, name):
    found = exchanges(registry.queries()[name](spark, sf))
    assert found and not [e for e in found if re.search(r"\btext#", e)]


def test_no_exchange_by_class_alone(spark, sf):
    df = splits.stratified_split(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "lang")
    rows = [e for e in exchanges(df) if "doc_id#" in e]  # others deal out sums of buckets
    assert rows and all("_bucket#" in e.split("Arguments:")[1] or "_at#" in e.split("Arguments:")[1] for e in rows)


def test_group_sizes_beside_ranks(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 2)).alias("c"))
    got = hash_rank(df, ["c"], order_key("id"), ["id"], size="n").groupBy("c", "n").agg(F.count(F.lit(1)).alias("k"), F.max("rn").alias("most")).collect()
    assert sorted(map(tuple, got), key=str) == [("c0", 20, 20, 20), ("c1", 20, 20, 20), (None, 20, 20, 20)]


@pytest.mark.parametrize("rows", [0, 60])
def test_report_of_copies_and_missing_texts(spark, tmp_path, rows):
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), F.col("id") % 10)).alias("text"), F.when(F.col("id") % 5 > 0, "en").alias("lang"), F.lit("s").alias("source"), F.lit(2).cast("long").alias("n_chars"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert differs(registry.queries()["integrity_report"](spark, str(tmp_path)), con, registry.oracle_sql()["integrity_report"]) is None
