"""The chain of chunks, clusters and weights over chunks in which the kernel finds clusters."""

import duckdb
import numpy as np
import pytest

from ballast.plans import registry
from tests.oracle import differs


@pytest.fixture
def planted(spark, tmp_path):
    """A chunk of two groups of 64 rows around directions of their own, and a shorter one of scattered rows."""
    r = np.random.default_rng(3)
    near = np.eye(8)[np.arange(128) % 2] * 10 + r.normal(0, 0.3, (128, 8))
    rows = [(i, i % 5, [float(v) for v in x]) for i, x in enumerate(np.concatenate([near, r.normal(size=(30, 8))]))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    return str(tmp_path), con


@pytest.mark.parametrize("name", ["flagship_fallback", "flagship_default"])
def test_chunks_with_clusters(spark, planted, name):
    at, con = planted
    df = registry.queries()[name](spark, at)
    assert differs(df, con, registry.oracle_sql()[name]) is None


def test_the_kernel_decides_by_default_only(spark, planted):
    at, _ = planted
    above = {name: [r["vec_id"] % 2 for r in registry.queries()[name](spark, at).filter("chunk = 0 AND cluster = 0").collect()] for name in ("flagship_fallback", "flagship_default")}
    assert len(set(above["flagship_default"])) == 1 and len(set(above["flagship_fallback"])) == 2
