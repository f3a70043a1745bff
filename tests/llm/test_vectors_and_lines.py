"""Centroid clusters, vector codes and line dedup against brute force and SQL, on generated and on hard tables."""

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ballast.llm import centroids, line_index, vector_codes
from tests.llm.helpers import read, tables
from tests.oracle import differs

VECTORS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("cluster", pa.string()), ("code", pa.string()), ("_cluster", pa.int32())])


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def vectors(folder, rows: list[dict]) -> str:
    pq.write_table(pa.Table.from_pylist(rows, VECTORS), f"{folder}/embeddings.parquet")
    return str(folder)


def hard_vectors() -> list[dict]:
    """Nulls, other lengths, numbers that aren't finite, a vector repeated often, ties on a grid, repeated ids, few and far values."""
    r = random.Random(5)
    rows = [{"vec_id": i, "embedding": [r.choice((-0.25, 0.0, 0.25)) if k < 3 else 0.0 for k in range(64)], "label": i % 3 or None} for i in range(120)]
    rows += [{"vec_id": 1000 + i, "embedding": [0.5] * 64, "label": 1} for i in range(60)]
    rows += [{"vec_id": 2000 + i, "embedding": [r.gauss(0, 3) for _ in range(64)], "label": 7} for i in range(40)]
    rows += [{"vec_id": 5, "embedding": [9.0] * 64, "label": 2}, {"vec_id": 5, "embedding": [-9.0] * 64, "label": 2}, {"vec_id": None, "embedding": [1000.0] * 64}, {"vec_id": None, "embedding": [0.0] * 64, "label": None}]
    rows += [{"vec_id": 3000, "embedding": None}, {"vec_id": 3001, "embedding": []}, {"vec_id": 3002, "embedding": [1.0] * 63}, {"vec_id": 3003, "embedding": [1.0] * 65}, {"vec_id": 3004, "embedding": [None] + [1.0] * 63}, {"vec_id": 3005, "embedding": [math.nan] + [1.0] * 63}, {"vec_id": 3006, "embedding": [1.0] * 63 + [-math.inf]}]
    return [{**x, "cluster": "clash", "code": "clash", "_cluster": 3} for x in rows]


@pytest.fixture(scope="module", params=["generated", "hard", "few", "empty"])
def folder(request, sf, tmp_path_factory):
    if request.param == "generated":
        return sf
    rows = {"hard": hard_vectors(), "few": hard_vectors()[118:123], "empty": []}[request.param]
    return vectors(tmp_path_factory.mktemp(request.param), rows)


@pytest.fixture(scope="module")
def con(folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    return con


def test_op11_against_brute_force_and_sql(spark, folder, con):
    rows = [(r["vec_id"], r["embedding"]) for r in read(folder, "embeddings")]
    got = sorted((tuple(r) for r in centroids.op11(spark, folder).collect()), key=key)
    assert got == sorted(centroids.brute_force(rows), key=key)
    assert differs(centroids.op11(spark, folder), con, centroids.SQL) is None


def test_op12_against_brute_force_and_sql(spark, folder, con):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in read(folder, "embeddings")]
    got = sorted((tuple(r) for r in vector_codes.op12(spark, folder).collect()), key=key)
    assert got == sorted(vector_codes.brute_force(rows), key=key)
    assert differs(vector_codes.op12(spark, folder), con, vector_codes.SQL) is None


def test_exponion_scans_few_centroids_and_keeps_ties():
    r = np.random.default_rng(3)
    c = r.integers(-500, 500, (60, 8))
    c[17], c[40] = c[3], c[3]  # equal centroids: the lowest number must win
    x = np.concatenate([c[r.integers(0, 60, 4000)] + r.integers(-20, 20, (4000, 8)), (c[5:6] + c[9:10]) // 2, c[3:4]])
    brute = np.array([np.argmin(((c - v) ** 2).sum(1)) for v in x])
    cluster, upper, lower = np.full(len(x), -1, np.int32), np.full(len(x), np.inf), np.zeros(len(x))
    net = centroids.Net(c)
    net.nearest(x, cluster, upper, lower)
    assert (cluster == brute).all()
    for step in range(4):  # bounds carried over moves of the centroids
        later = c + r.integers(-3, 4, c.shape)
        went, other = net.moved(later)
        upper, lower = (upper + went[cluster]) * centroids.UP, np.maximum(lower - other[cluster], 0.0) * centroids.DOWN
        c, net = later, centroids.Net(later)
        seen = net.nearest(x, cluster, upper, lower)
        assert (cluster == np.array([np.argmin(((c - v) ** 2).sum(1)) for v in x])).all()
        assert seen < len(x) * 60 / 4


def test_kd_tree_prunes_and_keeps_the_lowest_index():
    r = np.random.default_rng(4)
    for entries in (r.integers(-3, 4, (64, 4)), r.integers(-200, 200, (64, 4)), np.zeros((64, 4), np.int64), r.integers(0, 2, (1, 4)), np.repeat(r.integers(-9, 9, (8, 4)), 8, axis=0)):
        x = r.integers(-250, 250, (3000, 4)) // r.choice([1, 40], (3000, 1))
        index, d, seen = vector_codes.KdTree(entries).nearest(x)
        far = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (index == far.argmin(1)).all() and (d == far.min(1)).all()
    x = r.integers(-200, 200, (3000, 4))
    assert vector_codes.KdTree(r.integers(-200, 200, (64, 4))).nearest(x)[2] < 3000 * 64 * 0.7


def test_op11_op12_reject_values_that_have_no_exact_result(spark, tmp_path):
    folder = vectors(tmp_path, [{"vec_id": 1, "embedding": [1e30] * 64}])
    for run in (centroids.op11, vector_codes.op12):
        with pytest.raises(Exception, match="2\\*\\*27"):
            run(spark, folder).collect()


def test_operators_keep_other_columns(spark, tmp_path):
    df = spark.read.parquet(vectors(tmp_path, hard_vectors()) + "/embeddings.parquet").filter("size(embedding) = 64 and vec_id < 2000")
    df = df.withColumn("v", centroids.whole(F.col("embedding"), 64))
    seeds = centroids.seeds_of(df, "vec_id", "v", 4)
    got, _ = centroids.cluster(df, "v", seeds)
    assert got.columns == ["vec_id", "embedding", "label", "code", "_cluster", "v", "cluster", "distance"]
    assert {(r["_cluster"], r["code"]) for r in got.collect()} == {(3, "clash")}
    books = vector_codes.train(df, "v", vector_codes.seeds_of(df, "vec_id", "v", 8, 16))
    row = vector_codes.encode(df, "v", books).filter("vec_id = 1000").first()
    assert row["cluster"] == "clash" and sum((a - b) ** 2 for a, b in zip(row["v"], vector_codes.decoded(row["code"], books))) == row["error"]


def line_rows() -> list[tuple]:
    hot = "a line that a third of all documents hold"
    rows = [(i, f"{hot}\nown line of document {i}\n" + ("short\nshort" if i % 2 else "\t Another LINE they share\x0b")) for i in range(0, 300)]
    rows += [(None, "held by nobody with an id\nx"), (None, "held by nobody with an id"), (None, f"  {hot.upper()}  "), (7000, "another line they share\n\x0b other\n"), (7001, "Étude no. 12345\n\n"), (7002, "étude no. 12345"), (7003, "ÉTUDE no. 12345\n"), (7003, "ÉTUDE no. 12345\n"), (7003, "ÉTUDE no. 12345\nand this"), (7004, None), (7005, ""), (7006, "étude no. 12345 \nétude no. 12345"), (7007, "\n" * 50), (7008, ("word " * 10_000 + "\n") * 3), (7009, "word " * 10_000), (7010, "nine char"), (7011, "nine char"), (7012, "ten chars!"), (7013, "ten chars!"), (7014, "éééééééééé"), (7015, "éééééééééé"), (7016, "\x1cten chars!")]
    return rows


@pytest.mark.parametrize("options", [{}, {"direct_keys": 0}, {"direct_keys": 0, "shard_keys": 7}, {"shard_keys": 7}, {"least_docs": 5}])
def test_op13_both_routes(spark, options):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_a", F.lit(1)).withColumn("n_lines", F.lit("x"))
    got = line_index.drop_lines(df, **options)
    assert got.columns == ["doc_id", "text", "_a", "n_lines", "n_dropped", "kept_text"]
    got = [tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()]
    assert sorted(got, key=key) == sorted(line_index.brute_force(rows, least_docs=options.get("least_docs", 2)), key=key)


@pytest.mark.parametrize("kind", ["generated", "hard", "empty"])
def test_op13_against_brute_force_and_sql(spark, sf, tmp_path, kind):
    import duckdb

    folder = sf if kind == "generated" else tables(tmp_path, empty=kind == "empty")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    rows = [(d["doc_id"], d["text"]) for d in read(folder, "documents")]
    assert sorted((tuple(r) for r in line_index.op13(spark, folder).collect()), key=key) == sorted(line_index.brute_force(rows), key=key)
    assert differs(line_index.op13(spark, folder), con, line_index.SQL) is None


def test_perfect_hash_is_minimal_and_perfect():
    r = np.random.default_rng(6)
    for n in (0, 1, 2, 63, 5000):
        h, f = (r.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
        h[: n // 2] = 7  # equal in one half of the pair
        found = line_index.PerfectHash.of(h, f)
        assert sorted(found.number(h, f).tolist()) == list(range(n))
        assert n < 5000 or len(found.words) * 64 < 4.5 * n
