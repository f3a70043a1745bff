"""Permutations and shards, samplers' sizes, the running analyser, annotation files, signatures and nested columns."""

from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ballast.functions.nested import depth, flat_rows, flat_vector
from ballast.functions.permutation import grid, permuted
from ballast.operators import annotations, sampling, signatures
from ballast.plans import batches as plans
from ballast.plans import registry
from ballast.sources.annotation_files import annotation_rows
from ballast.sources.annotation_files import annotations as usable
from ballast.streaming import analyser
from tests.oracle import differs


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutation(spark, n):
    a, b = grid(n)
    assert n <= a * b < n + a
    seen = [tuple(r[0] for r in spark.range(n).select(permuted(F.col("id"), n, seed, epoch)).orderBy(F.monotonically_increasing_id()).collect()) for seed, epoch in ((1, 0), (1, 0), (1, 1), (2, 0))]
    assert all(sorted(s) == list(range(n)) for s in seen)
    assert seen[0] == seen[1] and (n < 64 or len(set(seen)) == 3)


@pytest.mark.parametrize("n, world", [(10, 3), (9, 3), (2, 5), (1, 1), (100, 7)])
def test_uniform_shards_have_equal_sizes(spark, n, world):
    for shuffle in (True, False):
        padded = sampling.shuffled_shards(spark.range(n), "id", n, world, shuffle=shuffle).collect()
        each = -(-n // world)
        assert Counter(r["rank"] for r in padded) == {k: each for k in range(world)}
        assert set(Counter(r["id"] for r in padded).values()) <= {each * world // n, -(-each * world // n)}
        assert sorted((r["rank"], r["position"]) for r in padded) == [(k, p) for k in range(world) for p in range(each)]
        cut = sampling.shuffled_shards(spark.range(n), "id", n, world, drop_last=True, shuffle=shuffle).collect()
        assert Counter(r["rank"] for r in cut) == {k: n // world for k in range(world) if n // world}
        assert len({r["id"] for r in cut}) == len(cut)
    assert [r["id"] for r in sorted(padded, key=lambda r: (r["position"], r["rank"]))] == [i % n for i in range(each * world)]


def test_sampler_sizes(spark):
    assert sampling.shard_sizes(10, 3) == (3, 9) and sampling.shard_sizes(10, 3, drop_last=False) == (4, 12)
    assert sampling.shard_sizes(10, 3, replacement=False, drop_last=False) == (4, 10) and sampling.shard_sizes(10, 3, 8, replacement=False) == (3, 9)
    assert sampling.shard_sizes(10, 3, 2, replacement=False) == (2, 6) and sampling.shard_sizes(10, 3, 50) == (50, 150)
    df = spark.range(40).select("id", F.when(F.col("id") % 4 == 0, 0.0).otherwise(F.col("id") + 1.0).alias("w"))
    epochs = [sampling.distributed_draws(df, "id", "w", 4, e, replacement=False).collect() for e in (0, 0, 1)]
    for rows in epochs:
        assert len({r["id"] for r in rows}) == len(rows) == 30 and all(r["id"] % 4 for r in rows)  # rows of weight 0 are never drawn
    order = [[r["id"] for r in sorted(rows, key=lambda r: r["draw"])] for rows in epochs]
    assert order[0] == order[1] != order[2]
    drawn = sampling.distributed_draws(df, "id", "w", 4, 2, num_samples=25).collect()
    assert Counter(r["rank"] for r in drawn) == dict.fromkeys(range(4), 25) and all(r["id"] % 4 for r in drawn)


class _State:
    def __init__(self):
        self.get, self.exists = None, False

    def update(self, value):
        self.get, self.exists = value, True


def test_analyser_state():
    """Order within a micro-batch is that of the positions; a null weight is no first weight."""
    state, frame = _State(), lambda rows: iter([pd.DataFrame(rows, columns=["sample", "batch_id", "position", "weight"])])
    (first,) = analyser._update(("a",), frame([("a", 3, 30, None), ("a", 2, 29, None), ("a", 3, 31, None)]), state)
    assert first[["batch_id", "n", "fresh", "total", "first_batch"]].values.tolist() == [[2, 1, True, 1, 2], [3, 2, False, 3, 2]]
    (second,) = analyser._update(("a",), frame([("a", 1, 99, 7.0), ("a", 9, 98, 5.0)]), state)
    assert second[["batch_id", "fresh", "total", "first_batch", "first_weight"]].values.tolist() == [[1, False, 4, 2, 7.0], [9, False, 5, 2, 7.0]]


def test_analyser_state_from_parts():
    """A sample's rows come in parts of any order; the weight at the least position counts."""
    parts = [pd.DataFrame(rows, columns=["sample", "batch_id", "position", "weight"]) for rows in ([("a", 1, 70, 7.0), ("a", 0, 9, None)], [("a", 1, 65, 5.0), ("a", 2, 130, 3.0)])]
    (out,) = analyser._update(("a",), iter(parts), _State())
    assert out[["batch_id", "n", "fresh", "total", "first_batch"]].values.tolist() == [[0, 1, True, 1, 0], [1, 2, False, 3, 0], [2, 1, False, 4, 0]]
    assert out["first_weight"].tolist()[1:] == [5.0, 5.0] and pd.isna(out["first_weight"][0])


@pytest.mark.parametrize("name", ["stream_sample_states", "stream_coverage"])
def test_stream_pieces(spark, tmp_path, monkeypatch, name):
    """Pieces have a limited size, and a repeated event counts as often as it comes."""
    rows = spark.range(0, 640, 1, 4).select(F.col("id").alias("event_id"), (F.col("id") % 11).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") % 13).cast("double").alias("value"))
    rows.unionAll(rows.filter("event_id % 5 = 0")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    monkeypatch.setattr(plans, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(plans, "PIECE_ROWS", 80, raising=False)
    assert differs(registry.queries()[name](spark, str(tmp_path)), con, registry.oracle_sql()[name]) is None
    offsets = [p for p in (tmp_path / "analyser" / "state" / "offsets").iterdir() if p.name.isdigit()]
    assert len(offsets) == 10  # micro-batches: 768 rows in 10 batches


@pytest.mark.parametrize("name", ["stream_sample_states", "stream_coverage"])
def test_stream_pieces_of_uneven_ids(spark, tmp_path, monkeypatch, name):
    """No piece grows with wide gaps between ids, or with one id that comes again and again; rows without id belong to no batch of the stream."""
    rows = spark.range(0, 600, 1, 4).select(F.when(F.col("id") < 300, F.col("id")).when(F.col("id") < 590, 310).otherwise(F.col("id") * 10**9).alias("event_id"), F.when(F.col("id") % 31 != 0, F.col("id") % 59).alias("user_id"))
    rows.select("event_id", "user_id", F.lit("view").alias("event_type"), (F.col("event_id") % 13).cast("double").alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    monkeypatch.setattr(plans, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(plans, "PIECE_ROWS", 60)
    assert differs(registry.queries()[name](spark, str(tmp_path)), con, registry.oracle_sql()[name]) is None
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/analyser/pieces").groupBy("piece").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 90


def test_coverage_of_split_batches(spark, monkeypatch):
    """A batch may come in several micro-batches, and more updates are dealt to more tasks."""
    monkeypatch.setattr(analyser, "TASK_ROWS", 50, raising=False)
    rows = [(f"s{i}", b, 2, part == 0 and b == 0, 0, 0, None) for b in range(10) for part in range(2) for i in range(20)]
    found = analyser.coverage(spark.createDataFrame(rows, analyser.UPDATES))
    assert sorted(tuple(r) for r in found.collect()) == [(b, 80, 20, 20 if b == 0 else 0) for b in range(10)]
    assert "hashpartitioning(batch_id" in (plan := found._jdf.queryExecution().toString()) and ", 8), REPARTITION_BY_NUM" in plan


def test_annotation_files(spark, tmp_path):
    head = "participant_id,file_id,annotation_id,frame_start,frame_end,activity,chunk_id\n"
    (tmp_path / "a.csv").write_text(head + 'p,f,1,0,9,"eat, ""fast""\nslowly",3\np,f,2,0\n\np,f,3,-4,+5,"",\np,f,4,1.5,9,x\np,f,5, 1 ,nine,x,0,more\np,f,6,1,,x\np,,7,1,2,x\n')
    (tmp_path / "b.csv").write_text(head + "q,g,8,1,2,y,2\n")
    rows = {r["annotation_id"]: r for r in annotation_rows(spark, str(tmp_path)).collect()}
    assert {k: (r["n_fields"], r["problem"]) for k, r in rows.items()} == {"1": (7, None), "2": (4, "fields"), "3": (7, None), "4": (6, "frame_start"), "5": (8, "frame_end"), "6": (6, "frame_end"), "7": (6, None), "8": (7, None)}
    assert rows["1"]["activity"] == 'eat, "fast"\nslowly' and (rows["3"]["frame_start"], rows["3"]["frame_end"], rows["3"]["activity"], rows["3"]["chunk_id"]) == (-4, 5, "", "0")
    assert rows["7"]["file_id"] == "" and rows["2"]["chunk_id"] is None
    assert sorted(r["annotation_id"] for r in usable(spark, str(tmp_path), strict=False).collect()) == ["1", "3", "7", "8"]
    with pytest.raises(Exception, match="not a whole number"):
        usable(spark, str(tmp_path)).collect()


def test_signatures_of_files(spark, tmp_path):
    contents = {"ok.png": b"\x89PNG\r\n\x1a\nrest", "ok.JPEG": b"\xff\xd8\xff\xe0", "ok.gif": b"GIF89a..", "old.gif": b"GIF87a", "bad.gif": b"GIF88a", "bad.png": b"\xff\xd8\xff\xe0", "short.png": b"\x89PN", "any.txt": b"x"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r["corrupt"] for r in signatures.with_signature(files, "path", "content").select("path", "corrupt").collect()}
    assert got == {name: name.startswith(("bad", "short")) for name in contents}
    bare = spark.createDataFrame([("a.bmp", b""), ("b.bmp", None), ("c.bmp", b"BM1")], "path string, content binary")  # the file reader leaves out empty files
    assert [r["corrupt"] for r in signatures.with_signature(bare, "path", "content").orderBy("path").collect()] == [True, False, False]


def test_nested_columns(spark):
    df = spark.createDataFrame([(1, [[["a", None], []], [["b"]]]), (2, []), (3, None), (4, [[]])], "i int, v array<array<array<string>>>")
    assert depth(df.schema["v"].dataType) == 3
    assert {(r["i"], r["v"], tuple(r["place"])) for r in flat_rows(df, "v").collect()} == {(1, "a", (0, 0, 0)), (1, None, (0, 0, 1)), (1, "b", (1, 0, 0))}
    assert {r["i"]: r["f"] for r in df.select("i", flat_vector(df, "v").alias("f")).collect()} == {1: ["a", None, "b"], 2: [], 3: None, 4: []}
    flat = spark.createDataFrame([(1, "x")], "i int, v string")
    assert flat_rows(flat, "v").first()["place"] == [] and flat.select(flat_vector(flat, "v")).first()[0] == ["x"]


def test_prefixed_paths(spark):
    paths = ["a/b.png", "/abs//x", "data/set", "data/set/../set/k", "data/settle/k", "./data/set/k", "../up"]
    got = {r["p"]: r["q"] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", annotations.prefixed_path(F.col("p"), "./data/set").alias("q")).collect()}
    assert got == {"a/b.png": "data/set/a/b.png", "/abs//x": "/abs/x", "data/set": "data/set", "data/set/../set/k": "data/set/k", "data/settle/k": "data/set/data/settle/k", "./data/set/k": "data/set/k", "../up": "data/up"}
