"""The pipeline's stages, end to end, against the decisions of plain versions."""

import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from ballast.llm import mixing, neardup, quality
from tests.llm.helpers import read, tables


@pytest.fixture(scope="module", params=["generated", "hard", "empty"])
def folder(request, sf, tmp_path_factory):
    return sf if request.param == "generated" else tables(tmp_path_factory.mktemp(request.param), empty=request.param == "empty")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def expected(folder: str) -> set:
    """(doc_id, text) after quality rules (their SQL), near-dedup and decontamination (brute force)."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    got = con.execute(f"SELECT doc_id, kept FROM ({quality.SQL})").fetchall()
    good = {i for i, kept in got if kept}
    rows = [(d["doc_id"], d["text"]) for d in read(folder, "documents") if d["doc_id"] in good]
    first = {}
    for (i, t), (_, n, c) in zip(rows, neardup.brute_force(rows, 5)):
        if i == c:
            first[i, t] = 1
    rows = list(first)
    windows = set()
    for b in read(folder, "benchmark"):
        w = words(b["text"])
        if b["item_id"] is not None:
            windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(x) for x in windows}
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return {(i, t) for i, t in rows if clean(words(t))}


def mixed(folder: str, rows: set) -> Counter:
    """How often mixing's own SQL passes each of these documents."""
    documents = pa.Table.from_pylist([d for d in read(folder, "documents") if (d["doc_id"], d["text"]) in rows], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())]))
    con = duckdb.connect()
    con.register("given", documents)
    con.execute("CREATE VIEW documents AS SELECT DISTINCT * FROM given")  # near-dedup has kept one row of each
    passes = con.execute(f"SELECT doc_id, source, count(*) FROM ({mixing.SQL}) GROUP BY ALL").fetchall()
    text = {(d["doc_id"], d["source"]): d["text"] for d in documents.to_pylist()}
    return Counter({(i, text[i, s], s): n for i, s, n in passes})


def test_run_against_plain_stages(spark, folder):
    want = expected(folder)
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == want  # mixing and sharding drop nothing
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == mixed(folder, want)
    if got and "extra" in got[0]:  # columns named as results of the stages keep their own values
        assert all(r["kept"] == "clash" and r["n_words"] == 7 for r in got)
    shards, slots = {}, {}
    for r in got:
        shards.setdefault(r["text"] or "", set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
