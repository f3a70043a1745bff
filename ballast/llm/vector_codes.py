"""Vector code compression: product codes found by kd-trees (operator 12).

Vectors are cut into equal consecutive parts, and each part position has a
codebook of entries. In every round each codebook becomes a kd-tree that is
broadcast: its inner nodes halve the entries at the median of their widest
component, and every node has the bounding box of its entries. The search for a
part's nearest entry goes to the nearer child first and leaves out a node only if
its box is further away than the best entry so far. A node at an equal distance
is visited, so that of equally near entries the lowest index wins. All parts of
a batch search side by side.

Tasks add up the components of each entry's parts as whole numbers, one row for
each entry and task, and Spark sums these. The driver holds the codebooks alone:
parts times entries times components, 64 KB here.

Defined results: vectors that are null or hold null or non-finite components are
dropped, and so are those of another length than ``dims``, as they have no such
parts. Components times the scale must lie below 2**27; a larger one is an error.
Rows without id are coded and seed only where rows with id are too few. Repeated
rows count one by one; repeated ids seed in the order of their vectors. Fewer
vectors than entries give fewer entries, so that an empty table gives an empty
result. Extra columns pass through ``encode``; columns named as results are
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ballast.llm.centroids import usable, whole
from ballast.llm.common import written

DIMS = 64
SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
LEAF = 6


class KdTree:
    """Entries of one codebook; ``nearest`` gives the lowest index among the nearest entries."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries = entries
        self.nodes: list[tuple] = []  # (low corner, high corner, entry indices or None, component, cut, left, right)
        self._build(np.arange(len(entries)), leaf)

    def _build(self, held: np.ndarray, leaf: int) -> int:
        at, points = len(self.nodes), self.entries[held]
        self.nodes.append(())
        low, high = points.min(axis=0), points.max(axis=0)
        wide = int(np.argmax(high - low)) if len(low) else 0
        if len(held) <= leaf or not len(low) or low[wide] == high[wide]:
            self.nodes[at] = (low, high, np.sort(held), 0, 0, -1, -1)
            return at
        cut = int(np.sort(points[:, wide])[(len(held) - 1) // 2])
        cut -= cut == high[wide]  # both sides get entries
        below = points[:, wide] <= cut
        left = self._build(held[below], leaf)
        right = self._build(held[~below], leaf)
        self.nodes[at] = (low, high, None, wide, cut, left, right)
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry index, squared distance) of all rows, and how many distances it took."""
        best, index, seen = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64), 0
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            low, high, held, wide, cut, left, right = self.nodes[node]
            out = np.maximum(np.maximum(low - x[rows], x[rows] - high), 0)
            rows = rows[np.einsum("ij,ij->i", out, out) <= best[rows]]  # an equal bound may hide a lower index
            if not len(rows):
                continue
            if held is None:
                near = x[rows, wide] <= cut
                # The last one pushed is visited first: each row's own side before the other.
                todo += [(left, rows[~near]), (right, rows[near]), (right, rows[~near]), (left, rows[near])]
                continue
            for j in held.tolist():
                gap = x[rows] - self.entries[j]
                d = np.einsum("ij,ij->i", gap, gap)
                seen += len(rows)
                better = (d < best[rows]) | ((d == best[rows]) & (j < index[rows]))
                best[rows[better]], index[rows[better]] = d[better], j
        return index, best, seen


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    """Rows by parts by components."""
    n = len(column)
    flat = np.asarray(column.flatten()).astype(np.int64)
    return flat.reshape(n, parts, len(flat) // max(n * parts, 1))


def _sums(df: DataFrame, vector: str, trees, parts: int, entries: int, width: int) -> DataFrame:
    """(part, entry, n, component sums): at most a row for each of them and task, then one each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = trees.value
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            x = _parts(b.column(0), parts)
            for p, tree in enumerate(found):
                index, _, _ = tree.nearest(x[:, p])
                count[p] += np.bincount(index, minlength=entries)
                np.add.at(total[p], index, x[:, p])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), *[pa.array(total[p, e, k]) for k in range(width)]], names=["part", "entry", "n", *[f"s{k}" for k in range(width)]])

    schema = "part int, entry int, n long" + "".join(f", s{k} long" for k in range(width))
    partial = df.select(vector).mapInArrow(run, schema)
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)])


def train(df: DataFrame, vector: str, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, components) after so many rounds; ``df`` is read once a round."""
    codebooks = np.array(codebooks, np.int64)
    parts, entries, width = codebooks.shape
    for _ in range(rounds):
        trees = df.sparkSession.sparkContext.broadcast([KdTree(c) for c in codebooks])
        for row in _sums(df, vector, trees, parts, entries, width).collect():  # at most parts times entries rows
            codebooks[row["part"], row["entry"]] = [row[f"s{k}"] // row["n"] for k in range(width)]
        trees.destroy()
    return codebooks


def encode(df: DataFrame, vector: str, codebooks: np.ndarray) -> DataFrame:
    """``df`` with ``code`` (two hexadecimal digits for each part) and ``error`` (squared distance, summed over parts)."""
    df = df.drop("code", "error")
    parts, entries, _ = codebooks.shape
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits for each part: 256 entries at most")
    trees = df.sparkSession.sparkContext.broadcast([KdTree(c) for c in codebooks])
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _parts(b.column(b.schema.get_field_index(vector)), parts)
            error, digits = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, parts), np.int64)
            for p, tree in enumerate(trees.value):
                digits[:, p], d, _ = tree.nearest(x[:, p])
                error += d
            code = pa.array(["".join(r) for r in hexes[digits].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, code, pa.array(error)], names=[*b.schema.names, "code", "error"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("code", StringType()), StructField("error", LongType())]))


def decoded(code: str, codebooks: np.ndarray) -> list[int]:
    """The vector that a code stands for."""
    return [int(x) for p, e in enumerate(bytes.fromhex(code)) for x in codebooks[p, e]]


def seeds_of(vectors: DataFrame, id_col: str, vector: str, entries: int, parts: int) -> np.ndarray:
    """Codebooks made of the parts of the vectors with the smallest ids: a top-k, merged from each task's top-k."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector).alias("_vector")).orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).collect()
    x = np.array([r["_vector"] for r in rows], np.int64)
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2) if len(x) else np.zeros((parts, 0, 0), np.int64)


def op12(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = table.filter(usable(F.col("embedding"), DIMS)).select("vec_id", "label", whole(F.col("embedding"), SCALE).alias("vector"))
    codebooks = seeds_of(vectors, "vec_id", "vector", ENTRIES, PARTS)
    if not codebooks.size:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codebooks = train(vectors, "vector", codebooks)
    coded = written(encode(vectors, "vector", codebooks).drop("vector"), "codes")
    # A row for each label, from partial sums. Spark broadcasts them if they are few and splits hot labels if they are many.
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


WIDTH = DIMS // PARTS


def _assigned(r: int) -> str:
    square = " + ".join(f"(x.c[{k}] - b.c[{k}]) * (x.c[{k}] - b.c[{k}])" for k in range(1, WIDTH + 1))
    return f"SELECT x.n, x.p, x.c, min(({square}) * {ENTRIES} + b.e) AS m FROM x JOIN b{r} b ON x.p = b.p GROUP BY ALL"


def _updated(r: int) -> str:
    sums = ", ".join(f"(s{k} - ((s{k} % n) + n) % n) // n" for k in range(1, WIDTH + 1))
    return f"""SELECT b.p, b.e, coalesce(u.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT p, e, [{sums}]::BIGINT[] AS c FROM (
    SELECT p, m % {ENTRIES} AS e, count(*) AS n, {", ".join(f"sum(c[{k}]) AS s{k}" for k in range(1, WIDTH + 1))} FROM a{r} GROUP BY ALL)) u ON b.p = u.p AND b.e = u.e"""


SQL = f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS n, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {DIMS}),
x AS MATERIALIZED (SELECT n, p, v[p * {WIDTH} + 1 : p * {WIDTH} + {WIDTH}] AS c FROM v, range({PARTS}) r(p)),
b0 AS MATERIALIZED (SELECT p, n AS e, c FROM x WHERE n < {ENTRIES}),
{"".join(f"a{r} AS MATERIALIZED ({_assigned(r)}), b{r + 1} AS MATERIALIZED ({_updated(r)}),{chr(10)}" for r in range(ROUNDS))}
z AS ({_assigned(ROUNDS)}),
w AS (SELECT n, string_agg(format('{{:02x}}', m % {ENTRIES}), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM z GROUP BY n)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM v JOIN w USING (n)"""


def brute_force(rows: list[tuple[int | None, list | None, int | None]], entries: int = ENTRIES, rounds: int = ROUNDS) -> list[tuple]:
    """The same result for a few vectors, in plain whole numbers, every entry looked at (for tests)."""
    import math

    kept = [(i, [math.floor(SCALE * float(x)) for x in v], y) for i, v, y in rows if v is not None and len(v) == DIMS and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda v: [v[k : k + WIDTH] for k in range(0, DIMS, WIDTH)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(PARTS)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            parts = [cut(v)[p] for _, v, _ in kept]
            of = [nearest(x, book)[1] for x in parts]
            for j in range(len(book)):
                own = [x for x, o in zip(parts, of) if o == j]
                if own:
                    book[j] = [sum(x) // len(own) for x in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [(i, y, [nearest(x, books[p]) for p, x in enumerate(cut(v))]) for i, v, y in kept]
    found = [(i, y, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for i, y, f in found]
    return [(i, c, e, sum(g for _, z, _, g in found if z == y), sha) for i, y, c, e in found]
