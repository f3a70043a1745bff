"""Centroid clustering by exponion search (operator 11).

Every vector carries the number of its centroid, an upper bound of the distance
to it and a lower bound of the distance to any other. A round moves the bounds
by how far the centroids went. A vector whose upper bound stays below its lower
bound, or below half the gap from its centroid to the next one, keeps its
centroid unseen. All others scan only centroids inside a ball around their own
centroid, of radius twice the upper bound plus that gap, which is a prefix of
the centroid's list of other centroids sorted by distance. The nearest and the
second nearest centroid lie in the ball. The ball is inclusive and bounds are
rounded outwards, so equally near centroids are all seen and the smallest number
wins.

A round is one narrow pass over a written table of vectors and bounds, without a
shuffle, and one sum for each centroid and component with partial sums in the
tasks. The driver holds the centroids: their number times the components.

Distances, sums and means are integers. Components must lie below 2**27 in
absolute value, so that squared distances fit into 64 bits; a larger one is an
error, as its result could not be stated.

Defined results: vectors that are null, of another length, or with null or
non-finite components are not kept. Rows without id are clustered and seed only
where rows with id are too few. Repeated rows count one by one; repeated ids seed
in the order of their vectors. Fewer vectors than centroids give fewer
centroids, so that an empty table gives an empty result. Extra columns pass
through ``cluster``; columns named as results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ballast.llm.common import discard, unused, written

DIMS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = 1

#: Outward rounding of bounds; far above the error of a square root and a sum.
UP, DOWN = 1 + 1e-12, 1 - 1e-12


def usable(vector: Column, dims: int | None = None) -> Column:
    """Whether all components are numbers, and as many as ``dims``."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine if dims is None else vector.isNotNull() & (F.size(vector) == dims) & fine, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """Components times ``scale``, rounded down; from 2**27 on they are an error."""
    up = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    large = F.raise_error(F.lit(f"a component times {scale} is 2**27 or more"))
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) * F.lit(float(scale)) < float(1 << 27), up(x)).otherwise(large.cast("long")).cast("int"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


class Net:
    """Centroids and, for each, the others sorted by their distance from it."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        between = np.sqrt(np.array([squared(centroids, c[None]) for c in centroids], float)).reshape(k, k)
        others = between.copy()
        np.fill_diagonal(others, np.inf)
        self.near = np.argsort(others, axis=1, kind="stable")[:, : k - 1]
        self.far = np.take_along_axis(others, self.near, axis=1)
        self.gap = self.far[:, 0] if k > 1 else np.full(k, np.inf)

    def nearest(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings centroid numbers and bounds up to date, in place; gives the number of distances it took.

        Rows with a negative number have no bounds yet and scan all centroids.
        """
        fresh = cluster < 0
        cluster[fresh], upper[fresh], lower[fresh] = 0, np.inf, 0.0
        safe = lambda rows: upper[rows] < np.maximum(lower[rows], self.gap[cluster[rows]] / 2 * DOWN)
        rows = np.arange(len(x))
        rows = rows[~safe(rows)]
        best = squared(x[rows], self.centroids[cluster[rows]])
        upper[rows] = np.sqrt(best.astype(float)) * UP
        seen = len(rows)
        radius = np.where(fresh[rows], np.inf, (2 * upper[rows] + self.gap[cluster[rows]]) * UP)
        open_ = ~safe(rows) | fresh[rows]
        rows, best, radius, own = rows[open_], best[open_], radius[open_], cluster[rows[open_]]
        for c in np.unique(own):
            at = np.flatnonzero(own == c)
            reach = np.searchsorted(self.far[c], radius[at], side="right")
            order = np.argsort(-reach, kind="stable")
            at, reach = at[order], reach[order]
            first, second, number = best[at].astype(float), np.full(len(at), np.inf), np.full(len(at), c)
            exact = best[at]
            for t in range(int(reach[0]) if len(reach) else 0):
                live = int(np.searchsorted(-reach, -t, side="left"))  # rows whose ball holds the t-th other centroid
                j = int(self.near[c, t])
                d = squared(x[rows[at[:live]]], self.centroids[j][None])
                seen += live
                better = (d < exact[:live]) | ((d == exact[:live]) & (j < number[:live]))
                second[:live] = np.where(better, first[:live], np.minimum(second[:live], d))
                exact[:live] = np.where(better, d, exact[:live])
                number[:live] = np.where(better, j, number[:live])
                first[:live] = exact[:live]
            cluster[rows[at]] = number
            upper[rows[at]] = np.sqrt(first) * UP
            lower[rows[at]] = np.sqrt(second) * DOWN
        return seen

    def moved(self, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far each centroid went, and the furthest that any other one went."""
        went = np.sqrt(squared(later, self.centroids).astype(float)) * UP
        order = np.argsort(-went, kind="stable")
        other = np.full(len(went), went[order[0]] if len(went) else 0.0)
        if len(went):
            other[order[0]] = went[order[1]] if len(went) > 1 else 0.0
        return went, other


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, dims)


def _step(df: DataFrame, vector: str, names: tuple[str, str, str], net: Net, went: np.ndarray | None, other: np.ndarray | None) -> DataFrame:
    """One assignment of all rows, their bounds brought forward by the last move of the centroids."""
    number, high, low = names
    dims = net.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            x = _matrix(columns[vector], dims)
            cluster, upper, lower = (np.array(columns[n]) for n in names)
            if went is not None:
                upper, lower = (upper + went[cluster]) * UP, np.maximum(lower - other[cluster], 0.0) * DOWN
            net.nearest(x, cluster, upper, lower)
            columns |= {number: pa.array(cluster, pa.int32()), high: pa.array(upper), low: pa.array(lower)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=b.schema)

    return df.mapInArrow(run, df.schema)


def _means(state: DataFrame, vector: str, number: str, centroids: np.ndarray) -> np.ndarray:
    """The floor of each centroid's mean; one without vectors stays. At most a row for each centroid comes to the driver."""
    k, dims = centroids.shape
    sums = state.groupBy(number).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col(vector)[i].cast("long")) for i in range(dims)]).alias("sums"))
    later = centroids.copy()
    for j, n, s in sums.collect():
        later[j] = [total // n for total in s]
    return later


def cluster(df: DataFrame, vector: str, seeds: np.ndarray, rounds: int = ROUNDS, into: str = "cluster") -> tuple[DataFrame, np.ndarray]:
    """(``df`` with the nearest centroid ``into`` and its squared ``distance``, the final centroids).

    ``vector`` holds whole components, as many as each row of ``seeds``. All
    columns of ``df`` are written anew in each round, so leave out what isn't needed.
    """
    df = df.drop(into, "distance")
    names = unused([*df.columns, into, "distance"], "_cluster", "_upper", "_lower")
    centroids = np.asarray(seeds, np.int64)
    state = df.withColumns({names[0]: F.lit(-1), names[1]: F.lit(float("inf")), names[2]: F.lit(0.0)})
    went = other = None
    last = None
    for _ in range(rounds):
        net = Net(centroids)
        state = written(_step(state, vector, names, net, went, other), "vectors")
        if last is not None:
            discard(last)
        last = state
        centroids = _means(state, vector, names[0], centroids)
        went, other = net.moved(centroids)
    found = _step(state, vector, names, Net(centroids), went, other)
    dims = centroids.shape[1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            number = columns.pop(names[0])
            del columns[names[1]], columns[names[2]]
            d = squared(_matrix(columns[vector], dims), centroids[np.asarray(number)])
            columns |= {into: number, "distance": pa.array(d, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = StructType([*df.schema.fields, StructField(into, IntegerType()), StructField("distance", LongType())])
    return found.mapInArrow(measure, schema), centroids


def seeds_of(vectors: DataFrame, id_col: str, vector: str, k: int, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors of the smallest hash of seed and id: a top-k, merged from each task's top-k."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    rows = vectors.select(key.alias("_key"), F.col(vector).alias("_vector")).orderBy(F.col("_key").asc_nulls_last(), "_vector").limit(k).collect()
    return np.array([r["_vector"] for r in rows], np.int64)


def op11(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = table.filter(usable(F.col("embedding"), DIMS)).select("vec_id", whole(F.col("embedding"), SCALE).alias("vector"))
    seeds = seeds_of(vectors, "vec_id", "vector", CENTROIDS)
    columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(seeds):
        return spark.createDataFrame([], columns)
    found, centroids = cluster(vectors, "vector", seeds)
    found = written(found.drop("vector"), "clusters")
    sums = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # at most a row for each centroid
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(j, s, sum(sums.values()), digest(centroids[j])) for j, s in sums.items()]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assigned(rows: str, centroids: str) -> str:
    return f"""SELECT r.*, list_min(list_transform(range(len(c)), lambda j: list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (v[i] - c[j + 1][i]) * (v[i] - c[j + 1][i])))::BIGINT * {CENTROIDS} + j)) AS m FROM {rows} r, {centroids}"""


def _updated(assigned: str, centroids: str) -> str:
    return f"""SELECT list(coalesce(u, old) ORDER BY j) AS c FROM (SELECT unnest(range(len(c))) AS j, unnest(c) AS old FROM {centroids})
  LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS u FROM (
    SELECT m % {CENTROIDS} AS j, i, sum(v[i]) AS s, count(*) AS n FROM {assigned}, range(1, {DIMS + 1}) x(i) GROUP BY ALL) GROUP BY j) USING (j)"""


SQL = f"""WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {DIMS}),
c0 AS (SELECT list(v ORDER BY k NULLS LAST, v) AS c FROM (SELECT sha256('{SEED}:' || vec_id) AS k, v FROM v ORDER BY k NULLS LAST, v LIMIT {CENTROIDS})),
{"".join(f"a{r} AS MATERIALIZED ({_assigned('v', f'c{r}')}), c{r + 1} AS MATERIALIZED ({_updated(f'a{r}', f'c{r}')}),{chr(10)}" for r in range(ROUNDS))}
z AS MATERIALIZED ({_assigned("v", f"c{ROUNDS}")})
SELECT vec_id, (m % {CENTROIDS})::INTEGER AS cluster, m // {CENTROIDS} AS distance, (sum(m // {CENTROIDS}) OVER (PARTITION BY m % {CENTROIDS}))::BIGINT AS cluster_inertia,
       (sum(m // {CENTROIDS}) OVER ())::BIGINT AS inertia, sha256(array_to_string(c[m % {CENTROIDS} + 1], ',')) AS centroid_sha256
FROM z, c{ROUNDS}"""


def brute_force(rows: list[tuple[int | None, list | None]], k: int = CENTROIDS, rounds: int = ROUNDS) -> list[tuple]:
    """The same result for a few vectors, in plain whole numbers, every centroid looked at (for tests)."""
    import math

    kept = [(i, [math.floor(SCALE * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == DIMS and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, sha(f"{SEED}:{r[0]}"), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(kept, of) if o == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    return [(i, j, d, sum(e for _, e, o in found if o == j), sum(e for _, e, _ in found), sha(",".join(map(str, c[j])))) for i, d, j in found]
