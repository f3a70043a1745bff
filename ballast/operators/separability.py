"""Separability of labelled embeddings: centroids, scatter, distances between classes, neighbours.

Sums over dimensions run as array aggregations inside a row; only class
centroids (a row for each class) are broadcast. Nearest neighbours search all rows, block by block; silhouette
works on a sample of at most ``most`` rows, which is part of its definition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.hashing import SEED, order_key

EPS = 1e-12
BLOCK = 4096
STEP = 256


def doubles(v: str | Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


def centroids(df: DataFrame, dims: int, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(label, n, centroid): one partial sum for each dimension, no row is exploded."""
    means = [F.avg(F.col(embedding)[i].cast("double")) for i in range(dims)]
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.array(*means).alias("centroid"))


def intra_scatter(df: DataFrame, centers: DataFrame, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """Mean squared and mean distance to the own centroid, for each class."""
    d2 = df.join(F.broadcast(centers), label).select(label, squared_distance(doubles(embedding), F.col("centroid")).alias("d2"))
    return d2.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg("d2").alias("msd"), F.avg(F.sqrt("d2")).alias("md"))


def center_pairs(centers: DataFrame) -> DataFrame:
    """Distances between the centroids of different classes (a row for each pair of classes)."""
    a = centers.select(F.col("label").alias("a"), F.col("centroid").alias("ca"))
    b = centers.select(F.col("label").alias("b"), F.col("centroid").alias("cb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.sqrt(squared_distance(F.col("ca"), F.col("cb"))).alias("distance"))


def davies_bouldin(scatter: DataFrame, pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    s = scatter.select("label", "md")
    r = both.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").withColumn("r", (F.col("sa") + F.col("sb")) / (F.col("distance") + F.lit(EPS)))
    return r.groupBy("a").agg(F.max("r").alias("worst")).agg(F.avg("worst").alias("dbi"))


def nearest_centroid(df: DataFrame, centers: DataFrame, index: str, embedding: str = "embedding") -> DataFrame:
    """Adds ``nearest``: the class with the closest centroid, the smallest on ties."""
    near = df.crossJoin(F.broadcast(centers.select(F.col("label").alias("_c"), "centroid")))  # class dimension only
    d = F.round(squared_distance(doubles(embedding), F.col("centroid")), 12)
    return near.groupBy(index).agg(F.min_by("_c", F.struct(d, F.col("_c"))).alias("nearest"))


def nearest_by_cosine(df: DataFrame, centers: DataFrame, index: str, embedding: str = "embedding") -> DataFrame:
    """As ``nearest_centroid``, by cosine distance."""
    ends = centers.select(F.col("label").alias("_c"), unit(F.col("centroid")).alias("_u"))
    near = df.withColumn("_v", unit(doubles(embedding))).crossJoin(F.broadcast(ends))  # class dimension only
    return near.groupBy(index).agg(F.min_by("_c", F.struct(F.round(1 - dot(F.col("_v"), F.col("_u")), 12), F.col("_c"))).alias("nearest"))


def pair_overlap(df: DataFrame, index: str, pairs: int = 30_000, label: str = "label", embedding: str = "embedding", seed: int = SEED) -> DataFrame:
    """Of hash-drawn pairs of different rows (ids from 0): the median distance between classes, and the share of pairs within a class that are further apart; null without either kind.

    The second row is drawn from all rows but the first, so every draw is a pair.

    The pairs are as many at any size; both joins are by the id.
    """
    n = df.count()
    draw = lambda side, of: F.conv(F.substring(order_key(F.lit(side), F.col("id"), seed=seed), 1, 13), 16, 10).cast("long") % max(of, 1)
    a, other = draw("a", n), draw("b", n - 1)
    drawn = df.sparkSession.range(pairs if n > 1 else 0).select(a.alias("a"), (other + (other >= a).cast("int")).alias("b"))
    v = df.select(F.col(index).alias("i"), F.col(label).alias("l"), F.col(embedding).alias("e"))
    both = drawn.join(v.toDF("a", "la", "ea"), "a").join(v.toDF("b", "lb", "eb"), "b").select(F.col("la") == F.col("lb"), F.round(F.sqrt(squared_distance(doubles("ea"), doubles("eb"))), 9)).toDF("same", "d")
    middle = both.filter("NOT same").agg(F.percentile("d", 0.5).alias("m"))
    return both.crossJoin(F.broadcast(middle)).agg(F.round(F.max("m"), 7).alias("median_inter"), F.round(F.avg(F.when(F.col("same"), (F.col("d") > F.col("m")).cast("double"))), 8).alias("overlap"))  # one row


def sampled(df: DataFrame, index: str, most: int, seed: int = SEED) -> DataFrame:
    """At most ``most`` rows in hash order: a top-n."""
    return df.orderBy(order_key(index, seed=seed), index).limit(most)


def _blocks(df: DataFrame, index: str, label: str, embedding: str, into: str) -> tuple[int, DataFrame]:
    """Number of blocks, and a row for each: (``into``, rows ordered by id); blocks of about ``BLOCK`` rows by a hash of the id."""
    n = max(1, -(-df.count() // BLOCK))
    item = F.struct(F.col(index).alias("id"), F.col(label).alias("label"), F.col(embedding).alias("v"))
    return n, df.groupBy(F.pmod(F.xxhash64(index), F.lit(n)).cast("int").alias(into)).agg(F.sort_array(F.collect_list(item)).alias("rows"))


def _columns(block: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray]:
    ids, labels, v = block["rows"].combine_chunks().flatten().flatten()
    return ids, labels, v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)


def _candidates(q: np.ndarray, o: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``o``, squared distance to 12 places) of all that can be among the ``k`` nearest, ties included."""
    qq, oo = (q * q).sum(1), (o * o).sum(1)
    about = qq[:, None] + oo[None, :] - 2.0 * (q @ o.T)
    far = np.partition(about, k - 1, axis=1)[:, k - 1] if len(o) > k else np.full(len(q), np.inf)
    slack = 2e-12 + 1e-12 * (qq.max() + oo.max())  # rounding to 12 places, and many times the product's error
    i, j = np.nonzero(about <= (far + slack)[:, None])
    d = np.zeros(len(i))
    for x in range(q.shape[1]):
        d += (q[i, x] - o[j, x]) ** 2
    return i, j, np.round(d, 12)


def _first(i: np.ndarray, k: int) -> np.ndarray:
    """Mask of the first ``k`` of each run of equal values."""
    at = np.arange(len(i))
    starts = np.maximum.accumulate(np.where(np.r_[True, i[1:] != i[:-1]], at, 0)) if len(i) else at
    return at - starts < k


def neighbours(queries: DataFrame, others: DataFrame, index: str, k: int, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(query id, label, vote): majority label of the ``k`` nearest of all others, for all queries.

    Every block of queries meets every block of others in a task of its own,
    which keeps the ``k`` nearest of each query; these are merged over the
    blocks. A task holds two blocks, and distances of ``STEP`` queries.
    """
    nq, q = _blocks(queries, index, label, embedding, "qb")
    no, o = _blocks(others, index, label, embedding, "ob")
    q = q.withColumn("ob", F.explode(F.sequence(F.lit(0), F.lit(no - 1))))
    o = o.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    kind = {c: queries.schema[c].dataType.simpleString() for c in (index, label)} | {f"o.{c}": others.schema[c].dataType.simpleString() for c in (index, label)}
    lists = {"i": "int", "d": "double", "o": kind[f"o.{index}"], "q": kind[index], "label": kind[label], "lo": kind[f"o.{label}"]}

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        steps = []
        if left.num_rows and right.num_rows:
            block = left["qb"][0].as_py()
            (q_ids, q_labels, q_at), (o_ids, o_labels, o_at) = _columns(left), _columns(right)
            for start in range(0, len(q_at), STEP):
                i, j, d = _candidates(q_at[start : start + STEP], o_at, k)
                by = np.lexsort((j, d, i))  # others stand in the order of their ids
                by = by[_first(i[by], k)]
                i, j = i[by] + start, j[by]
                values = [pa.array(i, pa.int32()), pa.array(d[by]), o_ids.take(pa.array(j)), q_ids.take(pa.array(i)), q_labels.take(pa.array(i)), o_labels.take(pa.array(j))]
                ends = pa.array([0, len(i)], pa.int32())
                steps.append(pa.table([pa.array([block], pa.int32()), pa.array([start], pa.int32()), *[pa.ListArray.from_arrays(ends, v) for v in values]], names=["qb", "start", *lists]))
        return pa.concat_tables(steps) if steps else pa.table({})

    def merged(steps: pa.Table) -> pa.Table:
        flat = pa.table({c: pa.concat_arrays([x.flatten() for x in steps[c].chunks]) for c in lists})
        flat = flat.sort_by([("i", "ascending"), ("d", "ascending"), ("o", "ascending")])
        return flat.filter(pa.array(_first(flat["i"].to_numpy(), k))).select(["q", "label", "lo"])

    near = q.groupBy("qb", "ob").cogroup(o.groupBy("qb", "ob")).applyInArrow(nearest, ", ".join(["qb int", "start int", *[f"{c} array<{t}>" for c, t in lists.items()]]))
    near = near.groupBy("qb", "start").applyInArrow(merged, f"q {lists['q']}, label {lists['label']}, lo {lists['lo']}")
    votes = near.groupBy("q", "label", "lo").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("q", "label").agg(F.min_by("lo", F.struct(-F.col("n"), F.col("lo"))).alias("vote"))


def silhouette(df: DataFrame, index: str, most: int = 5000, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """Mean silhouette over a sample of at most ``most`` rows; null where there are fewer than two classes, or a class of one row."""
    s = sampled(df, index, most).select(F.col(index).alias("i"), F.col(label).alias("li"), doubles(embedding).alias("ei"))
    o = s.select(F.col("i").alias("j"), F.col("li").alias("lj"), F.col("ei").alias("ej"))
    pairs = s.repartition(32, "i").crossJoin(F.broadcast(o)).filter("i <> j")  # at most ``most`` rows a side
    means = pairs.groupBy("i", "li", "lj").agg(F.avg(F.sqrt(squared_distance(F.col("ei"), F.col("ej")))).alias("m"))
    ab = means.groupBy("i").agg(F.max(F.when(F.col("li") == F.col("lj"), F.col("m"))).alias("a"), F.min(F.when(F.col("li") != F.col("lj"), F.col("m"))).alias("b"))
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least"))
    mean = ab.agg(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("mean")).crossJoin(F.broadcast(classes))  # one row each
    return mean.select(F.when((F.col("classes") > 1) & (F.col("least") > 1), F.round("mean", 7)).alias("silhouette"))
