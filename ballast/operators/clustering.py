"""Density clustering of each chunk by hierarchical single linkage on cosine distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _spanning_edges(distance: np.ndarray) -> list[tuple[float, int, int]]:
    """Minimum spanning tree by Prim, sorted by length."""
    n = len(distance)
    best, source, edges = distance[0].copy(), np.zeros(n, int), []
    todo = np.ones(n, bool)
    todo[0] = False
    for _ in range(n - 1):
        j = int(np.argmin(np.where(todo, best, np.inf)))
        edges.append((float(best[j]), int(source[j]), j))
        todo[j] = False
        closer = todo & (distance[j] < best)
        best[closer], source[closer] = distance[j][closer], j
    return sorted(edges)


def checked(x) -> np.ndarray:
    """Rows of features as doubles; none, or rows that aren't of one length, are an error."""
    x = np.asarray(x, float)
    if x.size == 0:
        raise ValueError("there are no features to cluster")
    if x.ndim != 2:
        raise ValueError(f"features must be rows of one length, not an array of {x.ndim} dimensions")
    return x


def distances(x: np.ndarray, metric: str = "cosine") -> np.ndarray:
    """All distances within a chunk; the metric is a name in any case, or a function of two arrays of rows."""
    if callable(metric):
        d = np.asarray(metric(x, x), float)
    elif (name := metric.strip().lower()) in ("cosine", "precomputed"):
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        d = 1.0 - unit @ unit.T
    elif name == "euclidean":
        x = x - x.mean(axis=0)  # smaller products, less rounding
        squares = np.einsum("ij,ij->i", x, x)
        d = np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * (x @ x.T), 0.0))
    elif name == "manhattan":
        d = np.zeros((len(x), len(x)))
        for column in x.T:  # one square matrix at a time
            d += np.abs(column[:, None] - column[None])
    else:
        raise ValueError(f"unknown metric {metric!r}: cosine, euclidean, manhattan or a function")
    np.fill_diagonal(d, 0.0)
    return d


def density_labels(x: np.ndarray, least: int = 25, min_samples: int = 1, metric: str = "cosine", epsilon: float = 0.0, single: bool = False) -> np.ndarray:
    """Cluster of every row or -1: condensed tree of the linkage, clusters of the largest total stability (published algorithm).

    Clusters that come apart at less than ``epsilon`` are taken as the one they
    come from; only with ``single`` may all rows be one cluster.
    """
    x = checked(x)
    n = len(x)
    labels = np.full(n, -1)
    if n < max(least, 2):
        return labels
    distance = distances(x, metric)
    core = np.sort(distance, axis=1)[:, min(min_samples, n - 1)]
    distance = np.maximum(distance, np.maximum(core[:, None], core[None, :]))
    up = list(range(2 * n - 1))
    children: dict[int, tuple[int, int, float]] = {}
    size = [1] * n

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for d, a, b in _spanning_edges(distance):
        a, b, new = root(a), root(b), len(size)
        up[a] = up[b] = new
        children[new] = (a, b, 1.0 / max(d, 1e-12))
        size.append(size[a] + size[b])

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            k = todo.pop()
            if k < n:
                out.append(k)
            else:
                todo += children[k][:2]
        return out

    # Walk down: a split into two large parts makes two clusters, else rows fall out of the running one.
    clusters = [{"birth": 0.0, "stability": 0.0, "kids": [], "rows": points(len(size) - 1)}]
    todo = [(len(size) - 1, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            continue
        a, b, density = children[node]
        large = [k for k in (a, b) if size[k] >= least]
        gained = density - clusters[c]["birth"]
        if len(large) == 2:
            clusters[c]["stability"] += gained * size[node]
            for k in large:
                clusters.append({"birth": density, "stability": 0.0, "kids": [], "rows": points(k)})
                clusters[c]["kids"].append(len(clusters) - 1)
                todo.append((k, len(clusters) - 1))
        else:
            clusters[c]["stability"] += gained * sum(size[k] for k in (a, b) if size[k] < least)
            todo += [(k, c) for k in large]
    # Bottom up: a cluster is taken if it is at least as stable as the best choice below it.
    best, taken = [c["stability"] for c in clusters], [True] * len(clusters)
    for i in range(len(clusters) - 1, -1, -1):
        below = sum(best[k] for k in clusters[i]["kids"])
        if clusters[i]["kids"] and below > best[i]:
            best[i], taken[i] = below, False
    todo, chosen = [0] if single else list(clusters[0]["kids"]), []
    while todo:
        i = todo.pop()
        if taken[i]:
            chosen.append(i)
        else:
            todo += clusters[i]["kids"]
    if epsilon > 0:
        parent = {k: i for i, c in enumerate(clusters) for k in c["kids"]}
        wide = set()
        for i in chosen:
            while i and 1.0 / clusters[i]["birth"] < epsilon and (parent[i] or single):
                i = parent[i]
            wide.add(i)
        below = lambda i: i in parent and (parent[i] in wide or below(parent[i]))
        chosen = [i for i in wide if not below(i)]
    # Clusters are numbered in the order of their first rows.
    for label, i in enumerate(sorted(chosen, key=lambda i: min(clusters[i]["rows"]))):
        labels[clusters[i]["rows"]] = label
    return labels


def cluster_chunks(df: DataFrame, index: str, embedding: str = "embedding", least: int = 25, fallback: bool = True, quantile: float = 0.7, metric: str = "cosine", epsilon: float = 0.0, single: bool = False) -> DataFrame:
    """(chunk, index, cluster) of chunked rows; a chunk is a fixed number of rows, so tasks stay small at any input size.

    Where no cluster is found in a chunk of ``least`` rows or more, the fallback
    partition by the first dimension is taken.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(index)
        x = np.array(part[embedding].tolist(), float)
        labels = density_labels(x, least, metric=metric, epsilon=epsilon, single=single)
        if fallback and len(x) >= least and (labels < 0).all():
            labels = (x[:, 0] > np.quantile(x[:, 0], quantile)).astype(int)
            if labels.min() == labels.max():
                labels = (np.arange(len(x)) >= len(x) // 2).astype(int)
        return pd.DataFrame({"chunk": part["chunk"], index: part[index], "cluster": labels.astype("int32")})

    return df.select("chunk", index, embedding).groupBy("chunk").applyInPandas(run, f"chunk long, {index} long, cluster int")
