"""Density clustering of chunks in relational terms, as DuckDB SQL: a second way to the clusters of ``operators.clustering``.

Pairs of rows and their distances are a table. Every recursion step joins the
two components at the shortest pair between components of a chunk. The condensed
tree is a recursion downwards over these merges; stabilities are sums over it;
the choice of clusters folds over them from the leaves up; members are another
recursion downwards.
"""

from __future__ import annotations


#: Distances of two vectors a.v and b.v; cosine takes vectors of length one.
DISTANCES = {
    "cosine": "1 - list_dot_product(a.v, b.v)",
    "euclidean": "list_distance(a.v, b.v)",
    "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))",
}


def clusters_sql(rows: str, fallback: str, least: int, metric: str = "cosine") -> str:
    """(vec_id, label, chunk, cluster) of ``rows`` (vec_id, label, embedding, chunk); chunks without clusters take those of ``fallback``.

    Core distances of one neighbour never exceed a pair's own distance, so the distance stands for itself.
    """
    norm = "norm" if metric == "cosine" else "1"
    return f"""(WITH RECURSIVE r AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY chunk) AS n,
         greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12::DOUBLE) AS norm FROM ({rows})),
u AS MATERIALIZED (SELECT vec_id, label, chunk, i, n, list_transform(embedding, lambda x: x::DOUBLE / {norm}) AS v FROM r),
p AS MATERIALIZED (SELECT a.chunk, a.n, a.i, b.i AS j, {DISTANCES[metric]} AS d FROM u a JOIN u b ON a.chunk = b.chunk AND a.i < b.i WHERE a.n >= {max(least, 2)}),
m AS (
  SELECT chunk, 0::BIGINT AS step, range(max(n)) AS of, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS d, 0::BIGINT AS size_a, 0::BIGINT AS size_b FROM p GROUP BY chunk
  UNION ALL
  SELECT chunk, step + 1, list_transform(of, lambda x: CASE WHEN x = s.a OR x = s.b THEN len(of) + step ELSE x END), s.a, s.b, s.d,
         len(list_filter(of, lambda x: x = s.a)), len(list_filter(of, lambda x: x = s.b))
  FROM (SELECT m.chunk, m.step, m.of, arg_min({{'a': m.of[p.i + 1], 'b': m.of[p.j + 1], 'd': p.d}}, p.d) AS s FROM m JOIN p ON m.chunk = p.chunk WHERE m.of[p.i + 1] <> m.of[p.j + 1] GROUP BY m.chunk, m.step, m.of)),
g AS MATERIALIZED (SELECT chunk, len(of) + step - 1 AS node, a, b, 1 / greatest(d, 1e-12::DOUBLE) AS density, size_a, size_b, size_a >= {least} AND size_b >= {least} AS parts FROM m WHERE step > 0),
w AS (
  SELECT chunk, max(node) AS node, max(node) AS cluster, NULL::BIGINT AS parent, 0.0::DOUBLE AS birth FROM g GROUP BY chunk
  UNION ALL
  SELECT chunk, k.node, CASE WHEN parts THEN k.node ELSE cluster END, CASE WHEN parts THEN cluster ELSE parent END, CASE WHEN parts THEN density ELSE birth END
  FROM (SELECT w.chunk, w.cluster, w.parent, w.birth, g.parts, g.density, unnest([{{'node': g.a, 'size': g.size_a}}, {{'node': g.b, 'size': g.size_b}}]) AS k FROM w JOIN g ON w.chunk = g.chunk AND w.node = g.node) WHERE k.size >= {least}),
c AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY cluster) AS k FROM (
    SELECT w.chunk, w.cluster, any_value(w.parent) AS parent,
           sum((density - birth) * CASE WHEN parts THEN size_a + size_b ELSE CASE WHEN size_a < {least} THEN size_a ELSE 0 END + CASE WHEN size_b < {least} THEN size_b ELSE 0 END END) AS stability
    FROM w JOIN g ON w.chunk = g.chunk AND w.node = g.node GROUP BY w.chunk, w.cluster)),
s AS MATERIALIZED (SELECT c.*, q.k AS up, (SELECT count(*) FROM c x WHERE x.chunk = c.chunk AND x.parent = c.cluster) AS kids FROM c LEFT JOIN c q ON c.chunk = q.chunk AND c.parent = q.cluster),
f AS (
  SELECT chunk, 0::BIGINT AS k, list_transform(range(count(*)), lambda x: 0.0::DOUBLE) AS below, NULL::BOOLEAN AS taken FROM s GROUP BY chunk
  UNION ALL
  SELECT chunk, k + 1, list_transform(below, lambda x, i: CASE WHEN i = up THEN x + CASE WHEN taken THEN stability ELSE below[k + 1] END ELSE x END), taken
  FROM (SELECT f.chunk, f.k, f.below, s.up, s.stability, NOT (s.kids > 0 AND f.below[f.k + 1] > s.stability) AS taken FROM f JOIN s ON f.chunk = s.chunk AND s.k = f.k + 1)),
t AS MATERIALIZED (SELECT s.chunk, s.cluster, s.parent, f.taken FROM s JOIN f ON s.chunk = f.chunk AND s.k = f.k),
h AS (
  SELECT chunk, cluster, taken FROM t WHERE parent IN (SELECT cluster FROM t x WHERE x.chunk = t.chunk AND x.parent IS NULL)
  UNION ALL SELECT t.chunk, t.cluster, t.taken FROM h JOIN t ON h.chunk = t.chunk AND t.parent = h.cluster WHERE NOT h.taken),
o AS (
  SELECT chunk, cluster, cluster AS node FROM h WHERE taken
  UNION ALL SELECT o.chunk, o.cluster, unnest([g.a, g.b]) FROM o JOIN g ON o.chunk = g.chunk AND o.node = g.node),
l AS (SELECT u.chunk, u.i, o.cluster, min(u.i) OVER (PARTITION BY u.chunk, o.cluster) AS first FROM u JOIN o ON u.chunk = o.chunk AND u.i = o.node),
z AS (SELECT u.vec_id, u.label, u.chunk, u.n, l.first, dense_rank() OVER (PARTITION BY u.chunk ORDER BY l.first NULLS LAST) - 1 AS k, max(l.first) OVER (PARTITION BY u.chunk) IS NOT NULL AS any_ FROM u LEFT JOIN l ON u.chunk = l.chunk AND u.i = l.i)
SELECT z.vec_id, z.label, z.chunk, (CASE WHEN z.first IS NOT NULL THEN k WHEN any_ OR z.n < {least} THEN -1 ELSE b.cluster END)::INTEGER AS cluster FROM z JOIN ({fallback}) b USING (vec_id))"""
