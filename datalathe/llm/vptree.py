"""Approximate nearest neighbours by inner product: vantage-point trees per shard, pruned by the triangle inequality.

Rows stand in shards of bounded size, as they are read. Inside a shard the largest inner product is the
smallest Euclidean distance: with M the shard's largest norm, every row gets one more component
``sqrt(M^2 - |x|^2)`` and every query a zero, so ``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``. A node of the
shard's tree holds a vantage point and cuts its rows in half by their distance to it; it keeps
the least and the largest distance of both halves. Rows are stored in the order of the leaves.

A query's distance d to a vantage point bounds its distance to all rows of a half from below, by
``max(lo - d, d - hi, 0)``; a leaf's bound is the largest one on its path. A query visits leaves by ascending
bound and stops at the first whose bound, times ``factor``, lies beyond its k-th distance so far. Factor
one loses nothing (a slack covers rounding). A larger factor stops earlier, and a row it loses lies no
nearer than the k-th distance over the factor.

Scores are inner products of the original vectors in double precision, added from the first
component to the last, so equal vectors have equal scores. Ties go to the smaller id.

Query blocks meet every shard under the shard's number: the given query set against all rows. Both
sides are written once; a task holds one shard and one block of queries.

Vectors that are null, zero or hold null or non-finite components take no part; shorter ones count as filled up
with zeros. Null ids take no part. A row is never compared with rows of its own id; each row of a repeated
query id is a query with results of its own, under the same id. Norms must fit a double; else an
error is raised. Extra columns are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from datalathe.llm.common import map_arrow
from datalathe.session import cut_lineage

#: How much earlier than proved a query may stop; see the README for the recall at this value.
FACTOR = 1.5
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES, PAIRS = 16_384, 128, 1024, 65_536
#: Relative slack of distances, which come from inner products by a square root.
SLACK = 1e-7

_SHARD = "rows int, depth int, norm double, ids binary, vectors binary, points binary, spans binary"
_QUERIES = "queries int, query_ids binary, query_vectors binary"


def build(vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, float]:
    """(order of rows, vantage rows, spans, depth, largest norm) of a tree; node i has the children 2i+1 and 2i+2.

    ``spans`` has lo and hi of the near half, then of the far half. A vantage point is the row farthest
    from its node's first one.
    """
    squares = np.einsum("ij,ij->i", vectors, vectors)
    top = squares.max()
    lifted = np.column_stack([vectors, np.sqrt(np.maximum(0, top - squares))])
    n = len(vectors)
    depth = max(0, math.ceil(math.log2(n / leaf_rows))) if n > leaf_rows else 0
    order = np.arange(n)
    points, spans = np.zeros((1 << depth) - 1, np.int64), np.zeros(((1 << depth) - 1, 4))
    for level in range(depth):
        edges = _edges(n, level)
        for i, (start, end) in enumerate(zip(edges[:-1], edges[1:])):
            node, rows = (1 << level) - 1 + i, order[start:end].copy()
            far = np.argmax(_distances(lifted[rows], lifted[rows[0]]))
            d = _distances(lifted[rows], lifted[rows[far]])
            cut = _middle(start, end) - start
            by = np.argsort(d, kind="stable")
            order[start:end], d = rows[by], d[by]
            points[node] = rows[far]
            spans[node] = d[0], d[max(0, cut - 1)], d[min(cut, len(d) - 1)], d[-1]
    return order, points, spans, depth, math.sqrt(top)


def _distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    away = rows - point
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def _middle(start: int, end: int) -> int:
    return (start + end + 1) // 2


def _edges(n: int, level: int) -> list[int]:
    """Where the nodes of a level start and end among the ordered rows."""
    edges = [0, n]
    for _ in range(level):
        edges = sorted([*edges, *(_middle(a, b) for a, b in zip(edges[:-1], edges[1:]))])
    return edges


class Shard:
    """A shard's rows in the order of the leaves, with its tree."""

    def __init__(self, ids, vectors, points, spans, depth, norm):
        self.ids, self.vectors, self.points, self.spans, self.norm = ids, vectors, points, spans, norm
        self.depth, self.edges = depth, _edges(len(ids), depth)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least distances (query, leaf) that the vantage points allow."""
        bound = np.zeros((len(queries), 1))
        for level in range(self.depth):
            nodes = slice((1 << level) - 1, (2 << level) - 1)
            d = self.distance(queries, queries @ self.points[nodes].T)
            near_lo, near_hi, far_lo, far_hi = self.spans[nodes].T
            halves = np.maximum(near_lo - d, d - near_hi), np.maximum(far_lo - d, d - far_hi)
            bound = np.maximum(bound[:, :, None], np.stack(halves, 2)).reshape(len(queries), -1)
        return bound

    def distance(self, queries: np.ndarray, products: np.ndarray) -> np.ndarray:
        squares = np.einsum("ij,ij->i", queries, queries)[:, None] + self.norm**2
        return np.sqrt(np.maximum(0, squares - 2 * products))

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, ...]:
        """(query number, id, score) of the best k found for each query, and the leaves visited."""
        bounds = self.bounds(queries)
        turns = np.argsort(bounds, axis=1, kind="stable")
        bounds = np.take_along_axis(bounds, turns, 1)
        slack = SLACK * (np.linalg.norm(queries, axis=1) + self.norm)
        least = np.full(len(queries), -np.inf)  # the k-th score so far
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        active, visited = np.arange(len(queries)), 0
        for turn in range(turns.shape[1]):
            kth = self.distance(queries[active], np.where(np.isfinite(least[active]), least[active], 0)[:, None])[:, 0]
            kth[~np.isfinite(least[active])] = np.inf
            active = active[factor * (bounds[active, turn] - slack[active]) <= kth + slack[active]]
            if not len(active):
                break
            visited += len(active)
            leaves = turns[active, turn]
            new = [self._leaf(leaf, active[leaves == leaf], query_ids, queries, k, least) for leaf in np.unique(leaves)]
            found = _best(*map(np.concatenate, zip(found, *new)), k)
            full = np.flatnonzero(np.bincount(found[0], minlength=len(queries)) >= k)
            last = np.searchsorted(found[0], full, side="right") - 1
            least[full] = found[2][last]
        return *found, visited

    def _leaf(self, leaf: int, at: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray):
        """Exact scores of the leaf's rows that may be among the best k, for the queries numbered ``at``."""
        rows = slice(self.edges[leaf], self.edges[leaf + 1])
        products = queries[at] @ self.vectors[rows].T
        products[query_ids[at][:, None] == self.ids[rows][None]] = -np.inf
        wanted = least[at]
        if products.shape[1] > k:
            wanted = np.maximum(wanted, np.partition(products, -k, axis=1)[:, -k])
        wanted = wanted - SLACK * (np.linalg.norm(queries[at], axis=1) * self.norm)
        q, r = np.nonzero((products >= wanted[:, None]) & (products > -np.inf))
        q, r = at[q], r + rows.start
        return q, self.ids[r], exact(queries, q, self.vectors, r)


def exact(queries: np.ndarray, q: np.ndarray, vectors: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of the pairs of rows, added from the first component to the last."""
    scores = np.zeros(len(q))
    for start in range(0, len(q), PAIRS):
        part = slice(start, start + PAIRS)
        products = queries[q[part]] * vectors[r[part]]
        for j in range(products.shape[1]):
            scores[part] += products[:, j]
    return scores


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query, by query, descending score and ascending id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    starts = np.searchsorted(q, q)
    kept = np.arange(len(q)) - starts < k
    return q[kept], ids[kept], scores[kept]


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, _finite) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(f"`{key}`").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v"))


def _filled(rows: DataFrame, size: int) -> DataFrame:
    return rows.select("id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v"))).alias("v"))


def _blocks(batches, size: int, most: int):
    """(ids, matrix) of ``most`` rows each, the last of what is left."""
    held, n = [], 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, most - n)
            held.append((part.column("id").to_numpy(), part.column("v").flatten().to_numpy().reshape(-1, size)))
            n, start = n + part.num_rows, start + part.num_rows
            if n == most:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def index(rows: DataFrame, size: int, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row per shard of rows (id, v)."""

    def work(batches):
        for ids, vectors in _blocks(batches, size, shard_rows):
            order, points, spans, depth, norm = build(vectors, leaf_rows)
            yield {
                "rows": [len(ids)], "depth": [depth], "norm": [norm], "ids": [ids[order].tobytes()],
                "vectors": [vectors[order].tobytes()], "points": [vectors[points].tobytes()], "spans": [spans.tobytes()],
            }

    return map_arrow(rows, work, _SHARD)


def _asked(rows: DataFrame, size: int, most: int) -> DataFrame:
    def work(batches):
        for ids, vectors in _blocks(batches, size, most):
            yield {"queries": [len(ids)], "query_ids": [ids.tobytes()], "query_vectors": [vectors.tobytes()]}

    return map_arrow(rows, work, _QUERIES)


def nearest(
    df: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS,
    leaf_rows: int = LEAF_ROWS, block_queries: int = BLOCK_QUERIES, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found for each query; ``queries`` has the columns of the rows."""
    if factor < 1:
        raise ValueError("the factor is at least 1")
    rows, asking = _vectors(df, key, vector), _vectors(queries, key, vector)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = [d.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first() for d in (rows, asking)]
    if not (facts[0][0] and facts[1][0]):
        return df.sparkSession.range(0).selectExpr("id as query_id", "0 as rank", f"id as `{key}`", "double(id) as score")
    if max(f[2] for f in facts) > 1e150:
        raise ValueError("a vector's norm is too large for inner products in double precision")
    size = max(f[1] for f in facts)
    # Shards are filled evenly however small or large the table's own parts are.
    spread = _filled(rows, size).repartition(max(1, math.ceil(facts[0][0] / shard_rows)))
    shards = cut_lineage(index(spread, size, shard_rows, leaf_rows).withColumn("shard", F.monotonically_increasing_id()))
    blocks = _asked(_filled(asking, size).coalesce(max(1, math.ceil(facts[1][0] / block_queries))), size, block_queries)
    blocks = cut_lineage(blocks.withColumn("query_block", F.monotonically_increasing_id()))
    numbers = [r["shard"] for r in shards.select("shard").collect()]
    met = blocks.withColumn("shard", F.explode(F.lit(numbers))).join(shards, "shard")

    def work(pairs):
        for batch in pairs:
            for i in range(batch.num_rows):
                yield _answers({n: batch.column(n)[i].as_py() for n in batch.schema.names}, size, k, factor)

    best = map_arrow(met, work, "query_block long, query int, query_id long, id long, score double")
    order = Window.partitionBy("query_block", "query", "query_id").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def _answers(row: dict, size: int, k: int, factor: float) -> dict:
    floats = lambda name, width: np.frombuffer(row[name]).reshape(-1, width)
    ids = np.frombuffer(row["ids"], np.int64)
    shard = Shard(ids, floats("vectors", size), floats("points", size), floats("spans", 4), row["depth"], row["norm"])
    query_ids = np.frombuffer(row["query_ids"], np.int64)
    q, found, scores, _ = shard.top(query_ids, floats("query_vectors", size), k, factor)
    return {
        "query_block": np.full(len(q), row["query_block"]), "query": q.astype(np.int32), "query_id": query_ids[q],
        "id": found, "score": scores,
    }
