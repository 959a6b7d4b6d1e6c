"""Exact top-k search by inner product with a KD-tree per shard."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plateloom.llm.common import stage

K = 10
LEAF_ROWS = 128
#: Vectors in a shard, and queries that are sent to all shards at once.
SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
SCALE = 1024


class KDTree:
    """Integer vectors split at the median of the widest dimension; every node has a tight bounding box."""

    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        self.order = np.lexsort((ids,))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        todo = [(self._node(points, self.order), self.order)]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= LEAF_ROWS:
                self.rows[node] = np.sort(rows)
                continue
            dim = int(np.argmax(self.high[node] - self.low[node]))
            half = len(rows) // 2
            cut = np.argpartition(points[rows, dim], half)
            parts = rows[cut[:half]], rows[cut[half:]]
            self.children[node] = tuple(self._node(points, x) for x in parts)
            todo += zip(self.children[node], parts)
        self.ids, self.points = ids, points
        self.lows, self.highs = np.array(self.low), np.array(self.high)

    def _node(self, points: np.ndarray, rows: np.ndarray) -> int:
        own = points[rows]
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        self.children.append(None)
        self.rows.append(None)
        return len(self.low) - 1

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No point of a node (column) has a larger inner product with a query (row)."""
        return np.maximum(queries, 0) @ self.highs.T + np.minimum(queries, 0) @ self.lows.T

    def search(self, own_id: int, query: np.ndarray, bounds: np.ndarray, best: list[tuple[int, int]], k: int, at_least: int | None) -> list[tuple[int, int]]:
        """The ``k`` first of ``best`` and the tree's rows by (-score, id), from the node of highest bound on.

        Stops when no node left can reach the kth score, be it of ``best`` or ``at_least``, known from elsewhere.
        """
        kth = max((-best[-1][0] if len(best) == k else None, at_least), key=lambda x: -np.inf if x is None else x)
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            if kth is not None and -bound < kth:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    if kth is None or bounds[child] >= kth:
                        heapq.heappush(todo, (-bounds[child], child))
                continue
            rows = self.rows[node]
            scores, ids = self.points[rows] @ query, self.ids[rows]
            keep = ids != own_id
            if kth is not None:
                keep &= (scores >= kth).astype(bool)
            scores, ids = scores[keep], ids[keep]
            if not len(ids):
                continue
            if len(ids) > k:
                # Python's integers can't be sorted by numpy with a second key
                first = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k] if scores.dtype == object else np.lexsort((ids, -scores))[:k]
                scores, ids = scores[first], ids[first]
            best = heapq.nsmallest(k, [*best, *zip((-scores).tolist(), ids.tolist())])
            if len(best) == k:
                kth = max(-best[-1][0], kth if kth is not None else -np.inf)
        return best


def integer_vectors(df: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """``(id long, v array<double>)`` with each component floor(scale * x); rows that hold a null or non-finite one go."""
    x = F.col(vector_column).cast("array<double>")
    rows = df.select(F.col(id_column).cast("long").alias("id"), x.alias("x")).filter("id is not null and x is not null")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.filter(fine).select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("v"))


def _matrix(column: pa.Array, exact: bool) -> np.ndarray:
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    return flat.reshape(len(column), -1) if exact else np.array([[int(x) for x in row] for row in flat.reshape(len(column), -1)], object)


def _shard_search(tables: list[pa.Table], queries: dict[int, tuple[np.ndarray, np.ndarray]], floor: dict[int, int], k: int):
    """Best of the rows of a task for every query: a tree for each shard, whose kth scores pass on to the next."""
    best: dict[int, dict[int, list]] = {dim: {} for dim in queries}
    for table in tables:
        column = table.column("v").combine_chunks()
        sizes, ids = np.diff(column.offsets.to_numpy()), table.column("id").to_numpy()
        for dim in np.unique(sizes).tolist():
            if dim not in queries:
                continue
            rows = np.flatnonzero(sizes == dim)
            qids, qs = queries[dim]
            part = column.take(pa.array(rows))
            points = _matrix(part, True) if dim else np.zeros((len(rows), 0))
            # sums of products stay exact in doubles below 2**53, else Python's integers are used
            exact = dim * float(np.abs(points).max(initial=0)) * float(np.abs(qs).max(initial=0)) < 2**53
            if not exact:
                points, qs = _matrix(part, False), np.array([[int(x) for x in q] for q in qs], object)
            tree = KDTree(ids[rows], points)
            bounds = tree.bounds(qs)
            for j, own in enumerate(qids.tolist()):
                best[dim][j] = tree.search(own, qs[j], bounds[j], best[dim].get(j, []), k, floor.get(own))
    for dim, found in best.items():
        for j, rows in found.items():
            for score, other in rows:
                yield int(queries[dim][0][j]), other, int(-score)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` the ``k`` rows of ``vectors`` of highest score.

    Both are as ``integer_vectors`` makes them; the score is the inner product, exact, ties go to the smaller id, and a
    vector doesn't meet those with its own id. Only vectors of one length meet. Fewer than ``k`` candidates are all
    returned; a query without any isn't. Repeated rows are candidates each for itself, and a repeated query is
    answered once. Empty tables give an empty result.

    Queries are taken in blocks of bounded size. The first shard of vectors is searched for a block before the others,
    and its kth scores prune their trees. Each task returns at most ``k`` rows a query.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    asked = stage(queries.dropDuplicates(["id"]), "queries")
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    parts = []
    for b in range(blocks):
        block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        own = block.toArrow()
        column = own.column("v").combine_chunks()
        if not len(column):
            continue
        sizes, ids = np.diff(column.offsets.to_numpy()), own.column("id").to_numpy()
        by_dim = {}
        for dim in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dim)
            by_dim[dim] = (ids[rows], _matrix(column.take(pa.array(rows)), True) if dim else np.zeros((len(rows), 0)))
        # the first shard: its kth scores are bounds for the others
        first = [vectors.limit(2048).toArrow()]
        seen: dict[int, list[int]] = {}
        for q, _, score in _shard_search(first, by_dim, {}, k):
            seen.setdefault(q, []).append(score)
        floor = {q: min(xs) for q, xs in seen.items() if len(xs) == k}
        sent = spark.sparkContext.broadcast((by_dim, floor))

        def run(batches, sent=sent):
            by_dim, floor = sent.value

            def shards():
                held, n = [], 0
                for batch in batches:
                    held.append(batch)
                    n += batch.num_rows
                    if n >= SHARD_ROWS:
                        yield pa.Table.from_batches(held)
                        held, n = [], 0
                if held:
                    yield pa.Table.from_batches(held)

            rows = list(_shard_search(shards(), by_dim, floor, k))
            for at in range(0, len(rows), 10_000):
                q, v, s = zip(*rows[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

        parts.append(vectors.mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_of_table(df: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int = K) -> DataFrame:
    """``top_k`` of the rows of ``df`` with ``is_query`` against all its rows."""
    vectors = integer_vectors(df, id_column, vector_column)
    return top_k(vectors, integer_vectors(df.filter(is_query), id_column, vector_column), k)
