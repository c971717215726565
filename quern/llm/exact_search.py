"""Exact top-k by inner product: KD-trees per shard, searched best first.

Candidates are dealt to shards of about `SHARD` rows. In a shard, median splits by the widest dimension give
a tree whose nodes have tight bounding boxes. The largest inner product that a box can hold with a query is
the sum over dimensions of the larger of query * low and query * high. From the root, the open node with
the largest bound is taken until no bound reaches the kth score, which is carried from shard to shard:
a task takes a block of queries through `RUN` shards and starts each with the kth scores so far.

Each query meets all shards, so the work is queries times rows; blocks of queries and runs of shards
are groups of bounded size, and a query sends on at most k rows a run.

Scores are exact integers: in double precision where the largest possible sum stays below 2^53, else in
64-bit integers, whose overflow is an error.

Nulls and oddities: vectors that are null or hold a null or non-finite component take no part, nor do rows
with a null id. Only vectors of one length meet. Rows with the query's own id are no candidates of it; a
query id that repeats is asked once, with the least of its vectors. Candidates that repeat an id stand as
often as they come. Ties go to the smaller id. With fewer than k candidates all are returned. Extra columns
are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.vectors import whole

SHARD, LEAF, BLOCK, RUN = 4096, 256, 1024, 16


class KdTree:
    """Nodes in an array: bounding boxes, and children or a range of rows."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(rows))
        self.low, self.high, self.children, self.range = [], [], [], []
        todo = [(0, len(rows), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = rows[self.order[a:b]]
            low, high = own.min(0), own.max(0)
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            self.range.append((a, b))
            if parent >= 0:
                self.children[parent].append(node)
            if b - a > leaf and own.shape[1] and (high > low).any():
                middle = (b - a) // 2
                split = np.argpartition(own[:, int((high - low).argmax())], middle)
                self.order[a:b] = self.order[a:b][split]
                todo += [(a, a + middle, node), (a + middle, b, node)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.rows = rows[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): the largest inner product that each node's box can hold."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


class Best:
    """The k best (score, id) of one query."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def kth(self) -> float:
        return self.score[-1] if len(self.score) >= self.k else -np.inf

    def add(self, score: np.ndarray, id: np.ndarray) -> None:
        score, id = np.concatenate([self.score, score]), np.concatenate([self.id, id])
        order = np.lexsort((id, -score))[: self.k]
        self.score, self.id = score[order], id[order]


def search(tree: KdTree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, best: list[Best]) -> None:
    """Improve `best` of each query with the tree's rows, but for those with its own id."""
    ids = ids[tree.order]
    bounds = tree.bounds(queries)
    for q in range(len(queries)):
        top, bound = best[q], bounds[q]
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= top.kth:
            node = heapq.heappop(heap)[1]
            if tree.children[node]:
                for child in tree.children[node]:
                    if bound[child] >= top.kth:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = tree.range[node]
            score = tree.rows[a:b] @ queries[q]
            keep = (score >= top.kth) & (ids[a:b] != own[q])
            if keep.any():
                top.add(score[keep].astype(np.int64), ids[a:b][keep])


_TOP = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _run(k: int):
    def run(table: pa.Table) -> pa.Table:
        shard, id = table.column("shard").to_numpy(), table.column("id").to_numpy()
        vectors = table.column("vector").combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        asked = shard < 0
        queries, own = flat[asked], id[asked]
        best = [Best(k) for _ in own]
        most = float(np.abs(flat.astype(np.float64)).max(initial=0))
        limit = most * most * max(flat.shape[1], 1)
        if limit >= 2.0**63:
            raise OverflowError("scores leave the range of 64-bit integers")
        if limit < 2.0**53:
            flat, queries = flat.astype(np.float64), queries.astype(np.float64)
        if len(own):
            for s in np.unique(shard[~asked]):
                rows = shard == s
                search(KdTree(flat[rows]), id[rows], queries, own, best)
        count = [len(b.score) for b in best]
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        return pa.table([pa.array(np.repeat(own, count).astype(np.int64)), pa.array(join([b.id for b in best])), pa.array(join([b.score for b in best]))], schema=_TOP)

    return run


def scaled(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, as integers."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def search_exact(rows: DataFrame, asked: Column, k: int = 20, scale: float = 64.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best of `rows` for each row where `asked` holds."""
    held = rows.where(whole(F.col(vector)) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), scaled(F.col(vector), scale).alias("vector"), asked.alias("asked"))
    held = held.withColumn("size", F.size("vector"))
    queries = held.where("asked").groupBy("id").agg(F.min("vector").alias("vector")).withColumn("size", F.size("vector"))
    counts = rows.agg(F.count("*").alias("rows"), F.count_if(asked).alias("asked")).first()
    shards, blocks = -(-counts["rows"] // SHARD) or 1, -(-counts["asked"] // BLOCK) or 1
    runs = -(-shards // RUN)
    candidates = held.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    candidates = candidates.select("size", F.floor(F.col("shard") / RUN).cast("int").alias("run"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", "id", "vector")
    queries = queries.select("size", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(-1).alias("shard"), "id", "vector")
    found = candidates.unionByName(queries).groupBy("size", "run", "block").applyInArrow(_run(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
