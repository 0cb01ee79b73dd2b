"""Exact top-k inner products with KD-trees, one tree per shard.

Equal vectors are one point with its smallest ids. Points are dealt to shards by hash; a shard
becomes a tree by median splits on the widest side, each node with its tight bounding box. For
a query no point of a box scores more than sum(max(q*lo, q*hi)); nodes are visited best bound
first until the bound falls below the k-th score. Every query first searches one home shard,
and its k-th score there goes along to the others as a bound to start from.

Queries and shards meet as blocks: a stated query set against all rows. Within a block pair
only k rows a query leave the task.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor
do rows with a null id. Components are scaled and floored to integers, saturated to the range
of a long, and products summed exactly (a sum beyond a long is saturated in the result).
Vectors of different lengths don't meet. Exactly repeated rows count once. Other columns are
not read. Of equal scores the smaller id comes first.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.common import stored_table
from stintwise.llm.vectors import collapsed, merged, usable

LEAF = 64


class Tree:
    """Flat arrays: a node's points are order[start:stop]; inner nodes have two children."""

    def __init__(self, points: np.ndarray) -> None:
        self.points, self.order = points, np.arange(len(points))
        starts, stops, left, low, high = [], [], [], [], []
        todo = [(0, len(points))]
        nodes = 0
        while nodes < len(todo):
            a, b = todo[nodes]
            inside = points[self.order[a:b]]
            lo, hi = inside.min(axis=0), inside.max(axis=0)
            starts.append(a)
            stops.append(b)
            low.append(lo)
            high.append(hi)
            if b - a > LEAF and (hi > lo).any():
                side, middle = int(np.argmax(hi - lo)), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argsort(inside[:, side], kind="stable")]
                left.append(len(todo))
                todo += [(a, a + middle), (a + middle, b)]
            else:
                left.append(-1)
            nodes += 1
        self.starts, self.stops, self.left = starts, stops, left
        self.low, self.high = np.array(low), np.array(high)

    def search(self, queries: np.ndarray, own: np.ndarray, ids: list, k: int, bounds: list) -> list[list[tuple]]:
        """For every query the best (-score, id) in order, of those not below its bound."""
        # Rows of nodes x columns of queries; the sum over sides of the larger product.
        most = self.high @ np.maximum(queries, 0).T + self.low @ np.minimum(queries, 0).T
        found = []
        for j, query in enumerate(queries):
            kth, best, heap = bounds[j], [], [(-most[0, j], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                if kth is not None and -top < kth:
                    break
                if self.left[node] >= 0:
                    for child in (self.left[node], self.left[node] + 1):
                        if kth is None or most[child, j] >= kth:
                            heapq.heappush(heap, (-most[child, j], child))
                    continue
                inside = self.order[self.starts[node]:self.stops[node]]
                scores = self.points[inside] @ query
                if kth is not None:
                    near = np.flatnonzero(scores >= kth)
                    inside, scores = inside[near], scores[near]
                new = [(-int(s), i) for s, p in zip(scores, inside) for i in ids[p] if i != own[j]]
                best = heapq.nsmallest(k, best + new)
                if len(best) == k and (kth is None or -best[-1][0] > kth):
                    kth = -best[-1][0]
            found.append(best)
        return found


def search_cell(points: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of a shard for every query of a block."""
    out: list[tuple[int, int, int]] = []
    if len(points) and len(queries):
        p, q = np.stack(points.value.to_numpy()), np.stack(queries.value.to_numpy())
        size = float(np.abs(p.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0))
        # Doubles hold sums up to 2^53 exactly; beyond, Python's integers are used.
        kind = np.float64 if size * max(1, p.shape[1]) < 2 ** 52 else object
        tree = Tree(p.astype(kind))
        bounds = [None if pd.isna(b) else int(b) for b in queries.bound]
        own = queries.query_id.to_numpy()
        for query, best in zip(own, tree.search(q.astype(kind), own, points.ids.tolist(), k, bounds), strict=True):
            out += [(query, i, max(-2 ** 63, min(2 ** 63 - 1, -s))) for s, i in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def top_k(rows: DataFrame, is_query: str, k: int = 10, scale: int = 1024, points_per_shard: int = 20_000,
          queries_per_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every query."""
    whole = usable(rows).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("value"))
    whole = stored_table(whole, "scaled")
    total = whole.count()
    shards = max(1, -(-total // points_per_shard))
    points = stored_table(collapsed(whole, "value", k + 1, total).withColumn(
        "shard", F.pmod(F.xxhash64("value"), F.lit(shards)).cast("int")).withColumn("sides", F.size("value")), "points")
    queries = whole.where(is_query).select(F.col("vec_id").alias("query_id"), "value", F.size("value").alias("sides")) \
        .distinct()
    blocks = max(1, -(-queries.count() // queries_per_block))
    queries = stored_table(queries.select(
        "*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(shards)).cast("int").alias("home")), "queries")
    dealt = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["sides", "shard", "block"]

    def searched(side: DataFrame) -> DataFrame:
        return dealt.groupBy(*keys).cogroup(side.groupBy(*keys)).applyInPandas(
            lambda p, q: search_cell(p, q, k), "query_id long, vec_id long, score long")

    none = F.lit(None).cast("long")
    first = searched(queries.withColumn("shard", F.col("home")).withColumn("bound", none))
    if shards == 1:
        return merged(first, k)
    first = stored_table(first, "home_results")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")) \
        .select("query_id", F.when(F.col("n") >= k, F.col("kth")).alias("bound"))
    others = queries.join(kth, "query_id", "left").withColumn("shard", F.explode(
        F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
    return merged(first.unionByName(searched(others)), k)
