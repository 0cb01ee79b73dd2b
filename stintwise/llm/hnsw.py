"""Approximate nearest neighbours: a navigable small-world graph in layers, one per shard.

Equal vectors are one node with its smallest ids, so that copies neither fill neighbour lists
nor crowd out results. Nodes are dealt to shards by hash; a shard's index is one stored row of
flat arrays: the vectors, each layer's members and their neighbour lists of fixed width. Graphs
are built layer by layer from the top, inserting batches whose searches run side by side as
array operations. Vectors get one more component that makes all norms equal, so the largest
inner product is the nearest point. Every query block is searched in every shard; scores are
then computed from the original vectors in double precision and the shards' results merged.

Every row is indexed and none is capped; recall below 1 is the graph's alone. The index is a
stored table, so a lost executor repeats single shards.

Defined results: vectors that are null, zero or hold a null or non-finite component take no
part, nor do rows with a null id. Vectors of different lengths don't meet. Exactly repeated
rows count once. Other columns are not read. Of equal scores the smaller id comes first; with
fewer candidates than k all found are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.common import mix, stored_table
from stintwise.llm.vectors import collapsed, merged, usable

WIDTH, WIDTH_0 = 16, 32
EF_BUILD, EF_SEARCH = 96, 256
BATCH, STEP = 256, 4


def beam(queries: np.ndarray, vectors: np.ndarray, graph: np.ndarray, entry: np.ndarray, ef: int) -> np.ndarray:
    """For every query the ef best nodes found, best first (-1: none), walking from its entries."""
    n, rows = len(queries), np.arange(len(queries))[:, None]
    ids = np.full((n, ef), -1, np.int64)
    ids[:, :entry.shape[1]] = entry[:, :ef]
    sims = np.where(ids >= 0, np.einsum("qd,qed->qe", queries, vectors[ids]), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = ids[rows, order], sims[rows, order]
    open_ = ids >= 0
    seen = np.zeros((n, len(vectors) + 1), bool)
    seen[rows, ids] = True
    live = np.arange(n)
    while len(live):
        at = np.arange(len(live))[:, None]
        # The best STEP nodes of every live query that were not walked from yet.
        turn = np.argsort(~open_[live], axis=1, kind="stable")[:, :STEP]
        walked = open_[live[:, None], turn]
        near = np.where(walked[:, :, None], graph[ids[live[:, None], turn]], -1).reshape(len(live), -1)
        open_[live[:, None], turn] = False
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near]] = -1
        seen[live[:, None], near] = True
        new = np.where(near >= 0, np.einsum("qd,qed->qe", queries[live], vectors[near]), -np.inf)
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_sims = np.concatenate([sims[live], new], axis=1)
        all_open = np.concatenate([open_[live], near >= 0], axis=1)
        best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        best = best[at, np.argsort(-all_sims[at, best], axis=1, kind="stable")]
        ids[live], sims[live] = all_ids[at, best], all_sims[at, best]
        open_[live] = all_open[at, best] & (ids[live] >= 0)
        live = live[open_[live].any(axis=1)]
    return ids


def diverse(points: np.ndarray, candidates: np.ndarray, vectors: np.ndarray, width: int) -> np.ndarray:
    """Of every point's candidates those nearer to it than to any chosen before, then the nearest others."""
    sims = np.where(candidates >= 0, np.einsum("pd,pcd->pc", points, vectors[candidates]), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    at = np.arange(len(points))[:, None]
    candidates, sims = candidates[at, order], sims[at, order]
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    found = vectors[candidates]
    between = np.einsum("pcd,ped->pce", found, found)
    chosen = np.zeros(candidates.shape, bool)
    for c in range(candidates.shape[1]):
        nearer = np.where(chosen[:, :c], between[:, c, :c], -np.inf).max(axis=1, initial=-np.inf)
        chosen[:, c] = (candidates[:, c] >= 0) & (sims[:, c] > nearer)
    rank = np.where(candidates < 0, 2, np.where(chosen, 0, 1))
    take = np.argsort(rank, axis=1, kind="stable")[:, :width]
    out = np.where(rank[at, take] < 2, candidates[at, take], -1)
    if out.shape[1] < width:
        out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
    return out


def link(graph: np.ndarray, vectors: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Set the new nodes' lists and add the reverse links, keeping every list within its width."""
    width = graph.shape[1]
    graph[new] = chosen
    source, target = np.repeat(new, width), chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    touched, start, count = np.unique(target, return_index=True, return_counts=True)
    extra = np.full((len(touched), int(count.max(initial=0))), -1, np.int64)
    extra[np.repeat(np.arange(len(touched)), count), np.arange(len(target)) - np.repeat(start, count)] = source
    both = np.concatenate([graph[touched], extra], axis=1)
    for a in range(0, len(touched), 512):
        part = touched[a:a + 512]
        graph[part] = diverse(vectors[part], both[a:a + 512].copy(), vectors, width)


class Graph:
    """Layers from the top: members (node numbers, best connected last) and neighbour lists."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.vectors, self.layers = vectors, layers

    @staticmethod
    def build(vectors: np.ndarray) -> Graph:
        n = len(vectors)
        chance = (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(float) / 2.0 ** 53
        level = np.floor(-np.log(np.maximum(chance, 1e-300)) / math.log(WIDTH)).astype(int)
        order = np.lexsort((np.arange(n), -level))
        graph = Graph(vectors, [])
        for layer in range(int(level.max(initial=0)), -1, -1):
            members = order[level[order] >= layer]
            width = WIDTH if layer else WIDTH_0
            lists = np.full((n, width), -1, np.int64)
            done, size = 1, 1
            while done < len(members):
                size = min(BATCH, done, len(members) - done)
                new = members[done:done + size]
                points = vectors[new]
                near = beam(points, vectors, lists, graph.entries(points, members[:1]), EF_BUILD)
                # Members of the same batch don't find each other by walking.
                same = points @ points.T
                np.fill_diagonal(same, -np.inf)
                few = min(width, size - 1)
                if few > 0:
                    near = np.concatenate([near, new[np.argpartition(-same, few - 1, axis=1)[:, :few]]], axis=1)
                link(lists, vectors, new, diverse(points, near, vectors, width))
                done += size
            graph.layers.append((members, lists))
        return graph

    def entries(self, queries: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where to start below the layers that exist: the best nodes of the lowest of them."""
        at = np.tile(first, (len(queries), 1))
        for _, lists in self.layers:
            at = beam(queries, self.vectors, lists, at, 8)
        return at

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        top, lists = self.layers[:-1], self.layers[-1][1]
        entry = Graph(self.vectors, top).entries(queries, self.layers[0][0][:1])
        return beam(queries, self.vectors, lists, entry, ef)


def build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """The index of a shard as one row of flat arrays."""
    original = np.stack(rows.embedding.to_numpy())
    square = (original ** 2).sum(axis=1)
    top = square.max()
    vectors = np.concatenate([original, np.sqrt(np.maximum(top - square, 0))[:, None]], axis=1)
    if top > 0 and np.isfinite(top):
        vectors /= math.sqrt(top)
    graph = Graph.build(np.nan_to_num(vectors.astype(np.float32)))
    members = np.concatenate([m for m, _ in graph.layers])
    lists = np.concatenate([g[m].ravel() for m, g in graph.layers])
    return pd.DataFrame([{
        "sides": int(rows.sides.iloc[0]), "shard": int(rows.shard.iloc[0]), "vectors": original.tobytes(),
        "walked": graph.vectors.tobytes(), "members": members.astype(np.int32).tobytes(),
        "sizes": [len(m) for m, _ in graph.layers], "lists": lists.astype(np.int32).tobytes(), "ids": rows.ids.tolist()}])


INDEX = "sides int, shard int, vectors binary, walked binary, members binary, sizes array<int>, lists binary, ids array<array<long>>"


def open_shard(row: pd.Series) -> tuple[Graph, np.ndarray]:
    n = len(row.ids)
    vectors = np.frombuffer(row.walked, np.float32).reshape(n, -1)
    members, lists = np.frombuffer(row.members, np.int32), np.frombuffer(row.lists, np.int32)
    layers, m, at = [], 0, 0
    for k, size in enumerate(row.sizes):
        width = WIDTH_0 if k == len(row.sizes) - 1 else WIDTH
        inside = members[m:m + size].astype(np.int64)
        graph = np.full((n, width), -1, np.int64)
        graph[inside] = lists[at:at + size * width].reshape(size, width)
        layers.append((inside, graph))
        m, at = m + size, at + size * width
    return Graph(vectors, layers), np.frombuffer(row.vectors, np.float64).reshape(n, -1)


def search_cell(index: pd.DataFrame, queries: pd.DataFrame, k: int, ef: int) -> pd.DataFrame:
    """The k best found in a shard for every query of a block, scored on the original vectors."""
    out: list[tuple[int, int, float]] = []
    if len(index) and len(queries):
        row = index.iloc[0]
        graph, original = open_shard(row)
        wanted = np.stack(queries.embedding.to_numpy())
        for a in range(0, len(queries), BATCH):
            part = wanted[a:a + BATCH]
            norm = np.sqrt((part ** 2).sum(axis=1, keepdims=True))
            walk = np.pad(part / np.where(norm > 0, norm, 1), ((0, 0), (0, 1))).astype(np.float32)
            near = graph.search(walk, max(ef, k + 1))[:, :k + 1 + ef // 8]
            for query, vector, nodes in zip(queries.query_id.iloc[a:a + BATCH], part, near, strict=True):
                nodes = nodes[nodes >= 0]
                best = [(-math.fsum(p), i) for p, node in zip((original[nodes] * vector).tolist(), nodes)
                        for i in row.ids[node] if i != query]
                out += [(query, i, -s) for s, i in sorted(best)[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def build_index(rows: DataFrame, keep: int, nodes_per_shard: int = 8192) -> tuple[DataFrame, int]:
    """The stored index over every usable row, and its number of shards."""
    whole = usable(rows, zero=False)
    total = whole.count()
    shards = max(1, -(-total // nodes_per_shard))
    nodes = collapsed(whole, "embedding", keep, total).select(
        "embedding", "ids", F.size("embedding").alias("sides"),
        F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"))
    return stored_table(nodes.groupBy("sides", "shard").applyInPandas(build_shard, INDEX), "graphs"), shards


def nearest(rows: DataFrame, is_query: str, k: int = 20, ef: int = EF_SEARCH, nodes_per_shard: int = 8192,
            queries_per_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for every query."""
    index, shards = build_index(rows, k + 1, nodes_per_shard)
    queries = usable(rows, zero=False).where(is_query).select(
        F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("sides")).distinct()
    blocks = max(1, -(-queries.count() // queries_per_block))
    dealt = queries.select("*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
                           F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    keys = ["sides", "shard", "block"]
    found = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy(*keys) \
        .cogroup(dealt.groupBy(*keys)).applyInPandas(
            lambda i, q: search_cell(i, q, k, ef), "query_id long, vec_id long, score double")
    return merged(found, k)
