"""Exact and approximate search against brute force, with odd vectors, ties and repeated rows."""

import math

import numpy as np
import pytest

from stintwise.llm import hnsw, topk

SCHEMA = "vec_id long, embedding array<float>, label int, value string, ids long, shard string"


def rows_of(vectors):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "left", 1, "clash") for i, v in vectors]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    plain = rng.normal(size=(900, 16)) / 4
    found = [(i, v) for i, v in enumerate(plain)]
    found += [(900 + i, plain[7]) for i in range(60)]
    found += [(960, None), (980, [None] + [0.1] * 15), (1000, [float("nan")] + [0.1] * 15), (1020, [float("inf")] * 16),
              (1040, [0.0] * 16), (1060, [0.5] * 3), (1080, [0.25] * 3), (None, plain[1]), (1100, [])]
    return spark.createDataFrame(rows_of(found), SCHEMA)


def usable(frame):
    return [(r.vec_id, np.array(r.embedding, np.float64)) for r in frame.distinct().collect()
            if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]


def brute(rows, step, k, scale=None):
    out = {}
    if scale:
        rows = [(i, np.floor(v * scale)) for i, v in rows]
    else:
        rows = [(i, v) for i, v in rows if v.any()]
    for q, v in rows:
        if q % step == 0:
            scores = [(-float(v @ w), i) for i, w in rows if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return {q: v for q, v in out.items() if v}


def got(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shards", [100, 100_000])
def test_exact_top_k(vectors, shards):
    found = got(topk.top_k(vectors, "vec_id % 20 = 0", 10, points_per_shard=shards, queries_per_block=20))
    assert found == brute(usable(vectors), 20, 10, 1024)


def test_exact_top_k_of_large_components(spark):
    rows = rows_of([(0, [1e12, 2.0]), (1, [3e9, -5.5]), (2, [-1e12, 7.25]), (3, [0.5, 1e15])])
    frame = spark.createDataFrame(rows, SCHEMA)
    found = got(topk.top_k(frame, "vec_id = 0", 10))
    values = {r.vec_id: [math.floor(1024 * x) for x in r.embedding] for r in frame.collect()}
    expected = sorted(((-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(values[0], values[i])))), i) for i in (1, 2, 3)))
    assert found == {0: [(i, -s) for s, i in expected]}


def test_nearest_recall_and_scores(vectors):
    rows = usable(vectors)
    found, expected = got(hnsw.nearest(vectors, "vec_id % 20 = 0", 20, nodes_per_shard=300)), brute(rows, 20, 20)
    assert found.keys() == expected.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    by_id = dict(rows)
    for q, best in found.items():
        assert len(best) == len(expected[q])
        assert best == sorted(best, key=lambda r: (-r[1], r[0]))
        assert all(math.isclose(s, float(by_id[q] @ by_id[i]), rel_tol=1e-12, abs_tol=1e-12) for i, s in best)


def test_nearest_with_one_hot_vector(spark):
    """Thousands of equal vectors neither hide their neighbours nor each other; ties go to smaller ids."""
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8)
    frame = spark.createDataFrame(rows_of([(i, hot if i % 3 else rng.normal(size=8)) for i in range(3000)]), SCHEMA)
    rows = usable(frame)
    found, expected = got(hnsw.nearest(frame, "vec_id % 100 = 0", 20)), brute(rows, 100, 20)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_repeated_rows_and_empty_tables(vectors):
    twice = vectors.unionByName(vectors)
    assert got(topk.top_k(twice, "vec_id % 100 = 0", 10)) == got(topk.top_k(vectors, "vec_id % 100 = 0", 10))
    assert got(hnsw.nearest(twice, "vec_id % 100 = 0", 5)).keys() == got(hnsw.nearest(vectors, "vec_id % 100 = 0", 5)).keys()
    nothing = vectors.where("false")
    assert topk.top_k(nothing, "vec_id % 100 = 0", 10).collect() == []
    assert hnsw.nearest(nothing, "vec_id % 20 = 0", 20).collect() == []
