"""The Merkle manifest against a plain recursive tree, and the queue of messages against sorting."""

import heapq
import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from stintwise.llm import manifest as own


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Root, and for every node its siblings level by level with its places."""
    paths, groups = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        after, merged = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a:a + 3]
            for place, k in enumerate(range(a, a + len(run))):
                for member in groups[k]:
                    paths[member].append((run[:place], run[place + 1:]))
            after.append(h("".join(run)))
            merged.append([m for k in range(a, a + len(run)) for m in groups[k]])
        nodes, groups = after, merged
    return nodes[0], paths


def by_hand(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append((r["doc_id"], leaf(r, r["text"]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = climb([x[1] for x in sources[s]])
    if not rows:
        return []
    root, tops = climb([trees[s][0] for s in order])
    want = []
    for k, s in enumerate(order):
        for (doc_id, own_leaf, r), path in zip(sources[s], trees[s][1]):
            path = path + tops[k]
            text = r["text"]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            at = leaf(r, text)
            for left, right in path:
                at = h("".join(left) + at + "".join(right))
            proof = h("".join(d for left, right in path for d in left + right))
            want.append((doc_id, own_leaf, trees[s][0], root, proof, at, at == root))
    return sorted(want, key=repr)


@pytest.mark.parametrize("name, chosen", [
    ("corpus", {}), ("repeated", {"levels": 1, "memory": 200, "partition_rows": 7}),
    ("repeated", {"levels": 2, "memory": 1, "partition_rows": 5}), ("nothing", {})])
def test_manifest_equals_a_plain_tree(spark, request, name, chosen):
    docs = request.getfixturevalue(name).withColumns({"key": F.lit("x"), "pos": F.lit(1), "digest": F.lit(2), "block": F.lit(3)})
    got = own.manifest(docs, **chosen)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_one_source_of_any_size(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"),
                                 F.lit(2).cast("long").alias("n_chars"), F.lit("a\n").alias("text"))
    got = own.manifest(docs, levels=2, memory=500)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand([r.asDict() for r in docs.collect()])


def test_every_row_a_source_and_many_levels(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), "id").alias("source"), F.lit("en").alias("lang"),
                                  F.lit(None).cast("long").alias("n_chars"), F.lit("x\ny").alias("text"))
    got = own.manifest(docs, levels=1, memory=300, partition_rows=6)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("memory", [1, 400, 1 << 20])
@pytest.mark.parametrize("sign", [1, -1])
def test_messages_come_in_order_whatever_is_spilled(memory, sign):
    rng = random.Random(memory)
    queue, plain, label = own.Messages(sign, memory), [], 0
    for step in range(2000):
        for _ in range(rng.randint(0, 3)):
            to, place, payload = label + sign * rng.randint(1, 50), rng.randint(0, 2), rng.randbytes(rng.randint(0, 90))
            queue.push(to, place, payload)
            heapq.heappush(plain, (sign * to, place, payload))
        label += sign
        want = []
        while plain and plain[0][0] == sign * label:
            want.append(heapq.heappop(plain)[2])
        assert sorted(queue.take(label)) == sorted(want)
    assert (queue.spills > 5) == (memory <= 400)


def test_registered_blocks_spill():
    """A full block of the registered size sends more than its queues hold."""
    spilled = []

    class Counted(own.Messages):
        def close(self):
            spilled.append(self.spills)
            super().close()

    leaves = [sha256(str(k).encode()).digest() for k in range(own.FAN ** own.LEVELS)]
    plain, own.Messages = own.Messages, Counted
    try:
        digests = own.upward(leaves, own.LEVELS)
        proofs = list(own.downward(digests, len(leaves), own.LEVELS, b""))[::-1]
    finally:
        own.Messages = plain
    assert min(spilled) > 0
    for k in (0, 1, 1234, len(leaves) - 1):
        assert own.folded(leaves[k], proofs[k], own.turns(k, len(leaves))) == digests[-32:]
