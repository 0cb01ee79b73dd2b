"""N-gram Jaccard join: a size-aware join of heavy and light sets.

A document's set holds the hashes of its distinct word shingles. Sets in one common order share
tokens early in that order if they are similar (prefix filtering). Small sets, up to a size
where that is cheaper, enumerate all 2-subsets of a prefix one token longer than the filter
needs, so similar small sets share a subset. Large sets put the tokens of their prefix into
inverted lists and scan those; small sets that a large one could resemble are listed too.
Prefixes of large sets are longer than necessary by a slack, hence similar ones share more than
the slack: documents with fewer shared tokens than that can have no partner and go before any
test. What remains is linked by ``linkage``: exact tests, no list expanded into pairs.

Equal sets are one item from the start, so copies cost one row each.

The boundary is where the cost of a set's subsets reaches that of its list entries; an entry
costs ``SCAN`` times a subset's row, as lists are longer.

Defined results: null and empty texts have no set, link with nothing and are their own
component. A row with a null doc_id links with nothing and has a null component. Rows that
repeat a doc_id are one document with the smallest of their texts. Hashes have 64 bits: two different shingles of a pair of
documents agree with a probability below 1e-12, which is the only inexactness. Other columns
pass through ``deduplicated`` and are not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stintwise.llm.common import mix, slices, stored_table, text_buffer
from stintwise.llm.linkage import BROADCAST_IDS, linked

WIDTH, PERCENT = 5, 75
SCAN = 2.0

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2 ** 64)
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A"):ord("Z") + 1] += 32
#: A random 64-bit number for every byte, case folded.
_letter = mix(_lower.astype(np.uint64) + np.uint64(1))
_odd = mix(np.arange(100, 100 + WIDTH, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse for i up to n, modulo 2^64."""
    out = []
    for base in (BASE, INVERSE):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def prefix_sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values[i] * BASE^i before every position, and the inverse powers: the hash of
    a stretch is the difference of its ends' sums times the inverse power of its start."""
    size = 1 << max(20, int(len(values)).bit_length())
    up, down = powers(size)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:], dtype=np.uint64)
    return sums, down


def shingles(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of the buffer."""
    n = len(bounds) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n
    word = ~_space[data]
    # One place more than bytes on both sides, so that texts and buffer end words alike.
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before = np.concatenate([[False], word[:-1]]) & ~cut[:-1]
    after = np.concatenate([word[1:], [False]]) & ~cut[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    sums, down = prefix_sums(_letter[data])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, bounds)
    size = max(0, len(hashes) - WIDTH + 1)
    runs = np.zeros(len(hashes), np.uint64)
    for k in range(WIDTH):
        runs[:size] += hashes[k:k + size] * _odd[k]
    runs = mix(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WIDTH:
            out.append(np.unique(runs[a:b - WIDTH + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * _odd[:b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix(n: int) -> int:
    """Tokens among which a set of n must share one with any similar set."""
    return n - -(-PERCENT * n // 100) + 1


def slack(n: int) -> int:
    return min(4 + n // 10, n - prefix(n))


def least_shared(n: int) -> int:
    """List entries that a set of n shares with any similar set, whatever the other's size."""
    return 1 + slack(-(-PERCENT * n // 100))


def boundary() -> int:
    """The largest size for which the 2-subsets cost no more than the list entries."""
    n = 3
    while comb(min(prefix(n + 1) + 1, n + 1), 2) <= SCAN * (prefix(n + 1) + slack(n + 1)):
        n += 1
    return n


BOUNDARY = boundary()


def keys_of(tokens: np.ndarray) -> np.ndarray:
    """A set's keys: even ones are list entries, odd ones 2-subsets. Sets below 3 are similar only if equal."""
    n = len(tokens)
    parts = []
    if 3 <= n <= BOUNDARY:
        some = tokens[:min(prefix(n) + 1, n)]
        a, b = np.triu_indices(len(some), 1)
        parts.append(mix(some[a] * _odd[0] + some[b]) | np.uint64(1))
    if n > 2 and (n > BOUNDARY or 100 * n >= PERCENT * (BOUNDARY + 1)):
        parts.append(tokens[:prefix(n) + slack(n)] & ~np.uint64(1))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n (size), a 128-bit signature of the set, its keys and the least shared list entries."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingles(*text_buffer(batch.column("text")))
            keys = [keys_of(s) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                pa.array(np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                ["doc_id", "n", "sum_a", "sum_b", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, "doc_id long, n long, sum_a long, sum_b long, keys array<long>")


def prepared(texts: pa.Array) -> list:
    return shingles(*text_buffer(texts))


def jaccard_distances(left: list, right: list) -> np.ndarray:
    """1 - |intersection| / |union|; the comparison with a quarter is exact in doubles."""
    out = np.empty(len(left))
    for k, (a, b) in enumerate(zip(left, right)):
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        both = int((b[at] == a).sum()) if len(b) else 0
        union = len(a) + len(b) - both
        out[k] = (union - both) / union if union else 1.0
    return out


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if every.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = stored_table(every.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
                            .unionByName(every.where("doc_id is null")), "one_text_each")
        found = components_of_keyed(docs)
        known = every.select("doc_id").join(found.where("doc_id is not null"), "doc_id")
        return known.unionByName(found.where("doc_id is null"))
    return components_of_keyed(every)


def components_of_keyed(docs: DataFrame) -> DataFrame:
    """As ``components_of``, for documents whose doc_ids are distinct or null."""
    sets = stored_table(shingle_sets(docs), "sets")
    narrow = sets.select("doc_id", "n", "sum_a", "sum_b")
    known = narrow.where("doc_id is not null and n > 0").distinct()
    groups = known.groupBy("n", "sum_a", "sum_b").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    members = stored_table(known.join(groups, ["n", "sum_a", "sum_b"]).select("doc_id", "n", "id", "copies"), "members")
    first = members.where("doc_id = id").select("id", F.col("n").alias("size"), "copies")

    # Keys that two documents hold, then only those of one document for each distinct set.
    entries = sets.where("doc_id is not null").select("doc_id", F.explode("keys").alias("k"))
    shared = entries.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    held = stored_table(entries.join(shared, "k").join(first, F.col("doc_id") == F.col("id"))
                        .select("k", "id", "size", F.col("copies").alias("weight")).distinct(), "shared_keys")
    # Twice: drop keys with one holder, and list entries of documents that share too few.
    smallest = F.ceil(F.col("size") * PERCENT / 100)
    cut = smallest - F.ceil(smallest * PERCENT / 100) + 1
    needed = 1 + F.least(4 + F.floor(smallest / 10), smallest - cut)

    def shared_by_two(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "k")

    for _ in range(2):
        held = shared_by_two(held).drop("c")
        enough = held.where("k % 2 = 0").groupBy("id", "size").agg(F.count("*").alias("c")).where(F.col("c") >= needed) \
            .select(F.col("id").alias("fit"))
        held = stored_table(held.join(enough, F.col("id") == F.col("fit"), "left")
                            .where("fit is not null or k % 2 <> 0").drop("fit"), "shared_keys")
    # Similar documents share the needed number of lists. In one order of all lists, by length,
    # each may leave out all but one of as many of its last: what a pair loses was left out by the
    # one that leaves out more, so a list in common stays. That takes out what unlike texts share.
    order = W.partitionBy("id", F.col("k") % 2).orderBy(F.desc("c"), "k")
    lean = shared_by_two(held).withColumn("place", F.row_number().over(order)) \
        .where((F.col("k") % 2 != 0) | (F.col("place") >= needed)).drop("c", "place")
    held = stored_table(shared_by_two(stored_table(lean, "lean_keys")), "lean_keys")
    payload = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    found = linked(held.select("k", "id", "weight"), payload, prepared, jaccard_distances, 1 - PERCENT / 100)

    per_doc = members.join(found, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component"))
    return narrow.select("doc_id", F.col("n").alias("n_shingles")).join(per_doc, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they are, that are the smallest of their component.

    Rows with a null doc_id stay. Of rows that repeat a doc_id the one with the smallest text
    stays; there are none in a keyed table, and then nothing is shuffled for them.
    """
    gone = components_of(docs).where("component_id <> doc_id").select("doc_id").distinct()
    few = gone.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
    repeated = stored_table(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"),
                            "repeated")
    if not repeated.limit(1).count():
        return kept
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(one.select("row.*"))
