"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

Documents become token ids and one end id, are cut into pieces no longer than a sequence, and
the pieces are packed. Pieces of one length are interchangeable, so the packing itself works on
the counts by length: at most ``capacity`` numbers, whatever the corpus. A bin is filled
greedily with the longest lengths that fit; then its smallest member is replaced by the two
unpacked lengths that fit its expanded gap most tightly, as long as that fills it further. The
same bin is repeated while its lengths last, so the packing ends after a few thousand patterns.
A piece finds its sequence and offset from its rank among the pieces of its length.

Defined results: null and empty texts are one piece of the end id alone. Repeated rows and
repeated or null doc_ids are packed row by row. Other columns of the documents are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tiktoken import Encoding
from tokenizers import Tokenizer

from stintwise.llm.common import slices, stored_table

CAPACITY = 2048
END_ID = 0
#: Fixed value: the pattern by which byte-level BPE of this family cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, Encoding] = {}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for
    themselves, the others follow from U+0100 on in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_encoder(path: str) -> Encoding:
    """The vocabulary file's byte-level BPE, its ids serving as merge ranks.

    That holds when every merge makes the next id, which is checked. Texts are split at the
    file's added tokens, which have ids of their own. The encoder gives the ids that the
    vocabulary's own library gives, about four times as fast; a test compares them.
    """
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, marks = whole["model"], whole.get("added_tokens") or []
    letters, vocab = byte_letters(), model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError(f"{path}: the merges are not in the order of their ids")
    added = set(vocab) - {"".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]} - set(letters)
    for mark in marks:
        if any(mark.get(rule) for rule in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: the added token {mark['content']!r} has rules of its own")
    special = {mark["content"]: mark["id"] for mark in marks}
    added |= set(special)
    ranks = {bytes(letters[c] for c in piece): i for piece, i in vocab.items() if piece not in added}
    return Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder(path: str) -> Encoding:
    if path not in _encoders:
        _encoders[path] = load_encoder(path)
    return _encoders[path]


_libraries: dict[str, Tokenizer] = {}


def ids_of(path: str, text: str) -> list[int]:
    """Token ids of any text. Blanks or line feeds by the hundred thousand in a row are more than the encoder's
    pattern can be matched against; such a text goes to the vocabulary's own library, whole."""
    try:
        return encoder(path).encode(text, allowed_special="all")
    except ValueError:
        if path not in _libraries:
            _libraries[path] = Tokenizer.from_file(path)
        return _libraries[path].encode(text, add_special_tokens=False).ids


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    Only documents longer than ``capacity`` tokens are cut; the first piece takes the rest.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(5 + ids)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = np.array(ids_of(tokenizer, text or ""), "<u4").tobytes() + end
                n = len(raw) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = raw[4 * a:4 * b]
                    values = (doc, k, a, b - a, zlib.crc32(part))
                    for store, v in zip(out, values):
                        store.append(v)
                    if ids:
                        out[5].append(np.frombuffer(part, "<u4").astype(np.int64))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)],
                                             schema.replace(" long", "").replace(" int", "").replace(" array<long>", "").split(", "))

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def tightest_two(free: dict[int, int], room: int, more_than: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (more_than, room], by two pointers."""
    have = sorted(n for n, c in free.items() if c > 0 and n < room)
    low, high, best, found = 0, len(have) - 1, more_than, None
    while low <= high:
        total = have[low] + have[high]
        if total > room:
            high -= 1
            continue
        if total > best and (low != high or free[have[low]] > 1):
            best, found = total, (have[high], have[low])
            if best == room:
                break
        low += 1
    return found


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Patterns (first sequence, number of sequences, [(length, copies), ...]) that use up the counts."""
    free = {n: c for n, c in counts.items() if c}
    patterns, sequence = [], 0
    while free:
        used: dict[int, int] = {}
        gap, limit = capacity, capacity
        while gap:
            fitting = [n for n, c in free.items() if c > 0 and n <= min(gap, limit)]
            if not fitting:
                break
            n = max(fitting)
            k = min(gap // n, free[n])
            used[n] = used.get(n, 0) + k
            free[n] -= k
            gap -= k * n
            limit = n
        while gap:
            least = min(used)
            two = tightest_two(free, gap + least, least)
            if two is None:
                break
            used[least] -= 1
            free[least] += 1
            if not used[least]:
                del used[least]
            for n in two:
                used[n] = used.get(n, 0) + 1
                free[n] -= 1
            gap += least - sum(two)
        more = min(free[n] // k for n, k in used.items())
        for n, k in used.items():
            free[n] -= more * k
        patterns.append((sequence, more + 1, sorted(used.items(), reverse=True)))
        sequence += more + 1
        free = {n: c for n, c in free.items() if c}
    return patterns


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_group: int = 50_000) -> DataFrame:
    """``pieces`` (with ``length``) plus sequence_id and offset, gapless from 0 in every sequence.

    ``pieces`` is read three times and should be a stored table. Ranks within a length come
    from groups of a length and a hash, so that a common length is spread over tasks.
    """
    keys = [c for c in pieces.columns if c != "ids"]
    total = pieces.count()
    groups = max(1, -(-total // rows_per_group))
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    counts = stored_table(parted.groupBy("length", "part").agg(F.count("*").alias("n")), "length_counts")
    by_length = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    if by_length and max(by_length) > capacity:
        raise ValueError(f"a piece of {max(by_length)} tokens exceeds the capacity of {capacity}")
    before = counts.select("length", "part", (F.sum("n").over(
        W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    ranked = parted.withColumn("place", F.row_number().over(W.partitionBy("length", "part").orderBy(*keys)) - 1) \
        .join(before, ["length", "part"]) \
        .withColumn("place", F.col("place") + F.coalesce("before", F.lit(0))).drop("part", "before")

    # For every length: the ranks at which runs begin, with what places a rank in its run.
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    for sequence, times, members in pack_counts(by_length, capacity):
        offset = 0
        for n, k in members:
            runs.setdefault(n, []).append((taken.get(n, 0), sequence, k, offset))
            taken[n] = taken.get(n, 0) + times * k
            offset += n * k
    table = {n: np.array(r, np.int64) for n, r in runs.items()}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    kept = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("place").to_numpy(zero_copy_only=False)
            out = np.zeros((2, len(rank)), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, sequence, k, offset = table[int(n)][
                    np.searchsorted(table[int(n)][:, 0], rank[at], side="right") - 1].T
                out[0, at] = sequence + (rank[at] - first) // k
                out[1, at] = offset + (rank[at] - first) % k * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, out)], [*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "place").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return pack(stored_table(token_pieces(docs, tokenizer, capacity, end_id, ids), "pieces"), capacity)
