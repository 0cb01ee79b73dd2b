"""Suffix-array dedup: remove every byte of a long string that also starts earlier.

A string of ``length`` bytes (100) that occurs twice must be found wherever it occurs, without
sorting all suffixes of the corpus together. Each window of that length picks an anchor, the
24 bytes in it with the smallest hash, so equal windows pick equal anchors. Runs of windows with
one anchor become pieces of text; anchors that occur once in the corpus cannot belong to a
repeated window and go. The others' pieces are dealt to shards by anchor, equal pieces counted
once, and every shard is sorted by external induced sorting (``induce``), which carries
the common-prefix lengths: neighbours that share ``length`` bytes are one window, of which the
earliest start stays and all others go.

An anchor more frequent than ``hot`` would fill a shard on its own. Its windows become pieces
of their own, dealt by their own hashes and counted once per task: equal ones meet, the others
are spread.

An anchor all of whose pieces are equal needs no sorting: its windows agree with no others.

Order of starts: doc_id, null first, then position. Rows that repeat a doc_id are documents of
their own, ordered by text; of exactly repeated rows one counts as the first. Null texts are
empty; texts shorter than ``length`` lose nothing. Other columns pass through
``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.common import mix, slices, stored_table, text_buffer
from stintwise.llm.induce import sorted_suffixes
from stintwise.llm.jaccard import prefix_sums

LENGTH, GRAM = 100, 24
SHARD_BYTES = 3_000_000
HOT = 50_000
#: Bytes of one text whose windows are found at a time; 24 bits hold a position among them.
STRETCH = 8_000_000
#: Piece bytes that a task remembers to count equal pieces once.
REMEMBERED = 12_000_000

_byte = mix(np.arange(1, 257, dtype=np.uint64))


def runs(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window, anchor hash) of every run of windows with one anchor."""
    grams = length - GRAM + 1
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    sums, down = prefix_sums(_byte[data])
    hashes = mix((sums[GRAM:] - sums[:-GRAM]) * down[:len(sums) - GRAM])
    place = np.uint64(24)
    # The upper 40 bits of the hash decide, then the position: the first of equal ones.
    key = (hashes >> place << place) | np.arange(len(hashes), dtype=np.uint64)
    least, span = key, 1
    while span * 2 <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if grams > span:
        least = np.minimum(least[:len(key) - grams + 1], least[grams - span:][:len(key) - grams + 1])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(anchor)]
    ends = bounds[1:][text]
    start = np.arange(len(anchor))
    inside = start + length <= ends
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]) & inside
    first = np.flatnonzero(new)
    # A run ends before the next one begins, or with the last window of its text.
    last = np.minimum(np.append(first[1:], len(anchor) + length) - 1, ends[first] - length)
    of = text[first]
    return of, first - bounds[of], last - bounds[of], hashes[anchor[first]]


def stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Batches of whole texts, or one long text in stretches that overlap by a window less a byte."""
    for batch in slices(batches, "text"):
        data, bounds = text_buffer(batch.column("text"))
        if len(data) <= STRETCH:
            yield batch, data, bounds, 0
            continue
        for at in range(0, len(data) - length + 1, STRETCH - length + 1):
            part = data[at:at + STRETCH]
            yield batch, part, np.array([0, len(part)]), at


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, row): a number that orders the documents, and all columns as a struct.

    The doc_id itself where that is a key. Otherwise a number that rises along the rows sorted
    by doc_id and text, stored so that it stays.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    doc_id = F.col("row.doc_id").cast("long")
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if not ids.where("n > 1 or doc_id is null").limit(1).count():
        return rows.select(doc_id.alias("doc"), "row")
    sorted_rows = rows.orderBy(doc_id.asc_nulls_first(), F.coalesce("row.text", F.lit("")))
    return stored_table(sorted_rows.select(F.monotonically_increasing_id().alias("doc"), "row"), "numbered")


def runs_of(rows: DataFrame, length: int) -> DataFrame:
    """doc, key and span (first window * 256 + further windows) for every run of windows."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds, at in stretches(batches, length):
            of, low, high, key = runs(data, bounds, length)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(of)), pa.array(key.view(np.int64)), pa.array((low + at) * 256 + high - low)],
                ["doc", "key", "span"])

    return rows.select("doc", F.col("row.text").alias("text")).mapInArrow(find, "doc long, key long, span long")


def packed(rows: DataFrame) -> DataFrame:
    """(doc, rest, text): the other columns as a struct, the text compressed for the shuffle."""
    rest = F.struct(*[F.col("row").getField(f.name).alias(f.name) for f in rows.schema["row"].dataType if f.name != "text"])
    flat = rows.select("doc", rest.alias("rest"), F.col("row.text").alias("text"))
    kind = flat.schema["rest"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            text = [None if t is None else compress(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("rest"), pa.array(text, pa.binary())],
                                             ["doc", "rest", "text"])

    return flat.mapInArrow(pack, f"doc long, rest {kind}, text binary")


def unpacked(column: pa.Array) -> Iterator[bytes | None]:
    expand = zstandard.ZstdDecompressor().decompress
    for text in column.to_pylist():
        yield None if text is None else expand(text)


def cut_pieces(rows: DataFrame, length: int) -> DataFrame:
    """key, piece, doc and low of all runs; equal pieces of a task once, with the earliest start.

    ``rows``: doc, rest, text and runs, an array of (key, span, hot).
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], tuple[int, int]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            columns = zip(*((*name, *start) for name, start in seen.items()))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "piece", "doc", "low"])

        for batch in batches:
            lists = batch.column("runs")
            flat = lists.flatten()
            spans = flat.field("span").to_numpy(zero_copy_only=False)
            keys = flat.field("key").to_numpy(zero_copy_only=False).tolist()
            lows, ends = (spans >> 8).tolist(), ((spans >> 8) + (spans & 255) + length).tolist()
            hots = flat.field("hot").to_numpy(zero_copy_only=False).tolist()
            at = 0
            for doc, raw, n in zip(batch.column("doc").to_pylist(), unpacked(batch.column("text")), lists.value_lengths().to_pylist()):
                for key, low, end, hot in zip(keys[at:at + n], lows[at:at + n], ends[at:at + n], hots[at:at + n]):
                    names = [(key, raw[low:end], low)] if not hot else [
                        (int.from_bytes(hashlib.blake2b(raw[k:k + length], digest_size=8).digest(), "little", signed=True),
                         raw[k:k + length], k) for k in range(low, end - length + 1)]
                    for name, piece, begin in names:
                        known = seen.get((name, piece))
                        if known is None:
                            seen[name, piece] = (doc, begin)
                            size += len(piece)
                        elif (doc, begin) < known:
                            seen[name, piece] = (doc, begin)
                at += n
                if size > REMEMBERED:
                    yield out()
                    seen.clear()
                    size = 0
        if seen:
            yield out()

    return rows.mapInArrow(cut, "key long, piece binary, doc long, low long")


def first_windows(doc: np.ndarray, low: np.ndarray, data: np.ndarray, bounds: np.ndarray, length: int,
                  memory: int) -> np.ndarray:
    """Which windows of the pieces, end to end, start nowhere earlier; by sorting the pieces' suffixes."""
    sizes = np.diff(bounds)
    n = len(sizes)
    # Symbols are bytes from 1 on, 0 after every piece.
    text = np.zeros(len(data) + n, np.uint16)
    starts = bounds[:-1] + np.arange(n)
    text[np.arange(len(data)) + np.repeat(np.arange(n), sizes)] = data.astype(np.uint16) + 1
    piece_at = np.repeat(np.arange(n, dtype=np.int32), sizes + 1)
    by_rank = np.lexsort((low, doc))
    rank = np.empty(n, np.int64)
    rank[by_rank] = np.arange(n)
    windows = sizes - length + 1
    window_at = np.concatenate([[0], np.cumsum(windows)])
    kept = np.zeros(window_at[-1], bool)

    def keep(order: np.ndarray) -> None:
        kept[window_at[by_rank[order >> 8]] + (order & 255)] = True

    carry = -1  # the earliest start of the group that the last block ended in
    for positions, shared in sorted_suffixes(text, length, memory):
        piece = piece_at[positions]
        at = positions - starts[piece]
        cut = np.cumsum(shared < length)
        valid = at < windows[piece]
        order, group = (rank[piece] * 256 + at)[valid], cut[valid]
        if carry >= 0:
            if len(group) and group[0] == 0:
                order, group = np.append(carry, order), np.append(0, group)
            elif cut[-1]:
                keep(np.array([carry]))
            else:
                continue
        carry = -1
        if not len(order):
            continue
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.minimum.reduceat(order, begins)
        if group[-1] == cut[-1]:
            carry, least = int(least[-1]), least[:-1]
        keep(least)
    if carry >= 0:
        keep(np.array([carry]))
    return kept


def shard_firsts(pieces: DataFrame, length: int, memory: int) -> DataFrame:
    """doc, low, high of the runs of windows that start nowhere earlier; a partition is a shard."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, bytes], tuple[int, int]] = {}
        for batch in batches:
            for *name, doc, low in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "doc", "low"))):
                name = tuple(name)
                known = best.get(name)
                if known is None or (doc, low) < known:
                    best[name] = (doc, low)
        if not best:
            return
        kinds = Counter(key for key, _ in best)
        alone = [(doc, low, low + len(piece) - length) for (key, piece), (doc, low) in best.items() if kinds[key] == 1]
        doc, low, high = (np.array(c, np.int64) for c in (zip(*alone) if alone else ((), (), ())))
        several = [(piece, start) for (key, piece), start in best.items() if kinds[key] > 1]
        del best, alone, kinds
        if several:
            own_doc, own_low = (np.array(c, np.int64) for c in zip(*(start for _, start in several)))
            bounds = np.concatenate([[0], np.cumsum([len(p) for p, _ in several])])
            data = np.frombuffer(b"".join(p for p, _ in several), np.uint8)
            del several
            kept = first_windows(own_doc, own_low, data, bounds, length, memory)
            window_at = np.concatenate([[0], np.cumsum(np.diff(bounds) - length + 1)])
            # Runs of kept windows, cut where pieces meet.
            edge = np.zeros(len(kept) + 1, bool)
            edge[window_at] = True
            begin = np.flatnonzero(kept & np.concatenate([[True], ~kept[:-1] | edge[1:-1]]))
            end = np.flatnonzero(kept & np.concatenate([~kept[1:] | edge[1:-1], [True]]))
            of = np.searchsorted(window_at, begin, side="right") - 1
            doc, low, high = (np.concatenate(pair) for pair in (
                (doc, own_doc[of]), (low, own_low[of] + begin - window_at[of]), (high, own_low[of] + end - window_at[of])))
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(low), pa.array(high)], ["doc", "low", "high"])

    return pieces.mapInArrow(rows, "doc long, low long, high long")


def with_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, memory: int = 4_000_000,
               shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """rest, text (see ``packed``) and the starts and ends of the spans to remove (null if there are none).

    The texts are shuffled compressed, once to cut the pieces and once for the result.
    """
    rows = keyed(docs)
    found = runs_of(rows, length)
    shared = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    by_doc = stored_table(found.join(shared, "key").groupBy("doc").agg(
        F.collect_list(F.struct("key", "span", (F.col("n") > hot).alias("hot"))).alias("runs")), "runs_by_doc")
    total = by_doc.agg(F.sum(F.aggregate(
        "runs", F.lit(0).cast("long"), lambda t, r: t + F.pmod(r["span"], F.lit(256)) + length))).first()[0]
    shards = max(1, -(-(total or 0) // shard_bytes))
    whole = packed(rows)
    firsts = shard_firsts(cut_pieces(whole.join(by_doc, "doc"), length).repartition(shards, "key"), length, memory) \
        .groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("firsts"))
    every = by_doc.select("doc", F.transform("runs", lambda r: r["span"]).alias("spans")).join(firsts, "doc", "left")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for all_, kept in zip(batch.column("spans").to_pylist(), batch.column("firsts").to_pylist()):
                a, b = removed([(s >> 8, (s >> 8) + (s & 255)) for s in all_],
                               [(r["low"], r["high"]) for r in kept or []], length)
                starts.append(a)
                ends.append(b)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(starts, kind), pa.array(ends, kind)],
                                             ["doc", "starts", "ends"])

    gone = every.mapInArrow(spans, "doc long, starts array<long>, ends array<long>").where("size(starts) > 0")
    return whole.join(gone, "doc", "left").select("rest", "text", "starts", "ends")


def removed(every: list[tuple[int, int]], kept: list[tuple[int, int]], length: int) -> tuple[list[int], list[int]]:
    """Maximal stretches covered by the windows of ``every`` run (first, last) that no run of ``kept`` holds."""
    stay = sorted(kept)
    starts: list[int] = []
    ends: list[int] = []

    def cover(low: int, high: int) -> None:
        if starts and low <= ends[-1]:
            ends[-1] = max(ends[-1], high + length)
        else:
            starts.append(low)
            ends.append(high + length)

    k = 0
    for low, high in sorted(every):
        while k < len(stay) and stay[k][0] <= high:
            if stay[k][0] > low:
                cover(low, stay[k][0] - 1)
            low = stay[k][1] + 1
            k += 1
        if low <= high:
            cover(low, high)
    return starts, ends


def rest_of(raw: bytes, starts: list[int], ends: list[int]) -> bytes:
    """The bytes outside the spans."""
    return b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)]))


def digests(docs: DataFrame, length: int = LENGTH, **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for raw, a, b in zip(unpacked(batch.column("text")), batch.column("starts").to_pylist(),
                                 batch.column("ends").to_pylist()):
                raw, a, b = raw or b"", a or [], b or []
                for store, v in zip(out, (len(raw), sum(b) - sum(a), len(a), hashlib.sha256(rest_of(raw, a, b)).hexdigest())):
                    store.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 3 + (pa.string(),)))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, **limits).select(
        F.col("rest.doc_id").alias("doc_id"), "text", "starts", "ends").mapInArrow(
        digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, **limits: int) -> DataFrame:
    """The documents, other columns as they are, with the repeated bytes cut out of their texts.

    A cut inside a character drops the bytes of it that stay. n_chars, where it is a column, is
    made anew for the texts that changed.
    """
    found = with_spans(docs, length, **limits)
    kind = found.schema["rest"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if raw is None else rest_of(raw, a or [], b or []).decode(errors="ignore") for raw, a, b in zip(
                unpacked(batch.column("text")), batch.column("starts").to_pylist(), batch.column("ends").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string()), batch.column("starts").is_valid()],
                                             ["rest", "kept", "changed"])

    done = found.mapInArrow(cut, f"rest {kind}, kept string, changed boolean")
    made = {c: F.col("rest").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in made:
        made["n_chars"] = F.when(F.col("changed"), F.length("kept").cast("long")).otherwise(made["n_chars"])
    return done.select(*[made[c].alias(c) for c in docs.columns])
