"""Exact dedup by counting quotient filters, with a check of the bytes behind them.

Every text has a fingerprint of up to 64 bits. Each partition keeps its fingerprints in counting
quotient filters, one for each range of fingerprints. A filter splits a fingerprint into a
quotient, which is the slot where its run belongs, and a remainder, which the run holds in sorted
order; two bits for each slot say which quotients have a run and where runs end, a third marks
slots that hold digits of the count of the remainder before them. The filters of one range merge
without loss, since each gives its fingerprints back in order of quotient and remainder. What the
merged filters count once stands for one row and is done. The rest is routed to verification:
their texts are grouped by the bytes themselves, so fingerprints that collide part again.

Texts are shuffled only if their fingerprint is repeated, and combined before that, so a text
that a third of all rows share is one row of each task. A range holds a bounded number of
fingerprints. Rows find their class by fingerprint and digest; large classes are broadcast,
at most rows / ``hot_rows`` of them.

Defined results: a null text counts as empty. Of equal texts the row with the largest doc_id stays
(null is smaller than any id); of rows that share that doc_id too, one stays. An empty table gives
no rows. Other columns are not read by ``decisions`` and kept as they are by ``deduplicated``.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.llm.common import stored_table

FINGERPRINT_BITS = 64
#: Fingerprints in a filter of one partition before the next one starts, and in one range.
FILTER_ROWS = 1 << 20
RANGE_ROWS = 1 << 20
LEAST_RANGE_BITS = 4
#: Rows of a few numbers that may be broadcast; rows of a class that is joined apart.
BROADCAST_ROWS = 1_000_000
HOT_ROWS = 100_000
HEADER = struct.Struct("<BBQQ")


def unchanged(text: Column) -> Column:
    return text


def encoded(values: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter of ascending distinct ``values`` of so many bits, with counts from 1."""
    repeated = int((counts > 1).sum())
    q = min(bits, max(1, int(np.ceil(np.log2(max(1, (len(values) + repeated) / 0.75))))))
    r = bits - q
    width = max(1, -(-r // 8))
    quotients = (values >> np.uint64(r)).astype(np.int64)
    digits, rest = np.zeros(len(values), np.int64), counts.astype(np.uint64) - np.uint64(1)
    more = rest.copy()
    while more.any():
        digits += more > 0
        more = more >> np.uint64(8 * width) if width < 8 else np.zeros_like(more)
    size = 1 + digits
    first = np.flatnonzero(np.r_[True, quotients[1:] != quotients[:-1]]) if len(values) else np.zeros(0, np.int64)
    length = np.add.reduceat(size, first) if len(values) else np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    # A run starts at its quotient's slot, or where the run before it ends.
    start = before + np.maximum.accumulate(quotients[first] - before) if len(values) else before
    slots = max(1 << q, int(start[-1] + length[-1]) if len(values) else 0)
    run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(values)]))
    at = start[run] + (np.cumsum(size) - size) - before[run]
    table, counter = np.zeros(slots, "<u8"), np.zeros(slots, bool)
    table[at] = values & np.uint64((1 << r) - 1)
    for d in range(int(digits.max()) if len(values) else 0):
        some = digits > d
        table[at[some] + 1 + d] = rest[some] >> np.uint64(8 * width * d) & np.uint64((1 << 8 * width) - 1)
        counter[at[some] + 1 + d] = True
    occupied, ends = np.zeros(1 << q, bool), np.zeros(slots, bool)
    occupied[quotients] = True
    ends[start + length - 1] = True
    # The two bits tell which slots are in use, so only those are written.
    used = np.repeat(start - before, length) + np.arange(length.sum())
    return b"".join([HEADER.pack(q, r, slots, len(used)), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
                     np.packbits(counter[used]).tobytes(), table[used].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()])


def decoded(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ascending values of a filter and their counts."""
    q, r, slots, in_use = HEADER.unpack_from(blob)
    width = max(1, -(-r // 8))
    raw, at = np.frombuffer(blob, np.uint8), HEADER.size

    def flags(n: int) -> np.ndarray:
        nonlocal at
        part = raw[at:at + -(-n // 8)]
        at += len(part)
        return np.unpackbits(part, count=n).astype(bool)

    occupied, ends, is_digit = flags(1 << q), flags(slots), flags(in_use)
    table = np.zeros((in_use, 8), np.uint8)
    table[:, :width] = raw[at:].reshape(in_use, width)
    held = table.view("<u8").ravel()
    runs, last = np.flatnonzero(occupied), np.flatnonzero(ends)
    start = np.maximum(runs, np.r_[0, last[:-1] + 1]) if len(runs) else runs
    length = last - start + 1
    entry = np.flatnonzero(~is_digit)
    values = np.repeat(runs, length).astype(np.uint64)[entry] << np.uint64(r) | held[entry]
    counts = np.ones(len(entry), np.uint64)
    digit = np.flatnonzero(is_digit)
    owner = np.searchsorted(entry, digit) - 1
    np.add.at(counts, owner, held[digit] << (np.uint64(8 * width) * (digit - entry[owner] - 1).astype(np.uint64)))
    return values, counts


def merged(blobs: list[bytes], bits: int) -> bytes:
    """One filter that counts what all filters count."""
    parts = [decoded(b) for b in blobs]
    values, counts = np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return encoded(values[first], np.add.reduceat(counts, first) if len(values) else counts, bits)


def fingerprint(text: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits) if bits < 64 else F.xxhash64(text)


def partition_filters(prints: DataFrame, bits: int, range_bits: int, filter_rows: int = FILTER_ROWS) -> DataFrame:
    """Filters of every partition of ``prints``: range, filter."""
    low = bits - range_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(values >> np.uint64(low), np.arange((1 << range_bits) + 1, dtype=np.uint64))
            out = [(k, encoded(values[a:b] & np.uint64((1 << low) - 1), counts[a:b], low))
                   for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if a < b]
            return pa.record_batch([pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())],
                                   ["range", "filter"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            rows += batch.num_rows
            if rows >= filter_rows:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return prints.select("print").mapInArrow(build, "range int, filter binary")


def merged_filters(filters: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """One filter for each range: range, filter."""
    low = bits - range_bits

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"range": table.column("range")[:1], "filter": pa.array([merged(table.column("filter").to_pylist(), low)],
                                                                               pa.binary())})

    return filters.groupBy("range").applyInArrow(merge, "range int, filter binary")


def repeated_prints(filters: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """Fingerprints that the filters count more than once: print, copies."""
    low = bits - range_bits

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values, counts = decoded(blob)
                some = counts > 1
                whole = (values[some] | np.uint64(part << low)).view(np.int64)
                yield pa.record_batch([pa.array(whole), pa.array(counts[some].astype(np.int64))], ["print", "copies"])

    return filters.select("range", "filter").mapInArrow(read, "print long, copies long")


def decisions(docs: DataFrame, normal: Callable[[Column], Column] = unchanged, bits: int = FINGERPRINT_BITS,
              filter_rows: int = FILTER_ROWS, range_rows: int = RANGE_ROWS, broadcast_rows: int = BROADCAST_ROWS,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, and twins, the number of
    rows that share the doc_id and the text of the row that stays (1 for all others).

    ``normal`` turns a text column into the one that is compared.
    """
    texts = docs.select(F.col("doc_id"), normal(F.coalesce(F.col("text"), F.lit(""))).alias("text")) \
        .withColumn("print", fingerprint(F.col("text"), bits))
    rows = stored_table(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "print",
                                     F.unhex(F.sha2(F.col("text"), 256)).alias("digest")), "prints")
    total = rows.count()
    range_bits = min(bits - 1, max(LEAST_RANGE_BITS, (max(1, total // range_rows) - 1).bit_length()))
    filters = merged_filters(partition_filters(rows, bits, range_bits, filter_rows), bits, range_bits)
    suspects = stored_table(repeated_prints(filters, bits, range_bits), "repeated")

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    same = texts.join(small(suspects).select("print"), "print", "left_semi").groupBy("print", "text") \
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Classes were told apart by their bytes; a row finds its own by fingerprint and digest, which must name one.
    classes = stored_table(
        same.select("print", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), "keep_id", "group_size")
        .groupBy("print", "digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
                                        F.count(F.lit(1)).alias("texts"))
        .select("print", "digest", "keep_id",
                F.when(F.col("texts") == 1, F.col("group_size"))
                .otherwise(F.raise_error(F.lit("two texts share fingerprint and digest")).cast("long")).alias("group_size")), "classes")
    key = ["print", "digest"]
    if classes.count() <= broadcast_rows:
        found = rows.join(F.broadcast(classes), key, "left")
    else:
        hot = F.broadcast(classes.where(F.col("group_size") >= hot_rows))
        found = rows.join(hot, key).unionByName(
            rows.join(hot, key, "left_anti").join(classes.where(F.col("group_size") < hot_rows), key, "left"))
    found = stored_table(found.withColumns({"alone": F.col("group_size").isNull(),
                                            "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
                         .withColumn("keep_id", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("keep_id"))), "found")
    # Rows that share text and largest doc_id: one of them stays.
    twins = stored_table(found.where((F.col("group_size") > 1) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
                         .groupBy(*key).agg(F.max("row").alias("stays"), F.count(F.lit(1)).alias("twins")).where("twins > 1"), "twins")
    return found.join(small(twins), key, "left").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.coalesce(F.col("row") == F.col("stays"), F.lit(True))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.when(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.coalesce("twins", F.lit(1).cast("long"))).otherwise(F.lit(1))
        .alias("twins"))


def deduplicated(docs: DataFrame, normal: Callable[[Column], Column] = unchanged, **settings: int) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    judged = stored_table(decisions(docs, normal, **settings), "decisions")
    names = docs.columns
    keyed = docs.withColumn("_digest", F.sha2(normal(F.coalesce(F.col("text"), F.lit(""))), 256))

    def of(df: DataFrame) -> DataFrame:
        return df.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()

    same = keyed["doc_id"].eqNullSafe(F.col("_id")) & (keyed["_digest"] == F.col("_sha"))
    dropped = of(judged.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))))
    twins = of(judged.where("twins > 1"))
    single = keyed.join(dropped, same, "left_anti").join(twins, same, "left_anti").select(*names)
    return single.unionByName(keyed.join(twins, same, "left_semi").dropDuplicates(["doc_id", "_digest"]).select(*names))
