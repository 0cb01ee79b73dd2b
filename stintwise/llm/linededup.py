"""Line dedup: a segment-partition edit join over the distinct lines of all documents.

Lines of at least ``SHORTEST`` characters within ``TAU`` edits (insertions, deletions, changes of one
character) of each other are linked; a class is what links connect. The first line of a class
stays, by document and line number, and all others are removed from their documents.

A line is cut into TAU + 1 segments of almost equal length; of two lines within TAU edits the
shorter has a segment that the longer holds unchanged, near the same place. Index keys name a
segment by the line's length, the segment's number and its hash; probe keys name, for every
length up to TAU shorter, the substrings where such a segment may lie (at most TAU + 1 shifts,
cut down from both ends of the line). Lines that share a key are linked by ``linkage``, which
expands no list into pairs; distances come from a banded bit-parallel computation that runs
over many pairs at once. Equal lines are one item from the start, by 64-bit hashes.

Defined results: lines are what line feeds separate. Shorter and empty lines always stay. Null
texts stay null and have no lines, empty texts one empty line. Documents are ordered by doc_id,
null first, rows that repeat a doc_id by a hash of the text; exactly repeated rows are one
document. A document may lose all its lines; its row stays with an empty text. Other columns
pass through ``without_repeated_lines``; n_chars, where it is one, is made anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.common import give_back, mix, slices, stored_table, text_buffer
from stintwise.llm.jaccard import prefix_sums
from stintwise.llm.linkage import BROADCAST_IDS, linked

TAU, SHORTEST = 2, 24
#: Distinct lines that a task remembers to make the keys of each once.
REMEMBERED = 1_000_000
#: Text bytes that a task works on at a time, in buffers of about fifty times the size; a longer text is whole.
BATCH_BYTES = 250_000


def lines_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(characters, text, start, end) of all lines of the buffer, in order."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = heads[bounds]
    feeds = np.flatnonzero(chars == 10)
    starts = np.sort(np.concatenate([at[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([at[1:], feeds]), kind="stable")
    text = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at[1:], feeds, side="right")])
    return chars, np.sort(text, kind="stable"), starts, ends


def segment(length: np.ndarray, number: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of a segment of lines of the given lengths; the last ones are longer by one."""
    short, longer = length // (tau + 1), length % (tau + 1)
    first_long = tau + 1 - longer
    start = number * short + np.maximum(number - first_long, 0)
    return start, short + (number >= first_long)


def line_keys(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tau: int) -> np.ndarray:
    """A column of keys per probe; 0 where a probe does not fit the line."""
    out = []
    for shorter in range(tau + 1):
        other = lengths - shorter
        for number in range(tau + 1):
            start, size = segment(other, number, tau)
            low, high = max(-number, shorter - (tau - number)), min(number, shorter + tau - number)
            for shift in range(low, high + 1):
                at = start + shift
                fits = (at >= 0) & (at + size <= lengths)
                a = starts + np.where(fits, at, 0)
                b = a + np.where(fits, size, 0)
                name = mix((sums[b] - sums[a]) * down[a] + other.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                           + np.uint64(number + 1))
                out.append(np.where(fits, name | np.uint64(1), np.uint64(0)))
    return np.stack(out, axis=1)


def line_rows(rows: DataFrame, tau: int, shortest: int) -> DataFrame:
    """doc, mark, line, id and keys for every line that counts; keys once per task and distinct line."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in slices(batches, "text", BATCH_BYTES):
            data, bounds = text_buffer(batch.column("text"))
            chars, text, starts, ends = lines_of(data, bounds)
            first = np.searchsorted(text, np.arange(len(bounds) - 1))
            number = np.arange(len(text)) - first[text] if len(text) else text
            keep = ends - starts >= shortest
            text, starts, ends, number = text[keep], starts[keep], ends[keep], number[keep]
            sums, down = prefix_sums(mix(chars.astype(np.uint64) + np.uint64(1)))
            lengths = ends - starts
            ids = mix((sums[ends] - sums[starts]) * down[starts] + lengths.astype(np.uint64)).view(np.int64)
            fresh = np.zeros(len(ids), bool)
            if len(known) > REMEMBERED:
                known = set()
            for k, i in enumerate(ids.tolist()):
                if i not in known:
                    known.add(i)
                    fresh[k] = True
            keys = line_keys(sums, down, starts[fresh], lengths[fresh], tau)
            counts = np.zeros(len(ids), np.int32)
            counts[fresh] = (keys != 0).sum(axis=1)
            flat = pa.array(keys[keys != 0].view(np.int64))
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(take), batch.column("mark").take(take), pa.array(number.astype(np.int32)),
                 pa.array(ids), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)],
                ["doc", "mark", "line", "id", "keys"])
        known.clear()
        give_back()

    return rows.mapInArrow(find, "doc long, mark long, line int, id long, keys array<long>")


def line_texts(rows: DataFrame, shortest: int) -> DataFrame:
    """id, text of the lines that count, once per task as far as it remembers."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in slices(batches, "text", BATCH_BYTES):
            chars, _, starts, ends = lines_of(*text_buffer(batch.column("text")))
            keep = ends - starts >= shortest
            starts, ends = starts[keep], ends[keep]
            sums, down = prefix_sums(mix(chars.astype(np.uint64) + np.uint64(1)))
            ids = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)).view(np.int64)
            if len(known) > REMEMBERED:
                known = set()
            whole = chars.tobytes().decode("utf-32-le")
            out_ids, out = [], []
            for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist()):
                if i not in known:
                    known.add(i)
                    out_ids.append(i)
                    out.append(whole[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.string())], ["id", "text"])
        known.clear()
        give_back()

    return rows.select("text").mapInArrow(find, "id long, text string")


def characters(texts: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts.to_pylist()]


def character_counts(lines: list[np.ndarray]) -> np.ndarray:
    """How often each of 32 classes of characters occurs, up to 255: an edit changes the sum of differences by two at most."""
    out = np.zeros((len(lines), 32), np.int16)
    for k, line in enumerate(lines):
        out[k] = np.minimum(np.bincount(line & 31, minlength=32), 255)
    return out


def edit_distances(left: list[np.ndarray], right: list[np.ndarray], tau: int = TAU) -> np.ndarray:
    """Edit distances of aligned pairs up to ``tau``, tau + 1 for anything beyond."""
    m = np.array([len(a) for a in left], np.int64)
    n = np.array([len(b) for b in right], np.int64)
    out = np.full(len(left), tau + 1.0)
    todo = np.flatnonzero(np.abs(m - n) <= tau)
    todo = todo[np.argsort(-n[todo], kind="stable")]
    at = 0
    while at < len(todo):
        size = max(1, int(1_000_000 // (int(n[todo[at]]) + 2 * tau + 1)))
        some = todo[at:at + size]
        out[some] = banded([left[k] for k in some], [right[k] for k in some], m[some], n[some], tau)
        at += size
    return np.minimum(out, tau + 1)


def banded(left: list[np.ndarray], right: list[np.ndarray], m: np.ndarray, n: np.ndarray, tau: int) -> np.ndarray:
    """Distances where the band of ``tau`` about the diagonal holds them; pairs in falling order of n.

    Bit b of a column j stands for row j - tau + b. Rows before the first and after the last act
    like characters that match nothing. The value of the band's lowest row is carried along the
    diagonal, the wanted one follows from the vertical differences below it.
    """
    width, rows = 2 * tau + 1, len(left)
    longest = int(n[0])
    padded = np.zeros((rows, longest + 2 * width), np.uint32)
    other = np.zeros((rows, longest), np.uint32)
    for k, (a, b) in enumerate(zip(left, right)):
        padded[k, tau:tau + len(a)] = a + 1
        other[k, :len(b)] = b + 1
    full, top = np.uint64((1 << width) - 1), np.uint64(1 << (width - 1))
    one = np.uint64(1)
    # Column 0: rows up to 0 fall by one each, the rows below rise.
    falls = np.full(rows, (1 << (tau + 1)) - 1, np.uint64)
    rises = full & ~falls
    lowest = np.full(rows, tau, np.int64)
    result = np.empty(rows)
    live = rows

    def settle(from_: int, to: int) -> None:
        # The wanted row is bit m - n + tau; the bits above it lead down to the lowest row.
        below = full & ~((one << (m[from_:to] - n[from_:to] + tau + 1).astype(np.uint64)) - one)
        result[from_:to] = lowest[from_:to] - np.bitwise_count(rises[from_:to] & below).astype(np.int64) \
            + np.bitwise_count(falls[from_:to] & below).astype(np.int64)

    for j in range(1, longest + 1):
        while live and n[live - 1] < j:
            done = int(np.searchsorted(-n[:live], -(j - 1), side="left"))
            settle(done, live)
            live = done
        c = other[:live, j - 1]
        match = np.zeros(live, np.uint64)
        for b in range(width):
            match |= (padded[:live, j - 1 + b] == c).astype(np.uint64) << np.uint64(b)
        rise, fall = (rises[:live] >> one) | top, falls[:live] >> one
        diagonal = ((((match & rise) + rise) ^ rise) | match | fall) & full
        up = (fall | ~(diagonal | rise)) & full
        down = diagonal & rise
        lowest[:live] += (diagonal & top) == 0
        up, down = ((up << one) | one) & full, (down << one) & full
        rises[:live] = (down | ~(diagonal | up)) & full
        falls[:live] = diagonal & up
    if live:
        settle(0, live)
    return result


def repeated_lines(docs: DataFrame, tau: int = TAU, shortest: int = SHORTEST) -> tuple[DataFrame, DataFrame]:
    """Keyed documents (doc, mark, doc_id, text), and doc, mark, lines: the numbers of the lines to remove."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63)).alias("doc"),
                       F.xxhash64("text").alias("mark"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = stored_table(line_rows(rows.select("doc", "mark", "text"), tau, shortest), "lines")
    entries = lines.select("id", F.explode("keys").alias("k"))
    shared = entries.groupBy("k").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("k")
    keys = stored_table(entries.join(shared, "k").select("k", "id", F.lit(0).cast("long").alias("weight")).distinct(), "shared_segments")
    found = linked(keys, line_texts(rows.select("text"), shortest), characters,
                   lambda a, b: edit_distances(a, b, tau), float(tau), store_texts=True,
                   outline=character_counts, apart=2.0 * tau)
    of_class = lines.select("doc", "mark", "line", "id").join(found, "id", "left") \
        .select("doc", "mark", "line", F.coalesce("component", "id").alias("class"))
    first = of_class.groupBy("class").agg(F.min(F.struct("doc", "mark", "line")).alias("first"), F.count("*").alias("n")) \
        .where("n > 1").select("class", "first")
    gone = of_class.join(first, "class").where(F.struct("doc", "mark", "line") != F.col("first")) \
        .groupBy("doc", "mark").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    return rows, stored_table(gone, "lines_to_remove")


def parted(frame: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that lose lines, with their numbers, and the others; few ids go by broadcast."""
    ids = gone.select("doc", "mark")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    touched = frame.join(ids, ["doc", "mark"], "left_semi").join(gone, ["doc", "mark"])
    return touched, frame.join(ids, ["doc", "mark"], "left_anti")


def remaining(text: str, lines: list[int]) -> str:
    gone = set(lines)
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)


def digests(docs: DataFrame, tau: int = TAU, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of what stays, null for a null text) of every row."""
    rows, gone = repeated_lines(docs, tau, shortest)
    touched, plain = parted(rows, gone)
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [hashlib.sha256(remaining(t, g).encode()).hexdigest()
                    for t, g in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_lines"), batch.column("n_removed"),
                                              pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    done = touched.select("doc_id", n_lines.cast("long").alias("n_lines"), F.size("lines").cast("long").alias("n_removed"),
                          "text", "lines").mapInArrow(digest, "doc_id long, n_lines long, n_removed long, kept_sha256 string")
    return done.unionByName(plain.select("doc_id", n_lines.cast("long").alias("n_lines"),
                                         F.lit(0).cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256")))


def without_repeated_lines(docs: DataFrame, tau: int = TAU, shortest: int = SHORTEST) -> DataFrame:
    """The documents, other columns as they are, without the repeated lines."""
    _, gone = repeated_lines(docs, tau, shortest)
    names = docs.columns
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63)).alias("doc"),
                        F.xxhash64("text").alias("mark"), F.struct(*[F.col(c) for c in names]).alias("row"))
    touched, plain = parted(whole, gone)
    kind = whole.schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [remaining(t, g) for t, g in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], ["row", "kept"])

    done = touched.select("row", F.col("row.text").alias("text"), "lines").mapInArrow(cut, f"row {kind}, kept string")
    made = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    done = done.select(*[(made[c] if c in made else F.col("row").getField(c)).alias(c) for c in names])
    return done.unionByName(plain.select(*[F.col("row").getField(c).alias(c) for c in names]))
