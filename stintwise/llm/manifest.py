"""Merkle manifest of a dataset, by time-forward processing.

Every row is a leaf; the leaves of a source in order of doc_id, and then the sources' subroots, are
the bottom of trees in which every ``FAN`` consecutive nodes become one. Nodes are labelled level by
level, so ascending labels visit children before parents. The upward sweep delivers each node's
digest to its parent, the downward sweep, in descending order, delivers to every child its siblings'
digests followed by what its parent was sent: the rest of the proof. Messages wait in a priority
queue ordered by label, which holds ``memory`` bytes and sorts the rest into runs on scratch files.

A tree is cut into blocks of ``FAN ** levels`` nodes; a block is one group of a Spark job, so a source
with a third of all rows is many groups. The blocks' roots are the nodes of the next job, until
every source has one; the way down takes the same jobs backwards, each block starting from what was
delivered to its root. Positions come from a range-partitioned sort and a prefix sum over
(partition, source).

Defined results: a null field is written as ``-``. Null doc_ids come first and rows that share a
doc_id follow in order of their leaves; nothing of a row without doc_id is tampered with. Null is a source of its
own, before all others. A lone node needs no proof, and an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import struct
import tempfile
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stintwise.llm.common import stored_table

FAN = 3
#: Levels of a block, and bytes of messages that a queue holds in memory.
LEVELS = 7
MEMORY = 1 << 17
PARTITION_ROWS = 1 << 16
BROADCAST_ROWS = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes that a digest has.
DIGEST = 32


def joined(digests: bytes) -> bytes:
    """Digest of digests, which are written as hex text."""
    return sha256(digests.hex().encode()).digest()


class Messages:
    """A priority queue of (label, place, payload), by ascending (sign 1) or descending (sign -1) label.

    Beyond ``memory`` bytes the messages held are sorted into a run on a scratch file, which is lost and
    made again with its task; runs are read on in small blocks.
    """

    HEAD = struct.Struct("<qBI")
    OVERHEAD = 120

    def __init__(self, sign: int, memory: int = MEMORY) -> None:
        self.sign, self.memory = sign, memory
        self.held: list[tuple[int, int, bytes]] = []
        self.bytes, self.file, self.spills = 0, None, 0
        self.heads: list[tuple[int, int, bytes, Iterator]] = []

    def push(self, label: int, place: int, payload: bytes) -> None:
        heapq.heappush(self.held, (self.sign * label, place, payload))
        self.bytes += len(payload) + self.OVERHEAD
        if self.bytes > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        start = self.file.tell()
        self.held.sort()
        for label, place, payload in self.held:
            self.file.write(self.HEAD.pack(label, place, len(payload)) + payload)
        self.spills += 1
        run = self._run(start, self.file.tell())
        self.held, self.bytes = [], 0
        self._next(self.spills, run)

    def _run(self, at: int, end: int, block: int = 1 << 14) -> Iterator[tuple[int, int, bytes]]:
        rest = b""
        while at < end or rest:
            self.file.seek(at)
            more = self.file.read(min(block, end - at))
            at += len(more)
            rest, k = rest + more, 0
            while k + self.HEAD.size <= len(rest):
                label, place, size = self.HEAD.unpack_from(rest, k)
                if k + self.HEAD.size + size > len(rest):
                    break
                yield label, place, rest[k + self.HEAD.size:k + self.HEAD.size + size]
                k += self.HEAD.size + size
            rest = rest[k:]

    def _next(self, number: int, run: Iterator) -> None:
        for label, place, payload in run:
            heapq.heappush(self.heads, (label, place, payload, number, run))
            return

    def take(self, label: int) -> list[bytes]:
        """The payloads sent to ``label``, in order of place; labels must be asked for in order."""
        key, out = self.sign * label, []
        while True:
            first = self.held[0] if self.held else None
            head = self.heads[0] if self.heads else None
            if head is not None and (first is None or head[:2] <= first[:2]):
                if head[0] != key:
                    return out
                heapq.heappop(self.heads)
                out.append(head[2])
                self._next(head[3], head[4])
            elif first is not None and first[0] == key:
                heapq.heappop(self.held)
                out.append(first[2])
                self.bytes -= len(first[2]) + self.OVERHEAD
            else:
                return out

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def level_starts(n: int, height: int) -> list[int]:
    """First label of every level over n leaves, and the end of the last."""
    starts = [0]
    for _ in range(height + 1):
        starts.append(starts[-1] + n)
        n = -(-n // FAN)
    return starts


def height_of(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def upward(leaves: list[bytes], height: int, memory: int = MEMORY) -> bytes:
    """Digests of all nodes, by label; the last one is the root's."""
    starts = level_starts(len(leaves), height)
    digests, queue = bytearray(), Messages(1, memory)
    for level in range(height + 1):
        for i in range(starts[level + 1] - starts[level]):
            own = leaves[i] if level == 0 else joined(b"".join(queue.take(starts[level] + i)))
            digests += own
            if level < height:
                queue.push(starts[level + 1] + i // FAN, i % FAN, own)
    queue.close()
    return bytes(digests)


def downward(digests: bytes, n: int, height: int, rest: bytes, memory: int = MEMORY) -> Iterator[bytes]:
    """Proofs of the leaves, last leaf first; ``rest`` is what was delivered to the root."""
    starts = level_starts(n, height)
    queue = Messages(-1, memory)
    queue.push(starts[height], 0, rest)
    for level in range(height, -1, -1):
        for i in range(starts[level + 1] - starts[level] - 1, -1, -1):
            (delivered,) = queue.take(starts[level] + i)
            if level == 0:
                yield delivered
                continue
            a = starts[level - 1] + FAN * i
            b = min(a + FAN, starts[level])
            for c in range(a, b):
                siblings = digests[a * DIGEST:c * DIGEST] + digests[(c + 1) * DIGEST:b * DIGEST]
                queue.push(c, 0, siblings + delivered)
    queue.close()


def turns(pos: int, n: int) -> list[tuple[int, int]]:
    """Place in its run and size of the run at every level, for node ``pos`` of n."""
    out = []
    while n > 1:
        first = pos - pos % FAN
        out.append((pos % FAN, min(FAN, n - first)))
        pos, n = pos // FAN, -(-n // FAN)
    return out


def folded(leaf: bytes, proof: bytes, path: list[tuple[int, int]]) -> bytes:
    """The root that a leaf and its proof lead to."""
    at = 0
    for place, size in path:
        cut, end = at + place * DIGEST, at + (size - 1) * DIGEST
        leaf, at = joined(proof[at:cut] + leaf + proof[cut:end]), end
    return leaf


def numbered(rows: DataFrame, group: str, order: list[str], partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """``rows`` with ``pos``, from 0 in every group in the given order, and ``n``, the group's size.

    Rows alike in group and order are interchangeable and may be dealt to several partitions.
    """
    rows = rows.withColumn("_salt", F.monotonically_increasing_id())
    rows = stored_table(rows, "unsorted")
    parts = max(1, -(-rows.count() // partition_rows))
    schema = rows.drop("_salt").schema.add("part", "integer").add("at", "long")
    column = rows.columns.index(group)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            seen = []
            for value in batch.column(column).to_pylist():
                at = at + 1 if value == last else 0
                last = value
                seen.append(at)
            keep = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.record_batch(keep + [pa.array([part] * batch.num_rows, pa.int32()), pa.array(seen, pa.int64())], schema.names)

    sort = [group, *order, "_salt"]
    placed = stored_table(rows.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).mapInArrow(count, schema), "sorted")
    sums = placed.groupBy("part", group).agg(F.count(F.lit(1)).alias("_rows"))
    ahead = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = stored_table(sums.select("part", group, F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"),
                                    F.sum("_rows").over(W.partitionBy(group)).alias("n")), "offsets")
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    return placed.join(sums, ["part", group]).withColumn("pos", F.col("at") + F.col("_ahead")).drop("part", "at", "_ahead")


NODE = "key string, pos long, n long, digest binary"


def block_rows(table: pa.Table) -> pa.Table:
    return table.sort_by("pos").combine_chunks()


def block_height(n: int, levels: int) -> int:
    """Levels that a block of a row of n nodes climbs: all there are, or those of a block."""
    return min(height_of(n), levels)


def stages_of(nodes: DataFrame, levels: int, memory: int) -> list[DataFrame]:
    """Stored rows of nodes: the given ones, their blocks' roots, and so on until each key has one."""
    size = FAN ** levels

    def up(table: pa.Table) -> pa.Table:
        table = block_rows(table)
        n = table.column("n")[0].as_py()
        root = upward(table.column("digest").to_pylist(), block_height(n, levels), memory)[-DIGEST:]
        return pa.table({"key": table.column("key")[:1], "pos": pa.array([table.column("pos")[0].as_py() // size], pa.int64()),
                         "n": pa.array([-(-n // size)], pa.int64()), "digest": pa.array([root], pa.binary())})

    stages = [nodes]
    while True:
        open_rows = stages[-1].where("n > 1")
        above = stored_table(open_rows.select("key", "pos", "n", "digest", F.expr(f"pos div {size}").alias("block"))
                             .groupBy("key", "block").applyInArrow(up, NODE), "blocks")
        if not above.limit(1).count():
            return stages
        stages.append(above)


def lone(stages: list[DataFrame]) -> DataFrame:
    """The one node that each key ends in."""
    out = [s.where("n = 1").select("key", "digest") for s in stages]
    while len(out) > 1:
        out[:2] = [out[0].unionByName(out[1])]
    return out[0]


CARRIED = "rest binary, subroot binary, root binary, rank long, keys long"


def finish(row: dict, proof: bytes) -> tuple[bytes, bytes]:
    """Digest of a leaf's proof, and the root that its leaf, tampered with where it is, folds to."""
    path = turns(row["pos"], row["n"]) + turns(row["rank"], row["keys"])
    forged = row["forged"]
    return joined(proof), folded(row["digest"] if forged is None else forged, proof, path)


LEAF = "doc_id long, leaf binary, subroot binary, root binary, proof binary, folded binary"


def delivered(stages: list[DataFrame], tops: DataFrame, levels: int, memory: int, leaves: bool) -> DataFrame:
    """What reaches the lowest nodes from ``tops`` (key and the carried columns), stage by stage.

    With ``leaves`` the lowest nodes are documents: their finished columns come back in place of
    the proofs themselves.
    """
    size = FAN ** levels
    names = ["rest", "subroot", "root", "rank", "keys"]

    def down(last: bool):
        def of(left: pa.Table, right: pa.Table) -> pa.Table:
            left = block_rows(left)
            n, rows = left.column("n")[0].as_py(), left.num_rows
            height = block_height(n, levels)
            sent = {name: right.column(name)[0].as_py() for name in names}
            digests = upward(left.column("digest").to_pylist(), height, memory)
            proofs = downward(digests, rows, height, sent["rest"], memory)
            if not last:
                return pa.table({"key": left.column("key"), "pos": left.column("pos"),
                                 "rest": pa.array(list(proofs)[::-1], pa.binary()),
                                 **{name: pa.array([sent[name]] * rows, t) for name, t in
                                    zip(names[1:], [pa.binary(), pa.binary(), pa.int64(), pa.int64()])}})
            first, forged = left.column("pos")[0].as_py(), left.column("forged").to_pylist()
            done = [finish({"pos": first + k, "n": n, "forged": forged[k], "digest": digests[k * DIGEST:(k + 1) * DIGEST], **sent}, proof)
                    for k, proof in zip(range(rows - 1, -1, -1), proofs)][::-1]
            return finished(left, [sent["subroot"]] * rows, [sent["root"]] * rows, done)
        return of

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield from finished(pa.Table.from_batches([batch]), [r["subroot"] for r in rows], [r["root"] for r in rows],
                                [finish(r, r["rest"]) for r in rows]).to_batches()

    above = None
    for k in range(len(stages) - 1, -1, -1):
        last = leaves and k == 0
        single = stages[k].where("n = 1").join(tops, "key")
        if last:
            own = single.mapInArrow(alone, LEAF)
        else:
            own = single.select("key", "pos", *names)
        if above is not None:
            left = stages[k].where("n > 1").withColumn("block", F.expr(f"pos div {size}"))
            right = above.withColumnRenamed("pos", "block")
            own = own.unionByName(left.groupBy("key", "block").cogroup(right.groupBy("key", "block")).applyInArrow(
                down(last), LEAF if last else f"key string, pos long, {CARRIED}"))
        above = own if last else stored_table(own, "delivered")
    return above


def finished(rows: pa.Table, subroots: list[bytes], roots: list[bytes], done: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"doc_id": rows.column("doc_id"), "leaf": rows.column("digest"), "subroot": pa.array(subroots, pa.binary()),
                     "root": pa.array(roots, pa.binary()), "proof": pa.array([p for p, _ in done], pa.binary()),
                     "folded": pa.array([f for _, f in done], pa.binary())})


def field(value: Column) -> Column:
    """A field of a leaf: byte count, colon, value; null is a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaf_of(columns: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(columns[name]) for name in FIELDS]), 256))


def manifest(docs: DataFrame, levels: int = LEVELS, memory: int = MEMORY, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Texts whose doc_id has an even CRC-32 lose their line feeds before they are folded.
    """
    columns = {name: F.col(name) for name in FIELDS}
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & (F.instr("text", "\n") > 0)
    forged = leaf_of({**columns, "text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))})
    # 'n' for no source sorts before 's' and any source.
    leaves = docs.select(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("key"),
                         "doc_id", leaf_of(columns).alias("digest"), F.when(tampered, forged).alias("forged"))
    nodes = stored_table(numbered(leaves, "key", ["doc_id", "digest"], partition_rows), "leaves")
    stages = stages_of(nodes, levels, memory)
    subroots = lone(stages)
    tree = numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("source_key"), "digest"), "key", ["source_key"],
                    partition_rows)
    tree = stored_table(tree, "subroots")
    upper = stages_of(tree.select("key", "pos", "n", "digest"), levels, memory)
    root = lone(upper).select("key", F.lit(b"").alias("rest"), F.lit(None).cast("binary").alias("subroot"),
                              F.col("digest").alias("root"), F.lit(0).cast("long").alias("rank"), F.lit(1).cast("long").alias("keys"))
    sent = delivered(upper, root, levels, memory, leaves=False)
    tops = tree.select("source_key", "pos", "n", "digest").join(sent.select("pos", "rest", "root"), "pos").select(
        F.col("source_key").alias("key"), "rest", F.col("digest").alias("subroot"), "root", F.col("pos").alias("rank"),
        F.col("n").alias("keys"))
    out = delivered(stages, stored_table(tops, "tops"), levels, memory, leaves=True)

    def text(name: str) -> Column:
        return F.lower(F.hex(name))

    return out.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
                      text("proof").alias("proof_sha256"), text("folded").alias("folded_root"),
                      (F.col("folded") == F.col("root")).alias("verified"))
