"""Repair of conversation structure by a persistent audit DP.

The rows of a conversation, in order of turn, are edited so that their roles read as an optional
system row and then user and assistant in turn. The DP goes over the rows with four states (nothing
yet, system, user, assistant) and keeps for each the cheapest edits, which are written as an audit of
letters: Delete, Insert, Keep, Rerole; ties go to the ASCII-least audit. Audits share their prefixes as
linked nodes, each with a rolling hash of its whole audit and its ancestors 1, 2, 4, ... steps up. A tie
is decided where the two audits part, which a search over ancestors of equal depth finds by hash;
prefixes of equal hash are then compared node by node up to a shared one, so a collision
decides nothing.

A long conversation is many chunks. A chunk is solved for each state it may be entered in, which
gives a table of cheapest audits from state to state; tables of consecutive chunks are joined in order,
with the same linked nodes, a chunk's audit on each. So the DP over a conversation with a third of all
rows is spread over tasks; only the audit itself and the digest of the repaired text, both of which are one value
of one row, are made in one task, streamed. Rows carry the number of their copies, so one row that is
repeated very often is one row everywhere.

Defined results: a null role or text is one space, and a null conv_id is a conversation of its own. Rows of null
turn come first; rows that share a turn go by role, then by the SHA-256 of their text. A blank text holds
nothing but spaces and the characters 9 to 13. An empty table gives no rows. Columns other than
conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.llm.common import stored_table

CHUNK_ROWS = 1024
PARTITION_ROWS = 1 << 15
SPACES = " \t\n\x0b\x0c\r"
MODULUS = (1 << 61) - 1
BASE = 0x1F3D_5B79_A2C4_E681 % MODULUS
#: Prices of the edits, and of a truncated row that stays.
KEEP, INSERT, REROLE, DELETE, TRUNCATED = 0, 2, 2, 3, 1
#: States: nothing yet, after system, after user, after assistant. What may follow each.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}


class Node:
    """An audit: the piece that its parent's audit is followed by."""

    __slots__ = ("piece", "depth", "size", "hash", "up")

    def __init__(self, parent: Node | None, piece: str) -> None:
        self.piece = piece
        if parent is None:
            self.depth, self.size, self.hash, self.up = 0, 0, 0, ()
            return
        value = parent.hash
        for letter in piece:
            value = (value * BASE + ord(letter)) % MODULUS
        self.depth, self.size, self.hash = parent.depth + 1, parent.size + len(piece), value
        up, at, j = [parent], parent, 0
        while len(at.up) > j:
            at = at.up[j]
            up.append(at)
            j += 1
        self.up = tuple(up)

    def ancestor(self, depth: int) -> Node:
        node, steps, j = self, self.depth - depth, 0
        while steps:
            if steps & 1:
                node = node.up[j]
            steps >>= 1
            j += 1
        return node

    def after(self, depth: int) -> str:
        """The audit from below the ancestor at ``depth``."""
        pieces, node = [], self
        while node.depth > depth:
            pieces.append(node.piece)
            node = node.up[0]
        return "".join(reversed(pieces))


EMPTY = Node(None, "")


def alike(a: Node, b: Node) -> bool:
    return a is b or (a.hash == b.hash and a.size == b.size)


def verified(a: Node, b: Node) -> bool:
    """Whether two audits are the same, letter by letter up to a node that they share."""
    x, y = a, b
    while x is not y:
        if x.depth != y.depth or x.piece != y.piece:
            return a.after(0) == b.after(0)
        x, y = x.up[0], y.up[0]
    return True


def before(a: Node, b: Node) -> bool:
    """Whether a's audit is ASCII-less than b's."""
    depth = min(a.depth, b.depth)
    x, y = a.ancestor(depth), b.ancestor(depth)
    if alike(x, y):
        if verified(x, y):
            return a.after(depth) < b.after(depth)
        return a.after(0) < b.after(0)
    for j in range(len(x.up) - 1, -1, -1):
        if j < len(x.up) and not alike(x.up[j], y.up[j]):
            x, y = x.up[j], y.up[j]
    p, q = x.up[0], y.up[0]
    if not verified(p, q):
        return a.after(0) < b.after(0)
    if x.piece.startswith(y.piece) or y.piece.startswith(x.piece):
        return a.after(p.depth) < b.after(q.depth)
    return x.piece < y.piece


Best = dict[int, tuple[int, Node]]


def offer(best: Best, state: int, cost: int, parent: Node, piece: str) -> bool:
    """Take an audit for a state if it is the cheapest so far, or as cheap and less."""
    old = best.get(state)
    if old is not None and cost > old[0]:
        return False
    node = Node(parent, piece)
    if old is not None and cost == old[0] and not before(node, old[1]):
        return False
    best[state] = (cost, node)
    return True


def with_inserts(best: Best) -> Best:
    """Two inserted rows at most lead from a state to any other that inserts reach."""
    for _ in range(2):
        for state, (cost, node) in sorted(best.items()):
            offer(best, NEXT[state], cost + INSERT, node, "I")
    return best


def allowed(state: int, initial: str) -> int | None:
    """The state after a kept row."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return USER if NEXT[state] == USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def with_row(best: Best, initial: str, must_go: bool, truncated: bool) -> Best:
    after: Best = {}
    extra = TRUNCATED if truncated else 0
    for state, (cost, node) in best.items():
        offer(after, state, cost + DELETE, node, "D")
        if must_go:
            continue
        kept = allowed(state, initial)
        if kept is not None:
            offer(after, kept, cost + KEEP + extra, node, "K")
        offer(after, NEXT[state], cost + REROLE + extra, node, "R")
    return with_inserts(after)


def accepted(best: Best) -> tuple[int, str]:
    cost, node = best[NOTHING]
    if ASSISTANT in best and (best[ASSISTANT][0] < cost or (best[ASSISTANT][0] == cost and before(best[ASSISTANT][1], node))):
        cost, node = best[ASSISTANT]
    return cost, node.after(0)


class Chunk:
    """Consecutive rows of one conversation: counts, and the cheapest audits from state to state."""

    def __init__(self, entries: tuple[int, ...]) -> None:
        self.rows = self.copies = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = ""
        self.low = self.high = None
        self.best = {entry: with_inserts({entry: (0, EMPTY)}) for entry in entries}

    def add(self, turn: int | None, role: str, blank: bool, seen: bool, truncated: bool, copies: int) -> None:
        self.rows += 1
        if not copies:
            return
        initial = role[:1]
        if self.copies:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last = initial
        self.illegal += (copies - 1) * (initial * 2 not in LEGAL)
        self.copies += copies
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - 1 + seen
            self.truncated += truncated and not seen
        for k in range(copies):
            must_go = blank or seen or k > 0
            for entry in self.best:
                self.best[entry] = with_row(self.best[entry], initial, must_go, truncated)

    def packed(self) -> bytes:
        audits = [[e, x, cost, node.after(0)] for e, best in self.best.items() for x, (cost, node) in best.items()]
        return zlib.compress(json.dumps([self.copies, self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low,
                                         self.high, self.first, self.last, audits]).encode(), 1)


class Summary:
    """Chunks of a conversation, joined in order."""

    def __init__(self) -> None:
        self.copies = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.last = ""
        self.best: Best = {NOTHING: (0, EMPTY)}

    def add(self, packed: bytes) -> None:
        copies, blank, duplicate, truncated, illegal, turns, low, high, first, last, audits = json.loads(zlib.decompress(packed))
        self.illegal += illegal + (bool(self.copies and copies) and self.last + first not in LEGAL)
        if copies:
            self.last = last
        self.copies, self.blank = self.copies + copies, self.blank + blank
        self.duplicate, self.truncated = self.duplicate + duplicate, self.truncated + truncated
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high
        after: Best = {}
        for entry, state, cost, audit in audits:
            if entry in self.best:
                offer(after, state, self.best[entry][0] + cost, self.best[entry][1], audit)
        self.best = after

    def result(self) -> dict:
        cost, audit = accepted(self.best) if self.copies else (0, "")
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
                "cost": cost, "audit": audit}


class Replay:
    """Applies an audit to the rows of a conversation, one after the other."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, NOTHING

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.state, self.at = NEXT[self.state], self.at + 1
            yield "I", ROLE[self.state], ""

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        for _ in range(copies):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = allowed(self.state, role[:1])
                yield edit, role, text
            elif edit == "R":
                self.state = NEXT[self.state]
                yield edit, ROLE[self.state], text


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with the faults that the CRC-32 of ``conv_id:turn`` chooses, as conv_id, turn, role,
    text and the number of copies, which is 0 for a row that is dropped."""
    def or_space(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    text, fault = or_space("text"), F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(or_space("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"))


def undamaged(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
                       F.lit(1).cast("long").alias("copies"))


ORDER = ["conv_id", "turn", "role", "digest"]


def judged(rows: DataFrame) -> DataFrame:
    """One row for each (conv_id, turn, role, text): what its text shows, its copies, and whether an earlier turn
    has the same role and text. No texts go along."""
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    narrow = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (stripped == "").alias("blank"),
                         (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "copies")
    narrow = stored_table(narrow.groupBy(*ORDER).agg(F.first("blank").alias("blank"), F.first("truncated").alias("truncated"),
                                                     F.sum("copies").alias("copies")), "turns")
    firsts = narrow.where("copies > 0").groupBy("conv_id", "role", "digest").agg(
        F.min("turn").alias("first_turn"), F.bool_or(F.col("turn").isNull()).alias("without"), F.count(F.lit(1)).alias("times")) \
        .where("times > 1").select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"),
                                   "first_turn", "without")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    seen = F.when(F.col("without"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first_turn"))
    return narrow.join(firsts, same, "left").select(*ORDER, "blank", "truncated", "copies", F.coalesce(seen, F.lit(False)).alias("seen"))


def chunks(rows: DataFrame, chunk_rows: int, partition_rows: int) -> DataFrame:
    """Solved chunks: their first row's order, and the packed counts and audits."""
    parts = max(1, -(-rows.count() // partition_rows))
    schema = rows.select(*ORDER).schema.add("chunk", "binary")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, start, conv, done = None, None, None, []
        leading = True  # the partition's first conversation may have begun in the one before
        for batch in batches:
            cells = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for conv_id, turn, role, digest, blank, truncated, copies, seen in zip(*cells):
                if chunk is None or conv_id != conv or chunk.rows == chunk_rows:
                    if chunk is not None:
                        done.append((*start, chunk.packed()))
                        leading = leading and conv_id == conv
                    whole = not leading and conv_id != conv
                    chunk, start = Chunk((NOTHING,) if whole else tuple(NEXT)), (conv_id, turn, role, digest)
                    conv = conv_id
                chunk.add(turn, role, blank, seen, truncated, copies)
            if done:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), [*batch.schema.types[:4], pa.binary()])], schema.names)
                kinds, done = batch.schema.types[:4], []
            kinds = batch.schema.types[:4]
        if chunk is not None:
            yield pa.record_batch([pa.array([c], t) for c, t in zip((*start, chunk.packed()), [*kinds, pa.binary()])], schema.names)

    return rows.select(*ORDER, "blank", "truncated", "copies", "seen") \
        .repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(solve, schema)


def replayed(rows: DataFrame, chunk_rows: int, partition_rows: int) -> DataFrame:
    """Conversations side by side in partitions, in order: a conversation's chunks, then its rows."""
    solved = stored_table(chunks(stored_table(judged(rows), "judged"), chunk_rows, partition_rows), "chunks")
    empty = {"chunk": F.lit(None).cast("binary"), "text": F.lit(None).cast("string"), "copies": F.lit(0).cast("long")}
    texts = rows.where("copies > 0").withColumn("digest", F.unhex(F.sha2("text", 256)))
    columns = [*ORDER, "chunk", "text", "copies"]
    both = solved.withColumns({k: empty[k] for k in ("text", "copies")}).select(*columns).unionByName(
        texts.withColumn("chunk", empty["chunk"]).select(*columns))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("chunk").isNull(), *ORDER[1:])


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("start", conv_id, summary), its edited rows as ("row", edit, role, text), and ("end",)."""
    summary, replay, conv = None, None, None
    for batch in batches:
        cells = [batch.column(k) for k in range(batch.num_columns)]
        for k in range(batch.num_rows):
            conv_id, packed = cells[0][k].as_py(), cells[4][k].as_py()
            if summary is None or conv_id != conv:
                if summary is not None:
                    yield from closing(conv, summary, replay)
                summary, replay, conv = Summary(), None, conv_id
            if packed is not None:
                summary.add(packed)
                continue
            if replay is None:
                result = summary.result()
                replay = Replay(result["audit"])
                yield "start", conv, result
            for edit in replay.row(cells[2][k].as_py(), cells[5][k].as_py(), cells[6][k].as_py()):
                yield "row", *edit
    if summary is not None:
        yield from closing(conv, summary, replay)


def closing(conv: object, summary: Summary, replay: Replay | None) -> Iterator[tuple]:
    if replay is None:
        yield "start", conv, summary.result()
    else:
        for edit in replay.inserted():
            yield "row", *edit
    yield ("end",)


BATCH_ROWS, BATCH_CHARS = 10_000, 4_000_000


def repaired(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (from 0), edit, role, text."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, conv, chars = [], 0, None, 0
        kinds = None

        def taken(batches):
            nonlocal kinds
            for batch in batches:
                kinds = [batch.schema.types[0], pa.int64(), pa.string(), pa.string(), pa.string()]
                yield batch

        def batch_of(out):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["conv_id", "place", "edit", "role", "text"])

        for what, *rest in conversations_of(taken(batches)):
            if what == "start":
                conv, place = rest[0], 0
            elif what == "row":
                out.append((conv, place, *rest))
                place, chars = place + 1, chars + len(rest[2])
            if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield batch_of(out)
                out, chars = [], 0
        if out:
            yield batch_of(out)

    return replayed(rows, chunk_rows, partition_rows).mapInArrow(write, f"conv_id {kind}, place long, edit string, role string, text string")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def digests(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """One row for each conversation: its faults, the cost of its repair, the audit, and the digest of the repaired
    rows, written as role:text and joined by line feeds."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, kinds = [], None

        def taken(batches):
            nonlocal kinds
            for batch in batches:
                kinds = [batch.schema.types[0], *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
                yield batch

        def batch_of(out):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])

        for what, *rest in conversations_of(taken(batches)):
            if what == "start":
                (conv, result), digest, first = rest, sha256(), True
            elif what == "row":
                digest.update(f"{'' if first else chr(10)}{rest[1]}:{rest[2]}".encode())
                first = False
            else:
                out.append((conv, *[result[c] for c in COUNTS], result["audit"], digest.hexdigest()))
                if len(out) >= BATCH_ROWS:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return replayed(rows, chunk_rows, partition_rows).mapInArrow(
        write, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")
