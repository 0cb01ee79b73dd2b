"""SentencePiece encoding and decoding by suffix-array matching, for BPE models.

Pieces never hold a space mark after another character, so a text falls into segments, each a
run of space marks and what follows. The distinct segments of a batch are laid end to end and
their suffixes sorted to the length of the longest piece. A binary search finds every piece's
range of suffixes, hence all its occurrences: edges from a start to an end. Sorted by their end
in the segment, the edges are relaxed position by position, in all segments side by side.

An edge is taken if its piece may follow the last piece of the path to its start. For BPE that
is so if joining both and encoding gives the two again, which is decided by undoing their
merges in reverse order until one would have crossed the boundary. A path whose neighbours all
agree is the encoding, so every position keeps one last piece. Characters in no piece become
the pieces of their bytes.

The vocabulary is read from the model file, whose path is a parameter. Defined results: null
and empty texts have no ids; ``decoded`` gives an empty text for no ids, and null for null.
Repeated rows are encoded row by row. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.common import slices

SPACE = "▁"
#: Segments whose ids a worker remembers.
REMEMBERED = 400_000
NONE, START, OTHER = -1, -2, -3

_models: dict[str, "Model"] = {}


class Model:
    """A BPE vocabulary: pieces with merge ranks, how each is merged, and which pairs may join."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        read = SentencePieceProcessor(model_file=path)
        size = read.get_piece_size()
        texts = [read.id_to_piece(i) for i in range(size)]
        self.bytes_of = [t.replace(SPACE, " ").encode() for t in texts]
        self.byte_id = {}
        usable = {}
        for i, text in enumerate(texts):
            if read.is_byte(i):
                self.byte_id[int(text[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(text[1:-1], 16)])
            elif read.is_control(i) or read.is_unknown(i):
                self.bytes_of[i] = b""
            elif not read.is_unused(i):
                usable[text] = i
        scores = [read.get_score(i) for i in range(size)]
        # Merges in falling order of score; single characters are never merged.
        order = sorted((i for t, i in usable.items() if len(t) > 1), key=lambda i: -scores[i])
        self.rank = np.full(size, -1, np.int64)
        self.rank[order] = np.arange(len(order))
        self.left, self.right = np.full(size, NONE, np.int64), np.full(size, NONE, np.int64)
        self.size = size
        whole = []
        for text, i in usable.items():
            if len(text) == 1 or self._split(text, usable):
                whole.append((text, i))
        joins = sorted((usable[t[:k]] * size + usable[t[k:]], self.rank[i]) for t, i in usable.items()
                       for k in range(1, len(t)) if t[:k] in usable and t[k:] in usable)
        self.join_keys = np.array([k for k, _ in joins], np.int64)
        self.join_ranks = np.array([r for _, r in joins], np.int64)
        letters = sorted({c for t, _ in whole for c in t})
        if len(letters) >= 1 << 16:
            raise ValueError(f"{path}: too many different characters")
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.ids = np.array([i for _, i in whole], np.int64)
        self.lengths = np.array([len(t) for t, _ in whole], np.int64)
        self.longest = -(-int(self.lengths.max(initial=1)) // 4) * 4
        spelled = np.zeros((len(whole), self.longest), np.uint64)
        for k, (text, _) in enumerate(whole):
            spelled[k, :len(text)] = self.letter[[ord(c) for c in text]]
        filled = np.where(np.arange(self.longest) < self.lengths[:, None], spelled, np.uint64(0xFFFF))
        self.low, self.high = self._packed(spelled), self._packed(filled)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _packed(spelled: np.ndarray) -> np.ndarray:
        four = spelled.reshape(len(spelled), -1, 4)
        return four[:, :, 0] << np.uint64(48) | four[:, :, 1] << np.uint64(32) | four[:, :, 2] << np.uint64(16) | four[:, :, 3]

    def _split(self, text: str, usable: dict[str, int]) -> bool:
        """Merge the piece from its characters and note its last merge; False if it can't be made."""
        parts = list(text)
        if any(c not in usable for c in parts):
            return False
        while len(parts) > 1:
            best = min(((self.rank[usable[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in usable),
                       default=None)
            if best is None:
                return False
            k = best[1]
            if len(parts) == 2:
                self.left[usable[text]], self.right[usable[text]] = usable[parts[0]], usable[parts[1]]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return True

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging never joins b to the a before it."""
        out = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        a, b = a.copy(), b.copy()
        while len(live):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.join_keys, key), max(len(self.join_keys) - 1, 0))
            joins = (self.join_keys[at] == key) & (self.join_ranks[at] < limit) if len(self.join_keys) else np.zeros(len(live), bool)
            out[live[joins]] = False
            ra, rb = self.rank[a], self.rank[b]
            # Undo the later merge; of equal ones the left one was made first.
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            go = ~joins & ((ra >= 0) | (rb >= 0))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            a, b, limit, live = a[go], b[go], limit[go], live[go]
        return out

    def occurrences(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, index of the piece) of every occurrence, by binary search in the sorted suffixes."""
        n = len(letters)
        wide = np.concatenate([letters, np.zeros(self.longest + 4, np.uint16)]).astype(np.uint64)
        four = wide[:-3] << np.uint64(48) | wide[1:-2] << np.uint64(32) | wide[2:-1] << np.uint64(16) | wide[3:]
        order = np.argsort(four[:n], kind="stable")
        rank, span = np.empty(n, np.int64), 4
        rank[order] = np.cumsum(np.concatenate([[0], (four[order[1:]] != four[order[:-1]]).astype(np.int64)]))
        while span < self.longest:
            after = np.zeros(n, np.int64)
            after[:max(0, n - span)] = rank[span:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key)
            key = key[order]
            rank[order] = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
            span *= 2
        first = four[order]
        low = np.searchsorted(first, self.low[:, 0], side="left")
        high = np.searchsorted(first, self.high[:, 0], side="right")
        for part in range(1, self.longest // 4):
            # Longer pieces: narrow the range by the next four characters.
            some = np.flatnonzero((self.lengths > 4 * part) & (high > low))
            if not len(some):
                break
            bounds = []
            for wanted, strict in ((self.low[some, part], True), (self.high[some, part], False)):
                a, b = low[some].copy(), high[some].copy()
                while (a < b).any():
                    open_ = a < b
                    mid = (a + b) // 2
                    value = four[order[np.minimum(mid, n - 1)] + 4 * part]
                    right = (value < wanted) if strict else (value <= wanted)
                    a = np.where(open_ & right, mid + 1, a)
                    b = np.where(open_ & ~right, mid, b)
                bounds.append(a)
            low[some], high[some] = bounds
        counts = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[piece]
        return order[place], piece

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment, little-endian unsigned 32-bit."""
        if not segments:
            return []
        sizes = np.array([len(s) for s in segments])
        chars = np.frombuffer("\0".join(segments).encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        ends = starts + sizes
        inside = np.ones(len(chars), bool)
        inside[ends[:-1]] = False
        letters = np.where(inside, self.letter[chars], 0)
        begin, piece = self.occurrences(letters)
        unknown = np.flatnonzero(inside & (letters == 0))
        begin = np.concatenate([begin, unknown])
        end = np.concatenate([begin[:len(piece)] + self.lengths[piece], unknown + 1])
        piece = np.concatenate([self.ids[piece], np.full(len(unknown), OTHER)])
        segment_at = np.repeat(starts, sizes + 1)[:len(chars)]
        depth = end - segment_at[begin]
        order = np.argsort(depth.astype(np.uint16) if int(depth.max(initial=0)) < 1 << 16 else depth, kind="stable")
        begin, end, piece, depth = begin[order], end[order], piece[order], depth[order]
        last = np.full(len(chars) + 1, NONE, np.int64)
        back = np.zeros(len(chars) + 1, np.int64)
        last[starts] = START
        cuts = np.concatenate([[0], np.flatnonzero(depth[1:] != depth[:-1]) + 1, [len(depth)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            s, e, p = begin[a:b], end[a:b], piece[a:b]
            before = last[s]
            fits = (before != NONE)
            check = np.flatnonzero(fits & (before >= 0) & (p >= 0))
            pairs, which = np.unique(before[check] * self.size + p[check], return_inverse=True)
            fits[check] = self.may_follow(pairs // self.size, pairs % self.size)[which]
            last[e[fits]], back[e[fits]] = p[fits], s[fits]
        on_path = np.zeros(len(chars) + 1, bool)
        at = ends[sizes > 0]
        goal = starts[sizes > 0]
        while len(at):
            on_path[at] = True
            at = back[at]
            more = at > goal
            at, goal = at[more], goal[more]
        stops = np.flatnonzero(on_path)
        ids = last[stops].astype(np.uint32)
        first, beyond = np.searchsorted(stops, starts, side="right"), np.searchsorted(stops, ends, side="right")
        raw = ids.astype("<u4").tobytes()
        out = [raw[4 * a:4 * b] for a, b in zip(first.tolist(), beyond.tolist())]
        odd = np.unique(np.searchsorted(starts, unknown, side="right") - 1) if len(unknown) else []
        for k in odd:
            parts = []
            for stop in stops[first[k]:beyond[k]].tolist():
                if last[stop] == OTHER:
                    parts += [self.byte_id[x] for x in chr(chars[stop - 1]).encode()]
                else:
                    parts.append(int(last[stop]))
            out[k] = np.array(parts, "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts; segments are encoded once while the worker remembers them."""
        cut = [segments_of(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set().union(*cut).difference(self.known)) if cut else []
        self.known.update(zip(new, self.encode_segments(new), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, parts)) for parts in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space mark that encoding puts first is taken off."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def segments_of(text: str) -> list[str]:
    """Runs of space marks with what follows, for a text with its leading mark."""
    if not text:
        return []
    words = text.replace(SPACE, " ").split(" ")
    if "" not in words:
        return [SPACE + w for w in words]
    out, marks = [], 0
    for word in words:
        marks += 1
        if word:
            out.append(SPACE * marks + word)
            marks = 0
    if marks:
        out.append(SPACE * marks)
    return out


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and ids_crc32 (of the little-endian unsigned 32-bit ids) of every row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model(path)
        for batch in slices(batches, "text", 4_000_000):
            raw = found.encode([t or "" for t in batch.column("text").to_pylist()])
            ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
            flat = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.array([zlib.crc32(r) for r in raw], pa.int64())], ["doc_id", "ids", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, "doc_id long, ids array<int>, ids_crc32 long")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """The rows (with ``ids``) plus their decoded text; a column of that name is replaced."""
    kept = [c for c in rows.columns if c != "decoded"]
    schema = rows.select(kept).schema.add("decoded", "string")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model(path)
        for batch in batches:
            out = [None if ids is None else found.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], [*kept, "decoded"])

    return rows.select(kept).mapInArrow(texts, schema)


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 and whether the decoded text is the document's, in one pass over the texts."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model(path)
        for batch in slices(batches, "text", 4_000_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            raw = found.encode(texts)
            same = [found.decode(np.frombuffer(r, "<u4").tolist()) == t for r, t in zip(raw, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(r) // 4 for r in raw], pa.int64()),
                 pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(same, pa.bool_())],
                ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
