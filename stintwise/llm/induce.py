"""External induced sorting of suffixes, with common-prefix lengths.

The suffixes of a string are sorted by induction: a suffix is L if it is larger than the one
after it, S otherwise; the S suffixes that follow an L one are the seeds. Sorted seeds induce all
L suffixes in ascending order, and those all S suffixes in descending order. The seeds are
sorted by the same induction, which orders the stretches between seeds; equal stretches get
equal names, and the string of names is sorted by recursion.

Suffix tuples wait in queues that are read symbol by symbol, first in first out within a
symbol: a priority queue for keys that only grow (or only fall). A queue holds a bounded number
of tuples in memory and writes the rest, sorted by symbol, to scratch files that vanish with
it; sorted output goes to scratch files alike. So memory is bounded by ``memory`` tuples and one
symbol per position of the string, whatever its length.

In the last induction tuples carry the length of the prefix shared with the suffix before them,
capped: two suffixes induced next to each other share one symbol more than the least of the
values between those that induced them. Suffixes need only be in order up to the cap, so a
string of names that fits in memory is sorted by doubling until the cap is covered. Beside the tuples a few bytes per position of the string are in memory.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 16


class Sequence:
    """Arrays appended and read back in order or reversed, in memory up to a bound, then on disk."""

    def __init__(self, kind: type, memory: int) -> None:
        self.kind, self.memory = np.dtype(kind), memory
        self.parts: list[np.ndarray] = []
        self.held, self.length, self.file = 0, 0, None

    def append(self, values: np.ndarray) -> None:
        self.parts.append(values.astype(self.kind, copy=False))
        self.held += len(values)
        self.length += len(values)
        if self.held > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for part in self.parts:
                self.file.write(part.tobytes())
            self.parts, self.held = [], 0

    def blocks(self, size: int = BLOCK) -> Iterator[np.ndarray]:
        """All values in order."""
        written = self.length - self.held
        for at in range(0, written, size):
            yield self._read(at, min(written, at + size))
        yield from self.parts

    def last(self, a: int, b: int) -> np.ndarray:
        """The values from a to b."""
        if self.file is None:
            if len(self.parts) > 1:
                self.parts = [np.concatenate(self.parts)]
            return self.parts[0][a:b] if self.parts else np.zeros(0, self.kind)
        if self.held:
            self.file.seek(0, 2)
            for part in self.parts:
                self.file.write(part.tobytes())
            self.parts, self.held = [], 0
        return self._read(a, b)

    def _read(self, a: int, b: int) -> np.ndarray:
        self.file.seek(a * self.kind.itemsize)
        return np.frombuffer(self.file.read((b - a) * self.kind.itemsize), self.kind)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Queue:
    """A priority queue of (symbol, position, shared) tuples, first in first out within a symbol.

    Symbols are popped in ascending (``sign`` 1) or descending (-1) order. Tuples beyond
    ``memory`` are sorted by symbol and written as a run; a pop reads every run on from where the
    last one stopped, oldest run first, then the tuples in memory.
    """

    KIND = np.dtype([("symbol", np.int64), ("position", np.int64), ("shared", np.uint8)])

    def __init__(self, sign: int, memory: int) -> None:
        self.sign, self.memory = sign, memory
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0
        self.file = None
        self.runs: list[list] = []  # next tuple, end, and the block read last
        self.next: list[int] = []   # symbols with tuples in memory, as a heap
        self.block = max(16, memory // 64)

    def push(self, symbols: np.ndarray, positions: np.ndarray, shared: np.ndarray) -> None:
        if not len(symbols):
            return
        # Sorting 16-bit numbers is several times faster, and symbols of texts fit.
        order = np.argsort(symbols.astype(np.uint16) if int(symbols.max()) < 1 << 16 else symbols, kind="stable")
        sorted_symbols = symbols[order]
        cuts = np.concatenate([[0], np.flatnonzero(sorted_symbols[1:] != sorted_symbols[:-1]) + 1, [len(order)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            symbol = int(sorted_symbols[a])
            if symbol not in self.waiting:
                self.waiting[symbol] = []
                heapq.heappush(self.next, self.sign * symbol)
            self.waiting[symbol].append((positions[order[a:b]], shared[order[a:b]]))
        self.held += len(symbols)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        start = self.file.tell() // self.KIND.itemsize
        total = 0
        for symbol in sorted(self.waiting, key=lambda s: self.sign * s):
            for positions, shared in self.waiting[symbol]:
                out = np.empty(len(positions), self.KIND)
                out["symbol"], out["position"], out["shared"] = symbol, positions, shared
                self.file.write(out.tobytes())
                total += len(out)
        self.runs.append([start, start + total, np.empty(0, self.KIND)])
        self.waiting, self.next, self.held = {}, [], 0

    def _fill(self, run: list) -> bool:
        if not len(run[2]) and run[0] < run[1]:
            n = min(self.block, run[1] - run[0])
            self.file.seek(run[0] * self.KIND.itemsize)
            run[2] = np.frombuffer(self.file.read(n * self.KIND.itemsize), self.KIND)
            run[0] += n
        return bool(len(run[2]))

    def peek(self) -> int | None:
        """The symbol that comes next."""
        self.runs = [run for run in self.runs if self._fill(run)]
        first = [self.sign * int(run[2]["symbol"][0]) for run in self.runs]
        while self.next and self.sign * self.next[0] not in self.waiting:
            heapq.heappop(self.next)
        if self.next:
            first.append(self.next[0])
        return self.sign * min(first) if first else None

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (positions, shared) of the symbol, also those pushed while it is popped."""
        while True:
            run = next((r for r in self.runs if self._fill(r) and r[2]["symbol"][0] == symbol), None)
            if run is not None:
                some = run[2]
                n = int(np.searchsorted(self.sign * some["symbol"], self.sign * symbol, side="right"))
                run[2] = some[n:]
                yield some["position"][:n].copy(), some["shared"][:n].copy()
                continue
            parts = self.waiting.pop(symbol, None)
            if not parts:
                return
            self.held -= sum(len(p) for p, _ in parts)
            positions, shared = (np.concatenate(x) for x in zip(*parts))
            for at in range(0, len(positions), BLOCK):
                yield positions[at:at + BLOCK], shared[at:at + BLOCK]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Least:
    """The least shared length, among the suffixes passed by, since the last push to each symbol."""

    def __init__(self, cap: int) -> None:
        self.cap = cap
        self.since: dict[int, int] = {}

    def of(self, shared: np.ndarray, at: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Shared lengths for the tuples that the suffixes at places ``at`` of a block push to ``targets``."""
        out = np.zeros(len(at), np.uint8)
        here = np.unique(targets).tolist()
        least = int(shared.min(initial=self.cap))
        for symbol, before in self.since.items():
            self.since[symbol] = min(before, least) if symbol not in here else before
        for symbol in here:
            mine = np.flatnonzero(targets == symbol)
            cuts = at[mine]
            found = np.minimum.reduceat(shared[:cuts[-1] + 1], np.concatenate([[0], cuts[:-1] + 1])).astype(np.int64)
            # The first tuple of a symbol has none before it: nothing shared.
            found[0] = min(found[0], self.since[symbol]) if symbol in self.since else -1
            out[mine] = np.minimum(found + 1, self.cap)
            self.since[symbol] = int(shared[cuts[-1] + 1:].min(initial=self.cap))
        return out


def run_length(text: np.ndarray, at: int, cap: int) -> int:
    """How often the symbol at ``at`` repeats from there on, up to the cap."""
    some = text[at:at + cap]
    other = np.flatnonzero(some != some[0])
    return int(other[0]) if len(other) else len(some)


def larger_after(text: np.ndarray) -> np.ndarray:
    """Which suffixes are S: smaller than the one after them; the empty suffix is the smallest."""
    if not len(text):
        return np.zeros(0, bool)
    ends = np.concatenate([np.flatnonzero(text[1:] != text[:-1]), [len(text) - 1]])
    last = np.append(text[1:], -1)[ends] > text[ends]
    return np.repeat(last, np.diff(np.concatenate([[-1], ends])))


class Induction:
    """One level: a string, its types, and the two passes over it."""

    def __init__(self, text: np.ndarray, memory: int, cap: int) -> None:
        self.text, self.memory, self.cap = text, memory, cap
        self.small = larger_after(text)
        self.seeds = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1 if len(text) else np.zeros(0, np.int64)

    def _push(self, queue: Queue, least: Least | None, positions: np.ndarray, shared: np.ndarray, small: bool) -> None:
        """Push the suffixes one longer than those of the block that have the wanted type."""
        at = np.flatnonzero(positions > 0)
        before = positions[at] - 1
        fits = self.small[before] == small
        at, before = at[fits], before[fits]
        targets = self.text[before].astype(np.int64)
        queue.push(targets, before, least.of(shared, at, targets) if least and len(shared) else np.zeros(len(at), np.uint8))

    def sort(self, seeds: np.ndarray, seed_shared: np.ndarray | None, seeds_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes in order (or only the seeds), as blocks of (positions, shared with the one before).

        ``seeds`` are in order; ``seed_shared`` are their shared lengths, or None if not wanted.
        """
        text, n, cap = self.text, len(self.text), self.cap
        if not n:
            return
        track = seed_shared is not None
        queue, least = Queue(1, self.memory), Least(cap) if track else None
        large, large_shared = Sequence(np.int64, self.memory), Sequence(np.uint8, self.memory)
        bounds: list[tuple[int, int, int]] = []  # of a symbol's L suffixes in the sequence
        zero = np.zeros(1, np.uint8)
        self._push(queue, least, np.array([n]), zero, False)
        symbols = text[seeds]
        cuts = np.concatenate([[0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1, [len(seeds)]]).tolist() if len(seeds) else [0]
        seed_runs = {int(symbols[a]): (a, b) for a, b in zip(cuts, cuts[1:])}
        todo = sorted(seed_runs, reverse=True)
        while True:
            symbol = queue.peek()
            if symbol is None and not todo:
                break
            if todo and (symbol is None or todo[-1] < symbol):
                symbol = todo[-1]
            start, last = large.length, -1
            for positions, shared in queue.pop(symbol):
                if last < 0:
                    shared[0] = 0
                last = int(positions[-1])
                large.append(positions)
                large_shared.append(shared)
                self._push(queue, least, positions, shared, False)
            if large.length > start:
                bounds.append((symbol, start, large.length))
            if todo and todo[-1] == symbol:
                todo.pop()
                a, b = seed_runs[symbol]
                for at in range(a, b, BLOCK):
                    some = seeds[at:min(b, at + BLOCK)]
                    shared = seed_shared[at:at + len(some)].copy() if track else zero[:0]
                    if track and at == a:
                        shared[0] = min(run_length(text, last, cap), run_length(text, int(some[0]), cap)) if last >= 0 else 0
                    self._push(queue, least, some, shared, False)
        queue.close()

        queue, least = Queue(-1, self.memory), Least(cap) if track else None
        falling, falling_shared = Sequence(np.int64, self.memory), Sequence(np.uint8, self.memory)
        small_bounds: list[tuple[int, int, int]] = []
        todo_large = list(bounds)
        while True:
            symbol = queue.peek()
            if symbol is None and not todo_large:
                break
            if todo_large and (symbol is None or todo_large[-1][0] > symbol):
                symbol = todo_large[-1][0]
            start, last = falling.length, -1
            for positions, shared in queue.pop(symbol):
                if last < 0:
                    shared[0] = 0
                last = int(positions[-1])
                if seeds_only:
                    keep = (positions > 0) & ~self.small[positions - 1]
                    falling.append(positions[keep])
                else:
                    falling.append(positions)
                    falling_shared.append(shared)
                self._push(queue, least, positions, shared, True)
            if falling.length > start:
                small_bounds.append((symbol, start, falling.length))
            if todo_large and todo_large[-1][0] == symbol:
                _, a, b = todo_large.pop()
                for end in range(b, a, -BLOCK):
                    begin = max(a, end - BLOCK)
                    positions = large.last(begin, end)[::-1]
                    shared = zero[:0]
                    if track:
                        # Falling order: a suffix shares with the one above what that one shares with it.
                        above = large_shared.last(begin + 1, min(end + 1, b))[::-1]
                        if end == b:
                            top = min(run_length(text, last, cap), run_length(text, int(positions[0]), cap)) if last >= 0 else 0
                            above = np.concatenate([np.array([top], np.uint8), above])
                        shared = above
                    self._push(queue, least, positions, shared, True)
        queue.close()

        if seeds_only:
            for end in range(falling.length, 0, -BLOCK):
                yield falling.last(max(0, end - BLOCK), end)[::-1], zero[:0]
        else:
            yield from self._ordered(bounds, large, large_shared, small_bounds, falling, falling_shared, track)
        for sequence in (large, large_shared, falling, falling_shared):
            sequence.close()

    def _ordered(self, bounds: list, large: Sequence, large_shared: Sequence, small_bounds: list, falling: Sequence,
                 falling_shared: Sequence, track: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every symbol's L suffixes, then its S suffixes, which lie in falling order."""
        of_large = {symbol: (a, b) for symbol, a, b in bounds}
        of_small = {symbol: (a, b) for symbol, a, b in small_bounds}
        for symbol in sorted(of_large.keys() | of_small.keys()):
            last = -1
            a, b = of_large.get(symbol, (0, 0))
            for at in range(a, b, BLOCK):
                end = min(b, at + BLOCK)
                positions = large.last(at, end)
                last = int(positions[-1])
                yield positions, large_shared.last(at, end)
            a, b = of_small.get(symbol, (0, 0))
            for end in range(b, a, -BLOCK):
                begin = max(a, end - BLOCK)
                positions = falling.last(begin, end)[::-1]
                shared = falling_shared.last(begin + 1, min(end + 1, b))[::-1]
                if end == b:
                    top = min(run_length(self.text, last, self.cap), run_length(self.text, int(positions[0]), self.cap)) \
                        if last >= 0 else 0
                    shared = np.concatenate([np.array([top], np.uint8), shared])
                yield positions, shared


def doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the suffixes in order of their first ``depth`` names, ties by position."""
    rank, length = names.astype(np.int64), 1
    while length < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-length] = rank[length:] + 1
        key = rank * (len(rank) + 1) + after
        order = np.argsort(key)
        key = key[order]
        fresh = np.concatenate([[False], key[1:] != key[:-1]])
        rank[order] = np.cumsum(fresh)
        if fresh.sum() + 1 == len(rank):
            return order
        length *= 2
    return np.argsort(rank, kind="stable")


def stretch_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of text[start:end]."""
    from stintwise.llm.common import mix
    from stintwise.llm.jaccard import prefix_sums

    sums, down = prefix_sums(mix(text.astype(np.uint64) + np.uint64(1)))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def seed_order(level: Induction, depth: int) -> np.ndarray:
    """The seeds in suffix order: their stretches sorted by induction and named, the names by recursion."""
    seeds = level.seeds
    if len(seeds) < 2:
        return seeds
    # Seeds by symbol, in text order within one: enough to sort the stretches between them.
    first = seeds[np.argsort(level.text[seeds], kind="stable")]
    by_stretch = np.concatenate([p for p, _ in level.sort(first, None, True)])
    number = np.zeros(len(level.text), np.int32)
    number[seeds] = np.arange(len(seeds))
    place = number[by_stretch]
    ends = np.append(seeds[1:] + 1, len(level.text))
    hashes = stretch_hashes(level.text, seeds, ends)[place]
    fresh = np.concatenate([[False], hashes[1:] != hashes[:-1]])
    # The last stretch ends with the string, which no other does.
    fresh[1:] |= (place[1:] == len(seeds) - 1) | (place[:-1] == len(seeds) - 1)
    names = np.empty(len(seeds), np.int64)
    names[place] = np.cumsum(fresh)
    if fresh.sum() + 1 == len(seeds):
        return by_stretch
    if len(names) <= level.memory:
        return seeds[doubled(names, depth)]
    inner = Induction(names, level.memory, level.cap)
    order = seed_order(inner, depth // 2 + 1)
    return seeds[np.concatenate([p for p, _ in inner.sort(order, None, False)])]


def shared_lengths(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Symbols that every suffix of ``order`` shares with the one before it, up to the cap.

    Seven symbols below 512 are compared at a time, packed into one number.
    """
    packed = np.zeros(len(text) + cap + 7, np.uint64)
    for k in range(7):
        packed[:max(0, len(text) - k)] |= text[k:].astype(np.uint64) << np.uint64(9 * k)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    upper, lower = order[1:], order[:-1]
    for step in range(0, cap, 7):
        if not len(live):
            break
        differ = packed[upper + step] ^ packed[lower + step]
        # The lowest differing bit tells the first differing symbol.
        lowest = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 9
        out[live] += np.where(differ == 0, 7, lowest)
        same = differ == 0
        live, upper, lower = live[same], upper[same], lower[same]
    room = len(text) - np.maximum(order, np.concatenate([order[:1], order[:-1]]))
    return np.minimum(np.minimum(out, room), cap).astype(np.uint8)


def sorted_suffixes(text: np.ndarray, cap: int, memory: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, shared) of all suffixes, in the order of their first ``cap`` symbols.

    ``text`` holds symbols from 0 to 511; ``cap`` is at most 255. ``memory`` bounds the tuples of each
    queue and the length of a string of names that is sorted in memory.
    """
    level = Induction(text, memory, cap)
    seeds = seed_order(level, cap + 8)
    yield from level.sort(seeds, shared_lengths(text, seeds, cap), False)
