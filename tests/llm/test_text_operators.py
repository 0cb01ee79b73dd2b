"""Line dedup, Jaccard join, suffix dedup, packing and pieces against brute force, with odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stintwise.llm import induce, jaccard, linededup, packing, pieces, suffixes
from stintwise.llm.queries import tokenizer_path


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


class Groups(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def shingle_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard_brute(rows):
    sets = {d: shingle_set(t) for d, t in rows if d is not None}
    groups = Groups()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and 100 * both >= 75 * union:
                groups.join(a, b)
    return {d: (len(s), groups.root(d)) for d, s in sets.items()}


def test_jaccard(corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(corpus).collect()}
    null = got.pop(None)
    assert null[1] is None and null[0] > 0
    assert got == jaccard_brute((r.doc_id, r.text) for r in corpus.collect())
    assert len({c for _, c in got.values()}) < len(got)


def test_jaccard_many_sizes(spark):
    """Sets around every small size, with one to three shingles changed, meet as they should."""
    rng = random.Random(5)
    rows = []
    for n in range(1, 40):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(n + 4)]
        for change in range(4):
            rows.append((len(rows), " ".join(words[:max(1, n + 4 - change)])))
            rows.append((len(rows), " ".join([f"c{change}"] + words[1:])))
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_brute(rows)


def test_jaccard_chain_apart_from_the_leader(spark):
    """Links between documents that are both too far from the leader of their lists are found."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(204)]
    rows = []
    for k in range(14):
        words = list(base)
        for j in range(k):
            words[10 + 14 * j] = f"v{j}"
        rows.append((100 - k, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_brute(rows)


def test_jaccard_repeated_and_empty(repeated, nothing):
    got = jaccard.components_of(repeated)
    assert got.count() == repeated.count()
    expected = {d: v[1] for d, v in jaccard_brute({(r.doc_id, r.text) for r in repeated.collect()}).items()}
    assert {r.doc_id: r.component_id for r in got.where("doc_id is not null").collect()} == expected
    assert jaccard.components_of(nothing).collect() == []


def test_deduplicated_keeps_rows_whole(repeated):
    got = jaccard.deduplicated(repeated).collect()
    kept = jaccard_brute({(r.doc_id, r.text) for r in repeated.collect()})
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(d for d, (_, c) in kept.items() if c == d)
    assert {tuple(map(str, r)) for r in got} <= {tuple(map(str, r)) for r in repeated.collect()}


def lines_brute(rows, tau=linededup.TAU, shortest=linededup.SHORTEST):
    every = [(d, k, line) for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for k, line in
             enumerate((t or "").split("\n")) if len(line) >= shortest]
    distinct = sorted({line for _, _, line in every})
    groups = Groups()
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if abs(len(a) - len(b)) <= tau and edits(a, b) <= tau:
                groups.join(a, b)
    seen, gone = set(), {}
    for d, k, line in every:
        root = groups.root(line)
        if root in seen:
            gone.setdefault(d, set()).add(k)
        seen.add(root)
    return gone


def short_lines(frame):
    return frame.where("text is null or length(text) < 2000")


def test_line_dedup(corpus):
    docs = short_lines(corpus)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    gone = lines_brute(rows)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in linededup.digests(docs).collect()}
    for d, text in rows:
        if text is None:
            assert got[d] == (0, 0, None)
            continue
        kept = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(d, ()))
        assert got[d] == (text.count("\n") + 1, len(gone.get(d, ())), hashlib.sha256(kept.encode()).hexdigest())
    assert any(v for v in gone.values())


def test_line_dedup_keeps_columns(repeated, nothing):
    got = linededup.without_repeated_lines(repeated)
    assert got.columns == repeated.columns and got.count() == repeated.count()
    others = [c for c in repeated.columns if c not in ("text", "n_chars")]
    assert sorted(map(str, got.select(others).collect())) == sorted(map(str, repeated.select(others).collect()))
    assert linededup.without_repeated_lines(nothing).collect() == []
    assert linededup.digests(nothing).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab é漢", max_size=14), st.text("ab é漢", max_size=14)), min_size=1, max_size=5),
       st.integers(1, 4))
def test_banded_edit_distance(pairs, tau):
    def chars(t):
        return np.frombuffer(t.encode("utf-32-le"), np.uint32)
    got = linededup.edit_distances([chars(a) for a, _ in pairs], [chars(b) for _, b in pairs], tau)
    assert got.tolist() == [min(tau + 1, edits(a, b)) for a, b in pairs]


def spans_brute(rows, length):
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            window = raw[i:i + length]
            if window in seen:
                gone[i:i + length] = b"\x01" * length
            seen.add(window)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"hot": 3}, {"memory": 50, "shard_bytes": 5000}])
def test_suffix_dedup(corpus, limits):
    docs = corpus.where("doc_id is not null")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(docs, **limits).collect()}
    assert got == spans_brute([(r.doc_id, r.text) for r in docs.collect()], suffixes.LENGTH)


def test_suffix_dedup_null_and_repeated_ids(repeated, nothing):
    """A null doc_id comes first; a repeated row loses all that its first copy has."""
    rows = repeated.collect()
    seen, expected = set(), []
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        raw = (r.text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i:i + 100] in seen:
                gone[i:i + 100] = b"\x01" * 100
            seen.add(raw[i:i + 100])
        expected.append((r.doc_id, sum(gone)))
    got = [(r.doc_id, r.n_removed) for r in suffixes.digests(repeated).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert suffixes.digests(nothing).collect() == []


def test_suffix_dedup_keeps_columns(corpus):
    got = suffixes.without_repeats(corpus)
    assert got.columns == corpus.columns and got.count() == corpus.count()
    before = {r.doc_id: r for r in corpus.collect()}
    for r in got.collect():
        assert (r.lang, r.id, r.side, r["keys"]) == (before[r.doc_id].lang, before[r.doc_id].id, before[r.doc_id].side,
                                                 before[r.doc_id]["keys"])
        assert (r.text is None) == (before[r.doc_id].text is None)


def test_long_text_in_stretches(monkeypatch):
    monkeypatch.setattr(suffixes, "STRETCH", 400)
    raw = np.frombuffer(random.Random(2).randbytes(3000), np.uint8)
    whole = {(int(k)) for k in suffixes.runs(raw, np.array([0, 3000]))[3]}
    parts, windows = set(), 0
    for at in range(0, 3000 - 99, 400 - 99):
        _, low, high, key = suffixes.runs(raw[at:at + 400], np.array([0, len(raw[at:at + 400])]))
        parts |= set(map(int, key))
        windows += int((high - low + 1).sum())
    assert parts == whole and windows == 3000 - 99


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.sampled_from([3, 30, 10 ** 6]), st.booleans())
def test_induced_sorting(symbols, memory, twice):
    text = np.array(symbols * (2 if twice else 1), np.uint16)
    n = len(text)
    order = sorted(range(n), key=lambda i: text[i:].tolist())
    blocks = list(induce.sorted_suffixes(text, 100, memory))
    assert np.concatenate([p for p, _ in blocks]).tolist() == order
    shared = np.concatenate([s for _, s in blocks]).tolist()
    for k in range(1, n):
        a, b = text[order[k - 1]:].tolist(), text[order[k]:].tolist()
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_packing(corpus, repeated, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    for docs in (corpus, repeated):
        got = packing.pack_documents(docs, path, capacity=256, ids=True).collect()
        texts = docs.select("doc_id", "text").collect()
        expected = []
        for r in texts:
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
            first = len(ids) % 256 or 256
            cuts = [0, *range(first, len(ids) + 1, 256)]
            expected += [(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b]))
                         for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got), key=str) == \
            sorted(expected, key=str)
        by_sequence = {}
        for r in got:
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in by_sequence.values():
            places.sort()
            assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
            assert sum(places[-1]) <= 256
        bins = []  # first fit of falling lengths
        for n in sorted((r.length for r in got), reverse=True):
            k = next((k for k, used in enumerate(bins) if used + n <= 256), None)
            if k is None:
                bins.append(n)
            else:
                bins[k] += n
        assert len(by_sequence) <= len(bins)
    assert packing.pack_documents(nothing, path).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1))
def test_patterns_use_up_the_counts(counts):
    used = {}
    for _, times, members in packing.pack_counts(counts, 64):
        assert sum(n * k for n, k in members) <= 64
        for n, k in members:
            used[n] = used.get(n, 0) + times * k
    assert used == counts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(
    ["a", "b", " ", "  ", "\n", "the", "ing", "er", "▁", "é", "漢", "😀", "<s>", "<0x0A>", "\x00", "１", ".", "Hello"]),
    max_size=12).map("".join), max_size=20))
def test_pieces_equal_the_library(texts):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    library, own = SentencePieceProcessor(model_file=path), pieces.model(path)
    ids = [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)]
    assert ids == library.encode(texts)
    assert [own.decode(i) for i in ids] == [library.decode(i) for i in ids]


def test_pieces_of_documents(corpus, nothing):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = pieces.decoded(pieces.encoded(corpus, path), path)
    text = {r.doc_id: r.text or "" for r in corpus.collect()}
    got = rows.collect()
    assert len(got) == corpus.count()
    assert all(r.decoded == text[r.doc_id] and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    digest = {r.doc_id: r for r in pieces.round_trips(corpus, path).collect()}
    assert all(digest[r.doc_id].n_ids == len(r.ids) and digest[r.doc_id].round_trip for r in got)
    assert pieces.round_trips(nothing, path).collect() == []


def test_lines_with_a_common_segment(spark):
    # More lines than a cell holds share their first words and nothing else; three of them have a near copy.
    draw = random.Random(11)
    lines = ["Posted by " + "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=20)) for _ in range(1200)]
    near = [lines[5][:14] + "#" + lines[5][15:], lines[600][:-2], lines[1100] + "é"]
    rows = [(k, line) for k, line in enumerate(lines + near)]
    got = linededup.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.where("n_removed > 0").collect()) == [1200, 1201, 1202]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40), st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["", "a", "é", "zz"])), max_size=2))
def test_character_counts_bound_edits(text, edits):
    other = text
    for at, put in edits:
        other = other[:at] + put[:1] + other[at + 1:]
    a, b = linededup.character_counts(linededup.characters(pa.array([text, other])))
    assert abs(a - b).sum() <= 2 * len(edits)
