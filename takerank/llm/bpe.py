"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Many texts are handled at once as arrays. Each codepoint gets a class, refined by the codepoint
after it; each class is a transition function on the states of a small automaton, and a scan that
composes these functions (composition is associative, so blocks are scanned side by side) gives the
state at every codepoint and with it the piece boundaries, as the pattern of the vocabulary sets
them: contractions, letters, numbers and other characters with at most one space before, and white
space. Distinct pieces are merged once and kept in a cache; decoding gathers the bytes of the ids
and must give back the text, which also rules out a clash of piece hashes.

A null text counts as empty, and an empty one has no ids; repeated rows get equal results, an empty
table an empty one, and columns other than the id and text are not read. No text is too long: pieces
above ``SHORT`` bytes are merged with a heap, and a text of more pieces than the cache holds is taken
in runs of pieces. The vocabulary is broadcast, so a file above ``VOCABULARY_BYTES`` is refused.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from takerank.llm import wordhash
from takerank.llm.cluster import ready

CHUNK = 1 << 20  # bytes of text handled at once
CACHED = 2_000_000  # pieces kept by a worker
SHORT = 64  # bytes of a piece that is merged by plain search
VOCABULARY_BYTES = 32 << 20  # largest vocabulary file that is broadcast

# The contractions of the pre-tokenisation pattern.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")

# Classes of codepoints. LETTER_END ends a contraction, LETTER_PAIR begins the last two letters of one.
CUT, LETTER, LETTER_END, LETTER_PAIR, NUMBER, OTHER, APOSTROPHE, WHITE, LAST_SPACE, LAST_WHITE = range(10)
# States: what the codepoint before belongs to.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, AT_APOSTROPHE, IN_PAIR = range(8)

_LETTERS = {AFTER_SPACE: IN_LETTERS, IN_PAIR: FRESH}
#: For each class: the state that follows by default, and from some states.
STEPS: dict[int, tuple[int, dict[int, int]]] = {
    CUT: (FRESH, {}),
    LETTER: (IN_LETTERS, _LETTERS),
    LETTER_END: (IN_LETTERS, _LETTERS | {AT_APOSTROPHE: FRESH}),
    LETTER_PAIR: (IN_LETTERS, _LETTERS | {AT_APOSTROPHE: IN_PAIR}),
    NUMBER: (IN_NUMBERS, {}),
    OTHER: (IN_OTHERS, {}),
    APOSTROPHE: (AT_APOSTROPHE, {IN_OTHERS: IN_OTHERS, AFTER_SPACE: IN_OTHERS, AT_APOSTROPHE: IN_OTHERS}),
    WHITE: (IN_WHITE, {}),
    LAST_SPACE: (AFTER_SPACE, {}),
    LAST_WHITE: (FRESH, {}),
}
#: States in which a codepoint of the class goes on with the piece before it.
JOINS: dict[int, set[int]] = {
    CUT: set(),
    LETTER: {IN_LETTERS, AFTER_SPACE, IN_PAIR},
    LETTER_END: {IN_LETTERS, AFTER_SPACE, IN_PAIR, AT_APOSTROPHE},
    LETTER_PAIR: {IN_LETTERS, AFTER_SPACE, IN_PAIR, AT_APOSTROPHE},
    NUMBER: {IN_NUMBERS, AFTER_SPACE},
    OTHER: {IN_OTHERS, AFTER_SPACE, AT_APOSTROPHE},
    APOSTROPHE: {IN_OTHERS, AFTER_SPACE, AT_APOSTROPHE},
    WHITE: {IN_WHITE},
    LAST_SPACE: set(),
    LAST_WHITE: set(),
}


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(function of each class, composition table, states after a function, boundary table, identity)."""
    base = [tuple(special.get(s, default) for s in range(8)) for default, special in (STEPS[c] for c in range(10))]
    functions = [tuple(range(8)), *dict.fromkeys(base)]
    known = {f: i for i, f in enumerate(functions)}
    for f in functions:  # the list grows while it is closed under composition
        for g in base:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(functions)
                functions.append(h)
    table = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], dtype=np.uint8)
    starts = np.array([[s not in JOINS[c] for c in range(10)] for s in range(8)])
    return np.array([known[f] for f in base], dtype=np.uint8), table.reshape(-1), np.array(functions, dtype=np.uint8), starts.reshape(-1), len(functions)


@cache
def _classes() -> np.ndarray:
    """The class of each codepoint, without regard to what follows; the one past the last is a cut."""
    found = np.full(0x110001, OTHER, dtype=np.uint8)
    found[:0x110000] = [{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)]
    # White_Space of the Unicode character database.
    for first, last in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        found[first : last + 1] = WHITE
    found[ord("'")] = APOSTROPHE
    found[0x110000] = CUT
    return found


def scan(functions: np.ndarray, width: int = 64) -> np.ndarray:
    """Composition of functions[0] to functions[i], for each i."""
    _, table, _, _, size = _automaton()
    n = len(functions)
    rows = -(-n // width)
    padded = np.zeros(rows * width, dtype=np.uint8)  # 0 is the identity
    padded[:n] = functions
    block = padded.reshape(rows, width)
    step = 1
    while step < width:
        block[:, step:] = table[block[:, :-step].astype(np.uint16) * np.uint16(size) + block[:, step:]]
        step *= 2
    if rows > 1:
        before = scan(block[:, -1].copy(), width)
        block[1:] = table[before[:-1, None].astype(np.uint16) * np.uint16(size) + block[1:]]
    return padded[:n]


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pieces of the texts begin."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    first = np.unique(np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0]))
    points = np.insert(points, first, 0x110000)
    kind = _classes()[points]
    after = np.append(kind[1:], CUT)
    following = np.append(points[1:], 0x110000)
    white = kind == WHITE
    last = white & (after != WHITE) & (after != CUT)
    kind[last] = LAST_WHITE
    kind[last & (points == 0x20)] = LAST_SPACE
    for c in ONE_LETTER:
        kind[points == ord(c)] = LETTER_END
    for a, b in TWO_LETTERS:
        kind[(points == ord(a)) & (following == ord(b))] = LETTER_PAIR
    of_class, _, after_function, starts, _ = _automaton()
    state = after_function[scan(of_class[kind]), FRESH]
    before = np.empty_like(state)
    before[0], before[1:] = FRESH, state[:-1]
    begins = starts[before * np.uint8(10) + kind]
    begins[first + np.arange(len(first))] = False  # the cuts themselves
    keep = np.ones(len(points), dtype=bool)
    keep[first + np.arange(len(first))] = False
    return at[begins[keep]]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of the least rank is merged first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > SHORT:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    costs = [ranks.get(piece[i : i + 2]) for i in range(len(piece) - 1)]
    while True:
        best, where = None, -1
        for i, c in enumerate(costs):
            if c is not None and (best is None or c < best):
                best, where = c, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[where : where + 2] = [parts[where] + parts[where + 1]]
        del costs[where]
        if where:
            costs[where - 1] = ranks.get(parts[where - 1] + parts[where])
        if where < len(costs):
            costs[where] = ranks.get(parts[where] + parts[where + 1])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long pieces: a heap of pairs over a linked list of parts."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != middle or after[i] >= n or end[after[i]] != stop:
            continue
        gone = after[i]
        alive[gone] = False
        end[i], after[i] = stop, after[gone]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], i, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of first[i], ..., first[i] + count[i] - 1."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(first - (ends - count), count) + np.arange(total)


class Vocabulary:
    """Ranks of byte strings, and a cache of merged pieces as sorted arrays of bounded size."""

    def __init__(self, content: bytes):
        """content: lines of a base64 token and its rank."""
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes, self.byte_first, self.byte_count = self._packed(tokens)
        self.digits, self.digit_first, self.digit_count = self._packed([b"%d " % i for i in range(size)])
        self.forget()

    @staticmethod
    def _packed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = np.array([len(p) for p in parts], dtype=np.int64)
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(count) - count, count

    def forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        merged = [merge(p, self.ranks) for p in pieces]
        count = np.array([len(m) for m in merged], dtype=np.int64)
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(merged), dtype=np.int32, count=int(count.sum()))])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.count = np.insert(self.keys, where, keys), np.insert(self.first, where, first), np.insert(self.count, where, count)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids)."""
        starts = piece_starts(raw, offsets)
        ends = np.append(starts[1:], len(raw))
        prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * wordhash._power("up", wordhash._BASE, len(raw) + 1)[: len(raw)], out=prefix[1:])
        hashes = wordhash.mix((prefix[ends] - prefix[starts]) * wordhash._power("down", wordhash._INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))
        parts = [self._pieces(raw, starts[a : a + CACHED], ends[a : a + CACHED], hashes[a : a + CACHED]) for a in range(0, len(starts), CACHED)]
        ids = np.concatenate([np.zeros(0, np.int32), *(p[0] for p in parts)])
        total = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)]))])
        return ids, total[np.searchsorted(starts, offsets)]

    def _pieces(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) of at most CACHED pieces, so that they always fit the cache."""
        distinct, example, piece = np.unique(hashes, return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), dtype=bool) if not len(self.keys) else self.keys[np.minimum(where, len(self.keys) - 1)] != distinct
        if len(self.keys) and len(self.keys) + int(new.sum()) > CACHED:
            self.forget()
            new[:] = True
        if new.any():
            self._learn(distinct[new], [raw[starts[i] : ends[i]].tobytes() for i in example[new]])
            where = np.searchsorted(self.keys, distinct)
        count = self.count[where][piece]
        return self.ids[spread(self.first[where][piece], count)], count

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        return self.bytes[spread(self.byte_first[ids], self.byte_count[ids])]

    def encode_checked(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """encode() and the decoded bytes, which are those of the texts."""
        for _ in range(2):
            ids, at = self.encode(raw, offsets)
            back = self.decode(ids)
            if np.array_equal(back, raw):
                return ids, at, back
            self.forget()
        raise ValueError("decoding does not give back the text")


_loaded: dict[bytes, Vocabulary] = {}


def vocabulary(content: bytes) -> Vocabulary:
    """The vocabulary of a rank file's content, kept by the worker."""
    key = hashlib.sha256(content).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(content)
    return _loaded[key]


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        content = f.read(VOCABULARY_BYTES + 1)
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    return content


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    rows = docs.selectExpr("doc_id", "cast(text AS string) AS text")
    return rows, rows.dtypes[0][1]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and offsets (byte of the text at which each token begins) of each row of docs."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(_content(path))
    rows, kind = _texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for batch in batches:
            for row, end, raw, offsets in wordhash.chunks(batch.column(1), CHUNK):
                ids, at, _ = v.encode_checked(raw, offsets)
                count = v.byte_count[ids]
                begin = np.cumsum(count) - count - np.repeat(offsets[:-1], np.diff(at))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (ids, begin)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(np.diff(at)), *lists], names=["doc_id", "n_tokens", "ids", "offsets"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, offsets array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids."""
    shared = ready(rows.sparkSession).sparkContext.broadcast(_content(path))
    rows = rows.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for batch in batches:
            texts = ["" if x is None else v.decode(np.array(x, dtype=np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids and of the decoded bytes of each row of docs."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(_content(path))
    rows, kind = _texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for batch in batches:
            for row, end, raw, offsets in wordhash.chunks(batch.column(1), CHUNK):
                ids, at, back = v.encode_checked(raw, offsets)
                digits = memoryview(v.digits[spread(v.digit_first[ids], v.digit_count[ids])])
                cut = np.concatenate([[0], np.cumsum(v.digit_count[ids])])[at]
                bytes_ = memoryview(back)
                names = [hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in itertools.pairwise(cut.tolist())]
                texts = [hashlib.sha256(bytes_[a:b]).hexdigest() for a, b in itertools.pairwise(offsets.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(np.diff(at)), pa.array(names), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
