"""Vectorised word and shingle hashing over the UTF-8 bytes of many texts at once.

Words are maximal runs of characters other than space, tab, LF, VT, FF and CR. All separators and
all of A-Z are single bytes in UTF-8, so the work is done on bytes without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the memory of the 64-bit work arrays.
CHUNK = 1 << 19

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLIERS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=_U)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that all bits depend on all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK) + 1
        steps = np.full(size, base & (2**64 - 1), dtype=_U)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes of text: (first row, end row, bytes, offsets from 0). Null: no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


@dataclass
class Words:
    """The words of a run of rows: hashes, byte spans, and for each row the range of its words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of row i


def words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of each row of a chunk, A-Z lower-cased before hashing."""
    low = _LOWER[raw]
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[raw]
    begins = inside[1:] & ~inside[:-1]
    ends = ~inside[1:] & inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    touching = cuts[inside[cuts] & inside[cuts + 1]]  # a word may not run on into the next row
    begins[touching] = True
    ends[touching] = True
    s, e = np.flatnonzero(begins), np.flatnonzero(ends)
    prefix = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum((low.astype(_U) + _U(1)) * _power("up", _BASE, len(raw) + 1)[: len(raw)], out=prefix[1:])
    h = mix((prefix[e] - prefix[s]) * _power("down", _INVERSE, len(raw) + 1)[s] + (e - s).astype(_U))
    return Words(h, s, e, np.searchsorted(s, offsets))


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of k-word shingles, index of each one's first word, first shingle of each row).

    A row with 1 to k - 1 words has its whole sequence as one shingle; a row without words has none.
    """
    count = np.diff(w.first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - w.first[:-1], n)
    length = np.repeat(np.minimum(count, k), n)
    h = length.astype(_U) * _U(_BASE)
    if len(at):
        full = bool((length == k).all())
        for i in range(k):
            term = w.hashes[np.minimum(at + i, len(w.hashes) - 1)] * _multiplier(i)
            h += term if full else np.where(i < length, term, _U(0))
    return mix(h), at, first


def _multiplier(i: int) -> np.uint64:
    return _MULTIPLIERS[i] if i < len(_MULTIPLIERS) else _U((0x9FB21C651E98DF25 + 2 * i * 0x9E3779B97F4A7C15) % 2**64 | 1)
