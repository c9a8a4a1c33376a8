"""Vectorised words over Arrow text buffers.

A word is a run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z is lower-cased: digits, letters
a-z and every non-ASCII character. In UTF-8 all bytes of a non-ASCII character are 0x80 or more,
so the class can be decided byte by byte and whole batches are handled by numpy, without a Python
string per word. Word hashes are 64 bits wide and depend on nothing but the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 19

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (multiply and shift)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _series(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_BYTE_VALUE = _series(11, 256) | U(1)
_PLACE = _series(29, 4096) | U(1)
_NGRAM = _series(47, 64) | U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = True
IS_WORD[97:123] = True
IS_WORD[128:] = True


@dataclass
class Slice:
    """Rows `first` to `last` of a batch: their bytes, and where each row begins in them."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray

    def text(self, row: int) -> str:
        return self.data[self.bounds[row] : self.bounds[row + 1]].tobytes().decode("utf-8", "replace")


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """A null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a slice in order: byte ranges, hashes, and the first word of each row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    rows: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts())

    def joined(self, first: int, n: int) -> bytes:
        """Words first..first+n-1 with one space between."""
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(first, first + n))


def words(part: Slice, member: np.ndarray = IS_WORD, lower: bool = True) -> Words:
    data = LOWER[part.data] if lower else part.data
    inside = member[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    cut = before.copy()
    cut[part.bounds] = False
    start = np.flatnonzero(inside & ~cut[:-1])
    after = before[1:].copy()
    after[:-1] = inside[1:]
    after[-1:] = False
    ends = part.bounds[part.bounds > 0] - 1
    after[ends] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, hashes(data, inside, start, end), np.searchsorted(start, part.bounds))


def joined_rows(w: Words) -> list[bytes]:
    """Each row's words with one blank between."""
    size = w.end - w.start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.full(int(at[-1]), 32, dtype=np.uint8)
    own = np.arange(len(flat)) - np.repeat(at[:-1], size + 1)
    inside = own < np.repeat(size, size + 1)
    flat[inside] = w.data[(np.repeat(w.start, size + 1) + own)[inside]]
    data = flat.tobytes()
    return [data[at[a] : max(at[a], at[b] - 1)] for a, b in zip(w.rows[:-1], w.rows[1:], strict=True)]


def hashes(data: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, dtype=U)
    lengths = end - start
    at = np.cumsum(lengths) - lengths
    own = data[inside]
    place = np.arange(len(own)) - np.repeat(at, lengths)
    value = _BYTE_VALUE[own] * _PLACE[place & 4095]
    if lengths.max() > len(_PLACE):  # further factors, so that no two places weigh the same
        value *= mix((place >> 12).astype(U)) | U(1)
    return mix(np.add.reduceat(value, at) + lengths.astype(U))


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of n words inside one row, and the runs' hashes."""
    total = len(w.hash)
    if total < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    h = w.hash[: total - n + 1] * _NGRAM[0]
    for i in range(1, n):
        h = h + w.hash[i : total - n + 1 + i] * _NGRAM[i & 63]
    left = np.repeat(w.rows[1:], w.counts())[: total - n + 1] - np.arange(total - n + 1)
    first = np.flatnonzero(left >= n)
    return first, mix(h[first] + U(n))
