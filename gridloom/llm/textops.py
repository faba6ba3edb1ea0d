"""Vectorised text primitives that run inside Arrow tasks.

Every function works on the UTF-8 bytes of a whole column slice at once, so a
task pays numpy cost per byte and no interpreter cost per word.  Texts are
always taken whole; a null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at once.  It bounds a task's memory (about 40 bytes of
#: scratch per text byte); a single longer text still goes through in one piece.
SLICE_BYTES = 1 << 21

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: True for the bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~_byte_set((0x20, 0x20), (0x09, 0x0D))
#: True for the bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: a-z, 0-9, non-ASCII.
LOWER_ALNUM = _byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _grow(row: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(row) < n:
            step = np.uint64(pow(base, len(row), 1 << 64))
            row = np.concatenate([row, row * step])
        return row

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.up = self._grow(self.up, self.base, n)
        self.down = self._grow(self.down, self.inverse, n)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; another salt gives an independent-looking hash."""
    h = h ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has at most ``limit`` text bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        total = np.cumsum(np.asarray(size, np.int64))
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; nulls are empty."""
    array = pc.fill_null(array, "") if array.null_count else array
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    """All words of a slice: byte spans, 64-bit hashes and the row of each."""

    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    #: first word of each row, and one past the last: ``bounds[r]:bounds[r + 1]``
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def words(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE) -> Words:
    """Split every row into maximal runs of the bytes that ``kind`` marks."""
    rows = len(offsets) - 1
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Words(raw, offsets, none, none, none.astype(np.uint64), none, np.zeros(rows + 1, np.int64))
    inside = kind[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(raw)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _BYTES.get(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[raw] * up, out=total[1:])
    digest = mix((total[end] - total[start]) * down[start])
    bounds = np.searchsorted(start, offsets)
    return Words(raw, offsets, start, end, digest, np.repeat(np.arange(rows), np.diff(bounds)), bounds)


def grams(w: Words, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word windows and the word position where each starts."""
    if len(w) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _WORDS.get(len(w) + 1)
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w.hash * up[:-1], out=total[1:])
    at = np.flatnonzero(w.row[: len(w) - n + 1] == w.row[n - 1 :])
    return mix((total[at + n] - total[at]) * down[at], salt), at


def span_grams(w: Words, first: np.ndarray, count: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of arbitrary word runs; a run of ``n`` words hashes as in ``grams``."""
    up, down = _WORDS.get(len(w) + 1)
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w.hash * up[:-1], out=total[1:])
    return mix((total[first + count] - total[first]) * down[first], salt)


def covered(length: int, starts: np.ndarray, width) -> np.ndarray:
    """Marks positions that lie in any ``[start, start + width)``."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def row_sums(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each ``bounds[r]:bounds[r + 1]``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def joined(w: Words, keep: np.ndarray) -> pa.Array:
    """For every row its kept words, joined by one space, as an Arrow column."""
    at = np.flatnonzero(keep)
    start, size, row = w.start[at], w.end[at] - w.start[at], w.row[at]
    rows = len(w.offsets) - 1
    ends_row = np.ones(len(at), bool)
    if len(at):
        ends_row[:-1] = row[1:] != row[:-1]
    width = size + ~ends_row
    stop = np.cumsum(width)
    total = int(stop[-1]) if len(at) else 0
    source = np.repeat(start - (stop - width), width) + np.arange(total)
    out = np.append(w.raw, np.uint8(0x20))[source]
    out[stop[~ends_row] - 1] = 0x20
    per_row = np.bincount(row, weights=width, minlength=rows).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())


def code_points(raw: np.ndarray) -> np.ndarray:
    """1 at each byte that starts a code point."""
    return (raw & 0xC0) != 0x80


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's LONG."""
    return h.view(np.int64)
