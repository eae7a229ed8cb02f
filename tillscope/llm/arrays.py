"""Vectorised word hashing over Arrow text columns, shared by the operators here.

Texts are handled as the UTF-8 bytes Arrow already holds. A slice of whole rows
(about half a megabyte, one row at least) is cut into tokens and every token
gets a 64-bit hash, all with array operations; no step loops over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

_LETTER, _MARK = 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[0x21:0x7F] = _MARK
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _KINDS[_first : _last + 1] = _LETTER
_POWERS: dict[str, np.ndarray] = {}
# First two bytes of the three of a sign in scripts without spaces between words: Thai, Lao, Myanmar, Khmer, Chinese, Japanese; full-width forms.
_SINGLE = np.zeros(1 << 16, bool)
for _first, _last in ((0xE0B8, 0xE0BB), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE380, 0xE9BF), (0xEFA4, 0xEFAB), (0xEFBC, 0xEFBE)):
    _SINGLE[_first : _last + 1] = True
# Their punctuation: U+3000 to U+303F but for two letters, the full-width forms of ASCII punctuation, and half-width marks.
_SINGLE_MARKS = frozenset(c for c in (*range(0x3000, 0x3040), 0x30FB, *range(0xFF01, 0xFF10), *range(0xFF1A, 0xFF21), *range(0xFF3B, 0xFF41), *range(0xFF5B, 0xFF66)) if c not in (0x3005, 0x3007))
_SINGLE_MARK = np.zeros(1 << 16, bool)
_SINGLE_MARK[list(_SINGLE_MARKS)] = True


class Tokens(NamedTuple):
    """Tokens of a slice of rows: hashes in order, the row of each, and the first token of each row (one more at the end)."""

    hashes: np.ndarray
    rows: np.ndarray
    bounds: np.ndarray


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(work: Callable) -> Callable:
    """The same function over batches; when it ends, freed memory goes back to the system.

    Python workers outlive a task and serve later stages; what their allocators keep
    would add up from stage to stage.
    """

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            _give_back()

    return released


def lean_group(work: Callable) -> Callable:
    """``lean`` for a function from the table of a group to a table."""

    def released(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            _give_back()

    return released


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    out = values ^ (values >> np.uint64(33))
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    out ^= out >> np.uint64(33)
    return out


def _powers(name: str, base: int, count: int) -> np.ndarray:
    known = _POWERS.get(name)
    if known is None or len(known) < count:
        steps = np.full(max(count, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        known = _POWERS[name] = np.multiply.accumulate(steps)
    return known[:count]


def text_array(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> pa.Array:
    """A plain string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.string()), "")
    return pc.utf8_lower(column) if lower else column


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about ``size`` bytes of text, at least one row each."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        yield first, min(last, len(column))
        first = min(last, len(column))


def slice_bytes(column: pa.Array, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows first to last, and where each row starts in them (one more at the end)."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset + first : column.offset + last + 1].astype(np.int64)
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return held, ends - ends[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running sum over all bytes."""
    inverse = _BASE_INVERSE if base == _BASE else pow(base, -1, 1 << 64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(f"up{base}", base, len(data)), out=total[1:])
    found = total[ends] - total[starts]
    found *= _powers(f"down{base}", inverse, len(data) + 1)[starts]
    return mix(found + (ends - starts).astype(np.uint64))


def _single_signs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where signs of scripts without spaces between words start, three bytes each, and which are punctuation."""
    at = np.flatnonzero((data[:-2] >= 0xE0) & (data[:-2] < 0xF0))
    pairs = data[at].astype(np.int64) << 8 | data[at + 1]
    at = at[_SINGLE[pairs]]
    points = (data[at].astype(np.int64) & 15) << 12 | (data[at + 1].astype(np.int64) & 63) << 6 | data[at + 2] & 63
    return at, _SINGLE_MARK[points]


def tokens(data: np.ndarray, offsets: np.ndarray, marks: bool = False) -> Tokens:
    """Words (runs of ASCII letters, digits and non-ASCII bytes); with ``marks`` runs of other printable signs too.

    A letter of a script without spaces between words is a word of its own.
    """
    kinds = _KINDS[data]
    single, mark = _single_signs(data) if len(data) > 2 else (np.zeros(0, np.int64), np.zeros(0, bool))
    for step in range(3):
        kinds[single[mark] + step] = _MARK
    if not marks:
        kinds[kinds == _MARK] = 0
    fresh = np.ones(len(kinds), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=fresh[1:])
    fresh[offsets[:-1][offsets[:-1] < len(kinds)]] = True
    letters = single[~mark]
    fresh[letters] = True
    fresh[letters[letters + 3 < len(kinds)] + 3] = True
    edges = np.flatnonzero(fresh)
    ends = np.append(edges[1:], len(kinds))
    real = kinds[edges] > 0
    starts, ends = edges[real], ends[real]
    bounds = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Tokens(span_hashes(data, starts, ends), rows, bounds)


def shingles(found: Tokens, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` following words, and the first shingle of each row (one more at the end).

    A row with fewer words, but any, has one shingle of all its words.
    """
    words, bounds = found.hashes, found.bounds
    counts = np.diff(bounds)
    numbers = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate(([0], np.cumsum(numbers)))
    total = int(out_bounds[-1])
    firsts = np.arange(total) - np.repeat(out_bounds[:-1], numbers) + np.repeat(bounds[:-1], numbers)
    stops = np.repeat(bounds[1:], numbers)
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    hashes = np.zeros(total, np.uint64)
    for step in range(size):
        here = padded[firsts + step]
        here[firsts + step >= stops] = np.uint64(step + 1)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes += here
    return mix(hashes), out_bounds
