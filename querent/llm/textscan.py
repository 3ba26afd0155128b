"""Whole-column text scans in numpy over Arrow's UTF-8 buffers: words, word hashes, code points.

Batches are worked on in blocks of about BLOCK bytes (a longer text is a block of its own), so memory
is bounded by the block or the longest text, not by the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 400_000
_U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random odd multiplier congruent to 3 mod 8, its inverse mod 2**64, and a random value for each byte.
_BASE = _U(int(_rng.integers(0, 2**61)) * 8 + 3)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_RANDOM = _rng.integers(0, 2**64, 256, dtype=_U)
#: \x20 and \x09 to \x0d.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _byte_values(lower: bool) -> np.ndarray:
    out = _RANDOM.copy()
    if lower:
        out[65:91] = out[97:123]
    out[SPACE] = 0
    return out


_VALUES = {True: _byte_values(True), False: _byte_values(False)}


def power_table(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 mod 2**64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, BLOCK // 2), base, _U)
        steps[0] = 1
        known = _powers[int(base)] = np.multiply.accumulate(steps)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that makes all of them depend on each."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the rows + 1 offsets of its texts; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def tidy() -> None:
    """Give freed memory back: Arrow's pool and the C heap otherwise keep what their largest batch took, and
    a worker lives on through later stages."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over an iterator of batches, and tidy() at its end."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows of up to limit bytes; a longer row alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, boundary: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and the rows + 1 offsets of the rows' words in that list."""
    gap = boundary[data]
    start = ~gap
    start[1:] &= gap[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = ~gap[heads]
    at = np.flatnonzero(start)
    return at, np.searchsorted(at, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased if asked), and the rows' offsets in the list."""
    at, rows = word_spans(data, offsets)
    if not len(at):
        return np.zeros(0, _U), rows
    sums = np.add.reduceat(_VALUES[lower][data] * power_table(_BASE, len(data)), at)
    return mix(sums * power_table(_INVERSE, len(data))[at]), rows


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-32 code points of the texts, and their offsets."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ahead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, ahead[offsets]
