"""Words and their hashes, vectorised over the UTF-8 bytes of an Arrow text column (numpy inside tasks).

Words are runs of 0-9, a-z, A-Z and all bytes above 127, which is every character outside ASCII; A-Z count as
a-z. All functions see whole texts; only the number of texts handled at once is bounded.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_IS_WORD = np.zeros(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IS_WORD[_low:_high] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BYTE_VALUES = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes of text that array operations work on at once, if texts are shorter; small, to stay in cache and memory.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (finaliser of the splitmix generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(PIECE << 1, 1 << max(0, n - 1).bit_length())
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], wide, len(column) + 1, column.offset * np.dtype(wide).itemsize) if len(column) else np.zeros(1, wide)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def chunks(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive whole texts with about ``size`` bytes together."""
    data, offsets = column_bytes(column)
    first = 0
    while first < len(offsets) - 1:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """Words of some texts: ``start`` and ``end`` in bytes, ``bounds`` of each text's words, prefix sums for hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        edges = np.zeros(n + 1, bool)
        edges[offsets] = True
        letter = np.zeros(n + 2, bool)
        letter[1:-1] = _IS_WORD[data]
        inside = letter[1:-1]
        self.start = np.flatnonzero(inside & (~letter[:-2] | edges[:-1]))
        self.end = np.flatnonzero(inside & (~letter[2:] | edges[1:])) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.lower = _LOWER[data]
        up, self._down = powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[self.lower] * up[:n], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each span of bytes."""
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.hash(self.start, self.end)

    def text_of(self) -> np.ndarray:
        """The text to which each word belongs."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``n`` words; a text of fewer words, but not none, has one of them all."""
    h, text = w.hashes(), w.text_of()
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    if len(h) < n:
        out, whole = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    else:
        whole = np.flatnonzero(text[: len(h) - n + 1] == text[n - 1 :])
        out = np.zeros(len(whole), np.uint64)
        for i in range(n):
            out += mix(h[whole + i] ^ salt[i])
    count = np.diff(w.bounds)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short) == 0:
        return mix(out), text[whole]
    less = np.zeros(len(short), np.uint64)
    for i in range(n - 1):
        has = count[short] > i
        less[has] += mix(h[w.bounds[short[has]] + i] ^ salt[i])
    return mix(np.concatenate([out, less])), np.concatenate([text[whole], short])
