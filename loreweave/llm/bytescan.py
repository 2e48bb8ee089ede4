"""A table-driven transducer over the UTF-8 bytes of texts, and a hash table of spans that compares their bytes.

The machine has two states, between and within a span, and reads one class of bytes at a time. Its next state depends
on the byte alone, so the states of a whole block of bytes are one table look-up and the outputs a second one; the
state, and the hash and length of a span that is still open, are carried from block to block. A text of any length is
read in blocks of ``block`` bytes; no array is as long as a text.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from .bytewords import BYTE_VALUES, PIECE, mix, powers

BETWEEN, WITHIN = 0, 1
#: Outputs of a step, as bits.
STARTS, ENDS, POINT, CAPITAL, SYMBOL, INK = 1, 2, 4, 8, 16, 32


def byte_set(*bounds: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in bounds:
        out[low : high + 1] = True
    return out


#: Fixed value: white space of the contracts.
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
LINE_BREAKS = byte_set((0x0A, 0x0A))
CAPITALS = byte_set((0x41, 0x5A))
#: Bytes that continue a code point.
TAILS = byte_set((0x80, 0xBF))


class Machine(NamedTuple):
    """``after[byte]`` is the next state, ``out[state, byte]`` the outputs of a step."""

    after: np.ndarray
    out: np.ndarray


def machine(between: np.ndarray, symbols: bytes = b"") -> Machine:
    """Spans are maximal runs of bytes outside ``between``."""
    after = np.where(between, BETWEEN, WITHIN).astype(np.uint8)
    own = np.zeros(256, np.uint8)
    own[~TAILS] |= POINT
    own[CAPITALS] |= CAPITAL
    own[list(symbols)] |= SYMBOL
    own[~SPACES] |= INK
    out = np.stack([own, own])
    out[BETWEEN, ~between] |= STARTS
    out[WITHIN, between] |= ENDS
    return Machine(after, out)


class Spans(NamedTuple):
    """Spans that end in a block, in order: first byte, length, text, hash of the bytes, bytes that are no white space."""

    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    ink: np.ndarray


class Reader:
    """Runs a machine over some texts. After the last block ``points``, ``capitals``, ``symbols``, ``ink`` (code points
    that are no white space) hold the counts of each text."""

    def __init__(self, m: Machine, data: np.ndarray, offsets: np.ndarray, block: int = PIECE):
        self.m, self.data, self.offsets, self.block = m, data, offsets, block
        self.points, self.capitals, self.symbols, self.ink = (np.zeros(len(offsets) - 1, np.int64) for _ in range(4))
        up, self._down = powers(block + 1)
        self._up, self._base = up, int(up[1])

    def _count(self, flags: np.ndarray, low: int) -> None:
        edges = np.clip(self.offsets - low, 0, len(flags))
        first, last = np.searchsorted(edges, 0, "right") - 1, np.searchsorted(edges, len(flags), "left")
        inner = edges[first : last + 1]
        for total, bits in ((self.points, POINT), (self.capitals, CAPITAL), (self.symbols, SYMBOL), (self.ink, POINT | INK)):
            total[first:last] += np.diff(np.searchsorted(np.flatnonzero((flags & bits) == bits), inner))

    def blocks(self) -> Iterator[Spans]:
        state, begun, raw, ink = BETWEEN, 0, 0, 0
        for low in range(0, len(self.data), self.block):
            part = self.data[low : low + self.block]
            n = len(part)
            edges = self.offsets[np.searchsorted(self.offsets, low) : np.searchsorted(self.offsets, low + n, "right")] - low
            after = self.m.after[part]
            before = np.empty(n, np.uint8)
            before[0], before[1:] = state, after[:-1]
            cut = np.unique(edges[edges > 0])
            cut = cut[after[cut - 1] == WITHIN]  # a text ends within a span
            if state == WITHIN and len(edges) and edges[0] == 0:
                cut = np.concatenate([[0], cut])
            before[edges[edges < n]] = BETWEEN
            flags = self.m.out[before, part]
            self._count(flags, low)
            start = np.flatnonzero(flags & STARTS)
            end = np.flatnonzero(flags & ENDS)
            end = np.sort(np.concatenate([end, cut])) if len(cut) else end
            sums, inked = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64)
            np.cumsum(BYTE_VALUES[part] * self._up[:n], out=sums[1:])
            np.cumsum((flags & INK) != 0, out=inked[1:])
            opened, open_ = np.concatenate([[0], start]) if state == WITHIN else start, state == WITHIN
            closed = opened[: len(end)]
            value = (sums[end] - sums[closed]) * self._down[closed]
            seen = inked[end] - inked[closed]
            first = closed + low
            if open_:
                done = pow(self._base, low - begun, 1 << 64)
                if len(end):
                    value[0] = np.uint64((raw + done * int(value[0])) % (1 << 64))
                    seen[0] += ink
                    first[0] = begun
            length = end + low - first
            if len(opened) > len(end):  # the last span goes on
                at = int(opened[-1])
                rest, more = (int(sums[n]) - int(sums[at])) * int(self._down[at]) % (1 << 64), int(inked[n] - inked[at])
                if open_ and not len(end):
                    raw, ink = (raw + pow(self._base, low - begun, 1 << 64) * rest) % (1 << 64), ink + more
                else:
                    raw, ink, begun = rest, more, low + at
                state = WITHIN
            else:
                state = BETWEEN
            yield Spans(first, length, np.searchsorted(self.offsets, first, "right") - 1, mix(value + length.astype(np.uint64)), seen)


class SpanTable:
    """Distinct (owner, bytes) of spans by open addressing. Two spans are one entry only if their bytes are equal."""

    def __init__(self, data: np.ndarray, block: int = PIECE):
        self.data, self.block, self.n = data, block, 0
        self.slots = np.full(1 << 12, -1, np.int32)
        self.start, self.length, self.owner, self.key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)

    def insert(self, start: np.ndarray, length: np.ndarray, owner: np.ndarray, hash_: np.ndarray) -> np.ndarray:
        """The entry number of each span."""
        key = mix(hash_ ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        self._reserve(len(start))
        mask = np.uint64(len(self.slots) - 1)
        step = (key >> np.uint64(40)) | np.uint64(1)
        at = key & mask
        ids = np.full(len(start), -1, np.int32)
        todo = np.arange(len(start))
        while len(todo):
            slot = at[todo].astype(np.int64)
            free = np.flatnonzero(self.slots[slot] < 0)
            if len(free):
                self.slots[slot[free]] = -2 - todo[free]  # of several spans that want a slot one gets it
                won = free[self.slots[slot[free]] == -2 - todo[free]]
                new = todo[won]
                ids[new] = np.arange(self.n, self.n + len(new), dtype=np.int32)
                self.slots[slot[won]] = ids[new]
                self.start[self.n : self.n + len(new)], self.length[self.n : self.n + len(new)] = start[new], length[new]
                self.owner[self.n : self.n + len(new)], self.key[self.n : self.n + len(new)] = owner[new], key[new]
                self.n += len(new)
            rest = ids[todo] < 0
            todo, slot = todo[rest], slot[rest]
            entry = self.slots[slot]
            same = self._equal(entry, start[todo], length[todo], owner[todo], key[todo])
            ids[todo[same]] = entry[same]
            todo = todo[~same]
            at[todo] = (at[todo] + step[todo]) & mask
        return ids

    def _reserve(self, more: int) -> None:
        need = self.n + more
        if need > len(self.start):
            size = max(need, len(self.start) * 3 // 2)
            for name in ("start", "length", "owner", "key"):
                old = getattr(self, name)
                new = np.zeros(size, old.dtype)
                new[: self.n] = old[: self.n]
                setattr(self, name, new)
        if 2 * need <= len(self.slots):
            return
        self.slots = np.full(1 << (2 * need - 1).bit_length(), -1, np.int32)
        mask, todo = np.uint64(len(self.slots) - 1), np.arange(self.n)
        at, step = self.key[: self.n] & mask, (self.key[: self.n] >> np.uint64(40)) | np.uint64(1)
        while len(todo):  # entries differ from each other, so nothing is compared
            slot = at[todo].astype(np.int64)
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            todo = todo[self.slots[slot] != todo]
            at[todo] = (at[todo] + step[todo]) & mask

    def _equal(self, entry: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = (self.key[entry] == key) & (self.length[entry] == length) & (self.owner[entry] == owner)
        some = np.flatnonzero(out)
        long = some[length[some] > self.block]
        for i in long.tolist():
            a, b, n = int(self.start[entry[i]]), int(start[i]), int(length[i])
            out[i] = np.array_equal(self.data[a : a + n], self.data[b : b + n])
        some = some[length[some] <= self.block]
        ends = np.cumsum(length[some])
        low = 0
        while low < len(some):  # about ``block`` bytes at once
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + self.block, "right")))
            part = some[low:high]
            n = length[part]
            first = np.cumsum(n) - n
            within = np.arange(int(n.sum())) - np.repeat(first, n)
            alike = self.data[np.repeat(self.start[entry[part]], n) + within] == self.data[np.repeat(start[part], n) + within]
            out[part] = np.logical_and.reduceat(alike, first)
            low = high
        return out
