"""Hashed-text features and penalised linear fits, shared by the two classifiers.

A text is a sparse vector of hashed words and word beginnings; the value of an entry is log2(1 + count). Fits
run over a bounded, documented sample of labelled rows; scoring runs over every whole text in Arrow batches.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import Words, chunks, mix, shingles
from .common import small, stage

BITS = 20
#: Beginnings of words that are features of their own, in bytes.
BEGINNINGS = (5, 6, 7, 8, 10)


def features(data: np.ndarray, offsets: np.ndarray, style: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of some texts, ordered by text and feature; ``style`` adds how the text is written."""
    w = Words(data, offsets)
    text, start, end = w.text_of(), w.start, w.end
    keys, of = [w.hash(start, end)], [text]
    for n in BEGINNINGS:
        long = np.flatnonzero(end - start > n)
        keys.append(mix(w.hash(start[long], start[long] + n) + np.uint64(n)))
        of.append(text[long])
    for key, row in manners(w, data, offsets) if style else ():
        keys.append(key)
        of.append(row)
    # One number holds text and feature, so that a sort groups both.
    slot = np.concatenate(keys) >> np.uint64(64 - BITS)
    both, count = np.unique((np.concatenate(of).astype(np.uint64) << np.uint64(BITS)) | slot, return_counts=True)
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64), np.log2(1.0 + count).astype(np.float32)


def manners(w: Words, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature hash, text): runs of signs, and steps of the share of capitals, digits, signs, distinct words and
    distinct five-word runs, each share in half octaves."""
    n, rows = len(data), np.arange(len(offsets) - 1)
    sign = (data > 32) & (data < 127) & ~((data >= 48) & (data < 58)) & ~((data >= 65) & (data < 91)) & ~((data >= 97) & (data < 123))
    edges = np.zeros(n + 1, bool)
    edges[offsets] = True
    before, after = np.concatenate([[False], sign[:-1]]), np.concatenate([sign[1:], [False]])
    start, end = np.flatnonzero(sign & (~before | edges[:-1])), np.flatnonzero(sign & (~after | edges[1:])) + 1
    out = [(mix(w.hash(start, end) + np.uint64(101)), np.searchsorted(offsets, start, "right") - 1)]
    size = np.maximum(np.diff(offsets), 1)

    def step(share: np.ndarray, name: int) -> None:
        level = np.floor(-2 * np.log2(np.maximum(share, 2.0**-12))).astype(np.uint64)
        out.append((mix(level + np.uint64(1000 * name)), rows))

    for name, kind in enumerate(((data >= 65) & (data < 91), (data >= 48) & (data < 58), sign), 1):
        sums = np.concatenate([[0], np.cumsum(kind)])
        step((sums[offsets[1:]] - sums[offsets[:-1]]) / size, name)
    spread = (w.hashes(), w.text_of()), shingles(w, 5)
    for name, (hashes, of) in enumerate(spread, 4):
        order = np.lexsort((hashes, of))
        h, t = hashes[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        step(np.bincount(t[new], minlength=len(rows)) / np.maximum(np.bincount(t, minlength=len(rows)), 1), name)
    step(1 / (1.0 + np.diff(w.bounds)), 6)
    return out


def screen(texts: list[str | None], targets: list[np.ndarray], errors: float, least: int = 3, style: bool = False) -> np.ndarray:
    """Features that at least ``least`` texts hold and whose correlation with a target is beyond ``errors`` standard
    errors, in rising order. Only sums per feature are held, never the vectors of all texts."""
    n = max(1, len(texts))
    held, total, square = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS), np.zeros(1 << BITS)
    cross = [np.zeros(1 << BITS) for _ in targets]
    for first, end, data, offsets in chunks(pa.array(texts, pa.large_string())):
        row, col, value = features(data, offsets, style)
        np.add.at(held, col, 1)
        np.add.at(total, col, value)
        np.add.at(square, col, value**2)
        for c, y in zip(cross, targets):
            np.add.at(c, col, value * (y[first:end] - y.mean())[row])
    spread = np.sqrt(np.maximum(square / n - (total / n) ** 2, 1e-9))
    keep = np.zeros(1 << BITS, bool)
    for c, y in zip(cross, targets):
        keep |= np.abs(c) / np.sqrt(n) > errors * spread * max(float(y.std()), 1e-9)
    return np.flatnonzero(keep & (held >= least))


class Sample:
    """Vectors of some texts as one sparse matrix over the given features."""

    def __init__(self, texts: list[str | None], used: np.ndarray, style: bool = False):
        place = np.full(1 << BITS, -1)
        place[used] = np.arange(len(used))
        self.n, self.used = len(texts), used
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for first, _, data, offsets in chunks(pa.array(texts, pa.large_string())):
            row, col, value = features(data, offsets, style)
            keep = place[col] >= 0
            parts.append((row[keep] + first, place[col][keep], value[keep].astype(np.float64)))
        self.row, self.col, self.value = (np.concatenate(x) for x in zip(*parts))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.col], self.n)

    def back(self, residual: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * residual[self.row], len(self.used))

    def spread(self, weights: np.ndarray) -> np.ndarray:
        full = np.zeros(1 << BITS, np.float32)
        full[self.used] = weights
        return full

    def curvature(self) -> float:
        """Largest eigenvalue of the Gram matrix over n, by power iteration."""
        v = np.ones(len(self.used))
        size = 1.0
        for _ in range(20):
            v = self.back(self.times(v)) / max(1, self.n)
            size = float(np.linalg.norm(v)) or 1.0
            v /= size
        return size


def descend(start: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], step: float, lasso: np.ndarray, rounds: int) -> np.ndarray:
    """Accelerated proximal gradient with an L1 penalty per entry; deterministic."""
    at = ahead = start
    t = 1.0
    for _ in range(rounds):
        new = ahead - step * gradient(ahead)
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - at)
        at, t = new, t_new
    return at


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def sampled(docs: DataFrame, known: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """(doc_id, text, label) of the rows of ``docs`` that ``known`` (doc_id, label) names: all of them, or a share chosen by
    a hash of the id that is expected to be within both bounds. The choice is made among the labels, before any text
    is read, so that texts are not shuffled."""

    def part(df: DataFrame, share: float, seed: int) -> DataFrame:
        return df if share >= 1 else df.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    chosen = stage(part(known, most_rows / max(1, known.count()), 8), "sample-labels")
    rows = stage(docs.select("doc_id", "text").join(small(chosen), "doc_id"), "sample-texts")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    return part(rows, most_bytes / max(1, size), 9)


def margins(texts: pa.Array, weights: np.ndarray, style: bool = False) -> np.ndarray:
    """Weighted sum of each whole text."""
    out = np.zeros(len(texts))
    for first, end, data, offsets in chunks(texts):
        row, col, value = features(data, offsets, style)
        out[first:end] = np.bincount(row, value * weights[col], end - first)
    return out


def margin_column(text: Column, weights: np.ndarray, style: bool = False) -> Column:
    """Weighted sum of each whole text as a column; only the weights that are not zero travel to the tasks."""
    used = np.flatnonzero(weights)
    values = weights[used]

    @F.arrow_udf("double")
    def margin(texts: pa.Array) -> pa.Array:
        full = np.zeros(1 << BITS, np.float32)
        full[used] = values
        return pa.array(margins(texts, full, style))

    return margin(text)
