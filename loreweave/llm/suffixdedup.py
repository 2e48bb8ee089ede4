"""Removal of byte strings that an earlier document holds, with a logarithmic family of sparse suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id.

Sampled suffixes. Every window of LENGTH bytes names one of its positions, the one whose next ``GRAM`` bytes have the
smallest fingerprint (leftmost on ties). The choice depends on the window's bytes alone, so equal windows name equal
suffixes, and only named suffixes, about one in 14, enter the arrays. The windows that name one suffix are neighbours;
the bytes they span together are its context. A suffix array here is sorted by fingerprint of its suffixes.

Batches and levels. Documents are dealt into batches by rising doc_id. Key ranges of the arrays are owned by tasks; an
owner takes the batches in order, scans each new array against its levels (sorted merge) and merges levels of equal size
as in a binary counter, so that every entry is merged a logarithmic number of times. Answers go back as bit sets in the
order of the batch's own array. Three rounds, each only over what the round before left open:
  1. suffixes that occur in more than one batch (all others name windows that occur nowhere else outside the batch);
  2. their contexts: one that an earlier batch holds removes all its windows at once;
  3. windows, one by one, of suffixes that occur with different contexts - the edges of matches.
Matches inside a batch are found by the batch itself. Texts lie in a table bucketed by batch, so rounds move arrays and
bits, not texts. Fingerprints have 64 bits and contexts and windows are compared by them.

Edge cases: null text is empty; texts below LENGTH bytes lose nothing; rows with equal doc_id do not affect each other; a
null doc_id ranks behind all others; repeated rows get equal results; an empty table gives no rows. Memory of a task is
bounded by a batch (``BATCH`` bytes and the longest text) or by a key range.
"""
from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import BYTE_VALUES, PIECE, chunks, column_bytes, mix, powers
from .common import shared_path, stage

LENGTH, GRAM = 50, 24
BATCH = 16 << 20
PAIR = np.dtype([("key", np.uint64), ("context", np.uint64)])
#: Bytes of which windows are named at once.
STRIDE = 1 << 20
#: Entries of one key range, about.
RANGE = 1 << 18


class Suffixes:
    """Named suffixes of a batch, document after document: ``key`` and ``context`` fingerprints, the ``doc`` they lie in,
    the first and last window start (``low``, ``high``) that names each, in bytes of the batch, and its ``rank``."""

    def __init__(self, texts: pa.Array, rank: np.ndarray):
        parts: list[tuple[np.ndarray, ...]] = []
        _, self.offsets = column_bytes(texts)
        self.rank_of = rank
        for first, _, data, offsets in chunks(texts):
            for begin in range(0, len(data), STRIDE):
                # One window before, to see whether the first one goes on with a suffix, and what the last ones need.
                start, end = max(0, begin - 1), min(len(data), begin + STRIDE + 2 * LENGTH)
                found = self._sample(data[start:end], np.unique(np.clip(offsets, start, end)) - start)
                if found is None:
                    continue
                key, context, low, high = found
                low, high = low + start, high + start
                own = (low >= begin) & (low < begin + STRIDE)
                key, context, low, high = key[own], context[own], low[own], high[own]
                doc = np.searchsorted(offsets, low, "right") - 1
                base = int(self.offsets[first])
                parts.append((key, context, low + base, high + base, doc + first))
        empty = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
        self.key, self.context, self.low, self.high, self.doc = (np.concatenate(x) for x in zip(*parts)) if parts else empty
        self.rank = rank[self.doc]

    @staticmethod
    def _sample(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...] | None:
        n = len(data)
        if n < LENGTH:
            return None
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * up[:n], out=sums[1:])
        grams = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
        # The top 40 bits of the fingerprint and the position in one number: the least is the leftmost smallest. The same
        # rule holds in texts of any length, as none is read in larger pieces.
        least = grams & ~np.uint64((1 << 24) - 1)
        least |= np.arange(len(grams), dtype=np.uint64)
        wide, span = LENGTH - GRAM + 1, 1
        while span < wide:
            step = min(span, wide - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        # Windows that lie within one text.
        text_end = np.repeat(offsets[1:], np.diff(offsets))[: len(at)]
        inside = np.arange(len(at)) + LENGTH <= text_end
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
        low = np.flatnonzero(new)
        if len(low) == 0:
            return None
        last = inside.copy()
        last[:-1] &= ~inside[1:] | (at[1:] != at[:-1])
        high = np.flatnonzero(last)
        place = at[low]
        span_hash = (sums[high + LENGTH] - sums[low]) * down[low]
        shape = ((place - low).astype(np.uint64) << np.uint64(8)) | (high - low).astype(np.uint64)
        return mix(grams[place]), mix(mix(span_hash) ^ mix(shape + np.uint64(1))), low, high


def window_prints(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Fingerprints of the LENGTH bytes at each start (rising), in pieces of the batch."""
    out = np.zeros(len(start), np.uint64)
    for base in range(0, len(data), PIECE):
        low, high = np.searchsorted(start, [base, base + PIECE])
        if low == high:
            continue
        part = data[base : base + PIECE + LENGTH]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[part] * up[: len(part)], out=sums[1:])
        s = start[low:high] - base
        out[low:high] = mix((sums[s + LENGTH] - sums[s]) * down[s] + np.uint64(77))
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    s = np.sort(values)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def ranks(values: np.ndarray, rank: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of the distinct values, in order, among ``values``; place of each value among the distinct ones; smallest
    and largest rank of each distinct value). With ``more``, values are pairs."""
    order = np.argsort(values) if more is None else np.lexsort((more, values))
    s = values[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if more is not None:
        new[1:] |= more[order][1:] != more[order][:-1]
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    if len(first) == 0:
        return first, place, first, first
    of = rank[order]
    return order[first], place, np.minimum.reduceat(of, first), np.maximum.reduceat(of, first)


class Batch:
    """One batch in doc_id order, and what the rounds have found so far."""

    def __init__(self, t: pa.Table, answers: pa.Table | None, bits: int):
        ids = t["doc_id"].combine_chunks()
        none = ids.is_null().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy()
        order = np.lexsort((number, none))
        t = t.take(pa.array(order))
        number, none = number[order], none[order]
        self.rank = np.cumsum(np.concatenate([[0], (number[1:] != number[:-1]) | (none[1:] != none[:-1])])) if len(number) else np.zeros(0, np.int64)
        self.table = t
        text = t["text"].combine_chunks() if t.num_rows else pa.array([], pa.string())
        self.data, self.offsets = column_bytes(text)
        self.bits = bits
        self.found: dict[int, list[tuple[int, bytes]]] = {}
        for kind, part, flags in zip(*(answers[c].to_pylist() for c in ("round", "part", "flags"))) if answers else ():
            self.found.setdefault(kind, []).append((part, flags))
        self.s = Suffixes(text, self.rank)

    def flags(self, kind: int, n: int) -> np.ndarray:
        """The answers of a round in the order of the array that was asked; parts are key ranges in order, each with its
        number of entries before the bits."""
        out = [np.unpackbits(np.frombuffer(f[8:], np.uint8), count=int.from_bytes(f[:8], "big")) for _, f in sorted(self.found.get(kind, []))]
        got = np.concatenate(out).astype(bool) if out else np.zeros(0, bool)
        if len(got) != n:
            raise ValueError(f"round {kind}: {len(got)} answers for {n} entries")
        return got

    def keys(self) -> np.ndarray:
        return distinct(self.s.key)

    def live(self) -> np.ndarray:
        """Suffixes whose key occurs in another batch or in another document of this one."""
        first, place, low, high = ranks(self.s.key, self.s.rank)
        return ((high > low) | self.flags(1, len(first)))[place]

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(live suffixes; the distinct (key, context) of these, in order; which of them each has; its smallest rank)."""
        live = np.flatnonzero(self.live())
        key, context = self.s.key[live], self.s.context[live]
        first, place, low, _ = ranks(key, self.s.rank[live], context)
        pairs = np.empty(len(first), PAIR)
        pairs["key"], pairs["context"] = key[first], context[first]
        return live, pairs, place, low

    def judged(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes whose context an earlier document holds, suffixes whose windows are to be asked)."""
        live, pairs, place, low = self.contexts()
        both = self.flags(2, 2 * len(pairs)).reshape(-1, 2)
        held = both[place, 0] | (low[place] < self.s.rank[live])
        return live[held], live[~held & both[place, 1]]

    def windows(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, fingerprint, rank) of all windows that name the asked suffixes."""
        n = self.s.high[asked] - self.s.low[asked] + 1
        start = np.repeat(self.s.low[asked] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return start, window_prints(self.data, start), np.repeat(self.s.rank[asked], n)

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Removed spans of bytes of the batch, apart from each other and in order."""
        held, asked = self.judged()
        start, prints, rank = self.windows(asked)
        first, place, low, _ = ranks(prints, rank)
        gone = self.flags(3, len(first))[place] | (low[place] < rank)
        a = np.concatenate([self.s.low[held], start[gone]])
        b = np.concatenate([self.s.high[held] + LENGTH, start[gone] + LENGTH])
        if len(a) == 0:
            return a, b
        order = np.argsort(a, kind="stable")
        a, reach = a[order], np.maximum.accumulate(b[order])
        # A span ends where the next start lies beyond it, or in another text.
        text = np.searchsorted(self.offsets, a, "right")
        first = np.flatnonzero(np.concatenate([[True], (a[1:] > reach[:-1]) | (text[1:] != text[:-1])]))
        return a[first], reach[np.append(first[1:], len(a)) - 1]

    def ask(self, entries: np.ndarray, number: int) -> pa.Table:
        """Rows (part, batch, entries) of a sorted array, cut by the leading bits of its key."""
        key = entries["key"] if entries.dtype.names else entries
        part = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        blobs = [entries[x:y].tobytes() for x, y in zip(cuts, np.append(cuts[1:], len(part)))]
        return pa.table({"part": pa.array(part[cuts], pa.int64()), "batch": pa.array([number] * len(blobs), pa.int32()), "entries": pa.array(blobs, pa.binary())})

    def results(self) -> pa.Table:
        a, b = self.spans()
        text = np.searchsorted(self.offsets, a, "right") - 1 if len(a) else np.zeros(0, np.int64)
        n = len(self.offsets) - 1
        n_bytes = np.diff(self.offsets)
        removed = np.bincount(text, b - a, n).astype(np.int64)
        bounds = np.searchsorted(text, np.arange(n + 1))
        digest, kept = [], []
        for i in range(n):
            low, high = int(self.offsets[i]), int(self.offsets[i + 1])
            rest, at = [], low
            for k in range(bounds[i], bounds[i + 1]):
                rest.append(self.data[at : a[k]])
                at = int(b[k])
            rest.append(self.data[at:high])
            whole = b"".join(x.tobytes() for x in rest)
            kept.append(whole)
            digest.append(hashlib.sha256(whole).hexdigest())
        return pa.table({
            "doc_id": self.table["doc_id"], "n_bytes": pa.array(n_bytes), "n_removed": pa.array(removed), "n_spans": pa.array(np.diff(bounds)),
            "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.binary()),
        })


class Levels:
    """Sorted arrays of distinct values; equal-sized ones (in batches) merge."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray]] = []

    def scan(self, new: np.ndarray) -> np.ndarray:
        """Which values of an array any level holds; fastest if it is sorted."""
        held = np.zeros(len(new), bool)
        for _, level in self.levels:
            at = np.searchsorted(level, new)
            at[at == len(level)] = 0
            held |= level[at] == new
        return held

    def add(self, new: np.ndarray) -> None:
        if len(new) == 0:
            return
        size = 1
        while self.levels and self.levels[-1][0] == size:
            n, level = self.levels.pop()
            new, size = distinct(np.concatenate([level, new])), size + n
        self.levels.append((size, new))


ASKED = "part bigint, batch int, entries binary"
ANSWER = "batch int, round int, part bigint, flags binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def answerer(kind: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for ``mapInArrow`` over ASKED, sorted by part and batch: the answers of one key range after another."""
    dtype = PAIR if kind == 2 else np.dtype(np.uint64)

    def one(part: int, asked: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
        if kind == 1:
            # A filter before the index: what occurs in two batches or more, whichever comes first. The parts of
            # one batch hold a value once each, as the batch is whole in its task.
            every = np.sort(np.concatenate([new for _, new in asked]))
            again = Levels()
            again.add(distinct(every[1:][every[1:] == every[:-1]]))
            return [(batch, again.scan(new)) for batch, new in asked]
        levels, out = Levels(), []
        if kind == 3:
            for batch, new in asked:
                out.append((batch, levels.scan(new)))
                levels.add(new)
            return out
        every = np.concatenate([new for _, new in asked])
        first, *_ = ranks(every["key"], np.zeros(len(every), np.int64), every["context"])
        keys = every["key"][first]
        many = Levels()
        many.add(distinct(keys[1:][keys[1:] == keys[:-1]]))
        for batch, new in asked:
            value = np.ascontiguousarray(new["context"])
            out.append((batch, np.column_stack([levels.scan(value), many.scan(np.ascontiguousarray(new["key"]))]).ravel()))
            levels.add(distinct(value))
        return out

    def emit(part: int, asked: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        rows = one(part, asked)
        flags = [len(f).to_bytes(8, "big") + np.packbits(f).tobytes() for _, f in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array(flags, pa.binary())],
            ["batch", "round", "part", "flags"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, asked = None, []
        for b in batches:
            for p, number, entries in zip(b.column("part").to_pylist(), b.column("batch").to_pylist(), b.column("entries")):
                if p != part and asked:
                    yield emit(part, asked)
                    asked = []
                part = p
                asked.append((number, np.frombuffer(entries.as_buffer(), dtype)))
        if asked:
            yield emit(part, asked)

    return run


def asker(kind: int, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function for a cogroup of texts and answers by batch: what the batch asks in a round."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Batch(left, right, bits)
        if kind == 1:
            what = b.keys()
        elif kind == 2:
            what = b.contexts()[1]
        else:
            what = distinct(b.windows(b.judged()[1])[1])
        return b.ask(what, left["batch"][0].as_py())

    return ask


def dealt(docs: DataFrame, size: int) -> tuple[DataFrame, str, int]:
    """(the texts in a table bucketed by ``batch``, which rises with doc_id; its name; their bytes)."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    n = max(1, math.ceil(total / size))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_last()).withColumn("batch", F.spark_partition_id())
    name = f"suffix_texts_{uuid.uuid4().hex}"
    ranged.write.bucketBy(n, "batch").option("path", shared_path(spark, "suffix-texts")).saveAsTable(name)
    return spark.table(name), name, total


def remove_seen(docs: DataFrame, size: int = BATCH, entries: int = RANGE) -> DataFrame:
    """RESULT of every row; ``kept`` holds the bytes that stay."""
    spark = docs.sparkSession
    texts, name, total = dealt(docs, size)
    # About one suffix in 14 bytes; a power of two of key ranges.
    bits = max(6, math.ceil(math.log2(max(1, total / 14 / entries))))
    answers = stage(spark.createDataFrame([], ANSWER), "suffix-answers")
    for kind in (1, 2, 3):
        asked = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(asker(kind, bits), ASKED)
        owned = asked.repartition("part").sortWithinPartitions("part", "batch")
        answers = stage(answers.unionByName(owned.mapInArrow(answerer(kind), ANSWER)), "suffix-answers")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        return Batch(left, right, bits).results()

    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, RESULT)
