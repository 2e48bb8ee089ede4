"""Fill-in-the-middle over texts that are stored as independent zstandard frames.

1. ``store`` writes each text as frames of ``FRAME`` bytes that can be decompressed alone, one after the other in one
   binary value, with an index: where frames end in the value and in the text, and how many code points and line ends
   come before.
2. ``cut`` finds a border between lines by binary search in the counts and decompresses only the frame that holds it.
3. ``outputs`` streams frames in the order of the output; the output is stored as frames itself. ``restored`` finds the
   markers there, rebuilds the text by streaming its parts in their first order, and is compared by digest.

Only one frame is decompressed at a time, so a long text needs memory for its compressed form and one frame.

Units are lines (``[^\\n]*\\n|[^\\n]+``). Draws come from SHA-256 of seed and doc_id, so reruns agree. A text that is
empty or holds a marker stays plain, as does the share of texts that is not drawn.

Edge cases: null text is empty; a null doc_id is drawn as the id ``''``; rows that repeat are cut alike; an empty
prefix, middle or suffix is allowed; other columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import TAILS
from .common import stage

#: Markers and draw of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50
FRAME = 64 << 10
LEVEL = 3
STORED = "frames binary, packed_ends array<bigint>, ends array<bigint>, points array<bigint>, breaks array<bigint>, n_units bigint"
FIELDS = ("frames", "packed_ends", "ends", "points", "breaks", "n_units")
KINDS = (pa.binary(), *[pa.list_(pa.int64())] * 4, pa.int64())


class Frames:
    """Bytes as independent frames with cumulative counts; ``ends[i]`` is the byte of the text at which frame i ends,
    ``points[i]`` and ``breaks[i]`` the code points and line breaks up to there."""

    def __init__(self, frames: bytes, packed_ends: list[int], ends: list[int], points: list[int], breaks: list[int], n_units: int):
        self.frames, self.packed_ends, self.ends, self.points, self.breaks, self.n_units = memoryview(frames), packed_ends, ends, points, breaks, n_units
        self._unpack = zstandard.ZstdDecompressor()

    @classmethod
    def pack(cls, parts: Iterable[bytes], size: int = FRAME, pack: zstandard.ZstdCompressor | None = None) -> Frames:
        """Frames of ``size`` bytes from pieces of any length."""
        pack = pack or zstandard.ZstdCompressor(level=LEVEL)
        out, packed_ends, ends, points, breaks, last = bytearray(), [], [], [], [], 10
        for frame in regular(parts, size):
            out += pack.compress(frame)
            b = np.frombuffer(frame, np.uint8)
            packed_ends.append(len(out))
            for counts, n in ((ends, len(b)), (points, len(b) - int(np.count_nonzero(TAILS[b]))), (breaks, frame.count(b"\n"))):
                counts.append((counts[-1] if counts else 0) + n)
            last = frame[-1]
        return cls(bytes(out), packed_ends, ends, points, breaks, (breaks[-1] if breaks else 0) + (last != 10))

    def row(self) -> tuple:
        return tuple(bytes(self.frames) if name == "frames" else getattr(self, name) for name in FIELDS)

    @property
    def size(self) -> int:
        return self.ends[-1] if self.ends else 0

    def frame(self, i: int) -> bytes:
        return self._unpack.decompress(self.frames[self.packed_ends[i - 1] if i else 0 : self.packed_ends[i]])

    def read(self, first: int, end: int) -> Iterator[bytes]:
        """Bytes ``first`` to ``end`` of the text, a frame at a time."""
        i = bisect_left(self.ends, first + 1)
        while first < end:
            low = self.ends[i - 1] if i else 0
            part = self.frame(i)[first - low : end - low]
            yield part
            first, i = first + len(part), i + 1

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, code point) at which the first ``units`` units end."""
        if units == 0:
            return 0, 0
        if units > self.breaks[-1]:  # the last unit has no line break
            return self.size, self.points[-1]
        i = bisect_left(self.breaks, units)
        b = np.frombuffer(self.frame(i), np.uint8)
        before = (self.ends[i - 1], self.points[i - 1], self.breaks[i - 1]) if i else (0, 0, 0)
        at = int(np.flatnonzero(b == 10)[units - before[2] - 1]) + 1
        return before[0] + at, before[1] + at - int(np.count_nonzero(TAILS[b[:at]]))

    def find(self, word: bytes, first: int) -> int:
        """The first byte of ``word`` at or behind ``first``; -1 if there is none."""
        rest, at = b"", first
        for part in self.read(first, self.size):
            part = rest + part
            found = part.find(word)
            if found >= 0:
                return at - len(rest) + found
            at += len(part) - len(rest)
            rest = part[len(part) - min(len(part), len(word) - 1) :]
        return -1


def regular(parts: Iterable[bytes], size: int) -> Iterator[bytes]:
    """The same bytes in pieces of ``size``."""
    held: list[bytes] = []
    n = 0
    for part in parts:
        view = memoryview(part)
        while len(view):
            some = view[: size - n]
            held.append(bytes(some))
            n, view = n + len(some), view[len(some) :]
            if n == size:
                yield b"".join(held)
                held, n = [], 0
    if n:
        yield b"".join(held)


def store(docs: DataFrame, size: int = FRAME) -> DataFrame:
    """doc_id, the frames of the text with their index, and whether the text holds a marker."""
    text = F.coalesce("text", F.lit(""))

    @F.arrow_udf(STORED)
    def run(texts: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        rows = []
        for value in texts:
            held = value.as_buffer()
            rows.append(Frames.pack(() if held is None else (memoryview(held),), size, pack).row())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(KINDS)], list(FIELDS))

    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    return docs.select("doc_id", marked.alias("marked"), run(text).alias("f")).select("doc_id", "marked", "f.*")


def draws(seed: int = SEED) -> dict[str, Column]:
    """Four numbers below 2 ** 32 for each doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return {f"h{i + 1}": F.conv(digest.substr(8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)}


def plan(stored: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``stored`` with the form of each output and the units before which its prefix and middle end. ``rate`` of 100
    texts are transformed, ``spm`` of 100 of them with the suffix first."""
    rows = stored.withColumns(draws(seed))
    plain = (F.col("n_units") == 0) | F.col("marked") | (F.col("h3") % 100 >= rate)
    a, b = (F.col(h) % (F.col("n_units") + 1) for h in ("h1", "h2"))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    return rows.withColumns({"form": form, "first_cut": F.least(a, b), "second_cut": F.greatest(a, b)}).drop("h1", "h2", "h3", "h4")


def parts(text: Frames, form: str, first: int, second: int) -> Iterator[bytes]:
    """The output of a text whose prefix ends at byte ``first`` and whose middle ends at byte ``second``."""
    ranges = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, text.size)}
    order = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}[form]
    if not order:
        yield from text.read(0, text.size)
    for marker in order:
        yield marker.encode()
        yield from text.read(*ranges[marker])


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text of an output: its parts lie behind the first occurrence of each marker, as no part holds a marker."""
    if form == "plain":
        yield from output.read(0, output.size)
        return
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    starts, at = [], 0
    for marker in order:
        starts.append(output.find(marker.encode(), at))
        at = starts[-1] + len(marker)
    ends = [*starts[1:], output.size]
    ranges = {marker: (start + len(marker), end) for marker, start, end in zip(order, starts, ends)}
    for marker in (PREFIX, MIDDLE, SUFFIX):
        yield from output.read(*ranges[marker])


def digest(pieces: Iterable[bytes]) -> str:
    h = hashlib.sha256()
    for piece in pieces:
        h.update(piece)
    return h.hexdigest()


def outputs(planned: DataFrame, size: int = FRAME) -> DataFrame:
    """doc_id, n_units, form, code points of prefix and middle (null if plain), the output as frames with their index,
    and the digests of the output and of the text that is rebuilt from it."""
    index = ", ".join(f"output_{x}" for x in STORED.split(", "))

    @F.arrow_udf(f"prefix_chars bigint, middle_chars bigint, {index}, output_sha256 string, restored_sha256 string")
    def run(rows: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        done = [one(row.as_py(), size, pack) for row in rows]
        names = ["prefix_chars", "middle_chars", *(f"output_{f}" for f in FIELDS), "output_sha256", "restored_sha256"]
        kinds = [pa.int64(), pa.int64(), *KINDS, pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds)], names)

    found = planned.select("doc_id", "n_units", "form", run(F.struct(*FIELDS, "form", "first_cut", "second_cut")).alias("o"))
    return found.select("doc_id", "n_units", "form", "o.*")


def one(row: dict, size: int, pack: zstandard.ZstdCompressor) -> tuple:
    text, form = Frames(*(row[f] for f in FIELDS)), row["form"]
    (first, a), (second, b) = (text.cut(row[c]) if form != "plain" else (0, 0) for c in ("first_cut", "second_cut"))
    output = Frames.pack(parts(text, form, first, second), size, pack)
    chars = (None, None) if form == "plain" else (a, b - a)
    return (*chars, *output.row(), digest(output.read(0, output.size)), digest(restored(output, form)))


def render(frames: Column) -> Column:
    """The text of frames: what independent frames hold one after the other."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        unpack = zstandard.ZstdDecompressor()
        return pa.array([None if v is None else unpack.decompressobj(read_across_frames=True).decompress(v).decode() if v else "" for v in values.to_pylist()], pa.string())

    return run(frames)


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``outputs`` of all of ``docs``; the frames of the texts are written to the shared folder first."""
    return outputs(plan(stage(store(docs), "fim-store"), seed, rate, spm))
