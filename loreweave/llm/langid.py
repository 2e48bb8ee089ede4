"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: at every context of up to ``ORDER`` bytes that its sample holds, the
counts of the bytes that followed. Statistics are frozen after training. The code length of a byte is that of the
longest known context: -log2 of its share if the byte followed there (escape method C: the number of distinct
followers counts as one more symbol), else the escape plus the code length at the context one byte shorter, down to a
uniform code over 256 values. A text is given the language that codes it in the fewest bits.

Because the statistics are frozen, each (context, byte) has one fixed cost per language. ``Tables`` lists them all by
dense numbers: byte class, pair of classes and known context of ``ORDER`` bytes, so that scoring is a few array
look-ups for each byte of the whole text, with no loop over bytes.

Edge cases: null text, or a text without a letter, is ``und`` with score 0; null languages are not learned from; rows
with a null id are predicted, and neither held out nor learned from; equal code lengths go to the language that sorts
first; without any sample every text is ``und``; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import chunks
from .common import small, stage

ORDER = 3
#: Bytes of text that are learned from per language, at most (in expectation; see ``sample``).
MOST_BYTES = 1 << 20


class Tables:
    """Frozen costs in bits. Bytes that no sample holds share class 0 and cost the same everywhere."""

    def __init__(self, grams: dict[str, dict[int, np.ndarray]]):
        """``grams``: see ``count_grams``."""
        self.languages = sorted(grams)
        seen = np.zeros(256, bool)
        for by in grams.values():
            seen |= by[0] > 0
        self.symbols = np.flatnonzero(seen)
        self.klass = np.zeros(256, np.uint32)
        self.klass[self.symbols] = np.arange(1, len(self.symbols) + 1)
        self.a = len(self.symbols) + 1
        self._fill(grams)

    def _fill(self, grams: dict[str, dict[int, np.ndarray]]) -> None:
        a, n = self.a, len(self.languages)
        contexts = sorted({c for by in grams.values() for c in by[ORDER]})
        self.node = np.zeros(a**3, np.int32)
        coded = [(self.klass[c >> 16 & 255] * a + self.klass[c >> 8 & 255]) * a + self.klass[c & 255] for c in contexts]
        self.node[np.array(coded, np.int64)] = np.arange(1, len(contexts) + 1)
        # Order 0: class 0 has 256 - (a - 1) members of equal cost.
        zero = np.zeros((n, a))
        for i, lang in enumerate(self.languages):
            zero[i] = self._level(grams[lang][0][self.symbols], np.full(a, 8.0))
        one = np.repeat(zero[:, None, :], a, axis=1)
        two: dict[int, np.ndarray] = {}
        for i, lang in enumerate(self.languages):
            for c, follow in grams[lang][1].items():
                one[i, self.klass[c]] = self._level(follow[self.symbols], zero[i])
        pairs = sorted({c for by in grams.values() for c in by[2]})
        for c in pairs:
            base = one[:, self.klass[c & 255]]
            two[c] = np.stack([self._level(grams[l][2][c][self.symbols], base[i]) if c in grams[l][2] else base[i] for i, l in enumerate(self.languages)])
        # Rows: the known contexts of three bytes, then, for all else, those of two bytes, then of one.
        top = np.zeros((len(contexts), a, n), np.float32)
        for k, c in enumerate(contexts):
            base = two[c & 0xFFFF]
            for i, l in enumerate(self.languages):
                top[k, :, i] = self._level(grams[l][3][c][self.symbols], base[i]) if c in grams[l][3] else base[i]
        self.pair = np.zeros(a * a, np.int32)
        for k, c in enumerate(pairs):
            self.pair[self.klass[c >> 8] * a + self.klass[c & 255]] = k + 1
        low = np.stack([two[c].T for c in pairs]).astype(np.float32) if pairs else np.zeros((0, a, n), np.float32)
        self.costs = np.concatenate([top, low, one.transpose(1, 2, 0).astype(np.float32)]).reshape(-1, n)
        rows_low, rows_one = len(contexts), len(contexts) + len(pairs)
        # One row number for every three classes: the longest context that any language knows.
        pair_row = np.where(self.pair > 0, rows_low + self.pair - 1, rows_one + np.tile(np.arange(a), a))
        self.row = np.where(self.node > 0, self.node - 1, np.tile(pair_row, a)).astype(np.int32)
        del self.node, self.pair

    def _level(self, follow: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Costs at one context from the counts of the symbols that followed it and the costs one byte shorter."""
        total, distinct = follow.sum(), (follow > 0).sum()
        if total == 0:
            return shorter.copy()
        out = shorter + np.log2(total + distinct) - np.log2(distinct)
        known = np.flatnonzero(follow)
        out[known + 1] = np.log2(total + distinct) - np.log2(follow[known])
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(text, language): exact code length of each whole text. Contexts start anew with each text, after
        imagined line breaks."""
        a, pad = self.a, ORDER
        size = np.diff(offsets)
        filled = np.full(len(data) + pad * len(size), 10, np.uint8)
        at = np.arange(len(data)) + pad * (np.repeat(np.arange(len(size)), size) + 1)
        filled[at] = data
        k = self.klass[filled]
        three = np.zeros(len(k), np.uint32)
        three[3:] = (k[:-3] * np.uint32(a) + k[1:-2]) * np.uint32(a) + k[2:-1]
        cost = self.costs[self.row[three[at]].astype(np.int64) * a + k[at]]
        sums = np.zeros((len(size), len(self.languages)))
        some = np.flatnonzero(size)
        if len(some):
            sums[some] = np.add.reduceat(cost, offsets[some], axis=0, dtype=np.float64)
        return sums


def count_grams(texts: list[tuple[str, str]]) -> dict[str, dict[int, np.ndarray]]:
    """Counts by language of what follows each context of 0 to ``ORDER`` bytes in (language, text) pairs."""
    out: dict[str, dict] = {}
    for lang in sorted({lang for lang, _ in texts}):
        joined = b"".join(b"\n" * ORDER + text.encode() for of, text in texts if of == lang)
        b = np.frombuffer(joined, np.uint8).astype(np.int64)
        levels: dict[int, object] = {0: np.bincount(b[ORDER:], minlength=256)}
        for k in range(1, ORDER + 1):
            context = sum(b[ORDER - j : len(b) - j] << (8 * (j - 1)) for j in range(1, k + 1))
            keys, count = np.unique(context * 256 + b[ORDER:], return_counts=True)
            table: dict[int, np.ndarray] = {}
            for key, n in zip(keys.tolist(), count.tolist()):
                table.setdefault(key >> 8, np.zeros(256, np.int64))[key & 255] = n
            levels[k] = table
        out[lang] = levels
    return out


def sample(docs: DataFrame, learn: Column, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(lang, text) of learned rows: all of a language with at most ``most_bytes`` of text, else a share of its rows,
    chosen by a hash of the id, with that expected size."""
    known = docs.select("doc_id", "lang", "text").filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"))
    place = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return known.join(small(stage(sizes, "langid-sizes")), "lang").filter(place * F.col("size") < most_bytes).select("lang", "text")


def train(docs: DataFrame, learn: Column, most_bytes: int = MOST_BYTES) -> Tables | None:
    """Tables from a bounded sample; None if there is nothing to learn from."""
    rows = sample(docs, learn, most_bytes).toPandas()
    texts = sorted(zip(rows["lang"], rows["text"]))
    return Tables(count_grams(texts)) if texts else None


def predict(spark: SparkSession, text: Column, tables: Tables | None) -> Column:
    """Struct (lang, score): the language of the whole text, and its share of the likelihood that all languages give
    to the text, after the lengths are scaled to at most 64 bytes (else the score of any long text would be 1)."""
    if tables is None:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    broadcast = spark.sparkContext.broadcast(tables)

    @F.arrow_udf("lang string, score double")
    def run(texts: pa.Array) -> pa.Array:
        t = broadcast.value
        names = np.array(t.languages, object)
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        letters = has_letter(texts)
        for first, end, data, offsets in chunks(texts):
            bits = t.bits(data, offsets)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(bits)), best]
            scale = np.minimum(1.0, 64 / np.maximum(np.diff(offsets), 1))
            lang[first:end] = names[best]
            score[first:end] = 1 / np.exp2((least[:, None] - bits) * scale[:, None]).sum(axis=1)
        lang[~letters], score[~letters] = "und", 0.0
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])

    return run(text)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    return pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
