"""Quality rules on how public tokenisers take a text.

``measure`` reads each whole text by the transducer of ``bytescan`` and numbers its distinct words in a hash table that
compares bytes; every distinct word of a block of texts is encoded once, by a piece vocabulary with byte fallback and by
a byte-level vocabulary, and the rest is arithmetic on word numbers. A text is judged by four figures:

* ``chars_per_piece`` and ``chars_per_rank``: code points of its words for each token of the two vocabularies,
* ``fallback_share``: tokens that are single bytes, for want of a piece,
* ``evenness``: entropy of its tokens in bits, over that of as many different ones (0 if there is one token at most).

``bands`` takes the quartiles of each figure over all rows that pass the base rules, per language, script and doubling
of the number of tokens (short texts vary more, and evenness falls with length), from exact histograms. A text is
rejected where a figure lies further outside the quartiles than ``reach`` times their distance (or a least distance).

Words are encoded one by one, with the blank before them; words of more than ``LONGEST`` code points in parts of that
length. Vocabularies are files of the given folder, read by the driver and sent to the executors (about 1.5 MB).

Edge cases: null text has no words and, like every text below 20 words, fails the base rules; a null language is a
language of its own; a text without letters has the script ``none``; repeated rows are judged alike and each count in
the bands; a text of any length is read in blocks; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import LINE_BREAKS, SPACES, Reader, SpanTable, machine
from .bytewords import PIECE, chunks, mix
from .common import small, stage

#: Fixed value: the symbols of the base rules.
SYMBOLS = b"#*$%&|<>"
#: Fixed value: words of a window of the base rules.
WINDOW = 8
FOLDER = "/opt/tokenizers"
PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONGEST = 256
#: Words that a worker remembers.
KNOWN = 1 << 18
#: Scripts by the first byte of a code point in UTF-8: name, first and last byte.
SCRIPTS = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC3, 0xCB), ("greek", 0xCE, 0xCF), ("cyrillic", 0xD0, 0xD3), ("armenian", 0xD4, 0xD5),
    ("hebrew", 0xD6, 0xD7), ("arabic", 0xD8, 0xDB), ("indic", 0xE0, 0xE0), ("kana", 0xE3, 0xE3), ("han", 0xE4, 0xE9), ("hangul", 0xEA, 0xED),
)
NAMES = ("none", *dict.fromkeys(name for name, _, _ in SCRIPTS))
_SCRIPT_OF = np.zeros(256, np.uint8)
for _name, _low, _high in SCRIPTS:
    _SCRIPT_OF[_low : _high + 1] = NAMES.index(_name)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_pieces", "n_ranks", "n_fallback")
#: Figure: bins for each unit, least distance of the quartiles, whether a low and a high value count against a text.
FIGURES = {
    "chars_per_piece": (1000, 0.04, True, True),
    "chars_per_rank": (1000, 0.04, True, True),
    "fallback_share": (1000, 0.01, False, True),
    "evenness": (1000, 0.02, True, False),
}
REACH = 3.0


class Files:
    """Bytes of the two vocabularies."""

    def __init__(self, folder: str = FOLDER):
        self.pieces, self.ranks = (Path(folder, name).read_bytes() for name in (PIECES, RANKS))


class Encoder:
    """Tokens of words; what was encoded is remembered until ``KNOWN`` words are."""

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, files.ranks.splitlines())}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_break = ranks[b"\n"]
        self.size = self.pieces.vocab_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.size)])
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.n_ranks = np.zeros(0, np.int64)
        self.first, self.tokens = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Of each word its place in ``n_ranks`` and ``first``; ``tokens[first[i] : first[i + 1]]`` are its pieces.
        Places hold until the next call."""
        if len(self.number) + len(words) > KNOWN:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        lengths, tokens, n_ranks = [], [self.tokens], []
        for low in range(0, len(new), 1024):
            some = [w.decode("utf-8", "replace") for w in new[low : low + 1024]]
            whole = [w if len(w) <= LONGEST else "" for w in some]
            found = self.pieces.encode(whole, num_threads=1)
            count = self._count_ranks(whole).tolist()
            for i, w in enumerate(some):
                if not whole[i] and w:
                    found[i], count[i] = self._parts(w)
            lengths += map(len, found)
            n_ranks += count
            tokens.append(np.fromiter(chain.from_iterable(found), np.int32))
        base = len(self.number)
        self.number.update((w, base + i) for i, w in enumerate(new))
        if new:
            self.tokens, self.n_ranks = np.concatenate(tokens), np.concatenate([self.n_ranks, n_ranks]).astype(np.int64)
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])
        return np.fromiter((self.number[w] for w in words), np.int64, len(words))

    def _count_ranks(self, words: list[str]) -> np.ndarray:
        """Tokens of each word. Line breaks, which no word holds, part the words in one call, unless one ends or begins
        with white space outside ASCII that would join them."""
        found = np.asarray(self.ranks.encode_ordinary("".join(f" {w}\n" for w in words)))
        ends = np.flatnonzero(found == self.line_break)
        if len(ends) == len(words):
            return np.diff(ends, prepend=-1) - 1
        return np.array([len(self.ranks.encode_ordinary(f" {w}")) for w in words])

    def _parts(self, word: str) -> tuple[np.ndarray, int]:
        tokens, n = [], 0
        for low in range(0, len(word), LONGEST * 1024):
            parts = [word[i : i + LONGEST] for i in range(low, min(low + LONGEST * 1024, len(word)), LONGEST)]
            tokens.append(np.fromiter(chain.from_iterable(self.pieces.encode(parts, num_threads=1)), np.int32))
            n += int(self._count_ranks(parts).sum())
        return np.concatenate(tokens), n


@lru_cache(maxsize=1)
def encoder(files: Broadcast) -> Encoder:
    return Encoder(files.value)


def repeated(ids: np.ndarray, bounds: np.ndarray, n: int = WINDOW, block: int = PIECE) -> np.ndarray:
    """Of each text (words ``bounds[i]`` to ``bounds[i + 1]``) the words in windows of ``n`` that occur twice in it.
    Windows are equal if hashes of their word numbers are."""
    total = max(0, len(ids) - n + 1)
    value, inside = np.zeros(total, np.uint64), np.zeros(total, bool)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    for low in range(0, total, block):
        high = min(low + block, total)
        text = np.searchsorted(bounds, np.arange(low, high + n - 1), "right")
        inside[low:high] = text[: high - low] == text[n - 1 :]
        for i in range(n):
            value[low:high] += mix(ids[low + i : high + i].astype(np.uint64) ^ salt[i])
        value[low:high] = mix(value[low:high] ^ mix(text[: high - low].astype(np.uint64)))
    ordered = value[inside]
    ordered.sort()
    twice = np.unique(ordered[:-1][ordered[1:] == ordered[:-1]])
    del ordered
    edge = np.zeros(len(ids) + 1, np.int32)
    for low in range(0, total if len(twice) else 0, block):
        part = value[low : low + block]
        hit = low + np.flatnonzero(inside[low : low + block] & (twice[np.minimum(np.searchsorted(twice, part), len(twice) - 1)] == part))
        edge[hit] += 1
        edge[hit + n] -= 1
    del value, inside
    np.cumsum(edge, out=edge)
    out = np.zeros(len(bounds) - 1, np.int64)
    for low in range(0, len(ids), block):
        covered = low + np.flatnonzero(edge[low : min(low + block, len(ids))])
        out += np.diff(np.searchsorted(covered, bounds))
    return out


def measures(texts: pa.Array, enc: Encoder) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Counts by name, bits of entropy, script number of whole texts."""
    out = {name: np.zeros(len(texts), np.int64) for name in COUNTS}
    bits, script = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    by_word, by_line = machine(SPACES, SYMBOLS), machine(LINE_BREAKS)
    for first, end, data, offsets in chunks(texts, 4 * PIECE):
        n, here = end - first, slice(first, end)
        reader, table, ids = Reader(by_word, data, offsets), SpanTable(data), []
        letters = np.zeros(n * len(NAMES), np.int64)
        for s in reader.blocks():
            out["n_words"][here] += np.bincount(s.text, minlength=n)
            ids.append(table.insert(s.start, s.length, np.zeros(len(s.start), np.int32), s.hash))
        for low in range(0, len(data), PIECE):
            text = np.searchsorted(offsets, np.arange(low, min(low + PIECE, len(data))), "right") - 1
            letters += np.bincount(text * len(NAMES) + _SCRIPT_OF[data[low : low + PIECE]], minlength=len(letters))
        letters = letters.reshape(n, len(NAMES))
        script[here] = np.where(letters[:, 1:].any(axis=1), letters[:, 1:].argmax(axis=1) + 1, 0)
        out["word_chars"][here], out["n_symbols"][here] = reader.ink, reader.symbols
        lines, seen = Reader(by_line, data, offsets), SpanTable(data)
        for s in lines.blocks():
            some = s.ink > 0
            out["n_dup_lines"][here] += np.bincount(s.text[some], minlength=n)
            seen.insert(s.start[some], s.length[some], s.text[some], s.hash[some])
        out["n_dup_lines"][here] -= np.bincount(seen.owner[: seen.n], minlength=n)
        numbers = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        bounds = np.concatenate([[0], np.cumsum(out["n_words"][here])])
        out["n_repeat_words"][here] = repeated(numbers, bounds)
        _tokens(out, bits, here, bounds, numbers, table, enc)
    return out, bits, script


def _tokens(out: dict[str, np.ndarray], bits: np.ndarray, here: slice, bounds: np.ndarray, numbers: np.ndarray, table: SpanTable, enc: Encoder) -> None:
    """Fill in what concerns tokens. A long text is alone in its block, so its token counts are one array."""
    n = here.stop - here.start
    data = memoryview(table.data)
    words = [bytes(data[a : a + k]) for a, k in zip(table.start[: table.n].tolist(), table.length[: table.n].tolist())]
    place = enc.numbers(words)
    size = np.diff(enc.first)[place]
    below = np.concatenate([[0], np.cumsum(enc.is_byte[enc.tokens])])
    fallback = (below[enc.first[1:]] - below[enc.first[:-1]])[place]
    n_ranks = enc.n_ranks[place]
    whole, sums = np.zeros(enc.size, np.int64), np.zeros(n)
    for low in range(0, len(numbers), PIECE):
        part = numbers[low : low + PIECE]
        text = np.searchsorted(bounds, np.arange(low, low + len(part)), "right") - 1
        for name, of in (("n_pieces", size), ("n_ranks", n_ranks), ("n_fallback", fallback)):
            out[name][here] += np.bincount(text, of[part], minlength=n).astype(np.int64)
        k = size[part]
        at = np.repeat(enc.first[place[part]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        tokens = enc.tokens[at]
        if n == 1:
            whole += np.bincount(tokens, minlength=enc.size)
        else:
            sums += c_log_c(tokens, np.repeat(text, k), n, enc.size)
    if n == 1:
        some = whole[whole > 0]
        sums[0] = (some * np.log2(some)).sum()
    total = np.maximum(out["n_pieces"][here], 1)
    bits[here] = np.maximum(0, np.log2(total) - sums / total)


def c_log_c(tokens: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """Of each text the sum of c * log2(c) over the counts c of its tokens."""
    key = np.sort(text * size + tokens)
    edge = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(edge, append=len(key))
    return np.bincount(key[edge] // size, count * np.log2(count), minlength=n_texts)


def measure(spark: SparkSession, text: Column, folder: str = FOLDER) -> Column:
    """Struct of ``COUNTS``, ``token_entropy`` and ``script`` of a whole text."""
    files = spark.sparkContext.broadcast(Files(folder))
    names = np.array(NAMES, object)

    @F.arrow_udf(", ".join(f"{name} bigint" for name in COUNTS) + ", token_entropy double, script string")
    def run(texts: pa.Array) -> pa.Array:
        out, bits, script = measures(texts, encoder(files))
        return pa.StructArray.from_arrays([*(pa.array(out[c]) for c in COUNTS), pa.array(bits), pa.array(names[script], pa.string())], [*COUNTS, "token_entropy", "script"])

    return run(text)


def base_failed() -> Column:
    """Fixed rules of the contract."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def figures() -> dict[str, Column]:
    n = F.greatest(F.col("n_pieces"), F.lit(1))
    return {
        "chars_per_piece": F.col("word_chars") / n,
        "chars_per_rank": F.col("word_chars") / F.greatest(F.col("n_ranks"), F.lit(1)),
        "fallback_share": F.col("n_fallback") / n,
        "evenness": F.when(F.col("n_pieces") > 1, F.col("token_entropy") / F.log2(n)).otherwise(0.0),
    }


def bands(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, figure, low, high) from exact histograms of ``rows``."""
    one = F.array(*(F.struct(F.lit(name).alias("figure"), F.floor(F.col(name) * scale).alias("bin")) for name, (scale, _, _, _) in FIGURES.items()))
    counted = rows.select(*by, F.explode(one).alias("f")).groupBy(*by, "f.figure", "f.bin").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by, "figure")
    up = group.orderBy("bin")
    ranked = counted.withColumns({"upto": F.sum("n").over(up), "total": F.sum("n").over(group)})
    quartile = {f"q{k}": F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bin"))) for k in (1, 3)}
    found = ranked.groupBy(*by, "figure").agg(*(c.alias(name) for name, c in quartile.items()))
    scale, least = (F.create_map(*(F.lit(x) for name, f in FIGURES.items() for x in (name, float(f[i])))) for i in (0, 1))
    low, high = F.col("q1") / scale[F.col("figure")], (F.col("q3") + 1) / scale[F.col("figure")]
    reach = REACH * F.greatest(high - low, least[F.col("figure")])
    return found.select(*by, "figure", (low - reach).alias("low"), (high + reach).alias("high"))


def judge(measured: DataFrame, by: list[str]) -> DataFrame:
    """``measured`` (counts, token_entropy and the columns ``by``) with the figures, base_failed, outside (the figures
    that reject the text) and kept."""
    rows = measured.withColumns(figures()).withColumns({"base_failed": base_failed(), "octave": F.floor(F.log2(F.greatest(F.col("n_pieces"), F.lit(1))))})
    by = [*by, "octave"]
    found = bands(rows.filter(~F.col("base_failed")), by)
    found = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("figure", F.struct("low", "high")))).alias("bands"))
    limits = small(stage(found.select(*(F.col(b).alias(f"_{b}") for b in by), "bands"), "fertility-bands"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    outside = []
    for name, (_, _, low, high) in FIGURES.items():
        band = F.col("bands")[name]
        far = (F.lit(low) & (F.col(name) < band["low"])) | (F.lit(high) & (F.col(name) > band["high"]))
        outside.append(F.when(~F.col("base_failed") & far, F.lit(name)))
    judged = rows.join(limits, same, "left").withColumn("outside", F.concat_ws(",", *outside))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("outside") == "")).drop("bands", *(f"_{b}" for b in by))


def report(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """doc_id, the counts, figures and the verdict of every row; bands by language and script."""
    m = docs.select("doc_id", "lang", measure(docs.sparkSession, F.col("text"), folder).alias("m"))
    return judge(stage(m.select("doc_id", "lang", "m.*"), "fertility-rows"), ["lang", "script"])
