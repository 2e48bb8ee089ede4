"""Secret scan: fixed patterns, and novelty of long strings under dictionary-primed zstandard.

Patterns find assigned values, access keys and long hex runs. The method adds ``novel`` spans: strings of 16 or more
characters in a sensitive context (a keyword such as ``key`` or ``auth`` shortly before) that are new. New means:
compressed alone behind a raw dictionary of vocabulary, identifiers and the surrounding text, the string costs at
least ``NOVEL`` bytes of output for each of its own bytes, and it is no known identifier. Copies of the string in its
surroundings are blanked first, so a secret that is stated and used is found at both places.

Known identifiers are the long strings that at least two different texts hold, at least once outside a sensitive
context; one that also occurs in a sensitive context must read as words, so a key does not become known by being
copied. All of them are a table that candidates are joined with; the most frequent (last, as zstandard prefers, up to
``DICTIONARY`` bytes) also prime the compressor.

Edge cases: null text is empty and has no span; spans that overlap a pattern span are not added; repeated rows are
scanned alike (and count once for the identifiers); offsets are code points of the whole text; an empty table
gives no rows.
"""
from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage

#: The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: What makes the text before a string sensitive.
CONTEXT = re.compile(r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|auth|bearer|credential|private|signature|access[_-]?key|client[_-]?id|salt|cookie|session", re.ASCII | re.IGNORECASE)
LEAST_LONG = 16
LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Longer strings are named by their hash.
LONGEST_NAME = 64
#: Words of a name; names have LETTERS letters or more for each word or number.
PARTS, LETTERS = re.compile(r"[A-Z]+[a-z]*|[a-z]+|[0-9]+"), 4
#: Characters before a string that are searched for a keyword, and text before it that primes the compressor.
NEAR, AROUND = 40, 400
NOVEL = 0.72
#: From this length zstandard may code literals by frequency, by which long hex would look known; these settings never do.
HUFFMAN = 64
RAW_LITERALS = zstandard.ZstdCompressionParameters(
    strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=4, window_log=19, hash_log=17, chain_log=16, search_log=1, write_content_size=False
)
DICTIONARY = 32 << 10
#: Vocabulary that surrounds settings and code; the identifiers of the corpus are added to it.
COMMON = (
    "password secret token api_key apikey access_key secret_key client_id client_secret authorization bearer private "
    "public static final const function return import export default config settings environment variable username "
    "localhost http https www example com org net index html json xml yaml true false null none string integer "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, kinds by their place in KINDS.

    An access or hex match below its least length starts and ends where the longest run does, so asking for that
    length in the pattern finds the same matches as dropping the short ones.
    """
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def long_strings(text: str) -> list[tuple[int, int]]:
    """Spans of long strings with a letter and a digit, or with both cases, in a sensitive context."""
    out = []
    for m in LONG.finditer(text):
        s = m[0]
        mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s) or (s.lower() != s and s.upper() != s and not s.istitle())
        if mixed and CONTEXT.search(text, max(0, m.start() - NEAR), m.start()):
            out.append((m.start(), m.end()))
    return out


def key(s: str) -> str:
    return s if len(s) <= LONGEST_NAME else "#" + hashlib.sha256(s.encode()).hexdigest()


def like_words(s: str) -> bool:
    """Whether a string reads as a few words, as identifiers and paths do; random strings change class too often."""
    return sum(c.isalpha() for c in s) >= LETTERS * len(PARTS.findall(s))


def names_of(text: str) -> list[dict]:
    """Each long string of a text by its key: whether it occurs outside and in sensitive contexts, and reads as words."""
    out = {}
    for m in LONG.finditer(text):
        near = CONTEXT.search(text, max(0, m.start() - NEAR), m.start()) is not None
        name = key(m[0])
        if name not in out:
            out[name] = {"name": name, "plain": False, "sensitive": False, "words": like_words(m[0])}
        out[name]["sensitive" if near else "plain"] = True
    return list(out.values())


def pieces(s: str) -> set[str]:
    return {s[i : i + LEAST_LONG] for i in range(len(s) - LEAST_LONG + 1)}


def without(text: str, shared: set[str]) -> str:
    """The text with blanks in place of all it shares with a string, given as its pieces."""

    def blank(m: re.Match) -> str:
        s = list(m[0])
        for i in range(len(s) - LEAST_LONG + 1):
            if m[0][i : i + LEAST_LONG] in shared:
                s[i : i + LEAST_LONG] = " " * LEAST_LONG
        return "".join(s)

    return LONG.sub(blank, text)


@lru_cache(2)
def names_part(dictionary: bytes) -> tuple[str, set[str]]:
    """The identifiers of a dictionary and their pieces."""
    names = dictionary.removeprefix(COMMON.encode()).decode()
    return names, set().union(*(pieces(m[0]) for m in LONG.finditer(names)))


def cost(value: str, before: str, after: str, dictionary: bytes) -> int:
    """Bytes of the string alone behind dictionary and surroundings; nothing else is coded along with it."""
    primer = zstandard.ZstdCompressionDict(dictionary + f"{after}\n{before}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    if len(value) < HUFFMAN:
        packer = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False)
    else:
        packer = zstandard.ZstdCompressor(compression_params=RAW_LITERALS, dict_data=primer)
    return len(packer.compress(value.encode())) - len(packer.compress(b""))


def novel_spans(text: str, base: list[tuple[int, int, int]], dictionary: bytes) -> list[tuple[int, int, int]]:
    out = []
    for a, b in long_strings(text):
        if any(s < b and a < e for s, _, e in base):
            continue
        value, size = text[a:b], b - a
        shared = pieces(value)
        # Wider by the string, so that a copy across the border of the window is seen whole.
        before = without(text[max(0, a - AROUND - size) : a], shared)[-AROUND:]
        after = without(text[b : b + AROUND + size], shared)[:AROUND]
        names, held = names_part(dictionary)
        own = dictionary
        if not like_words(value) and not shared.isdisjoint(held):
            own = (COMMON + without(names, shared)).encode()
        if cost(value, before, after, own) >= NOVEL * size:
            out.append((a, 3, b))
    return out


def scan(text: str | None, dictionary: bytes) -> dict:
    """Counts of the fixed patterns; ``spans`` as (span, key of a novel string, else None) in order of the text."""
    text = text or ""
    base = pattern_spans(text)
    named = lambda s: f"{KINDS[s[1]]}:{s[0]}:{s[2]}"
    count = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return {
        "n_assign": count[0], "n_access": count[1], "n_hex": count[2], "base_sha256": hashlib.sha256(",".join(map(named, base)).encode()).hexdigest(),
        "spans": [{"span": named(s), "key": key(text[s[0] : s[2]]) if s[1] == 3 else None} for s in sorted(base + novel_spans(text, base, dictionary))],
    }


COUNTS = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
RESULT = COUNTS + "spans string"
APART = COUNTS + "spans array<struct<span:string,key:string>>"
_COUNTS = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string())]
_APART = pa.struct([*_COUNTS, ("spans", pa.list_(pa.struct([("span", pa.string()), ("key", pa.string())])))])
_NAMES = pa.list_(pa.struct([("name", pa.string()), ("plain", pa.bool_()), ("sensitive", pa.bool_()), ("words", pa.bool_())]))


def named(docs: DataFrame) -> DataFrame:
    """(name, texts, sensitive) of all known identifiers, counted over distinct texts."""

    @F.arrow_udf("array<struct<name:string,plain:boolean,sensitive:boolean,words:boolean>>")
    def held(texts: pa.Array) -> pa.Array:
        return pa.array([names_of(t.as_py() or "") for t in texts], _NAMES)

    each = docs.select(F.xxhash64("text").alias("text"), F.explode(held(F.col("text"))).alias("s")).select("text", "s.*").distinct()
    names = each.groupBy("name").agg(F.count(F.lit(1)).alias("texts"), *(F.bool_or(c).alias(c) for c in ("plain", "sensitive", "words")))
    return names.filter("texts > 1 AND plain AND (words OR NOT sensitive)").select("name", "texts", "sensitive")


def primer(names: DataFrame, most: int = DICTIONARY) -> bytes:
    """Dictionary of the most frequent identifiers, at most ``most`` bytes of them."""
    top = names.filter("name NOT LIKE '#%'").orderBy(F.desc("texts"), "name").limit(most // (LEAST_LONG + 1)).collect()
    kept, size = [], 0
    for row in top:
        if size + len(row["name"]) + 1 > most:
            break
        kept.append(row["name"])
        size += len(row["name"]) + 1
    return (COMMON + " ".join(reversed(kept))).encode()


def identifiers(docs: DataFrame, most: int = DICTIONARY) -> bytes:
    """Dictionary of the identifiers of ``docs``, from counts over all rows."""
    return primer(stage(named(docs), "secrets-identifiers"), most)


def find(text: Column, dictionary: bytes) -> Column:
    """Struct of RESULT for each whole text, by the dictionary alone."""

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        rows = [scan(t.as_py(), dictionary) for t in texts]
        return pa.array([r | {"spans": ",".join(s["span"] for s in r["spans"])} for r in rows], pa.struct([*_COUNTS, ("spans", pa.string())]))

    return run(text)


def report(docs: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """doc_id and the columns of RESULT for each row: novel strings are looked up in all known identifiers."""
    names = stage(named(docs), "secrets-identifiers")
    dictionary = primer(names, most)

    @F.arrow_udf(APART)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([scan(t.as_py(), dictionary) for t in texts], _APART)

    found = stage(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), run(F.col("text")).alias("f")), "secrets-found")
    known = small(stage(names.filter("sensitive").select(F.col("name").alias("key")), "secrets-known"))
    novel = found.select("row", F.explode("f.spans.key").alias("key")).filter("key IS NOT NULL")
    drop = small(stage(novel.join(known, "key").groupBy("row").agg(F.collect_set("key").alias("known")), "secrets-dropped"))
    kept = F.filter("f.spans", lambda s: s["key"].isNull() | F.col("known").isNull() | ~F.array_contains("known", s["key"]))
    return found.join(drop, "row", "left").select(
        "doc_id", "f.n_assign", "f.n_access", "f.n_hex", "f.base_sha256", F.concat_ws(",", F.transform(kept, lambda s: s["span"])).alias("spans")
    )
