"""Column expressions over whole texts: pieces with offsets, exact scans, sentence windows.

Offsets are code points, end-exclusive. Everything is evaluated inside one row of text, so no text
is shuffled to compute an offset.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loreweave.functions.keys import WORD, WS_CHARS

SENTENCE_END = ".!?。！？\n\r"  # fixed values
END_OF_TEXT = 2147483647


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a plain column reference inside a lambda
    would be evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_starts(lengths: Column, block: int | None = None) -> Column:
    """Exclusive prefix sums of an array. Two levels of ``block`` (twice the cube root of n) keep the copies of growing
    arrays at n * block and (n / block) ** 2."""

    def scan(values: Column, first: Column) -> Column:
        grown = F.aggregate(
            values,
            F.array(first.cast("long")),
            lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
        )
        return F.slice(grown, F.lit(1), F.size(values))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def by_blocks(lens: Column, size: Column) -> Column:
        n_blocks = F.ceil(F.size(lens) / size).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(lens, b * size + 1, size))
        return let(
            blocks,
            lambda bs: let(
                scan(F.transform(bs, total), F.lit(0)),
                lambda firsts: F.flatten(
                    F.transform(bs, lambda b, i: scan(b, F.get(firsts, i)))
                ),
            ),
        )

    return let(
        lengths,
        lambda lens: F.when(F.size(lens) == 0, F.array().cast("array<bigint>"))
        .when(F.size(lens) <= (block or 16), scan(lens, F.lit(0)))
        .otherwise(let(F.lit(block) if block else F.ceil(2 * F.cbrt(F.size(lens))).cast("int"), lambda size: by_blocks(lens, size))),
    )


def pieces_with_starts(pieces: Column) -> Column:
    """Consecutive pieces of a text -> array of (start, piece)."""
    return let(
        pieces,
        lambda ps: F.zip_with(
            prefix_starts(F.transform(ps, lambda p: F.length(p).cast("long"))),
            ps,
            lambda s, p: F.struct(s.alias("start"), p.alias("piece")),
        ),
    )


def split_with_starts(text: Column, delimiter: str) -> Column:
    """Split on a delimiter pattern -> array of (start, piece), delimiters left out."""

    def build(t: Column) -> Column:
        return let(
            F.struct(
                F.split(t, delimiter, -1).alias("ps"),
                F.concat(F.regexp_extract_all(t, F.lit(delimiter), 0), F.array(F.lit(""))).alias("ds"),
            ),
            lambda x: F.zip_with(
                prefix_starts(
                    F.zip_with(x["ps"], x["ds"], lambda p, d: (F.length(p) + F.length(d)).cast("long"))
                ),
                x["ps"],
                lambda s, p: F.struct(s.alias("start"), p.alias("piece")),
            ),
        )

    return let(text, build)


def quote_regex(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def scan_spans(text: Column, variant: Column) -> Column:
    """Left-to-right scan for ``variant`` without self-overlap -> array of (start, end) where the
    neighbouring characters are no word characters. Failed matches consume their characters too."""

    def is_word(c: Column) -> Column:
        return c.rlike(f"[{WORD}]")

    def build(x: Column) -> Column:
        v, ps = x["v"], x["ps"]
        n = F.length(v).cast("long")
        n_hits = F.size(ps) - 1

        def hit(s: Column, i: Column) -> Column:
            left, right = F.get(ps, i), F.get(ps, i + 1)
            before = F.when(left != "", F.right(left, F.lit(1))).otherwise(
                F.when(i > 0, F.right(v, F.lit(1))).otherwise(F.lit(""))
            )
            after = F.when(right != "", F.left(right, F.lit(1))).otherwise(
                F.when(i + 1 < n_hits, F.left(v, F.lit(1))).otherwise(F.lit(""))
            )
            start = s + F.length(left) + n * i
            return F.struct(
                start.alias("start"),
                (start + n).alias("end"),
                (~is_word(before) & ~is_word(after)).alias("ok"),
            )

        starts = prefix_starts(F.transform(ps, lambda p: F.length(p).cast("long")))
        hits = F.slice(F.transform(starts, hit), F.lit(1), n_hits)
        kept = F.filter(hits, lambda h: h["ok"])
        return F.transform(kept, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.when(
        F.contains(text, variant),
        let(
            F.struct(variant.alias("v"), F.split(text, quote_regex(variant), -1).alias("ps")), build
        ),
    ).otherwise(none)


def spaced(text: Column, word: str) -> Column:
    """``text`` with one space for every character that is not in the class ``word``: offsets stay as they are."""
    return F.regexp_replace(text, f"[^{word}]", " ")


def _variant_starts(text: str, spaced_text: str, variants: dict[str, list[tuple[str, int, str]]]) -> Iterator[tuple[str, int]]:
    """(variant, start) of every variant in a text; neighbouring characters are no word characters. ``variants`` are
    listed by their first run, each with its offset in the variant and the spaced variant."""
    n, at, again = len(text), 0, {}

    def bordered(start: int, end: int) -> bool:
        return (start == 0 or spaced_text[start - 1] == " ") and (end == n or spaced_text[end] == " ")

    for variant, _, _ in variants.get("", ()):
        again[variant] = None
    for run in spaced_text.split(" "):
        for variant, offset, shape in variants.get(run, ()) if run else ():
            start = at - offset
            if start >= 0 and text.startswith(variant, start) and bordered(start, start + len(variant)):
                if " " in shape and overlaps_itself(variant, shape):
                    again[variant] = None
                else:
                    yield variant, start
        at += len(run) + 1
    # from left to right: an earlier match, also a failed one, consumes its characters
    for variant in again:
        start = text.find(variant)
        while start >= 0:
            if bordered(start, start + len(variant)):
                yield variant, start
            start = text.find(variant, start + len(variant))


def overlaps_itself(variant: str, shape: str) -> bool:
    """Whether a match that begins a word can lie across the end of an earlier one."""
    n = len(variant)
    return any(shape[n - k - 1] == " " and variant.startswith(variant[n - k:]) for k in range(1, n))


def variant_spans():
    """Function of (parts of a text, the parts spaced, variants, variants spaced) -> array of (which part, which variant,
    start)."""

    @F.arrow_udf("array<struct<part:int,which:int,start:bigint>>")
    def spans(texts: pa.Array, spaced_texts: pa.Array, variants: pa.Array, shapes: pa.Array) -> pa.Array:
        ends, parts, which, starts = [0], [], [], []
        for texts_of, spaced_of, names, forms in zip(texts, spaced_texts, variants, shapes, strict=True):
            by_run, places = {}, {}
            for i, (variant, shape) in enumerate(zip(names.as_py(), forms.as_py(), strict=True)):
                if variant not in places:
                    head = shape.lstrip(" ")
                    by_run.setdefault(head.split(" ", 1)[0], []).append((variant, len(shape) - len(head), shape))
                places.setdefault(variant, []).append(i)
            for part, (text, spaced_text) in enumerate(zip(texts_of.as_py(), spaced_of.as_py(), strict=True)):
                for variant, start in _variant_starts(text, spaced_text, by_run):
                    found = places[variant]
                    parts += [part] * len(found)
                    which += found
                    starts += [start] * len(found)
            ends.append(len(which))
        rows = [pa.array(parts, pa.int32()), pa.array(which, pa.int32()), pa.array(starts, pa.int64())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(rows, ["part", "which", "start"]))

    # so that no filter on what is found computes it a second time
    return spans.asNondeterministic()


def char_slice(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def ltrim_ws(c: Column) -> Column:
    return F.ltrim(c, F.lit(WS_CHARS))


def is_json(c: Column, options: dict[str, str] | None = None) -> Column:
    """One whole JSON value and nothing after it.

    A JSON reader ignores what follows a value. As the only element of an array the text cannot hold a
    second value; as a member before a mark made from the text it cannot close the array early and hide
    what follows, because then the mark is never read."""
    options = options or {}
    wrapped = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>", options)
    mark = F.xxhash64(c)
    member = F.from_json(F.concat(F.lit('{"v":'), c, F.lit(',"end":'), mark.cast("string"), F.lit("}")), "struct<v:string,end:bigint>", options)
    return F.coalesce((F.size(wrapped) == 1) & (member["end"] == mark), F.lit(False))


def one_stop(text: Column, stops: str = SENTENCE_END) -> Column:
    """``text`` with a full stop for every character that ends a sentence."""
    return F.translate(text, stops, "." * len(stops))


def sentence_window(text: Column, start: Column, end: Column, stops: str = SENTENCE_END, normal: Column | None = None) -> Column:
    """(s, e, context) of the sentence around a span: from just after the previous stop to
    just after the next one. ``normal`` is ``one_stop`` of the text, where it is made once for many spans."""
    normal = one_stop(text, stops) if normal is None else normal

    def build(x: Column) -> Column:
        before = char_slice(x["t"], F.lit(0), x["s"])
        after = F.substring(x["t"], (x["e"] + 1).cast("int"), END_OF_TEXT)
        s = x["s"] - F.length(F.substring_index(before, ".", -1))
        tail = F.instr(after, ".")
        e = F.when(tail > 0, x["e"] + tail).otherwise(x["e"] + F.length(after))
        return F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"))

    w = let(F.struct(normal.alias("t"), start.cast("long").alias("s"), end.cast("long").alias("e")), build)
    return let(
        F.struct(w.alias("w"), text.alias("t")),
        lambda x: F.struct(
            x["w"]["s"].alias("s"),
            x["w"]["e"].alias("e"),
            char_slice(x["t"], x["w"]["s"], x["w"]["e"]).alias("context"),
        ),
    )
