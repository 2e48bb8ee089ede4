"""Chapters, paragraphs, chunks, sentences and language of texts.

Each operator works inside the row that holds the text, so the plans have no shuffle except for
per-novel totals (which are partially aggregated before their shuffle).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.keys import (
    FOLD_FROM,
    WS,
    WS_CHARS,
    WS_CLASS,
    char_ranges,
    is_blank,
    squeeze_ws,
    trim_ws,
)
from loreweave.functions.textfns import (
    let,
    ltrim_ws,
    pieces_with_starts,
    split_with_starts,
)

# --- Fixed values -------------------------------------------------------------------------
HEADING_MAX = 96
HAN_HEADING_MAX = 40
PREVIEW_CHARS = 180
LANGUAGE_SAMPLE = 12000
CHUNK_TARGET = 2400
CHUNK_MIN = 900
HAN = "㐀-䶿一-鿿豈-﫿"
KANA = "぀-ヿ"
HANGUL = "가-힯ᄀ-ᇿ"
MARKED = char_ranges(FOLD_FROM + FOLD_FROM.upper())
# ------------------------------------------------------------------------------------------

_S = "[^" + WS_CLASS + "]"
_LWS = "[" + char_ranges(WS_CHARS.replace("\n", "")) + "]"
_EOL = _LWS + r"*(?:\n|\z)"


def _line_of(limit: int) -> str:
    return rf"(?={_S}(?:[^\n]{{0,{limit - 2}}}{_S})?{_EOL})"


# A heading at the start of a line, as a zero-width condition.
_HEADING = (
    rf"(?={_LWS}*{_line_of(HEADING_MAX)}(?:"
    rf"#+(?!#){_LWS}*{_S}"
    rf"|(?iu:prologue|epilogue){_EOL}"
    rf"|(?iu:chapter(?:[ \t]{_LWS}*{_S}|:)|chap\. {_LWS}*{_S}"
    rf"|chương(?:[ \t]{_LWS}*{_S}|:)|chuong(?: {_LWS}*{_S}|:))"
    rf"|{_line_of(HAN_HEADING_MAX)}第[^\n]*章"
    r"))"
)
_AT_HEADING = "(?dm)^" + _HEADING
_STARTS_WITH_HEADING = r"\A" + _HEADING


def _title_of(piece: Column) -> Column:
    line = trim_ws(F.substring_index(piece, "\n", 1))
    bare = trim_ws(F.ltrim(line, F.lit("#")))
    return F.when(line.startswith("#") & (bare != ""), bare).otherwise(line)


def _heading_pieces(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return (
        texts.filter(~is_blank(F.col(text_col)))
        .withColumn("_ps", pieces_with_starts(F.split(F.col(text_col), _AT_HEADING, -1)))
        .withColumn("_first", F.get("_ps", F.lit(0))["piece"])
        .withColumn("_headed", F.col("_first").rlike(_STARTS_WITH_HEADING))
        .withColumn("_n", F.size("_ps"))
    )


def detect_headings(texts: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """B1: heading lines with the offset of their line."""
    return (
        _heading_pieces(texts, id_col, text_col)
        .select(id_col, "_headed", F.posexplode("_ps").alias("_pos", "_p"))
        .filter((F.col("_pos") > 0) | F.col("_headed"))
        .select(id_col, F.col("_p.start").alias("line_start"), _title_of(F.col("_p.piece")).alias("title"))
    )


def split_chapters(
    novels: DataFrame, id_col: str = "novel_id", text_col: str = "text", trim_first: bool = False
) -> DataFrame:
    """B2: chapters of each novel. ``trim_first`` is what an import does; a preview does not."""
    if trim_first:
        novels = novels.withColumn(text_col, trim_ws(F.col(text_col)))
    numbered = F.col("_headed") | (F.col("_n") == 1) | ~is_blank(F.col("_first"))
    title = (
        F.when((F.col("_pos") > 0) | F.col("_headed"), _title_of(F.col("_p.piece")))
        .when(F.col("_n") == 1, F.lit("Chapter 1"))
        .otherwise(F.lit("Preface"))
    )
    return (
        _heading_pieces(novels, id_col, text_col)
        .select(id_col, "_headed", "_n", numbered.alias("_numbered"), F.posexplode("_ps").alias("_pos", "_p"))
        .filter(~is_blank(F.col("_p.piece")))
        .select(
            id_col,
            (F.col("_pos") + F.col("_numbered").cast("long")).alias("chapter_num"),
            title.alias("title"),
            F.col("_p.start").alias("start_char"),
            (F.col("_p.start") + F.length("_p.piece")).alias("end_char"),
            F.col("_p.piece").alias("content"),
        )
    )


def preview_text(c: Column, limit: int = PREVIEW_CHARS) -> Column:
    return F.left(squeeze_ws(c), F.lit(limit))


def import_preview(novels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary per novel, one preview row per chapter), on the text as given."""
    chapters = split_chapters(novels)
    previews = chapters.select(
        "novel_id", "chapter_num", "title", "start_char", "end_char",
        (F.col("end_char") - F.col("start_char")).alias("char_count"),
        preview_text(F.col("content")).alias("preview"),
    )
    counts = chapters.groupBy("novel_id").agg(F.count(F.lit(1)).alias("chapter_count"))
    summary = (
        novels.select("novel_id", trim_ws(F.col("title")).alias("title"), F.length("text").cast("long").alias("total_chars"))
        .join(counts, "novel_id", "left")
        .withColumn("chapter_count", F.coalesce("chapter_count", F.lit(0).cast("long")))
    )
    return summary, previews


# Paragraph | run of blank lines | blank rest. Possessive loops run without recursion.
_PARAGRAPHS = (
    rf"(?:{_LWS}*+{_S}[^\n]*+(?:\n|\z))++|(?:{_LWS}*+\n)++|{_LWS}++\z"
)


def split_segments(chapters: DataFrame, id_col: str = "chapter_id", text_col: str = "content") -> DataFrame:
    """paragraphs = maximal runs of non-blank lines."""
    parts = pieces_with_starts(F.regexp_extract_all(F.col(text_col), F.lit(_PARAGRAPHS), 0))
    kept = F.filter(parts, lambda p: ~is_blank(p["piece"]))
    return (
        chapters.filter(~is_blank(F.col(text_col)))
        .select(id_col, F.posexplode(kept).alias("_pos", "_p"))
        .select(
            id_col,
            (F.col("_pos") + 1).cast("long").alias("segment_index"),
            F.col("_p.start").alias("start_char"),
            (F.col("_p.start") + F.length("_p.piece")).alias("end_char"),
            F.col("_p.piece").alias("text"),
        )
    )


def _chunk_end(rest: Column, target: int, minimum: int) -> Column:
    """Length of the next chunk of ``rest``: after the last blank line, line end or sentence end
    between ``minimum`` and ``target`` characters, else at ``target``."""
    tail2 = F.reverse(F.substring(rest, minimum + 1, target - minimum + 1))
    tail = F.reverse(F.substring(rest, minimum + 1, target - minimum))
    blank, line = F.instr(tail2, "\n\n"), F.instr(tail, "\n")
    stop = F.instr(F.translate(tail, "!?。！？", "....."), ".")
    return (
        F.when(F.length(rest) <= target, F.length(rest))
        .when(blank > 0, F.lit(target + 2) - blank)
        .when(line > 0, F.lit(target + 1) - line)
        .when(stop > 0, F.lit(target + 1) - stop)
        .otherwise(F.lit(target))
        .cast("long")
    )


def chunk_chapters(
    chapters: DataFrame, id_col: str = "chapter_id", text_col: str = "content",
    target: int = CHUNK_TARGET, minimum: int = CHUNK_MIN,
) -> DataFrame:
    """Chunks of about ``target`` characters. Blank chunks are skipped; a chapter without any
    other chunk keeps itself as one."""
    schema = "array<struct<start:bigint,end:bigint,text:string>>"

    def fold(t: Column) -> Column:
        n = F.length(t).cast("long")
        steps = F.sequence(F.lit(1), F.greatest(F.ceil(n / minimum), F.lit(1)).cast("int"))

        def step(acc: Column, _: Column) -> Column:
            rest = F.substring(t, (acc["pos"] + 1).cast("int"), target + 1)
            # a window of target + 1 characters tells "the rest fits" from "search backwards"
            def take(w: Column) -> Column:
                end = acc["pos"] + _chunk_end(w, target, minimum)
                row = F.struct(
                    acc["pos"].alias("start"), end.alias("end"),
                    F.left(w, (end - acc["pos"]).cast("int")).alias("text"),
                )
                # the break after a blank line may lie one character past the window
                return F.struct(end.alias("pos"), F.concat(acc["rows"], F.array(row)).alias("rows"))

            return F.when(acc["pos"] >= n, acc).otherwise(let(rest, take))

        first = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(schema).alias("rows"))
        rows = F.filter(F.aggregate(steps, first, step)["rows"], lambda r: ~is_blank(r["text"]))
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end"), t.alias("text")))
        return let(rows, lambda r: F.when(F.size(r) > 0, r).otherwise(whole))

    return chapters.select(id_col, F.posexplode(let(F.col(text_col), fold)).alias("_pos", "_c")).select(
        id_col,
        F.col("_pos").cast("long").alias("chunk_index"),
        F.col("_c.start").alias("start_char"),
        F.col("_c.end").alias("end_char"),
        F.col("_c.text").alias("text"),
    )


_AFTER_STOP = "(?<=[.!?。！？\n\r])"


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, _AFTER_STOP, -1), trim_ws), lambda s: s != "")


def split_sentences(texts: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """Trimmed, non-empty sentences."""
    return texts.select(
        id_col, F.posexplode(sentences(F.col(text_col))).alias("sentence_index", "sentence")
    ).withColumn("sentence_index", F.col("sentence_index").cast("long"))


def paragraph_blocks(
    chapters: DataFrame, id_col: str = "chapter_id", text_col: str = "content", title_col: str = "title"
) -> DataFrame:
    """Blocks between blank lines with offsets; a first block that repeats the title is dropped."""
    title = F.lower(squeeze_ws(F.col(title_col)))

    def block(p: Column) -> Column:
        text = trim_ws(p["piece"])
        start = p["start"] + F.length(p["piece"]) - F.length(ltrim_ws(p["piece"]))
        return F.struct(start.alias("start_char"), (start + F.length(text)).alias("end_char"), text.alias("text"))

    def drop_title(bs: Column) -> Column:
        head = F.lower(squeeze_ws(F.get(bs, F.lit(0))["text"]))
        same = F.endswith(head, title) | F.endswith(title, head)
        return F.when(same, F.slice(bs, F.lit(2), F.size(bs))).otherwise(bs)

    blocks = F.filter(
        F.transform(split_with_starts(F.col(text_col), "(?:\r?\n){2,}+"), block), lambda b: b["text"] != ""
    )
    blocks = let(blocks, lambda bs: F.when(F.size(bs) > 0, drop_title(bs)).otherwise(bs))
    return chapters.select(id_col, F.inline(blocks))


def detect_language(c: Column, sample_chars: int | None = None) -> Column:
    """Language guess from the whole text, or from its first ``sample_chars`` characters
    (the original reads LANGUAGE_SAMPLE)."""
    head = c if sample_chars is None else F.left(c, F.lit(sample_chars))

    def count(members: str, h: Column) -> Column:
        return F.length(F.regexp_replace(h, f"[^{members}]+", ""))

    return let(
        head,
        lambda h: language_of_counts(
            count(HAN, h), count(KANA, h), count(HANGUL, h), count("A-Za-z", h), count(MARKED, h)
        ),
    )


def language_of_counts(han: Column, kana: Column, hangul: Column, ascii_: Column, marked: Column) -> Column:
    latin = ascii_ + marked
    return (
        F.when(kana >= 8, F.lit("ja"))
        .when(hangul >= 8, F.lit("ko"))
        .when((han >= 16) & (han > latin), F.lit("zh"))
        .when(marked >= 8, F.lit("vi"))
        .when(latin >= 32, F.lit("en"))
    )


def word_count(c: Column) -> Column:
    """Words of a text."""
    t = trim_ws(c)
    return F.when(t == "", F.lit(0)).otherwise(
        F.size(F.split(t, WS + "+", -1))
    ).cast("long")


def word_counts(chapters: DataFrame, text_col: str = "content") -> DataFrame:
    """Words per chapter."""
    return chapters.select("novel_id", "chapter_num", word_count(F.col(text_col)).alias("word_count"))


def word_totals(chapters: DataFrame, text_col: str = "content") -> DataFrame:
    """Words per novel, and over all novels in the row without one."""
    return (
        word_counts(chapters, text_col)
        .rollup("novel_id")
        .agg(F.count(F.lit(1)).alias("chapter_count"), F.sum("word_count").alias("word_count"))
    )


