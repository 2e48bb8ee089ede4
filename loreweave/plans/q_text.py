"""Queries over texts: segmentation (B) and keys, surfaces, vocabularies (C)."""
from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.functions import keys as K
from loreweave.functions import vocab as V
from loreweave.operators import segment as S
from loreweave.plans import inputs as I
from loreweave.plans import sqlkit as Q
from loreweave.plans.registry import query

NL = "chr(10)"
WSC = Q.lit(K.WS_CHARS)

_LINES = f"""SELECT id, txt, line, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY line_no
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s,
 {Q.trim('line')} AS t FROM (SELECT id, txt, unnest(string_split(txt, {NL})) AS line,
 unnest(range(1, len(string_split(txt, {NL})) + 1)) AS line_no FROM src)"""

_HEADS = f"""SELECT *, length(t) BETWEEN 1 AND 96 AND (md <> '' OR low IN ('prologue', 'epilogue') OR starts_with(low, 'chapter ')
 OR starts_with(low, 'chapter' || chr(9)) OR starts_with(low, 'chapter:') OR starts_with(low, 'chap. ') OR starts_with(low, 'chương ')
 OR starts_with(low, 'chương' || chr(9)) OR starts_with(low, 'chương:') OR starts_with(low, 'chuong ') OR starts_with(low, 'chuong:')
 OR (starts_with(t, '第') AND contains(t, '章') AND length(t) <= 40)) AS is_head,
 CASE WHEN md <> '' THEN md ELSE t END AS title
 FROM (SELECT *, lower(t) AS low, CASE WHEN starts_with(t, '#') THEN {Q.trim("ltrim(t, '#')")} ELSE '' END AS md FROM ({_LINES}))"""


def _chapters_sql(text: str) -> str:
    return f"""WITH src AS (SELECT novel_id AS id, {text} AS txt FROM {I.duck(I.novels)}),
heads AS ({_HEADS}), h AS (SELECT id, txt, s, title FROM heads WHERE is_head),
firsts AS (SELECT src.id, src.txt, min(h.s) AS f FROM src LEFT JOIN h ON src.id = h.id GROUP BY 1, 2),
cuts AS (SELECT id, txt, s, title FROM h
 UNION ALL SELECT id, txt, 0, CASE WHEN f IS NULL THEN 'Chapter 1' ELSE 'Preface' END FROM firsts
 WHERE f IS NULL OR (f > 0 AND {Q.trim('left(txt, f)')} <> '')),
numbered AS (SELECT id, row_number() OVER w AS chapter_num, title, s, coalesce(lead(s) OVER w, length(txt)) AS e, txt
 FROM cuts WINDOW w AS (PARTITION BY id ORDER BY s)),
chapters AS (SELECT id AS novel_id, chapter_num, title, s AS start_char, e AS end_char, substr(txt, s + 1, e - s) AS content
 FROM numbered WHERE {Q.trim('txt')} <> '')"""


@query("b1_detect_headings", f"""WITH src AS (SELECT novel_id AS id, text AS txt FROM {I.duck(I.novels)})
SELECT id AS text_id, s AS line_start, title FROM ({_HEADS}) WHERE is_head""")
def b1(spark, sf):
    return S.detect_headings(I.run(spark, sf, I.novels).withColumnRenamed("novel_id", "text_id"))


@query("b2_split_chapters", _chapters_sql(Q.trim("text")) + " SELECT * FROM chapters")
def b2(spark, sf):
    return S.split_chapters(I.run(spark, sf, I.novels), trim_first=True)


@query("b3_import_preview", _chapters_sql("text") + f""" SELECT novel_id, {Q.trim("n.title")} AS novel_title, total_chars, c.chapter_count, chapter_num, p.title,
 end_char - start_char AS char_count, left({Q.squeeze('content')}, 180) AS preview
 FROM chapters p JOIN (SELECT novel_id, count(*) AS chapter_count FROM chapters GROUP BY 1) c USING (novel_id)
 JOIN (SELECT novel_id, title, length(text) AS total_chars FROM {I.duck(I.novels)}) n USING (novel_id)""")
def b3(spark, sf):
    summary, previews = S.import_preview(I.run(spark, sf, I.novels))
    return previews.drop("start_char", "end_char").join(
        summary.withColumnRenamed("title", "novel_title"), "novel_id"
    )


@query("b4_split_segments", f"""WITH src AS (SELECT novel_id AS id, text AS txt FROM {I.duck(I.novels)}),
l AS (SELECT *, t = '' AS bl, sum((t = '')::INT) OVER (PARTITION BY id ORDER BY line_no) AS grp FROM ({_LINES})),
g AS (SELECT id, grp, min(s) AS s, least(max(s + length(line) + 1), length(any_value(txt))) AS e, any_value(txt) AS txt FROM l WHERE NOT bl GROUP BY 1, 2)
SELECT id AS chapter_id, row_number() OVER (PARTITION BY id ORDER BY s) AS segment_index, s AS start_char, e AS end_char, substr(txt, s + 1, e - s) AS text FROM g""")
def b4(spark, sf):
    n = I.run(spark, sf, I.novels)
    return S.split_segments(n.select(F.col("novel_id").alias("chapter_id"), F.col("text").alias("content")))


_B5 = f"""WITH RECURSIVE src AS (SELECT novel_id AS id, text AS txt, length(text) AS n FROM {I.duck(I.novels)}),
step AS (SELECT id, 0::BIGINT AS s, 0::BIGINT AS e, 0 AS k FROM src
 UNION ALL SELECT id, e, CASE WHEN n - e <= 2400 THEN n
  WHEN contains(w2, chr(10) || chr(10)) THEN e + 2402 - strpos(w2, chr(10) || chr(10))
  WHEN contains(w, chr(10)) THEN e + 2401 - strpos(w, chr(10))
  WHEN regexp_matches(w, '[.!?。！？]') THEN e + 2400 - length(regexp_extract(w, '^[^.!?。！？]*'))
  ELSE e + 2400 END, k + 1
 FROM (SELECT step.id, e, k, n, reverse(substr(txt, e + 901, 1501)) AS w2, reverse(substr(txt, e + 901, 1500)) AS w
  FROM step JOIN src ON step.id = src.id WHERE e < n))
SELECT id AS chapter_id, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS chunk_index, s AS start_char, e AS end_char, substr(txt, s + 1, e - s) AS text
FROM step JOIN src USING (id) WHERE k > 0 AND {Q.trim('substr(txt, s + 1, e - s)')} <> ''"""


@query("b5_chunk_chapters", _B5)
def b5(spark, sf):
    n = I.run(spark, sf, I.novels)
    return S.chunk_chapters(n.select(F.col("novel_id").alias("chapter_id"), F.col("text").alias("content")))


_SENT = f"""SELECT doc_id, u, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sentence_index FROM (
 SELECT doc_id, {Q.trim('unnest(l)')} AS u, unnest(range(len(l))) AS i FROM (
 SELECT doc_id, regexp_extract_all(text, '[^.!?。！？' || chr(10) || chr(13) || ']*([.!?。！？' || chr(10) || chr(13) || ']|$)') AS l FROM documents)) WHERE u <> ''"""


@query("b6_split_sentences", f"SELECT doc_id AS text_id, sentence_index, u AS sentence FROM ({_SENT})")
def b6(spark, sf):
    return S.split_sentences(I.table(spark, sf, "documents").withColumnRenamed("doc_id", "text_id"))


@query("b8_paragraph_blocks", f"""WITH src AS (SELECT novel_id, text AS txt, regexp_extract(text, '[A-Z][^.]*') AS title FROM {I.duck(I.novels)}),
raw AS (SELECT novel_id, title, ps, ds, unnest(range(1, len(ps) + 1)) AS i FROM (
 SELECT novel_id, title, string_split_regex(txt, {NL} || {NL} || '+') AS ps, regexp_extract_all(txt, {NL} || {NL} || '+') AS ds FROM src)),
b AS (SELECT novel_id, title, i, ps[i] AS p, {Q.trim('ps[i]')} AS t,
 coalesce(list_sum(list_transform(ps[1:i-1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ds[1:i-1], lambda x: length(x))), 0) AS s FROM raw),
k AS (SELECT *, row_number() OVER (PARTITION BY novel_id ORDER BY i) AS rn, lower({Q.squeeze('t')}) AS nb, lower({Q.squeeze('title')}) AS nt FROM b WHERE t <> '')
SELECT novel_id AS chapter_id, (s + length(p) - length(ltrim(p, {WSC})))::BIGINT AS start_char,
 (s + length(p) - length(ltrim(p, {WSC})) + length(t))::BIGINT AS end_char, t AS text FROM k WHERE NOT (rn = 1 AND (ends_with(nb, nt) OR ends_with(nt, nb)))""")
def b8(spark, sf):
    n = I.run(spark, sf, I.novels).withColumn("title", F.regexp_extract("text", "[A-Z][^.]*", 0))
    return S.paragraph_blocks(n.selectExpr("novel_id AS chapter_id", "title", "text AS content"))


def _cnt(cls):
    return f"len(regexp_extract_all(h, '[{cls}]'))"


_LANG = f"""SELECT text_id, CASE WHEN kana >= 8 THEN 'ja' WHEN hangul >= 8 THEN 'ko' WHEN han >= 16 AND han > asc_n + vi THEN 'zh'
 WHEN vi >= 8 THEN 'vi' WHEN asc_n + vi >= 32 THEN 'en' END AS lang FROM (SELECT text_id, {_cnt('぀-ヿ')} AS kana, {_cnt('가-힯ᄀ-ᇿ')} AS hangul,
 {_cnt('㐀-䶿一-鿿豈-﫿')} AS han, {_cnt('A-Za-z')} AS asc_n, {_cnt(K.FOLD_FROM + K.FOLD_FROM.upper())} AS vi FROM (SELECT text_id, text AS h FROM TEXTS))"""


@query("b9_detect_language", _LANG.replace("TEXTS", I.duck(I.scripts)))
def b9(spark, sf):
    return I.run(spark, sf, I.scripts).select("text_id", S.detect_language(F.col("text")).alias("lang"))


@query("b10_word_counts", f"""SELECT novel_id, count(*) AS chapter_count, sum(CASE WHEN {Q.trim('content')} = '' THEN 0 ELSE {Q.ntoks('content')} END)::BIGINT AS word_count
FROM {I.duck(I.chapters)} GROUP BY ROLLUP (novel_id)""")
def b10(spark, sf):
    return S.word_totals(I.run(spark, sf, I.chapters))


# --- C: keys and surfaces -------------------------------------------------------------------
_RAW = I.duck(I.surfaces_raw)


def _raw(spark, sf):
    return I.run(spark, sf, I.surfaces_raw)


def _key_query(name, fn, sql):
    @query(name, f"SELECT doc_id, pos, {sql('raw')} AS k FROM {_RAW}")
    def q(spark, sf):
        return _raw(spark, sf).select("doc_id", "pos", fn(F.col("raw")).alias("k"))


_key_query("c1_text_key", K.text_key, Q.key)
_key_query("c2_folded_key", K.folded_key, Q.fkey)
_key_query("c3_ascii_key", K.ascii_key, Q.akey)
_key_query("c4_schema_key", K.schema_key, Q.skey)


@query("c5_clean_surface", Q.clean_cols("raw", _RAW, "doc_id, pos", "k"))
def c5(spark, sf):
    return _raw(spark, sf).select("doc_id", "pos", K.clean_surface(F.col("raw")).alias("k"))


@query("c6_surface_flags", f"""SELECT doc_id, pos, n_up > 0 AS has_upper, n_up = 0 OR (n <= 2 AND n_up < 2) AS ambiguous
FROM (SELECT doc_id, pos, {Q.ups('raw')} AS n_up, {Q.ntoks('raw')} AS n FROM {_RAW})""")
def c6(spark, sf):
    return _raw(spark, sf).select(
        "doc_id", "pos", K.has_upper_token(F.col("raw")).alias("has_upper"), K.is_ambiguous(F.col("raw")).alias("ambiguous")
    )


@query("c7_stable_alias_in_text", f"""SELECT doc_id, pos, length({Q.squeeze('k')}) BETWEEN 2 AND 64 AND NOT regexp_matches(raw, '[:;\\[\\]{{}}]')
 AND {Q.ntoks('k')} <= 7 AND NOT regexp_matches(k, '[()<>/\\\\]') AS stable FROM ({Q.clean_cols('raw', _RAW, 'doc_id, pos, raw', 'k')})""")
def c7(spark, sf):
    raw = F.col("raw")
    return _raw(spark, sf).select("doc_id", "pos", K.stable_alias_in_text(raw, K.clean_surface(raw)).alias("stable"))


@query("c8_stable_alias_stored", f"""SELECT doc_id, pos, ch > 3 AND (n_up > 0 OR (n > 2 AND n <= 3) OR (n <= 2 AND ch > 6)) AS stable
FROM (SELECT doc_id, pos, {Q.ups('raw')} AS n_up, {Q.ntoks('raw')} AS n, {Q.alnum('raw')} AS ch FROM {_RAW})""")
def c8(spark, sf):
    return _raw(spark, sf).select("doc_id", "pos", K.stable_alias_stored(F.col("raw")).alias("stable"))


@query("c9_stable_alias_display", f"""SELECT doc_id, pos, ch >= 2 AND (n_up > 0 OR n > 2 OR (ch > 6 AND n BETWEEN 1 AND 2)) AS stable
FROM (SELECT doc_id, pos, {Q.ups('raw')} AS n_up, {Q.ntoks('raw')} AS n, {Q.alnum('raw')} AS ch FROM {_RAW})""")
def c9(spark, sf):
    return _raw(spark, sf).select("doc_id", "pos", K.stable_alias_display(F.col("raw")).alias("stable"))
