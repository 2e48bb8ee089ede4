"""Queries over reader projections (D8-D10, D12-D17, M)."""
from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.operators import mentions as D
from loreweave.operators import reader as M
from loreweave.operators import runs as RU
from loreweave.plans import inputs as I
from loreweave.plans import q_mentions as QM
from loreweave.plans import q_records as QR
from loreweave.plans import sqlkit as Q
from loreweave.plans.q_oneshot import _I7, _I8, _rel
from loreweave.plans.registry import query

CR, CV, IDC, CH, QT = I.duck(I.char_recs), I.duck(I.char_values), I.duck(I.identities), I.duck(I.chapters), I.duck(I.quoted_texts)
_P = I.duck(I.pairs)


def rk(x):
    return f"lower({Q.squeeze(f'coalesce({x}, {chr(39)}{chr(39)})')})"


_IDK = f"CASE WHEN trim(entity_key) <> '' THEN 'entity:' || lower(trim(entity_key)) ELSE 'name:' || {rk('display_name')} END"


def identities_with_order(spark, sf):
    return I.run(spark, sf, I.identities).select("chapter_id", F.col("name").alias("identity_id"), "name", F.array("alias").alias("aliases"), "ord")


_SENT = f"""st AS (SELECT doc_id AS chapter_id, u AS sentence, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS si FROM (SELECT doc_id, {Q.trim('unnest(l)')} AS u, unnest(range(len(l))) AS i FROM (
 SELECT doc_id, regexp_extract_all(text, '[^.!?。！？' || chr(10) || chr(13) || ']*([.!?。！？' || chr(10) || chr(13) || ']|$)') AS l FROM documents)) WHERE u <> '')"""
_D8 = f"""WITH {_SENT}, sv AS (SELECT chapter_id, name, unnest([name, lower(left(name, 1)) || substr(name, 2), alias, lower(left(alias, 1)) || substr(alias, 2)]) AS v FROM {IDC}),
h AS ({Q.scan_hits('(SELECT sv.*, si, sentence FROM sv JOIN st USING (chapter_id))', 'chapter_id, name, si, sentence, v', 'sentence', 'v')}),
top AS (SELECT chapter_id, name, si, sentence, s, e FROM h x WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.chapter_id = x.chapter_id AND y.name = x.name AND y.si = x.si AND y.s <= x.s AND y.e >= x.e AND y.e - y.s > x.e - x.s)),
mk AS (SELECT chapter_id, name, si, any_value(sentence) AS sentence, list({{'s': s, 'e': e}} ORDER BY s DESC) AS sp FROM top GROUP BY 1, 2, 3),
ctx AS (SELECT chapter_id, name, si, list_reduce(list_prepend({{'t': sentence, 's': 0::BIGINT, 'e': 0::BIGINT}}, list_transform(sp, lambda x: {{'t': '', 's': x.s, 'e': x.e}})),
 lambda a, x: {{'t': substr(a.t, 1, x.s) || '[[' || substr(a.t, x.s + 1, x.e - x.s) || ']]' || substr(a.t, x.e + 1), 's': x.s, 'e': x.e}}).t AS context FROM mk),
dd AS (SELECT * FROM ctx QUALIFY row_number() OVER (PARTITION BY chapter_id, name, {Q.key('context')} ORDER BY si) = 1)
SELECT chapter_id, name AS identity_id, context_index, context FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, name ORDER BY si) AS context_index FROM dd)"""


@query("d8_field_contexts", _D8)
def d8(spark, sf):
    chunks = I.table(spark, sf, "documents").selectExpr("doc_id AS chapter_id", "text")
    return D.field_contexts(chunks, identities_with_order(spark, sf), "chapter_id")


_QR = "'[\"''`“”‘’]'"
_D9 = f"""qs AS (SELECT chapter_id, text, ps, unnest(range(2, len(ps), 2)) AS i FROM (SELECT chapter_id, text, string_split_regex(text, {_QR}) AS ps FROM {QT})),
sp AS (SELECT chapter_id, text, ps[i] AS q, CAST(list_sum(list_transform(ps[1:i-1], lambda p: length(p))) + i - 2 AS BIGINT) AS s FROM qs),
ok AS (SELECT chapter_id, text, q, s, s + length(q) + 2 AS e, {Q.unquote(Q.trim(Q.clean('q')))} AS c FROM sp),
d9 AS (SELECT * FROM ok WHERE length({Q.squeeze('c')}) BETWEEN 2 AND 64 AND NOT regexp_matches(q, '[:;\\[\\]{{}}]') AND {Q.ntoks('c')} <= 7 AND NOT regexp_matches(c, '[()<>/\\\\]'))"""


@query("d9_quoted_spans", f"WITH {_D9} SELECT chapter_id, s AS start_char, e AS end_char, q AS text FROM d9")
def d9(spark, sf):
    return D.quoted_spans(I.run(spark, sf, I.quoted_texts), "chapter_id")


_D10 = f"""WITH {_D9}, w AS (SELECT chapter_id, s, c, text, s - strpos(reverse('.' || translate(substr(text, 1, s), '!?。！？' || chr(10) || chr(13), '.......')), '.') + 1 AS ws, translate(substr(text, e + 1), '!?。！？' || chr(10) || chr(13), '.......') AS aft, e FROM d9 WHERE c <> ''),
x AS (SELECT chapter_id, s, c, ws, substr(text, ws + 1, e + CASE WHEN strpos(aft, '.') > 0 THEN strpos(aft, '.') ELSE length(aft) END - ws) AS context, substr(text, ws + 1, s - ws) AS bef FROM w),
sv AS (SELECT chapter_id, name, ord, unnest([name, lower(left(name, 1)) || substr(name, 2), alias, lower(left(alias, 1)) || substr(alias, 2)]) AS v FROM {IDC}),
n1 AS ({Q.scan_hits('(SELECT sv.*, x.s AS qs, context FROM sv JOIN x USING (chapter_id))', 'chapter_id, qs, name, ord', 'context', 'v')}),
n2 AS ({Q.scan_hits('(SELECT sv.*, x.s AS qs, bef FROM sv JOIN x USING (chapter_id))', 'chapter_id, qs, name, ord', 'bef', 'v')}),
nb AS (SELECT chapter_id, qs, string_agg(name, '|' ORDER BY ord) AS names FROM (SELECT DISTINCT chapter_id, qs, name, ord FROM n1) GROUP BY 1, 2), nr AS (SELECT chapter_id, qs, max_by(name, (e, -ord)) AS nearest FROM n2 GROUP BY 1, 2)
SELECT x.chapter_id, x.s AS start_char, c AS surface, context, names AS nearby_names, nearest AS nearest_identity FROM x JOIN nb ON nb.chapter_id = x.chapter_id AND nb.qs = x.s LEFT JOIN nr ON nr.chapter_id = x.chapter_id AND nr.qs = x.s"""


@query("d10_quoted_alias_context", _D10)
def d10(spark, sf):
    c = D.quoted_alias_context(I.run(spark, sf, I.quoted_texts), identities_with_order(spark, sf), "chapter_id")
    return c.withColumn("nearby_names", F.array_join("nearby_names", "|"))


# names of one and of two words side by side, so that the short ones lie inside the long ones
_BOTH = f"SELECT chapter_id, name AS identity_id, name FROM {IDC} UNION SELECT chapter_id, alias, alias FROM {IDC}"
_D12 = f"""WITH b AS ({_BOTH}), v AS (SELECT chapter_id, name, unnest([name, lower(left(name, 1)) || substr(name, 2)]) AS v FROM b),
h AS ({Q.scan_hits(f"(SELECT v.*, content FROM v JOIN (SELECT chapter_id, content FROM {CH}) c USING (chapter_id))", 'chapter_id, name', 'content', 'v')}),
t AS (SELECT x.chapter_id, x.name, bool_and(EXISTS (SELECT 1 FROM h y WHERE y.chapter_id = x.chapter_id AND y.name <> x.name AND y.s <= x.s AND y.e >= x.e AND y.e - y.s > x.e - x.s AND contains({Q.fkey('y.name')}, {Q.fkey('x.name')}))) AS gone FROM h x GROUP BY 1, 2)
SELECT chapter_id, identity_id, name FROM b WHERE (chapter_id, name) NOT IN (SELECT (chapter_id, name) FROM t WHERE gone)"""


@query("d12_drop_substring_only_identities", _D12)
def d12(spark, sf):
    i = I.run(spark, sf, I.identities)
    both = i.select("chapter_id", F.col("name").alias("identity_id"), "name").union(i.select("chapter_id", F.col("alias").alias("a"), "alias")).distinct()
    return D.drop_substring_only_identities(both, I.run(spark, sf, I.chapters).withColumnRenamed("content", "text"), "chapter_id")


# alias rows of a novel: the word after the name, in the order of their chapters
_AL = f"SELECT novel_id, lower(display_name) AS entity_key, value_text AS alias_text, CASE WHEN field_key = 'alias' THEN 'alias' ELSE 'other_alias' END AS alias_type, 'L' AS alias_label, min(chapter_num) AS first_chapter_num, lower(display_name) || '/' || value_text || '/' || CASE WHEN field_key = 'alias' THEN 'alias' ELSE 'other_alias' END AS ord FROM {CV} WHERE field_key <> 'appearance' GROUP BY ALL"


def aliases(spark, sf):
    v = I.run(spark, sf, I.char_values).filter("field_key <> 'appearance'")
    return v.groupBy(
        "novel_id", F.lower("display_name").alias("entity_key"), F.col("value_text").alias("alias_text"), F.when(F.col("field_key") == "alias", "alias").otherwise("other_alias").alias("alias_type"),
    ).agg(F.min("chapter_num").alias("first_chapter_num")).withColumn("alias_label", F.lit("L")).withColumn("ord", F.concat_ws("/", "entity_key", "alias_text", "alias_type"))


# stored mentions: first place of every name in its chapter
_MN = f"SELECT r.record_id, display_name AS text, instr(content, display_name) - 1 AS start_char, instr(content, display_name) - 1 + length(display_name) AS end_char, CASE WHEN r.ord % 2 = 0 THEN 'name' ELSE 'alias' END AS mention_type FROM {{r}} r JOIN {{c}} c ON c.chapter_id = r.chapter_id"


def mentions(spark, sf):
    I.run(spark, sf, I.char_recs).createOrReplaceTempView("lw_char_recs")
    I.run(spark, sf, I.chapters).createOrReplaceTempView("lw_chapters")
    return spark.sql(_MN.format(r="lw_char_recs", c="lw_chapters"))


MN = "(" + _MN.format(r=CR, c=CH) + ")"
_STABLE = f"(n_ch >= 2 AND (n_up > 0 OR n_t > 2 OR (n_ch > 6 AND n_t BETWEEN 1 AND 2)))"
_SAL = f"(SELECT * FROM (SELECT *, {Q.ups('alias_text')} AS n_up, {Q.ntoks('alias_text')} AS n_t, {Q.alnum('alias_text')} AS n_ch FROM ({_AL})) WHERE {_STABLE})"
_D13 = f"""WITH r AS (SELECT *, {_IDK} AS ik, chapter_num || ':' || {_IDK} AS rkey FROM {CR}), a AS (SELECT * FROM {_SAL}),
runs AS (SELECT DISTINCT chapter_id, chapter_num, novel_id, unnest(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+')) AS v FROM {CH}),
av AS (SELECT *, unnest(list_distinct([alias_text, lower(left(alias_text, 1)) || substr(alias_text, 2), upper(left(alias_text, 1)) || substr(alias_text, 2)])) AS v FROM a),
cand AS (SELECT av.*, chapter_id, chapter_num FROM av JOIN runs USING (novel_id, v) WHERE first_chapter_num <= chapter_num),
h AS ({Q.scan_hits(f"(SELECT cand.*, content FROM cand JOIN (SELECT chapter_id, content FROM {CH}) c USING (chapter_id))", 'chapter_id, entity_key, alias_type, ord, v', 'content', 'v')}),
here AS (SELECT chapter_id, ik, max_by(rkey, (display_name, record_id)) AS rkey FROM r GROUP BY 1, 2),
al AS (SELECT chapter_id, s AS start_char, e AS end_char, v AS text, alias_type AS mention_type, coalesce(rkey, 'alias:entity:' || entity_key) AS record_key, 1 AS p, ord AS o FROM h LEFT JOIN (SELECT * FROM here) here USING (chapter_id) WHERE here.ik = 'entity:' || h.entity_key
 UNION ALL SELECT chapter_id, s, e, v, alias_type, 'alias:entity:' || entity_key, 1, ord FROM h WHERE (chapter_id, 'entity:' || entity_key) NOT IN (SELECT (chapter_id, ik) FROM here)),
st AS (SELECT chapter_id, start_char, end_char, text, mention_type, rkey AS record_key, 0 AS p, display_name || '/' || record_id AS o FROM {MN} m JOIN r USING (record_id))
SELECT chapter_id, start_char, end_char, text, min_by(mention_type, (p, o)) AS mention_type, min_by(record_key, (p, o)) AS record_key FROM (SELECT * FROM st UNION ALL SELECT * FROM al) GROUP BY 1, 2, 3, 4"""


@query("d13_highlight_mentions", _D13)
def d13(spark, sf):
    return M.highlight_mentions(QR.char_recs(spark, sf), mentions(spark, sf), aliases(spark, sf), I.run(spark, sf, I.chapters))


def _keep(src, keys):
    """Rows (s, e, rk) of ``src`` by start, longest first, without those that overlap an earlier choice."""
    t = "STRUCT(s BIGINT, e BIGINT, rk VARCHAR)[]"
    return f"""SELECT {keys}, r.s AS s, r.e AS e, r.rk AS rk FROM (SELECT {keys}, unnest(list_reduce(list_prepend({{'s': 0::BIGINT, 'e': 0::BIGINT, 'rk': '', 'last': 0::BIGINT, 'got': []::{t}}},
 list_transform(arr, lambda x: {{'s': x.s, 'e': x.e, 'rk': x.rk, 'last': 0::BIGINT, 'got': []::{t}}})), lambda a, x: CASE WHEN x.s < a.last THEN a ELSE {{'s': x.s, 'e': x.e, 'rk': x.rk, 'last': x.e,
 'got': list_append(a.got, {{'s': x.s, 'e': x.e, 'rk': x.rk}})}} END).got) AS r FROM (SELECT {keys}, list({{'s': s::BIGINT, 'e': e::BIGINT, 'rk': rk}} ORDER BY s, s - e, rk) AS arr FROM {src} GROUP BY ALL))"""


@query("d14_annotate_inline", f"""WITH {QM._OCC}, sel AS ({_keep("(SELECT chapter_id, s, e, 'k' AS rk FROM occ)", 'chapter_id')}), n AS (SELECT *, lag(e, 1, 0::BIGINT) OVER (PARTITION BY chapter_id ORDER BY s) AS pe FROM sel),
seg AS (SELECT chapter_id, s AS at, substr(content, s + 1, e - s) AS text, 'k' AS record_key FROM n JOIN (SELECT chapter_id, content FROM {CH}) c USING (chapter_id) UNION ALL SELECT chapter_id, pe, substr(content, pe + 1, s - pe), NULL FROM n JOIN (SELECT chapter_id, content FROM {CH}) c USING (chapter_id) WHERE s > pe
 UNION ALL SELECT chapter_id, coalesce(m, 0), substr(content, coalesce(m, 0) + 1), NULL FROM (SELECT chapter_id, content FROM {CH}) c LEFT JOIN (SELECT chapter_id, max(e) AS m FROM sel GROUP BY 1) x USING (chapter_id) WHERE length(content) > coalesce(m, 0))
SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY "at") - 1 AS seg_index, text, record_key FROM seg""".replace("s AS at,", 's AS "at",'))
def d14(spark, sf):
    occ = QM.d1(spark, sf).select("chapter_id", "start_char", "end_char", "text").withColumn("record_key", F.lit("k"))
    return M.annotate_inline(I.run(spark, sf, I.chapters).withColumnRenamed("content", "text"), occ, "chapter_id")


_D14P = f"""WITH bl AS (SELECT doc_id AS chapter_id, ps[i] AS text, CAST(coalesce(list_sum(list_transform(ps[1:i-1], lambda p: length(p))), 0) + (i - 1) * 2 AS BIGINT) AS b FROM (SELECT doc_id, string_split(t2, chr(10) || chr(10)) AS ps, unnest(range(1, len(string_split(t2, chr(10) || chr(10))) + 1)) AS i FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t2 FROM documents)) WHERE trim(ps[i]) <> ''),
m AS (SELECT r.chapter_id, record_id, display_name, strpos(replace(text, chr(10), chr(10) || chr(10)), display_name) - 1 AS s FROM {CR} r JOIN documents ON doc_id = r.chapter_id),
x AS (SELECT m.chapter_id, b, s - b AS s, s - b + length(display_name) AS e, record_id, text FROM m JOIN bl ON bl.chapter_id = m.chapter_id AND s >= b AND s + length(display_name) <= b + length(text)),
k AS ({_keep("(SELECT chapter_id, b, s, e, record_id AS rk FROM x)", 'chapter_id, b')}),
n AS (SELECT k.*, text, lag(e, 1, 0::BIGINT) OVER (PARTITION BY chapter_id, b ORDER BY s) AS pe FROM k JOIN bl USING (chapter_id, b)),
seg AS (SELECT chapter_id, b, s AS "at", substr(text, s + 1, e - s) AS t, rk AS record_key FROM n UNION ALL SELECT chapter_id, b, pe, substr(text, pe + 1, s - pe), NULL FROM n WHERE s > pe
 UNION ALL SELECT bl.chapter_id, bl.b, coalesce(mx, 0), substr(text, coalesce(mx, 0) + 1), NULL FROM bl LEFT JOIN (SELECT chapter_id, b, max(e) AS mx FROM k GROUP BY 1, 2) y ON y.chapter_id = bl.chapter_id AND y.b = bl.b WHERE length(text) > coalesce(mx, 0))
SELECT chapter_id, b AS block_start, row_number() OVER (PARTITION BY chapter_id, b ORDER BY "at") - 1 AS seg_index, t AS text, record_key FROM seg"""


@query("d14_annotate_paragraphs", _D14P)
def d14p(spark, sf):
    from loreweave.operators.segment import paragraph_blocks

    docs = I.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"))
    blocks = paragraph_blocks(docs.select(F.col("doc_id").alias("chapter_id"), "content", F.lit("#no title#").alias("title")))
    r = QR.char_recs(spark, sf).join(docs.withColumnRenamed("doc_id", "chapter_id"), "chapter_id")
    at = F.expr("instr(content, display_name) - 1").cast("long")
    men = r.select("chapter_id", at.alias("start_char"), (at + F.length("display_name")).alias("end_char"), F.col("record_id").alias("record_key"))
    return M.annotate_paragraphs(blocks, men)


@query("d15_inline_surfaces", f"""WITH r AS (SELECT *, {_IDK} AS ik FROM {CR}), l AS (SELECT novel_id, ik, max_by(display_name, (chapter_num, display_name, record_id)) AS dn, max(chapter_num) || ':' || ik AS rkey FROM r GROUP BY novel_id, ik),
x AS (SELECT novel_id, dn AS text, rkey, '' AS o FROM l UNION ALL SELECT a.novel_id, alias_text, rkey, ord FROM {_SAL} a JOIN l ON l.novel_id = a.novel_id AND l.ik = 'entity:' || entity_key)
SELECT novel_id, rkey AS record_key, min_by(text, o) AS text FROM x GROUP BY novel_id, rkey, lower(text)""")
def d15(spark, sf):
    return M.inline_surfaces(QR.char_recs(spark, sf), aliases(spark, sf))


_FIRST = f"SELECT novel_id, {_IDK} AS ik, lower(text) AS k, min((chapter_num, start_char)) AS f FROM {MN} m JOIN {CR} r USING (record_id) GROUP BY 1, 2, 3"


@query("d16_first_mention_location", f"""WITH f AS ({_FIRST}), w AS (SELECT novel_id, 'entity:' || entity_key AS identity_key, CASE WHEN length(alias_text) % 2 = 0 THEN entity_key ELSE alias_text END AS text, first_chapter_num AS fallback_chapter FROM ({_AL}))
SELECT w.*, coalesce(f[1], fallback_chapter) AS first_chapter_num, coalesce(f[2], 0) AS first_start_char FROM w LEFT JOIN f ON f.novel_id = w.novel_id AND ik = identity_key AND k = lower(text)""".replace("f[1]", "f.f[1]").replace("f[2]", "f.f[2]"))
def d16(spark, sf):
    w = aliases(spark, sf).select(
        "novel_id", F.concat(F.lit("entity:"), "entity_key").alias("identity_key"), F.when(F.length("alias_text") % 2 == 0, F.col("entity_key")).otherwise(F.col("alias_text")).alias("text"),
        F.col("first_chapter_num").alias("fallback_chapter"))
    return M.first_mention_location(w, QR.char_recs(spark, sf), mentions(spark, sf))


@query("d17_compact_mentions", f"SELECT novel_id, min_by(text, (start_char, text)) AS text, min_by(mention_type, (start_char, text)) AS mention_type FROM {MN} m JOIN {CR} r USING (record_id) GROUP BY novel_id, lower(text), mention_type")
def d17(spark, sf):
    m = mentions(spark, sf).join(QR.char_recs(spark, sf).select("record_id", "novel_id"), "record_id")
    return M.compact_mentions(m, ["novel_id"])


# --- M ---------------------------------------------------------------------------------------
@query("m1_visible_as_of", f"SELECT record_id, chapter_num AS visible_from FROM {CR} r WHERE chapter_num <= (SELECT max(chapter_num) // 2 FROM {CH})")
def m1(spark, sf):
    """What a reader in the middle of the chapters may see."""
    half = I.run(spark, sf, I.chapters).agg(F.max("chapter_num")).first()[0] // 2
    return M.visible_as_of(QR.char_recs(spark, sf), half).select("record_id", "visible_from")


@query("m2_identity_group_key", f"SELECT record_id, {_IDK} AS group_key, chapter_num || ':' || {_IDK} AS selection_key FROM {CR}")
def m2(spark, sf):
    e, n = F.col("entity_key"), F.col("display_name")
    return QR.char_recs(spark, sf).select("record_id", M.identity_group_key(e, n).alias("group_key"), M.selection_key(F.col("chapter_num"), e, n).alias("selection_key"))


_ALF = "('alias', 'aliases', 'other_alias', 'other_name', 'other_names', 'nickname', 'title_or_role')"
_M3 = f"""WITH r AS (SELECT *, {_IDK} AS ik FROM {CR}), f AS ({_FIRST}), amp AS (SELECT *, 'entity:' || entity_key || CASE WHEN first_chapter_num % 2 = 0 THEN '' ELSE '_else' END AS ik FROM {_SAL}),
x AS (SELECT novel_id, ik, alias_type AS kind, alias_text AS text, alias_label AS lab, first_chapter_num AS fb, ord AS o FROM amp WHERE (novel_id, ik) IN (SELECT (novel_id, ik) FROM r)
 UNION ALL SELECT r.novel_id, ik, lower(field_key), value_text, field_label, r.chapter_num, lpad(r.chapter_num::VARCHAR, 18, '0') || '/' || r.display_name || '/' || r.record_id || '/' || lpad(pos::VARCHAR, 18, '0') FROM (SELECT record_id, field_key, field_label, value_text, pos FROM {CV}) v JOIN r ON r.record_id = v.record_id WHERE lower(field_key) IN {_ALF} AND (r.novel_id, ik) NOT IN (SELECT (novel_id, ik) FROM amp)),
y AS (SELECT novel_id, ik, kind, lower(text) AS k, min_by(text, o) AS text, min_by(lab, o) AS lab, min_by(fb, o) AS fb FROM x WHERE (novel_id, ik, lower(text)) NOT IN (SELECT (novel_id, ik, lower(display_name)) FROM r) GROUP BY 1, 2, 3, 4)
SELECT y.novel_id, y.ik AS identity_key, text, CASE WHEN kind IN ('nickname', 'alias', 'aliases') THEN 'Biệt danh' ELSE lab END AS alias_label, coalesce(f.f[1], fb) AS first_chapter_num, coalesce(f.f[2], 0) AS first_start_char FROM y LEFT JOIN f ON f.novel_id = y.novel_id AND f.ik = y.ik AND f.k = y.k"""


@query("m3_alias_summaries", _M3)
def m3(spark, sf):
    # half of the alias map belongs to identities without records, so that both sources of names are used
    amap = aliases(spark, sf).withColumn("entity_key", F.expr("entity_key || CASE WHEN first_chapter_num % 2 = 0 THEN '' ELSE '_else' END"))
    return M.alias_summaries(QR.char_recs(spark, sf), QR.char_values(spark, sf), amap, mentions(spark, sf))


def _read_spec(x):
    t = f"list_filter(string_split(regexp_replace({rk(x)}, '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_'), lambda t: t <> '')"
    return f"(len({t}) * 1000 + length(array_to_string({t}, '')))"


_M4 = f"""ch4 AS (SELECT novel_id, ek, min_by(display_name, o) AS display_name, min_by(chapter_num, o) AS chapter_num FROM (SELECT novel_id, replace(lower(name), ' ', '_') AS ek, name AS display_name, chapter_num, (chapter_num, name, chapter_id || '/' || name) AS o FROM {IDC}) GROUP BY 1, 2),
rl4 AS (SELECT p.chapter_id, p.entity_key, c.novel_id, c.chapter_num, min_by(ln || ' ↔ ' || rn, ord) AS pair, p.chapter_id || '/' || p.entity_key AS record_id FROM pairs2 p JOIN (SELECT chapter_id, novel_id, chapter_num FROM {CH}) c ON c.chapter_id = p.chapter_id GROUP BY 1, 2, 3, 4),
en4 AS (SELECT DISTINCT rl4.*, split_part(entity_key, '|', a) AS own, split_part(entity_key, '|', 5 - a) AS other FROM rl4, (SELECT unnest([2, 3]) AS a)),
j4 AS (SELECT en4.*, a.display_name AS own_name, coalesce(b.display_name, CASE WHEN {rk("split_part(pair, ' ↔ ', 1)")} = {rk('a.display_name')} THEN split_part(pair, ' ↔ ', 2) ELSE split_part(pair, ' ↔ ', 1) END) AS related_name,
 b.chapter_num || ':entity:' || lower(b.ek) AS rkey FROM en4 JOIN ch4 a ON a.novel_id = en4.novel_id AND a.ek = own LEFT JOIN ch4 b ON b.novel_id = en4.novel_id AND b.ek = other),
v4 AS (SELECT j4.*, pos, trim(value) AS l, ev, {rk('related_name')} AS rel, (j4.chapter_num, pair, record_id, pos) AS o FROM j4 JOIN values8 v ON v.chapter_id = j4.chapter_id AND v.entity_key = j4.entity_key WHERE trim(value) <> '' AND (related = '' OR {rk('related')} = {rk('related_name')})),
q4 AS (SELECT novel_id, own, rel, chapter_num, min(q) AS q FROM (SELECT novel_id, own, rel, chapter_num, trim(unnest(ev).q) AS q FROM v4) WHERE q <> '' GROUP BY 1, 2, 3, 4, {rk('q')})"""


@query("m4_relationship_summaries", f"""WITH RECURSIVE {_I7}, {_I8}, {_M4} SELECT b.novel_id, b.own AS entity_key, related_name, label, record_key, coalesce(quotes, '') AS quotes FROM (
 SELECT novel_id, own, rel, min_by(related_name, o) AS related_name, min_by(l, (-{_read_spec('l')}, o)) AS label, min_by(rkey, (rkey IS NULL, o)) AS record_key FROM v4 GROUP BY 1, 2, 3) b
 LEFT JOIN (SELECT novel_id, own, rel, string_agg(chapter_num || ':' || q, '|' ORDER BY chapter_num, q) AS quotes FROM q4 GROUP BY 1, 2, 3) q ON q.novel_id = b.novel_id AND q.own = b.own AND q.rel = b.rel""")
def m4(spark, sf):
    built = _rel(spark, sf)
    rec = I.run(spark, sf, I.identities).select(
        "novel_id", "chapter_num", F.replace(F.lower("name"), F.lit(" "), F.lit("_")).alias("entity_key"), F.col("name").alias("display_name"), F.concat_ws("/", F.col("chapter_id").cast("string"), "name").alias("record_id"))
    ch = I.run(spark, sf, I.chapters).select("chapter_id", "chapter_num", "novel_id")
    rid = F.concat_ws("/", F.col("chapter_id").cast("string"), "entity_key").alias("record_id")
    relations = built["records"].join(ch, "chapter_id").select("novel_id", rid, "chapter_num", "entity_key", "display_name")
    values = built["values"].select(rid, "pos", "value", "related", "evidence")
    out = M.relationship_summaries(rec, relations, values)
    return out.withColumn("quotes", F.array_join(F.transform("quotes", lambda q: F.concat_ws(":", q["chapter_num"].cast("string"), q["quote"])), "|"))


@query("m5_attribute_rollup", f"""WITH r AS (SELECT *, {_IDK} AS ik FROM {CR}) SELECT r.novel_id, ik AS identity_key, lower(field_key) AS field, min_by(value_text, (r.chapter_num, r.display_name, r.record_id, pos)) AS value_text, q AS quote_key, min(r.chapter_num) AS chapter_num, count(*) AS seen, coalesce(string_agg(DISTINCT quote, '|' ORDER BY quote), '') AS quotes
FROM (SELECT record_id, field_key, value_text, pos, quote, lower(coalesce(quote, '')) AS q FROM {CV}) v JOIN r ON r.record_id = v.record_id WHERE lower(field_key) NOT IN {_ALF} GROUP BY r.novel_id, ik, lower(field_key), lower(value_text), q""")
def m5(spark, sf):
    return M.attribute_rollup(QR.char_recs(spark, sf), QR.char_values(spark, sf)).withColumn("quotes", F.array_join("quotes", "|"))


@query("m6_identity_records", f"""WITH o AS (SELECT novel_id, {_IDK} AS ik, chapter_num AS c, min_by(record_id, (display_name, record_id)) AS own FROM {CR} GROUP BY 1, 2, 3),
w AS (SELECT *, first(own) OVER i AS f, row_number() OVER i AS n, lead(c) OVER i - 1 AS e FROM o WINDOW i AS (PARTITION BY novel_id, ik ORDER BY c))
SELECT novel_id, ik AS identity_key, own AS record_id, c AS from_chapter, CASE WHEN n = 1 THEN e ELSE c END AS to_chapter FROM w
UNION ALL SELECT novel_id, ik, f, c + 1, e FROM w WHERE n > 1 AND (e IS NULL OR e > c)""")
def m6(spark, sf):
    return M.identity_records(QR.char_recs(spark, sf))


# --- K13: resets of what an analysis has written --------------------------------------------------
_NR = I.duck(I.novel_resets)
_LEFT = f"(SELECT * FROM {CR} c WHERE NOT EXISTS (SELECT 1 FROM {_NR} x WHERE x.novel_id = c.novel_id AND (x.from_num IS NULL OR c.chapter_num BETWEEN x.from_num AND x.to_num)))"


def _after_reset(spark, sf):
    resets = I.run(spark, sf, I.novel_resets)
    values = QR.char_values(spark, sf).select("record_id", "field_key", "field_label", "pos", "value_text", "confidence", "evidence")
    records = QR.char_recs(spark, sf).drop("chapter_id")
    return RU.reset_records(records, {"mentions": mentions(spark, sf)}, values, QR.alias_map(spark, sf), resets, ["novel_id"])


@query("k13_reset_records", f"SELECT novel_id, record_id, chapter_num FROM {_LEFT}")
def k13_records(spark, sf):
    return _after_reset(spark, sf)["records"].select("novel_id", "record_id", "chapter_num")


@query("k13_reset_values", f"SELECT record_id, field_key, pos, value_text FROM {CV} v WHERE record_id IN (SELECT record_id FROM {_LEFT})")
def k13_values(spark, sf):
    return _after_reset(spark, sf)["values"].select("record_id", "field_key", "pos", "value_text")


@query("k13_reset_mentions", f"SELECT record_id, text, start_char, end_char, mention_type FROM {MN} m WHERE record_id IN (SELECT record_id FROM {_LEFT})")
def k13_mentions(spark, sf):
    return _after_reset(spark, sf)["mentions"].select("record_id", "text", "start_char", "end_char", "mention_type")


@query("k13_reset_aliases", f"WITH {QR._J1.replace(CR, _LEFT)} SELECT novel_id, entity_key, alias_key, display_name, alias_type, alias_label, alias_text, first_chapter_num, confidence, quote FROM amap")
def k13_aliases(spark, sf):
    left = _after_reset(spark, sf)["aliases"]
    return left.withColumn("quote", F.get("evidence", F.lit(0))["quote"]).drop("evidence")
