"""Queries over dictionary x text matching (C13, C14, D)."""
from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.operators import mentions as M
from loreweave.plans import inputs as I
from loreweave.plans import sqlkit as Q
from loreweave.plans.registry import query

IDS = I.duck(I.identities)
CHAPTERS = I.duck(I.chapters)


def identities(spark, sf):
    return I.run(spark, sf, I.identities).select(
        "chapter_id", "novel_id", F.col("name").alias("identity_id"), "name", F.array("alias").alias("aliases"), "ord"
    )


_SURF = f"""SELECT chapter_id, novel_id, name, name AS surface, 'name' AS mention_type, 0 AS ord FROM {IDS}
UNION ALL SELECT chapter_id, novel_id, name, alias, 'alias', 1 FROM {IDS}"""
_VAR = f"SELECT *, unnest([surface, lower(left(surface, 1)) || substr(surface, 2)]) AS v FROM ({_SURF})"
# distinct surfaces are scanned once per chapter and joined back to their identities
_OCC = f"""hits AS MATERIALIZED ({Q.scan_hits(f"(SELECT DISTINCT chapter_id, v, content FROM ({_VAR}) JOIN {CHAPTERS} USING (chapter_id))", 'chapter_id, v', 'content', 'v')}),
occ AS (SELECT chapter_id, name, surface, mention_type, ord, v AS text, s, e FROM ({_VAR}) JOIN hits USING (chapter_id, v))"""
_AMB = f"({Q.ups('surface')} = 0 OR ({Q.ntoks('surface')} <= 2 AND {Q.ups('surface')} < 2))"


@query("c13_identity_surfaces", f"SELECT chapter_id, name AS identity_id, surface, mention_type, ord FROM ({_SURF})")
def c13(spark, sf):
    return M.identity_surfaces(identities(spark, sf), ("chapter_id", "identity_id"))


@query("c14_surface_variants", f"SELECT chapter_id, name AS identity_id, surface, v AS variant FROM ({_VAR})")
def c14(spark, sf):
    return M.variant_rows(c13(spark, sf)).drop("mention_type", "ord")


@query("d1_find_occurrences", f"""WITH {_OCC} SELECT chapter_id, name AS identity_id, surface, mention_type, text, s AS start_char, e AS end_char,
 {_AMB} AS ambiguous FROM occ""")
def d1(spark, sf):
    chapters = I.run(spark, sf, I.chapters)
    return M.find_occurrences(chapters, c13(spark, sf), ["chapter_id"], text_id="chapter_id", text_col="content").drop("ord")


# --- occurrences of all surfaces of a novel in all its chapters -------------------------------
_NSURF = f"SELECT DISTINCT novel_id, alias AS surface FROM {IDS}"


@query("d1_find_occurrences_by_novel", f"""WITH v AS (SELECT novel_id, surface, unnest([surface, lower(left(surface, 1)) || substr(surface, 2)]) AS v FROM ({_NSURF})),
runs AS (SELECT DISTINCT chapter_id, novel_id, unnest(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+')) AS v FROM {CHAPTERS}),
cand AS (SELECT chapter_id, novel_id, surface, v, content FROM v JOIN runs USING (novel_id, v) JOIN (SELECT chapter_id, content FROM {CHAPTERS}) c USING (chapter_id))
SELECT chapter_id, novel_id, surface, v AS text, s AS start_char, e AS end_char FROM ({Q.scan_hits('cand', 'chapter_id, novel_id, surface, v', 'content', 'v')})""")
def d1_novel(spark, sf):
    surfaces = I.run(spark, sf, I.identities).select("novel_id", F.col("alias").alias("surface")).distinct()
    chapters = I.run(spark, sf, I.chapters)
    return M.find_occurrences(chapters, surfaces, ["novel_id"], text_id="chapter_id", text_col="content").drop("ambiguous")


_FOLD = """sel AS (SELECT chapter_id, name, unnest(list_reduce(list_prepend({'n': 0, 's': 0, 'e': 0, 'text': '', 'mt': '', 'sf': '',
 'got': []::STRUCT(s BIGINT, e BIGINT, text VARCHAR, mt VARCHAR, sf VARCHAR)[]}, list_transform(arr, lambda x: {'n': x.n, 's': x.s, 'e': x.e, 'text': x.text,
 'mt': x.mt, 'sf': x.sf, 'got': []::STRUCT(s BIGINT, e BIGINT, text VARCHAR, mt VARCHAR, sf VARCHAR)[]})),
 lambda a, x: {'n': x.n, 's': x.s, 'e': x.e, 'text': x.text, 'mt': x.mt, 'sf': x.sf, 'got': CASE WHEN len(list_filter(a.got, lambda g: g.s < x.e AND x.s < g.e)) > 0
 THEN a.got ELSE list_append(a.got, {'s': x.s, 'e': x.e, 'text': x.text, 'mt': x.mt, 'sf': x.sf}) END}).got) AS r
FROM (SELECT chapter_id, name, list({'n': (s - e)::BIGINT, 's': s::BIGINT, 'text': text, 'e': e::BIGINT, 'mt': mention_type, 'sf': surface} ORDER BY s - e, s, text) AS arr
 FROM occ GROUP BY 1, 2)),
men AS (SELECT chapter_id, name, r.s AS s, r.e AS e, r.text AS text, r.mt AS mention_type, r.sf AS surface FROM sel)"""


@query("d2_select_non_overlapping", f"WITH {_OCC}, {_FOLD} SELECT chapter_id, name AS identity_id, text, s AS start_char, e AS end_char, surface FROM men")
def d2(spark, sf):
    return d3(spark, sf).drop("mention_type")


@query("d3_scan_identity_mentions", f"WITH {_OCC}, {_FOLD} SELECT chapter_id, name AS identity_id, text, s AS start_char, e AS end_char, mention_type, surface FROM men")
def d3(spark, sf):
    return M.scan_identity_mentions(I.run(spark, sf, I.chapters), identities(spark, sf)).drop("ord", "ambiguous")


_GRP = f"grp AS (SELECT *, mention_type || ':' || {Q.key('text')} AS group_key FROM men WHERE {_AMB})"
_SMP = """smp AS (SELECT chapter_id, name, group_key, s, e, text FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, name, group_key ORDER BY s, e, text) - 1 AS i,
 count(*) OVER (PARTITION BY chapter_id, name, group_key) AS n FROM grp))"""
_DEC = """dec AS (SELECT *, s % 3 <> 0 AS yes, CASE WHEN s % 7 = 0 THEN NULL ELSE (s % 10) / 10.0 END AS conf FROM smp WHERE s % 11 <> 0),
jdg AS (SELECT chapter_id, name, group_key, s, e, coalesce(yes AND coalesce(conf, 1.0) >= 0.5, FALSE) AS ok FROM smp LEFT JOIN dec USING (chapter_id, name, group_key, s, e)),
rep AS (SELECT chapter_id, name, group_key, occurrence_count, surface_text, sample_count, confirmed_count,
 confirmed_count = sample_count AND length(regexp_replace(surface_text, '[^\\p{L}\\p{N}]', '', 'g')) >= 5 AND contains(surface_text, ' ') AS accept_all
 FROM (SELECT chapter_id, name, group_key, count(*) AS occurrence_count, min_by(text, s) AS surface_text FROM grp GROUP BY 1, 2, 3)
 JOIN (SELECT chapter_id, name, group_key, count(*) AS sample_count, count(*) FILTER (ok) AS confirmed_count FROM jdg GROUP BY 1, 2, 3) USING (chapter_id, name, group_key))"""
G = ["chapter_id", "identity_id"]


def _mentions(spark, sf):
    return M.scan_identity_mentions(I.run(spark, sf, I.chapters), identities(spark, sf)).drop("ord")


@query("d4_group_ambiguous", f"""WITH {_OCC}, {_FOLD}, {_GRP} SELECT chapter_id, name AS identity_id, group_key, s AS start_char, e AS end_char, text FROM grp""")
def d4(spark, sf):
    return M.group_ambiguous(_mentions(spark, sf), G)[1].drop("surface", "mention_type", "ambiguous")


@query("d5_sample_for_confirmation", f"WITH {_OCC}, {_FOLD}, {_GRP}, {_SMP} SELECT chapter_id, name AS identity_id, group_key, s AS start_char, e AS end_char, text FROM smp")
def d5(spark, sf):
    return M.sample_for_confirmation(d4(spark, sf), G)


def _confirmed(spark, sf):
    groups = d4(spark, sf)
    samples = M.sample_for_confirmation(groups, G)
    s = F.col("start_char")
    decisions = samples.filter(s % 11 != 0).select(
        *G, "start_char", "end_char", (s % 3 != 0).alias("is_character_mention"),
        F.when(s % 7 != 0, (s % 10) / 10.0).alias("confidence"),
    )
    return M.apply_confirmations(groups, samples, decisions, G)


@query("d6_apply_confirmations", f"""WITH {_OCC}, {_FOLD}, {_GRP}, {_SMP}, {_DEC} SELECT grp.chapter_id, grp.name AS identity_id, grp.group_key, grp.s AS start_char, grp.e AS end_char, grp.text
FROM grp JOIN rep USING (chapter_id, name, group_key) LEFT JOIN jdg ON jdg.chapter_id = grp.chapter_id AND jdg.name = grp.name AND jdg.group_key = grp.group_key AND jdg.s = grp.s AND jdg.e = grp.e
WHERE rep.accept_all OR coalesce(jdg.ok, FALSE)""")
def d6(spark, sf):
    return _confirmed(spark, sf)[0]


@query("d6_confirmation_report", f"""WITH {_OCC}, {_FOLD}, {_GRP}, {_SMP}, {_DEC} SELECT chapter_id, name AS identity_id, group_key, occurrence_count, surface_text, sample_count, confirmed_count, accept_all FROM rep""")
def d6_report(spark, sf):
    return _confirmed(spark, sf)[1]


@query("d7_mark_context", f"""WITH {_OCC} SELECT chapter_id, identity_id, start_char, substr(content, greatest(start_char - 150, 0) + 1, start_char - greatest(start_char - 150, 0)) || '[[' || text || ']]'
 || substr(content, end_char + 1, 150) AS context FROM (SELECT chapter_id, name AS identity_id, s AS start_char, e AS end_char, text FROM occ) JOIN (SELECT chapter_id, content FROM {CHAPTERS}) c USING (chapter_id)""")
def d7(spark, sf):
    chapters = I.run(spark, sf, I.chapters).select("chapter_id", "content")
    return d1(spark, sf).join(chapters, "chapter_id").select(
        "chapter_id", "identity_id", "start_char",
        M.mark_context(F.col("content"), F.col("start_char"), F.col("end_char")).alias("context"),
    )


@query("b7_sentence_window", f"""WITH {_OCC}, p AS (SELECT occ.*, content, translate(content, '!?。！？' || chr(10) || chr(13), '.......') AS n FROM occ JOIN (SELECT chapter_id, content FROM {CHAPTERS}) c USING (chapter_id)),
w AS (SELECT chapter_id, name, s, e, content, s - strpos(reverse('.' || substr(n, 1, s)), '.') + 1 AS ws,
 e + CASE WHEN strpos(substr(n, e + 1), '.') > 0 THEN strpos(substr(n, e + 1), '.') ELSE length(n) - e END AS we FROM p)
SELECT chapter_id, name AS identity_id, s AS start_char, ws AS s, we AS e, substr(content, ws + 1, we - ws) AS context FROM w""")
def b7(spark, sf):
    from loreweave.functions.textfns import one_stop, sentence_window

    chapters = I.run(spark, sf, I.chapters).select("chapter_id", "content", one_stop(F.col("content")).alias("_normal"))
    return d1(spark, sf).join(chapters, "chapter_id").select(
        "chapter_id", "identity_id", "start_char",
        sentence_window(F.col("content"), F.col("start_char"), F.col("end_char"), normal=F.col("_normal")).alias("w"),
    ).select("chapter_id", "identity_id", "start_char", "w.*")
