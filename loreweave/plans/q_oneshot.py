"""Queries over the structured one-shot path (A3, I)."""
from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.operators import oneshot as O
from loreweave.operators.mentions import known_identities_in_text
from loreweave.operators.relations import unique_surfaces
from loreweave.plans import inputs as I
from loreweave.plans import sqlkit as Q
from loreweave.plans.registry import query
from loreweave.sources import corpus as C

OC, OR, IDC = I.duck(I.one_characters), I.duck(I.one_relationships), I.duck(I.identities)
CH = I.duck(I.chapters)


def chapters(spark, sf):
    return I.run(spark, sf, I.chapters).select("chapter_id", "chapter_num", "novel_id", "content")


def characters(spark, sf):
    c = I.run(spark, sf, I.one_characters)
    f = F.struct(F.col("field_key"), F.lit("L").alias("field_label"), F.col("value_text").alias("value"), "semantic_class", F.lit(0.9).alias("confidence"), F.array("field_quote").alias("quotes"))
    return c.select(
        "chapter_id", "ord", "display_name", "entity_nature", "confidence", F.array("alias_a", "alias_b").alias("aliases"), F.array("quote").alias("quotes"),
        F.when(F.col("has_field"), F.array(f)).otherwise(F.filter(F.array(f), lambda x: F.lit(False))).alias("fields"))


def relationships(spark, sf):
    return I.run(spark, sf, I.one_relationships).withColumn("quotes", F.array("quote")).drop("quote", "chapter_num")


def model_outputs(spark, sf):
    """Model answers as text, with words around the JSON and raw line breaks inside strings."""
    c = I.run(spark, sf, I.one_characters).groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct(
        "ord", "display_name", F.array("alias_a", "alias_b").alias("aliases"), "entity_nature", "confidence", F.array("quote").alias("evidence_quotes"),
        F.when(F.col("has_field"), F.array(F.struct("field_key", F.col("value_text").alias("value"), "semantic_class", F.array("field_quote").alias("evidence_quotes")))).alias("fields")))).alias("characters"))
    r = I.run(spark, sf, I.one_relationships).groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct(
        "ord", "source_name", "target_name", F.col("rel_scope").alias("relationship_scope"), F.col("rel_type").alias("relationship_type"), F.col("forward").alias("source_to_target_label"),
        F.col("backward").alias("target_to_source_label"), "confidence", F.array("quote").alias("evidence_quotes")))).alias("relationships"))
    doc = F.to_json(F.struct(F.lit(O.RESPONSE_SCHEMA).alias("schema_version"), F.col("chapter_id").alias("chapter_num"), "characters", "relationships", F.lit("x").alias("note")))
    text = F.concat(F.lit("Here it is: "), F.replace(doc, F.lit('"note":"x"'), F.lit('"note":"a\nb\tc"')), F.lit(" done."))
    broken = F.when(F.col("chapter_id") % 10 == 9, F.replace(text, F.lit('"characters":['), F.lit('"characters":'))).otherwise(text)
    return c.join(r, "chapter_id").select("chapter_id", broken.alias("json_text"))


@query("a3_read_model_outputs", f"SELECT chapter_id, ord, display_name, entity_nature, confidence, alias_a || '|' || alias_b AS aliases, quote AS quotes, CASE WHEN has_field THEN value_text || '~' || field_quote ELSE '' END AS fields FROM {OC} WHERE chapter_id % 10 <> 9")
def a3(spark, sf):
    docs, _ = C.read_model_outputs(model_outputs(spark, sf))
    c, _ = C.flatten_outputs(docs)
    return c.select("chapter_id", "ord", "display_name", "entity_nature", "confidence", F.array_join("aliases", "|").alias("aliases"), F.array_join("quotes", "|").alias("quotes"),
                    F.array_join(F.transform("fields", lambda f: F.concat_ws("~", f["value"], F.array_join(f["quotes"], "|"))), "|").alias("fields"))


@query("a3_model_relationships", f"SELECT chapter_id, ord, source_name, target_name, rel_scope, rel_type, forward, backward, confidence, quote AS quotes FROM {OR} WHERE chapter_id % 10 <> 9")
def a3_rel(spark, sf):
    docs, _ = C.read_model_outputs(model_outputs(spark, sf))
    return C.flatten_outputs(docs)[1].withColumn("quotes", F.array_join("quotes", "|"))


@query("l3_repair_queue", f"SELECT DISTINCT chapter_id, 1 AS attempt FROM {OC} WHERE chapter_id % 10 = 9")
def l3(spark, sf):
    from loreweave.operators.modeltext import repair_queue

    _, bad = C.read_model_outputs(model_outputs(spark, sf))
    return repair_queue(bad, "json_text")[0].select("chapter_id", "attempt")


_HDR = f"SELECT doc_id AS chapter_id, CASE WHEN doc_id % 9 = 4 THEN 'v0' WHEN doc_id % 9 = 5 THEN NULL ELSE ' {O.RESPONSE_SCHEMA} ' END AS schema_version, CASE WHEN doc_id % 7 = 3 THEN doc_id + 1 WHEN doc_id % 7 = 4 THEN NULL ELSE doc_id END AS chapter_num FROM documents"


@query("i1_check_document_header", f"SELECT chapter_id, CASE WHEN coalesce(trim(schema_version), '') <> '{O.RESPONSE_SCHEMA}' THEN 'cloud_schema_mismatch' WHEN chapter_num IS NULL OR chapter_num <> chapter_id THEN 'cloud_chapter_num_mismatch' ELSE 'ok' END AS code FROM ({_HDR})")
def i1(spark, sf):
    I.table(spark, sf, "documents").createOrReplaceTempView("documents")
    ok, bad = O.check_document_header(spark.sql(_HDR), chapters(spark, sf))
    return ok.select("chapter_id", F.lit("ok").alias("code")).unionByName(bad)


# characters that count, with their cleaned name and valid aliases (one alias is a single lower-case word or a pair)
_CC = f"""c0 AS (SELECT *, {Q.unquote(Q.trim(Q.clean('display_name')))} AS name, {Q.skey('entity_nature')} AS nature FROM {OC} WHERE coalesce(confidence, 0) >= 0.45),
c1 AS (SELECT *, replace(lower(name), ' ', '_') AS ek FROM c0 WHERE nature = 'person' AND name <> ''),
al AS (SELECT chapter_id, ord, p AS pos, a AS text FROM (SELECT chapter_id, ord, name, unnest([alias_a, alias_b]) AS a, unnest([0, 1]) AS p FROM c1) WHERE {Q.key('a')} <> {Q.key('name')} AND NOT contains({Q.fkey('a')}, {Q.fkey('name')}) AND {Q.ups('a')} > 0),
sf AS (SELECT chapter_id, ord, name AS surface, 'name' AS mt, 0 AS so FROM c1 UNION ALL SELECT chapter_id, ord, text, 'alias', pos + 1 FROM al),
sv AS (SELECT *, unnest([surface, lower(left(surface, 1)) || substr(surface, 2)]) AS v FROM sf),
hits AS MATERIALIZED ({Q.scan_hits(f"(SELECT DISTINCT chapter_id, v, content FROM sv JOIN (SELECT chapter_id, content FROM {CH}) USING (chapter_id))", 'chapter_id, v', 'content', 'v')}),
occ AS (SELECT chapter_id, ord, surface, mt, v AS text, s, e FROM sv JOIN hits USING (chapter_id, v)),
sel AS (SELECT chapter_id, ord, unnest(list_reduce(list_prepend({{'n': 0, 's': 0, 'e': 0, 'text': '', 'mt': '', 'got': []::STRUCT(s BIGINT, e BIGINT, text VARCHAR, mt VARCHAR)[]}},
 list_transform(arr, lambda x: {{'n': x.n, 's': x.s, 'e': x.e, 'text': x.text, 'mt': x.mt, 'got': []::STRUCT(s BIGINT, e BIGINT, text VARCHAR, mt VARCHAR)[]}})),
 lambda a, x: {{'n': x.n, 's': x.s, 'e': x.e, 'text': x.text, 'mt': x.mt, 'got': CASE WHEN len(list_filter(a.got, lambda g: g.s < x.e AND x.s < g.e)) > 0 THEN a.got ELSE list_append(a.got, {{'s': x.s, 'e': x.e, 'text': x.text, 'mt': x.mt}}) END}}).got) AS r
 FROM (SELECT chapter_id, ord, list({{'n': (s - e)::BIGINT, 's': s::BIGINT, 'text': text, 'e': e::BIGINT, 'mt': mt}} ORDER BY s - e, s, text) AS arr FROM occ GROUP BY 1, 2)),
men AS (SELECT chapter_id, ord, r.s AS s, r.e AS e, r.text AS text FROM sel),
rec AS (SELECT chapter_id, ek AS entity_key, min(ord) AS record_ord, min_by(name, ord) AS display_name FROM c1 GROUP BY 1, 2),
own AS (SELECT c1.chapter_id, c1.ord, record_ord FROM c1 JOIN rec ON rec.chapter_id = c1.chapter_id AND rec.entity_key = c1.ek)"""
_FLD = f"""f0 AS (SELECT c1.chapter_id, c1.ord, display_name, trim(value_text) AS value_text, CASE WHEN semantic_class = '' THEN field_key ELSE {Q.akey('semantic_class')} END AS cls, trim(field_quote) AS q, content FROM c1 JOIN (SELECT chapter_id, content FROM {CH}) x USING (chapter_id) WHERE has_field AND trim(value_text) <> ''),
f1 AS (SELECT *, cls IN ('physical_appearance', 'clothing', 'age_or_build', 'appearance') AS okc, strpos(content, q) - 1 AS p FROM f0)"""


@query("i2_build_character_records", f"WITH {_CC} SELECT rec.chapter_id, entity_key, rec.record_ord, display_name, count(DISTINCT (s, e, {Q.key('text')})) FILTER (s IS NOT NULL) AS mention_count FROM rec LEFT JOIN own USING (chapter_id, record_ord) LEFT JOIN men ON men.chapter_id = own.chapter_id AND men.ord = own.ord GROUP BY 1, 2, 3, 4")
def i2(spark, sf):
    b = O.build_character_records(characters(spark, sf), chapters(spark, sf))
    n = b["mentions"].groupBy("chapter_id", "record_ord").agg(F.count(F.lit(1)).alias("mention_count"))
    return b["records"].join(n, ["chapter_id", "record_ord"], "left").fillna(0, ["mention_count"])


@query("i2_suspects", f"""WITH {_CC}, {_FLD} SELECT chapter_id, 'character_entity_nature_not_persistable' AS reason, display_name AS subject, nature AS detail FROM c0 WHERE nature <> 'person'
UNION ALL SELECT chapter_id, 'character_mentions_not_found_from_surfaces', display_name, '' FROM c1 WHERE (chapter_id, ord) NOT IN (SELECT (chapter_id, ord) FROM men)
UNION ALL SELECT chapter_id, CASE WHEN okc THEN 'field_evidence_not_found_in_chapter' ELSE 'field_semantic_class_not_persistable' END, display_name, value_text FROM f1 WHERE NOT okc OR p < 0""")
def i2_suspects(spark, sf):
    return O.build_character_records(characters(spark, sf), chapters(spark, sf))["suspects"]


# one row per chapter and step of the fold over its records; merged records leave the list, so the place stays
_BROAD = "(length({0}) >= 6 AND contains({0}, '_'))"
_STRONG = "t.id <> src.id AND (len(t.m) > len(src.m) OR t.n > 0 OR len(t.a) > 0)"
_I3 = f"""m3 AS (SELECT own.chapter_id, record_ord, list(DISTINCT s || ':' || e || ':' || {Q.key('text')}) AS m FROM own JOIN men ON men.chapter_id = own.chapter_id AND men.ord = own.ord GROUP BY 1, 2),
v3 AS (SELECT own.chapter_id, record_ord, count(*) FILTER (attr) AS n, list(DISTINCT f) FILTER (f <> '') AS a FROM own JOIN (SELECT chapter_id, ord, {Q.fkey('text')} AS f, FALSE AS attr FROM al
 UNION ALL SELECT chapter_id, ord, {Q.fkey('value_text')}, TRUE FROM f1 WHERE okc AND p >= 0) x ON x.chapter_id = own.chapter_id AND x.ord = own.ord GROUP BY 1, 2),
rs0 AS (SELECT rec.chapter_id, list({{'id': rec.record_ord, 'k': {Q.fkey('display_name')}, 'm': coalesce(m, []::VARCHAR[]), 'n': coalesce(n, 0), 'a': coalesce(a, []::VARCHAR[])}} ORDER BY rec.record_ord) AS rs
 FROM rec LEFT JOIN m3 ON m3.chapter_id = rec.chapter_id AND m3.record_ord = rec.record_ord LEFT JOIN v3 ON v3.chapter_id = rec.chapter_id AND v3.record_ord = rec.record_ord GROUP BY 1),
st3 AS (SELECT chapter_id, 0 AS step, 1::BIGINT AS i, rs, []::STRUCT(s BIGINT, t BIGINT, kind VARCHAR)[] AS log FROM rs0
 UNION ALL SELECT chapter_id, step + 1, CASE WHEN hit = 0 THEN i + 1 ELSE i END,
  CASE WHEN hit = 0 THEN rs ELSE list_filter(list_transform(rs, lambda r, n: CASE WHEN n = hit THEN {{'id': r.id, 'k': r.k, 'm': list_distinct(list_concat(r.m, src.m)), 'n': r.n, 'a': list_distinct(list_concat(r.a, src.a))}} ELSE r END), lambda r: r.id <> src.id) END,
  CASE WHEN hit = 0 THEN log ELSE list_append(log, {{'s': src.id, 't': rs[hit].id, 'kind': CASE WHEN exact > 0 THEN 'exact_alias_surface' ELSE 'near_alias_surface' END}}) END
 FROM (SELECT *, CASE WHEN NOT (len(src.m) <= 2 AND src.n = 0 AND src.k <> '') THEN 0 WHEN exact > 0 THEN exact ELSE close END AS hit FROM (
  SELECT *, coalesce(list_position(list_transform(rs, lambda t: {_STRONG} AND (t.k = src.k OR list_contains(t.a, src.k))), TRUE), 0) AS exact,
   coalesce(list_position(list_transform(rs, lambda t: {_STRONG} AND len(list_filter(t.a, lambda a: a = src.k OR ({_BROAD.format('a')} AND {_BROAD.format('src.k')} AND levenshtein(a, src.k) <= 1))) > 0), TRUE), 0) AS close
  FROM (SELECT *, rs[i] AS src FROM st3 WHERE i <= len(rs)) x1) x2) x3),
log3 AS (SELECT chapter_id, log, unnest(log) AS e FROM (SELECT chapter_id, arg_max(log, step) AS log FROM st3 GROUP BY 1)),
mrg3 AS (SELECT chapter_id, e.s AS source_ord, e.t AS target_ord, e.kind AS match_kind,
 list_reduce(list_prepend({{'s': 0::BIGINT, 't': e.t, 'kind': ''}}, log), lambda c, x: {{'s': 0::BIGINT, 't': CASE WHEN x.s = c.t THEN x.t ELSE c.t END, 'kind': ''}}).t AS final_ord FROM log3)"""


@query("i3_merge_probable_aliases", f"WITH RECURSIVE {_CC}, {_FLD}, {_I3} SELECT chapter_id, source_ord, target_ord, match_kind, final_ord FROM mrg3")
def i3(spark, sf):
    b = O.build_character_records(characters(spark, sf), chapters(spark, sf))
    return O.merge_probable_aliases(b["records"], b["mentions"], b["values"])


@query("i4_build_attribute_fields", f"WITH {_CC}, {_FLD} SELECT chapter_id, ord, value_text, p AS start_char, p + length(q) AS end_char, q AS quote FROM f1 WHERE okc AND p >= 0")
def i4(spark, sf):
    c = characters(spark, sf).filter("coalesce(confidence, 0) >= 0.45 AND entity_nature = 'person'")
    e = F.get("evidence", F.lit(0))
    return O.build_attribute_fields(c, chapters(spark, sf))[0].select("chapter_id", "ord", "value_text", e["start_char"].alias("start_char"), e["end_char"].alias("end_char"), e["quote"].alias("quote"))


@query("i5_resolve_surfaces_unique", f"SELECT chapter_id, skey, min(ord) AS ord FROM (SELECT DISTINCT chapter_id, ord, unnest([{Q.key('name')}, {Q.key('alias')}]) AS skey FROM {IDC}) GROUP BY 1, 2 HAVING count(*) = 1")
def i5(spark, sf):
    ids = I.run(spark, sf, I.identities).select("chapter_id", "ord", "name", F.array("alias").alias("aliases"))
    return unique_surfaces(ids, ["chapter_id"], "ord")


@query("i6_locate_quotes", f"SELECT chapter_id, ord, strpos(content, trim(field_quote)) - 1 AS start_char, strpos(content, trim(field_quote)) - 1 + length(trim(field_quote)) AS end_char, trim(field_quote) AS quote FROM {OC} JOIN (SELECT chapter_id, content FROM {CH}) c USING (chapter_id) WHERE strpos(content, trim(field_quote)) > 0")
def i6(spark, sf):
    q = I.run(spark, sf, I.one_characters).select("chapter_id", "ord", F.array("field_quote", F.upper("field_quote")).alias("quotes"))
    e = F.get("evidence", F.lit(0))
    return O.locate_quotes(q, chapters(spark, sf), ["ord"], "r").select("chapter_id", "ord", e["start_char"].alias("start_char"), e["end_char"].alias("end_char"), e["quote"].alias("quote"))


_I7 = f"""uq AS (SELECT chapter_id, k, min(ord) AS id FROM (SELECT DISTINCT chapter_id, ord, unnest([{Q.key('name')}, {Q.key('alias')}]) AS k FROM {IDC}) GROUP BY 1, 2 HAVING count(*) = 1),
r0 AS (SELECT r.*, a.id AS si, b.id AS ti, ia.name AS sn, ib.name AS tn, strpos(content, quote) AS p, {Q.skey('rel_scope')} AS sc, {Q.skey('rel_type')} AS ty, trim(forward) AS fw, trim(backward) AS bk FROM {OR} r
 LEFT JOIN uq a ON a.chapter_id = r.chapter_id AND a.k = {Q.key('source_name')} LEFT JOIN uq b ON b.chapter_id = r.chapter_id AND b.k = {Q.key('target_name')} LEFT JOIN {IDC} ia ON ia.chapter_id = r.chapter_id AND ia.ord = a.id LEFT JOIN {IDC} ib ON ib.chapter_id = r.chapter_id AND ib.ord = b.id
 JOIN (SELECT chapter_id, content FROM {CH}) c ON c.chapter_id = r.chapter_id WHERE coalesce(r.confidence, 0) >= 0.45),
r1 AS (SELECT *, CASE WHEN sc = 'event' THEN 'relationship_scope_not_persistable' WHEN si IS NULL THEN 'relationship_source_not_resolved_unique' WHEN ti IS NULL THEN 'relationship_target_not_resolved_unique' END AS why, coalesce(sc <> 'event' AND si <> ti AND fw <> '' AND bk <> '' AND ty <> '', FALSE) AS usable FROM r0),
r2 AS (SELECT *, CASE WHEN {Q.key('sn')} <= {Q.key('tn')} THEN sn ELSE tn END AS ln, CASE WHEN {Q.key('sn')} <= {Q.key('tn')} THEN tn ELSE sn END AS rn, CASE WHEN {Q.key('sn')} <= {Q.key('tn')} THEN fw ELSE bk END AS ll, CASE WHEN {Q.key('sn')} <= {Q.key('tn')} THEN bk ELSE fw END AS rl FROM r1 WHERE usable AND p > 0),
pairs2 AS (SELECT *, 'relationship|' || replace(lower(ln), ' ', '_') || '|' || replace(lower(rn), ' ', '_') AS entity_key FROM r2)"""


def _rel(spark, sf):
    ids = I.run(spark, sf, I.identities).select("chapter_id", "ord", "name", F.array("alias").alias("aliases"))
    return O.build_relationship_records(relationships(spark, sf), ids, chapters(spark, sf))


@query("i7_build_relationship_records", f"WITH {_I7} SELECT chapter_id, entity_key, min(ord) AS record_ord, min_by(ln || ' ↔ ' || rn, ord) AS display_name FROM pairs2 GROUP BY 1, 2")
def i7(spark, sf):
    return _rel(spark, sf)["records"]


@query("i7_suspects", f"WITH {_I7} SELECT chapter_id, CASE WHEN why IS NOT NULL THEN why ELSE 'relationship_evidence_not_found_in_chapter' END AS reason, source_name AS subject, target_name AS detail FROM r1 WHERE why IS NOT NULL OR (usable AND p <= 0)")
def i7_suspects(spark, sf):
    return _rel(spark, sf)["suspects"]


_TOKS = "list_filter(string_split({0}, '_'), lambda t: t <> '')"
_SPEC = "len(" + _TOKS + ") * 1000 + length(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g'))"


def _starts(a, b):
    return f"(len({a}) < len({b}) AND {b}[1:len({a})] = {a})"


def _overlap(a, b):
    return f"(len({a}) > 0 AND len({b}) > 0 AND ({a} = {b} OR {_starts(a, b)} OR {_starts(b, a)}))"


# one row per pair, chapter and value in order of arrival; a value goes into the first one of the same edge
_EDGE = "'value': {0}value, 'related': {0}related, 'direction': {0}direction, 'rtype': {0}rtype, 'conf': {0}conf, 'ev': {0}ev, 'rk': {0}rk, 'toks': {0}toks, 'spec': {0}spec, 'tspec': {0}tspec"
_BETTER = "(len(v.toks) > 0 AND (len(x.toks) = 0 OR v.spec > x.spec))"
_TYPED = "(v.rtype <> '' AND (x.rtype = '' OR v.tspec > x.tspec))"
_I8 = f"""e8 AS (SELECT chapter_id, entity_key, ord, pos, value, related, direction, ty AS rtype, confidence AS conf, [{{'p': (p - 1)::BIGINT, 'q': quote}}] AS ev, {Q.akey('related')} AS rk, {Q.fkey('value')} AS vf, {Q.fkey('ty')} AS tf, ord = min(ord) OVER (PARTITION BY chapter_id, entity_key) AS first
 FROM (SELECT *, 0 AS pos, ll AS value, rn AS related, 'self_to_related' AS direction FROM pairs2 UNION ALL SELECT *, 1, rl, ln, 'related_to_self' FROM pairs2)),
v8 AS MATERIALIZED (SELECT *, {_TOKS.format('vf')} AS toks, {_SPEC.format('vf')} AS spec, {_SPEC.format('tf')} AS tspec, row_number() OVER (PARTITION BY chapter_id, entity_key ORDER BY ord, pos) AS rn8 FROM e8),
st8 AS (SELECT chapter_id, entity_key, 1::BIGINT AS rn8, [{{{_EDGE.format('')}}}] AS acc FROM v8 WHERE rn8 = 1
 UNION ALL SELECT chapter_id, entity_key, rn8, CASE WHEN hit = 0 THEN list_append(acc, v) ELSE list_transform(acc, lambda x, n: CASE WHEN n <> hit THEN x ELSE {{'value': CASE WHEN {_BETTER} THEN v.value ELSE x.value END, 'related': x.related, 'direction': x.direction,
  'rtype': CASE WHEN {_TYPED} THEN v.rtype ELSE x.rtype END, 'conf': greatest(x.conf, v.conf), 'ev': list_sort(list_distinct(list_concat(x.ev, v.ev))), 'rk': x.rk, 'toks': CASE WHEN {_BETTER} THEN v.toks ELSE x.toks END,
  'spec': CASE WHEN {_BETTER} THEN v.spec ELSE x.spec END, 'tspec': CASE WHEN {_TYPED} THEN v.tspec ELSE x.tspec END}} END) END
 FROM (SELECT *, CASE WHEN first THEN 0 ELSE coalesce(list_position(list_transform(acc, lambda x: x.rk = v.rk AND x.direction = v.direction AND ((x.rtype <> '' AND x.rtype = v.rtype) OR {_overlap('x.toks', 'v.toks')})), TRUE), 0) END AS hit
  FROM (SELECT st8.chapter_id, st8.entity_key, v8.rn8, acc, first, {{{_EDGE.format('v8.')}}} AS v FROM st8 JOIN v8 ON v8.chapter_id = st8.chapter_id AND v8.entity_key = st8.entity_key AND v8.rn8 = st8.rn8 + 1) y1) y2),
val8 AS (SELECT chapter_id, entity_key, (unnest(range(len(acc))))::BIGINT AS pos, unnest(acc) AS x FROM (SELECT chapter_id, entity_key, arg_max(acc, rn8) AS acc FROM st8 GROUP BY 1, 2)),
values8 AS (SELECT chapter_id, entity_key, pos, x.value AS value, x.related AS related, x.direction AS direction, x.rtype AS rtype, x.conf AS confidence, x.ev AS ev FROM val8)"""


@query("i8_merge_relationship_values", f"WITH RECURSIVE {_I7}, {_I8} SELECT chapter_id, entity_key, pos::INT AS pos, value, related, direction, rtype, confidence, array_to_string(list_transform(ev, lambda e: e.p || '~' || e.q), '|') AS evidence FROM values8")
def i8(spark, sf):
    v = _rel(spark, sf)["values"]
    return v.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat_ws("~", e["start_char"].cast("string"), e["quote"])), "|"))


@query("i9_merge_same_key_records", f"WITH {_CC} SELECT own.chapter_id, own.record_ord, s AS start_char, e AS end_char, min(text) AS text FROM own JOIN men ON men.chapter_id = own.chapter_id AND men.ord = own.ord GROUP BY 1, 2, 3, 4, {Q.key('text')}")
def i9(spark, sf):
    b = O.build_character_records(characters(spark, sf), chapters(spark, sf))
    return O.merge_record_mentions(b["mentions"]).drop("mention_type")


_LAB = "CASE pos % 4 WHEN 0 THEN name WHEN 1 THEN split_part(name, ' ', 1) WHEN 2 THEN name || ' của vua' ELSE '' END"
_LTK = f"list_filter(string_split({Q.fkey('a')}, '_'), lambda t: t <> '')"


def _pre(a, b):
    return f"(len({a}) < len({b}) AND {b}[1:len({a})] = {a})"


@query("i10_label_specificity_overlap", f"""SELECT chapter_id, pos, len(ta) * 1000 + length(regexp_replace({Q.fkey('a')}, '[^A-Za-z0-9]', '', 'g')) AS spec, len(ta) > 0 AND len(tb) > 0 AND (ta = tb OR {_pre('ta', 'tb')} OR {_pre('tb', 'ta')}) AS ovl
FROM (SELECT *, {_LTK} AS ta, {_LTK.replace('(a)', '(b)').replace('lower(a', 'lower(b')} AS tb FROM (SELECT chapter_id, pos, {_LAB} AS a, name AS b FROM {I.duck(I.pairs)}))""")
def i10(spark, sf):
    p = I.run(spark, sf, I.pairs).select("chapter_id", "pos", F.expr(_LAB).alias("a"), F.col("name").alias("b"))
    return p.select("chapter_id", "pos", O.label_specificity(F.col("a")).alias("spec"), O.labels_overlap(F.col("a"), F.col("b")).alias("ovl"))


# alias surfaces of a novel with the chapter they first appear in
_AS = f"SELECT novel_id, replace(lower(name), ' ', '_') AS entity_key, alias AS surface, min(chapter_num) AS first_chapter_num FROM {IDC} GROUP BY 1, 2, 3"
_KNOWN = f"""v AS (SELECT novel_id, entity_key, first_chapter_num, surface, unnest([surface, lower(left(surface, 1)) || substr(surface, 2)]) AS v FROM ({_AS})),
runs AS (SELECT DISTINCT chapter_id, chapter_num, novel_id, unnest(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+')) AS v FROM {CH})"""


def _alias_surfaces(spark, sf):
    i = I.run(spark, sf, I.identities)
    return i.groupBy("novel_id", F.replace(F.lower("name"), F.lit(" "), F.lit("_")).alias("entity_key"), F.col("alias").alias("surface")).agg(F.min("chapter_num").alias("first_chapter_num"))


@query("d11_known_identities_in_text", f"WITH {_KNOWN} SELECT DISTINCT chapter_id, novel_id, entity_key FROM v JOIN runs USING (novel_id, v)")
def d11(spark, sf):
    return known_identities_in_text(chapters(spark, sf).withColumnRenamed("content", "text"), _alias_surfaces(spark, sf))


@query("i11_prior_alias_hints", f"WITH {_KNOWN} SELECT DISTINCT chapter_id, novel_id, entity_key FROM v JOIN runs USING (novel_id, v) WHERE first_chapter_num < chapter_num")
def i11(spark, sf):
    return known_identities_in_text(chapters(spark, sf).withColumnRenamed("content", "text"), _alias_surfaces(spark, sf), prior_only=True)


# one row per pair and record along the chapters of a novel: the hints after that record
_HINT = "'ln': {0}ln, 'rn': {0}rn, 't': {0}t, 'ts': {0}ts, 'f': {0}f, 'ft': {0}ft, 'fs': {0}fs, 'b': {0}b, 'bt': {0}bt, 'bs': {0}bs, 'ch': {0}ch"


def _picked(c):
    better = f"(len(v.{c}t) > 0 AND (len(x.{c}t) = 0 OR v.{c}s > x.{c}s))"
    return ", ".join(f"'{k}': CASE WHEN {better} THEN v.{k} ELSE x.{k} END" for k in (c, c + "t", c + "s"))


_I12 = f"""rc12 AS (SELECT p.chapter_id, c.novel_id, p.entity_key, min_by(ln || ' ↔ ' || rn, ord) AS display FROM pairs2 p JOIN (SELECT chapter_id, novel_id FROM {CH}) c ON c.chapter_id = p.chapter_id GROUP BY 1, 2, 3),
sp12 AS (SELECT *, trim(value) AS l, {_SPEC.format(Q.fkey('value'))} AS vs, {_SPEC.format(Q.fkey('rtype'))} AS ks FROM values8),
sd12 AS (SELECT chapter_id, entity_key, max_by(rtype, (ks, -pos)) AS t, max_by(l, (vs, -pos)) FILTER (direction = 'self_to_related' AND l <> '') AS f, max_by(l, (vs, -pos)) FILTER (direction = 'related_to_self' AND l <> '') AS b FROM sp12 GROUP BY 1, 2),
h12 AS MATERIALIZED (SELECT *, {_SPEC.format(Q.fkey('t'))} AS ts, {_TOKS.format(Q.fkey("coalesce(f, '')"))} AS ft, {_SPEC.format(Q.fkey("coalesce(f, '')"))} AS fs, {_TOKS.format(Q.fkey("coalesce(b, '')"))} AS bt, {_SPEC.format(Q.fkey("coalesce(b, '')"))} AS bs, [chap] AS ch,
 row_number() OVER (PARTITION BY novel_id, lk, rk ORDER BY chap, display, rid) AS n FROM (SELECT novel_id, rc12.chapter_id AS chap, display, rc12.chapter_id || '/' || rc12.entity_key AS rid, split_part(rc12.entity_key, '|', 2) AS lk, split_part(rc12.entity_key, '|', 3) AS rk,
 split_part(display, ' ↔ ', 1) AS ln, split_part(display, ' ↔ ', 2) AS rn, t, f, b FROM rc12 JOIN sd12 ON sd12.chapter_id = rc12.chapter_id AND sd12.entity_key = rc12.entity_key)),
st12 AS (SELECT novel_id, lk, rk, n, [{{{_HINT.format('')}}}] AS acc FROM h12 WHERE n = 1
 UNION ALL SELECT novel_id, lk, rk, n, CASE WHEN hit = 0 THEN list_append(acc, v) ELSE list_transform(acc, lambda x, i: CASE WHEN i <> hit THEN x ELSE {{'ln': x.ln, 'rn': x.rn, 't': CASE WHEN v.ts > x.ts THEN v.t ELSE x.t END, 'ts': greatest(x.ts, v.ts), {_picked('f')}, {_picked('b')}, 'ch': list_sort(list_distinct(list_concat(x.ch, v.ch)))}} END) END
 FROM (SELECT *, coalesce(list_position(list_transform(acc, lambda x: x.t = v.t OR {_overlap('x.ft', 'v.ft')} OR {_overlap('x.bt', 'v.bt')}), TRUE), 0) AS hit
  FROM (SELECT st12.novel_id, st12.lk, st12.rk, h12.n, acc, {{{_HINT.format('h12.')}}} AS v FROM st12 JOIN h12 ON h12.novel_id = st12.novel_id AND h12.lk = st12.lk AND h12.rk = st12.rk AND h12.n = st12.n + 1) z1) z2),
pr12 AS (SELECT DISTINCT novel_id, chapter_num, unnest([replace(lower(name), ' ', '_'), lower(alias)]) AS k FROM {IDC}),
as12 AS (SELECT q.novel_id, q.chapter_num, q.lk, q.rk, count(*) AS n FROM (SELECT DISTINCT p.novel_id, a.chapter_num, lk, rk FROM (SELECT DISTINCT novel_id, lk, rk FROM h12) p JOIN pr12 a ON a.novel_id = p.novel_id AND a.k = lk JOIN pr12 b ON b.novel_id = p.novel_id AND b.k = rk AND b.chapter_num = a.chapter_num) q
 JOIN h12 ON h12.novel_id = q.novel_id AND h12.lk = q.lk AND h12.rk = q.rk AND h12.chap < q.chapter_num GROUP BY 1, 2, 3, 4)"""


@query("i12_known_relationship_context", f"""WITH RECURSIVE {_I7}, {_I8}, {_I12} SELECT scope_id, chapter_num, left_key, right_key, x.ln AS left_name, x.rn AS right_name, x.t AS relationship_type, x.f AS left_to_right, x.b AS right_to_left, array_to_string(x.ch, '|') AS evidence_chapters
FROM (SELECT q.novel_id AS scope_id, q.chapter_num, q.lk AS left_key, q.rk AS right_key, unnest(acc) AS x FROM as12 q JOIN st12 s ON s.novel_id = q.novel_id AND s.lk = q.lk AND s.rk = q.rk AND s.n = q.n)""")
def i12(spark, sf):
    built = _rel(spark, sf)
    ch = chapters(spark, sf).select("chapter_id", "chapter_num", "novel_id")
    rec = built["records"].join(ch, "chapter_id").select(
        F.col("novel_id").alias("scope_id"), F.concat_ws("/", F.col("chapter_id").cast("string"), "entity_key").alias("record_id"), "chapter_num", "entity_key", "display_name")
    val = built["values"].withColumn("record_id", F.concat_ws("/", F.col("chapter_id").cast("string"), "entity_key")).drop("chapter_id", "entity_key")
    present = I.run(spark, sf, I.identities).select(F.col("novel_id").alias("scope_id"), "chapter_num", F.explode(F.array(
        F.replace(F.lower("name"), F.lit(" "), F.lit("_")), F.lower("alias"))).alias("identity_key"))
    return O.known_relationship_context(rec, val, present).withColumn("evidence_chapters", F.array_join(F.col("evidence_chapters").cast("array<string>"), "|"))


@query("i13_run_summary", f"""WITH {_CC}, {_FLD}, {_I7}, sus AS (SELECT chapter_id FROM c0 WHERE nature <> 'person' UNION ALL SELECT chapter_id FROM c1 WHERE (chapter_id, ord) NOT IN (SELECT (chapter_id, ord) FROM men) UNION ALL SELECT chapter_id FROM f1 WHERE NOT okc OR p < 0
 UNION ALL SELECT chapter_id FROM r1 WHERE why IS NOT NULL OR (usable AND p <= 0))
SELECT doc_id AS chapter_id, coalesce(a, 0) AS character_record_count, coalesce(b, 0) AS relationship_record_count, coalesce(s, 0) AS suspect_count, coalesce(n, 0) AS review_count, CASE WHEN coalesce(s, 0) > 0 THEN 'moved_to_review' ELSE 'ok' END AS status
FROM documents LEFT JOIN (SELECT chapter_id AS doc_id, count(*) AS a FROM rec GROUP BY 1) x USING (doc_id) LEFT JOIN (SELECT chapter_id AS doc_id, count(DISTINCT entity_key) AS b FROM pairs2 GROUP BY 1) y USING (doc_id)
LEFT JOIN (SELECT chapter_id AS doc_id, count(*) AS s FROM sus GROUP BY 1) z USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels WHERE quality = 0 GROUP BY 1) l USING (doc_id)""")
def i13(spark, sf):
    b, r = O.build_character_records(characters(spark, sf), chapters(spark, sf)), _rel(spark, sf)
    rec = b["records"].select("chapter_id", F.lit("character").alias("group_key")).unionByName(r["records"].select("chapter_id", F.lit("relationship").alias("group_key")))
    reviews = I.table(spark, sf, "labels").filter("quality = 0").groupBy(F.col("doc_id").alias("chapter_id")).agg(F.count(F.lit(1)).alias("review_count"))
    return O.run_summary(chapters(spark, sf), rec, b["suspects"].unionByName(r["suspects"]), reviews)
