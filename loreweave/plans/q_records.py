"""Queries over records (F), attribute gates (G), staged relationships (H) and the alias map (J)."""
from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.functions import keys as K
from loreweave.functions import vocab as V
from loreweave.operators import aliases as J
from loreweave.operators import gates as G
from loreweave.operators import records as R
from loreweave.operators import relations as H
from loreweave.plans import inputs as I
from loreweave.plans import sqlkit as Q
from loreweave.plans.q_identity import _AT, _case
from loreweave.plans.registry import query

RV, RC, CR, CV = I.duck(I.rec_values), I.duck(I.recs), I.duck(I.char_recs), I.duck(I.char_values)
IDC = I.duck(I.identities)
_P = I.duck(I.pairs)


def values(spark, sf):
    ev = F.struct(*[F.col(f"e_{a}").cast(t).alias(b) for a, b, t in (
        ("chapter", "chapter_num", "bigint"), ("start", "start_char", "bigint"), ("end", "end_char", "bigint"), ("quote", "quote", "string"), ("reason", "reason", "string"))])
    return I.run(spark, sf, I.rec_values).withColumn("evidence", F.array(ev)).drop("e_chapter", "e_start", "e_end", "e_quote", "e_reason")


def char_values(spark, sf):
    ev = F.struct(F.col("chapter_num").cast("bigint").alias("chapter_num"), F.lit(None).cast("bigint").alias("start_char"), F.lit(None).cast("bigint").alias("end_char"),
                  F.col("quote").alias("quote"), F.lit("r").alias("reason"))
    return I.run(spark, sf, I.char_values).withColumn("evidence", F.when(F.col("quote").isNotNull(), F.array(ev)).otherwise(R.no_evidence())).drop("quote")


def char_recs(spark, sf):
    return I.run(spark, sf, I.char_recs)


def identities(spark, sf):
    return I.run(spark, sf, I.identities).select("chapter_id", F.col("name").alias("identity_id"), "name", F.array("alias").alias("aliases"), "ord")


@query("f1_identity_to_record", f"""SELECT chapter_id, display_name, entity_key, value_text, quotes FROM (SELECT chapter_id, name AS display_name, replace(lower(name), ' ', '_') AS entity_key, alias AS value_text, CASE WHEN ord % 2 = 0 THEN name ELSE '' END AS quotes FROM {IDC} WHERE ord % 3 <> 0)""")
def f1(spark, sf):
    i = I.run(spark, sf, I.identities)
    ev = F.struct((F.col("chapter_num") + F.col("ord") % 2).alias("chapter_num"), F.lit(None).cast("bigint").alias("start_char"), F.lit(None).cast("bigint").alias("end_char"), F.col("name").alias("quote"), F.lit("r").alias("reason"))
    aliases = i.select("chapter_id", "name", "ord", F.col("alias").alias("text"), F.when(F.col("ord") % 3 == 0, "pronoun").otherwise("alias").alias("alias_type"), F.array(ev).alias("evidence"))
    rec, val = R.identity_to_record(i.select("chapter_id", "ord", "name", "chapter_num"), aliases)
    return rec.join(val, ["chapter_id", "display_name"]).select("chapter_id", "display_name", "entity_key", "value_text", F.array_join(F.transform("evidence", lambda e: e["quote"]), "|").alias("quotes"))




@query("f9_aliases_of_records", f"""SELECT record_id, batch, value_text AS text, CASE field_key WHEN 'nickname' THEN 'nickname' ELSE 'other_alias' END AS alias_type,
 CASE WHEN field_label <> '' THEN field_label WHEN field_key = 'nickname' THEN 'Biệt danh' ELSE 'Tên gọi khác' END AS alias_label, coalesce(confidence, 0) >= 1 AS is_primary FROM {RV} WHERE field_key IN ('other_alias', 'nickname')""")
def f9(spark, sf):
    return R.record_aliases(values(spark, sf)).select("record_id", "batch", "text", "alias_type", "alias_label", "is_primary")


@query("f9_aliases_of_records_parity", f"""SELECT record_id, batch, value_text AS text, CASE field_key WHEN 'nickname' THEN 'nickname' ELSE 'other_alias' END AS alias_type FROM {RV} WHERE field_key <> 'relationship'""")
def f9p(spark, sf):
    return R.record_aliases(values(spark, sf), parity=True).select("record_id", "batch", "text", "alias_type")


# records named by single words against identities named by word pairs with that word as an alias
_SURF = f"""SELECT chapter_id, record_id, ord, {Q.key('display_name')} AS k, TRUE AS own FROM {CR} UNION ALL SELECT v.chapter_id, v.record_id, r.ord, {Q.key('value_text')}, FALSE FROM {CV} v JOIN {CR} r USING (record_id) WHERE field_key <> 'appearance'"""
_F2IDS = f"SELECT chapter_id, name AS identity_id, CASE WHEN ord % 4 = 3 THEN 'Zq ' || name ELSE name END AS name, CASE WHEN ord % 4 = 3 THEN 'Zq' || alias ELSE alias END AS alias, ord FROM {IDC} UNION ALL SELECT chapter_id, name || '!', split_part(name, ' ', 2), upper(name), ord + 1000000 FROM {IDC}"
_MATCH = f"""sf AS ({_SURF}), idn AS ({_F2IDS}), mt AS (SELECT chapter_id, identity_id, min_by(record_id, (prio, o, record_id)) AS record_id, min(prio) AS prio FROM (
 SELECT idn.chapter_id, identity_id, CASE WHEN own AND sf.k = {Q.key('name')} THEN 0 ELSE 1 END AS prio, sf.ord AS o, record_id FROM idn JOIN sf ON idn.chapter_id = sf.chapter_id AND (sf.k = {Q.key('name')} OR sf.k = {Q.key('alias')})) GROUP BY 1, 2)"""


def _f2_ids(spark, sf):
    i = I.run(spark, sf, I.identities)
    # every fourth identity has other names, so that it meets no record
    a = i.select(
        "chapter_id", F.col("name").alias("identity_id"), F.expr("CASE WHEN ord % 4 = 3 THEN 'Zq ' || name ELSE name END").alias("name"),
        F.expr("array(CASE WHEN ord % 4 = 3 THEN 'Zq' || alias ELSE alias END)").alias("aliases"), "ord")
    b = i.select("chapter_id", F.concat("name", F.lit("!")).alias("identity_id"), F.split_part("name", F.lit(" "), F.lit(2)).alias("name"), F.array(F.upper("name")).alias("aliases"), (F.col("ord") + 1000000).alias("ord"))
    return a.unionByName(b)


@query("f2_merge_identity_records", f"""WITH {_MATCH}, rn AS (SELECT chapter_id, record_id, max_by(name, ord) AS nm FROM mt JOIN idn USING (chapter_id, identity_id) GROUP BY 1, 2)
SELECT chapter_id, record_id, coalesce(nm, display_name) AS display_name, CASE WHEN nm IS NULL THEN entity_key ELSE {Q.akey('nm')} END AS entity_key, FALSE AS is_new FROM {CR} LEFT JOIN rn USING (chapter_id, record_id)
UNION ALL SELECT chapter_id, identity_id, name, {Q.akey('name')}, TRUE FROM idn WHERE (chapter_id, identity_id) NOT IN (SELECT (chapter_id, identity_id) FROM mt)""")
def f2(spark, sf):
    return R.merge_identity_records(char_recs(spark, sf), char_values(spark, sf), _f2_ids(spark, sf)).drop("ord")


@query("f12_ensure_record", f"WITH {_MATCH} SELECT chapter_id, identity_id, coalesce(record_id, identity_id) AS record_id, record_id IS NULL AS is_new FROM idn LEFT JOIN mt USING (chapter_id, identity_id)")
def f12(spark, sf):
    return R.ensure_record(char_recs(spark, sf), char_values(spark, sf), _f2_ids(spark, sf))


@query("f3_dedupe_records", f"""WITH RECURSIVE sf AS ({_SURF}), lnk AS (SELECT DISTINCT a.chapter_id, a.ord AS x, b.ord AS y FROM sf a JOIN sf b ON a.chapter_id = b.chapter_id AND a.k = b.k),
reach AS (SELECT chapter_id, ord AS x, ord AS y FROM {CR} UNION SELECT r.chapter_id, r.x, l.y FROM reach r JOIN lnk l ON l.chapter_id = r.chapter_id AND l.x = r.y),
lab AS (SELECT chapter_id, x, min(y) AS m FROM reach GROUP BY 1, 2)
SELECT r.chapter_id, r.record_id, t.record_id AS target_id FROM {CR} r JOIN lab ON lab.chapter_id = r.chapter_id AND lab.x = r.ord JOIN {CR} t ON t.chapter_id = r.chapter_id AND t.ord = lab.m""")
def f3(spark, sf):
    return R.dedupe_records(char_recs(spark, sf), char_values(spark, sf))


_MEN = f"SELECT chapter_id, CAST(chapter_id AS STRING) || ':' || substring(name, 1, 1) AS record_id, CASE WHEN pos % 2 = 0 THEN name ELSE ' ' || name || ' ' END AS text, CAST(pos % 7 AS BIGINT) AS start_char, CAST(pos % 7 + length(name) AS BIGINT) AS end_char, pos AS arrival FROM {{}}"


def _mentions(spark, sf):
    I.run(spark, sf, I.pairs).createOrReplaceTempView("lw_pairs")
    return spark.sql(_MEN.format("lw_pairs"))


@query("f4_merge_mentions", f"SELECT record_id, start_char, end_char, min_by(text, arrival) AS text FROM ({_MEN.format(_P)}) GROUP BY record_id, start_char, end_char, trim(text)")
def f4(spark, sf):
    return R.merge_mentions(_mentions(spark, sf)).drop("chapter_id", "arrival")


_VALKEY = "concat_ws(':', " + ", ".join(Q.key(f"coalesce({c}, '')") for c in ("value_text", *R.META)) + ")"
_META_ON = " OR ".join(f"coalesce(trim({c}), '') <> ''" for c in R.META)
_F5 = f"""v0 AS (SELECT *, {Q.akey('field_key')} AS f, {Q.key('value_text')} AS vk, {_VALKEY} AS fk, NOT ({_META_ON}) AND ({Q.akey('field_key')}) <> 'relationship' AS plain,
 ({Q.akey('field_key')}) <> 'relationship' AS listed FROM {RV}),
v1 AS (SELECT x.*, plain AND (vk = '' OR coalesce((SELECT arg_min(y.f, y.batch) FROM v0 y WHERE y.record_id = x.record_id AND y.vk = x.vk AND y.listed AND y.batch <= x.batch) <> f, FALSE)) AS leaves FROM v0 x),
v2 AS (SELECT *, min(batch) FILTER (NOT leaves) OVER (PARTITION BY record_id, f) AS created FROM v1),
v3 AS (SELECT *, created IS NULL OR batch <= created AS isnew FROM v2),
v4 AS (SELECT *, isnew AND leaves AS folds FROM v3 WHERE NOT (isnew AND plain AND vk = '')),
v5 AS (SELECT x.*, CASE WHEN folds THEN (SELECT arg_min(y.batch, (y.created, y.batch)) FROM v4 y WHERE y.record_id = x.record_id AND y.vk = x.vk AND y.listed AND NOT y.folds AND y.batch < x.batch)
 WHEN isnew THEN batch ELSE coalesce((SELECT max(y.batch) FROM v4 y WHERE y.record_id = x.record_id AND y.f = x.f AND y.fk = x.fk AND NOT y.folds AND y.isnew), (SELECT min(y.batch) FROM v4 y WHERE y.record_id = x.record_id AND y.f = x.f AND y.fk = x.fk AND NOT y.folds AND NOT y.isnew)) END AS anchor FROM v4 x),
v6 AS (SELECT x.*, coalesce(o.anchor, x.anchor) AS fin FROM v5 x LEFT JOIN v5 o ON o.record_id = x.record_id AND o.batch = x.anchor AND NOT o.folds)"""


def _flat_ev(c="evidence"):
    return F.array_join(F.transform(c, lambda e: F.concat_ws("~", F.coalesce(e["start_char"].cast("string"), F.lit("-1")), e["quote"])), "|")


_EV = "string_agg(DISTINCT coalesce(e_start::VARCHAR, '-1') || '~' || e_quote, '|' ORDER BY coalesce(e_start::VARCHAR, '-1') || '~' || e_quote)"


@query("f5_merge_fields", f"""WITH {_F5} SELECT record_id, fin AS batch, min_by(f, (batch <> fin, batch)) AS field_key, min_by(value_text, (batch <> fin, batch)) AS value_text, min_by(confidence, batch) FILTER (confidence IS NOT NULL) AS confidence,
 min_by(related_character, batch) FILTER (related_character IS NOT NULL) AS related_character, min_by(relationship_type, batch) FILTER (relationship_type IS NOT NULL) AS relationship_type, {_EV} AS evidence FROM v6 GROUP BY 1, 2""")
def f5(spark, sf):
    m = R.merge_fields(values(spark, sf))
    return m.select("record_id", "batch", "field_key", "value_text", "confidence", "related_character", "relationship_type", _flat_ev(F.array_sort("evidence", _by_text)).alias("evidence"))


def _by_text(x, y):
    a, b = (F.concat_ws("~", F.coalesce(e["start_char"].cast("string"), F.lit("-1")), e["quote"]) for e in (x, y))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


@query("f6_merge_values", f"""SELECT record_id, field_key, min_by(value_text, batch) AS value_text, min_by(confidence, batch) FILTER (confidence IS NOT NULL) AS confidence,
 min_by(relationship_label, batch) FILTER (relationship_label IS NOT NULL) AS relationship_label, {_EV} AS evidence FROM (SELECT * EXCLUDE (field_key), {Q.akey('field_key')} AS field_key, {_VALKEY} AS fk FROM {RV}) GROUP BY record_id, field_key, fk""")
def f6(spark, sf):
    m = R.merge_values(values(spark, sf))
    return m.select("record_id", "field_key", "value_text", "confidence", "relationship_label", _flat_ev(F.array_sort("evidence", _by_text)).alias("evidence"))


@query("f7_working_identities", f"""WITH sf AS ({_SURF}), ids AS (SELECT chapter_id, CASE WHEN ord % 2 = 0 THEN name ELSE 'Zq ' || name END AS name, CASE WHEN ord % 2 = 0 THEN alias ELSE 'Zq' || alias END AS alias FROM {IDC}),
hit AS (SELECT DISTINCT record_id FROM sf JOIN ids i ON i.chapter_id = sf.chapter_id AND (sf.k = {Q.key('name')} OR sf.k = {Q.key('alias')}))
SELECT chapter_id, name, alias AS aliases, FALSE AS from_record FROM ids
UNION ALL SELECT r.chapter_id, display_name, coalesce((SELECT string_agg(value_text, '|' ORDER BY pos) FROM {CV} v WHERE v.record_id = r.record_id AND field_key <> 'appearance'), ''), TRUE FROM {CR} r WHERE ord % 5 <> 0 AND record_id NOT IN (SELECT record_id FROM hit)""")
def f7(spark, sf):
    rec, val = char_recs(spark, sf), char_values(spark, sf).withColumn("batch", F.lit(0))
    men = rec.select("chapter_id", F.expr("CASE WHEN ord % 5 <> 0 THEN record_id ELSE record_id || '?' END").alias("record_id"))
    ids = identities(spark, sf).withColumn("name", F.expr("CASE WHEN ord % 2 = 0 THEN name ELSE 'Zq ' || name END")).withColumn(
        "aliases", F.expr("transform(aliases, a -> CASE WHEN ord % 2 = 0 THEN a ELSE 'Zq' || a END)"))
    return R.working_identities(ids, rec, val, men).withColumn("aliases", F.array_join("aliases", "|"))


@query("f8_hydrate_aliases", f"""SELECT chapter_id, name, min_by(text, ord) AS text FROM (SELECT r.chapter_id, r.display_name AS name, v.value_text AS text, v.ord, {_case(Q.akey('v.field_key'), V.ALIAS_TYPES, "'other_alias'")} AS t
 FROM {CR} r JOIN (SELECT *, record_id || ':' || pos AS ord FROM {CV}) v ON r.novel_id = v.novel_id AND {Q.key('r.display_name')} = {Q.key('v.display_name')})
 WHERE {Q.key('text')} <> {Q.key('name')} AND length(text) BETWEEN 2 AND 64 AND t IN ('nickname', 'other_alias') AND NOT contains({Q.fkey('text')}, {Q.fkey('name')}) AND {Q.ups('text')} > 0 GROUP BY chapter_id, name, {Q.key('text')}""")
def f8(spark, sf):
    amap = char_values(spark, sf).select(
        "novel_id", "display_name", F.concat_ws(":", "record_id", F.col("pos").cast("string")).alias("ord"), F.col("value_text").alias("alias_text"), F.col("field_key").alias("alias_type"),
        F.col("field_label").alias("alias_label"), "confidence", F.transform("evidence", lambda e: e["quote"]).alias("quotes"))
    ids = char_recs(spark, sf).select("chapter_id", "novel_id", F.col("display_name").alias("name"))
    return R.hydrate_aliases(ids, amap, ["chapter_id"]).select("chapter_id", "name", "text")


_HEAD = "SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'old' ELSE 'story_character_extraction.v1' END AS schema_version, CASE WHEN doc_id % 31 = 3 THEN doc_id + 1 ELSE doc_id END AS chapter_num, doc_id AS expected_chapter_num, length(text) AS chapter_length FROM documents"
_F10 = f"""WITH head AS ({_HEAD}), bad AS (
SELECT doc_id, unnest(list_filter([CASE WHEN schema_version <> 'story_character_extraction.v1' THEN 'schema_version' END, CASE WHEN chapter_num <> expected_chapter_num THEN 'chapter_num' END], lambda x: x IS NOT NULL)) AS rule, 'document' AS path FROM head
UNION ALL SELECT chapter_id, unnest(list_filter([CASE WHEN ord % 17 = 3 THEN 'group_key' END, CASE WHEN ord % 19 = 3 THEN 'group_label' END, CASE WHEN ord % 23 = 3 THEN 'display_name' END], lambda x: x IS NOT NULL)), record_id FROM {RC}
UNION ALL SELECT chapter_id, unnest(list_filter([CASE WHEN pos % 29 = 3 THEN 'mention_text' END, CASE WHEN e_start - 20 < 0 OR e_end + 100 > chapter_length THEN 'mention_span' END], lambda x: x IS NOT NULL)), record_id || '/' || (e_start - 20) FROM (SELECT *, batch AS pos FROM (SELECT * EXCLUDE (pos) FROM {RV})) m JOIN head ON head.doc_id = m.chapter_id WHERE e_start IS NOT NULL
UNION ALL SELECT chapter_id, unnest(list_filter([CASE WHEN trim(field_label) = '' THEN 'field_label' END,
  CASE WHEN field_key = 'relationship' AND (relationship_type IS NULL OR relationship_direction NOT IN ('self_to_related')) THEN 'relationship_value' END, CASE WHEN confidence * 1.25 > 1 THEN 'confidence' END,
  CASE WHEN e_chapter <> expected_chapter_num THEN 'evidence_chapter' END, CASE WHEN e_start IS NOT NULL AND e_end > chapter_length - 50 THEN 'evidence_span' END], lambda x: x IS NOT NULL)), record_id || '/' || field_key || '/' || batch FROM (SELECT * FROM {RV}) v JOIN (SELECT * EXCLUDE (chapter_num) FROM head) h ON h.doc_id = v.chapter_id)
SELECT doc_id, rule, path FROM bad"""


@query("f10_validate_documents", _F10)
def f10(spark, sf):
    I.table(spark, sf, "documents").createOrReplaceTempView("documents")
    head = spark.sql(_HEAD)
    o = F.col("ord")
    rec = I.run(spark, sf, I.recs).select(
        F.col("chapter_id").alias("doc_id"), "record_id", F.when(o % 17 == 3, "place").otherwise("character").alias("group_key"), F.when(o % 19 == 3, " ").otherwise("x").alias("group_label"),
        F.when(o % 23 == 3, "").otherwise("x").alias("display_name"))
    v = values(spark, sf).withColumnRenamed("chapter_id", "doc_id").drop("chapter_num", "novel_id")
    e = F.get("evidence", F.lit(0))
    men = v.filter(e["start_char"].isNotNull()).select(
        "doc_id", "record_id", F.when(F.col("batch") % 29 == 3, " ").otherwise("x").alias("text"), (e["start_char"] - 20).alias("start_char"), (e["end_char"] + 100).alias("end_char"))
    # spans closer than 50 characters to the end count as outside
    ev = F.transform("evidence", lambda x: F.struct(x["chapter_num"].alias("chapter_num"), x["start_char"].alias("start_char"), (x["end_char"] + 50).alias("end_char"), x["quote"].alias("quote"), x["reason"].alias("reason")))
    val = v.withColumn("evidence", ev).withColumn("confidence", F.col("confidence") * 1.25)
    return R.validate_documents(head, rec, men, val)


@query("f11_normalize_field_keys", f"SELECT record_id, batch, {Q.akey('field_key')} AS field_key FROM {RV}")
def f11(spark, sf):
    return R.normalize_field_keys(values(spark, sf)).select("record_id", "batch", "field_key")


# --- G ---------------------------------------------------------------------------------------
_GV = """SELECT chapter_id, CAST(chapter_id AS STRING) || ':' || split_part(name, ' ', 1) AS identity_id, pos AS value_id, CASE WHEN pos % 9 = 8 THEN 'habit' ELSE 'Appearance' END AS field_key,
 CASE pos % 6 WHEN 0 THEN ' ' || split_part(name, ' ', 2) WHEN 1 THEN split_part(name, ' ', 1) WHEN 2 THEN name WHEN 3 THEN split_part(name, ' ', 2) || ' of the old' WHEN 4 THEN ' ' ELSE name || ' red eye' END AS value_text,
 CASE WHEN pos % 8 = 7 THEN 0.5 WHEN pos % 8 = 5 THEN NULL ELSE 0.9 END AS confidence, chapter_num, CASE pos % 5 WHEN 4 THEN ' ' WHEN 3 THEN 'a ' || name || ' red' ELSE '[[' || name || ']] was of the old' END AS quote FROM {}"""


def _gate_values(spark, sf):
    I.run(spark, sf, I.pairs).createOrReplaceTempView("lw_pairs")
    return spark.sql(_GV.format("lw_pairs")).withColumn("quotes", F.array("quote")).drop("quote")


def _gate_keys(spark, sf):
    r = char_recs(spark, sf)
    own = r.select(F.col("record_id").alias("identity_id"), K.text_key(F.col("display_name")).alias("skey"))
    # only every third name is that of another character
    other = I.run(spark, sf, I.pairs).select(
        F.concat_ws(":", F.col("chapter_id").cast("string"), F.split_part("name", F.lit(" "), F.lit(1))).alias("identity_id"),
        K.text_key(F.expr("CASE WHEN pos % 3 = 2 THEN name ELSE 'Zq ' || name END")).alias("skey"))
    return own, other


def _gtok(x):
    return f"list_distinct(list_filter(string_split({Q.fkey(x)}, '_'), lambda t: length(t) >= 2))"


_GRD = f"len({_gtok('value_text')}) > 0 AND CASE WHEN len({_gtok('value_text')}) <= 2 THEN len(list_intersect({_gtok('value_text')}, {_gtok('quote')})) = len({_gtok('value_text')}) ELSE len(list_intersect({_gtok('value_text')}, {_gtok('quote')})) * 5 >= len({_gtok('value_text')}) * 3 END"
_G1 = f"""g AS (SELECT * EXCLUDE (value_text), trim(value_text) AS value_text FROM ({_GV.format(_P)})),
oth AS (SELECT DISTINCT CAST(chapter_id AS STRING) || ':' || split_part(name, ' ', 1) AS identity_id, {Q.key("CASE WHEN pos % 3 = 2 THEN name ELSE 'Zq ' || name END")} AS k FROM {_P}),
g1 AS (SELECT g.*, CASE WHEN field_key = 'habit' THEN 'field_not_kept' WHEN value_text = '' THEN 'value_blank' WHEN {Q.key('value_text')} = {Q.key("split_part(g.identity_id, ':', 2)")} THEN 'value_is_own_name'
 WHEN oth.k IS NOT NULL THEN 'value_is_other_name' WHEN trim(quote) = '' THEN 'no_quote' WHEN NOT (contains(quote, '[[') AND contains(quote, ']]')) THEN 'no_marker' WHEN coalesce(confidence, -1) < 0.85 THEN 'low_confidence'
 WHEN NOT ({_GRD}) THEN 'not_grounded' END AS reason FROM g LEFT JOIN oth ON oth.identity_id = g.identity_id AND oth.k = {Q.key('value_text')})"""


@query("g1_gate_field_values", f"WITH {_G1} SELECT identity_id, value_id, coalesce(reason, 'kept') AS outcome, CASE WHEN reason IS NULL THEN replace(replace(quote, '[[', ''), ']]', '') END AS quote FROM g1")
def g1(spark, sf):
    kept, bad = G.gate_field_values(_gate_values(spark, sf), *_gate_keys(spark, sf))
    return kept.select("identity_id", "value_id", F.lit("kept").alias("outcome"), F.get("quotes", F.lit(0)).alias("quote")).unionByName(
        bad.select("identity_id", "value_id", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("quote")))


@query("g2_value_grounded", f"SELECT identity_id, value_id, {_GRD} AS grounded FROM ({_GV.format(_P)})")
def g2(spark, sf):
    return _gate_values(spark, sf).select("identity_id", "value_id", G.value_grounded(F.col("value_text"), F.col("quotes")).alias("grounded"))


_GDEC = """SELECT identity_id, value_id, value_id % 3 <> 0 AS accepted, CASE WHEN value_id % 4 = 3 THEN 0.8 ELSE 0.86 END AS confidence, CASE WHEN value_id % 5 = 4 THEN 'mood' ELSE 'Physical appearance' END AS semantic_class,
 CASE value_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN value_text ELSE 'x' END AS owner_name FROM {} WHERE value_id % 11 <> 10"""


@query("g3_apply_field_decisions", f"""SELECT v.identity_id, v.value_id, coalesce(accepted AND d.confidence >= 0.85 AND semantic_class <> 'mood' AND (owner_name IS NULL OR trim(owner_name) = '' OR {Q.key('owner_name')} = {Q.key("split_part(v.identity_id, ':', 2)")}), FALSE) AS accepted
FROM ({_GV.format(_P)}) v LEFT JOIN ({_GDEC.format('(' + _GV.format(_P) + ')')}) d ON v.identity_id = d.identity_id AND v.value_id = d.value_id""")
def g3(spark, sf):
    v = _gate_values(spark, sf)
    v.createOrReplaceTempView("lw_gate_values")
    return G.apply_field_decisions(v, spark.sql(_GDEC.format("lw_gate_values")), _gate_keys(spark, sf)[0])[1]


# --- H ---------------------------------------------------------------------------------------
_HID = f"SELECT chapter_id, ord AS idx, name, alias FROM {IDC}"
_HC = """SELECT chapter_id, pos AS cand_id, CASE WHEN pos % 2 = 0 THEN name ELSE split_part(name, ' ', 1) END AS source_name, next_name AS target_name, CASE WHEN pos % 9 = 8 THEN 'event' ELSE 'Relation' END AS kind,
 CASE WHEN pos % 3 = 0 THEN ' ' ELSE 'Old Friend' END AS rel_type, ' friend of ' || CAST(pos % 2 AS STRING) AS forward, CASE WHEN pos % 4 = 0 THEN '' ELSE 'mate ' END AS backward, CASE WHEN pos % 7 = 6 THEN 0.5 WHEN pos % 7 = 5 THEN NULL ELSE 0.8 END AS confidence,
 CASE WHEN pos % 6 = 5 THEN name || ' zz' WHEN pos % 6 = 4 THEN replace(name, ' ', '  ') ELSE ' ' || name END AS quote FROM (SELECT *, lead(name) OVER (PARTITION BY chapter_id ORDER BY pos) AS next_name FROM {}) _n WHERE next_name IS NOT NULL"""


def _h_identities(spark, sf):
    return I.run(spark, sf, I.identities).select("chapter_id", F.col("ord").alias("idx"), "name", F.array("alias").alias("aliases"))


def _h_candidates(spark, sf):
    I.run(spark, sf, I.pairs).createOrReplaceTempView("lw_pairs")
    return spark.sql(_HC.format("lw_pairs")).withColumn("quotes", F.array("quote")).drop("quote")


_H2 = f"""hid AS ({_HID}), uq AS (SELECT chapter_id, k, min(idx) AS idx FROM (SELECT DISTINCT chapter_id, idx, unnest([{Q.key('name')}, {Q.key('alias')}]) AS k FROM hid) GROUP BY 1, 2 HAVING count(*) = 1),
hc AS ({_HC.format(_P)}), h2 AS (SELECT hc.*, a.idx AS si, b.idx AS ti, CASE WHEN kind = 'event' THEN 'relationship_candidate_not_stable' WHEN coalesce(confidence, 0) < 0.78 THEN 'relationship_candidate_low_confidence'
 WHEN a.idx IS NULL THEN 'relationship_source_not_resolved' WHEN b.idx IS NULL THEN 'relationship_target_not_resolved' WHEN a.idx = b.idx THEN 'relationship_self_reference_skipped'
 WHEN NOT (contains(text, trim(quote)) OR contains({Q.squeeze('text')}, {Q.squeeze('quote')})) THEN 'relationship_candidate_not_grounded' END AS code
 FROM hc LEFT JOIN uq a ON a.chapter_id = hc.chapter_id AND a.k = {Q.key('source_name')} LEFT JOIN uq b ON b.chapter_id = hc.chapter_id AND b.k = {Q.key('target_name')} JOIN documents d ON d.doc_id = hc.chapter_id)"""
_H4 = """h4 AS (SELECT chapter_id, cand_id, confidence, least(si, ti) AS left_idx, greatest(si, ti) AS right_idx, CASE WHEN trim(rel_type) = '' THEN replace(trim(forward), ' ', '_') ELSE 'old_friend' END AS rel_type,
 CASE WHEN si > ti THEN bk ELSE fw END AS left_label, CASE WHEN si > ti THEN fw ELSE bk END AS right_label, trim(quote) AS quote FROM (SELECT *, trim(forward) AS fw, CASE WHEN trim(backward) = '' THEN trim(forward) ELSE trim(backward) END AS bk FROM h2 WHERE code IS NULL))"""
_H5 = f"h5 AS (SELECT * FROM h4 QUALIFY row_number() OVER (PARTITION BY chapter_id, left_idx, right_idx, rel_type, {Q.key('left_label')}, {Q.key('right_label')} ORDER BY cand_id) = 1)"


@query("h1_relationship_identities", f"""WITH r AS (SELECT *, replace(lower(display_name), ' ', '_') AS k FROM {CR} WHERE ord % 5 <> 0), n AS (SELECT chapter_id FROM r GROUP BY 1 HAVING count(DISTINCT k) >= 2)
SELECT chapter_id, k AS entity_key, record_id, display_name FROM r WHERE chapter_id IN (SELECT chapter_id FROM n)""")
def h1(spark, sf):
    r = char_recs(spark, sf).withColumn("group_key", F.lit("character")).drop("entity_key")
    named = r.withColumn("record_id", F.expr("CASE WHEN ord % 5 <> 0 THEN record_id ELSE record_id || '?' END"))
    return H.relationship_identities(r, named).drop("ord")


def _resolved(spark, sf):
    chapters = I.run(spark, sf, I.chapters).select("chapter_id", "content")
    return H.resolve_relationship_candidates(_h_candidates(spark, sf), _h_identities(spark, sf), chapters)


@query("h2_resolve_relationship_candidates", f"WITH {_H2} SELECT chapter_id, cand_id, CASE WHEN code IS NULL THEN si END AS source_idx, CASE WHEN code IS NULL THEN ti END AS target_idx, code FROM h2")
def h2(spark, sf):
    ok, bad = _resolved(spark, sf)
    none = F.lit(None).cast("bigint")
    return ok.select("chapter_id", "cand_id", "source_idx", "target_idx", F.lit(None).cast("string").alias("code")).unionByName(
        bad.select("chapter_id", "cand_id", none.alias("source_idx"), none.alias("target_idx"), "code"))


@query("h3_quote_in_text", f"SELECT chapter_id, cand_id, contains(text, trim(quote)) OR contains({Q.squeeze('text')}, {Q.squeeze('quote')}) AS found FROM ({_HC.format(_P)}) hc JOIN documents d ON d.doc_id = hc.chapter_id")
def h3(spark, sf):
    q = _h_candidates(spark, sf).select("chapter_id", "cand_id", F.get("quotes", F.lit(0)).alias("quote"))
    return H.quotes_in_texts(q, I.run(spark, sf, I.chapters)).select("chapter_id", "cand_id", "found")


@query("h4_canonicalize_pairs", f"WITH {_H2}, {_H4} SELECT chapter_id, cand_id, left_idx, right_idx, rel_type, left_label, right_label, quote FROM h4")
def h4(spark, sf):
    return H.canonicalize_pairs(_resolved(spark, sf)[0]).select("chapter_id", "cand_id", "left_idx", "right_idx", "rel_type", "left_label", "right_label", F.array_join("quotes", "|").alias("quote"))


def _deduped(spark, sf):
    return H.dedupe_pair_relationships(H.canonicalize_pairs(_resolved(spark, sf)[0]))


@query("h5_dedupe_pair_relationships", f"WITH {_H2}, {_H4}, {_H5} SELECT chapter_id, cand_id, left_idx, right_idx, rel_type, left_label, right_label FROM h5")
def h5(spark, sf):
    return _deduped(spark, sf).drop("confidence", "quotes")


_HDEC = "SELECT chapter_id, cand_id, cand_id % 3 <> 0 AS accepted, cand_id % 5 <> 0 AS owner_direction_ok, CASE WHEN cand_id % 4 = 3 THEN 0.8 ELSE 0.9 END AS confidence, CASE WHEN cand_id % 7 = 6 THEN 'event' ELSE 'Kinship' END AS rel_scope FROM {} WHERE cand_id % 11 <> 10"


def _kept(spark, sf):
    p = _deduped(spark, sf)
    c = _h_candidates(spark, sf)
    c.createOrReplaceTempView("lw_h_candidates")
    return H.apply_relationship_decisions(p, spark.sql(_HDEC.format("lw_h_candidates")))


_H6 = f"h6 AS (SELECT h5.*, coalesce(accepted AND owner_direction_ok AND d.confidence >= 0.85 AND rel_scope = 'Kinship', FALSE) AS okd FROM h5 LEFT JOIN ({_HDEC.format('hc')}) d ON d.chapter_id = h5.chapter_id AND d.cand_id = h5.cand_id)"


@query("h6_apply_relationship_decisions", f"WITH {_H2}, {_H4}, {_H5}, {_H6} SELECT chapter_id, cand_id, okd AS accepted FROM h6")
def h6(spark, sf):
    return _kept(spark, sf)[1]


@query("h7_pairs_to_records", f"""WITH {_H2}, {_H4}, {_H5}, {_H6}, n AS (SELECT h6.*, a.name AS an, b.name AS bn FROM h6 JOIN hid a ON a.chapter_id = h6.chapter_id AND a.idx = left_idx JOIN hid b ON b.chapter_id = h6.chapter_id AND b.idx = right_idx WHERE okd),
k AS (SELECT *, 'relationship|' || replace(lower(an), ' ', '_') || '|' || replace(lower(bn), ' ', '_') AS entity_key, an || ' ↔ ' || bn AS display_name FROM n)
SELECT chapter_id, entity_key, display_name, cand_id, 0 AS pos, left_label AS value_text, bn AS related_character, rel_type AS relationship_type, 'self_to_related' AS relationship_direction FROM k
UNION ALL SELECT chapter_id, entity_key, display_name, cand_id, 1, right_label, an, rel_type, 'self_to_related' FROM k""")
def h7(spark, sf):
    rec, val = H.pairs_to_records(_kept(spark, sf)[0], _h_identities(spark, sf))
    return val.join(rec.select("chapter_id", "entity_key", "display_name"), ["chapter_id", "entity_key"]).select(
        "chapter_id", "entity_key", "display_name", "cand_id", "pos", "value_text", "related_character", "relationship_type", "relationship_direction")


# --- J ---------------------------------------------------------------------------------------
_ST = _case(Q.fkey("field_key"), V.STORED_ALIAS_TYPES, Q.fkey("field_key"))
_J1 = f"""r AS (SELECT novel_id, record_id, chapter_num, display_name, CASE WHEN trim(entity_key) = '' THEN {Q.fkey('display_name')} ELSE entity_key END AS entity_key FROM {CR}),
j0 AS (SELECT novel_id, record_id, chapter_num, display_name, entity_key, display_name AS alias_text, 'canonical_name' AS alias_type, 'Tên chính' AS alias_label, 1.0::DOUBLE AS confidence, '' AS fk, -1 AS pos, NULL AS quote FROM r
 UNION ALL SELECT r.novel_id, r.record_id, r.chapter_num, r.display_name, entity_key, value_text, {_ST}, field_label, confidence, field_key, pos, quote FROM r JOIN (SELECT record_id, field_key, field_label, value_text, confidence, pos, quote FROM {CV}) v ON v.record_id = r.record_id
  WHERE ({_ST}) <> 'appearance' AND {Q.alnum('value_text')} > 3 AND ({Q.ups('value_text')} > 0 OR {Q.alnum('value_text')} > 6) AND {Q.fkey('value_text')} <> {Q.fkey('r.display_name')}),
j1 AS (SELECT *, {Q.fkey('alias_text')} AS alias_key, (chapter_num, display_name, record_id, fk, pos) AS o FROM j0),
amap AS (SELECT novel_id, entity_key, alias_key, min_by(display_name, o) AS display_name, min_by(alias_type, o) AS alias_type, min_by(alias_label, o) AS alias_label, min_by(alias_text, o) AS alias_text, min(chapter_num) AS first_chapter_num,
 CASE WHEN max(confidence) > 0 THEN max(confidence) ELSE (min_by({{'c': confidence}}, o)).c END AS confidence, min_by(quote, o) FILTER (quote IS NOT NULL) AS quote FROM j1 WHERE alias_key <> '' GROUP BY 1, 2, 3)"""


def alias_map(spark, sf):
    return J.rebuild_alias_map(char_recs(spark, sf).drop("chapter_id"), char_values(spark, sf).select("record_id", "field_key", "field_label", "pos", "value_text", "confidence", "evidence"), ["novel_id"])


@query("j1_rebuild_alias_map", f"WITH {_J1} SELECT novel_id, entity_key, alias_key, display_name, alias_type, alias_label, alias_text, first_chapter_num, confidence, quote FROM amap")
def j1(spark, sf):
    return alias_map(spark, sf).withColumn("quote", F.get("evidence", F.lit(0))["quote"]).drop("evidence")


@query("j2_list_aliases", f"WITH {_J1} SELECT novel_id, entity_key, alias_text, first_chapter_num FROM amap ORDER BY display_name, first_chapter_num, alias_text, alias_key")
def j2(spark, sf):
    return J.list_aliases(alias_map(spark, sf)).select("novel_id", "entity_key", "alias_text", "first_chapter_num")
