"""Queries over sources, tables and model text (A, L)."""
from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.operators import modeltext as L
from loreweave.plans import inputs as I
from loreweave.plans import q_records as QR
from loreweave.plans import q_text as QT
from loreweave.plans import sqlkit as Q
from loreweave.plans.registry import query
from loreweave.sources import corpus as C
from loreweave.sources import tables as T

CH, PR = I.duck(I.chapters), I.duck(I.projects)


# --- A2: import --------------------------------------------------------------------------------
_IMP = """SELECT novel_id AS source_key, source AS project_id, CASE WHEN novel_id % 17 = 5 THEN ' ' ELSE title END AS title, CASE WHEN novel_id % 23 = 7 THEN chr(10) || ' ' ELSE text END AS text,
 CASE novel_id % 3 WHEN 0 THEN ' auto ' WHEN 1 THEN NULL ELSE ' fr ' END AS source_language, CASE WHEN novel_id % 2 = 0 THEN ' A ' ELSE ' ' END AS author FROM {}"""


def _import(spark, sf):
    I.run(spark, sf, I.novels).createOrReplaceTempView("lw_novels")
    return C.import_novels(spark.sql(_IMP.format("lw_novels")))


_IN = f"({_IMP.format(I.duck(I.novels))})"


@query("a2_import_novels", f"SELECT source_key, trim(title) AS title, CASE WHEN author = ' ' THEN NULL ELSE 'A' END AS author, CASE WHEN source_language = ' fr ' THEN 'fr' ELSE lang END AS source_language FROM {_IN} n JOIN ("
       + QT._LANG.replace("TEXTS", f"(SELECT source_key AS text_id, {Q.trim('text')} AS text FROM {_IN})") + f") l ON l.text_id = n.source_key WHERE trim(title) <> '' AND {Q.trim('text')} <> ''")
def a2(spark, sf):
    return _import(spark, sf)["novels"].select("source_key", "title", "author", "source_language")


@query("a2_import_errors", f"SELECT source_key, CASE WHEN trim(title) = '' THEN 'title_required' ELSE 'text_required' END AS error FROM {_IN} WHERE trim(title) = '' OR {Q.trim('text')} = ''")
def a2_errors(spark, sf):
    return _import(spark, sf)["errors"]


_A2C = QT._chapters_sql(Q.trim("text")).replace(f"FROM {I.duck(I.novels)})", f"FROM (SELECT source_key AS novel_id, text FROM {_IN} WHERE trim(title) <> '' AND {Q.trim('text')} <> ''))", 1)
_A2S = f""", src2 AS (SELECT novel_id, chapter_num, content AS txt FROM chapters), l0 AS (SELECT novel_id, chapter_num, unnest(string_split(txt, chr(10))) AS line, unnest(range(1, len(string_split(txt, chr(10))) + 1)) AS line_no FROM src2),
l1 AS (SELECT *, {Q.trim('line')} = '' AS bl FROM l0), l2 AS (SELECT *, NOT bl AND coalesce(lag(bl) OVER (PARTITION BY novel_id, chapter_num ORDER BY line_no), TRUE) AS st FROM l1), sg AS (SELECT novel_id, count(*) AS n FROM l2 WHERE st GROUP BY 1)"""


@query("a2_import_events", _A2C + _A2S + " SELECT novel_id AS source_key, 1 AS sequence, 'analysis_job_created' AS event_type, count(*) AS chapter_count, any_value(n) AS source_segment_count FROM chapters JOIN sg USING (novel_id) GROUP BY 1")
def a2_events(spark, sf):
    t = _import(spark, sf)
    e = t["job_events"].join(t["jobs"].select("job_id", "novel_id"), "job_id").join(t["novels"].select("novel_id", "source_key"), "novel_id")
    return e.select("source_key", "sequence", "event_type", "chapter_count", "source_segment_count")


# --- A4 - A6 -----------------------------------------------------------------------------------
def _nested(spark, sf):
    """One document per chapter with its records, values and mentions nested."""
    v = QR.values(spark, sf)
    val = F.struct("batch", "field_key", "field_label", F.array(F.struct(F.col("value_text").alias("value"), "confidence", "related_character", "relationship_type", "relationship_label", "relationship_direction", "evidence")).alias("values"))
    e = F.get("evidence", F.lit(0))
    men = F.struct(F.col("batch").alias("b"), e["quote"].alias("text"), F.coalesce(e["start_char"], F.lit(0)).alias("start_char"), e["end_char"].alias("end_char"), F.lit("name").alias("mention_type"))
    rec = v.groupBy("chapter_id", "novel_id", "chapter_num", "record_id").agg(
        F.array_sort(F.collect_list(val)).alias("fields"), F.transform(F.array_sort(F.collect_list(men)), lambda m: F.struct(m["text"].alias("text"), m["start_char"].alias("start_char"), m["end_char"].alias("end_char"), m["mention_type"].alias("mention_type"))).alias("mentions"))
    row = F.struct(F.col("record_id").alias("display_name"), F.lit("character").alias("group_key"), F.lit("Nhân Vật").alias("group_label"), F.lower("record_id").alias("entity_key"), "mentions", "fields")
    return rec.groupBy(F.col("novel_id").alias("job_id"), "chapter_id", "chapter_num").agg(F.array_sort(F.collect_list(row)).alias("records"))


@query("a4_flatten_records", f"SELECT chapter_num, record_id AS display_name, row_number() OVER (PARTITION BY record_id ORDER BY batch) - 1 AS batch, field_key, field_label, value_text, confidence, relationship_label, e_quote AS quote FROM {QR.RV}")
def a4(spark, sf):
    rec, _, val, _ = T.flatten_records(_nested(spark, sf))
    return val.join(rec.select("record_id", "display_name"), "record_id").select(
        "chapter_num", "display_name", "batch", "field_key", "field_label", "value_text", "confidence", "relationship_label", F.get("evidence", F.lit(0))["quote"].alias("quote"))


@query("a4_flatten_mentions", f"SELECT record_id AS display_name, row_number() OVER (PARTITION BY record_id ORDER BY batch) - 1 AS pos, e_quote AS text, coalesce(e_start, 0) AS start_char, e_end AS end_char FROM {QR.RV}")
def a4_mentions(spark, sf):
    rec, _, _, men = T.flatten_records(_nested(spark, sf))
    return men.join(rec.select("record_id", "display_name"), "record_id").select("display_name", "pos", "text", "start_char", "end_char")


@query("a5_nest_records", f"""SELECT chapter_num, record_id AS display_name, string_agg(field_label || '>' || field_key || '>' || value_text, '|' ORDER BY field_label, field_key, batch) AS fields,
 string_agg(e_quote, '|' ORDER BY coalesce(e_start, 0), e_end, e_quote) AS mentions FROM {QR.RV} GROUP BY 1, 2""")
def a5(spark, sf):
    rec, _, val, men = T.flatten_records(_nested(spark, sf))
    n = T.nest_records(rec, val, men)
    fields = F.array_join(F.transform("fields", lambda f: F.array_join(F.transform(f["values"], lambda v: F.concat_ws(">", f["field_label"], f["field_key"], v["value_text"])), "|")), "|")
    return n.select("chapter_num", "display_name", fields.alias("fields"), F.array_join(F.transform("mentions", lambda m: m["text"]), "|").alias("mentions"))


_A6 = f"SELECT novel_id AS job_id, chapter_num, record_id, display_name FROM {QR.CR}"


@query("a6_replace_chapter_records", f"SELECT * FROM ({_A6}) WHERE chapter_num % 3 <> 0 UNION ALL SELECT job_id, chapter_num, record_id || '/new', upper(display_name) FROM ({_A6}) WHERE chapter_num % 3 = 0 AND length(display_name) % 2 = 0")
def a6(spark, sf):
    old = QR.char_recs(spark, sf).select(F.col("novel_id").alias("job_id"), "chapter_num", "record_id", "display_name")
    again = old.filter("chapter_num % 3 = 0")
    new = again.filter("length(display_name) % 2 = 0").select("job_id", "chapter_num", F.concat("record_id", F.lit("/new")).alias("record_id"), F.upper("display_name").alias("display_name"))
    return T.replace_chapter_records(old, new, again)


@query("a6_written_counts", f"WITH {QR._J1} SELECT novel_id AS job_id, count(*) AS record_count, 0 AS relationship_record_count, (SELECT count(*) FROM {I.duck(I.pairs)} p WHERE p.novel_id = r.novel_id) AS mention_count, (SELECT count(*) FROM amap WHERE amap.novel_id = r.novel_id) AS character_alias_count FROM {QR.CR} r GROUP BY r.novel_id")
def a6_counts(spark, sf):
    rec = QR.char_recs(spark, sf).select(F.col("novel_id").alias("job_id"), F.lit("character").alias("group_key"))
    men = I.run(spark, sf, I.pairs).select(F.col("novel_id").alias("job_id"))
    return T.written_counts(rec, men, QR.alias_map(spark, sf).withColumnRenamed("novel_id", "job_id"))


# --- A7 - A10 ----------------------------------------------------------------------------------
_REQ = "SELECT project_id + CASE WHEN project_id % 11 = 0 THEN 1 ELSE 0 END AS project_id, CASE project_id % 3 WHEN 0 THEN 'archive' WHEN 1 THEN 'restore' ELSE 'purge' END AS action, 99 AS \"at\" FROM {} WHERE project_id % 4 <> 3"


def _requests(spark, sf):
    I.run(spark, sf, I.projects).createOrReplaceTempView("lw_projects")
    return spark.sql(_REQ.format("lw_projects").replace('"at"', "at"))


_OUT = f"SELECT r.project_id, r.action, CASE WHEN p.project_id IS NULL THEN 'not_found' WHEN action = 'purge' THEN 'purged' WHEN action = 'archive' THEN CASE WHEN deleted_at IS NULL THEN 'archived' ELSE 'already_archived' END ELSE CASE WHEN deleted_at IS NULL THEN 'not_archived' ELSE 'restored' END END AS outcome FROM ({_REQ.format(PR)}) r LEFT JOIN {PR} p USING (project_id)"


@query("a7_project_requests", _OUT)
def a7_outcomes(spark, sf):
    return T.archive_restore_purge(I.run(spark, sf, I.projects), _requests(spark, sf))[1]


@query("a7_archive_restore_purge", f"""SELECT p.project_id, CASE WHEN outcome IN ('archived', 'restored') THEN 99 ELSE updated_at END AS updated_at, CASE outcome WHEN 'archived' THEN 99 WHEN 'restored' THEN NULL ELSE deleted_at END AS deleted_at,
 CASE outcome WHEN 'archived' THEN 'archived' WHEN 'restored' THEN 'private' ELSE visibility END AS visibility FROM {PR} p LEFT JOIN ({_OUT}) o USING (project_id) WHERE coalesce(outcome, '') <> 'purged'""")
def a7(spark, sf):
    return T.archive_restore_purge(I.run(spark, sf, I.projects), _requests(spark, sf))[0].drop("name", "created_at")


@query("a7_purge_dependents", f"SELECT job_id, chapter_id FROM {I.duck(I.runs)} r WHERE novel_id NOT IN (SELECT novel_id FROM {I.duck(I.job_novels)} WHERE project_id IN (SELECT project_id FROM ({_OUT}) WHERE outcome = 'purged'))")
def a7_purge(spark, sf):
    outcome = T.archive_restore_purge(I.run(spark, sf, I.projects), _requests(spark, sf))[1]
    tables = {"novels": I.run(spark, sf, I.job_novels), "runs": I.run(spark, sf, I.runs)}
    gone = outcome.filter("outcome = 'purged'").select("project_id")
    return T.purge(tables, gone, [("novels", "project_id"), ("runs", "novel_id")])["runs"].select("job_id", "chapter_id")


_UPD = "SELECT DISTINCT source AS novel_id, CASE WHEN length(source) % 2 = 0 THEN ' ' ELSE ' New ' || source END AS title, ' A ' AS author, ' ' AS genre, CAST(NULL AS STRING) AS description, CASE WHEN source < 'src5' THEN 'auto' ELSE ' de ' END AS source_language FROM documents WHERE source <> 'src7'"
_NOV = "SELECT DISTINCT source AS novel_id, 'Old' AS title, 'oa' AS author, 'og' AS genre, 'od' AS description, 'xx' AS source_language FROM documents"
_JOINED = "(SELECT novel_id AS text_id, string_agg(content, chr(10) || chr(10) ORDER BY chapter_num) AS text FROM (SELECT source AS novel_id, doc_id AS chapter_num, text AS content FROM (SELECT doc_id, source, s.text FROM documents JOIN " + I.duck(I.scripts) + " s ON s.text_id = doc_id)) GROUP BY 1)"


@query("a8_update_novel_metadata", f"""SELECT n.novel_id, coalesce(nullif(trim(u.title), ''), n.title) AS title, CASE WHEN u.novel_id IS NULL THEN 'oa' ELSE 'A' END AS author, CASE WHEN u.novel_id IS NULL THEN 'og' END AS genre, CASE WHEN u.novel_id IS NULL THEN 'od' END AS description,
 CASE WHEN u.novel_id IS NULL THEN 'xx' WHEN u.source_language = 'auto' THEN lang ELSE 'de' END AS source_language FROM ({_NOV}) n LEFT JOIN ({_UPD}) u ON u.novel_id = n.novel_id LEFT JOIN ({QT._LANG.replace('TEXTS', _JOINED)}) l ON l.text_id = n.novel_id""")
def a8(spark, sf):
    docs = I.table(spark, sf, "documents")
    docs.createOrReplaceTempView("documents")
    chapters = I.run(spark, sf, I.scripts).join(docs.select(F.col("doc_id").alias("text_id"), F.col("source").alias("novel_id")), "text_id").select(
        "novel_id", F.col("text_id").alias("chapter_num"), F.col("text").alias("content"))
    return T.update_novel_metadata(spark.sql(_NOV), spark.sql(_UPD), chapters)


@query("a9_list_projects", f"SELECT project_id, created_at FROM {PR} WHERE deleted_at IS NULL ORDER BY created_at DESC, project_id DESC")
def a9(spark, sf):
    return T.list_projects(I.run(spark, sf, I.projects)).select("project_id", "created_at")


@query("a9_list_archived_projects", f"SELECT project_id, updated_at, created_at FROM {PR} WHERE deleted_at IS NOT NULL ORDER BY updated_at DESC, created_at DESC, project_id DESC")
def a9_archived(spark, sf):
    return T.list_projects(I.run(spark, sf, I.projects), archived=True).select("project_id", "updated_at", "created_at")


@query("a10_create_projects", "SELECT c_custkey AS request_id, trim(name) AS name, 'local' AS workspace_id, 'private' AS visibility FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 4 THEN '  ' ELSE ' ' || c_name || ' ' END AS name FROM customer) WHERE trim(name) <> ''")
def a10(spark, sf):
    req = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.when(F.col("c_custkey") % 9 == 4, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("name"))
    return T.create_projects(req)[0].drop("project_id")


# --- L -----------------------------------------------------------------------------------------
_TXT = "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Sure: [' || text || ']} done ]' WHEN 1 THEN ']' || text || '[' WHEN 2 THEN text ELSE '{' || text || '[1]' END AS text FROM conversations"


@query("l1_extract_json_block", f"SELECT conv_id, turn, CASE WHEN strpos(text, '[') > 0 AND length(text) - strpos(reverse(text), ']') + 1 > strpos(text, '[') AND contains(text, ']') THEN substr(text, strpos(text, '['), length(text) - strpos(reverse(text), ']') + 2 - strpos(text, '[')) END AS block FROM ({_TXT})")
def l1(spark, sf):
    I.table(spark, sf, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(_TXT).select("conv_id", "turn", L.extract_json_block(F.col("text"), "array").alias("block"))


_JSN = "SELECT doc_id, '{\"id\":' || CAST(doc_id AS STRING) || ',\"text\":\"' || replace(replace(text, chr(92), ' '), chr(34), ' ') || '\"' || CASE WHEN doc_id % 5 = 3 THEN '' WHEN doc_id % 5 = 4 THEN '}}' WHEN doc_id % 10 = 5 THEN '}] x {\"b\":2}' WHEN doc_id % 10 = 6 THEN '},\"end\":1' WHEN doc_id % 10 = 7 THEN '} trailing' ELSE '}' || chr(10) END AS json_text FROM documents"


@query("l2_parse_tolerant_json", "SELECT doc_id, doc_id % 5 NOT IN (3, 4) AND doc_id % 10 NOT IN (5, 6, 7) AS ok, CASE WHEN doc_id % 5 NOT IN (3, 4) AND doc_id % 10 NOT IN (5, 6, 7) THEN replace(replace(text, chr(92), ' '), chr(34), ' ') END AS text FROM documents")
def l2(spark, sf):
    I.table(spark, sf, "documents").createOrReplaceTempView("documents")
    good, bad = L.parse_tolerant_json(spark.sql(_JSN), "json_text", "struct<id:bigint,text:string>")
    return good.select("doc_id", F.lit(True).alias("ok"), F.col("parsed.text").alias("text")).unionByName(bad.select("doc_id", F.lit(False).alias("ok"), F.lit(None).cast("string").alias("text")))


@query("l3_truncated_repairs", "SELECT doc_id, 1 AS attempt, text AS invalid_text FROM documents")
def l3(spark, sf):
    return L.repair_queue(I.table(spark, sf, "documents").select("doc_id", "text"), "text")[0]


_ALS = "SELECT event_id, '[\"' || event_type || '\",{\"text\":\"T' || CAST(user_id AS STRING) || '\",\"alias_type\":\"nickname\",\"is_primary\":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '},{\"text\":\"b\"}]' AS j FROM events"


@query("l4_coerce_alias_shape", """SELECT event_id, 0 AS pos, event_type AS text, 'other_alias' AS alias_type, 'Tên gọi khác' AS alias_label, FALSE AS is_primary FROM events
UNION ALL SELECT event_id, 1, 'T' || user_id, 'nickname', '', event_id % 2 = 0 FROM events UNION ALL SELECT event_id, 2, 'b', '', '', FALSE FROM events""")
def l4(spark, sf):
    I.table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql(_ALS).select("event_id", F.posexplode(L.coerce_aliases(F.col("j"))).alias("pos", "a")).select("event_id", "pos", "a.*")


_RLS = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"source_name\":\"' || event_type || '\",\"target\":\"b\",\"kind\":\"k\"}' WHEN 1 THEN '{\"person_a\":\"' || event_type || '\",\"person_b\":\"b\",\"a_to_b_label\":\"f\"}' ELSE '{\"source\":\"' || event_type || '\",\"relationship_label\":\"g\",\"target_label\":\"h\"}' END AS j FROM events"


@query("l4_coerce_relationship_shape", """SELECT event_id, event_type AS source_name, CASE WHEN event_id % 3 < 2 THEN 'b' ELSE '' END AS target_name, CASE WHEN event_id % 3 = 0 THEN 'k' ELSE '' END AS relationship_kind, '' AS relationship_type,
 CASE event_id % 3 WHEN 1 THEN 'f' WHEN 2 THEN 'g' ELSE '' END AS source_to_target_label, CASE WHEN event_id % 3 = 2 THEN 'h' ELSE '' END AS target_to_source_label FROM events""")
def l4_rel(spark, sf):
    I.table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql(_RLS).select("event_id", *L.coerce_relationship(F.col("j")))


_TPL = "{chapter_num}|{title}|{source_language}|{novel_context}|{other}|{known_relationships_json}|{chapter_text}"


@query("l5_build_requests", """SELECT chapter_num, replace(chapter_num || '|' || CASE WHEN chapter_num % 3 = 0 THEN 'Untitled chapter' ELSE 'T {novel_context}' END || '|' || CASE WHEN chapter_num % 2 = 0 THEN 'unknown' ELSE 'vi' END || '|{novel_context}|{other}|{known_relationships_json}|', '{novel_context}', 'ctx') || chapter_text AS user_prompt
FROM (SELECT doc_id AS chapter_num, text AS chapter_text FROM documents)""")
def l5(spark, sf):
    d = I.table(spark, sf, "documents").select(
        F.col("doc_id").alias("chapter_num"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise("T {novel_context}").alias("title"), F.when(F.col("doc_id") % 2 == 1, " vi ").alias("source_language"),
        F.lit("ctx").alias("novel_context"), F.col("text").alias("chapter_text"))
    return L.build_requests(d, _TPL).select("chapter_num", "user_prompt")


_SUG = "SELECT text_id AS novel_id, CASE WHEN text_id % 2 = 0 THEN ' New ' END AS title, CASE WHEN text_id % 3 = 0 THEN ' ' ELSE 'B' END AS author, 'g' AS genre, CAST(NULL AS STRING) AS description, CASE text_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'fr' ELSE '' END AS source_language, text AS sample FROM {}"
_NV = "SELECT doc_id AS novel_id, 'Old' AS title, CASE WHEN doc_id % 5 = 0 THEN 'A' END AS author, CAST(NULL AS STRING) AS genre, 'd' AS description, CASE WHEN doc_id % 7 = 0 THEN 'zz' END AS source_language FROM documents"
_NV6 = _NV.replace("WHEN doc_id % 7 = 0 THEN 'zz'", "WHEN doc_id % 7 = 0 THEN 'zz' WHEN doc_id % 7 = 1 THEN 'auto' WHEN doc_id % 7 = 2 THEN ' '")


@query("l6_fill_metadata", f"SELECT n.novel_id, coalesce(nullif(trim(s.title), ''), n.title) AS title, coalesce(nullif(trim(s.author), ''), n.author) AS author, 'g' AS genre, 'd' AS description, CASE WHEN n.novel_id % 4 = 1 THEN 'fr' ELSE coalesce(nullif(nullif(trim(n.source_language), ''), 'auto'), l.lang) END AS source_language FROM ({_NV6}) n JOIN ({_SUG.format(I.duck(I.scripts))}) s USING (novel_id) JOIN ({QT._LANG.replace('TEXTS', I.duck(I.scripts))}) l ON l.text_id = n.novel_id")
def l6(spark, sf):
    I.run(spark, sf, I.scripts).createOrReplaceTempView("lw_scripts")
    I.table(spark, sf, "documents").createOrReplaceTempView("documents")
    return L.fill_metadata(spark.sql(_NV6), spark.sql(_SUG.format("lw_scripts")))


_LOG = "SELECT doc_id, 'Bearer ' || text || ' AIzaSy' || lpad(CAST(doc_id AS STRING), 12, '7') || ' x BEARER  tok-' || CAST(doc_id AS STRING) || ' AIzaShort' AS msg FROM documents"


@query("l7_redact_secrets", f"SELECT doc_id, regexp_replace({Q.squeeze(chr(114) + 'egexp_replace(msg, ' + chr(39) + 'AIza[A-Za-z0-9]' + chr(123) + '12,' + chr(125) + chr(39) + ', ' + chr(39) + '[redacted_api_key]' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '(^| )([Bb][Ee][Aa][Rr][Ee][Rr]) [^ ]+', '\\1\\2 [redacted_token]', 'g') AS msg FROM ({_LOG})")
def l7(spark, sf):
    I.table(spark, sf, "documents").createOrReplaceTempView("documents")
    return spark.sql(_LOG).select("doc_id", L.redact_secrets(F.col("msg")).alias("msg"))


@query("l8_novel_context", "SELECT novel_id, 'Current novel metadata:' || chr(10) || '- Title: ' || title || chr(10) || '- Author: ' || coalesce(author, '') || chr(10) || '- Source language: ' || coalesce(source_language, '') || chr(10) || '- Genre: ' || chr(10) || '- Description: d' AS context FROM (" + _NV + ")")
def l8(spark, sf):
    I.table(spark, sf, "documents").createOrReplaceTempView("documents")
    return spark.sql(_NV).select("novel_id", L.novel_context().alias("context"))


