"""Inputs of the registered queries, derived from the given tables.

Each rule is one SQL text that reads the same in Spark and in DuckDB; only list explosion differs
between the two and is written per dialect. Whole tables and whole texts are used.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def explode(d: str, src: str, keep: str, items: str, pos: str, item: str) -> str:
    if d == "spark":
        return f"SELECT {keep}, CAST(_p AS BIGINT) AS {pos}, _i AS {item} FROM ({src}) LATERAL VIEW posexplode({items}) _x AS _p, _i"
    return (
        f"SELECT {keep}, CAST(unnest(range(len(_l))) AS BIGINT) AS {pos}, unnest(_l) AS {item} "
        f"FROM (SELECT *, {items} AS _l FROM ({src}) _a) _b"
    )


def novels(d: str) -> str:
    """One novel per document; some line starts become headings, some line ends blank lines."""
    nl = "chr(10)"
    t = "text"
    for letter, before in (
        ("A", f"{nl} || 'Chapter A' || {nl} || 'A'"),
        ("O", f"'  # Opening O  ' || {nl} || 'O'"),
        ("E", f"' ' || chr(9) || {nl} || 'E'"),
        ("D", f"'CHƯƠNG 2: D' || {nl} || 'D'"),
        ("L", f"'第3章 L' || {nl} || {nl} || 'L'"),
        ("W", f"{nl} || {nl} || 'W'"),
    ):
        t = f"replace({t}, {nl} || '{letter}', {nl} || {before})"
    lead = "CASE WHEN doc_id % 3 = 0 THEN chr(10) || ' ' ELSE '' END"
    return f"SELECT doc_id AS novel_id, source, ' Novel ' || CAST(doc_id AS STRING) || ' ' AS title, {lead} || {t} AS text FROM documents"


def scripts(d: str) -> str:
    """Texts in several scripts, by replacing letters of some languages."""
    return (
        "SELECT doc_id AS text_id, CASE lang WHEN 'de' THEN translate(text, 'enirstu', '가나다라마바사') "
        "WHEN 'es' THEN translate(text, 'aeionrsdltc', '的一是在不了人我有他这') ELSE text END AS text FROM documents"
    )


def chapters(d: str) -> str:
    return (
        "SELECT doc_id AS chapter_id, source AS novel_id, doc_id AS chapter_num, "
        "'Chapter ' || CAST(doc_id AS STRING) AS title, text AS content FROM documents"
    )


def lines(d: str) -> str:
    split = "split(text, chr(10))" if d == "spark" else "string_split(text, chr(10))"
    return explode(d, "SELECT doc_id, text FROM documents", "doc_id", split, "pos", "line")


def surfaces_raw(d: str) -> str:
    """Lines in several disguises: quoted, with endings, with marked letters, in lower case."""
    return f"""SELECT doc_id, pos, CASE pos % 5 WHEN 0 THEN line
 WHEN 1 THEN '  “' || line || ' này” ' WHEN 2 THEN 'vị ' || translate(line, 'aeod', 'ắềợđ') || ' kia'
 WHEN 3 THEN lower(line) || chr(9) || ' ' || chr(39) ELSE line END AS raw FROM ({lines(d)}) _l"""


def pairs(d: str) -> str:
    """Every capitalised word with the word after it, by position in the chapter."""
    pat = "'[A-Z][a-z][a-z][a-z][a-z][a-z]+ [a-z][a-z][a-z]+'"
    items = f"regexp_extract_all(content, {pat}, 0)"
    return explode(d, chapters(d), "chapter_id, novel_id, chapter_num", items, "pos", "name")


def identities(d: str) -> str:
    """Per chapter: a name (two words) and its first word as an alias."""
    return (
        "SELECT chapter_id, novel_id, chapter_num, name, split_part(name, ' ', 1) AS alias, "
        f"MIN(pos) AS ord FROM ({pairs(d)}) _p GROUP BY chapter_id, novel_id, chapter_num, name"
    )


def candidates(d: str) -> str:
    """Known characters of each novel, split over the three sources of the resolver."""
    # the least of a novel is the least of its chapters, so Spark needs no grouping by chapter before
    rows = identities(d) if d == "duck" else f"SELECT novel_id, name, split_part(name, ' ', 1) AS alias, chapter_num FROM ({pairs(d)}) _p"
    return f"""SELECT novel_id, name AS cand_id, replace(lower(name), ' ', '_') AS target_key, name AS display_name, MIN(alias) AS alias, MIN(chapter_num) AS chapter_num, name AS ord,
 CASE length(name) % 3 WHEN 0 THEN 'alias_map' WHEN 1 THEN 'stored' ELSE 'working' END AS source FROM ({rows}) _i GROUP BY novel_id, name"""


def observed(d: str) -> str:
    return observed_of(f"({candidates(d)}) _c")


def observed_of(known: str) -> str:
    """Every known name as somebody might observe it: unchanged, shortened, with words added."""
    return f"""SELECT novel_id, cand_id AS observed_id, chapter_num AS text_id, alias, CASE length(cand_id) % 4 WHEN 0 THEN cand_id WHEN 1 THEN replace(cand_id, 'th', 't')
 WHEN 2 THEN cand_id || ' esten' ELSE 'Ofer ' || cand_id END AS name FROM {known}"""


def alias_rows(d: str) -> str:
    """Alias claims of the characters of a chapter: each word that follows the first word of a name."""
    return f"""SELECT chapter_id, split_part(name, ' ', 1) AS name, pos AS ord, CASE pos % 4 WHEN 0 THEN name || ' ' || split_part(name, ' ', 2) WHEN 1 THEN upper(split_part(name, ' ', 2))
 WHEN 2 THEN split_part(name, ' ', 2) ELSE ' “' || substring(name, 3, 12) || '” ' END AS text,
 CASE pos % 5 WHEN 0 THEN 'pronoun' WHEN 1 THEN 'Nickname' WHEN 2 THEN 'alias' WHEN 3 THEN 'title' ELSE '' END AS alias_type, CASE pos % 3 WHEN 0 THEN ' ' ELSE ' L' || CAST(pos % 2 AS STRING) END AS alias_label,
 pos % 2 = 0 AS is_primary, CASE WHEN pos % 3 = 0 THEN 'he said "' || split_part(name, ' ', 2) || '" to' END AS quote FROM ({pairs(d)}) _p"""


def ownerships(d: str) -> str:
    """Claims that an identity of the chapter owns an alias: words and names that follow its name."""
    return f"""SELECT chapter_id, pos AS ord, CASE WHEN pos % 2 = 0 THEN name ELSE split_part(name, ' ', 1) END AS owner_name,
 CASE pos % 3 WHEN 0 THEN next_name WHEN 1 THEN upper(split_part(name, ' ', 2)) ELSE split_part(name, ' ', 1) || ' ' || split_part(next_name, ' ', 1) END AS alias_text,
 CASE WHEN pos % 7 = 6 THEN 'title' ELSE 'alias' END AS alias_type, CASE WHEN pos % 5 = 4 THEN 0.7 WHEN pos % 5 = 3 THEN 0.96 ELSE 0.8 END AS confidence,
 CASE WHEN pos % 4 = 3 THEN next_name ELSE 'so ' || name || ' or ' || next_name || ' of ' || split_part(name, ' ', 2) END AS quote
 FROM (SELECT *, lead(name) OVER (PARTITION BY chapter_id ORDER BY pos) AS next_name FROM ({pairs(d)}) _p) _q WHERE next_name IS NOT NULL"""


def rec_values(d: str) -> str:
    """Values of character records. A record of a chapter collects the words of one initial letter, so
    that values meet again in several fields."""
    return f"""SELECT p.chapter_id, p.novel_id, p.chapter_num, CAST(p.chapter_id AS STRING) || ':' || substring(name, 1, 1) AS record_id, pos AS batch, 0 AS pos,
 CASE pos % 5 WHEN 0 THEN 'other_alias' WHEN 1 THEN 'Appearance' WHEN 2 THEN 'nickname' WHEN 3 THEN 'habit' ELSE 'relationship' END AS field_key,
 CASE WHEN pos % 6 = 0 THEN '' ELSE 'Label ' || CAST(pos % 5 AS STRING) END AS field_label,
 CASE WHEN pos % 3 = 0 THEN split_part(name, ' ', 1) ELSE substring(split_part(name, ' ', 2), 1, 2) END AS value_text, CASE WHEN pos % 4 = 3 THEN NULL ELSE (pos % 11) / 10.0 END AS confidence,
 CASE WHEN pos % 5 = 4 THEN split_part(name, ' ', 1) END AS related_character, CASE WHEN pos % 5 = 4 AND pos % 2 = 0 THEN 'friend' END AS relationship_type,
 CASE WHEN pos % 5 = 4 THEN 'label ' || CAST(pos % 3 AS STRING) END AS relationship_label, CASE WHEN pos % 5 = 4 THEN CASE pos % 3 WHEN 0 THEN 'self_to_related' ELSE 'other' END END AS relationship_direction,
 p.chapter_num + CASE WHEN pos % 13 = 12 THEN 1 ELSE 0 END AS e_chapter, CASE WHEN pos % 7 = 0 THEN NULL ELSE instr(content, name) - 1 END AS e_start, instr(content, name) - 1 + length(name) AS e_end,
 name AS e_quote, 'r' AS e_reason FROM ({pairs(d)}) p JOIN ({chapters(d)}) c ON p.chapter_id = c.chapter_id"""


def recs(d: str) -> str:
    """Character records: one per chapter and initial letter, named by their first word."""
    return f"""SELECT chapter_id, novel_id, chapter_num, record_id, MIN(batch) AS ord, MIN(e_quote) AS first_name FROM ({rec_values(d)}) _v GROUP BY chapter_id, novel_id, chapter_num, record_id"""


def char_recs(d: str) -> str:
    """Character records named by single words, so that a name returns in many chapters of a novel."""
    return f"""SELECT chapter_id, novel_id, chapter_num, CAST(chapter_id AS STRING) || ':' || split_part(name, ' ', 1) AS record_id, CASE WHEN chapter_id % 4 = 0 THEN ' ' ELSE lower(split_part(name, ' ', 1)) END AS entity_key,
 split_part(name, ' ', 1) AS display_name, MIN(pos) AS ord FROM ({pairs(d)}) _p GROUP BY chapter_id, novel_id, chapter_num, split_part(name, ' ', 1)"""


def novel_resets(d: str) -> str:
    """Resets of the analysis of some novels: a range of chapters, or all of them."""
    whole = "MIN(doc_id) % 4 = 0"
    return f"""SELECT source AS novel_id, CASE WHEN {whole} THEN NULL ELSE MIN(doc_id) + COUNT(*) END AS from_num, CASE WHEN {whole} THEN NULL ELSE MIN(doc_id) + 8 * COUNT(*) END AS to_num
 FROM documents GROUP BY source HAVING MIN(doc_id) % 5 <> 0"""


def char_values(d: str) -> str:
    """Alias and attribute values of the records of ``char_recs``: the word after the name."""
    return f"""SELECT chapter_id, novel_id, chapter_num, CAST(chapter_id AS STRING) || ':' || split_part(name, ' ', 1) AS record_id, split_part(name, ' ', 1) AS display_name, pos,
 CASE pos % 4 WHEN 0 THEN 'other_alias' WHEN 1 THEN 'Nickname' WHEN 2 THEN 'appearance' ELSE 'alias' END AS field_key, 'L' || CAST(pos % 3 AS STRING) AS field_label,
 CASE WHEN pos % 2 = 0 THEN split_part(name, ' ', 2) ELSE upper(substring(split_part(name, ' ', 2), 1, 1)) || substring(split_part(name, ' ', 2), 2, 3) END AS value_text,
 CASE WHEN pos % 4 = 3 THEN NULL ELSE (pos % 11) / 10.0 END AS confidence, CASE WHEN pos % 3 <> 0 THEN name END AS quote FROM ({pairs(d)}) _p"""


def _next(d: str) -> str:
    return f"SELECT *, coalesce(lead(name) OVER (PARTITION BY chapter_id ORDER BY pos), name) AS next_name FROM ({pairs(d)}) _p"


def one_characters(d: str) -> str:
    """Characters of a model answer per chapter, one per word pair of the text, with one attribute."""
    return f"""SELECT chapter_id, chapter_num, novel_id, pos AS ord, CASE pos % 6 WHEN 0 THEN '“' || name || '” này' WHEN 5 THEN name || ' zz' ELSE name END AS display_name,
 CASE pos % 11 WHEN 10 THEN 'Role title' WHEN 9 THEN 'uncertain' ELSE 'person' END AS entity_nature, CASE WHEN pos % 13 = 12 THEN 0.4 WHEN pos % 13 = 11 THEN NULL ELSE 0.45 END AS confidence,
 split_part(name, ' ', 1) AS alias_a, CASE WHEN pos % 3 = 0 THEN next_name || 's' ELSE split_part(name, ' ', 2) END AS alias_b, name AS quote,
 CASE pos % 4 WHEN 0 THEN 'appearance' ELSE 'eyes' END AS field_key, CASE pos % 5 WHEN 0 THEN '' WHEN 1 THEN 'Clothing' WHEN 2 THEN 'mood' ELSE 'physical_appearance' END AS semantic_class,
 CASE WHEN pos % 7 = 6 THEN ' ' ELSE ' ' || split_part(name, ' ', 2) || ' ' END AS value_text, CASE pos % 8 WHEN 7 THEN name || ' missing' ELSE ' ' || split_part(name, ' ', 2) END AS field_quote,
 pos % 2 = 0 AS has_field FROM ({_next(d)}) _n"""


def one_relationships(d: str) -> str:
    return f"""SELECT chapter_id, chapter_num, pos AS ord, CASE WHEN pos % 2 = 0 THEN name ELSE split_part(name, ' ', 1) END AS source_name, next_name AS target_name,
 CASE pos % 7 WHEN 6 THEN 'event' WHEN 5 THEN 'Organization hierarchy' ELSE 'kinship' END AS rel_scope, CASE pos % 5 WHEN 4 THEN ' ' WHEN 3 THEN 'Old Uncle' ELSE 'uncle' END AS rel_type,
 CASE pos % 3 WHEN 0 THEN 'miller' WHEN 1 THEN ' miller of the ford' ELSE 'ferryman' END AS forward, CASE WHEN pos % 9 = 8 THEN '' ELSE 'nephew' END AS backward,
 CASE WHEN pos % 13 = 12 THEN 0.4 ELSE 0.5 + (pos % 5) / 10.0 END AS confidence, CASE pos % 8 WHEN 7 THEN name || ' missing' ELSE name END AS quote FROM ({_next(d)}) _n"""


def quoted_texts(d: str) -> str:
    """Texts with quotation marks round the words after some commas."""
    return "SELECT doc_id AS chapter_id, source AS novel_id, replace(replace(text, ', the ', ', \"The Old ' || source || '\" '), ', ', ' ‘a ') AS text FROM documents"


TWO = "(SELECT 0 AS k UNION ALL SELECT 1 AS k) _k"


def projects(d: str) -> str:
    """A project for every three customers; some are archived."""
    return """SELECT project_id, ' Project ' || CAST(project_id AS STRING) || ' ' AS name, project_id % 10 AS created_at, project_id % 7 AS updated_at,
 CASE WHEN project_id % 5 = 0 THEN project_id % 3 END AS deleted_at, CASE WHEN project_id % 5 = 0 THEN 'archived' ELSE 'private' END AS visibility
 FROM (SELECT DISTINCT CAST(floor(c_custkey / 3) AS BIGINT) * 2 AS project_id FROM customer) _p"""


def job_novels(d: str) -> str:
    return """SELECT c_custkey AS novel_id, CAST(floor(c_custkey / 3) AS BIGINT) * CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 1 END AS project_id, c_name AS title,
 CASE c_nationkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'vi' ELSE NULL END AS source_language, c_acctbal AS created_at, c_nationkey AS updated_at FROM customer"""


def jobs(d: str) -> str:
    """Two jobs per customer."""
    return f"""SELECT c_custkey * 2 + k AS job_id, c_custkey AS novel_id, CAST(floor(c_custkey / 3) AS BIGINT) AS project_id,
 CASE (c_custkey + c_nationkey + k) % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'paused' WHEN 3 THEN 'completed' WHEN 4 THEN 'failed' ELSE 'cancelled' END AS status,
 CASE WHEN c_nationkey % 3 = 0 THEN 7 END AS started_at, CAST(NULL AS INT) AS finished_at, CASE WHEN c_nationkey % 4 = 0 THEN 'code' END AS error_code,
 'reason ' || CAST(c_nationkey AS STRING) AS error_message, c_nationkey * (1 - 2 * k) % 3 AS created_at FROM customer CROSS JOIN {TWO}"""


def job_chapters(d: str) -> str:
    return "SELECT o_orderkey AS chapter_id, o_custkey AS novel_id, o_orderkey AS chapter_num, o_orderpriority AS title FROM orders"


def runs(d: str) -> str:
    return f"""SELECT o_custkey * 2 + k AS job_id, o_custkey AS novel_id, o_orderkey AS chapter_id, o_orderkey AS chapter_num,
 CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'pending' END AS status,
 1 + o_orderkey % 3 AS attempt, CASE WHEN o_orderstatus = 'P' THEN 'code' END AS error_code, CASE WHEN o_orderstatus = 'P' THEN 'message' END AS error_message,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '{{"execution_profile": "x"' WHEN o_orderkey % 7 = 2 THEN '{{"execution_profile":"one_shot","other":[1,2]}}'
  ELSE '{{"execution_profile":"one_shot","call_summary":{{"status":"ok","api_call_count":' || CAST(o_orderkey % 3 AS STRING) || ',"provider":"p","model":"m' || o_orderstatus
  || '","input_tokens":' || CAST(o_custkey AS STRING) || ',"estimated_cost":0.5}}}}' END AS output_json
 FROM orders CROSS JOIN {TWO} WHERE (k = 0 AND o_orderpriority <> '1-URGENT') OR (k = 1 AND o_orderpriority = '5-LOW')"""


def ranges_raw(d: str) -> str:
    return f"""SELECT job_id, CASE WHEN job_id % 4 IN (0, 1) THEN (job_id * 37) % 900 - 3 END AS from_num,
 CASE WHEN job_id % 4 IN (1, 2) THEN (job_id * 91) % 9000 - 3 END AS to_num FROM ({jobs(d)}) _j"""


def history(d: str) -> str:
    """Status history of jobs from the event table."""
    return """SELECT user_id AS job_id, event_id AS sequence, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
 WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, event_type, props FROM events"""


def requests(d: str) -> str:
    """Requested status changes of jobs."""
    return """SELECT user_id AS job_id, event_id AS sequence, CASE event_type WHEN 'signup' THEN 'running' WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused'
 WHEN 'purchase' THEN CASE WHEN event_id % 9 = 0 THEN 'completed' ELSE 'paused' END ELSE CASE WHEN event_id % 11 = 0 THEN 'cancelled' ELSE 'running' END END AS target,
 event_id AS at, 'r' || CAST(event_id % 5 AS STRING) AS reason, CASE WHEN event_id % 2 = 0 THEN 'c' || CAST(event_id % 3 AS STRING) END AS code FROM events"""


def run(spark: SparkSession, sf_dir: str, rule) -> DataFrame:
    """Evaluate an input rule on Spark."""
    text = rule("spark")
    for name in TABLES:
        if f" {name}" in text:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def duck(rule) -> str:
    return "(" + rule("duck") + ")"
