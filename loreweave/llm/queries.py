"""Registered queries of the operators, with SQL where SQL can state the result."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exactdedup, fertility, fillmiddle, filteraudit, jaccard, langid, mixing, quality, secrets, suffixdedup, toxicity, warc
from .common import remainder, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_pareto_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    sized = stage(sized.withColumn("liking", mixing.damped(F.col("size"))), "mix-sizes")
    out = mixing.mix(sized, share=1.5, weights=(3, 1, 2), most=2, preference="liking", size="size")
    return out.select("row.doc_id", "row.source", "size", "source_size", "target", "expected", "copies", "taken")


@query(
    "op3_extendible_hash_dedup",
    r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digests = stage(exactdedup.digest(docs), "dedup-digests")
    return exactdedup.assign(digests, exactdedup.build_index(docs))


@query(
    "op7_positional_decontamination",
    r"""
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
    b AS (SELECT item_id, ws, len(ws) AS m, least(13, len(ws)) AS n FROM (SELECT item_id, list_filter(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
        FROM benchmark) WHERE len(ws) > 0),
    bw AS (SELECT DISTINCT item_id, n, list_slice(ws, s, s + n - 1) AS win FROM (SELECT *, unnest(range(1, m - n + 2)) AS s FROM b)),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, n, s, list_slice(ws, s, s + n - 1) AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, sizes)),
    hit AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
    pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
    its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
    SELECT w.doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(ws), 0) AS contaminated
    FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    out = decontaminate.judge(docs, decontaminate.find(docs, items))
    return out.select("row.doc_id", "n_words", "n_hit", "n_items", F.sha2("item_ids", 256).alias("items_sha256"), "contaminated")


def held_out(n: int, out: int):
    """The remainder of a row's id is ``out``; false for a null id, which is never learned from either."""
    return F.coalesce(remainder(F.col("doc_id"), n) == out, F.lit(False))


@query("op8_counterfactual_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    out = docs.select("doc_id", held_out(3, 1).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query("op6_ordinal_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 good but toxic, 2 good and civil. A row is selected if it is good more likely than not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 2 - F.col("toxic"))
    ratings = table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    model = quality.train(docs, ratings, remainder(F.col("doc_id"), 3) != 1)
    out = quality.grades(docs, model, cut=1)
    return out.select("row.doc_id", "expected_grade", "tail_probability", "selected").withColumn("held_out", held_out(3, 1))


@query("op2_ppm_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tables = langid.train(docs, remainder(F.col("doc_id"), 4) != 2)
    found = docs.select("doc_id", held_out(4, 2).alias("held_out"), langid.predict(spark, F.col("text"), tables).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query(
    "op10_boundary_chain_warc",
    """
    WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    g AS (SELECT payload_digest, min(page_id) AS low FROM p WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN low < page_id THEN low END AS refers_to
    FROM p LEFT JOIN g USING (payload_digest)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_zstd_novelty_secrets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "op9_bayesian_jaccard_join",
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 10 * k >= 8 * (p.n + q.n - k)),
    r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
    m AS (SELECT x, min(y) AS low, count(*) AS size FROM (SELECT x, y FROM r UNION SELECT x, x FROM e) GROUP BY 1),
    l AS (SELECT x, count(*) AS k FROM e GROUP BY 1)
    SELECT doc_id, coalesce(low, doc_id) AS class_id, CAST(coalesce(size, 1) AS BIGINT) AS class_size, CAST(coalesce(l.k, 0) AS BIGINT) AS n_links
    FROM documents LEFT JOIN m ON m.x = doc_id LEFT JOIN l ON l.x = doc_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", "n_links")


@query("op5_logarithmic_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.remove_seen(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query(
    "op11_transducer_filter_audit",
    r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS low FROM d),
    l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
    r AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(ws) < 200 AS INT) AS a,
        CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT) AS b,
        CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT) AS c,
        CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS d, CAST(coalesce(low < w.doc_id, low IS NOT NULL AND w.doc_id IS NULL) AS INT) AS e
        FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
    cells AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM r GROUP BY ALL),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order FROM f p, f q, f r, f s, f t
        WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
    x AS (SELECT part, n, good, toxic, filter_order, list_transform(string_split(filter_order, ''), lambda k: CASE k WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails
        FROM cells, o),
    y AS (SELECT *, coalesce(list_position(fails, 1), 6) AS pos, list_sum(fails) AS k FROM x),
    z AS (SELECT part, filter_order, step, CAST(sum(n) FILTER (pos > step) AS BIGINT) AS kept, CAST(sum(n) FILTER (pos = step) AS BIGINT) AS removed,
        CAST(sum(n) FILTER (pos < step AND fails[step] = 1) AS BIGINT) AS redundant, CAST(sum(n) FILTER (k = 1 AND pos = step) AS BIGINT) AS unique_fails,
        CAST(sum(good) FILTER (pos = step) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (pos = step) AS BIGINT) AS toxic_lost
        FROM y, (SELECT unnest(range(1, 6)) AS step) GROUP BY 1, 2, 3)
    SELECT part, filter_order, CAST(step AS INT) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
        coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
        CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
    FROM z
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_fertility_rules")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fertility.report(table(spark, sf_dir, "documents"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(*base, "outside", "script", "token_entropy", *fertility.FIGURES)


@query(
    "op13_seekable_fill_middle",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    p AS (SELECT *, string_split(t, chr(10)) AS ls, [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN range(4)] AS r FROM d),
    u AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE len(ls) - CAST(ls[len(ls)] = '' AS INT) END AS n FROM p),
    c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
    k AS (SELECT *, [CASE WHEN x = 0 THEN 0 WHEN x = n THEN length(t) ELSE length(array_to_string(ls[1:x], chr(10))) + 1 END FOR x IN [a, b]] AS cut FROM c),
    s AS (SELECT *, substr(t, 1, cut[1]) AS pre, substr(t, cut[1] + 1, cut[2] - cut[1]) AS mid, substr(t, cut[2] + 1) AS suf FROM k)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(cut[1] AS BIGINT) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN CAST(cut[2] - cut[1] AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
        sha256(t) AS restored_sha256 FROM s
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fillmiddle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
