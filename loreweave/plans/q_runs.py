"""Queries over jobs, runs, events and projects (K)."""
from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.operators import runs as R
from loreweave.plans import inputs as I
from loreweave.plans.registry import query


def T(name):
    return I.duck(getattr(I, name))


def S(spark, sf, *names):
    return [I.run(spark, sf, getattr(I, n)) for n in names]


_JC = f"SELECT job_id, novel_id, chapter_id, chapter_num, title FROM {T('jobs')} j JOIN {T('job_chapters')} c USING (novel_id)"
_TEL = f"""SELECT *, CASE WHEN ok THEN output_json->>'$.execution_profile' END AS execution_profile, CASE WHEN ok THEN output_json->>'$.call_summary.status' END AS call_status,
 CASE WHEN ok THEN (output_json->>'$.call_summary.api_call_count')::BIGINT END AS api_call_count, CASE WHEN ok THEN output_json->>'$.call_summary.provider' END AS provider,
 CASE WHEN ok THEN output_json->>'$.call_summary.model' END AS model, CASE WHEN ok THEN (output_json->>'$.call_summary.input_tokens')::BIGINT END AS input_tokens,
 CASE WHEN ok THEN (output_json->>'$.call_summary.output_tokens')::BIGINT END AS output_tokens, CASE WHEN ok THEN (output_json->>'$.call_summary.estimated_cost')::DOUBLE END AS estimated_cost,
 CASE WHEN ok THEN output_json->>'$.call_summary.trace_id' END AS trace_id FROM (SELECT *, output_json IS NOT NULL AND json_valid(output_json) AS ok FROM {T('runs')})"""
_STATE = f"""SELECT jc.job_id, jc.novel_id, jc.chapter_id, jc.chapter_num, jc.title, coalesce(t.status, 'pending') AS status, t.attempt, t.error_code, t.error_message, t.execution_profile, t.call_status, t.api_call_count,
 t.provider, t.model, t.input_tokens, t.output_tokens, t.estimated_cost, t.trace_id FROM ({_JC}) jc LEFT JOIN ({_TEL}) t ON jc.job_id = t.job_id AND jc.chapter_id = t.chapter_id"""


@query("k1_run_snapshot", f"""SELECT j.job_id, j.status, CASE WHEN j.status = 'paused' THEN j.error_message END AS paused_reason, count(s.chapter_id) AS total_chapters,
 count(*) FILTER (s.status = 'completed') AS completed_chapters, count(*) FILTER (s.status = 'running') AS running_chapters, count(*) FILTER (s.status = 'failed') AS failed_chapters,
 count(*) FILTER (s.status = 'pending') AS pending_chapters, min(s.chapter_num) FILTER (s.status <> 'completed') AS next_chapter_num
 FROM {T('jobs')} j LEFT JOIN ({_STATE}) s ON j.job_id = s.job_id GROUP BY 1, 2, 3""")
def k1(spark, sf):
    return R.run_snapshot(*S(spark, sf, "jobs", "job_chapters", "runs"))


@query("k2_chapter_states", _STATE)
def k2(spark, sf):
    return R.chapter_states(*S(spark, sf, "jobs", "job_chapters", "runs"))


@query("k3_extract_telemetry", f"SELECT job_id, chapter_id, execution_profile, call_status, api_call_count, provider, model, input_tokens, output_tokens, estimated_cost, trace_id FROM ({_TEL})")
def k3(spark, sf):
    return R.telemetry(S(spark, sf, "runs")[0].select("job_id", "chapter_id", "output_json")).drop("output_json")


_RNG = f"SELECT *, coalesce(from_num, to_num) AS f, coalesce(to_num, from_num) AS t FROM {T('ranges_raw')}"
_OKR = f"SELECT job_id, f AS from_num, t AS to_num FROM ({_RNG}) WHERE f >= 1 AND t >= f"
_TODO = f"SELECT * FROM ({_JC}) jc WHERE NOT EXISTS (SELECT 1 FROM {T('runs')} r WHERE r.job_id = jc.job_id AND r.chapter_id = jc.chapter_id AND r.status = 'completed')"


@query("k4_next_chapter", f"SELECT job_id, min_by(chapter_id, chapter_num) AS chapter_id, min(chapter_num) AS chapter_num FROM ({_TODO}) t JOIN ({_OKR}) r USING (job_id) WHERE chapter_num BETWEEN from_num AND to_num GROUP BY 1")
def k4(spark, sf):
    jobs, chapters, runs, raw = S(spark, sf, "jobs", "job_chapters", "runs", "ranges_raw")
    return R.next_chapter(jobs, chapters, runs, R.normalize_ranges(raw)[0])


@query("k5_normalize_ranges", f"""SELECT job_id, f AS from_num, t AS to_num, CASE WHEN f < 1 OR t < 1 THEN 'range_below_one' WHEN t < f THEN 'range_reversed' ELSE 'ok' END AS outcome FROM ({_RNG}) WHERE f IS NOT NULL""")
def k5(spark, sf):
    ok, bad = R.normalize_ranges(S(spark, sf, "ranges_raw")[0])
    bad = bad.select("job_id", F.coalesce("from_num", "to_num").alias("from_num"), F.coalesce("to_num", "from_num").alias("to_num"), F.col("error").alias("outcome"))
    return ok.withColumn("outcome", F.lit("ok")).unionByName(bad)


@query("k6_finish_rule", f"""WITH todo AS ({_TODO}), rng AS ({_OKR}), openj AS (SELECT DISTINCT job_id FROM todo), openr AS (SELECT DISTINCT job_id FROM todo JOIN rng USING (job_id) WHERE chapter_num BETWEEN from_num AND to_num)
SELECT job_id, CASE WHEN job_id NOT IN (SELECT job_id FROM openj) THEN 'completed' ELSE 'paused' END AS action, CASE WHEN job_id IN (SELECT job_id FROM openj) THEN 'analysis_range_completed' END AS error_code
FROM {T('jobs')} WHERE job_id NOT IN (SELECT job_id FROM openj) OR (job_id IN (SELECT job_id FROM rng) AND job_id NOT IN (SELECT job_id FROM openr))""")
def k6(spark, sf):
    jobs, chapters, runs, raw = S(spark, sf, "jobs", "job_chapters", "runs", "ranges_raw")
    return R.finish_rule(jobs, chapters, runs, R.normalize_ranges(raw)[0])


_LEGAL = " OR ".join(["{a} = {b}"] + ["({a} = '%s' AND {b} = '%s')" % e for e in R.EDGES])


@query("k7_audit_transitions", f"""SELECT job_id, sequence, from_status, status AS to_status FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY sequence) AS from_status FROM {T('history')})
WHERE from_status IS NOT NULL AND NOT ({_LEGAL.format(a='from_status', b='status')})""")
def k7(spark, sf):
    return R.audit_transitions(S(spark, sf, "history")[0])


@query("k8_append_events", f"""SELECT user_id AS job_id, event_id AS arrival, event_type, coalesce(m, 0) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence
FROM events LEFT JOIN (SELECT o_custkey AS user_id, max(o_orderkey) AS m FROM orders GROUP BY 1) USING (user_id)""")
def k8(spark, sf):
    old = I.table(spark, sf, "orders").selectExpr("o_custkey AS job_id", "o_orderkey AS sequence")
    new = I.table(spark, sf, "events").selectExpr("user_id AS job_id", "event_id AS arrival", "event_type")
    return R.append_events(old, new)


@query("k9_list_events", f"SELECT job_id, sequence, event_type FROM {T('history')} ORDER BY job_id, sequence")
def k9(spark, sf):
    return S(spark, sf, "history")[0].select("job_id", "sequence", "event_type").orderBy("job_id", "sequence")


_FOLDS = f"""WITH RECURSIVE req AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sequence) AS n FROM {T('requests')} WHERE job_id IN (SELECT job_id FROM {T('jobs')})),
w AS (SELECT job_id, n, sequence, target, "at", reason, code, status AS from_status, CASE WHEN {_LEGAL.format(a='status', b='target')} THEN target ELSE status END AS s FROM req JOIN (SELECT job_id, status FROM {T('jobs')}) j USING (job_id) WHERE n = 1
 UNION ALL SELECT req.job_id, req.n, req.sequence, req.target, req."at", req.reason, req.code, w.s, CASE WHEN {_LEGAL.format(a='w.s', b='req.target')} THEN req.target ELSE w.s END FROM w JOIN req ON req.job_id = w.job_id AND req.n = w.n + 1),
done AS (SELECT * FROM w WHERE from_status <> target AND s = target)"""


@query("k10_replay_jobs", _FOLDS + f""" SELECT j.job_id, coalesce(max_by(target, sequence), any_value(j.status)) AS status, coalesce(any_value(j.started_at), min_by("at", sequence) FILTER (target = 'running')) AS started_at,
 CASE WHEN count(sequence) FILTER (target IN ('running', 'completed', 'cancelled')) > 0 THEN (max_by({{'v': CASE WHEN target <> 'running' THEN "at" END}}, sequence) FILTER (target IN ('running', 'completed', 'cancelled'))).v ELSE any_value(j.finished_at) END AS finished_at,
 CASE WHEN count(sequence) FILTER (target IN ('running', 'completed', 'paused')) > 0 THEN (max_by({{'v': CASE WHEN target = 'paused' THEN code END}}, sequence) FILTER (target IN ('running', 'completed', 'paused'))).v ELSE any_value(j.error_code) END AS error_code,
 CASE WHEN count(sequence) FILTER (target IN ('running', 'completed', 'paused')) > 0 THEN (max_by({{'v': CASE WHEN target = 'paused' THEN reason END}}, sequence) FILTER (target IN ('running', 'completed', 'paused'))).v ELSE any_value(j.error_message) END AS error_message
FROM {T('jobs')} j LEFT JOIN done USING (job_id) GROUP BY 1""")
def k10(spark, sf):
    return R.replay_jobs(*S(spark, sf, "jobs", "requests"))[0]


@query("k10_replay_events", _FOLDS + """ SELECT job_id, sequence, from_status, target AS to_status, CASE target WHEN 'running' THEN CASE WHEN from_status = 'paused' THEN 'analysis_job_resumed' ELSE 'analysis_job_started' END
 WHEN 'paused' THEN 'analysis_job_paused' WHEN 'completed' THEN 'analysis_job_completed' ELSE 'analysis_job_cancelled' END AS event_type FROM done""")
def k10_events(spark, sf):
    return R.replay_jobs(*S(spark, sf, "jobs", "requests"))[1]


@query("k10_refused_requests", _FOLDS + """ SELECT job_id, sequence, from_status, target AS to_status FROM w WHERE s <> target""")
def k10_refused(spark, sf):
    return R.replay_jobs(*S(spark, sf, "jobs", "requests"))[2]


_STARTS = '''SELECT o_custkey * 2 AS job_id, o_orderkey AS chapter_id, o_orderkey AS chapter_num, 1 AS "at" FROM orders WHERE o_orderstatus <> 'F' '''


@query("k11_start_runs", f"""SELECT job_id, chapter_id, coalesce(r.chapter_num, s.chapter_num) AS chapter_num, CASE WHEN s."at" IS NOT NULL THEN 'running' ELSE status END AS status, coalesce(attempt, 0) + (s."at" IS NOT NULL)::INT AS attempt,
 CASE WHEN s."at" IS NULL THEN output_json END AS output_json, CASE WHEN s."at" IS NULL THEN error_code END AS error_code, CASE WHEN s."at" IS NULL THEN error_message END AS error_message FROM {T('runs')} r FULL JOIN ({_STARTS}) s USING (job_id, chapter_id)""")
def k11(spark, sf):
    runs = S(spark, sf, "runs")[0]
    starts = I.table(spark, sf, "orders").filter("o_orderstatus <> 'F'").selectExpr("o_custkey * 2 AS job_id", "o_orderkey AS chapter_id", "o_orderkey AS chapter_num", "1 AS at")
    return R.start_runs(runs, starts)


def _results(runs):
    return runs.filter("status = 'running'").select(
        "job_id", "chapter_id", (F.col("chapter_id") % 4 != 0).alias("ok"), F.lit("{}").alias("output"), F.lit("c").alias("code"), F.lit("m").alias("message")
    )


@query("k12_finish_runs", f"""SELECT job_id, chapter_id, chapter_num, attempt, CASE WHEN status <> 'running' THEN status WHEN chapter_id % 4 <> 0 THEN 'completed' ELSE 'failed' END AS status,
 CASE WHEN status = 'running' AND chapter_id % 4 <> 0 THEN '{{}}' ELSE output_json END AS output_json, CASE WHEN status <> 'running' THEN error_code WHEN chapter_id % 4 = 0 THEN 'c' END AS error_code,
 CASE WHEN status <> 'running' THEN error_message WHEN chapter_id % 4 = 0 THEN 'm' END AS error_message FROM {T('runs')}""")
def k12(spark, sf):
    runs = S(spark, sf, "runs")[0]
    return R.finish_runs(runs, _results(runs))[0]


@query("k12_finish_events", f"SELECT job_id, chapter_id, chapter_num, attempt, CASE WHEN chapter_id % 4 <> 0 THEN 'analysis_chapter_completed' ELSE 'analysis_chapter_failed' END AS event_type FROM {T('runs')} WHERE status = 'running'")
def k12_events(spark, sf):
    runs = S(spark, sf, "runs")[0]
    return R.finish_runs(runs, _results(runs))[1]


_RESETS = f"SELECT job_id, from_num, to_num FROM ({_OKR}) UNION ALL SELECT job_id, NULL, NULL FROM {T('jobs')} WHERE job_id % 4 = 3"


@query("k13_reset_runs", f"SELECT job_id, chapter_id, status FROM {T('runs')} r WHERE NOT EXISTS (SELECT 1 FROM ({_RESETS}) x WHERE x.job_id = r.job_id AND (x.from_num IS NULL OR r.chapter_num BETWEEN x.from_num AND x.to_num))")
def k13(spark, sf):
    return _reset(spark, sf)[0].select("job_id", "chapter_id", "status")


@query("k13_reset_jobs", f"SELECT job_id, CASE WHEN h THEN 'pending' ELSE status END AS status, CASE WHEN NOT h THEN started_at END AS started_at, CASE WHEN NOT h THEN error_code END AS error_code, CASE WHEN NOT h THEN error_message END AS error_message FROM (SELECT *, job_id IN (SELECT job_id FROM ({_RESETS})) AS h FROM {T('jobs')})")
def k13_jobs(spark, sf):
    return _reset(spark, sf)[1].select("job_id", "status", "started_at", "error_code", "error_message")


def _reset(spark, sf):
    jobs, runs, raw = S(spark, sf, "jobs", "runs", "ranges_raw")
    resets = R.normalize_ranges(raw)[0].unionByName(
        jobs.filter("job_id % 4 = 3").select("job_id", F.lit(None).cast("bigint").alias("from_num"), F.lit(None).cast("bigint").alias("to_num"))
    )
    return R.reset_runs(runs, jobs, resets)


_LATEST = f"SELECT novel_id, job_id, status, created_at FROM {T('jobs')} QUALIFY row_number() OVER (PARTITION BY novel_id ORDER BY created_at DESC, job_id DESC) = 1"
_ACTIVE = f"SELECT project_id, novel_id, title, source_language FROM {T('job_novels')} QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, created_at DESC, novel_id DESC) = 1"


@query("k14_latest_job", _LATEST)
def k14(spark, sf):
    return R.latest_job(S(spark, sf, "jobs")[0])


@query("k15_workspace_snapshot", f"""SELECT p.project_id, p.name, a.novel_id, a.title, a.source_language, l.job_id, l.status AS job_status, coalesce(chapter_count, 0) AS chapter_count, coalesce(run_count, 0) AS run_count,
 coalesce(completed_count, 0) AS completed_count, coalesce(event_count, 0) AS event_count, last_sequence FROM {T('projects')} p LEFT JOIN ({_ACTIVE}) a USING (project_id) LEFT JOIN ({_LATEST}) l USING (novel_id)
LEFT JOIN (SELECT novel_id, count(*) AS chapter_count FROM {T('job_chapters')} GROUP BY 1) c USING (novel_id)
LEFT JOIN (SELECT job_id, count(*) AS run_count, count(*) FILTER (status = 'completed') AS completed_count FROM {T('runs')} GROUP BY 1) r USING (job_id)
LEFT JOIN (SELECT job_id, count(*) AS event_count, max(sequence) AS last_sequence FROM {T('history')} GROUP BY 1) e USING (job_id) WHERE p.deleted_at IS NULL""")
def k15(spark, sf):
    return R.workspace_snapshot(*S(spark, sf, "projects", "job_novels", "job_chapters", "jobs", "runs", "history"))


_BASE = f"(SELECT p.project_id AS pid, a.novel_id, l.job_id FROM {T('projects')} p JOIN ({_ACTIVE}) a USING (project_id) LEFT JOIN ({_LATEST}) l USING (novel_id) WHERE p.deleted_at IS NULL) b"


def _lists(spark, sf):
    projects, novels, chapters, jobs, runs, events = S(spark, sf, "projects", "job_novels", "job_chapters", "jobs", "runs", "history")
    lists = {
        "chapters": chapters.select("novel_id", "chapter_id", "chapter_num", "title"),
        "states": R.chapter_states(jobs, chapters, runs).select("job_id", "chapter_id", "status", "attempt"),
        "events": events.select("job_id", "sequence", "event_type"),
    }
    return R.workspace_lists(projects, novels, jobs, lists)


@query("k15_chapter_list", f"SELECT pid AS project_id, novel_id, chapter_id, chapter_num, title FROM {T('job_chapters')} c JOIN {_BASE} USING (novel_id)")
def k15_chapters(spark, sf):
    return _lists(spark, sf)["chapters"]


@query("k15_state_list", f"SELECT pid AS project_id, s.job_id, chapter_id, status, attempt FROM ({_STATE}) s JOIN {_BASE} ON b.job_id = s.job_id")
def k15_states(spark, sf):
    return _lists(spark, sf)["states"]


@query("k15_event_list", f"SELECT pid AS project_id, h.job_id, sequence, event_type FROM {T('history')} h JOIN {_BASE} ON b.job_id = h.job_id")
def k15_events(spark, sf):
    return _lists(spark, sf)["events"]


_USAGE = """SELECT l_orderkey AS job_id, CASE l_returnflag WHEN 'A' THEN ' Model-2.5-Pro' WHEN 'N' THEN 'model-2.5-flash' ELSE 'other' END AS model,
 CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity * 1000 AS BIGINT) END AS input_tokens, CASE WHEN l_linenumber <> 4 THEN CAST(l_quantity * 10 AS BIGINT) END AS output_tokens FROM lineitem"""
_COST = f"SELECT *, CASE WHEN contains(lower(model), '2.5-pro') THEN input_tokens / 1000000.0 * 1.25 + output_tokens / 1000000.0 * 10.0 ELSE input_tokens / 1000000.0 * 0.3 + output_tokens / 1000000.0 * 2.5 END AS c FROM ({_USAGE})"


@query("k16_estimate_cost", f"SELECT job_id, model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(c), 6) AS estimated_cost FROM ({_COST}) GROUP BY ROLLUP (job_id, model)")
def k16(spark, sf):
    I.table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return R.usage_totals(spark.sql(_USAGE)).withColumn("estimated_cost", F.round("estimated_cost", 6))


@query("k17_project_cards", f"""SELECT p.project_id, p.name, coalesce(n, 0) AS chapter_count, coalesce(w, 0) AS word_count, coalesce(source_language, 'Not set') AS source_language,
 CASE WHEN a.novel_id IS NULL THEN 'No novel imported' WHEN l.status IS NULL THEN 'Novel ready' ELSE l.status END AS stage,
 CASE WHEN a.novel_id IS NULL THEN 'Empty' ELSE 'Imported' END || '|' || coalesce('Analysis ' || l.status, 'No analysis job') || '|' || coalesce(source_language, 'Not set') AS tags
FROM {T('projects')} p LEFT JOIN ({_ACTIVE}) a USING (project_id) LEFT JOIN ({_LATEST}) l USING (novel_id)
LEFT JOIN (SELECT doc_id AS novel_id, 1 AS n, len(list_filter(string_split_regex(text, '[\\s]+'), lambda t: t <> '')) AS w FROM documents) c USING (novel_id) WHERE p.deleted_at IS NULL""")
def k17(spark, sf):
    projects, novels, jobs = S(spark, sf, "projects", "job_novels", "jobs")
    chapters = I.table(spark, sf, "documents").selectExpr("doc_id AS novel_id", "text AS content")
    return R.project_cards(projects, novels, chapters, jobs).withColumn("tags", F.array_join("tags", "|"))


_PAY = "CASE WHEN event_id % 5 = 0 THEN props || '}' WHEN event_id % 3 = 0 THEN '{\"a\":1,\"b\":\"x\",\"c\":true,\"d\":4}' ELSE props END"


@query("k18_event_labels", f"""SELECT event_id AS sequence, replace(event_type || '_seen', '_', ' ') AS label, CASE WHEN event_id % 5 = 0 THEN props || '}}' WHEN event_id % 3 = 0 THEN 'a: 1 · b: x · c: true'
 ELSE 'k: ' || (props->>'$.k') END AS summary FROM events""")
def k18(spark, sf):
    I.table(spark, sf, "events").createOrReplaceTempView("events")
    e = spark.sql(f"SELECT user_id AS job_id, event_id AS sequence, event_type || '_seen' AS event_type, {_PAY} AS payload_json FROM events")
    return R.event_labels(e).drop("job_id")


_TREQ = "SELECT o_orderkey AS request_id, o_custkey * 2 AS novel_id, CASE o_orderstatus WHEN 'F' THEN ' fr ' WHEN 'O' THEN '  ' END AS source_language, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE ' de' END AS target_language FROM orders"


@query("k19_create_translation_jobs", f"""SELECT request_id, novel_id, coalesce(nullif(trim(r.source_language), ''), n.source_language) AS source_language, trim(target_language) AS target_language, 'pending' AS status
FROM ({_TREQ}) r JOIN {T('job_novels')} n USING (novel_id) WHERE trim(target_language) <> ''""")
def k19(spark, sf):
    novels = S(spark, sf, "job_novels")[0]
    I.table(spark, sf, "orders").createOrReplaceTempView("orders")
    return R.create_translation_jobs(spark.sql(_TREQ), novels)[0].drop("job_id")


@query("k20_progress", f"SELECT job_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, max(chapter_num) FILTER (api_call_count IS NOT NULL OR provider IS NOT NULL) AS last_reported_chapter, floor(count(*) FILTER (status = 'completed') * 100.0 / count(*) + 0.5)::BIGINT AS percent FROM ({_STATE}) GROUP BY 1")
def k20(spark, sf):
    return R.progress(k2(spark, sf))


@query("k21_list_chapters_runs", f"""SELECT r.job_id, r.chapter_id, r.chapter_num, r.status FROM {T('runs')} r JOIN {T('jobs')} j USING (job_id) JOIN {T('projects')} p USING (project_id) WHERE p.deleted_at IS NULL""")
def k21(spark, sf):
    projects, jobs, runs = S(spark, sf, "projects", "jobs", "runs")
    rows = runs.join(jobs.select("job_id", "project_id"), "job_id")
    return R.of_active_projects(rows, projects).select("job_id", "chapter_id", "chapter_num", "status")
