"""Job, run and workspace analytics over the bookkeeping tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.keys import blank_to_null, trim_ws
from loreweave.functions.ordered import WIDTH, bucket_of, lag_in_key, row_number_in_key
from loreweave.functions.textfns import is_json
from loreweave.operators.aliases import retract_records
from loreweave.operators.segment import word_count

# --- Fixed values -------------------------------------------------------------------------
STATUSES = ("pending", "running", "paused", "completed", "failed", "cancelled")
EDGES = (
    ("pending", "running"), ("pending", "paused"), ("pending", "cancelled"),
    ("running", "completed"), ("running", "failed"), ("running", "cancelled"), ("running", "paused"),
    ("paused", "running"), ("paused", "cancelled"), ("failed", "pending"),
)
RANGE_DONE = "analysis_range_completed"
CANCEL_EVENTS = {
    "analysis": "analysis_job_cancelled", "translation": "translation_job_cancelled",
    "import": "import_job_cancelled", "indexing": "indexing_job_cancelled",
}
# price per million input and output tokens
PRICES = (("2.5-pro", 1.25, 10.0), ("", 0.30, 2.50))
TELEMETRY = (
    "execution_profile string, call_summary struct<status:string,api_call_count:bigint,provider:string,"
    "model:string,input_tokens:bigint,output_tokens:bigint,estimated_cost:double,trace_id:string>, _corrupt string"
)
# ------------------------------------------------------------------------------------------


def _rows() -> Column:
    return F.count(F.lit(1))


def legal_edge(source: Column, target: Column) -> Column:
    """K7: may a job move from ``source`` to ``target``."""
    pairs = [f"{a}>{b}" for a, b in EDGES]
    return (source == target) | F.concat_ws(">", source, target).isin(*pairs)


def telemetry(runs: DataFrame) -> DataFrame:
    """K3: call telemetry of each run; text that does not parse gives nulls."""
    parsed = F.from_json("output_json", TELEMETRY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    t = runs.withColumn("_t", F.when(is_json(F.col("output_json")), parsed))
    t = t.withColumn("_t", F.when(F.col("_t._corrupt").isNull(), F.col("_t")))
    call = "_t.call_summary"
    return t.select(
        *runs.columns, F.col("_t.execution_profile").alias("execution_profile"),
        F.col(f"{call}.status").alias("call_status"),
        *[F.col(f"{call}.{c}").alias(c) for c in (
            "api_call_count", "provider", "model", "input_tokens", "output_tokens", "estimated_cost", "trace_id")],
    )


def _job_chapters(jobs: DataFrame, chapters: DataFrame, *cols: str) -> DataFrame:
    return jobs.select("job_id", "novel_id").join(chapters.select("novel_id", "chapter_id", "chapter_num", *cols), "novel_id")


def chapter_states(jobs: DataFrame, chapters: DataFrame, runs: DataFrame) -> DataFrame:
    """K2: one row per chapter of each job; chapters without a run are pending."""
    run = telemetry(runs).drop("novel_id", "chapter_num", "output_json")
    return (
        _job_chapters(jobs, chapters, "title")
        .join(run, ["job_id", "chapter_id"], "left")
        .withColumn("status", F.coalesce("status", F.lit("pending")))
    )


def run_snapshot(jobs: DataFrame, chapters: DataFrame, runs: DataFrame) -> DataFrame:
    """K1: chapter counts per job, first chapter that is not completed, reason of a pause."""
    status = F.coalesce("status", F.lit("pending"))
    states = _job_chapters(jobs, chapters).join(
        runs.select("job_id", "chapter_id", "status"), ["job_id", "chapter_id"], "left"
    ).withColumn("status", status)
    counts = states.groupBy("job_id").agg(
        _rows().alias("total_chapters"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_chapters") for s in ("completed", "running", "failed", "pending")],
        F.min(F.when(F.col("status") != "completed", F.col("chapter_num"))).alias("next_chapter_num"),
    )
    zero = ["total_chapters", "completed_chapters", "running_chapters", "failed_chapters", "pending_chapters"]
    return (
        jobs.select("job_id", "status", F.when(F.col("status") == "paused", F.col("error_message")).alias("paused_reason"))
        .join(counts, "job_id", "left")
        .fillna(0, zero)
    )


def next_chapter(jobs: DataFrame, chapters: DataFrame, runs: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """K4: lowest chapter (in the job's range, where one is given) without a completed run."""
    todo = _job_chapters(jobs, chapters)
    if ranges is not None:
        todo = todo.join(ranges.select("job_id", "from_num", "to_num"), "job_id").filter(
            F.col("chapter_num").between(F.col("from_num"), F.col("to_num"))
        )
    done = runs.filter(F.col("status") == "completed").select("job_id", "chapter_id")
    return todo.join(done, ["job_id", "chapter_id"], "left_anti").groupBy("job_id").agg(
        F.min(F.struct("chapter_num", "chapter_id")).alias("_n")
    ).select("job_id", F.col("_n.chapter_id").alias("chapter_id"), F.col("_n.chapter_num").alias("chapter_num"))


def normalize_ranges(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K5: (ranges, errors). A single bound stands for both; no bound means no range."""
    r = requests.withColumn("from_n", F.coalesce("from_num", "to_num")).withColumn("to_n", F.coalesce("to_num", "from_num"))
    error = F.when((F.col("from_n") < 1) | (F.col("to_n") < 1), F.lit("range_below_one")).when(
        F.col("to_n") < F.col("from_n"), F.lit("range_reversed")
    )
    r = r.withColumn("error", error)
    ok = r.filter("error IS NULL AND from_n IS NOT NULL").select("job_id", F.col("from_n").alias("from_num"), F.col("to_n").alias("to_num"))
    return ok, r.filter("error IS NOT NULL").select("job_id", "from_num", "to_num", "error")


def finish_rule(jobs: DataFrame, chapters: DataFrame, runs: DataFrame, ranges: DataFrame) -> DataFrame:
    """K6: what becomes of a job after a chapter: completed, paused because its range is done, or nothing."""
    open_job = next_chapter(jobs, chapters, runs).select("job_id", F.lit(True).alias("_open"))
    open_range = next_chapter(jobs, chapters, runs, ranges).select("job_id", F.lit(True).alias("_open_range"))
    j = (
        jobs.select("job_id").join(open_job, "job_id", "left")
        .join(ranges.select("job_id", F.lit(True).alias("_ranged")), "job_id", "left")
        .join(open_range, "job_id", "left")
    )
    done_range = F.col("_ranged").isNotNull() & F.col("_open_range").isNull()
    return j.select(
        "job_id",
        F.when(F.col("_open").isNull(), F.lit("completed")).when(done_range, F.lit("paused")).alias("action"),
        F.when(F.col("_open").isNotNull() & done_range, F.lit(RANGE_DONE)).alias("error_code"),
    ).filter("action IS NOT NULL")


def audit_transitions(history: DataFrame, width: int = WIDTH) -> DataFrame:
    """K7: steps of a job's status history that the state machine forbids."""
    h = lag_in_key(history.select("job_id", "sequence", "status"), ["job_id"], "sequence", "status", "from_status", width)
    return h.filter(F.col("from_status").isNotNull() & ~legal_edge(F.col("from_status"), F.col("status"))).withColumnRenamed(
        "status", "to_status"
    )


def append_events(job_events: DataFrame, new: DataFrame, order: str = "arrival") -> DataFrame:
    """K8: number new events after the last one of their job. ``new`` has a unique integer ``order``."""
    last = job_events.groupBy("job_id").agg(F.max("sequence").alias("_last"))
    return (
        row_number_in_key(new, ["job_id"], order, "_rn")
        .join(last, "job_id", "left")
        .withColumn("sequence", F.col("_rn") + F.coalesce("_last", F.lit(0)))
        .drop("_rn", "_last")
    )


def cancel_event_type(kind: Column) -> Column:
    """K8: event type of a cancellation by job kind."""
    out = None
    for k, v in CANCEL_EVENTS.items():
        out = (F if out is None else out).when(kind == k, F.lit(v))
    return out


def states_before(jobs: DataFrame, requests: DataFrame, width: int = 1024) -> DataFrame:
    """State of its job before each request: job_id, sequence, from_status. ``requests``: job_id, sequence (unique
    integer per job), target (status).

    A status step is a function on six states, and functions compose: each bucket of requests is reduced to where it
    leads from every state, buckets are composed on one row each, and then every bucket is replayed from its true
    start. No job has to fit into one task."""
    def step(s: Column, target: Column) -> Column:
        return F.when(legal_edge(s, target), target).otherwise(s)

    def lead(items: str, move) -> Column:
        """Where ``items`` lead from each state."""
        return F.create_map(*[
            x for s in STATUSES for x in (F.lit(s), F.aggregate(items, F.lit(s), lambda acc, r: move(acc, r)))
        ])

    def walk(items: str, first: Column, move, pos: str) -> Column:
        """(position, state before it) for each of ``items``."""
        empty = F.array().cast("array<struct<pos:bigint,s:string>>")
        return F.aggregate(
            items, F.struct(first.alias("s"), empty.alias("o")),
            lambda acc, r: F.struct(
                move(acc["s"], r).alias("s"),
                F.concat(acc["o"], F.array(F.struct(r[pos].alias("pos"), acc["s"].alias("s")))).alias("o"),
            ),
            lambda acc: acc["o"],
        )

    def by_target(s: Column, r: Column) -> Column:
        return step(s, r["target"])

    def by_map(s: Column, r: Column) -> Column:
        return F.element_at(r["m"], s)

    def pack(df: DataFrame, keys: list[str], *cols) -> DataFrame:
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("_r"))

    leaf = pack(requests.withColumn("_b", bucket_of("sequence", width)), ["job_id", "_b"], "sequence", "target")
    low = leaf.select("job_id", "_b", lead("_r", by_target).alias("m")).withColumn("_bb", bucket_of("_b", width))

    def maps(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
        # maps do not sort; order by position alone
        return df.groupBy(*keys).agg(F.collect_list(F.struct(F.col(pos).alias("b"), "m")).alias("_r")).withColumn(
            "_r", F.array_sort("_r", lambda x, y: (x["b"] - y["b"]).cast("int"))
        )

    mid = maps(low, ["job_id", "_bb"], "_b")
    top = maps(mid.select("job_id", "_bb", lead("_r", by_map).alias("m")), ["job_id"], "_bb")
    top = top.join(jobs.select("job_id", F.col("status").alias("_s0")), "job_id")
    at_mid = top.select("job_id", F.inline(walk("_r", F.col("_s0"), by_map, "b")).alias("_bb", "_start"))
    at_low = mid.join(at_mid, ["job_id", "_bb"]).select(
        "job_id", F.inline(walk("_r", F.col("_start"), by_map, "b")).alias("_b", "_start")
    )
    return leaf.join(at_low, ["job_id", "_b"]).select(
        "job_id", F.inline(walk("_r", F.col("_start"), by_target, "sequence")).alias("sequence", "from_status")
    )


def replay_jobs(jobs: DataFrame, requests: DataFrame, width: int = 1024) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs after the requests, events, refused requests).

    ``requests``: job_id, sequence (unique integer per job), target (status), at, reason, code. No job has to fit
    into one task (``states_before``)."""
    rows = requests.join(states_before(jobs, requests, width), ["job_id", "sequence"])
    changed = F.col("from_status") != F.col("target")
    legal = legal_edge(F.col("from_status"), F.col("target"))
    done = rows.filter(changed & legal)
    event = (
        F.when(F.col("target") == "running", F.when(F.col("from_status") == "paused", "analysis_job_resumed").otherwise("analysis_job_started"))
        .when(F.col("target") == "paused", "analysis_job_paused")
        .when(F.col("target") == "completed", "analysis_job_completed")
        .when(F.col("target") == "cancelled", "analysis_job_cancelled")
        .otherwise(F.concat(F.lit("analysis_job_"), F.col("target")))
    )
    events = done.select("job_id", "sequence", event.alias("event_type"), "from_status", F.col("target").alias("to_status"))
    t = F.col("target")
    clears = t.isin("running", "completed")
    last = done.groupBy("job_id").agg(
        F.max_by("target", "sequence").alias("_status"),
        F.min_by(F.when(t == "running", F.col("at")), F.when(t == "running", F.col("sequence"))).alias("_started"),
        F.max_by(
            F.struct(F.when(t != "running", F.col("at")).alias("v")),
            F.when(t.isin("running", "completed", "cancelled"), F.col("sequence")),
        ).alias("_fin"),
        F.max_by(
            F.struct(F.when(~clears, F.col("code")).alias("code"), F.when(~clears, F.col("reason")).alias("reason")),
            F.when(clears | (t == "paused"), F.col("sequence")),
        ).alias("_err"),
    )
    after = jobs.join(last, "job_id", "left").select(
        "job_id",
        F.coalesce("_status", "status").alias("status"),
        F.coalesce("started_at", "_started").alias("started_at"),
        F.when(F.col("_fin").isNotNull(), F.col("_fin.v")).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(F.col("_err").isNotNull(), F.col("_err.code")).otherwise(F.col("error_code")).alias("error_code"),
        F.when(F.col("_err").isNotNull(), F.col("_err.reason")).otherwise(F.col("error_message")).alias("error_message"),
    )
    refused = rows.filter(~legal).select("job_id", "sequence", "from_status", F.col("target").alias("to_status"))
    return after, events, refused


def start_runs(runs: DataFrame, starts: DataFrame) -> DataFrame:
    """Upsert a run per (job, chapter): attempt + 1, output and errors cleared."""
    started = F.col("_started").isNotNull()
    s = starts.select("job_id", "chapter_id", F.col("chapter_num").alias("_num"), F.col("at").alias("_started"))
    j = runs.join(s, ["job_id", "chapter_id"], "full")

    def cleared(c: str) -> Column:
        return F.when(~started, F.col(c)).alias(c)

    return j.select(
        "job_id", "chapter_id", F.coalesce("chapter_num", "_num").alias("chapter_num"),
        F.when(started, F.lit("running")).otherwise(F.col("status")).alias("status"),
        (F.coalesce("attempt", F.lit(0)) + started.cast("long")).alias("attempt"),
        cleared("output_json"), cleared("error_code"), cleared("error_message"),
    )


def finish_runs(runs: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs after, events). ``results``: job_id, chapter_id, ok, output, code, message."""
    r = results.select(
        "job_id", "chapter_id", F.col("ok").alias("_ok"), F.col("output").alias("_out"),
        F.col("code").alias("_code"), F.col("message").alias("_msg"),
    )
    j = runs.join(r, ["job_id", "chapter_id"], "left")
    hit, ok = F.col("_ok").isNotNull(), F.col("_ok")
    status = F.when(~hit, F.col("status")).when(ok, F.lit("completed")).otherwise(F.lit("failed"))
    after = j.select(
        "job_id", "chapter_id", "chapter_num", status.alias("status"), "attempt",
        F.when(hit & ok, F.col("_out")).otherwise(F.col("output_json")).alias("output_json"),
        F.when(~hit, F.col("error_code")).when(~ok, F.col("_code")).alias("error_code"),
        F.when(~hit, F.col("error_message")).when(~ok, F.col("_msg")).alias("error_message"),
    )
    events = j.filter(hit).select(
        "job_id", "chapter_id", "chapter_num", "attempt",
        F.when(ok, F.lit("analysis_chapter_completed")).otherwise(F.lit("analysis_chapter_failed")).alias("event_type"),
    )
    return after, events


def reset_runs(runs: DataFrame, jobs: DataFrame, resets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, jobs) after the resets. ``resets``: job_id, from_num, to_num; no bounds = all chapters.
    ``reset_records`` does the same to records, what belongs to them and the alias map."""
    hit = F.col("_hit").isNotNull()
    j = jobs.join(resets.select("job_id", F.lit(1).alias("_hit")).distinct(), "job_id", "left")
    cols = [c for c in ("started_at", "finished_at", "error_code", "error_message") if c in jobs.columns]
    after = j.select(*[
        F.when(hit, F.lit("pending")).otherwise(F.col(c)).alias(c) if c == "status"
        else F.when(~hit, F.col(c)).alias(c) if c in cols else F.col(c)
        for c in jobs.columns
    ])
    return outside(runs, resets), after


def _within(rows: DataFrame, resets: DataFrame, job: Sequence[str], how: str) -> DataFrame:
    r = resets.select(*(F.col(c).alias(f"_r_{c}") for c in job), F.col("from_num").alias("_f"), F.col("to_num").alias("_t"))
    hit = (F.col("chapter_num") >= F.coalesce("_f", "chapter_num")) & (F.col("chapter_num") <= F.coalesce("_t", "chapter_num"))
    for c in job:
        hit = hit & (F.col(c) == F.col(f"_r_{c}"))
    return rows.join(r, hit, how)


def outside(rows: DataFrame, resets: DataFrame, job: Sequence[str] = ("job_id",)) -> DataFrame:
    """Rows (job, chapter_num and more) in no range of ``resets``."""
    return _within(rows, resets, job, "left_anti")


def reset_records(
    records: DataFrame, parts: dict[str, DataFrame], values: DataFrame, aliases: DataFrame, resets: DataFrame, job: Sequence[str] = ("job_id",)
) -> dict[str, DataFrame]:
    """K13 for what an analysis has written: ``records`` of reset chapters go, with them the rows of ``parts`` and
    ``values`` (by record_id), and the alias map is kept up by what left (J1)."""
    gone = _within(records, resets, job, "left_semi").select(*job, "record_id")
    out = {name: df.join(gone.select("record_id"), "record_id", "left_anti") for name, df in {**parts, "values": values}.items()}
    return {**out, "records": outside(records, resets, job), "aliases": retract_records(aliases, records, values, gone, job)}


def latest_job(jobs: DataFrame) -> DataFrame:
    """Newest job of each novel by created_at, then id."""
    return jobs.groupBy("novel_id").agg(
        F.max_by(F.struct("job_id", "status", "created_at"), F.struct("created_at", "job_id")).alias("_j")
    ).select("novel_id", "_j.*")


def active_novel(novels: DataFrame) -> DataFrame:
    """Newest-updated novel of each project."""
    return novels.groupBy("project_id").agg(
        F.max_by(F.struct("novel_id", "title", "source_language"), F.struct("updated_at", "created_at", "novel_id")).alias("_n")
    ).select("project_id", "_n.*")


def workspace_snapshot(
    projects: DataFrame, novels: DataFrame, chapters: DataFrame, jobs: DataFrame, runs: DataFrame, events: DataFrame
) -> DataFrame:
    """One flat row per active project: novel in use, its latest job and what belongs to them.
    ``workspace_lists`` has the lists behind the counts."""
    base = (
        projects.filter(F.col("deleted_at").isNull()).select("project_id", "name")
        .join(active_novel(novels), "project_id", "left")
        .join(latest_job(jobs).withColumnRenamed("status", "job_status").drop("created_at"), "novel_id", "left")
    )
    n_chapters = chapters.groupBy("novel_id").agg(_rows().alias("chapter_count"))
    n_runs = runs.groupBy("job_id").agg(_rows().alias("run_count"), F.count_if(F.col("status") == "completed").alias("completed_count"))
    n_events = events.groupBy("job_id").agg(_rows().alias("event_count"), F.max("sequence").alias("last_sequence"))
    return (
        base.join(n_chapters, "novel_id", "left").join(n_runs, "job_id", "left").join(n_events, "job_id", "left")
        .fillna(0, ["chapter_count", "run_count", "completed_count", "event_count"])
    )


def workspace_lists(projects: DataFrame, novels: DataFrame, jobs: DataFrame, lists: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The lists of the snapshot of each active project, one flat view each: the rows of the novel in use or, where a
    list has a job_id, of its latest job. Every list keeps its columns and gets project_id first."""
    active = active_novel(novels).select("project_id", "novel_id")
    base = projects.filter(F.col("deleted_at").isNull()).select("project_id").join(active, "project_id")
    latest = latest_job(jobs).select("novel_id", "job_id")
    of_job = base.join(latest, "novel_id").select("project_id", "job_id")
    out = {}
    for name, rows in lists.items():
        key, owner = ("job_id", of_job) if "job_id" in rows.columns else ("novel_id", base)
        out[name] = rows.join(owner.withColumnRenamed("project_id", "_project"), key).select(F.col("_project").alias("project_id"), *rows.columns)
    return out


def estimate_cost(usage: DataFrame) -> DataFrame:
    """Cost per usage row; unknown token counts give no cost."""
    model = F.lower(trim_ws(F.col("model")))

    def cost(i: float, o: float) -> Column:
        return F.col("input_tokens") / 1000000.0 * i + F.col("output_tokens") / 1000000.0 * o

    (pattern, pi, po), (_, di, do) = PRICES
    return usage.withColumn("estimated_cost", F.when(F.contains(model, F.lit(pattern)), cost(pi, po)).otherwise(cost(di, do)))


def usage_totals(usage: DataFrame) -> DataFrame:
    """Tokens and cost per job and model with subtotals; a null count does not spoil a sum."""
    return estimate_cost(usage).rollup("job_id", "model").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("estimated_cost").alias("estimated_cost"),
    )


def project_stage(novel_id: Column, job_status: Column) -> Column:
    return (
        F.when(novel_id.isNull(), F.lit("No novel imported")).when(job_status.isNull(), F.lit("Novel ready"))
        .otherwise(F.replace(job_status, F.lit("_"), F.lit(" ")))
    )


def project_cards(projects: DataFrame, novels: DataFrame, chapters: DataFrame, jobs: DataFrame, text_col: str = "content") -> DataFrame:
    """The card of each active project."""
    words = chapters.groupBy("novel_id").agg(
        _rows().alias("chapter_count"), F.sum(word_count(F.col(text_col))).alias("word_count")
    )
    lang = F.coalesce("source_language", F.lit("Not set"))
    return (
        projects.filter(F.col("deleted_at").isNull()).select("project_id", "name")
        .join(active_novel(novels), "project_id", "left")
        .join(latest_job(jobs).select("novel_id", F.col("status").alias("job_status")), "novel_id", "left")
        .join(words, "novel_id", "left")
        .fillna(0, ["chapter_count", "word_count"])
        .select(
            "project_id", "name", "chapter_count", "word_count", lang.alias("source_language"),
            project_stage(F.col("novel_id"), F.col("job_status")).alias("stage"),
            F.array(
                F.when(F.col("novel_id").isNotNull(), F.lit("Imported")).otherwise(F.lit("Empty")),
                F.coalesce(F.concat(F.lit("Analysis "), F.col("job_status")), F.lit("No analysis job")), lang,
            ).alias("tags"),
        )
    )


def event_labels(events: DataFrame) -> DataFrame:
    """Readable label and the first three payload entries of each event."""
    entries = F.from_json("payload_json", "map<string,string>")
    pairs = F.transform(F.slice(F.map_entries(entries), 1, 3), lambda e: F.concat_ws(": ", e["key"], F.coalesce(e["value"], F.lit("null"))))
    return events.select(
        "job_id", "sequence", F.replace("event_type", F.lit("_"), F.lit(" ")).alias("label"),
        F.when(~is_json(F.col("payload_json")), F.col("payload_json"))
        .otherwise(F.concat_ws(" · ", pairs)).alias("summary"),
    )


def create_translation_jobs(requests: DataFrame, novels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, first events, errors)."""
    target = blank_to_null(F.col("target_language"))
    r = requests.join(novels.select("novel_id", F.col("source_language").alias("_lang"), F.lit(1).alias("_known")), "novel_id", "left")
    r = r.withColumn(
        "error", F.when(F.col("_known").isNull(), F.lit("novel_not_found")).when(target.isNull(), F.lit("target_language_required"))
    )
    jobs = r.filter("error IS NULL").select(
        F.sha2(F.concat_ws("|", F.lit("translation"), F.col("request_id").cast("string")), 256).alias("job_id"), "request_id", "novel_id",
        F.coalesce(blank_to_null(F.col("source_language")), F.col("_lang")).alias("source_language"),
        target.alias("target_language"), F.lit("pending").alias("status"),
    )
    events = jobs.select("job_id", F.lit(1).cast("long").alias("sequence"), F.lit("translation_job_created").alias("event_type"))
    return jobs, events, r.filter("error IS NOT NULL").select("request_id", "novel_id", "error")


def progress(states: DataFrame) -> DataFrame:
    """Percent done and the last chapter with telemetry, per job."""
    return states.groupBy("job_id").agg(
        _rows().alias("total"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.max(F.when(F.col("api_call_count").isNotNull() | F.col("provider").isNotNull(), F.col("chapter_num"))).alias("last_reported_chapter"),
    ).withColumn("percent", F.floor(F.col("completed") * 100.0 / F.col("total") + 0.5).cast("long"))


def of_active_projects(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Lists of an archived project read as empty."""
    return rows.join(projects.filter(F.col("deleted_at").isNull()).select("project_id"), "project_id", "left_semi")


