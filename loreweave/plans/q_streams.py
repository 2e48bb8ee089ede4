"""Queries over streams (N): the given tables read as streams to their end, state returned as a table."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loreweave.operators import runs as R
from loreweave.plans import inputs as I
from loreweave.plans import sqlkit as Q
from loreweave.plans.q_oneshot import _CC, _FLD, _I3, CH, OC, model_outputs
from loreweave.plans.registry import query
from loreweave.session import ensure_checkpoint_dir
from loreweave.streaming import streams as N


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    schema = I.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _status():
    e = F.col("event_type")
    return F.when(e == "signup", "pending").when(e == "view", "running").when(e == "click", "paused").when(e == "purchase", "completed").otherwise("failed")


_LEGAL = " OR ".join(["w.s = req.status"] + ["(w.s = '%s' AND req.status = '%s')" % e for e in R.EDGES])
# steps arrive in three micro-batches: the earlier half, the later half, and late ones; a step at or before the last
# one of its job in an earlier micro-batch is ignored
_PART = "CASE WHEN sequence % 17 = 3 THEN 2 WHEN sequence <= (SELECT max(event_id) // 2 FROM events) THEN 0 ELSE 1 END"
_N1 = f"""WITH RECURSIVE arr AS (SELECT *, {_PART} AS b FROM {I.duck(I.history)}),
fresh AS (SELECT * FROM arr QUALIFY sequence > coalesce(max(sequence) OVER (PARTITION BY job_id ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)),
req AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sequence) AS n FROM fresh),
w AS (SELECT DISTINCT job_id, 0::BIGINT AS n, 0::BIGINT AS sequence, 'pending' AS was, '' AS target, 'pending' AS s FROM req
 UNION ALL SELECT req.job_id, req.n, req.sequence, w.s, req.status, CASE WHEN {_LEGAL} THEN req.status ELSE w.s END FROM w JOIN req ON req.job_id = w.job_id AND req.n = w.n + 1)"""


def _arrivals(spark, base, parts, start):
    """Each part is written and the stream started anew, so that every part is a micro-batch after a restart."""
    for part in parts:
        part.write.mode("append").parquet(f"{base}/incoming")
        start(spark.readStream.schema(part.schema).parquet(f"{base}/incoming")).awaitTermination()


def _job_steps(spark, sf):
    base = _folder(spark, "job-state")
    e = I.table(spark, sf, "events")
    half = e.agg(F.max("event_id")).first()[0] // 2
    steps = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("sequence"), _status().alias("status"))
    s, late = F.col("sequence"), F.col("sequence") % 17 == 3
    first = steps.filter(~late & (s <= half))
    again = first.filter(s % 10 == 0)
    parts = [first, steps.filter(~late & (s > half)).unionByName(again), steps.filter(late).unionByName(again)]
    _arrivals(spark, base, parts, lambda stream: N.run_batches(stream, f"{base}/checkpoint", N.job_step(f"{base}/tables")))
    return N.job_tables(f"{base}/tables")[0].rows(spark).drop("batch_id")


@query("n1_job_state_stream", _N1 + " SELECT job_id, max_by(s, n) AS status, max(sequence) AS last_sequence FROM w GROUP BY 1")
def n1(spark, sf):
    return N.job_state(_job_steps(spark, sf))


@query("n1_job_state_violations", _N1 + " SELECT job_id, sequence, was AS from_status, target AS to_status FROM w WHERE n > 0 AND s <> target")
def n1_violations(spark, sf):
    return _job_steps(spark, sf).filter("NOT applied").drop("applied")


_N2 = "SELECT user_id % 40 AS project_id, event_type, event_id AS sequence FROM events WHERE user_id % 40 IN (SELECT n_nationkey FROM nation)"


def _feed(df):
    return df.select((F.col("user_id") % 40).alias("project_id"), F.col("event_id").alias("sequence"), "event_type")


def _subscribers(spark, sf):
    return I.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"))


@query("n2_project_feed", _N2)
def n2(spark, sf):
    return N.project_feed(_feed(I.table(spark, sf, "events")), _subscribers(spark, sf))


@query("n2_project_feed_stream", _N2)
def n2_stream(spark, sf):
    base = _folder(spark, "feed")
    feed = N.project_feed(_feed(_stream(spark, sf, "events")), _subscribers(spark, sf))
    N.append_to(feed, f"{base}/feed", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/feed")


_ANSWERED = f"(SELECT * FROM {OC} WHERE chapter_id % 10 <> 9)"
_N3 = f"""{_CC.replace(OC, _ANSWERED)}, {_FLD}, {_I3}, left3 AS (SELECT r.*, novel_id AS job_id, novel_id || '/' || r.chapter_id || '/' || entity_key AS record_id FROM rec r JOIN (SELECT chapter_id, novel_id FROM {CH}) c ON c.chapter_id = r.chapter_id
 WHERE (r.chapter_id, record_ord) NOT IN (SELECT (chapter_id, source_ord) FROM mrg3)),
own3 AS (SELECT own.chapter_id, own.ord, coalesce(final_ord, own.record_ord) AS record_ord FROM own LEFT JOIN mrg3 ON mrg3.chapter_id = own.chapter_id AND mrg3.source_ord = own.record_ord),
src3 AS (SELECT job_id, entity_key, display_name AS alias_text, chapter_id, (chapter_id, display_name, record_id, '', -1, -1) AS o FROM left3
 UNION ALL SELECT job_id, entity_key, text, l.chapter_id, (l.chapter_id, display_name, record_id, 'other_alias', al.ord, al.pos) FROM left3 l JOIN own3 ON own3.chapter_id = l.chapter_id AND own3.record_ord = l.record_ord JOIN al ON al.chapter_id = l.chapter_id AND al.ord = own3.ord
  WHERE {Q.alnum('text')} > 3 AND {Q.fkey('text')} <> {Q.fkey('display_name')})"""


@query("n3_incremental_extraction", f"WITH RECURSIVE {_N3} SELECT job_id, entity_key, alias_key, min_by(alias_text, o) AS alias_text, min(chapter_id) AS first_chapter_num, 1.0::DOUBLE AS confidence FROM (SELECT *, {Q.fkey('alias_text')} AS alias_key FROM src3) WHERE alias_key <> '' GROUP BY 1, 2, 3")
def n3(spark, sf):
    """Answers arrive in two micro-batches with a restart between them; the second also rewrites chapters of the first,
    whose earlier answers name more characters."""
    base, answers, n = _folder(spark, "extraction"), model_outputs(spark, sf), F.col("chapter_id")
    earlier = answers.filter((n % 5 == 0) & (n % 4 != 1)).withColumn("json_text", F.replace("json_text", F.lit('"uncertain"'), F.lit('"person"')))
    parts = [answers.filter((n % 5 != 0) & (n % 4 != 1)).unionByName(earlier), answers.filter((n % 5 == 0) | (n % 4 == 1))]
    chapters = I.run(spark, sf, I.chapters).select(F.col("novel_id").alias("job_id"), "chapter_id", "chapter_num", "content")
    _arrivals(spark, base, parts, lambda stream: N.run_batches(stream, f"{base}/checkpoint", N.extraction_step(chapters, f"{base}/tables")))
    return N.extraction_tables(f"{base}/tables")[2].current(spark).select("job_id", "entity_key", "alias_key", "alias_text", "first_chapter_num", "confidence")


_N4 = """WITH l AS (SELECT o_custkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'P' ELSE o_orderstatus END AS st FROM orders)
SELECT job_id, count(*) FILTER (st = 'P') AS pending, count(*) FILTER (st = 'O') AS running, count(*) FILTER (st = 'F') AS completed, 0 AS failed FROM l GROUP BY 1"""


@query("n4_progress_stream", _N4)
def n4(spark, sf):
    """All chapters start as pending, two of three move on, then repeated and late events arrive."""
    base = _folder(spark, "progress")
    log = N.LogTable(f"{base}/runs", ["job_id", "chapter_id"])
    o, key = I.table(spark, sf, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("pending")

    def events(rows, at, state):
        return rows.select(F.col("o_custkey").alias("job_id"), key.alias("chapter_id"), (key * 10 + at).alias("sequence"), state.alias("status"))

    first, second = events(o, 1, F.lit("pending")), events(o.filter(key % 3 != 0), 2, status)
    late = events(o.filter(key % 5 == 0), 0, F.lit("failed")).unionByName(second.filter(F.col("chapter_id") % 7 == 0))
    _arrivals(spark, base, [first, second, late], lambda stream: N.run_batches(
        N.latest_chapter_runs(stream), f"{base}/checkpoint", N.progress_step(log), mode="update"))
    return N.progress(log.latest(spark))
