"""Structured Streaming jobs. Each micro-batch runs the batch operators over what is new and over the
state of the touched keys only, so one hot job is spread over tasks like any other data.

State per key (job status, newest run of a chapter) is kept by Spark's state store; tables that are rewritten chapter
by chapter lie in ``sources.tables``, one folder per micro-batch.
No event time is used: the reference order is the sequence number of a job.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loreweave.operators import oneshot as O
from loreweave.operators import runs as R
from loreweave.operators.aliases import rebuild_alias_map
from loreweave.sources import corpus as C
from loreweave.session import cut_lineage
from loreweave.sources.tables import LogTable, VersionedTable


def run_batches(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], mode: str = "append", **trigger) -> StreamingQuery:
    """Start a stream that hands every micro-batch to ``step``. Without a trigger, what is there is read
    once."""
    trigger = trigger or {"availableNow": True}
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).outputMode(mode).foreachBatch(step).start()


# --- N1 ----------------------------------------------------------------------------------------

JOB_STEPS = "sequence bigint, from_status string, to_status string, applied boolean"


def job_steps(steps: DataFrame) -> DataFrame:
    """What becomes of each step (job_id, sequence, status) of a stream: job_id, sequence, from_status, to_status
    and applied. A step that repeats or comes after a later one gives no row, an illegal one is not applied and changes
    nothing. Jobs start as pending. Spark keeps status and last sequence per job as keyed state. The steps of a job in a
    micro-batch are held in one task; ``job_step`` has no such limit."""
    key = steps.schema["job_id"].dataType.simpleString()

    def apply(job: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, last = state.get if state.exists else ("pending", None)
        new = pd.concat(list(frames)).groupby("sequence")["status"].min().sort_index()
        out = []
        for sequence, target in new.items() if last is None else new[new.index > last].items():
            legal = status == target or (status, target) in R.EDGES
            out.append((job[0], sequence, status, target, legal))
            status, last = target if legal else status, int(sequence)
        if out:
            state.update((status, last))
        yield pd.DataFrame(out, columns=["job_id", "sequence", "from_status", "to_status", "applied"])

    return steps.groupBy("job_id").applyInPandasWithState(
        apply, f"job_id {key}, {JOB_STEPS}", "status string, last_sequence bigint", "append", GroupStateTimeout.NoTimeout)


def job_step(path: str) -> Callable[[DataFrame, int], None]:
    """N1 per micro-batch: the rows of ``job_steps``, for jobs of any size. A micro-batch is replayed natively in buckets
    of the sequence, from one row of state per job, so no task holds the steps of a job. Tables: ``job_tables``."""
    out, state = job_tables(path)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # in a struct, so that steps without a job are a job too, as in a group
        new = batch.filter("sequence IS NOT NULL").groupBy(F.struct("job_id").alias("job_id"), "sequence").agg(F.min("status").alias("target"))
        before = state.latest(spark, batch_id)
        if before is None:
            new = new.withColumn("status", F.lit("pending"))
        else:
            new = new.join(before, "job_id", "left").filter("last_sequence IS NULL OR sequence > last_sequence")
            new = new.withColumn("status", F.coalesce("status", F.lit("pending"))).drop("last_sequence")
        new = cut_lineage(new)
        jobs = new.groupBy("job_id").agg(F.first("status").alias("status"))
        steps = new.drop("status")
        s, t = F.col("from_status"), F.col("target")
        rows = steps.join(R.states_before(jobs, steps), ["job_id", "sequence"])
        rows = cut_lineage(rows.select("job_id", "sequence", s, t.alias("to_status"), F.coalesce(R.legal_edge(s, t), F.lit(False)).alias("applied")))
        out.append(rows.withColumn("job_id", F.col("job_id.job_id")), batch_id)
        state.append(job_state(rows), batch_id)

    return step


def job_tables(path: str) -> tuple[LogTable, LogTable]:
    return LogTable(f"{path}/steps", ["job_id", "sequence"]), LogTable(f"{path}/state", ["job_id"])


def job_state(steps: DataFrame) -> DataFrame:
    """Status and last sequence per job, of the rows that ``job_steps`` wrote."""
    after = F.when(F.col("applied"), F.col("to_status")).otherwise(F.col("from_status"))
    return steps.groupBy("job_id").agg(F.max_by(after, "sequence").alias("status"), F.max("sequence").alias("last_sequence"))


def append_to(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the rows of a stream to files, each once. Without a trigger, what is there is read once."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)


# --- N2 ----------------------------------------------------------------------------------------


def project_feed(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """The events of subscribed projects; on tables and on streams."""
    return events.join(subscribers.select("project_id"), "project_id", "left_semi").select("project_id", "event_type", "sequence")


# --- N3 ----------------------------------------------------------------------------------------


def extraction_step(chapters: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """New model answers go through the one-shot path, replace what their chapter had before, and
    refresh the alias map of the jobs they touch. ``chapters``: job_id, chapter_id, chapter_num, content.
    Tables under ``path``: records and values per chapter, aliases per job."""
    records, values, aliases = extraction_tables(path)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        docs, _ = C.read_model_outputs(batch)
        here = chapters.join(batch.select("chapter_id").distinct(), "chapter_id", "left_semi")
        rec, val = extract_tables(docs, here)
        done = here.select("job_id", "chapter_id")
        records.replace(rec, done, batch_id)
        values.replace(val, done, batch_id)
        jobs = done.select("job_id").distinct()
        # up to this batch only, so that a retry sees the same tables
        now = records.current(spark, batch_id, jobs).filter("group_key = 'character'")
        said = values.current(spark, batch_id, jobs).drop("job_id", "chapter_num", "chapter_id")
        aliases.replace(rebuild_alias_map(now, said), jobs, batch_id)

    return step


def extraction_tables(path: str) -> tuple[VersionedTable, VersionedTable, VersionedTable]:
    return (VersionedTable(f"{path}/records", ["job_id", "chapter_id"]), VersionedTable(f"{path}/values", ["job_id", "chapter_id"]),
            VersionedTable(f"{path}/aliases", ["job_id"]))


def extract_tables(docs: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I1 to I9 over nested documents: (records, values), flat, with job_id and chapter_num."""
    ok, _ = O.check_document_header(docs, chapters)
    characters, relationships = C.flatten_outputs(ok)
    # each part is read several times below
    built = {k: cut_lineage(v) for k, v in O.build_character_records(cut_lineage(characters), chapters).items()}
    done = O.apply_record_merges(built, cut_lineage(O.merge_probable_aliases(built["records"], built["mentions"], built["values"])))
    lists = done["values"].filter("field_key = 'other_alias'").groupBy("chapter_id", "record_ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "pos", "value_text"))), lambda x: x["value_text"]).alias("aliases"))
    ids = done["records"].join(lists, ["chapter_id", "record_ord"], "left").select(
        "chapter_id", F.col("record_ord").alias("ord"), F.col("display_name").alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    related = O.build_relationship_records(relationships, ids, chapters)
    place = chapters.select("chapter_id", "job_id", "chapter_num")

    def rid(df: DataFrame) -> DataFrame:
        return df.join(place, "chapter_id").withColumn("record_id", F.concat_ws("/", F.col("job_id").cast("string"), F.col("chapter_id").cast("string"), "entity_key"))

    rec = rid(done["records"].withColumn("group_key", F.lit("character"))).unionByName(rid(related["records"].withColumn("group_key", F.lit("relationship"))))
    rec = rec.select("record_id", "chapter_id", "group_key", "entity_key", "display_name", "record_ord", "job_id", "chapter_num")
    key = done["records"].select("chapter_id", "record_ord", "entity_key")
    none = F.lit(None).cast("string")
    own = rid(done["values"].join(key, ["chapter_id", "record_ord"])).select(
        "record_id", "field_key", F.col("field_key").alias("field_label"), F.struct(F.col("ord").cast("long").alias("o"), F.col("pos").cast("long").alias("p")).alias("pos"), "value_text", "confidence",
        *[none.alias(c) for c in ("related_character", "relationship_type", "relationship_direction")], "evidence", "job_id", "chapter_id", "chapter_num")
    rel = rid(related["values"]).select(
        "record_id", F.lit("relationship").alias("field_key"), F.lit("relationship").alias("field_label"), F.struct(F.lit(0).cast("long").alias("o"), F.col("pos").cast("long").alias("p")).alias("pos"), F.col("value").alias("value_text"), "confidence",
        F.col("related").alias("related_character"), F.col("rtype").alias("relationship_type"), F.col("direction").alias("relationship_direction"), "evidence", "job_id", "chapter_id", "chapter_num")
    return rec, own.unionByName(rel)


# --- N4 ----------------------------------------------------------------------------------------


def latest_chapter_runs(events: DataFrame) -> DataFrame:
    """Newest status of each chapter of a job, of a stream of run events (job_id, chapter_id, sequence, status);
    Spark keeps it as state of the aggregate. For output mode ``update``: changed chapters of each micro-batch."""
    return events.groupBy("job_id", "chapter_id").agg(F.max_by("status", "sequence").alias("status"), F.max("sequence").alias("sequence"))


def progress_step(log: LogTable) -> Callable[[DataFrame, int], None]:
    """Sink of ``latest_chapter_runs``: the changed chapters of a micro-batch."""
    return lambda batch, batch_id: log.append(batch, batch_id)


def progress(latest: DataFrame) -> DataFrame:
    """Chapter counts per job."""
    return latest.groupBy("job_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "completed", "failed")])
