"""Sources: text files, raw novels and model documents, as flat tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import keys as K
from loreweave.operators.modeltext import extract_json_block, parse_tolerant_json
from loreweave.operators.segment import detect_language, split_chapters, split_segments

# --- Fixed values -------------------------------------------------------------------------
JOB_TYPE, JOB_EVENT = "chapter_analysis_batch", "analysis_job_created"
_FIELD = "struct<field_key:string,field_label:string,value:string,semantic_class:string,evidence_quotes:array<string>,confidence:double>"
RESPONSE = (
    "struct<schema_version:string,chapter_num:bigint,call_profile:string,"
    f"characters:array<struct<display_name:string,aliases:array<string>,entity_nature:string,fields:array<{_FIELD}>,"
    "evidence_quotes:array<string>,confidence:double>>,"
    "relationships:array<struct<source_name:string,target_name:string,relationship_scope:string,relationship_type:string,"
    "source_to_target_label:string,target_to_source_label:string,evidence_quotes:array<string>,confidence:double>>,"
    "review_items:array<string>>"
)
# ------------------------------------------------------------------------------------------


def stable_id(prefix: str, *cols: Column) -> Column:
    """Deterministic id: the same input row gets the same id on every attempt."""
    return F.concat(F.lit(prefix + "_"), F.left(F.sha2(F.concat_ws("\x1f", *[c.cast("string") for c in cols]), 256), F.lit(32)))


def read_text_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A1: (texts, rejected files). One TXT or Markdown file is one novel; a file without text is
    rejected; the title is the file name without its ending."""
    files = spark.read.text(path, wholetext=True).withColumn("source_id", F.col("_metadata.file_path")).withColumnRenamed("value", "text")
    name = F.url_decode(F.substring_index("source_id", "/", -1))
    t = files.select("source_id", F.regexp_replace(name, r"\.[^.]*\z", "").alias("title"), "text")
    return t.filter(~K.is_blank(F.col("text"))), t.filter(K.is_blank(F.col("text"))).select("source_id", "title")


def source_language(given: Column, text: Column) -> Column:
    """Given language, or the guess from the text where it is blank, ``auto`` or ``detect``."""
    g = K.blank_to_null(given)
    return F.when(g.isNull() | g.isin("auto", "detect"), detect_language(text)).otherwise(g)


def import_novels(raw: DataFrame) -> dict[str, DataFrame]:
    """A2: novels, chapters, segments, jobs, job_events and errors.

    ``raw``: source_key (unique), project_id, title, text and optionally author, source_language, genre,
    description. Title and text are trimmed before the text is split. One job per novel."""
    for c in ("author", "source_language", "genre", "description"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    t, x = K.blank_to_null(F.col("title")), K.blank_to_null(F.col("text"))
    r = raw.withColumn("title", t).withColumn("text", x)
    error = F.when(F.col("title").isNull(), F.lit("title_required")).when(F.col("text").isNull(), F.lit("text_required"))
    errors = r.withColumn("error", error).filter("error IS NOT NULL").select("source_key", "error")
    ok = r.filter("title IS NOT NULL AND text IS NOT NULL").withColumn("novel_id", stable_id("novel", F.col("project_id"), F.col("source_key")))
    novels = ok.select(
        "novel_id", "project_id", "source_key", "title", K.blank_to_null(F.col("author")).alias("author"),
        source_language(F.col("source_language"), F.col("text")).alias("source_language"),
        K.blank_to_null(F.col("genre")).alias("genre"), K.blank_to_null(F.col("description")).alias("description"))
    chapters = split_chapters(ok).withColumn("chapter_id", stable_id("chap", F.col("novel_id"), F.col("chapter_num")))
    segments = split_segments(chapters).withColumn("kind", F.lit("paragraph")).withColumn(
        "segment_id", stable_id("seg", F.col("chapter_id"), F.col("segment_index")))
    n_seg = segments.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("_n"))
    counts = chapters.select("novel_id", "chapter_id").join(n_seg, "chapter_id", "left").groupBy("novel_id").agg(
        F.count(F.lit(1)).alias("chapter_count"), F.coalesce(F.sum("_n"), F.lit(0)).alias("source_segment_count"))
    jobs = ok.select(
        stable_id("job", F.col("novel_id")).alias("job_id"), "project_id", "novel_id", F.lit(JOB_TYPE).alias("job_type"), F.lit("pending").alias("status"),
        F.to_json(F.struct("novel_id", F.lit("import_confirm").alias("source"))).alias("payload_json"))
    events = jobs.select("job_id", "project_id", "novel_id").join(counts, "novel_id").select(
        "job_id", "project_id", F.lit("analysis").alias("job_kind"), F.lit(1).cast("long").alias("sequence"), F.lit(JOB_EVENT).alias("event_type"),
        F.to_json(F.struct("novel_id", "chapter_count", "source_segment_count")).alias("payload_json"), "chapter_count", "source_segment_count")
    return {"novels": novels, "chapters": chapters, "segments": segments, "jobs": jobs, "job_events": events, "errors": errors}


def read_model_outputs(raw: DataFrame, text_col: str = "json_text") -> tuple[DataFrame, DataFrame]:
    """A3: (one nested document per chapter, rows for the repair queue). Extra fields are ignored,
    missing lists are empty. ``raw``: chapter_id and the answer text."""
    d = raw.withColumn("_block", extract_json_block(F.col(text_col)))
    good, bad = parse_tolerant_json(d, "_block", RESPONSE, "doc")
    docs = good.select("chapter_id", "doc.schema_version", "doc.chapter_num", *[
        F.coalesce(f"doc.{c}", F.array()).alias(c) for c in ("characters", "relationships", "review_items")])
    return docs, bad.drop("_block")


def flatten_outputs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested model documents as (characters, relationships) with their position in the answer."""
    none, blank = F.array().cast("array<string>"), F.lit("")
    c = docs.select("chapter_id", F.posexplode("characters").alias("ord", "c")).select(
        "chapter_id", F.col("ord").cast("long").alias("ord"), F.coalesce("c.display_name", blank).alias("display_name"), F.coalesce("c.entity_nature", blank).alias("entity_nature"),
        F.col("c.confidence").alias("confidence"), F.coalesce("c.aliases", none).alias("aliases"), F.coalesce("c.evidence_quotes", none).alias("quotes"),
        F.transform(F.coalesce("c.fields", F.array()), lambda f: F.struct(
            f["field_key"].alias("field_key"), f["field_label"].alias("field_label"), F.coalesce(f["value"], blank).alias("value"), f["semantic_class"].alias("semantic_class"),
            f["confidence"].alias("confidence"), F.coalesce(f["evidence_quotes"], none).alias("quotes"))).alias("fields"))
    r = docs.select("chapter_id", F.posexplode("relationships").alias("ord", "r")).select(
        "chapter_id", F.col("ord").cast("long").alias("ord"), *[F.coalesce(f"r.{a}", blank).alias(b) for a, b in (
            ("source_name", "source_name"), ("target_name", "target_name"), ("relationship_scope", "rel_scope"), ("relationship_type", "rel_type"),
            ("source_to_target_label", "forward"), ("target_to_source_label", "backward"))],
        F.col("r.confidence").alias("confidence"), F.coalesce("r.evidence_quotes", none).alias("quotes"))
    return c, r
