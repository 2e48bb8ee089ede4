"""Tables: flat and nested records, idempotent rewrite of chapters, projects and novels."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.functions import keys as K
from loreweave.operators.segment import HAN, HANGUL, KANA, MARKED, language_of_counts
from loreweave.sources.corpus import stable_id

JOINED_BY = 2  # characters between two joined chapters (a blank line)


def flatten_records(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A4: (records, fields, values, mentions) of nested documents. ``documents``: job_id, chapter_id,
    chapter_num, records[] of (group_key, group_label, entity_key, display_name, mentions[], fields[])."""
    keys = ["job_id", "chapter_id", "chapter_num"]
    r = documents.select(*keys, F.posexplode("records").alias("pos", "r")).filter(F.col("r.group_key").isin("character", "relationship")).withColumn(
        "record_id", stable_id("srec", F.col("job_id"), F.col("chapter_id"), F.col("pos")))
    records = r.select(*keys, "record_id", F.col("pos").alias("ord"), "r.group_key", "r.group_label", "r.entity_key", "r.display_name")
    f = r.select("job_id", "chapter_num", "record_id", F.posexplode("r.fields").alias("batch", "f"))
    fields = f.select("job_id", "chapter_num", "record_id", "batch", "f.field_key", "f.field_label")
    values = f.select("job_id", "chapter_num", "record_id", "batch", "f.field_key", "f.field_label", F.posexplode("f.values").alias("pos", "v")).select(
        "job_id", "chapter_num", "record_id", "batch", "field_key", "field_label", "pos", F.col("v.value").alias("value_text"), "v.confidence", "v.related_character",
        "v.relationship_type", "v.relationship_label", "v.relationship_direction", "v.evidence")
    mentions = r.select("job_id", "chapter_num", "record_id", F.posexplode("r.mentions").alias("pos", "m")).select("job_id", "chapter_num", "record_id", "pos", "m.*")
    return records, fields, values, mentions


def nest_records(records: DataFrame, values: DataFrame, mentions: DataFrame) -> DataFrame:
    """A5: one nested row per record: mentions in order, fields by label and key with values in order.
    One shuffle per level. Sort by chapter_num, display_name, record_id to list them."""
    value_cols = [c for c in values.columns if c not in ("record_id", "job_id", "chapter_num", "batch", "field_key", "field_label", "pos")]
    f = values.groupBy("record_id", "batch", "field_key", "field_label").agg(F.array_sort(F.collect_list(F.struct("pos", *value_cols))).alias("values"))
    f = f.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("field_label", "field_key", "batch", "values"))).alias("fields"))
    m = mentions.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "text", "mention_type"))).alias("mentions"))
    return records.join(f, "record_id", "left").join(m, "record_id", "left")


def replace_chapter_records(target: DataFrame, new: DataFrame, chapters: DataFrame, keys: Sequence[str] = ("job_id", "chapter_num")) -> DataFrame:
    """Rows of ``target`` after the rows of the rewritten ``chapters`` were replaced by ``new``."""
    return target.join(chapters.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


class LogTable:
    """Append-only state: rows of a batch live in their own folder, so a retried batch overwrites itself
    and nothing else. The current row of a key is the one with the highest batch id."""

    def __init__(self, path: str, keys: Sequence[str]):
        self.path, self.keys = path, list(keys)

    def append(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def rows(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        try:
            df = spark.read.option("basePath", self.path).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # any other fault is not an empty table
                raise
            return None
        df = df.withColumn("batch_id", F.col("batch_id").cast("long"))
        return df if before is None else df.filter(F.col("batch_id") < before)

    def latest(self, spark: SparkSession, before: int | None = None, touched: DataFrame | None = None) -> DataFrame | None:
        """Newest row of each key; of the ``touched`` keys only where they are given."""
        df = self.rows(spark, before)
        if df is None:
            return None
        if touched is not None:
            df = df.join(touched.select(*self.keys).distinct(), self.keys, "left_semi")
        rest = [c for c in df.columns if c not in (*self.keys, "batch_id")]
        return df.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*self.keys, "_r.*")


class VersionedTable:
    """A6 on storage: rows that are rewritten group by group (a chapter, a job) without touching others.

    A write appends the new rows and the list of groups it replaces; the rows of a group are those of
    the last write that names it. Running a write again leaves the same table. One folder per write
    instead of one per chapter keeps the number of files independent of the number of chapters."""

    def __init__(self, path: str, keys: Sequence[str]):
        self.keys = list(keys)
        self._rows, self._groups = LogTable(f"{path}/rows", keys), LogTable(f"{path}/groups", keys)

    def replace(self, new: DataFrame, groups: DataFrame, version: int) -> None:
        self._rows.append(new, version)
        self._groups.append(groups.select(*self.keys).distinct(), version)

    def current(self, spark: SparkSession, upto: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """Rows as of version ``upto`` (default: all), of the groups matching ``only`` where given."""
        before = None if upto is None else upto + 1
        groups = self._groups.rows(spark, before)
        if only is not None:
            groups = groups.join(only, only.columns, "left_semi")
        last = groups.groupBy(*self.keys).agg(F.max("batch_id").alias("batch_id"))
        return self._rows.rows(spark, before).join(last, [*self.keys, "batch_id"]).drop("batch_id")


def written_counts(records: DataFrame, mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """The four counts of a rewrite, per job."""
    rec = records.groupBy("job_id").agg(
        F.count_if(F.col("group_key") == "character").alias("record_count"), F.count_if(F.col("group_key") == "relationship").alias("relationship_record_count"))
    men = mentions.groupBy("job_id").agg(F.count(F.lit(1)).alias("mention_count"))
    ali = aliases.groupBy("job_id").agg(F.count(F.lit(1)).alias("character_alias_count"))
    return rec.join(men, "job_id", "left").join(ali, "job_id", "left").fillna(0, ["mention_count", "character_alias_count"])


def archive_restore_purge(projects: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects after, one outcome per request). ``requests``: project_id, action (archive | restore
    | purge), at; one request per project."""
    j = projects.join(requests.select("project_id", "action", "at"), "project_id", "left")
    gone = F.col("deleted_at").isNotNull()
    outcome = (
        F.when(F.col("action") == "purge", F.lit("purged"))
        .when((F.col("action") == "archive") & gone, F.lit("already_archived")).when(F.col("action") == "archive", F.lit("archived"))
        .when((F.col("action") == "restore") & ~gone, F.lit("not_archived")).when(F.col("action") == "restore", F.lit("restored"))
    )
    j = j.withColumn("outcome", outcome)
    changed = F.coalesce(F.col("outcome").isin("archived", "restored"), F.lit(False))
    after = j.filter(F.coalesce(F.col("outcome") != "purged", F.lit(True))).select(
        "project_id", "name", "created_at", F.when(changed, F.col("at")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(F.col("outcome") == "archived", F.col("at")).when(F.col("outcome") == "restored", F.lit(None)).otherwise(F.col("deleted_at")).alias("deleted_at"),
        F.when(F.col("outcome") == "archived", F.lit("archived")).when(F.col("outcome") == "restored", F.lit("private")).otherwise(F.col("visibility")).alias("visibility"))
    missing = requests.join(projects.select("project_id"), "project_id", "left_anti").select("project_id", "action", F.lit("not_found").alias("outcome"))
    return after, j.filter("action IS NOT NULL").select("project_id", "action", "outcome").unionByName(missing)


def purge(tables: dict[str, DataFrame], gone: DataFrame, links: Sequence[tuple[str, str]]) -> dict[str, DataFrame]:
    """Rows that depend on purged parents, removed down the foreign keys. ``links``: (table, key) in
    the order of dependence; ``gone`` has the key of the first one. Rows without a parent stay."""
    out, lost = dict(tables), {gone.columns[0]: gone.distinct()}
    for table, key in links:
        df = out[table]
        dead = df.join(lost[key], key, "left_semi")
        out[table] = df.join(lost[key], key, "left_anti")
        own = table.rstrip("s") + "_id"
        if own in df.columns and own != key:
            ids = dead.select(own).distinct()
            lost[own] = ids if own not in lost else lost[own].unionByName(ids).distinct()
    return out


def update_novel_metadata(novels: DataFrame, updates: DataFrame, chapters: DataFrame) -> DataFrame:
    """Title only when given; author, genre, description overwritten (blank clears); a language of
    blank or ``auto`` is detected from the chapters joined by blank lines."""
    u = updates.select("novel_id", *[K.blank_to_null(F.col(c)).alias(f"_{c}") for c in ("title", "author", "genre", "description", "source_language")], F.lit(True).alias("_hit"))
    wants = u.filter("_source_language IS NULL OR _source_language IN ('auto', 'detect')").select("novel_id")
    lang = detect_novel_language(chapters.join(wants, "novel_id", "left_semi"))
    j = novels.join(u, "novel_id", "left").join(lang, "novel_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    auto = F.col("_source_language").isNull() | F.col("_source_language").isin("auto", "detect")
    return j.select(
        "novel_id", F.coalesce("_title", "title").alias("title"),
        *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("author", "genre", "description")],
        F.when(~hit, F.col("source_language")).when(auto, F.col("_lang")).otherwise(F.col("_source_language")).alias("source_language"))


def detect_novel_language(chapters: DataFrame, sample_chars: int | None = None) -> DataFrame:
    """Language of each novel from all its chapters: letters are counted per chapter and summed, so the
    chapters of a novel are never joined.

    With ``sample_chars`` only so many characters of the chapters joined by blank lines count (the original
    reads LANGUAGE_SAMPLE); the part of a chapter inside them follows from running sums."""
    part = chapters.select("novel_id", F.col("content").alias("_part"))
    if sample_chars is not None:
        w = Window.partitionBy("novel_id").orderBy("chapter_num").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.length("content") + JOINED_BY).over(w), F.lit(0))
        left = F.greatest(F.lit(sample_chars) - before, F.lit(0)).cast("int")
        part = chapters.select("novel_id", F.left("content", left).alias("_part"))
    sums = part.groupBy("novel_id").agg(*[
        F.sum(F.length(F.regexp_replace("_part", f"[^{members}]+", ""))).alias(name) for name, members in
        (("han", HAN), ("kana", KANA), ("hangul", HANGUL), ("ascii", "A-Za-z"), ("marked", MARKED))])
    return sums.select("novel_id", language_of_counts(*[F.col(c) for c in ("han", "kana", "hangul", "ascii", "marked")]).alias("_lang"))


def list_projects(projects: DataFrame, archived: bool = False) -> DataFrame:
    """Active projects, newest first, or archived ones by last change."""
    if archived:
        return projects.filter(F.col("deleted_at").isNotNull()).orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("project_id"))
    return projects.filter(F.col("deleted_at").isNull()).orderBy(F.desc("created_at"), F.desc("project_id"))


def create_projects(requests: DataFrame, workspace: str = "local") -> tuple[DataFrame, DataFrame]:
    """A10: (projects, errors). The name is required and trimmed."""
    r = requests.withColumn("name", K.blank_to_null(F.col("name")))
    ok = r.filter("name IS NOT NULL").select(
        stable_id("proj", F.col("request_id")).alias("project_id"), "request_id", F.lit(workspace).alias("workspace_id"), "name", F.lit("private").alias("visibility"))
    return ok, r.filter("name IS NULL").select("request_id", F.lit("project_name_required").alias("error"))
