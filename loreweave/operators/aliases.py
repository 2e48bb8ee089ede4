"""The alias map: every stored name of every character of a job."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.functions import keys as K
from loreweave.functions import vocab as V

CANONICAL = ("canonical_name", "Tên chính")  # fixed value


def alias_sources(records: DataFrame, values: DataFrame, job: Sequence[str] = ("job_id",)) -> DataFrame:
    """What states an alias: the name of a record, and each of its values that may be stored as one, with the entry
    (entity_key, alias_key) of the alias map that it supports."""
    r = records.withColumn("entity_key", F.coalesce(K.blank_to_null(F.col("entity_key")), K.folded_key(F.col("display_name")))).filter(
        K.trim_ws(F.col("entity_key")) != "")
    own = r.select(
        *job, "record_id", "entity_key", "display_name", "chapter_num", F.col("display_name").alias("alias_text"), F.lit(CANONICAL[0]).alias("alias_type"),
        F.lit(CANONICAL[1]).alias("alias_label"), F.lit(1.0).alias("confidence"), F.lit("").alias("field_key"), F.lit(None).cast(dict(values.dtypes)["pos"]).alias("pos"),
        F.lit(None).cast(dict(values.dtypes)["evidence"]).alias("evidence"),
    )
    kept = values.filter(V.stored_type_persistable(F.col("field_key")) & K.stable_alias_stored(F.col("value_text")))
    other = r.join(kept, "record_id").select(
        *job, "record_id", "entity_key", "display_name", "chapter_num", F.col("value_text").alias("alias_text"), V.stored_alias_type(F.col("field_key")).alias("alias_type"),
        F.col("field_label").alias("alias_label"), "confidence", "field_key", "pos", "evidence",
    ).filter(K.folded_key(F.col("alias_text")) != K.folded_key(F.col("display_name")))
    return own.unionByName(other).withColumn("alias_key", K.folded_key(F.col("alias_text"))).filter("alias_key <> ''")


def entries(sources: DataFrame, job: Sequence[str]) -> DataFrame:
    """The alias map that ``sources`` support: texts of the first, highest confidence, first evidence."""
    evidence = dict(sources.dtypes)["evidence"]
    order = F.struct("chapter_num", "display_name", "record_id", "field_key", "pos")
    found = F.size(F.coalesce("evidence", F.array().cast(evidence))) > 0
    return (
        sources.groupBy(*job, "entity_key", "alias_key")
        .agg(
            F.min_by(F.struct("display_name", "alias_type", "alias_label", "alias_text", F.col("confidence").alias("_c")), order).alias("_f"),
            F.min("chapter_num").alias("first_chapter_num"),
            F.max("confidence").alias("_max"),
            F.min_by(F.when(found, F.col("evidence")), F.when(found, order)).alias("evidence"),
        )
        .select(*job, "entity_key", "alias_key", "_f.display_name", "_f.alias_type", "_f.alias_label", "_f.alias_text", "first_chapter_num",
                F.when(F.col("_max") > 0, F.col("_max")).otherwise(F.col("_f._c")).alias("confidence"),
                F.coalesce("evidence", F.array().cast(evidence)).alias("evidence"))
    )


def rebuild_alias_map(records: DataFrame, values: DataFrame, job: Sequence[str] = ("job_id",)) -> DataFrame:
    """The alias map of each job from its character records.

    ``records``: job, record_id, chapter_num, entity_key, display_name. ``values``: record_id,
    field_key, field_label, pos, value_text, confidence, evidence. Arrival order is chapter, name,
    record id, canonical name first, then field key and position."""
    return entries(alias_sources(records, values, job), job)


def retract_records(aliases: DataFrame, records: DataFrame, values: DataFrame, gone: DataFrame, job: Sequence[str] = ("job_id",)) -> DataFrame:
    """J1 under deletion: the alias map ``aliases`` of ``records`` after the records ``gone`` (job, record_id) left.

    First texts, lowest chapter and highest confidence cannot be taken back from the map alone, so entries with a source
    in a record that left are derived anew, from what still supports them; all others stay as they are. What is derived
    grows with what left, not with the map."""
    entry = [*job, "entity_key", "alias_key"]
    sources = alias_sources(records, values, job)
    touched = sources.join(gone, [*job, "record_id"], "left_semi").select(*entry).distinct()
    support = sources.join(touched, entry, "left_semi").join(gone, [*job, "record_id"], "left_anti")
    return aliases.join(touched, entry, "left_anti").unionByName(entries(support, job).select(*aliases.columns))


def list_aliases(aliases: DataFrame) -> DataFrame:
    """Listed order of an alias map."""
    return aliases.orderBy("display_name", "first_chapter_num", "alias_text", "alias_key")
