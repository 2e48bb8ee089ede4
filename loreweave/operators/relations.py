"""Staged relationship path: candidates between known identities of a chapter."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions import keys as K
from loreweave.functions import vocab as V
from loreweave.operators.mentions import identity_surfaces

# --- Fixed values -------------------------------------------------------------------------
CANDIDATE_CONFIDENCE = 0.78
VERIFY_CONFIDENCE = 0.85
KINDS = {
    "stable_relation": ("stable_relation", "relationship", "relation", "direct_relation"),
    "temporary_interaction": ("temporary_interaction", "interaction", "scene_interaction"),
    "event": ("event", "action", "scene_event"),
}
# ------------------------------------------------------------------------------------------


def relation_kind(c: Column) -> Column:
    """Kind of a relationship candidate."""
    return V.lookup(K.ascii_key(F.coalesce(c, F.lit(""))), KINDS, F.lit("uncertain"))


def relationship_identities(records: DataFrame, mentions: DataFrame, scope: Sequence[str] = ("chapter_id",), key_mode: str = "parity") -> DataFrame:
    """H1: records with a mention, first per C3 key, of chapters with at least two of them."""
    hit = records.filter("group_key = 'character'").join(mentions.select(*scope, "record_id").distinct(), [*scope, "record_id"], "left_semi")
    first = hit.groupBy(*scope, K.ascii_key(F.col("display_name"), key_mode).alias("entity_key")).agg(
        F.min_by(F.struct("record_id", "display_name", "ord"), "ord").alias("_r")).select(*scope, "entity_key", "_r.*")
    many = first.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select(*scope)
    return first.join(many, list(scope), "left_semi")


def quote_in_text(text: Column, quote: Column) -> Column:
    """H3: the quote is in the text, as it is or after both collapse white space."""
    return quote_in_flat(K.squeeze_ws(text), quote)


def quote_in_flat(flat: Column, quote: Column) -> Column:
    """H3 for a text whose white space is collapsed already. A quote that is in the text as it is, is also in it
    after both are collapsed, so one search decides."""
    q = K.squeeze_ws(quote)
    return F.coalesce((q != "") & F.contains(flat, q), F.lit(False))


def quotes_in_texts(quotes: DataFrame, chapters: DataFrame, scope: Sequence[str] = ("chapter_id",)) -> DataFrame:
    """H3 over a table: rows of ``quotes`` (scope, quote) that have a chapter, with ``found``. White space is collapsed once
    per chapter, before its quotes meet it. ``chapters``: scope, content."""
    flat = chapters.select(*scope, K.squeeze_ws(F.col("content")).alias("_flat"))
    return quotes.join(flat, list(scope)).withColumn("found", quote_in_flat(F.col("_flat"), F.col("quote"))).drop("_flat")


def unique_surfaces(identities: DataFrame, scope: Sequence[str], ident: str) -> DataFrame:
    """Surface key -> the one identity it stands for; keys of several identities are left out."""
    s = identity_surfaces(identities.withColumnRenamed(ident, "_id"), (*scope, "_id")).select(
        *scope, F.col("_id").alias(ident), K.text_key(F.col("surface")).alias("skey")).distinct()
    return s.groupBy(*scope, "skey").agg(F.count(F.lit(1)).alias("_n"), F.min(ident).alias(ident)).filter("_n = 1").drop("_n")


def resolve_relationship_candidates(
    candidates: DataFrame, identities: DataFrame, chapters: DataFrame, scope: Sequence[str] = ("chapter_id",)
) -> tuple[DataFrame, DataFrame]:
    """H2: (resolved, warnings with the first code that applies). ``candidates``: scope, cand_id,
    source_name, target_name, kind, rel_type, forward, backward, confidence, quotes. ``identities``:
    scope, idx (position in the chapter), name, aliases."""
    keys = unique_surfaces(identities, scope, "idx")

    def side(name: str, out: str) -> DataFrame:
        return keys.select(*scope, F.col("skey").alias(f"_{name}"), F.col("idx").alias(out))

    c = candidates.withColumn("_s", K.text_key(K.clean_surface(F.col("source_name")))).withColumn("_t", K.text_key(K.clean_surface(F.col("target_name"))))
    c = c.join(side("s", "source_idx"), [*scope, "_s"], "left").join(side("t", "target_idx"), [*scope, "_t"], "left")
    # only quoted candidates need the text; one row per quote keeps the text out of arrays
    quoted = c.select(*scope, "cand_id", F.explode("quotes").alias("quote"))
    grounded = quotes_in_texts(quoted, chapters, scope).filter("found").select(*scope, "cand_id").distinct().withColumn("_grounded", F.lit(True))
    c = c.join(grounded, [*scope, "cand_id"], "left")
    code = (
        F.when(relation_kind(F.col("kind")) != "stable_relation", F.lit("relationship_candidate_not_stable"))
        .when(F.coalesce("confidence", F.lit(0.0)) < CANDIDATE_CONFIDENCE, F.lit("relationship_candidate_low_confidence"))
        .when(F.col("source_idx").isNull(), F.lit("relationship_source_not_resolved"))
        .when(F.col("target_idx").isNull(), F.lit("relationship_target_not_resolved"))
        .when(F.col("source_idx") == F.col("target_idx"), F.lit("relationship_self_reference_skipped"))
        .when(F.col("_grounded").isNull(), F.lit("relationship_candidate_not_grounded"))
    )
    c = c.withColumn("code", code).drop("_s", "_t", "_grounded")
    return c.filter("code IS NULL").drop("code"), c.filter("code IS NOT NULL").select(*scope, "cand_id", "code")


def canonicalize_pairs(resolved: DataFrame) -> DataFrame:
    """H4: lower index first; labels swap with it. A missing reverse label repeats the forward one."""
    fwd = K.trim_ws(F.col("forward"))
    back = F.coalesce(K.blank_to_null(F.col("backward")), fwd)
    swap = F.col("source_idx") > F.col("target_idx")
    rtype = K.ascii_key(F.coalesce(K.blank_to_null(F.col("rel_type")), F.col("forward")))
    quotes = F.filter(F.transform("quotes", K.trim_ws), lambda q: q.isNotNull() & (q != ""))
    return resolved.select(
        *[c for c in resolved.columns if c not in ("source_name", "target_name", "kind", "rel_type", "forward", "backward", "source_idx", "target_idx", "quotes")],
        F.least("source_idx", "target_idx").alias("left_idx"), F.greatest("source_idx", "target_idx").alias("right_idx"),
        rtype.alias("rel_type"), F.when(swap, back).otherwise(fwd).alias("left_label"), F.when(swap, fwd).otherwise(back).alias("right_label"),
        quotes.alias("quotes"),
    )


def dedupe_pair_relationships(pairs: DataFrame, scope: Sequence[str] = ("chapter_id",)) -> DataFrame:
    """H5: quoted relations with labels, the first per pair, type and label keys."""
    ok = pairs.filter((F.col("rel_type") != "") & (F.col("left_label") != "") & (F.col("right_label") != "") & (F.size("quotes") > 0))
    cols = [c for c in pairs.columns if c not in (*scope, "left_idx", "right_idx")]
    return (
        ok.withColumn("_k", F.concat_ws(":", "rel_type", K.text_key(F.col("left_label")), K.text_key(F.col("right_label"))))
        .groupBy(*scope, "left_idx", "right_idx", "_k").agg(F.min_by(F.struct(*cols), "cand_id").alias("_r"))
        .select(*scope, "left_idx", "right_idx", *[F.col(f"_r.{c}").alias(c) for c in cols])
    )


def apply_relationship_decisions(pairs: DataFrame, decisions: DataFrame, scope: Sequence[str] = ("chapter_id",)) -> tuple[DataFrame, DataFrame]:
    """H6: (kept, report). ``decisions``: scope, cand_id, accepted, owner_direction_ok, confidence, rel_scope."""
    d = decisions.select(*scope, "cand_id", "accepted", "owner_direction_ok", F.col("confidence").alias("_conf"), K.ascii_key(F.coalesce("rel_scope", F.lit(""))).alias("_scope"))
    ok = (
        F.coalesce("accepted", F.lit(False)) & F.coalesce("owner_direction_ok", F.lit(False)) & (F.coalesce("_conf", F.lit(0.0)) >= VERIFY_CONFIDENCE)
        & F.coalesce(F.col("_scope").isin(*V.RELATION_SCOPES), F.lit(False))
    )
    j = pairs.join(d, [*scope, "cand_id"], "left").withColumn("_ok", ok)
    return j.filter("_ok").select(*pairs.columns), j.select(*scope, "cand_id", F.col("_ok").alias("accepted"))


def pairs_to_records(pairs: DataFrame, identities: DataFrame, scope: Sequence[str] = ("chapter_id",), key_mode: str = "parity") -> tuple[DataFrame, DataFrame]:
    """H7: (records, values): one record per pair, two values per relation, both from the first to the
    related character."""
    names = identities.select(*scope, "idx", "name")
    j = pairs.join(names.withColumnsRenamed({"idx": "left_idx", "name": "left_name"}), [*scope, "left_idx"]).join(
        names.withColumnsRenamed({"idx": "right_idx", "name": "right_name"}), [*scope, "right_idx"])
    key = F.concat_ws("|", F.lit("relationship"), K.ascii_key(F.col("left_name"), key_mode), K.ascii_key(F.col("right_name"), key_mode))
    j = j.withColumn("entity_key", key)
    records = j.groupBy(*scope, "left_idx", "right_idx").agg(
        F.first("entity_key").alias("entity_key"), F.first(F.concat_ws(" ↔ ", "left_name", "right_name")).alias("display_name"))
    both = F.array(
        F.struct(F.lit(0).alias("pos"), F.col("left_label").alias("value_text"), F.col("right_name").alias("related_character")),
        F.struct(F.lit(1).alias("pos"), F.col("right_label").alias("value_text"), F.col("left_name").alias("related_character")),
    )
    values = j.select(*scope, "entity_key", "cand_id", "confidence", F.col("rel_type").alias("relationship_type"), "quotes", F.inline(both)).withColumn(
        "relationship_label", F.col("value_text")).withColumn("relationship_direction", F.lit("self_to_related"))
    return records, values


