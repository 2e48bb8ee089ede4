"""Structured one-shot path: one model document per chapter becomes records, or suspects for review.

Input tables are flat: ``characters`` (chapter_id, ord, display_name, entity_nature, confidence,
aliases[], quotes[], fields[]) and ``relationships`` (chapter_id, ord, source_name, target_name,
rel_scope, rel_type, forward, backward, confidence, quotes[]), as ``sources.corpus`` reads them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions import keys as K
from loreweave.functions import vocab as V
from loreweave.functions.textfns import let
from loreweave.operators.identity import push_alias
from loreweave.operators.mentions import scan_identity_mentions
from loreweave.operators.records import distinct_by
from loreweave.operators.relations import unique_surfaces

# --- Fixed values -------------------------------------------------------------------------
MIN_CONFIDENCE = 0.45
RESPONSE_SCHEMA = "story_chapter_cloud_extraction.v2"
NOT_PERSISTABLE = ("temporary_reference", "role_title", "uncertain")
FIELD_REASON, RELATION_REASON = "cloud_field", "cloud_relationship"
HINT_LIMIT = 24
LOW_SIGNAL_MENTIONS = 2
EVIDENCE = "array<struct<chapter_num:bigint,start_char:bigint,end_char:bigint,quote:string,reason:string>>"
# ------------------------------------------------------------------------------------------


def check_document_header(outputs: DataFrame, chapters: DataFrame, schema_version: str = RESPONSE_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(documents that fit their chapter, failures with a code)."""
    j = outputs.join(chapters.select("chapter_id", F.col("chapter_num").alias("_num")), "chapter_id")
    code = F.when(F.coalesce(K.trim_ws(F.col("schema_version")), F.lit("")) != schema_version, F.lit("cloud_schema_mismatch")).when(
        F.coalesce(F.col("chapter_num") != F.col("_num"), F.lit(True)), F.lit("cloud_chapter_num_mismatch"))
    j = j.withColumn("code", code).drop("_num")
    return j.filter("code IS NULL").drop("code"), j.filter("code IS NOT NULL").select("chapter_id", "code")


def locate_quotes(quotes: DataFrame, chapters: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """First exact place of each quote in its chapter -> keys, evidence. ``quotes``: chapter_id,
    keys, quotes[]. Equal quotes (C1) count once; what is not found is dropped."""
    each = F.filter(F.transform("quotes", K.trim_ws), lambda q: q.isNotNull() & (q != ""))
    rows = quotes.select("chapter_id", *keys, F.posexplode(distinct_by(each, K.text_key)).alias("_i", "_q"))
    found = rows.join(chapters.select("chapter_id", "chapter_num", "content"), "chapter_id").withColumn(
        "_s", (F.expr("instr(content, _q)") - 1).cast("long")).filter("_s >= 0")
    span = F.struct(
        F.col("chapter_num").cast("long").alias("chapter_num"), F.col("_s").alias("start_char"),
        (F.col("_s") + F.length("_q")).alias("end_char"), F.col("_q").alias("quote"), F.lit(reason).alias("reason"))
    return found.groupBy("chapter_id", *keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", span.alias("e")))), lambda x: x["e"]).alias("evidence"))


def build_attribute_fields(characters: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I4: (attribute values with evidence, suspects)."""
    f = characters.select("chapter_id", "ord", "display_name", F.posexplode("fields").alias("pos", "_f")).select(
        "chapter_id", "ord", "display_name", "pos", K.trim_ws(F.col("_f.value")).alias("value_text"), F.col("_f.confidence").alias("confidence"),
        K.schema_key(F.coalesce("_f.field_key", F.lit(""))).alias("_key"), K.schema_key(F.coalesce("_f.semantic_class", F.lit(""))).alias("semantic_class"),
        F.col("_f.quotes").alias("quotes")).filter("value_text <> ''")
    kind = F.when(F.col("semantic_class") == "", F.col("_key")).otherwise(F.col("semantic_class"))
    f = f.withColumn("_ok", kind.isin(*V.APPEARANCE_CLASSES))
    ev = locate_quotes(f.filter("_ok").select("chapter_id", "ord", "pos", "quotes"), chapters, ["ord", "pos"], FIELD_REASON)
    j = f.join(ev, ["chapter_id", "ord", "pos"], "left")
    kept = j.filter(F.col("_ok") & F.col("evidence").isNotNull()).select("chapter_id", "ord", "pos", "value_text", "confidence", "evidence")
    why = F.when(~F.col("_ok"), F.lit("field_semantic_class_not_persistable")).otherwise(F.lit("field_evidence_not_found_in_chapter"))
    suspects = j.filter(~F.col("_ok") | F.col("evidence").isNull()).select(
        "chapter_id", why.alias("reason"), F.col("display_name").alias("subject"), F.col("value_text").alias("detail"))
    return kept, suspects


def build_character_records(characters: DataFrame, chapters: DataFrame, key_mode: str = "parity") -> dict[str, DataFrame]:
    """I2 (with I4 and I9): records, mentions, values and suspects of the characters of each chapter.

    Characters of one C3 key in a chapter are one record: mentions are united, values appended."""
    c = characters.filter(F.coalesce("confidence", F.lit(0.0)) >= MIN_CONFIDENCE).withColumn(
        "_nature", K.schema_key(F.coalesce("entity_nature", F.lit(""))))
    unfit = F.col("_nature").isin(*NOT_PERSISTABLE)
    refused = c.filter(unfit).select(
        "chapter_id", F.lit("character_entity_nature_not_persistable").alias("reason"), F.col("display_name").alias("subject"), F.col("_nature").alias("detail"))
    c = c.filter(~unfit).withColumn("name", K.clean_surface(F.col("display_name"))).filter("name <> ''")
    alias_rows = c.select("chapter_id", F.col("ord").alias("_c"), "name", F.posexplode("aliases").alias("ord", "_a")).select(
        "chapter_id", "_c", "name", F.col("ord").cast("long").alias("ord"), K.clean_surface(F.col("_a")).alias("text"), F.lit("other_alias").alias("alias_type"),
        F.lit("").alias("alias_label"), F.lit(False).alias("is_primary"), F.array().cast("array<string>").alias("quotes"))
    aliases = push_alias(alias_rows, ["chapter_id", "_c"]).select("chapter_id", F.col("_c").alias("ord"), F.col("ord").alias("pos"), "text")
    lists = aliases.groupBy("chapter_id", "ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("_al"))
    ids = c.select("chapter_id", "ord", "name", "display_name", "quotes").join(lists, ["chapter_id", "ord"], "left").select(
        "chapter_id", F.col("ord").alias("identity_id"), "name", F.coalesce("_al", F.array().cast("array<string>")).alias("aliases"), "display_name", "quotes")
    found = scan_identity_mentions(chapters, ids.select("chapter_id", "identity_id", "name", "aliases"))
    unseen = ids.filter(F.size(F.coalesce("quotes", F.array().cast("array<string>"))) > 0).join(
        found.select("chapter_id", "identity_id").distinct(), ["chapter_id", "identity_id"], "left_anti"
    ).select("chapter_id", F.lit("character_mentions_not_found_from_surfaces").alias("reason"), F.col("display_name").alias("subject"), F.lit("").alias("detail"))
    attributes, field_suspects = build_attribute_fields(c, chapters)
    keyed = c.select("chapter_id", "ord", "name", K.ascii_key(F.col("name"), key_mode).alias("entity_key"))
    records = keyed.groupBy("chapter_id", "entity_key").agg(F.min("ord").alias("record_ord"), F.min_by("name", "ord").alias("display_name"))
    owner = keyed.select("chapter_id", "ord", "entity_key").join(records.select("chapter_id", "entity_key", "record_ord"), ["chapter_id", "entity_key"]).drop("entity_key")
    mentions = found.join(owner.withColumnRenamed("ord", "identity_id"), ["chapter_id", "identity_id"])
    mentions = mentions.groupBy("chapter_id", "record_ord", "start_char", "end_char", K.text_key(F.col("text")).alias("_k")).agg(
        F.min_by(F.struct("text", "mention_type"), F.struct("text", "identity_id")).alias("_m")
    ).select("chapter_id", "record_ord", "start_char", "end_char", "_m.text", "_m.mention_type")
    none = F.array().cast(EVIDENCE)
    values = attributes.select("chapter_id", "ord", "pos", F.lit("appearance").alias("field_key"), "value_text", "confidence", "evidence").unionByName(
        aliases.select("chapter_id", "ord", "pos", F.lit("other_alias").alias("field_key"), F.col("text").alias("value_text"), F.lit(1.0).alias("confidence"), none.alias("evidence")))
    values = values.join(owner, ["chapter_id", "ord"])
    return {"records": records, "mentions": mentions, "values": values,
            "suspects": refused.unionByName(unseen).unionByName(field_suspects)}


def merge_probable_aliases(records: DataFrame, mentions: DataFrame, values: DataFrame, parity: bool = True) -> DataFrame:
    """chapter_id, source_ord, target_ord, match_kind of records that are probably an alias.

    A record with at most two mentions and no attribute folds into one with a stronger signal: its name
    is one of the target's surfaces, or one edit from a target alias. Later records see earlier merges,
    so each chapter is folded in order. ``parity`` counts attribute values as aliases, as F9 does."""
    men = mentions.groupBy("chapter_id", "record_ord").agg(
        F.collect_set(F.concat_ws(":", "start_char", "end_char", K.text_key(F.col("text")))).alias("m"))
    alias_value = F.lit(True) if parity else F.col("field_key") == "other_alias"
    val = values.groupBy("chapter_id", "record_ord").agg(
        F.count_if(F.col("field_key") != "other_alias").cast("int").alias("n"),
        F.array_compact(F.collect_set(F.when(alias_value, K.folded_key(F.col("value_text"))))).alias("a"))
    none = F.array().cast("array<string>")
    row = F.struct(
        F.col("record_ord").alias("id"), K.folded_key(F.col("display_name")).alias("k"), F.coalesce("m", none).alias("m"),
        F.coalesce("n", F.lit(0)).alias("n"), F.filter(F.coalesce("a", none), lambda x: x != "").alias("a"))
    packed = records.join(men, ["chapter_id", "record_ord"], "left").join(val, ["chapter_id", "record_ord"], "left").groupBy("chapter_id").agg(
        F.array_sort(F.collect_list(row)).alias("rs"))

    def broad(k: Column) -> Column:
        return (F.length(k) >= 6) & (F.size(F.split(k, "_")) >= 2)

    def near(x: Column, y: Column) -> Column:
        return (x == y) | (broad(x) & broad(y) & (F.levenshtein(x, y) <= 1))

    def step(acc: Column, _: Column) -> Column:
        def at(src: Column) -> Column:
            low = (F.size(src["m"]) <= LOW_SIGNAL_MENTIONS) & (src["n"] == 0) & (src["k"] != "")

            def strong(t: Column) -> Column:
                return (t["id"] != src["id"]) & ((F.size(t["m"]) > F.size(src["m"])) | (t["n"] > 0) | (F.size(t["a"]) > 0))

            exact = F.transform(acc["rs"], lambda t: strong(t) & ((t["k"] == src["k"]) | F.array_contains(t["a"], src["k"])))
            close = F.transform(acc["rs"], lambda t: strong(t) & F.exists(t["a"], lambda a: near(src["k"], a)))

            def merge(p: Column) -> Column:
                def into(t: Column) -> Column:
                    grown = F.struct(
                        t["id"].alias("id"), t["k"].alias("k"), F.array_union(t["m"], src["m"]).alias("m"), t["n"].alias("n"),
                        F.array_union(t["a"], src["a"]).alias("a"))
                    kept = F.filter(
                        F.transform(acc["rs"], lambda r: F.when(r["id"] == t["id"], grown).otherwise(r)), lambda r: r["id"] != src["id"])
                    kind = F.when(p["exact"] > 0, F.lit("exact_alias_surface")).otherwise(F.lit("near_alias_surface"))
                    entry = F.struct(src["id"].alias("source_ord"), t["id"].alias("target_ord"), kind.alias("match_kind"))
                    return F.struct(kept.alias("rs"), acc["i"].alias("i"), F.concat(acc["log"], F.array(entry)).alias("log"))

                return let(F.element_at(acc["rs"], F.when(p["exact"] > 0, p["exact"]).otherwise(p["close"]).cast("int")), into)

            found = F.struct(F.array_position(exact, True).alias("exact"), F.array_position(close, True).alias("close"))
            skip = F.struct(acc["rs"].alias("rs"), (acc["i"] + 1).alias("i"), acc["log"].alias("log"))
            return F.when(
                low, let(found, lambda p: F.when((p["exact"] == 0) & (p["close"] == 0), skip).otherwise(merge(p)))
            ).otherwise(skip)

        return F.when(acc["i"] > F.size(acc["rs"]), acc).otherwise(let(F.element_at(acc["rs"], acc["i"]), at))

    id_type = dict(records.dtypes)["record_ord"]
    start = F.struct(
        F.col("rs").alias("rs"), F.lit(1).alias("i"),
        F.array().cast(f"array<struct<source_ord:{id_type},target_ord:{id_type},match_kind:string>>").alias("log"))
    log = packed.select("chapter_id", F.aggregate("rs", start, step, lambda a: a["log"]).alias("log"))
    # a target may itself fold later: follow the log to the end
    return log.select("chapter_id", F.inline(F.transform(
        "log", lambda e: F.struct(
            e["source_ord"].alias("source_ord"), e["target_ord"].alias("target_ord"), e["match_kind"].alias("match_kind"),
            F.aggregate("log", e["target_ord"], lambda cur, x: F.when(x["source_ord"] == cur, x["target_ord"]).otherwise(cur)).alias("final_ord")))))


def apply_record_merges(built: dict[str, DataFrame], merges: DataFrame) -> dict[str, DataFrame]:
    """Records, mentions and values after I3; merged records count as suspects for review."""
    m = merges.select("chapter_id", F.col("source_ord").alias("record_ord"), F.col("final_ord").alias("_to"))

    def move(df: DataFrame) -> DataFrame:
        return df.join(m, ["chapter_id", "record_ord"], "left").withColumn("record_ord", F.coalesce("_to", "record_ord")).drop("_to")

    names = built["records"].select("chapter_id", F.col("record_ord").alias("source_ord"), F.col("display_name").alias("subject"))
    notes = merges.join(names, ["chapter_id", "source_ord"]).select(
        "chapter_id", F.lit("probable_alias_character_record_merged").alias("reason"), "subject", F.col("match_kind").alias("detail"))
    mentions = merge_record_mentions(move(built["mentions"]))
    return {
        "records": built["records"].join(m.select("chapter_id", "record_ord"), ["chapter_id", "record_ord"], "left_anti"),
        "mentions": mentions, "values": move(built["values"]), "suspects": built["suspects"].unionByName(notes),
    }


def merge_record_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions of one record with equal span and text key count once."""
    return mentions.groupBy("chapter_id", "record_ord", "start_char", "end_char", K.text_key(F.col("text")).alias("_k")).agg(
        F.min(F.struct("text", "mention_type")).alias("_m")).select("chapter_id", "record_ord", "start_char", "end_char", "_m.text", "_m.mention_type")


# --- relationships ----------------------------------------------------------------------------


def label_tokens(c: Column) -> Column:
    return F.filter(F.split(K.folded_key(c), "_"), lambda t: t != "")


def label_specificity(c: Column) -> Column:
    """More words, then more ASCII letters, make a label more specific."""
    return let(K.folded_key(c), lambda k: F.size(F.filter(F.split(k, "_"), lambda t: t != "")) * 1000 + F.length(F.regexp_replace(k, "[^A-Za-z0-9]", "")))


def _prefix(a: Column, b: Column) -> Column:
    return (F.size(a) < F.size(b)) & (F.slice(b, F.lit(1), F.size(a)) == a)


def tokens_overlap(a: Column, b: Column) -> Column:
    """Equal word lists, or one starts the other."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((a == b) | _prefix(a, b) | _prefix(b, a))


def labels_overlap(a: Column, b: Column) -> Column:
    return tokens_overlap(label_tokens(a), label_tokens(b))


def edge_row(value: str, related: str, direction: str, rtype: str, confidence: str, evidence: str) -> Column:
    """A relationship value with what the merge compares."""
    label = K.trim_ws(F.col(value))
    return F.struct(
        F.col(value).alias("value"), F.col(related).alias("related"), F.col(direction).alias("direction"), F.col(rtype).alias("rtype"),
        F.col(confidence).alias("confidence"), F.col(evidence).alias("evidence"), K.ascii_key(F.col(related)).alias("rk"), K.ascii_key(F.col(direction)).alias("dk"),
        label_tokens(label).alias("toks"), label_specificity(label).alias("spec"), label_specificity(F.col(rtype)).alias("tspec"))


def same_edge(a: Column, b: Column) -> Column:
    return (a["rk"] == b["rk"]) & (a["dk"] == b["dk"]) & (((a["rtype"] != "") & (a["rtype"] == b["rtype"])) | tokens_overlap(a["toks"], b["toks"]))


def span_key(e: Column) -> Column:
    return F.concat_ws(
        ":", e["chapter_num"].cast("string"), F.coalesce(e["start_char"], F.lit(-1)).cast("string"), F.coalesce(e["end_char"], F.lit(-1)).cast("string"),
        K.text_key(F.coalesce(e["quote"], F.lit(""))))


def merge_edges(a: Column, b: Column) -> Column:
    """I8: the more specific label and type win, the higher confidence, all evidence once."""
    better = (F.size(b["toks"]) > 0) & ((F.size(a["toks"]) == 0) | (b["spec"] > a["spec"]))
    typed = (b["rtype"] != "") & ((a["rtype"] == "") | (b["tspec"] > a["tspec"]))

    def pick(cond: Column, name: str) -> Column:
        return F.when(cond, b[name]).otherwise(a[name]).alias(name)

    return F.struct(
        pick(better, "value"), a["related"].alias("related"), a["direction"].alias("direction"), pick(typed, "rtype"),
        F.greatest(a["confidence"], b["confidence"]).alias("confidence"),
        F.array_sort(distinct_by(F.concat(a["evidence"], b["evidence"]), span_key)).alias("evidence"),
        a["rk"].alias("rk"), a["dk"].alias("dk"), pick(better, "toks"), pick(better, "spec"), pick(typed, "tspec"))


def fold_edges(rows: Column) -> Column:
    """I8: values in arrival order; each goes into the first one of the same edge, or stands for itself.
    ``rows``: array of (ord, first, edge); values of the first relationship of a pair are not compared
    with each other."""
    def step(acc: Column, r: Column) -> Column:
        v = r["edge"]
        at = F.when(r["first"], F.lit(0)).otherwise(F.array_position(F.transform(acc, lambda x: same_edge(x, v)), True))
        return let(at, lambda p: F.when(p == 0, F.concat(acc, F.array(v))).otherwise(
            F.transform(acc, lambda x, i: F.when(i + 1 == p, merge_edges(x, v)).otherwise(x))))

    return let(rows, lambda rs: F.aggregate(rs, F.slice(F.transform(rs, lambda r: r["edge"]), F.lit(1), F.lit(0)), step))


def build_relationship_records(relationships: DataFrame, identities: DataFrame, chapters: DataFrame, key_mode: str = "parity") -> dict[str, DataFrame]:
    """I7 (with I5, I6, I8): relationship records, their values, and suspects. ``identities``:
    chapter_id, ord, name, aliases of the records of the chapter."""
    r = relationships.filter(F.coalesce("confidence", F.lit(0.0)) >= MIN_CONFIDENCE).withColumn("_scope", K.schema_key(F.coalesce("rel_scope", F.lit(""))))
    keys = unique_surfaces(identities, ["chapter_id"], "ord")
    names = identities.select("chapter_id", F.col("ord").alias("_id"), "name")
    for side in ("source", "target"):
        k = keys.select("chapter_id", F.col("skey").alias("_k"), F.col("ord").alias(f"{side}_id"))
        n = names.select("chapter_id", F.col("_id").alias(f"{side}_id"), F.col("name").alias(f"_{side}"))
        r = r.withColumn("_k", K.text_key(F.coalesce(F.col(f"{side}_name"), F.lit("")))).join(k, ["chapter_id", "_k"], "left").drop("_k").join(n, ["chapter_id", f"{side}_id"], "left")
    r = r.withColumn("_fwd", K.trim_ws(F.coalesce("forward", F.lit("")))).withColumn("_back", K.trim_ws(F.coalesce("backward", F.lit("")))).withColumn(
        "_type", K.schema_key(F.coalesce("rel_type", F.lit(""))))
    suspect = (
        F.when(~F.col("_scope").isin(*V.RELATION_SCOPES), F.lit("relationship_scope_not_persistable"))
        .when(F.col("source_id").isNull(), F.lit("relationship_source_not_resolved_unique"))
        .when(F.col("target_id").isNull(), F.lit("relationship_target_not_resolved_unique"))
    )
    r = r.withColumn("_why", suspect)
    usable = F.col("_why").isNull() & (F.col("source_id") != F.col("target_id")) & (F.col("_fwd") != "") & (F.col("_back") != "") & (F.col("_type") != "")
    ev = locate_quotes(r.filter(usable).select("chapter_id", "ord", "quotes"), chapters, ["ord"], RELATION_REASON)
    r = r.withColumn("_use", F.coalesce(usable, F.lit(False))).join(ev, ["chapter_id", "ord"], "left")
    why = F.when(F.col("_why").isNotNull(), F.col("_why")).when(F.col("_use") & F.col("evidence").isNull(), F.lit("relationship_evidence_not_found_in_chapter"))
    suspects = r.withColumn("reason", why).filter("reason IS NOT NULL").select(
        "chapter_id", "reason", F.col("source_name").alias("subject"), F.col("target_name").alias("detail"))
    ok = r.filter(F.col("_use") & F.col("evidence").isNotNull())
    keep = K.text_key(F.col("_source")) <= K.text_key(F.col("_target"))
    ok = ok.select(
        "chapter_id", "ord", "confidence", "evidence", F.col("_type").alias("rtype"),
        F.when(keep, F.col("_source")).otherwise(F.col("_target")).alias("left_name"), F.when(keep, F.col("_target")).otherwise(F.col("_source")).alias("right_name"),
        F.when(keep, F.col("_fwd")).otherwise(F.col("_back")).alias("left_label"), F.when(keep, F.col("_back")).otherwise(F.col("_fwd")).alias("right_label"))
    ok = ok.withColumn("entity_key", F.concat_ws("|", F.lit("relationship"), K.ascii_key(F.col("left_name"), key_mode), K.ascii_key(F.col("right_name"), key_mode)))
    records = ok.groupBy("chapter_id", "entity_key").agg(
        F.min("ord").alias("record_ord"), F.min_by(F.concat_ws(" ↔ ", "left_name", "right_name"), "ord").alias("display_name"))
    two = F.array(
        F.struct(F.lit(0).alias("pos"), F.col("left_label").alias("value"), F.col("right_name").alias("related"), F.lit("self_to_related").alias("direction")),
        F.struct(F.lit(1).alias("pos"), F.col("right_label").alias("value"), F.col("left_name").alias("related"), F.lit("related_to_self").alias("direction")))
    rows = ok.join(records.select("chapter_id", "entity_key", "record_ord"), ["chapter_id", "entity_key"]).select(
        "chapter_id", "entity_key", "ord", "record_ord", "rtype", "confidence", "evidence", F.inline(two))
    values = merge_relationship_values(rows.withColumn("first", F.col("ord") == F.col("record_ord")), ["chapter_id", "entity_key"])
    return {"records": records, "values": values, "suspects": suspects}


def merge_relationship_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """I8 over a table: keys, pos, value, related, direction, rtype, confidence, evidence. ``rows`` also
    has ord, pos and first. The values of one pair in one chapter are few."""
    edge = edge_row("value", "related", "direction", "rtype", "confidence", "evidence")
    # same pair of names per group, so different edges never meet across groups
    group = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "pos", "first", edge.alias("edge")))).alias("_rs"))
    return group.select(*keys, F.posexplode(fold_edges(F.col("_rs"))).alias("pos", "_v")).select(
        *keys, "pos", *[F.col(f"_v.{c}").alias(c) for c in ("value", "related", "direction", "rtype", "confidence", "evidence")])


def known_relationship_context(records: DataFrame, values: DataFrame, present: DataFrame, limit: int | None = None) -> DataFrame:
    """Relationships of earlier chapters whose both ends are present in the current one.

    ``records``: scope_id, record_id, chapter_num, entity_key, display_name. ``values``: record_id,
    value, related, direction, rtype, evidence. ``present``: scope_id, chapter_num (current),
    identity_key (C3 keys of names and aliases). ``limit`` keeps the first hints of a chapter in record order
    and does not read records after the one that opens the last (the original lists HINT_LIMIT)."""
    parts = F.split("entity_key", r"\|")
    names = F.filter(F.transform(F.split("display_name", "↔"), K.trim_ws), lambda x: x != "")
    r = records.filter((F.size(parts) == 3) & (F.get(parts, F.lit(0)) == "relationship")).select(
        "scope_id", "record_id", F.col("chapter_num").alias("_at"), F.struct("chapter_num", "display_name", "record_id").alias("_order"),
        K.ascii_key(F.get(parts, F.lit(1))).alias("left_key"), K.ascii_key(F.get(parts, F.lit(2))).alias("right_key"), names.alias("_n"))
    spelled = F.size("_n") == 2
    r = r.withColumn("left_name", F.when(spelled, F.get("_n", F.lit(0))).otherwise(F.replace("left_key", F.lit("_"), F.lit(" ")))).withColumn(
        "right_name", F.when(spelled, F.get("_n", F.lit(1))).otherwise(F.replace("right_key", F.lit("_"), F.lit(" ")))).drop("_n")
    # what a record says, whatever chapter reads it
    v = values.join(r.select("record_id", "left_key", "right_key", "left_name", "right_name"), "record_id")
    d, rel = K.ascii_key(F.coalesce("direction", F.lit(""))), K.ascii_key(F.coalesce("related", F.lit("")))
    to_right = F.when(d == "self_to_related", F.lit(True)).when(d == "related_to_self", F.lit(False)).when(
        (rel == K.ascii_key(F.col("right_name"))) | (rel == F.col("right_key")), F.lit(True)).when(
        (rel == K.ascii_key(F.col("left_name"))) | (rel == F.col("left_key")), F.lit(False))
    label = K.blank_to_null(F.col("value"))
    kind = F.nullif(K.schema_key(F.coalesce("rtype", F.lit(""))), F.lit(""))
    v = v.withColumn("_r", to_right).withColumn("_l", label).withColumn("_t", kind)

    def best(col: str, cond: Column) -> Column:
        # most specific; of equals the first
        rank = F.when(cond & F.col(col).isNotNull(), F.struct(label_specificity(F.col(col)), -F.col("pos")))
        return F.max_by(col, rank)

    said = v.groupBy("record_id").agg(
        best("_t", F.lit(True)).alias("rtype"), best("_l", F.col("_r")).alias("forward"), best("_l", ~F.col("_r")).alias("backward"),
        F.array_distinct(F.flatten(F.collect_list(F.transform("evidence", lambda e: e["chapter_num"])))).alias("_ev")
    ).filter("rtype IS NOT NULL")
    here = present.select("scope_id", "chapter_num", "identity_key").distinct()
    pair = ["scope_id", "left_key", "right_key"]
    told = r.join(said, "record_id")
    # chapters in which both ends of a pair are present
    asked = told.select(*pair).distinct().join(here.withColumnRenamed("identity_key", "left_key"), ["scope_id", "left_key"]).join(
        here.withColumnRenamed("identity_key", "right_key"), ["scope_id", "chapter_num", "right_key"], "left_semi")
    hint = F.struct(
        F.col("_order").alias("o"), F.col("left_name").alias("ln"), F.col("right_name").alias("rn"), F.col("rtype").alias("t"), label_specificity(F.col("rtype")).alias("ts"),
        *[x for c in ("forward", "backward") for x in (
            F.col(c).alias(c[0]), label_tokens(F.coalesce(c, F.lit(""))).alias(c[0] + "t"), label_specificity(F.coalesce(c, F.lit(""))).alias(c[0] + "s"))],
        F.array(F.struct(F.col("_at").cast("long").alias("at"), F.col("_ev").alias("ev"))).alias("said"))

    def same(a: Column, b: Column) -> Column:
        return (a["t"] == b["t"]) | tokens_overlap(a["ft"], b["ft"]) | tokens_overlap(a["bt"], b["bt"])

    def merge(a: Column, b: Column) -> Column:
        def pick(c: str) -> list[Column]:
            better = (F.size(b[c + "t"]) > 0) & ((F.size(a[c + "t"]) == 0) | (b[c + "s"] > a[c + "s"]))
            return [F.when(better, b[x]).otherwise(a[x]).alias(x) for x in (c, c + "t", c + "s")]

        typed = b["ts"] > a["ts"]
        return F.struct(
            a["o"].alias("o"), a["ln"].alias("ln"), a["rn"].alias("rn"), F.when(typed, b["t"]).otherwise(a["t"]).alias("t"), F.greatest(a["ts"], b["ts"]).alias("ts"),
            *pick("f"), *pick("b"), F.concat(a["said"], b["said"]).alias("said"))

    def running(rows: Column) -> Column:
        """The hints after each record of a pair."""
        def add(hints: Column, h: Column) -> Column:
            return let(F.array_position(F.transform(hints, lambda x: same(x, h)), True), lambda p: F.when(
                p == 0, F.concat(hints, F.array(h))).otherwise(F.transform(hints, lambda x, i: F.when(i + 1 == p, merge(x, h)).otherwise(x))))

        def step(acc: Column, h: Column) -> Column:
            return let(add(acc["hints"], h), lambda hints: F.struct(hints.alias("hints"), F.concat(acc["out"], F.array(hints)).alias("out")))

        def scan(rs: Column) -> Column:
            none = F.slice(rs, F.lit(1), F.lit(0))
            start = F.struct(none.alias("hints"), F.slice(F.array(none), F.lit(1), F.lit(0)).alias("out"))
            return F.aggregate(rs, start, step, lambda acc: acc["out"])

        return let(rows, scan)

    def hints(records: DataFrame, by: list[str]) -> DataFrame:
        """(*by, chapter_num, _h): the hints of each asked chapter. The records of a pair are folded once, along the
        chapters; a chapter takes the state after the last record before it."""
        packed = records.groupBy(*by).agg(F.array_sort(F.collect_list(hint)).alias("_hs"))
        states = packed.select(*by, F.transform("_hs", lambda h: h["o"]["chapter_num"]).alias("_ats"), running(F.col("_hs")).alias("_states"))
        before = F.size(F.filter("_ats", lambda at: at < F.col("chapter_num")))
        return asked.join(states, by).withColumn("_n", before).filter("_n > 0").select(*asked.columns, F.explode(F.get("_states", F.col("_n") - 1)).alias("_h"))

    found = hints(told, pair)
    if limit is not None:
        # the record that opens the last allowed hint is the last one that a chapter reads
        w = Window.partitionBy("scope_id", "chapter_num").orderBy("_h.o")
        opened = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
        last = opened.groupBy("scope_id", "chapter_num").agg(F.max("_h.o").alias("_last"), F.max("_n").alias("_full"))
        read = told.join(asked, pair).filter("_at < chapter_num").join(last, ["scope_id", "chapter_num"]).filter((F.col("_full") < limit) | (F.col("_order") <= F.col("_last")))
        found = hints(read, [*pair, "chapter_num"])
    chapters = F.array_sort(F.array_distinct(F.flatten(F.transform("_h.said", lambda s: let(
        F.filter(s["ev"], lambda c: c < F.col("chapter_num")), lambda e: F.when(F.size(e) > 0, e).otherwise(F.array(s["at"])))))))
    return found.select(
        "scope_id", "chapter_num", "left_key", "right_key", F.col("_h.ln").alias("left_name"), F.col("_h.rn").alias("right_name"), F.col("_h.t").alias("relationship_type"),
        F.col("_h.f").alias("left_to_right"), F.col("_h.b").alias("right_to_left"), chapters.alias("evidence_chapters"))


def run_summary(chapters: DataFrame, records: DataFrame, suspects: DataFrame, reviews: DataFrame) -> DataFrame:
    """Counts per chapter and the status of its call. ``records``: chapter_id, group_key;
    ``reviews``: chapter_id, review_count."""
    rec = records.groupBy("chapter_id").agg(
        F.count_if(F.col("group_key") == "character").alias("character_record_count"), F.count_if(F.col("group_key") == "relationship").alias("relationship_record_count"))
    sus = suspects.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("suspect_count"))
    return (
        chapters.select("chapter_id").join(rec, "chapter_id", "left").join(sus, "chapter_id", "left").join(reviews, "chapter_id", "left")
        .fillna(0, ["character_record_count", "relationship_record_count", "suspect_count", "review_count"])
        .withColumn("status", F.when(F.col("suspect_count") > 0, F.lit("moved_to_review")).otherwise(F.lit("ok")))
    )
