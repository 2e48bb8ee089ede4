"""Gates for attribute values: what is kept, and why the rest is not."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions import keys as K
from loreweave.functions import vocab as V

# --- Fixed values -------------------------------------------------------------------------
VALUE_CONFIDENCE = 0.85
VERIFY_CONFIDENCE = 0.85
APPEARANCE = ("appearance", "Ngoại hình")
# ------------------------------------------------------------------------------------------


def value_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(K.folded_key(c), "_"), lambda t: F.length(t) >= 2))


def value_grounded(value: Column, quotes: Column) -> Column:
    """The words of the value are in one quote: all of up to two, else at least three fifths."""
    t = value_tokens(value)

    def enough(q: Column) -> Column:
        hit = F.size(F.array_intersect(t, value_tokens(q)))
        return F.when(F.size(t) <= 2, hit == F.size(t)).otherwise(hit * 5 >= F.size(t) * 3)

    return (F.size(t) > 0) & F.exists(quotes, lambda q: q.isNotNull() & (F.size(value_tokens(q)) > 0) & enough(q))


def gate_field_values(values: DataFrame, own_keys: DataFrame, other_keys: DataFrame, keys: Sequence[str] = ("identity_id",)) -> tuple[DataFrame, DataFrame]:
    """G1: (kept, rejected with the first reason). ``values``: keys, value_id, field_key, value_text,
    confidence, chapter_num, quotes. ``own_keys`` and ``other_keys``: keys, skey (C1 keys of the
    identity itself and of the other characters)."""
    v = values.withColumn("value_text", K.trim_ws(F.col("value_text"))).withColumn("_k", K.text_key(F.col("value_text")))
    for name, table in (("_own", own_keys), ("_other", other_keys)):
        t = table.select(*keys, F.col("skey").alias("_k"), F.lit(True).alias(name)).filter("_k <> ''").distinct()
        v = v.join(t, [*keys, "_k"], "left")
    quotes = F.filter("quotes", lambda q: q.isNotNull())
    reason = (
        F.when(K.ascii_key(F.col("field_key")) != APPEARANCE[0], F.lit("field_not_kept"))
        .when(F.col("value_text") == "", F.lit("value_blank"))
        .when(F.col("_own").isNotNull(), F.lit("value_is_own_name"))
        .when(F.col("_other").isNotNull(), F.lit("value_is_other_name"))
        .when(~F.exists(quotes, lambda q: K.trim_ws(q) != ""), F.lit("no_quote"))
        .when(~F.exists(quotes, lambda q: F.contains(q, F.lit("[[")) & F.contains(q, F.lit("]]"))), F.lit("no_marker"))
        .when(F.coalesce("confidence", F.lit(-1.0)) < VALUE_CONFIDENCE, F.lit("low_confidence"))
        .when(~value_grounded(F.col("value_text"), F.col("quotes")), F.lit("not_grounded"))
    )
    v = v.withColumn("reason", reason).drop("_k", "_own", "_other")
    bare = F.transform("quotes", lambda q: F.replace(F.replace(q, F.lit("[["), F.lit("")), F.lit("]]"), F.lit("")))
    kept = v.filter("reason IS NULL").drop("reason").withColumn("quotes", bare).withColumn(
        "field_key", F.lit(APPEARANCE[0])).withColumn("field_label", F.lit(APPEARANCE[1]))
    return kept, v.filter("reason IS NOT NULL").select(*keys, "value_id", "reason")


def apply_field_decisions(values: DataFrame, decisions: DataFrame, own_keys: DataFrame, keys: Sequence[str] = ("identity_id",)) -> tuple[DataFrame, DataFrame]:
    """(kept, report). ``decisions``: keys, value_id, accepted, confidence, semantic_class,
    owner_name. No decision rejects the value. ``own_keys``: C13 surface keys of the identity."""
    owner = K.text_key(F.coalesce("owner_name", F.lit("")))
    d = decisions.select(
        *keys, "value_id", "accepted", F.col("confidence").alias("_conf"), K.ascii_key(F.coalesce("semantic_class", F.lit(""))).alias("_class"),
        K.is_blank(F.col("owner_name")).alias("_anyone"), owner.alias("_k"),
    ).join(own_keys.select(*keys, F.col("skey").alias("_k"), F.lit(True).alias("_own")).distinct(), [*keys, "_k"], "left")
    ok = (
        F.coalesce("accepted", F.lit(False)) & (F.coalesce("_conf", F.lit(0.0)) >= VERIFY_CONFIDENCE)
        & F.coalesce(F.col("_class").isin(*V.APPEARANCE_CLASSES), F.lit(False)) & (F.coalesce("_anyone", F.lit(False)) | F.col("_own").isNotNull())
    )
    j = values.join(d.drop("_k"), [*keys, "value_id"], "left").withColumn("_ok", ok)
    report = j.select(*keys, "value_id", F.col("_ok").alias("accepted"))
    return j.filter("_ok").select(*values.columns), report
