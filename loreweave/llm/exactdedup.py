"""Exact deduplication over an extendible-hash index kept in shared files.

1. Texts are normalised and grouped by (key, text) with map-side combine, so that Spark compares the bytes
   of all texts of one 64-bit key and a group of a billion copies reaches its owner as one row per map task.
2. The directory starts with one bucket; a bucket of more than ``capacity`` entries doubles the directory and
   is split by the next bit of the key. ``directory`` states the outcome for every prefix at once.
3. Owner tasks each take whole buckets, which are key ranges, and chain the entries of one key (true
   collisions) in order. The index goes to files in the shared folder.
4. Rows find their entry by (key, SHA-256). AQE can split that join for a hot text.

Edge cases: null text counts as empty; a null doc_id ranks behind all others (``keep_id`` is null only if a
group has no other); rows that repeat both doc_id and text count in ``group_size`` and exactly one of them is
kept; an empty table gives no rows. Other columns are passed through by ``keep_first`` whatever their names.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stage


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, key, sha) of every row."""
    d = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    return d.select("doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha"))


def directory(entries: DataFrame, capacity: int) -> DataFrame:
    """(fine, depth): for every prefix of ``bits`` key bits the depth of the bucket that holds it.

    The directory may double as often as an even spread would need and four times more; keys are hashes of
    distinct texts, so deeper splits could only part equal keys, which are chained instead.
    """
    bits = max(1, math.ceil(math.log2(max(1, entries.count() / capacity)))) + 4
    counts = entries.groupBy(fine(bits).alias("fine")).count()
    depths = counts.select("fine", "count", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    sizes = depths.withColumn("prefix", F.expr(f"shiftright(fine, {bits} - depth)"))
    total = sizes.groupBy("depth", "prefix").agg(F.sum("count").alias("n"))
    fits = sizes.join(total, ["depth", "prefix"]).filter((F.col("n") <= capacity) | (F.col("depth") == bits))
    return fits.groupBy("fine").agg(F.min("depth").alias("depth")).select(
        "fine", "depth", F.expr(f"shiftright(fine, {bits} - depth)").alias("prefix"), F.lit(bits).alias("bits")
    )


def fine(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits)


def build_index(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """The index: one entry per distinct normalised text, in files sorted by bucket and key."""
    d = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    grouped = d.groupBy(F.xxhash64("norm").alias("key"), "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = stage(grouped.select("key", "keep_id", "group_size", F.sha2("norm", 256).alias("sha")), "dedup-entries")
    buckets = stage(directory(entries, capacity), "dedup-directory")
    first = buckets.select("bits").head()
    owned = entries.withColumn("fine", fine(first.bits if first else 1)).join(buckets.drop("bits"), "fine").repartition("depth", "prefix")
    chained = Window.partitionBy("depth", "prefix", "key").orderBy(F.col("keep_id").asc_nulls_last(), "sha")
    chains = owned.withColumn("chain", F.row_number().over(chained)).sortWithinPartitions("depth", "prefix", "key", "chain")
    return stage(chains.select("depth", "prefix", "key", "chain", "sha", "keep_id", "group_size"), "dedup-index")


def assign(digests: DataFrame, index: DataFrame) -> DataFrame:
    """One row per row of ``digests``: doc_id, keep_id, group_size, kept, text_sha256."""
    found = digests.join(index.select("key", "sha", "keep_id", "group_size"), ["key", "sha"])
    # Dealt anew by text and id, so that a hot text stays spread; orders rows only where an id repeats.
    same = Window.partitionBy("sha", "doc_id").orderBy("key")
    turn = found.repartition("sha", "doc_id").withColumn("turn", F.row_number().over(same))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)
    return turn.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, index: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), normalised(F.col("text")).alias("norm"))
    d = d.select("row", "id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha"))
    found = d.join(index.select("key", "sha", "keep_id"), ["key", "sha"]).filter(F.col("id").eqNullSafe(F.col("keep_id")))
    # Rows that repeat id and text: normally none.
    twice = stage(digests.groupBy("sha", "doc_id").count().filter("count > 1").select("sha", F.col("doc_id").alias("twice")), "dedup-twice")
    if twice.isEmpty():
        return found.select("row.*")
    same = (found.sha == twice.sha) & found.id.eqNullSafe(twice.twice)
    turn = Window.partitionBy("sha", "id").orderBy("key")
    one = found.join(twice, same, "left_semi").withColumn("turn", F.row_number().over(turn)).filter("turn = 1")
    return found.join(twice, same, "left_anti").select("row.*").unionByName(one.select("row.*"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Pipeline form: the rows that stay."""
    return keep_first(docs, build_index(docs), stage(digest(docs), "dedup-digests"))
