"""Mixing of sources to target weights by Pareto order sampling.

Every source has a target number of words. The expected copies of a document are its preference times the level of its
source, at most ``most``; the level is set by water filling, so that expected words meet the target and what documents at
their limit leave goes to the others. A document takes as many whole copies as that number surely holds; the fraction
that is left is its inclusion probability for one more copy. The documents of a source are ranked by random odds over inclusion odds (Pareto order sampling) and take
the further copy in that order until the words of the source are used up; the document on the border
takes only the words that are left. So the sample of each source has a fixed size in words.

No window ever sees a source as a whole: ranks are cut into ``BUCKETS`` ranges, words are summed per
(source, range), and only the one range of a source on which its border falls is ordered row by row.

Edge cases: null or empty text has size 0 and takes nothing; a null source is a source of its own and sorts
last; repeated rows are rows of their own, of which equal ones are interchangeable; a source without words
has target 0; an empty table gives no rows. Other columns of the input are passed through by ``mix``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stage

BUCKETS = 4096
#: Preferences count in steps of this part of a doubling, so a source has some hundred of them at most.
STEPS = 16


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; each run becomes one letter, then letters are counted."""
    marked = F.regexp_replace(text, rf"{SPACE}*[^\x20\x09-\x0D]+{SPACE}*", "x")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.length(marked)).otherwise(0).cast("bigint")


def targets(sources: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size) with ``target``: ``share`` of all words dealt by weight, at most ``most`` times
    the size of a source, the excess dealt again by weight until none is above (water filling).

    Sorted by size over weight, the sources that end at their limit are a prefix, so running sums over the
    sources give the level. Sources are one row each here.
    """
    # The row number of a source is its place among distinct names, a table of one narrow row per source.
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(ordered) - 1) % len(weights)
    s = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), (at + 1).cast("int")))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_limit = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    s = s.withColumn("_limit", F.lit(float(most)) * F.col("source_size")).withColumn(
        "_all", F.lit(float(share)) * F.sum("source_size").over(everything)
    )
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_full", F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
    s = s.withColumn("_open", F.sum("_w").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # The level if all before are at their limit; it is highest at the first source that stays below its own.
    s = s.withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_open"))
    s = s.withColumn("_is_open", (F.col("_level") * F.col("_w") < F.col("_limit")).cast("int"))
    s = s.withColumn("_level", F.max(F.when(F.col("_is_open") == 1, F.col("_level"))).over(everything))
    goal = F.least(F.col("_limit"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_limit")))
    return s.select("source", "source_size", goal.alias("target"))


def damped(size: Column) -> Column:
    """A preference that falls slowly with the words of a document, so that long ones do not crowd out the many short
    ones of their source: one over the fourth root."""
    return F.pow(F.greatest(size, F.lit(1)).cast("double"), F.lit(-0.25))


def levels(likings: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """(source, level) such that the words of a source times min(``most``, level * preference) meet its target.

    ``likings``: source, _p, _w (words of that preference). Sorted by falling preference, those at their limit are a
    prefix, so running sums over the preferences of a source give the level."""
    s = likings.join(goals, likings.source.eqNullSafe(goals._g)).drop("_g")
    whole = Window.partitionBy("source")
    by_limit = whole.orderBy(F.desc("_p"))
    full = F.coalesce(F.sum("_w").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    rest = F.sum(F.col("_p") * F.col("_w")).over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("_level", F.when(rest > 0, (F.col("target") - full) / rest))
    below = F.col("_level") * F.col("_p") < most
    # The level if all before are at their limit; it is highest at the first preference that stays below its own.
    return s.groupBy("source").agg(F.max(F.when(below, F.col("_level"))).alias("level"))


def mix(
    docs: DataFrame,
    share: float = 1.5,
    weights: tuple[float, ...] = (3, 1, 2),
    most: int = 2,
    preference: str | None = None,
    size: str | None = None,
    seed: int = 20,
) -> DataFrame:
    """Rows of ``docs`` as struct ``row`` with size, source_size, target, expected (copies), copies (whole ones) and
    taken (words).

    ``preference`` names a positive column that raises or lowers the expected copies of a document within its
    source (null, zero and less count as 1); without it all documents of a source are alike. ``size`` names a column that
    already holds the words of a row; else they are counted in ``text``.
    """
    given = F.col(preference).cast("double") if preference else F.lit(1.0)
    liking = F.when(given > 0, F.pow(F.lit(2.0), F.round(F.log2(given) * STEPS) / STEPS)).otherwise(1.0)
    random = F.xxhash64(F.lit(seed), F.col("_id"), F.col("size")).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5
    d = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("source"), F.col("doc_id").alias("_id"),
        (F.coalesce(F.col(size), F.lit(0)) if size else n_words(F.col("text"))).alias("size"), liking.alias("_p"),
    ).withColumn("_u", random / float(1 << 52))
    likings = stage(d.groupBy("source", "_p").agg(F.sum("size").alias("_w")), "mix-sources")
    per_source = likings.groupBy("source").agg(F.sum("_w").alias("source_size"))
    t = stage(targets(per_source, share, weights, most), "mix-goals")
    goals = t.select(F.col("source").alias("_g"), "target")
    level = levels(likings, goals, most)
    facts = t.join(level, t.source.eqNullSafe(level.source)).select(
        t.source.alias("_s"), "source_size", "target", "level",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_mean"),
    )
    facts = stage(facts, "mix-targets")
    d = d.join(facts, d.source.eqNullSafe(facts._s)).drop("_s")
    # Without a level all documents of the source are at their limit. Copies are certain up to the whole part; 1e-9 keeps
    # a number that is whole but for rounding whole.
    limit = F.when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0)
    d = d.withColumn("expected", F.when(F.col("level").isNull(), limit).otherwise(F.least(limit, F.col("level") * F.col("_p"))))
    d = d.withColumn("copies", F.floor(F.col("expected") + 1e-9).cast("bigint"))
    expected = F.col("expected")
    part = F.least(F.greatest(expected - F.col("copies"), F.lit(1e-9)), F.lit(1 - 1e-9))
    typical = F.least(F.greatest(F.col("_mean") - F.floor(F.col("_mean") + 1e-9), F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = F.col("_u") / (1 - F.col("_u")) / (part / (1 - part)) * (typical / (1 - typical))
    d = d.withColumn("_rank", odds / (1 + odds))
    d = d.withColumn("_bucket", F.least(F.floor(F.col("_rank") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    d = d.withColumn("_more", F.when(F.col("copies") < most, F.col("size")).otherwise(0))

    sums = d.groupBy("source", "_bucket").agg(
        F.sum("_more").alias("_words"), F.sum(F.col("copies") * F.col("size")).alias("_sure"), F.first("target").alias("target")
    )
    whole = Window.partitionBy("source")
    run = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.round(F.col("target")).cast("bigint") - F.sum("_sure").over(whole), F.lit(0))
    cut = sums.select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_words",
        (left - F.coalesce(F.sum("_words").over(run), F.lit(0))).alias("_left"),
    )
    cut = stage(cut, "mix-borders")
    d = d.join(cut, d.source.eqNullSafe(cut._s) & (d._bucket == cut._b)).drop("_s", "_b")
    out = ["row", "size", "source_size", "target", "expected", "copies"]
    border = (F.col("_left") > 0) & (F.col("_left") < F.col("_words"))
    sure = F.col("copies") * F.col("size")
    flat = d.filter(~border).select(*out, (sure + F.when(F.col("_left") > 0, F.col("_more")).otherwise(0)).alias("taken"))
    in_order = Window.partitionBy("source", "_bucket").orderBy("_rank", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("_left") - F.coalesce(F.sum("_more").over(in_order), F.lit(0))
    near = d.filter(border).select(*out, (sure + F.greatest(F.least(F.col("_more"), rest), F.lit(0))).alias("taken"))
    return flat.unionByName(near)
