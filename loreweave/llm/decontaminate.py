"""Benchmark decontamination with a distributed positional inverted index.

1. ``item_windows`` cuts each benchmark item into windows of ``size`` words (a shorter item is one window).
2. ``term_counts`` counts every term of the items over all documents; ``anchors`` then names, for each window,
   its rarest terms. Only lists of these terms are ever read, so ``build_index`` stores the postings
   (term, document, position) of these, for all documents, in shared files.
3. ``candidates`` starts from the list of the rarest term of a window, shifts it by the place of the term in
   the item and intersects it with the shifted list of the next rarest: what is left are alignments
   (document, item, shift).
4. ``phrase_hits`` lays the words of the item over the document at each alignment and marks the words of every
   window that is equal in all words; ``proximity`` instead reports documents in which the rarest terms of a
   window lie close together in any order.

A document is known by (doc_id, hash of its text), so repeated rows share one entry and equal ids with other
texts do not mix. Terms are 64-bit hashes in the lists; the final test compares words.

Edge cases: null or empty texts have no words and are never hit; an item without words has no window; items or
documents that repeat are treated alike; an empty table on either side gives zero hits. ``keep_clean`` passes all
columns of the documents through, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textfns import let
from .common import small, stage, words

WINDOW = 13


def text_key() -> Column:
    return F.xxhash64("text")


def item_windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(item_id, item_words) of distinct items with words, and (item, start, place, term) of all windows."""
    w = items.select("item_id", words(F.col("text")).alias("item_words")).filter(F.size("item_words") > 0).distinct()
    w = stage(w.withColumn("item", F.xxhash64("item_id", "item_words")), "decon-items")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("item_words") - size, F.lit(0))))
    parts = w.select("item", "item_words", starts.alias("start"))
    placed = parts.select("item", "start", F.posexplode(F.slice("item_words", F.col("start") + 1, size)).alias("at", "word"))
    return w, placed.select("item", "start", (F.col("start") + F.col("at")).alias("place"), F.xxhash64("word").alias("term"))


def term_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(term, n): how often each term of the items occurs in all documents; 0 if never."""
    terms = stage(windows.select("term").distinct(), "decon-terms")
    tokens = docs.select(F.explode(words(F.col("text"))).alias("word")).select(F.xxhash64("word").alias("term"))
    counted = tokens.join(small(terms), "term").groupBy("term").count()
    return terms.join(counted, "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("n"))


def anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, term1, place1, term2, place2): the two rarest places of each window, once per item. Windows with
    a term that no document holds cannot occur and are left out."""
    order = Window.partitionBy("item", "start").orderBy("n", "place")
    ranked = windows.join(counts, "term").withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    pairs = ranked.groupBy("item", "start").agg(
        F.min("n").alias("n"),
        *[F.min(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("term", "place")],
    )
    one = F.col("term2").isNull()
    return pairs.filter("n > 0").select(
        "item", "term1", "place1", F.when(one, F.col("term1")).otherwise(F.col("term2")).alias("term2"),
        F.when(one, F.col("place1")).otherwise(F.col("place2")).alias("place2"),
    ).distinct()


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, doc_id, text_key, position) of the given terms over all documents, in shared files."""
    tokens = docs.select("doc_id", text_key().alias("text_key"), F.posexplode(words(F.col("text"))).alias("position", "word"))
    tokens = tokens.select(F.xxhash64("word").alias("term"), "doc_id", "text_key", "position")
    return stage(tokens.join(small(terms), "term"), "decon-postings")


def candidates(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, text_key, item, shift): intersection of the shifted lists of the two rarest terms."""
    first = index.join(small(stage(pairs, "decon-pairs")), index.term == F.col("term1")).select(
        "doc_id", "text_key", "item", (F.col("position") - F.col("place1")).alias("shift"),
        F.col("term2").alias("term"), (F.col("position") - F.col("place1") + F.col("place2")).alias("position"),
    )
    same = ["text_key", "position", "term"]
    other = index.select(F.col("doc_id").alias("other"), *same).distinct()
    met = first.filter("position >= 0").join(other, same).filter(F.col("doc_id").eqNullSafe(F.col("other")))
    return met.select("doc_id", "text_key", "item", "shift").distinct()


def phrase_hits(docs: DataFrame, found: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, item_id, position): the document words inside an occurring window."""
    keys = found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()
    keys = small(stage(keys, "decon-keys"))
    texts = docs.select("doc_id", "text", text_key().alias("text_key"))
    texts = texts.join(keys, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").distinct()
    texts = texts.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), words(F.col("text")).alias("doc_words"))
    # One row per document and item, so that the words of a document are not copied for each alignment; a word is read
    # by its index.
    laid = found.groupBy("doc_id", "text_key", "item").agg(F.collect_list("shift").alias("shifts")).join(items, "item")
    laid = laid.join(texts, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    n, need = F.size("item_words"), F.least(F.lit(size), F.size("item_words"))

    def covered(shift: Column) -> Column:
        """Document words inside equal windows, if item word i lies over document word i + shift."""
        low = F.greatest(-shift, F.lit(0))
        many = F.greatest(F.least(n, F.size("doc_words") - shift) - low, F.lit(0))
        same = F.transform(F.sequence(low, low + many - 1), lambda i: F.get("item_words", i) == F.get("doc_words", i + shift))

        def words_of(equal: Column) -> Column:
            whole = F.filter(F.sequence(F.lit(0), many - need), lambda s: F.forall(F.slice(equal, s + 1, need), lambda x: x))
            return F.flatten(F.transform(whole, lambda s: F.sequence(low + shift + s, low + shift + s + need - 1)))

        return F.when(many >= need, let(same, words_of)).otherwise(F.array().cast("array<int>"))

    hit = F.explode(F.array_distinct(F.flatten(F.transform("shifts", covered)))).alias("position")
    return laid.select("doc_id", "text_key", "item_id", hit).distinct()


def find(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_hit, n_items, item_ids as one sorted, joined string) of the documents that are hit."""
    known, windows = item_windows(items, size)
    windows = stage(windows, "decon-windows")
    pairs = stage(anchors(windows, term_counts(docs, windows)), "decon-anchors")
    terms = stage(pairs.select(F.explode(F.array("term1", "term2")).alias("term")).distinct(), "decon-rare")
    hits = stage(phrase_hits(docs, stage(candidates(build_index(docs, terms), pairs), "decon-found"), known, size), "decon-hits")
    n_hit = hits.select("doc_id", "text_key", "position").distinct().groupBy("doc_id", "text_key").count()
    # The items of one document: at most as many as it has windows.
    per_item = hits.select("doc_id", "text_key", F.col("item_id").cast("string").alias("id")).distinct()
    ids = per_item.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("item_ids")
    )
    both = n_hit.join(ids, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return stage(both.select("doc_id", "text_key", F.col("count").alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids")), "decon-result")


def judge(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with n_words, n_hit, n_items, item_ids and contaminated."""
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_k"), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    j = d.join(small(hits), (F.col("_k") == F.col("text_key")) & F.col("_d").eqNullSafe(F.col("doc_id")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return j.select(
        "row", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Pipeline form: the rows that are not contaminated."""
    return judge(docs, find(docs, items, size)).filter(~F.col("contaminated")).select("row.*")


def proximity(index: DataFrame, pairs: DataFrame, span: int = 30) -> DataFrame:
    """(doc_id, text_key, item, first, last): places where the two rarest terms of a window of the item lie at
    most ``span`` words apart, in any order. Positions meet by blocks of ``span`` words, not by all pairs."""
    a = index.join(pairs, index.term == F.col("term1")).select(
        F.col("doc_id"), F.col("text_key"), "item", F.col("term2").alias("term"), F.col("position").alias("p1"),
        F.explode(F.array(*[F.floor(F.col("position") / span) + i for i in (-1, 0, 1)])).alias("block"),
    )
    b = index.select(F.col("doc_id").alias("d"), "text_key", "term", F.col("position").alias("p2"), F.floor(F.col("position") / span).alias("block"))
    near = a.join(b, ["text_key", "term", "block"]).filter(F.col("doc_id").eqNullSafe(F.col("d")) & (F.abs(F.col("p1") - F.col("p2")) <= span))
    return near.select("doc_id", "text_key", "item", F.least("p1", "p2").alias("first"), F.greatest("p1", "p2").alias("last")).distinct()
