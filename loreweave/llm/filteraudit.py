"""Audit of how filters act together: what each removes first, again or alone in every order of the filters.

1. ``measure`` runs a table-driven byte transducer over each whole text (``bytescan``): one pass counts words, capitals,
   code points and symbols, and puts word spans into a hash table that compares bytes, so the number of distinct words
   is exact. Texts are read in blocks; a text of any length needs no array as long as the text.
2. ``repeats`` finds texts that a smaller doc_id holds too: least id per SHA-256 with map-side combine; only texts that
   occur twice are joined back, and AQE can split that join for a text that very many rows hold.
3. ``cells`` counts rows by part and by the set of filters they fail: 2 ** filters cells a part, whatever the input.
4. ``audit`` derives every order and step from the cells of a part. The share of a filter over all orders needs no
   orders: a row that fails k filters is removed first by each of them in 1 / k of the orders.

Edge cases: null text is empty (no words, so A holds; E if a smaller id is empty too); a null doc_id is no smaller id
and is larger than any other; rows that repeat doc_id and text are counted each and are no repeats of each other; a null
source is the part ``''``; a document with several labels counts as good or toxic if one of them says so, one without
labels as neither; columns of other names are ignored; an empty table gives no rows.
"""
from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import SPACES, Reader, SpanTable, machine
from .bytewords import chunks
from .common import stage

#: Fixed value: the symbols of filter D.
SYMBOLS = b"#$%&*|"
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")
#: The bounds of filters A to C.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
TOTALS = ("n", "good", "toxic")


def counts(texts: pa.Array) -> np.ndarray:
    """(count, text) of whole texts, in the order of ``COUNTS``."""
    out = np.zeros((len(COUNTS), len(texts)), np.int64)
    m = machine(SPACES, SYMBOLS)
    for first, end, data, offsets in chunks(texts):
        reader, table = Reader(m, data, offsets), SpanTable(data)
        for spans in reader.blocks():
            out[0, first:end] += np.bincount(spans.text, minlength=end - first)
            table.insert(spans.start, spans.length, spans.text, spans.hash)
        out[1, first:end] = np.bincount(table.owner[: table.n], minlength=end - first)
        out[2:, first:end] = reader.capitals, reader.points, reader.symbols
    return out


def measure(text: Column) -> Column:
    """Struct of ``COUNTS`` of a whole text."""

    @F.arrow_udf(", ".join(f"{name} bigint" for name in COUNTS))
    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in counts(texts)], list(COUNTS))

    return run(text)


def failures(m: Column) -> list[Column]:
    """Filters A to D on the counts of a text."""
    return [
        m["n_words"] < LEAST_WORDS,
        100 * m["n_distinct"] < LEAST_DISTINCT * m["n_words"],
        100 * m["n_capitals"] > MOST_CAPITALS * m["n_points"],
        m["n_symbols"] > 0,
    ]


def as_set(failed: list[Column]) -> Column:
    """The set of filters that a row fails, as a number with bit i for filter i."""
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, digest and more) with ``repeat``: a row with a smaller doc_id has the digest."""
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    found = rows.join(least.select("digest", "_least"), "digest", "left")
    again = F.col("_least").isNotNull() & (F.col("doc_id").isNull() | (F.col("_least") < F.col("doc_id")))
    return found.withColumn("repeat", again).drop("_least")


def cells(rows: DataFrame, failed: list[Column], part: Column, good: Column, toxic: Column) -> DataFrame:
    """part and arrays n, good, toxic: rows by the set of filters they fail."""
    counted = rows.groupBy(part.alias("part"), as_set(failed).alias("fails")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good"), F.count_if(toxic).alias("toxic")
    )
    # At most 2 ** filters entries a part.
    found = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("fails", F.struct(*TOTALS)))).alias("m"))
    sets = F.sequence(F.lit(0), F.lit((1 << len(failed)) - 1))

    def of_every_set(name: str) -> Column:
        return F.transform(sets, lambda i: F.coalesce(F.col("m")[i][name], F.lit(0)))

    return found.select("part", *(of_every_set(name).alias(name) for name in TOTALS))


def audit(by_set: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of that step. ``names`` has a letter a filter."""
    k = len(names)
    every = F.split(F.lit(",".join(map("".join, permutations(names)))), ",")
    rows = by_set.select("part", *TOTALS, F.explode(every).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))

    def bits(letters: Column) -> Column:
        return as_set([F.instr(letters, name) > 0 for name in names])

    rows = rows.withColumns({
        "own": bits(F.col("filter_order").substr(F.col("step"), F.lit(1))),
        "before": bits(F.col("filter_order").substr(F.lit(1), F.col("step") - 1)),
    })
    own, before = F.col("own"), F.col("before")
    sets = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    orders = int(np.prod(range(1, k + 1)))
    size = [bin(i).count("1") for i in range(1 << k)]
    share = F.array(*(F.lit(orders // max(1, n)) for n in size))

    def total(name: str, chosen) -> Column:
        """Sum over the sets of failed filters that ``chosen`` takes."""
        return F.aggregate(sets, F.lit(0).cast("bigint"), lambda a, i: a + F.when(chosen(i), F.get(F.col(name), i)).otherwise(0))

    def has(i: Column, bits: Column) -> Column:
        return i.bitwiseAND(bits) != 0

    def first(i: Column) -> Column:
        return has(i, own) & ~has(i, before)

    shapley = F.aggregate(sets, F.lit(0).cast("bigint"), lambda a, i: a + F.when(has(i, own), F.get(F.col("n"), i) * F.get(share, i)).otherwise(0))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda i: ~has(i, own) & ~has(i, before)).alias("kept"),
        total("n", first).alias("removed"),
        total("n", lambda i: has(i, own) & has(i, before)).alias("redundant"),
        total("n", lambda i: i == own).alias("unique_fails"),
        total("good", first).alias("good_lost"),
        total("toxic", first).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Audit of filters A to E over ``docs`` by source."""
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    measured = d.select("doc_id", "part", F.sha2("text", 256).alias("digest"), measure(F.col("text")).alias("m"))
    kinds = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    base = as_set(failures(F.col("m")))
    rows = stage(measured.select("doc_id", "part", "digest", base.alias("base")), "audit-rows")
    known = repeats(rows).join(kinds, "doc_id", "left")
    bits = [F.col("base").bitwiseAND(1 << i) != 0 for i in range(4)]
    yes = {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}
    return audit(cells(known, [*bits, F.col("repeat")], F.col("part"), yes["good"], yes["toxic"]), "ABCDE")
