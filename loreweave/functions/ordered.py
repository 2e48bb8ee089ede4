"""Ordered computations per key that never need one key in one task.

Rows are cut into buckets of the (unique, integer) order column. Work inside a bucket is a window
over (key, bucket); what crosses buckets is computed on one row per bucket and joined back. One key
may hold any share of the rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 65536


def bucket_of(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def lag_in_key(df: DataFrame, keys: Sequence[str], order: str, col: str, out: str, width: int = WIDTH) -> DataFrame:
    """Value of ``col`` on the previous row of the key."""
    b = df.withColumn("_b", bucket_of(order, width))
    w = Window.partitionBy(*keys, "_b").orderBy(order)
    inner = b.withColumn("_rn", F.row_number().over(w)).withColumn(out, F.lag(col).over(w))
    tails = b.groupBy(*keys, "_b").agg(F.max_by(col, order).alias("_tail"))
    prev = tails.withColumn(
        "_prev", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_b"))
    ).select(*keys, "_b", "_prev")
    return (
        inner.join(prev, [*keys, "_b"])
        .withColumn(out, F.when(F.col("_rn") == 1, F.col("_prev")).otherwise(F.col(out)))
        .select(*df.columns, out)
    )


def row_number_in_key(df: DataFrame, keys: Sequence[str], order: str, out: str, width: int = WIDTH) -> DataFrame:
    """1-based position of each row in its key."""
    b = df.withColumn("_b", bucket_of(order, width))
    inner = b.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(order)))
    sizes = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(*keys, "_b", "_base")
    return inner.join(base, [*keys, "_b"]).withColumn(out, F.col("_rn") + F.col("_base")).select(*df.columns, out)
