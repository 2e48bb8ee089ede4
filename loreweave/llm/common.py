"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Fixed value: ASCII white space of the contracts.
SPACE = r"[\x20\x09-\x0D]"
#: Fixed value: what separates words, once A-Z are lower case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A side of a join is sent to all executors only if measured to be at most this large.
SMALL_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: later uses neither recompute it nor
    depend on one executor, and the planner knows its real size."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A staged table, marked for broadcast if its measured size allows it; else Spark shuffles both sides."""
    width = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
    size = df.agg(F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).head()[0]
    return F.broadcast(df) if size <= SMALL_BYTES else df


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z, all else stays. ``lower`` does the same on pure ASCII text and is faster."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Words of a whole text; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), NOT_WORD), ""), F.array().cast("array<string>"))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n
