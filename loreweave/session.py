"""Session defaults. Everything here can be overridden by the cluster."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "loreweave", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # text work is bound by the processor: small splits keep all cores busy
        "spark.sql.files.maxPartitionBytes": "16m",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster; a private one only where none is named (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        folder = os.path.join(tempfile.gettempdir(), "loreweave-checkpoints")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that an iterative job survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the checkpoint folder and read it back: later uses do not compute it again, and the planner
    knows its size."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
