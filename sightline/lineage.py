"""Cutting lineage on shared storage, so that a lost executor costs no restart."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; fall back to a private one only when
    everything runs in one local JVM."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and forget how it was made."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
