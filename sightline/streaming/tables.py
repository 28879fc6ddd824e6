"""Keeping engine tables current from a stream: one small delta per batch, folded into a base now and then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans import merge, tables


def entity_deltas(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes what a batch adds, not the table. A batch that is run again overwrites its own delta, so
    restarts do not count twice."""
    def write(batch: DataFrame, batch_id: int) -> None:
        tables.entity_rows(batch).write.mode("overwrite").parquet(f"{path}/kind=delta/batch={batch_id}")

    return write


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """The last base and the deltas after it."""
    parts = spark.read.option("basePath", path).parquet(path)
    base = parts.where("kind = 'base'").agg(F.coalesce(F.max("batch"), F.lit(-1))).scalar()
    return parts.where(((F.col("kind") == "base") & (F.col("batch") == base)) | ((F.col("kind") == "delta") & (F.col("batch") > base)))


def current_entities(spark: SparkSession, path: str) -> DataFrame:
    """Base and deltas added up, one aggregate with map-side combine: the same as one upsert after the other."""
    first, last = F.struct("first_seen_at", "batch"), F.struct("last_seen_at", "batch")
    return _parts(spark, path).groupBy("entity_id").agg(
        F.min("first_seen_at").alias("first_seen_at"), F.min_by("first_seen_device", first).alias("first_seen_device"),
        F.max("last_seen_at").alias("last_seen_at"), F.max_by("last_seen_device", last).alias("last_seen_device"),
        F.sum("sighting_count").alias("sighting_count"), F.min_by("source", "batch").alias("source"), F.min_by("is_active", "batch").alias("is_active"))


def compact(spark: SparkSession, path: str, batch_id: int) -> None:
    """Fold base and deltas up to the last finished batch, ``batch_id``, into a new base; to be called on a schedule, between batches."""
    current_entities(spark, path).write.mode("overwrite").parquet(f"{path}/kind=base/batch={batch_id}")


def counters(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """Row counters and averages collected while the data passes by."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.max("frame_no").alias("last_frame"), F.avg("confidence").alias("avg_confidence")), seen


def reconcile_on_schedule(load: Callable[[], merge.Tables], apply: Callable[[DataFrame], None]) -> bool:
    """One run of the background reconciler, for whatever scheduler calls it."""
    merges = merge.reconcile(load())
    if merges.isEmpty():
        return False
    apply(merges)
    return True
