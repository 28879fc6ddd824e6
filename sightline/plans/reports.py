"""Counting reports over the engine tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values
RECOVERY_METHODS = (
    "spatial_appearance_reuse", "recent_person_reuse", "recent_person_reuse_after_fallback", "tentative_soft_match",
    "soft_match_at_promotion", "ambiguous_resolved", "current_identity_maintained",
)


def histogram(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *cols)


def tracklets_per_entity(tracklets: DataFrame) -> DataFrame:
    return tracklets.groupBy("entity_id").agg(F.count(F.lit(1)).alias("tracklets"))


def traffic_per_device(sightings: DataFrame) -> DataFrame:
    per_entity = sightings.groupBy("device_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return per_entity.groupBy("device_id").agg(F.sum("n").alias("sightings"), F.count(F.lit(1)).alias("entities"))


def cross_device_entities(sightings: DataFrame, min_devices: int = 2) -> DataFrame:
    pairs = sightings.groupBy("entity_id", "device_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        pairs.groupBy("entity_id")
        .agg(F.sort_array(F.collect_list("device_id")).alias("devices"), F.count(F.lit(1)).alias("device_count"),
             F.sum("n").alias("sightings"))
        .where(F.col("device_count") >= min_devices)
    )


def tracklet_summary(tracklets: DataFrame) -> DataFrame:
    """Quality of an entity's tracklets: missing scores count as zero."""
    overall = F.coalesce(F.col("overall"), F.lit(0.0))
    return tracklets.groupBy("entity_id").agg(
        F.avg(overall).alias("avg_consistency"),
        F.avg(F.coalesce(F.col("good_ratio"), F.lit(0.0))).alias("avg_good_ratio"),
        F.count_if(F.col("match_method").isin(*RECOVERY_METHODS)).alias("recoveries"),
        F.count_if(overall >= 0.7).alias("high_quality"),
    )


def busiest_devices(sightings: DataFrame, top: int = 8) -> DataFrame:
    counts = sightings.groupBy("device_id").agg(F.count(F.lit(1)).alias("sightings"))
    best = counts.orderBy(F.desc("sightings"), F.asc("device_id")).limit(top)
    # at most ``top`` rows reach this window
    return best.withColumn("share", F.col("sightings") / F.max("sightings").over(Window.partitionBy()))


def throughput(messages: DataFrame, ts: str = "ts", kept: str = "kept", seconds: int = 5) -> DataFrame:
    """Consumed and forwarded messages per second, by device and window."""
    return (
        messages.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), "device_id")
        .agg((F.count(F.lit(1)) / seconds).alias("consumed_rate"), (F.count_if(F.col(kept)) / seconds).alias("kept_rate"))
        .select("device_id", F.col("w.start").alias("window_start"), "consumed_rate", "kept_rate")
    )


def triage(candidates: DataFrame) -> DataFrame:
    """Candidates with a suggested entity versus unresolved ones."""
    return candidates.withColumn(
        "triage", F.when(F.col("suggested_entity_id").isNotNull(), "suggested").otherwise("unresolved")
    )
