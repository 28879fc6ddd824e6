"""Table writes as batch transformations: new rows in, new table version out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def sighting_rows(matched: DataFrame) -> DataFrame:
    """Matched tracklets to the sightings they add."""
    return matched.select(
        "entity_id", "device_id", "tracklet_id", "started_at", "ended_at",
        g.seconds_between(F.col("started_at"), F.col("ended_at")).alias("duration_seconds"),
        "entry_count", "quality_score", "labels",
    )


def timeline_rows(facts: DataFrame, event_type: str, timestamp: str, details: dict[str, Column]) -> DataFrame:
    pairs = [part for name, value in details.items() for part in (F.lit(name), value.cast("string"))]
    return facts.select(
        "entity_id", F.lit(event_type).alias("event_type"), F.col(timestamp).alias("timestamp"), "device_id",
        F.create_map(*pairs).alias("details"),
    )


def entity_rows(sightings: DataFrame, source: str = "new_detection") -> DataFrame:
    """Entity statistics of a batch of sightings."""
    start = F.struct("started_at", "tracklet_id")
    end = F.struct("ended_at", "tracklet_id")
    return sightings.groupBy("entity_id").agg(
        F.min("started_at").alias("first_seen_at"), F.min_by("device_id", start).alias("first_seen_device"),
        F.max("ended_at").alias("last_seen_at"), F.max_by("device_id", end).alias("last_seen_device"),
        F.count(F.lit(1)).alias("sighting_count"),
    ).withColumn("source", F.lit(source)).withColumn("is_active", F.lit(True))


def upsert_entities(current: DataFrame, batch: DataFrame) -> DataFrame:
    """First-seen fields and source are kept from the earlier row, counts add up,
    last-seen fields come from the later one."""
    p, q = current.alias("p"), batch.alias("q")
    old, new = F.col("p.entity_id").isNotNull(), F.col("q.entity_id").isNotNull()
    newer = new & (~old | (F.col("q.last_seen_at") >= F.col("p.last_seen_at")))
    older = old & (~new | (F.col("p.first_seen_at") <= F.col("q.first_seen_at")))

    def pick(flag: Column, yes: str, no: str) -> Column:
        return F.when(flag, F.col(yes)).otherwise(F.col(no))

    return p.join(q, F.col("p.entity_id") == F.col("q.entity_id"), "full").select(
        F.coalesce("p.entity_id", "q.entity_id").alias("entity_id"),
        F.least("p.first_seen_at", "q.first_seen_at").alias("first_seen_at"),
        pick(older, "p.first_seen_device", "q.first_seen_device").alias("first_seen_device"),
        F.greatest("p.last_seen_at", "q.last_seen_at").alias("last_seen_at"),
        pick(newer, "q.last_seen_device", "p.last_seen_device").alias("last_seen_device"),
        (F.coalesce("p.sighting_count", F.lit(0)) + F.coalesce("q.sighting_count", F.lit(0))).alias("sighting_count"),
        F.coalesce("p.source", "q.source").alias("source"),
        F.coalesce("p.is_active", "q.is_active").alias("is_active"),
    )


def best_snapshots(shots: DataFrame, key: str = "snapshot_key", score: str = "snapshot_score",
                   seq: str = "seq") -> DataFrame:
    """Best key per entity; only a strictly higher score replaces an earlier one."""
    best = F.struct(F.col(score), (-F.col(seq)).alias("_s"))
    return shots.where(F.col(key).isNotNull()).groupBy("entity_id").agg(
        F.max_by(key, best).alias(key), F.max(score).alias("best_snapshot_score")
    )


def latest_by(rows: DataFrame, key: str, version: Sequence[str]) -> DataFrame:
    """Last write per key. An aggregate, so partial results shrink before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    kept = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
    return kept.select(key, "_row.*")


def upsert_candidates(current: DataFrame, batch: DataFrame, version: Sequence[str] = ("updated_at", "seq")) -> DataFrame:
    """Whole-row replacement by candidate id: the batch wins over the table."""
    fresh = latest_by(batch, "candidate_id", version)
    kept = current.join(fresh.select("candidate_id"), "candidate_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def mark_attached(candidates: DataFrame, attached: DataFrame) -> DataFrame:
    """``attached``: one row of (candidate_id, entity_id, at) per resolved candidate."""
    a = attached.select("candidate_id", F.col("entity_id").alias("_entity"), F.col("at").alias("_at"))
    hit = F.col("_entity").isNotNull()
    return candidates.join(a, "candidate_id", "left").select(
        *[F.col(c) for c in candidates.columns if c not in ("status", "updated_at", "attached_entity_id")],
        F.when(hit, "attached").otherwise(F.col("status")).alias("status"),
        F.coalesce("_at", "updated_at").alias("updated_at"), F.col("_entity").alias("attached_entity_id"),
    )


def fill_assets(table: DataFrame, assets: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Overwrite ``columns`` where the asset row carries a value."""
    renamed = assets.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return table.join(renamed, key, "left").select(*[
        F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns
    ])


def remove_entities(tables: dict[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """Cascade delete over every table that names an entity."""
    gone = removed.select("entity_id").distinct()
    return {name: df.join(gone, "entity_id", "left_anti") for name, df in tables.items()}


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add rows to a table folder."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
