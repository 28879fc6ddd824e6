"""The read queries: each takes tables and parameters and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import and_
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 100


class Page(NamedTuple):
    items: DataFrame
    total: DataFrame

    def joined(self) -> DataFrame:
        """Items with the total as a scalar-subquery column."""
        return self.items.withColumn("total", self.total.scalar())


def paged(df: DataFrame, order: Sequence[Column], page: int = 1, page_size: int = 20) -> Page:
    if page < 1 or not 1 <= page_size <= MAX_PAGE:
        raise ValueError("page starts at 1 and page_size lies in 1..100")
    items = df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    return Page(items, df.agg(F.count(F.lit(1)).alias("total")))


def _all(predicates: Sequence[Column]) -> Column:
    return reduce(and_, predicates, F.lit(True))


def _between(column: str, start: datetime | str | None, end: datetime | str | None) -> list[Column]:
    out = []
    if start is not None:
        out.append(F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        out.append(F.col(column) <= F.lit(end).cast("timestamp"))
    return out


# entities -----------------------------------------------------------------------------


def entity_lookup(entities: DataFrame, entity_id: int) -> DataFrame:
    return entities.where(F.col("entity_id") == entity_id)


def entity_predicates(filters: dict[str, Any], tasks: Sequence[str]) -> list[Column]:
    """Only the filters that are set take part."""
    given = {k: v for k, v in filters.items() if v is not None}
    out: list[Column] = []
    if "entity_id" in given:
        out.append(F.col("entity_id") == given.pop("entity_id"))
    for task in tasks:
        value = given.pop(task, None)
        if value:
            out.append(F.col("labels")[task]["label"] == value)
        floor = given.pop(f"{task}_confidence_min", None)
        if floor is not None:
            out.append(F.col("labels")[task]["confidence"] >= floor)
    if given.get("last_seen_device"):
        out.append(F.col("last_seen_device") == given["last_seen_device"])
    given.pop("last_seen_device", None)
    for edge in ("first_seen", "last_seen"):
        out += _between(f"{edge}_at", given.pop(f"{edge}_after", None), given.pop(f"{edge}_before", None))
    if "min_sighting_count" in given:
        out.append(F.col("sighting_count") >= given.pop("min_sighting_count"))
    if "is_active" in given:
        out.append(F.col("is_active") == given.pop("is_active"))
    if given:
        raise ValueError(f"unknown filters: {sorted(given)}")
    return out


def entity_search(entities: DataFrame, filters: dict[str, Any], tasks: Sequence[str], page: int = 1,
                  page_size: int = 20) -> Page:
    hits = entities.where(_all(entity_predicates(filters, tasks)))
    return paged(hits, [F.desc("last_seen_at"), F.asc("entity_id")], page, page_size)


def recent_active(entities: DataFrame, limit: int = 50) -> DataFrame:
    live = entities.where(F.coalesce(F.col("is_active"), F.lit(True)))
    return live.orderBy(F.desc("last_seen_at"), F.asc("entity_id")).limit(limit).select("entity_id", "last_seen_at")


# facts --------------------------------------------------------------------------------


def sightings_of(sightings: DataFrame, entity_id: int, start=None, end=None, page: int = 1,
                 page_size: int = 20) -> Page:
    hits = sightings.where(_all([F.col("entity_id") == entity_id, *_between("started_at", start, end)]))
    return paged(hits, [F.desc("started_at"), F.asc("tracklet_id")], page, page_size)


def tracklets_of(tracklets: DataFrame, entity_id: int, page: int = 1, page_size: int = 20) -> Page:
    hits = tracklets.where(F.col("entity_id") == entity_id)
    return paged(hits, [F.desc("created_at"), F.asc("tracklet_id")], page, page_size)


def candidates(table: DataFrame, status: str | None = "unconfirmed", device_id: str | None = None, page: int = 1,
               page_size: int = 20) -> Page:
    wanted = []
    if status:
        wanted.append(F.col("status") == status)
    if device_id:
        wanted.append(F.col("device_id") == device_id)
    return paged(table.where(_all(wanted)), [F.desc("created_at"), F.asc("candidate_id")], page, page_size)


def timeline(events: DataFrame, entity_id: int, start=None, end=None, event_types: Sequence[str] | None = None,
             limit: int = 50, page: int = 1) -> Page:
    wanted = [F.col("entity_id") == entity_id, *_between("timestamp", start, end)]
    if event_types:
        wanted.append(F.col("event_type").isin(*event_types))
    hits = events.where(_all(wanted))
    items = hits.orderBy(F.desc("timestamp"), F.asc("event_id")).offset((page - 1) * limit).limit(limit)
    return Page(items, hits.agg(F.count(F.lit(1)).alias("total")))


# aggregates ---------------------------------------------------------------------------


def bucket(group_by: str, ts: str = "started_at", device: str = "device_id") -> Column:
    if group_by == "device":
        return F.col(device)
    if group_by == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if group_by == "hour":
        return F.date_format(ts, "yyyy-MM-dd'T'HH:00")
    raise ValueError(f"cannot group by {group_by}")


def sighting_aggregation(sightings: DataFrame, group_by: str = "hour", entity_id: int | None = None,
                         device_id: str | None = None, start=None, end=None, limit: int | None = None) -> DataFrame:
    wanted = _between("started_at", start, end)
    if entity_id is not None:
        wanted.append(F.col("entity_id") == entity_id)
    if device_id:
        wanted.append(F.col("device_id") == device_id)
    out = (
        sightings.where(_all(wanted)).groupBy(bucket(group_by).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("count"), F.sum("duration_seconds").alias("total_duration"),
             F.avg("quality_score").alias("avg_quality"))
        .orderBy("bucket")
    )
    return out if limit is None else out.limit(limit)


def devices_seen(sightings: DataFrame) -> DataFrame:
    """One row per device. Entities are made distinct first, so a device that
    holds much of the data is counted by many tasks."""
    per_entity = sightings.groupBy("device_id", "entity_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("started_at").alias("_first"), F.max("started_at").alias("_last")
    )
    return per_entity.groupBy("device_id").agg(
        F.sum("_n").alias("sighting_count"), F.count(F.lit(1)).alias("unique_entity_count"),
        F.min("_first").alias("first_seen_at"), F.max("_last").alias("last_seen_at"),
    )


def device_list(sightings: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """Registered devices if there are any, otherwise what sightings show."""
    seen = devices_seen(sightings)
    if registered is None:
        return seen.orderBy(F.desc("last_seen_at"), F.asc("device_id"))
    none_registered = registered.agg(F.count(F.lit(1))).scalar() == 0
    return registered.unionByName(seen.where(none_registered), allowMissingColumns=True)


def device_lookup(sightings: DataFrame, device_id: str, registered: DataFrame | None = None) -> DataFrame:
    seen = devices_seen(sightings.where(F.col("device_id") == device_id))
    if registered is None:
        return seen
    own = registered.where(F.col("device_id") == device_id)
    not_registered = own.agg(F.count(F.lit(1))).scalar() == 0
    return own.unionByName(seen.where(not_registered), allowMissingColumns=True)


def stats(entities: DataFrame, sightings: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Each table is reduced to one row before the rows meet."""
    parts = [
        entities.agg(F.count(F.lit(1)).alias("total_entities"), F.count_if("is_active").alias("active_entities")),
        sightings.agg(F.count(F.lit(1)).alias("total_sightings"), F.countDistinct("device_id").alias("_seen")),
    ]
    if devices is not None:
        parts.append(devices.agg(F.count(F.lit(1)).alias("_registered")))
    rows = reduce(lambda p, q: p.unionByName(q, allowMissingColumns=True), parts)
    registered = F.max("_registered") if devices is not None else F.lit(0)
    return rows.agg(
        F.max("total_entities").alias("total_entities"), F.max("active_entities").alias("active_entities"),
        F.max("total_sightings").alias("total_sightings"),
        F.when(registered > 0, registered).otherwise(F.max("_seen")).alias("total_devices"),
    )


class Tables(NamedTuple):
    entities: DataFrame
    sightings: DataFrame
    timeline: DataFrame
    gallery: DataFrame
    devices: DataFrame | None = None
    tasks: tuple[str, ...] = ()


def execute(query: dict[str, Any], tables: Tables) -> DataFrame | Page:
    """Answer a ``{query_type, params}`` record."""
    from ..operators import similarity

    kind, params = query.get("query_type"), dict(query.get("params") or {})
    if kind == "entity_lookup":
        return entity_lookup(tables.entities, **params)
    if kind == "entity_search":
        return entity_search(tables.entities, params.pop("filters", {}), tables.tasks, **params)
    if kind == "timeline":
        return timeline(tables.timeline, **params)
    if kind == "similarity_search":
        return similarity.similar_to_entity(tables.gallery, tables.entities, **params)
    if kind == "sighting_aggregation":
        return sighting_aggregation(tables.sightings, **params)
    if kind == "device_lookup":
        if params.get("device_id"):
            return device_lookup(tables.sightings, params["device_id"], tables.devices)
        return device_list(tables.sightings, tables.devices)
    raise ValueError(f"Unknown query type: {kind}")
