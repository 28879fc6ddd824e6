"""From ready tracklets to stored entities: one call a batch.

A batch is matched against the gallery as earlier batches left it, every frame gives an entity to one tracklet, unmatched ones become new
entities, wait as candidates or are attached as evidence. What follows from that is added to all tables in one commit, so batch two
finds what batch one added and a retry finds its work done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MATCHING as M
from ..functions import geometry as g
from ..lineage import cut
from ..operators import gallery, similarity
from . import resolve, tables
from .store import Store

BUCKETS = 64
BOX = "struct<x1:double, y1:double, x2:double, y2:double>"
SCHEMAS = {
    "entities": "entity_id long, first_seen_at timestamp, first_seen_device string, last_seen_at timestamp, last_seen_device string, sighting_count long, source string, is_active boolean",
    "tracklets": f"tracklet_id long, track_id long, entity_id long, device_id string, state string, method string, source string, score double, runner_up double, provisional boolean, "
                 f"frame_start long, frame_end long, started_at timestamp, ended_at timestamp, entry_count long, v_avg double, vector_consistency double, overall double, "
                 f"max_overlap double, evidence string, first_box {BOX}, last_box {BOX}",
    "sightings": "entity_id long, device_id string, tracklet_id long, started_at timestamp, ended_at timestamp, duration_seconds double, entry_count long, quality_score double, "
                 "labels map<string, struct<label:string, confidence:double>>",
    "timeline": "entity_id long, event_type string, timestamp timestamp, device_id string, details map<string, string>",
    "snapshots": "entity_id long, seq long, snapshot_key string, snapshot_score double",
    "gallery": "point_id long, entity_id long, bucket int, op string, vec array<double>, is_anchor boolean, added_at timestamp",
    "candidates": "candidate_id long, track_id long, device_id string, status string, suggested_id long, score double, v_avg double, vector_consistency double, entry_count long, "
                  "quality_frames long, updated_at timestamp",
}
PARTITIONS = {"gallery": ("bucket",)}
#: methods by which a tracklet waits
WAITING = ("tentative_pending", "near_gallery_deferred", "new_identity_blocked", "new_identity_suppressed", "reserved_by_other")


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, SCHEMAS)


# the gallery as a table of changes ----------------------------------------------------------------------


def bucket(entity: str = "entity_id") -> F.Column:
    return F.pmod(F.col(entity), F.lit(BUCKETS)).cast("int")


def points(store: Store, upto: int | None = None, buckets: DataFrame | None = None) -> DataFrame:
    """Gallery points after a batch: the last change of each point, unless it was dropped. With ``buckets`` only those folders are read:
    a point that moves to another entity is dropped in its old bucket, so a bucket stands for itself."""
    changes = store.read("gallery", upto)
    if buckets is not None:
        changes = changes.where(F.col("bucket").isin([r.bucket for r in buckets.select("bucket").distinct().collect()]))  # at most BUCKETS
    return folded(changes).drop("batch", "op")


def folded(changes: DataFrame) -> DataFrame:
    """Last change of a point in its bucket; of one batch an addition counts before a drop."""
    keys = ["bucket", "point_id"]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in changes.columns if c not in keys]), F.struct("batch", (F.col("op") == "drop").alias("gone"))).alias("_c"))
    return last.select(*keys, "_c.*").where("op <> 'drop'")


def dropped(store: Store) -> DataFrame:
    """Points that were in the gallery and are no more, as they were added last: what pruning took out."""
    added = store.deltas("gallery").where("op = 'add'")
    last = tables.latest_by(added, "point_id", ["batch"])
    return last.join(points(store).select("point_id"), "point_id", "left_anti").drop("batch", "op")


def change(rows: DataFrame, op: str) -> DataFrame:
    return rows.select("point_id", "entity_id", bucket().alias("bucket"), F.lit(op).alias("op"), "vec", "is_anchor", "added_at")


def grown(store: Store, confirmed: DataFrame, known: DataFrame) -> DataFrame:
    """Gallery changes of confirmed tracklets: the first vector of a new entity is its anchor, a known one gets those that pass the update gates;
    galleries that grow past their size lose their most redundant points."""
    new = confirmed.where(F.col("method") == "new_identity").select(F.col("tracklet_id").alias("point_id"), "entity_id", "vec", F.col("ended_at").alias("added_at"), F.lit(True).alias("is_anchor"))
    old = confirmed.where(F.col("method") != "new_identity")
    own = similarity.own_score(old.select(F.col("tracklet_id").alias("query_id"), "entity_id", "vec"), known).select(F.col("query_id").alias("tracklet_id"), F.col("score").alias("_own"))
    fit = old.join(own, "tracklet_id", "left").where(
        (F.col("max_overlap") <= M.update_max_overlap) & (F.col("overall") >= M.update_overall) & (F.col("v_avg") >= M.update_v)
        & (F.col("vector_consistency") >= M.update_consistency) & (F.col("entry_count") >= M.update_entries)
        & (F.col("_own").isNull() | (F.col("_own") >= M.update_score)))
    added = cut(new.unionByName(fit.select(F.col("tracklet_id").alias("point_id"), "entity_id", "vec", F.col("ended_at").alias("added_at"), F.lit(False).alias("is_anchor"))))
    touched = added.select("entity_id").distinct()
    now = cut(known.join(touched, "entity_id", "left_semi").select(added.columns).unionByName(added))
    kept = gallery.prune(now, ("entity_id",)).select("point_id", "entity_id")
    return change(added, "add").unionByName(change(now.join(kept, ["point_id", "entity_id"], "left_anti"), "drop"))


def moved(store: Store, merges: DataFrame) -> DataFrame:
    """Gallery changes of merges (source_id, target_id): points go to the survivor, as no anchors, and leave their old bucket."""
    m = merges.select(F.col("source_id").alias("entity_id"), "target_id")
    rows = cut(points(store).join(m, "entity_id"))
    there = rows.withColumn("entity_id", F.col("target_id")).withColumn("is_anchor", F.lit(False))
    away = rows.where(bucket() != bucket("target_id"))
    return change(there, "add").unionByName(change(away, "drop"))


# one batch ----------------------------------------------------------------------------------------------


def entities(store: Store, upto: int | None = None) -> DataFrame:
    """Entities after a batch: one aggregate over what the batches added."""
    first, last = F.struct("first_seen_at", "batch"), F.struct("last_seen_at", "batch")
    return store.read("entities", upto).groupBy("entity_id").agg(
        F.min("first_seen_at").alias("first_seen_at"), F.min_by("first_seen_device", first).alias("first_seen_device"),
        F.max("last_seen_at").alias("last_seen_at"), F.max_by("last_seen_device", last).alias("last_seen_device"),
        F.sum("sighting_count").alias("sighting_count"), F.min_by("source", "batch").alias("source"), F.min("is_active").alias("is_active"))


def candidates(store: Store, upto: int | None = None) -> DataFrame:
    """The last state of each waiting tracklet."""
    return tables.latest_by(store.read("candidates", upto), "candidate_id", ["batch", "updated_at"])


def named(decided: DataFrame, first_id: int) -> DataFrame:
    """Decisions with ids for the new entities; of two new ones that are each other's closest the later takes the earlier's."""
    new = cut(resolve.mint(decided, first_id))
    alike = resolve.linked_new(new).select(F.col("source_id").alias("entity_id"), "target_id")
    new = new.join(alike, "entity_id", "left").withColumn("entity_id", F.coalesce("target_id", "entity_id")).withColumn("_second", F.col("target_id").isNotNull())
    new = new.withColumn("method", F.when(F.col("_second"), "new_identity_linked").otherwise(F.col("method"))).drop("target_id", "_second")
    return decided.where(F.col("method") != "new_identity").unionByName(new)


def process(store: Store, batch: int, tracklets: DataFrame, exclusions: DataFrame | None = None, aux: DataFrame | None = None,
            misfits: DataFrame | None = None, allow_new: bool = True, block: int | None = None) -> bool:
    """Match a batch of ready tracklets and store what follows, in one commit. False if the batch is stored already; nothing changes then.

    Tracklets carry tracklet_id, track_id, device_id, frame_start, frame_end, started_at, ended_at, first_box, last_box, vec, v_avg,
    vector_consistency, overall, good_ratio, entry_count, quality_frames, max_overlap, current_id, hint_id, attempts, was_ambiguous, labels.
    A tracklet below the consistency floor is left out before it is matched, one without rows adds nothing.
    """
    if batch <= store.last_batch():
        return store.commit(batch, {})
    known = cut(points(store))
    fit = tracklets.where(F.col("overall") >= F.lit(M.min_consistency))
    decided = cut(resolve.decide(fit, known, aux, exclusions, allow_new, block))
    first_id = int(store.read("entities").agg(F.max("entity_id")).first()[0] or 0) + 1
    final = named(decided, first_id).withColumn("provisional", F.lit(False))
    since = int(fit.agg(F.min("frame_start")).first()[0] or 0) - M.reentry_frames
    past = store.read("tracklets").where((F.col("frame_end") >= since) & F.col("entity_id").isNotNull()).select("entity_id", "device_id", "frame_end", "last_box")
    attached = resolve.provisional(decided, past, misfits).drop("short_reentry")
    rest = final.join(attached.select("tracklet_id"), "tracklet_id", "left_anti")
    final = cut(rest.unionByName(attached.select(rest.columns)))

    matched = final.where(F.col("entity_id").isNotNull())
    confirmed = matched.where("NOT provisional")
    state = F.when(F.col("provisional"), "occlusion_attached").when(F.col("entity_id").isNotNull(), "matched").otherwise("pending")
    records = final.withColumn("state", state).withColumn("evidence", g.evidence_strength(F.col("overall"), F.col("good_ratio")))
    facts = matched.withColumn("quality_score", F.round("overall", 4))
    seen = tables.entity_rows(confirmed.select("entity_id", "device_id", "tracklet_id", "started_at", "ended_at"))
    events = tables.timeline_rows(facts, "sighting_start", "started_at", {"tracklet_id": F.col("tracklet_id"), "quality_score": F.col("quality_score")})
    waiting = final.where(F.col("entity_id").isNull() | F.col("provisional")).select(
        F.col("tracklet_id").alias("candidate_id"), "track_id", "device_id", F.when(F.col("provisional"), "attached").otherwise("pending").alias("status"),
        F.coalesce("entity_id", "suggested_id").alias("suggested_id"), "score", "v_avg", "vector_consistency", "entry_count", "quality_frames", F.col("ended_at").alias("updated_at"))
    return store.commit(batch, {
        "entities": seen, "tracklets": records, "sightings": tables.sighting_rows(facts), "timeline": events, "snapshots": resolve.snapshot_rows(final),
        "gallery": grown(store, confirmed, known), "candidates": waiting}, PARTITIONS)


def apply_merges(store: Store, batch: int, merges: DataFrame) -> bool:
    """Move what merged entities own to their survivors (source_id, target_id), as a batch of its own: their counts and spans, gallery points
    and an event for each. Tracklets and sightings keep the id they were stored with; ``survivor`` maps it when they are read."""
    m = merges.select(F.col("source_id").alias("entity_id"), F.col("target_id").alias("_to"))
    old = cut(entities(store).join(m, "entity_id"))
    plus = old.withColumn("entity_id", F.col("_to")).drop("_to")
    minus = old.drop("_to").withColumn("sighting_count", -F.col("sighting_count")).withColumn("is_active", F.lit(False))
    events = old.select(F.col("_to").alias("entity_id"), F.lit("entity_merged").alias("event_type"), F.col("last_seen_at").alias("timestamp"),
                        F.col("last_seen_device").alias("device_id"), F.create_map(F.lit("source_id"), F.col("entity_id").cast("string")).alias("details"))
    return store.commit(batch, {"entities": plus.unionByName(minus), "timeline": events, "gallery": moved(store, merges)}, PARTITIONS)


def survivors(store: Store) -> DataFrame:
    """(source_id, target_id): where merged entities are now, with the last link of every chain."""
    events = store.read("timeline").where("event_type = 'entity_merged'")
    links = events.select(F.col("details")["source_id"].cast("long").alias("source_id"), F.col("entity_id").alias("target_id"))
    from ..operators import tracks

    ids = links.select(F.col("source_id").alias("id")).union(links.select("target_id")).distinct()
    ends = tracks.roots(ids, links, node="id", parent="target_id", child="source_id")
    return ends.where("id <> root").select(F.col("id").alias("source_id"), F.col("root").alias("target_id"))


def compact(store: Store) -> None:
    """Fold entities and gallery into a new base; to be called now and then, between batches."""
    store.compact({"entities": lambda _: entities(store).withColumn("batch", F.lit(store.last_batch()).cast("long")), "gallery": folded}, PARTITIONS)
