"""Table writes as queries over the rows they produce."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import tables
from ..sources import derived as d
from ..sources import frames
from .registry import register
from .reports import CAND, candidate_table, iso, isosql

HALF = "tracklet_id % 2 = 0"


@register("entity_upsert", f"""WITH {d.SIGHT} SELECT entity_id, {isosql('min(started_at)', 'first_seen_at')}, arg_min(device_id, started_at) AS first_seen_device,
  {isosql('max(ended_at)', 'last_seen_at')}, arg_max(device_id, ended_at) AS last_seen_device, count(*) AS sighting_count, 'new_detection' AS source, true AS is_active
FROM sight GROUP BY entity_id""")
def _(spark, sf):
    s = d.sightings(spark, sf)
    out = tables.upsert_entities(tables.entity_rows(s.where(HALF)), tables.entity_rows(s.where(f"NOT ({HALF})")))
    return out.select("entity_id", iso("first_seen_at"), "first_seen_device", iso("last_seen_at"), "last_seen_device", "sighting_count",
                      "source", "is_active")


@register("best_snapshot", f"""WITH {d.OBS} SELECT entity_id, 'shot-' || frame_no AS snapshot_key, v_score AS best_snapshot_score FROM obs
QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY v_score DESC, frame_no) = 1""")
def _(spark, sf):
    o = d.observations(spark, sf).select("entity_id", F.col("frame_no").alias("seq"), F.concat(F.lit("shot-"), "frame_no").alias("snapshot_key"),
                                         F.col("v_score").alias("snapshot_score"))
    return tables.best_snapshots(o)


@register("sighting_append", f"""WITH {d.TRK} SELECT tracklet_id, entity_id, device_id, (epoch_us(ended_at) - epoch_us(started_at)) / 1e6::DOUBLE AS duration_seconds,
  entry_count, round(v_avg, 7) AS quality_score FROM trk""")
def _(spark, sf):
    t = d.tracklets(spark, sf).withColumn("quality_score", F.round("v_avg", 7)).withColumn("labels", F.lit(None))
    return tables.sighting_rows(t).select("tracklet_id", "entity_id", "device_id", "duration_seconds",
                                          "entry_count", "quality_score")


@register("timeline_append", f"""WITH {d.TRK} SELECT entity_id, 'sighting_start' AS event_type, {isosql('started_at', 'timestamp')}, device_id, tracklet_id AS d1,
  entry_count::VARCHAR AS d2 FROM trk""")
def _(spark, sf):
    rows = tables.timeline_rows(d.tracklets(spark, sf), "sighting_start", "started_at",
                                {"tracklet_id": F.col("tracklet_id"), "entries": F.col("entry_count")})
    return rows.select("entity_id", "event_type", iso("timestamp"), "device_id", F.col("details")["tracklet_id"].alias("d1"),
                       F.col("details")["entries"].alias("d2"))


@register("candidate_upsert", f"""WITH {CAND}, w AS (SELECT 'c' || track_id || ':' || device_id AS candidate_id, status, seq, updated_at FROM cand)
SELECT candidate_id, status, seq FROM w QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY seq DESC) = 1""")
def _(spark, sf):
    rows = candidate_table(spark, sf).withColumn("candidate_id", F.concat(F.lit("c"), "track_id", F.lit(":"), "device_id")).select(
        "candidate_id", "status", "seq", "updated_at")
    mid = rows.agg(F.percentile_approx("seq", 0.5)).scalar()
    old = tables.latest_by(rows.where(F.col("seq") < mid), "candidate_id", ["updated_at", "seq"])
    return tables.upsert_candidates(old, rows.where(F.col("seq") >= mid)).select("candidate_id", "status", "seq")


@register("candidate_attached", f"""WITH {CAND} SELECT candidate_id, CASE WHEN frame_no % 6 = 0 THEN 'attached' ELSE status END AS status,
  CASE WHEN frame_no % 6 = 0 THEN track_id END AS attached_entity_id FROM cand""")
def _(spark, sf):
    c = candidate_table(spark, sf)
    hit = c.where("frame_no % 6 = 0").select("candidate_id", F.col("track_id").alias("entity_id"), F.lit("2024-02-01").cast("timestamp").alias("at"))
    return tables.mark_attached(c, hit).select("candidate_id", "status", "attached_entity_id")


@register("asset_backfill", f"""WITH {d.SIGHT} SELECT tracklet_id, CASE WHEN tracklet_id % 4 = 0 THEN 'new-' || tracklet_id ELSE 'old-' || tracklet_id END AS snapshot_key FROM sight""")
def _(spark, sf):
    s = d.sightings(spark, sf).withColumn("snapshot_key", F.concat(F.lit("old-"), "tracklet_id"))
    assets = s.where("tracklet_id % 4 = 0").select("tracklet_id", F.concat(F.lit("new-"), "tracklet_id").alias("snapshot_key"))
    return tables.fill_assets(s, assets, "tracklet_id", ["snapshot_key"]).select("tracklet_id", "snapshot_key")


@register("entity_cascade_delete", f"""WITH {d.SIGHT}, k AS (SELECT * FROM sight WHERE entity_id % 7 <> 3)
SELECT 'sightings' AS name, entity_id, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'timeline', entity_id, count(*) FROM k WHERE tracklet_id % 2 = 0 GROUP BY ALL""")
def _(spark, sf):
    s = d.sightings(spark, sf)
    gone = s.where("entity_id % 7 = 3").select("entity_id")
    kept = tables.remove_entities({"sightings": s, "timeline": s.where(HALF)}, gone)
    counted = [df.groupBy(F.lit(n).alias("name"), "entity_id").agg(F.count(F.lit(1)).alias("n")) for n, df in kept.items()]
    return counted[0].unionByName(counted[1])


# frame messages -------------------------------------------------------------------------------------


def messages(spark, sf):
    """Detections packed into frames; every ninth frame is a heartbeat, one in fifty has no image."""
    det = d.detections(spark, sf)
    item = F.struct(F.array("x1", "y1", "x2", "y2").cast("array<float>").alias("bbox"), F.col("confidence").cast("float").alias("confidence"),
                    "class_id", (F.col("x1") / 2000).cast("float").alias("visibility_score"), (F.col("y1") / 2000).cast("float").alias("overlap_ratio"),
                    F.when(F.col("class_id") == 1, "good").alias("visibility_tag"))
    packed = det.groupBy("device_id", "frame_no", "created_at_ns").agg(F.array_sort(F.collect_list(item)).alias("detections"))
    beat = F.col("frame_no") % 9 == 0
    return packed.select("device_id", F.col("frame_no").alias("frame_number"), F.when(beat, F.slice("detections", 1, 0)).otherwise(F.col("detections")).alias("detections"),
                         F.col("created_at_ns").alias("created_at"),
                         F.when(F.col("frame_no") % 50 != 1, F.encode(F.concat(F.lit("img"), F.col("frame_no").cast("string")), "UTF-8")).otherwise(F.lit(b"")).alias("image_data"))


@register("heartbeat_filter", f"WITH {d.DET} SELECT device_id, frame_no AS frame_number, count(*) AS n FROM det WHERE frame_no % 9 <> 0 GROUP BY ALL")
def _(spark, sf):
    return frames.detected(messages(spark, sf)).select("device_id", "frame_number", F.size("detections").cast("long").alias("n"))


@register("frames_to_detections", f"WITH {d.DET} SELECT device_id, frame_no, count(*) AS n, sum(x1) AS sx, sum(y2) AS sy, count(*) FILTER (class_id = 1) AS good FROM det WHERE frame_no % 9 <> 0 GROUP BY ALL")
def _(spark, sf):
    return frames.to_detections(messages(spark, sf)).groupBy("device_id", "frame_no").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x1").alias("sx"), F.sum("y2").alias("sy"), F.count_if(F.col("visibility_tag") == "good").alias("good"))


@register("end_of_stream", f"WITH {d.DET} SELECT device_id, max(frame_no) AS last_frame FROM det GROUP BY 1")
def _(spark, sf):
    m = messages(spark, sf)
    ends = m.groupBy("device_id").agg(F.lit(-1).cast("long").alias("frame_number"), F.max("created_at").alias("created_at")).select(
        "device_id", "frame_number", F.slice(F.array(F.lit(None).cast(frames.DETECTION)), 1, 0).alias("detections"), "created_at", F.lit(b"").alias("image_data"))
    both = m.unionByName(ends)
    ended = both.where(frames.end_of_stream()).select("device_id").distinct()
    return both.where(~frames.end_of_stream()).join(ended, "device_id", "left_semi").groupBy("device_id").agg(F.max("frame_number").alias("last_frame"))


@register("tracked_frames", f"""WITH {d.OBS} SELECT device_id, frame_no // 40 AS frame_no, string_agg(entity_id::VARCHAR, ',' ORDER BY k) AS ids FROM (
  SELECT *, frame_no AS k FROM obs) GROUP BY ALL""")
def _(spark, sf):
    o = d.observations(spark, sf).withColumn("k", F.col("frame_no")).withColumn("frame_no", F.floor(F.col("frame_no") / 40)).withColumn("created_at", F.col("k"))
    out = frames.to_frames(o, ["k", "entity_id"], "k")
    ids = F.transform("tracked", lambda t: t["entity_id"].cast("string"))
    return out.select("device_id", "frame_no", F.array_join(ids, ",").alias("ids"))


@register("contract_normalisation", f"""WITH {d.OBS} SELECT frame_no, entity_id::INT AS entity_id, CASE WHEN frame_no % 5 = 0 THEN 'unknown' ELSE event_type END AS kind,
  round(CASE WHEN frame_no % 3 = 0 THEN 0 ELSE v_score::FLOAT END::DOUBLE, 6) AS kind_confidence, frame_no % 2 = 0 AS has_quality, 3 AS schema_version FROM obs""")
def _(spark, sf):
    o = d.observations(spark, sf)
    text = F.when(F.col("frame_no") % 10 == 0, "").when(F.col("frame_no") % 5 == 0, F.lit(None)).otherwise(F.col("event_type"))
    rows = o.select("device_id", "frame_no", "entity_id", F.col("v_score").alias("confidence"), text.alias("kind"),
                    F.when(F.col("frame_no") % 3 != 0, F.col("v_score")).alias("kind_confidence"),
                    F.when(F.col("frame_no") % 2 == 0, F.struct(F.col("v_score").alias("v_avg"))).alias("quality"))
    out = frames.normalised(rows, ["kind"])
    return out.select("frame_no", "entity_id", "kind", F.round(F.col("kind_confidence").cast("double"), 6).alias("kind_confidence"),
                      F.col("quality").isNotNull().alias("has_quality"), "schema_version")


@register("display_frames", f"""WITH {d.DET}, f AS (SELECT device_id, frame_no AS frame_number, CASE WHEN min(frame_no) % 9 = 0 THEN 0 ELSE count(*) END AS boxes FROM det
  WHERE frame_no % 50 <> 1 GROUP BY ALL) SELECT device_id, frame_number, boxes, base64(('img' || frame_number)::BLOB) AS image FROM f""")
def _(spark, sf):
    return frames.display_frames(messages(spark, sf)).select("device_id", "frame_number", F.size("tracked").cast("long").alias("boxes"), "image")
