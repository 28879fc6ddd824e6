"""Read queries and counting reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..operators import votes as vt
from ..plans import queries, reports, tables
from ..sources import derived as d
from .registry import register

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def iso(col: str, name: str | None = None):
    return F.date_format(col, ISO).alias(name or col)


def isosql(col: str, name: str | None = None) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S') AS {name or col}"


# entity table: statistics of all sightings plus voted labels ---------------------------

VOTED = d.VOTE + """, tally AS (
  SELECT entity_id, task, label, sum(confidence) AS s, count(*) AS n FROM votes
  WHERE label <> 'unknown' AND confidence > 0 GROUP BY ALL),
voted AS (
  SELECT entity_id, task, label, round(s / n, 4) AS confidence FROM tally
  QUALIFY row_number() OVER (PARTITION BY entity_id, task ORDER BY round(s, 6) DESC, label) = 1)"""
ENT = d.SIGHT + ", " + VOTED + """, ent AS (
  SELECT * FROM (
    SELECT entity_id, min(started_at) AS first_seen_at, arg_min(device_id, started_at) AS first_seen_device,
           max(ended_at) AS last_seen_at, arg_max(device_id, ended_at) AS last_seen_device,
           count(*) AS sighting_count, entity_id % 5 <> 0 AS is_active
    FROM sight GROUP BY entity_id)
  LEFT JOIN (SELECT entity_id, """ + ", ".join(
    f"max(label) FILTER (task = '{t}') AS {t}, max(confidence) FILTER (task = '{t}') AS {t}_confidence"
    for t in d.TASKS) + " FROM voted GROUP BY entity_id) USING (entity_id))"


def entities(spark, sf):
    stats = tables.entity_rows(d.sightings(spark, sf)).withColumn("is_active", F.col("entity_id") % 5 != 0)
    labels = d.label_maps(vt.entity_vote(d.votes(spark, sf)), ["entity_id"])
    return stats.join(labels, "entity_id", "left")


def entity_view(df):
    return df.select(
        "entity_id", iso("first_seen_at"), "first_seen_device", iso("last_seen_at"), "last_seen_device",
        "sighting_count", "is_active", *lb.flatten(F.col("labels"), d.TASKS),
        *[c for c in df.columns if c == "total"],
    )


ENTITY_COLS = ", ".join([
    "entity_id", isosql("first_seen_at"), "first_seen_device", isosql("last_seen_at"), "last_seen_device",
    "sighting_count", "is_active", *[f"{t}, {t}_confidence" for t in d.TASKS]])


@register("entity_lookup", f"WITH {ENT} SELECT {ENTITY_COLS} FROM ent WHERE entity_id = 7")
def _(spark, sf):
    return entity_view(queries.entity_lookup(entities(spark, sf), 7))


@register("entity_lookup_dispatch", f"WITH {ENT} SELECT {ENTITY_COLS} FROM ent WHERE entity_id = 3")
def _(spark, sf):
    t = queries.Tables(entities(spark, sf), d.sightings(spark, sf), timeline(spark, sf), d.gallery(spark, sf),
                       tasks=d.TASKS)
    return entity_view(queries.execute({"query_type": "entity_lookup", "params": {"entity_id": 3}}, t))


SEARCH = {
    "kind": "a", "kind_confidence_min": 0.7, "first_seen_after": "2024-01-01 00:00:00",
    "first_seen_before": "2024-01-20 00:00:00", "last_seen_after": "2024-01-10 00:00:00",
    "last_seen_before": "2024-02-20 00:00:00", "min_sighting_count": 3, "is_active": True,
}
SEARCH_SQL = """kind = 'a' AND kind_confidence >= 0.7 AND first_seen_at >= TIMESTAMP '2024-01-01 00:00:00'
  AND first_seen_at <= TIMESTAMP '2024-01-20 00:00:00' AND last_seen_at >= TIMESTAMP '2024-01-10 00:00:00'
  AND last_seen_at <= TIMESTAMP '2024-02-20 00:00:00' AND sighting_count >= 3 AND is_active"""


@register("entity_search", f"""WITH {ENT}, hit AS (SELECT * FROM ent WHERE {SEARCH_SQL})
SELECT {ENTITY_COLS}, (SELECT count(*) FROM hit) AS total FROM hit
ORDER BY last_seen_at DESC, entity_id LIMIT 10 OFFSET 10""")
def _(spark, sf):
    page = queries.entity_search(entities(spark, sf), SEARCH, d.TASKS, page=2, page_size=10)
    return entity_view(page.joined())


@register("entity_list_short_filters", f"""WITH {ENT}
SELECT {ENTITY_COLS} FROM ent WHERE lower = 'b' AND upper = 'a' AND last_seen_device = 'dev1'
ORDER BY last_seen_at DESC, entity_id LIMIT 20""")
def _(spark, sf):
    filters = {"lower": "b", "upper": "a", "last_seen_device": "dev1", "headwear": None}
    return entity_view(queries.entity_search(entities(spark, sf), filters, d.TASKS).items)


@register("entity_search_all_predicates", f"""WITH {ENT}
SELECT {ENTITY_COLS} FROM ent WHERE entity_id = 9 AND {" AND ".join(f"{t} IN ('a','b')" for t in d.TASKS)}
  AND kind = 'b' AND carried = 'b' AND sighting_count >= 1""")
def _(spark, sf):
    filters = {"entity_id": 9, "kind": "b", "carried": "b", "min_sighting_count": 1}
    return entity_view(queries.entity_search(entities(spark, sf), filters, d.TASKS).items)


@register("recent_active_entities", f"""WITH {ENT}
SELECT entity_id, {isosql('last_seen_at')} FROM ent WHERE is_active
ORDER BY ent.last_seen_at DESC, entity_id LIMIT 50""")
def _(spark, sf):
    return queries.recent_active(entities(spark, sf)).select("entity_id", iso("last_seen_at"))


SIGHT_COLS = f"""tracklet_id, entity_id, device_id, {isosql('started_at')}, {isosql('ended_at')}, duration_seconds,
  entry_count, quality_score"""


@register("sightings_of_entity", f"""WITH {d.SIGHT}, hit AS (SELECT * FROM sight WHERE entity_id = 5
  AND started_at >= TIMESTAMP '2024-01-05 00:00:00' AND started_at <= TIMESTAMP '2024-01-25 00:00:00')
SELECT {SIGHT_COLS}, (SELECT count(*) FROM hit) AS total FROM hit
ORDER BY hit.started_at DESC, tracklet_id LIMIT 15 OFFSET 15""")
def _(spark, sf):
    page = queries.sightings_of(d.sightings(spark, sf), 5, "2024-01-05 00:00:00", "2024-01-25 00:00:00", 2, 15)
    return page.joined().select(
        "tracklet_id", "entity_id", "device_id", iso("started_at"), iso("ended_at"), "duration_seconds",
        "entry_count", "quality_score", "total")


@register("tracklets_of_entity", f"""WITH {d.TRK}, hit AS (SELECT *, ended_at AS created_at FROM trk WHERE entity_id = 4)
SELECT tracklet_id, entity_id, device_id, state, frame_start, frame_end, entry_count, (SELECT count(*) FROM hit) AS total
FROM hit ORDER BY created_at DESC, tracklet_id LIMIT 20""")
def _(spark, sf):
    rows = d.tracklets(spark, sf).withColumn("created_at", F.col("ended_at"))
    return queries.tracklets_of(rows, 4).joined().select(
        "tracklet_id", "entity_id", "device_id", "state", "frame_start", "frame_end", "entry_count", "total")


# evidence candidates: one per observation with a low score ------------------------------

CAND = d.OBS + """, cand AS (
  SELECT concat_ws(':', device_id, 'track', track_id::VARCHAR, 'low_quality', frame_no::VARCHAR, frame_no::VARCHAR)
           AS candidate_id, track_id, device_id, 'low_quality' AS reason,
         CASE frame_no % 3 WHEN 0 THEN 'unconfirmed' WHEN 1 THEN 'attached' ELSE 'expired' END AS status,
         frame_no, v_score, ts AS created_at, ts AS updated_at, frame_no AS seq,
         CASE WHEN frame_no % 4 = 0 THEN entity_id END AS suggested_entity_id
  FROM obs WHERE v_score < 0.45)"""


def candidate_table(spark, sf):
    o = d.observations(spark, sf).where("v_score < 0.45")
    return o.select(
        F.concat_ws(":", "device_id", F.lit("track"), "track_id", F.lit("low_quality"), "frame_no", "frame_no")
        .alias("candidate_id"), "track_id", "device_id", F.lit("low_quality").alias("reason"),
        F.when(F.col("frame_no") % 3 == 0, "unconfirmed").when(F.col("frame_no") % 3 == 1, "attached")
        .otherwise("expired").alias("status"),
        "frame_no", "v_score", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
        F.col("frame_no").alias("seq"),
        F.when(F.col("frame_no") % 4 == 0, F.col("entity_id")).alias("suggested_entity_id"),
    )


@register("evidence_candidates_page", f"""WITH {CAND}, hit AS (
  SELECT * FROM cand WHERE status = 'unconfirmed' AND device_id = 'dev2')
SELECT candidate_id, track_id, device_id, status, {isosql('created_at')}, (SELECT count(*) FROM hit) AS total
FROM hit ORDER BY hit.created_at DESC, candidate_id LIMIT 20""")
def _(spark, sf):
    page = queries.candidates(candidate_table(spark, sf), "unconfirmed", "dev2").joined()
    return page.select("candidate_id", "track_id", "device_id", "status", iso("created_at"), "total")


@register("candidate_triage", f"""WITH {CAND}
SELECT CASE WHEN suggested_entity_id IS NOT NULL THEN 'suggested' ELSE 'unresolved' END AS triage, status,
       count(*) AS n FROM cand GROUP BY ALL""")
def _(spark, sf):
    return reports.histogram(reports.triage(candidate_table(spark, sf)), "triage", "status")


def timeline(spark, sf):
    return d.observations(spark, sf).select(
        F.col("frame_no").alias("event_id"), "entity_id", "device_id", "event_type", F.col("ts").alias("timestamp"))


@register("timeline_of_entity", f"""WITH {d.OBS}, hit AS (SELECT *, ts AS timestamp FROM obs WHERE entity_id = 11
  AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-28 00:00:00'
  AND event_type IN ('click', 'view'))
SELECT frame_no AS event_id, entity_id, device_id, event_type, {isosql('timestamp')},
       (SELECT count(*) FROM hit) AS total FROM hit ORDER BY hit.timestamp DESC, frame_no LIMIT 50""")
def _(spark, sf):
    page = queries.timeline(timeline(spark, sf), 11, "2024-01-03 00:00:00", "2024-01-28 00:00:00", ["click", "view"])
    return page.joined().select("event_id", "entity_id", "device_id", "event_type", iso("timestamp"), "total")


# the same queries as records, through the dispatch ---------------------------------------------------


def asked(spark, sf, kind, **params):
    t = queries.Tables(entities(spark, sf), d.sightings(spark, sf), timeline(spark, sf), d.gallery(spark, sf),
                       registered_devices(spark, sf), d.TASKS)
    return queries.execute({"query_type": kind, "params": params}, t)


@register("entity_search_dispatch", f"""WITH {ENT}, hit AS (SELECT * FROM ent WHERE {SEARCH_SQL})
SELECT {ENTITY_COLS}, (SELECT count(*) FROM hit) AS total FROM hit
ORDER BY last_seen_at DESC, entity_id LIMIT 10 OFFSET 10""")
def _(spark, sf):
    return entity_view(asked(spark, sf, "entity_search", filters=SEARCH, page=2, page_size=10).joined())


@register("timeline_dispatch_second_page", f"""WITH {d.OBS} SELECT frame_no AS event_id, event_type, {isosql('ts', 'timestamp')} FROM obs WHERE entity_id = 11
ORDER BY ts DESC, frame_no LIMIT 2 OFFSET 2""")
def _(spark, sf):
    return asked(spark, sf, "timeline", entity_id=11, limit=2, page=2).items.select("event_id", "event_type", iso("timestamp"))


@register("similarity_search_dispatch", f"""WITH {d.GAL}, own AS (SELECT vec FROM gal WHERE entity_id = 7 ORDER BY point_id LIMIT 1)
SELECT entity_id, round(max(list_cosine_similarity(gal.vec, own.vec)), 4) AS score FROM gal, own WHERE entity_id <> 7 GROUP BY 1
HAVING max(list_cosine_similarity(gal.vec, own.vec)) >= 0.2 ORDER BY max(list_cosine_similarity(gal.vec, own.vec)) DESC, entity_id LIMIT 5""")
def _(spark, sf):
    return asked(spark, sf, "similarity_search", entity_id=7, top_k=5, min_score=0.2).select("entity_id", F.round("score", 4).alias("score"))


@register("sighting_aggregation_dispatch", f"""WITH {d.SIGHT}
SELECT device_id AS bucket, count(*) AS count, sum(duration_seconds) AS total_duration, round(avg(quality_score), 5) AS avg_quality FROM sight GROUP BY 1""")
def _(spark, sf):
    return asked(spark, sf, "sighting_aggregation", group_by="device").withColumn("avg_quality", F.round("avg_quality", 5))


for _kind, _expr in (("hour", "strftime(started_at, '%Y-%m-%dT%H:00')"), ("day", "strftime(started_at, '%Y-%m-%d')"),
                     ("device", "device_id")):
    @register(f"sighting_aggregation_{_kind}", f"""WITH {d.SIGHT}
SELECT {_expr} AS bucket, count(*) AS count, sum(duration_seconds) AS total_duration,
       round(avg(quality_score), 5) AS avg_quality FROM sight GROUP BY 1""")
    def _(spark, sf, kind=_kind):
        out = queries.sighting_aggregation(d.sightings(spark, sf), kind, limit=None)
        return out.withColumn("avg_quality", F.round("avg_quality", 5))


@register("sighting_aggregation_filtered", f"""WITH {d.SIGHT}
SELECT strftime(started_at, '%Y-%m-%dT%H:00') AS bucket, count(*) AS count, sum(duration_seconds) AS total_duration,
       round(avg(quality_score), 5) AS avg_quality FROM sight
WHERE entity_id = 2 AND device_id = 'dev1' AND started_at >= TIMESTAMP '2024-01-02 00:00:00'
  AND started_at <= TIMESTAMP '2024-01-29 00:00:00' GROUP BY 1 ORDER BY 1 LIMIT 200""")
def _(spark, sf):
    out = queries.sighting_aggregation(d.sightings(spark, sf), "hour", 2, "dev1", "2024-01-02 00:00:00",
                                       "2024-01-29 00:00:00")
    return out.withColumn("avg_quality", F.round("avg_quality", 5))


def registered_devices(spark, sf):
    n, r = d.table(spark, sf, "nation"), d.table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("dev"), F.col("n_nationkey").cast("string")).alias("device_id"), F.col("n_name").alias("name"),
        F.col("r_name").alias("location"))


REG = """reg AS (SELECT concat('dev', n_nationkey::VARCHAR) AS device_id, n_name AS name, r_name AS location
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
DEV = d.SIGHT + """, dev AS (
  SELECT device_id, count(*) AS sighting_count, count(DISTINCT entity_id) AS unique_entity_count,
         min(started_at) AS first_seen_at, max(started_at) AS last_seen_at FROM sight GROUP BY device_id)"""
DEV_COLS = f"device_id, sighting_count, unique_entity_count, {isosql('first_seen_at')}, {isosql('last_seen_at')}"


def device_view(df):
    return df.select("device_id", "sighting_count", "unique_entity_count", iso("first_seen_at"), iso("last_seen_at"))


@register("device_list_from_sightings", f"WITH {DEV} SELECT {DEV_COLS} FROM dev")
def _(spark, sf):
    return device_view(queries.device_list(d.sightings(spark, sf)))


@register("device_list_registered", f"WITH {REG} SELECT * FROM reg")
def _(spark, sf):
    return queries.device_list(d.sightings(spark, sf), registered_devices(spark, sf)).select(
        "device_id", "name", "location")


@register("device_lookup", f"WITH {DEV} SELECT {DEV_COLS} FROM dev WHERE device_id = 'dev3'")
def _(spark, sf):
    return device_view(queries.device_lookup(d.sightings(spark, sf), "dev3",
                                             registered_devices(spark, sf).where("location = 'nowhere'")))


@register("global_stats", f"""WITH {ENT}, {REG}
SELECT (SELECT count(*) FROM ent) AS total_entities, (SELECT count(*) FROM ent WHERE is_active) AS active_entities,
       (SELECT count(*) FROM sight) AS total_sightings, (SELECT count(*) FROM reg) AS total_devices""")
def _(spark, sf):
    return queries.stats(entities(spark, sf), d.sightings(spark, sf), registered_devices(spark, sf))


@register("global_stats_unregistered", f"""WITH {ENT}
SELECT (SELECT count(*) FROM ent) AS total_entities, (SELECT count(*) FROM ent WHERE is_active) AS active_entities,
       (SELECT count(*) FROM sight) AS total_sightings, (SELECT count(DISTINCT device_id) FROM sight) AS total_devices""")
def _(spark, sf):
    return queries.stats(entities(spark, sf), d.sightings(spark, sf))


# counting reports -------------------------------------------------------------------------

METHODS = ("gallery_match", "new_identity", "current_identity_maintained", "spatial_appearance_reuse",
           "soft_match_at_promotion", "tentative_soft_match", "ambiguous_resolved", "tentative_pending")
METHOD_SQL = "CASE frame_start % 8 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(METHODS)) + " END"
SOURCE_SQL = "CASE WHEN frame_start % 2 = 0 THEN 'gallery_search' ELSE 'track_continuity' END"


def matched_tracklets(spark, sf):
    return d.tracklets(spark, sf).withColumn("match_method", F.expr(METHOD_SQL)).withColumn(
        "match_source", F.expr(SOURCE_SQL))


@register("match_method_histogram", f"""WITH {d.TRK}
SELECT {METHOD_SQL} AS match_method, {SOURCE_SQL} AS match_source, count(*) AS n FROM trk GROUP BY ALL""")
def _(spark, sf):
    return reports.histogram(matched_tracklets(spark, sf), "match_method", "match_source")


@register("candidate_source_histogram", f"WITH {CAND} SELECT reason, status, count(*) AS n FROM cand GROUP BY ALL")
def _(spark, sf):
    return reports.histogram(candidate_table(spark, sf), "reason", "status")


@register("tracklets_per_entity", f"WITH {d.TRK} SELECT entity_id, count(*) AS tracklets FROM trk GROUP BY 1")
def _(spark, sf):
    return reports.tracklets_per_entity(d.tracklets(spark, sf))


@register("traffic_per_device", f"""WITH {d.SIGHT}
SELECT device_id, count(*) AS sightings, count(DISTINCT entity_id) AS entities FROM sight GROUP BY 1""")
def _(spark, sf):
    return reports.traffic_per_device(d.sightings(spark, sf))


@register("cross_device_entities", f"""WITH {d.SIGHT}
SELECT entity_id, array_to_string(list_sort(list(DISTINCT device_id)), ',') AS devices,
       count(DISTINCT device_id) AS device_count, count(*) AS sightings
FROM sight GROUP BY 1 HAVING count(DISTINCT device_id) >= 2""")
def _(spark, sf):
    return reports.cross_device_entities(d.sightings(spark, sf)).withColumn("devices", F.array_join("devices", ","))


@register("busiest_devices", f"""WITH {d.SIGHT}, c AS (SELECT device_id, count(*) AS sightings FROM sight GROUP BY 1
  ORDER BY sightings DESC, device_id LIMIT 8)
SELECT device_id, sightings, round(sightings / max(sightings) OVER (), 6) AS share FROM c""")
def _(spark, sf):
    return reports.busiest_devices(d.sightings(spark, sf)).withColumn("share", F.round("share", 6))


@register("throughput_windows", f"""WITH {d.OBS}
SELECT device_id, strftime(time_bucket(INTERVAL 5 SECOND, ts), '%Y-%m-%dT%H:%M:%S') AS window_start,
       count(*) / 5.0::DOUBLE AS consumed_rate, count(*) FILTER (v_score >= 0.5) / 5.0::DOUBLE AS kept_rate
FROM obs GROUP BY 1, 2""")
def _(spark, sf):
    rows = d.observations(spark, sf).withColumn("kept", F.col("v_score") >= 0.5)
    return reports.throughput(rows).withColumn("window_start", F.date_format("window_start", ISO))


@register("device_lookup_dispatch", f"WITH {REG} SELECT device_id, name, location FROM reg WHERE device_id = 'dev2'")
def _(spark, sf):
    return asked(spark, sf, "device_lookup", device_id="dev2").select("device_id", "name", "location")
