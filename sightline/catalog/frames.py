"""Detections and tracklets: overlap, quality, gates, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import STATIC
from ..functions import geometry as g
from ..functions import labels as lb
from ..operators import chains, clusters, ordered, overlap, quality, sampling
from ..plans import reports
from ..sources import derived as d
from .geometry import (AREA, ASPECT, CONF, CUTOFF, KEY, RATIO, area_sql, dist_sql, iou_eps_sql, size_sql)
from .registry import register
from .reports import METHOD_SQL

# overlap: union of the rectangles that other boxes of the frame cut out of a box ------------

OVER = d.DET + """, ov_r AS (
  SELECT a.det_id, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1, least(a.x2, b.x2) AS x2, least(a.y2, b.y2) AS y2
  FROM det a JOIN det b ON a.device_id = b.device_id AND a.frame_no = b.frame_no
  WHERE NOT (abs(a.x1 - b.x1) < 1 AND abs(a.y1 - b.y1) < 1 AND abs(a.x2 - b.x2) < 1 AND abs(a.y2 - b.y2) < 1)
    AND least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)),
ov_x AS (SELECT det_id, x AS lo, lead(x) OVER (PARTITION BY det_id ORDER BY x) AS hi
  FROM (SELECT det_id, x1 AS x FROM ov_r UNION SELECT det_id, x2 FROM ov_r)),
ov_i AS (SELECT s.det_id, lo, hi, r.y1, r.y2, max(r.y2) OVER (PARTITION BY s.det_id, lo ORDER BY r.y1, r.y2
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM ov_x s JOIN ov_r r ON r.det_id = s.det_id AND r.x1 < hi AND r.x2 > lo WHERE hi IS NOT NULL),
ov AS (SELECT det_id, sum((hi - lo) * greatest(0, y2 - greatest(y1, coalesce(reach, y1)))) AS covered
  FROM ov_i GROUP BY det_id),
over_det AS (SELECT det.*, CASE WHEN x2 <= x1 OR y2 <= y1 THEN 0.0::DOUBLE
    ELSE least(coalesce(covered, 0.0) / ((x2 - x1) * (y2 - y1)), 1.0::DOUBLE) END AS overlap_ratio
  FROM det LEFT JOIN ov USING (det_id))"""
OVERLAP_SCORE = """CASE WHEN x2 <= x1 OR y2 <= y1 THEN 0.2 WHEN overlap_ratio < 0.05 THEN 1.0 WHEN overlap_ratio < 0.15 THEN 0.8
  WHEN overlap_ratio < 0.30 THEN 0.6 WHEN overlap_ratio < 0.50 THEN 0.4 ELSE 0.2 END::DOUBLE"""
SCORED = OVER + f""", parts AS (SELECT *, {CUTOFF} AS s1, {AREA} AS s2, {ASPECT} AS s3, {CONF} AS s4, {OVERLAP_SCORE} AS s5
  FROM over_det),
scored AS (SELECT *, round(0.0::DOUBLE + s1 * 0.25::DOUBLE + s2 * 0.20::DOUBLE + s3 * 0.15::DOUBLE + s4 * 0.10::DOUBLE
    + s5 * 0.30::DOUBLE, 4) AS v FROM parts),
tagged AS (SELECT *, CASE WHEN v >= 0.7 THEN 'good' WHEN v >= 0.4 THEN 'mid' ELSE 'bad' END AS tag,
    confidence >= 0.55 AND v >= 0.72 AND overlap_ratio <= 0.35 AND s1 >= 0.6 AND {RATIO} >= 0.0075 AS forced FROM scored)"""


def scored(spark, sf):
    return overlap.with_scores(d.detections(spark, sf))


@register("overlap_ratio", f"WITH {OVER} SELECT det_id, overlap_ratio FROM over_det")
def _(spark, sf):
    return overlap.with_overlap(d.detections(spark, sf)).select("det_id", "overlap_ratio")


@register("overlap_score", f"WITH {OVER} SELECT det_id, {OVERLAP_SCORE} AS value FROM over_det")
def _(spark, sf):
    value = g.overlap_score(F.col("overlap_ratio"), g.box(), F.lit(2))
    return overlap.with_overlap(d.detections(spark, sf)).select("det_id", value.alias("value"))


@register("visibility_subscores", f"""WITH {SCORED} SELECT det_id, s1 AS cut_off, s2 AS area_ratio, s3 AS aspect_ratio,
  round(s4, 8) AS det_conf, s5 AS overlap FROM scored""")
def _(spark, sf):
    s = scored(spark, sf).select("det_id", "subscores.*")
    return s.withColumn("det_conf", F.round("det_conf", 8))


@register("visibility_score", f"WITH {SCORED} SELECT det_id, v AS visibility_score FROM scored")
def _(spark, sf):
    return scored(spark, sf).select("det_id", "visibility_score")


@register("visibility_tag", f"WITH {SCORED} SELECT tag AS visibility_tag, count(*) AS n FROM tagged GROUP BY 1")
def _(spark, sf):
    return reports.histogram(scored(spark, sf), "visibility_tag")


@register("overlap_drop", f"WITH {SCORED} SELECT det_id FROM tagged WHERE overlap_ratio < 0.5")
def _(spark, sf):
    return sampling.usable(scored(spark, sf)).select("det_id")


@register("force_send", f"WITH {SCORED} SELECT det_id, v FROM tagged WHERE forced")
def _(spark, sf):
    rows = overlap.with_scores(d.detections(spark, sf), asked=sampling.forcible())
    return rows.where(sampling.forced()).select("det_id", F.col("visibility_score").alias("v"))


@register("every_nth_frame", f"WITH {d.DET} SELECT det_id, frame_no FROM det WHERE frame_no % 3 = 0")
def _(spark, sf):
    return sampling.every_nth(d.detections(spark, sf), 3).select("det_id", "frame_no")


@register("stride_sampling", f"""WITH {SCORED}, k AS (SELECT *, {KEY} AS spatial_key FROM tagged WHERE overlap_ratio < 0.5),
c AS (SELECT *, CASE WHEN frame_no - lag(frame_no) OVER w <= 30 THEN 0 ELSE 1 END AS st FROM k WHERE v >= 0.15
  WINDOW w AS (PARTITION BY device_id, spatial_key ORDER BY frame_no, det_id)),
s AS (SELECT *, sum(st) OVER (PARTITION BY device_id, spatial_key ORDER BY frame_no, det_id) AS sess FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY device_id, spatial_key, sess ORDER BY frame_no, det_id) AS n FROM s)
SELECT det_id, spatial_key, v AS visibility_score, tag AS visibility_tag, forced, n AS count_in_key FROM n
WHERE forced OR n % (CASE tag WHEN 'good' THEN 2 WHEN 'mid' THEN 3 ELSE 5 END) = 0
UNION ALL SELECT det_id, spatial_key, v, tag, forced, NULL FROM k WHERE v < 0.15 AND forced""")
def _(spark, sf):
    cols = ["det_id", "spatial_key", "visibility_score", "visibility_tag", "forced"]
    return sampling.stride_sample(scored(spark, sf), cols=cols).select(*cols, "count_in_key")


# detections against track boxes: boxes of class 0 play the tracks ----------------------------

TRACKS = d.DET + """, t AS (SELECT * FROM det WHERE class_id = 0), q AS (SELECT * FROM det WHERE class_id <> 0)"""


def tracks_and_detections(spark, sf):
    det = d.detections(spark, sf)
    return det.where("class_id = 0"), det.where("class_id <> 0")


@register("untracked_detections", f"""WITH {TRACKS} SELECT det_id FROM q
WHERE confidence >= 0.25 AND y1 / 600 >= 0.35 AND NOT EXISTS (SELECT 1 FROM t WHERE t.device_id = q.device_id
  AND t.frame_no = q.frame_no AND {iou_eps_sql('q.', 't.')} >= 0.1)""")
def _(spark, sf):
    t, q = tracks_and_detections(spark, sf)
    fit = q.where((F.col("confidence") >= 0.25) & (F.col("y1") / 600 >= 0.35))
    return overlap.untouched(fit, t, min_iou=0.1).select("det_id")


@register("detections_without_track", f"""WITH {TRACKS} SELECT det_id FROM q
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.device_id = q.device_id AND t.frame_no = q.frame_no
  AND least(t.x2, q.x2) > greatest(t.x1, q.x1) AND least(t.y2, q.y2) > greatest(t.y1, q.y1))""")
def _(spark, sf):
    t, q = tracks_and_detections(spark, sf)
    return overlap.untouched(q, t).select("det_id")


@register("nearest_detection", f"""WITH {TRACKS}, p AS (
  SELECT t.det_id AS track, q.det_id AS nearest, sqrt((t.x1-q.x1)**2 + (t.y1-q.y1)**2 + (t.x2-q.x2)**2 + (t.y2-q.y2)**2) AS far
  FROM t JOIN q ON t.device_id = q.device_id AND t.frame_no = q.frame_no)
SELECT track, nearest, round(far, 6) AS distance FROM p
QUALIFY row_number() OVER (PARTITION BY track ORDER BY far, nearest) = 1""")
def _(spark, sf):
    t, q = tracks_and_detections(spark, sf)
    out = overlap.nearest_detection(t.withColumnRenamed("det_id", "track"), q, "track", "det_id")
    return out.select("track", "nearest", F.round("distance", 6).alias("distance"))


@register("lost_tracks_not_active", f"""WITH {TRACKS} SELECT det_id FROM q
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.device_id = q.device_id AND t.frame_no = q.frame_no
  AND 1 - {iou_eps_sql('q.', 't.')} < 0.6)""")
def _(spark, sf):
    t, q = tracks_and_detections(spark, sf)
    return overlap.drop_covered_tracks(q, t, "det_id", 0.6).select("det_id")


@register("joint_tracks", f"""WITH {d.DET}, a AS (SELECT det_id, 'first' AS side FROM det WHERE class_id <> 1),
b AS (SELECT det_id, 'second' AS side FROM det WHERE class_id <> 2)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE det_id NOT IN (SELECT det_id FROM a)""")
def _(spark, sf):
    det = d.detections(spark, sf)
    a = det.where("class_id <> 1").select("det_id", F.lit("first").alias("side"))
    b = det.where("class_id <> 2").select("det_id", F.lit("second").alias("side"))
    return overlap.joint_tracks(a, b, "det_id")


@register("tracks_difference", f"""WITH {d.DET} SELECT det_id FROM det WHERE class_id <> 1
  AND det_id NOT IN (SELECT det_id FROM det WHERE class_id <> 2)""")
def _(spark, sf):
    det = d.detections(spark, sf)
    return overlap.without_tracks(det.where("class_id <> 1"), det.where("class_id <> 2"), "det_id").select("det_id")


# tracklet quality ------------------------------------------------------------------------------

SUMMARY = d.ENTRIES + """, l AS (
  SELECT *, """ + ", ".join(f"lag({c}) OVER w AS p_{c}" for c in ("x1", "y1", "x2", "y2")) + f"""
  FROM entries WINDOW w AS (PARTITION BY tracklet_id ORDER BY frame_no)),
per AS (SELECT tracklet_id, count(*) AS entry_count, min(frame_no) AS frame_start, max(frame_no) AS frame_end,
    avg(v_score) AS v_avg, max(v_score) AS v_max, max(overlap_ratio) AS max_overlap,
    count(*) FILTER (v_score >= 0.55) AS quality_frames,
    greatest(0.0, least(1.0, 1 - coalesce(avg(abs(greatest({area_sql('')}, 1) - greatest({area_sql('p_')}, 1))
      / greatest({area_sql('p_')}, 1)) FILTER (p_x1 IS NOT NULL), 0))) AS ss,
    greatest(0.0, least(1.0, 1 - coalesce(avg({dist_sql('', 'p_')} / {size_sql('')}) FILTER (p_x1 IS NOT NULL), 0) / 0.5)) AS ps,
    count(*) FILTER (v_score >= 0.6) / count(*) AS good,
    avg(greatest(x2 - x1, 1.0)) AS mw, avg(greatest(y2 - y1, 1.0)) AS mh, greatest(median(greatest(y2 - y1, 1.0)), 1.0) AS norm,
    coalesce(sum({dist_sql('', 'p_')}), 0) AS path,
    avg((x1 <= 2 OR y1 <= 2 OR x2 >= frame_w - 2 OR y2 >= frame_h - 2)::INT) AS edge,
    arg_min(x1, frame_no) AS fx1, arg_min(y1, frame_no) AS fy1, arg_min(x2, frame_no) AS fx2, arg_min(y2, frame_no) AS fy2,
    arg_max(x1, frame_no) AS lx1, arg_max(y1, frame_no) AS ly1, arg_max(x2, frame_no) AS lx2, arg_max(y2, frame_no) AS ly2
  FROM l GROUP BY tracklet_id),
summ AS (SELECT *, round(ss, 4) AS size_stability, round(ps, 4) AS position_stability, round(good, 4) AS good_ratio,
    round(ss * 0.35::DOUBLE + ps * 0.35::DOUBLE + good * 0.30::DOUBLE, 4) AS overall,
    round(mw, 4) AS mean_width, round(mh, 4) AS mean_height, round(path / norm, 4) AS path_ratio,
    round({dist_sql('f', 'l')} / norm, 4) AS endpoint_ratio, round(edge, 4) AS boundary_ratio FROM per)"""


def summary(spark, sf):
    return quality.summary(d.tracklet_entries(spark, sf))


@register("tracklet_consistency", f"""WITH {SUMMARY}
SELECT tracklet_id, size_stability, position_stability, good_ratio, overall FROM summ""")
def _(spark, sf):
    return summary(spark, sf).select("tracklet_id", "size_stability", "position_stability", "good_ratio", "overall")


@register("tracklet_motion", f"""WITH {SUMMARY}
SELECT tracklet_id, mean_width, mean_height, path_ratio, endpoint_ratio, boundary_ratio FROM summ""")
def _(spark, sf):
    return summary(spark, sf).select(
        "tracklet_id", "mean_width", "mean_height", "path_ratio", "endpoint_ratio", "boundary_ratio")


@register("tracklet_ready", f"""WITH {SUMMARY} SELECT tracklet_id, entry_count, quality_frames FROM summ
WHERE entry_count >= 6 AND quality_frames >= 3""")
def _(spark, sf):
    return quality.ready(summary(spark, sf)).select("tracklet_id", "entry_count", "quality_frames")


@register("tracklet_consistency_gate", f"WITH {SUMMARY} SELECT tracklet_id, overall FROM summ WHERE overall >= 0.35")
def _(spark, sf):
    return quality.consistent(summary(spark, sf)).select("tracklet_id", "overall")


@register("incoherent_vector_gate", f"""WITH {SUMMARY} SELECT tracklet_id FROM summ
WHERE frame_start % 5 = 0 OR good_ratio >= 0.55""")
def _(spark, sf):
    s = summary(spark, sf).withColumn("current_entity_id", F.when(F.col("frame_start") % 5 == 0, F.lit(1)))
    return quality.coherent(s.withColumn("vector_consistency", F.col("good_ratio"))).select("tracklet_id")


STATIC_SQL = """entry_count >= 6 AND boundary_ratio < 0.3 AND mean_width <= 130 AND mean_height <= 260
  AND (path_ratio <= 0.05 AND endpoint_ratio <= 0.02 OR size_stability >= 0.97 AND position_stability >= 0.97)"""


@register("static_artifact_tracklets", f"""WITH {SUMMARY}, c AS (SELECT tracklet_id, entry_count, boundary_ratio, mean_width,
  mean_height, path_ratio / 100 AS path_ratio, endpoint_ratio / 100 AS endpoint_ratio, size_stability, position_stability FROM summ)
SELECT tracklet_id FROM c WHERE {STATIC_SQL}""")
def _(spark, sf):
    calm = summary(spark, sf).withColumn("path_ratio", F.col("path_ratio") / 100).withColumn(
        "endpoint_ratio", F.col("endpoint_ratio") / 100)
    return calm.where(quality.static_artifact()).select("tracklet_id")


@register("longest_good_run", f"""WITH {d.ENTRIES}, i AS (SELECT tracklet_id, v_score, sum((v_score < 0.6)::INT)
  OVER (PARTITION BY tracklet_id ORDER BY frame_no) AS grp FROM entries),
c AS (SELECT tracklet_id, grp, count(*) FILTER (v_score >= 0.6) AS n FROM i GROUP BY ALL)
SELECT tracklet_id, max(n) AS good_run FROM c GROUP BY 1""")
def _(spark, sf):
    return quality.longest_good_run(d.tracklet_entries(spark, sf))


@register("pretrack_static", f"""WITH {d.OBS}, h AS (SELECT *,
  {", ".join(f"lag({c}, {k}) OVER w AS p{k}_{c}" for k in range(1, 5) for c in ("x1", "y1", "x2", "y2"))}
  FROM obs WINDOW w AS (PARTITION BY device_id, track_id ORDER BY frame_no))
SELECT device_id, frame_no, coalesce(p4_x1 IS NOT NULL AND NOT (x1 <= 2 OR y1 <= 2 OR x2 >= frame_w - 2 OR y2 >= frame_h - 2)
  AND {" AND ".join(f"p{k}_x2 - p{k}_x1 <= 130 AND p{k}_y2 - p{k}_y1 <= 260 AND {dist_sql(f'p{k}_', 'p4_')} <= 60" for k in range(1, 5))},
  false) AS is_static FROM h""")
def _(spark, sf):
    from dataclasses import replace
    rows = quality.pretrack_static(d.observations(spark, sf), ["device_id", "track_id"], replace(STATIC, pretrack_drift=60.0))
    return rows.select("device_id", "frame_no", "is_static")


EXTENT = d.TRK + """, pts AS (SELECT entity_id, (fx1 + fx2) / 2 AS cx, (fy1 + fy2) / 2 AS cy, abs(fx2 - fx1) AS w, abs(fy2 - fy1) AS h FROM trk
  UNION ALL SELECT entity_id, (lx1 + lx2) / 2, (ly1 + ly2) / 2, abs(lx2 - lx1), abs(ly2 - ly1) FROM trk),
extent AS (SELECT entity_id, max(cx) - min(cx) AS spread_x, max(cy) - min(cy) AS spread_y, avg(w) AS mean_width,
  avg(h) AS mean_height, count(*) // 2 AS tracklet_count, count(*) AS point_count FROM pts GROUP BY 1)"""


@register("entity_motion_extent", f"""WITH {EXTENT} SELECT entity_id, spread_x, spread_y, round(mean_width, 7) AS mean_width,
  round(mean_height, 7) AS mean_height, tracklet_count, point_count FROM extent""")
def _(spark, sf):
    m = quality.motion_extent(d.tracklets(spark, sf))
    return m.withColumn("mean_width", F.round("mean_width", 7)).withColumn("mean_height", F.round("mean_height", 7))


@register("static_entities", f"""WITH {EXTENT}, f AS (SELECT *, tracklet_count >= 1 AND spread_x <= 150 AND spread_y <= 45 AS still,
  tracklet_count >= 2 AND mean_width <= 130 AND mean_height <= 260 AND spread_x <= 1.5 * mean_width
  AND spread_y <= 1.5 * mean_height AS small FROM extent)
SELECT entity_id, CASE WHEN still THEN 'zero_motion' ELSE 'small_static' END AS branch FROM f WHERE still OR small""")
def _(spark, sf):
    return quality.static_entities(d.tracklets(spark, sf)).select("entity_id", "branch")


@register("clean_descriptor_frames", f"""WITH {d.ENTRIES} SELECT tracklet_id, count(*) AS clean_frames FROM entries
WHERE v_score >= 0.5 AND overlap_ratio <= 0.3 GROUP BY 1 HAVING count(*) >= 3""")
def _(spark, sf):
    return quality.clean_frames(d.tracklet_entries(spark, sf))


@register("candidate_admission", f"""WITH {d.TRK}, s AS (SELECT *, concat_ws(':', device_id, track_id::VARCHAR) AS track_key FROM trk)
SELECT track_key, tracklet_id, entry_count FROM s WHERE entry_count >= 2 AND v_avg >= 0.45
QUALIFY row_number() OVER (PARTITION BY track_key ORDER BY frame_start, tracklet_id) = 1""")
def _(spark, sf):
    s = d.tracklets(spark, sf).withColumn("track_key", F.concat_ws(":", "device_id", "track_id")).withColumn(
        "v_max", F.col("v_avg"))
    return quality.admitted_candidates(s).select("track_key", "tracklet_id", "entry_count")


@register("canonical_tracklets", f"""WITH {d.TRK} SELECT entity_id, count(*) AS tracklets FROM trk
WHERE state <> 'occlusion_attached' AND frame_start % 17 <> 0 GROUP BY 1""")
def _(spark, sf):
    t = d.tracklets(spark, sf).withColumn("provisional", F.col("frame_start") % 17 == 0)
    return reports.tracklets_per_entity(quality.canonical(t))


@register("fresh_tracklets", f"""WITH {d.TRK} SELECT tracklet_id FROM trk
WHERE ended_at >= (SELECT max(ended_at) FROM trk) - INTERVAL 3 DAY""")
def _(spark, sf):
    return quality.fresh(d.tracklets(spark, sf), max_lag_s=3 * 86400).select("tracklet_id")


@register("identity_cap", f"""WITH {d.TRK}, n AS (SELECT count(DISTINCT entity_id) AS n FROM trk)
SELECT tracklet_id, n AS known, n >= 100 AS cap_reached FROM trk, n""")
def _(spark, sf):
    t = d.tracklets(spark, sf)
    return quality.identity_cap(t, t, 100).select("tracklet_id", "known", "cap_reached")


@register("label_unreliable", f"""WITH {d.TRK} SELECT tracklet_id,
  track_id - 20 < 0 OR v_avg < 0.65 OR max_overlap >= 0.35 AS unreliable FROM trk""")
def _(spark, sf):
    flag = lb.unreliable(F.col("track_id") - 20, F.col("v_avg"), F.col("max_overlap"))
    return d.tracklets(spark, sf).select("tracklet_id", flag.alias("unreliable"))


@register("tracklet_summary", f"""WITH {SUMMARY}, t AS (SELECT tracklet_id, entity_id, {METHOD_SQL} AS m FROM (
  SELECT tracklet_id, entity_id, min(frame_no) AS frame_start FROM entries GROUP BY ALL))
SELECT entity_id, round(avg(overall), 7) AS avg_consistency, round(avg(good_ratio), 7) AS avg_good_ratio,
  count(*) FILTER (m IN {reports.RECOVERY_METHODS}) AS recoveries, count(*) FILTER (overall >= 0.7) AS high_quality
FROM t JOIN summ USING (tracklet_id) GROUP BY entity_id""")
def _(spark, sf):
    entries = d.tracklet_entries(spark, sf)
    owner = entries.groupBy("tracklet_id").agg(F.first("entity_id").alias("entity_id"))
    s = quality.summary(entries).join(owner, "tracklet_id").withColumn("match_method", F.expr(METHOD_SQL))
    return reports.tracklet_summary(s).withColumn("avg_consistency", F.round("avg_consistency", 7)).withColumn(
        "avg_good_ratio", F.round("avg_good_ratio", 7))


@register("cluster_promotion", f"""WITH {SUMMARY} SELECT tracklet_id, CASE WHEN entry_count >= 6 AND v_max >= 0.65 THEN 'slow'
  WHEN entry_count >= 5 AND v_max >= 0.85 AND overall >= 0.83 THEN 'fast' END AS tier FROM summ""")
def _(spark, sf):
    return summary(spark, sf).select("tracklet_id", quality.promotion_tier().alias("tier"))


@register("cluster_statistics", f"""WITH {d.ENTRIES} SELECT tracklet_id, count(*) AS entries, round(avg(v_score) / 1.3::DOUBLE, 4) AS confidence_avg,
  round(max(v_score), 4) AS confidence_max, round(min(overlap_ratio / 3), 4) AS iou_min, round(max(overlap_ratio / 3), 4) AS iou_max
FROM entries GROUP BY 1""")
def _(spark, sf):
    rows = d.tracklet_entries(spark, sf).withColumn("nearest_iou", F.col("overlap_ratio") / 3)
    stats = clusters.statistics(rows, "tracklet_id", "v_score").withColumn("confidence_avg", F.col("confidence_avg") / 1.3)
    return stats.select("tracklet_id", "entries", *[F.round(c, 4).alias(c) for c in ("confidence_avg", "confidence_max", "iou_min", "iou_max")])


# choosing frames ---------------------------------------------------------------------------------


@register("last_entries_per_track", f"""WITH {d.OBS} SELECT device_id, track_id, frame_no FROM obs
QUALIFY row_number() OVER (PARTITION BY device_id, track_id ORDER BY frame_no DESC) <= 10""")
def _(spark, sf):
    return sampling.last_entries(d.observations(spark, sf), ["device_id", "track_id"], limit=10).select(
        "device_id", "track_id", "frame_no")


@register("latest_frame_per_device", f"""WITH {d.OBS} SELECT device_id, frame_no, entity_id FROM obs
QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY frame_no DESC) = 1""")
def _(spark, sf):
    return sampling.latest_frame(d.observations(spark, sf)).select("device_id", "frame_no", "entity_id")


@register("one_row_per_id_in_frame", f"""WITH {d.DET} SELECT device_id, frame_no, class_id, det_id FROM det
QUALIFY row_number() OVER (PARTITION BY device_id, frame_no, class_id ORDER BY confidence DESC, det_id) = 1""")
def _(spark, sf):
    det = d.detections(spark, sf).withColumn("_neg", -F.col("confidence"))
    return sampling.one_per_id(det, ["device_id", "frame_no", "class_id"], ["_neg", "det_id"]).select(
        "device_id", "frame_no", "class_id", "det_id")


# selection is a fold over ranked rows, unrolled here into one step per pick
SELECT_SQL = d.ENTRIES + """, r0 AS (SELECT tracklet_id, frame_no AS f, v_score - overlap_ratio * 0.3::DOUBLE AS s FROM entries)"""
for _i in range(1, 6):
    SELECT_SQL += f""", p{_i} AS (SELECT tracklet_id, f, {_i} AS rank FROM r{_i - 1}
  QUALIFY row_number() OVER (PARTITION BY tracklet_id ORDER BY s DESC, f) = 1),
r{_i} AS (SELECT r.* FROM r{_i - 1} r JOIN p{_i} p USING (tracklet_id) WHERE abs(r.f - p.f) >= 3)"""
SELECT_SQL += ", chosen AS (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, 6)) + ")"
MARKED = SELECT_SQL + """, marked AS (SELECT e.*, c.rank IS NOT NULL AS selected, e.frame_no % 4 <> 0 AS has_crop
  FROM entries e LEFT JOIN chosen c ON c.tracklet_id = e.tracklet_id AND c.f = e.frame_no)"""


def marked(spark, sf):
    return sampling.with_selected(d.tracklet_entries(spark, sf)).withColumn("has_crop", F.col("frame_no") % 4 != 0)


@register("spaced_top_k_frames", f"WITH {SELECT_SQL} SELECT tracklet_id, f AS frame_no, rank FROM chosen")
def _(spark, sf):
    return sampling.selected_frames(d.tracklet_entries(spark, sf))


@register("representative_frame", f"""WITH {MARKED} SELECT tracklet_id, frame_no FROM marked WHERE overlap_ratio <= 0.35
QUALIFY row_number() OVER (PARTITION BY tracklet_id ORDER BY selected DESC, v_score - overlap_ratio * 0.7::DOUBLE DESC,
  overlap_ratio, frame_no DESC) = 1""")
def _(spark, sf):
    return sampling.representative_frame(marked(spark, sf))


@register("preview_frames", f"""WITH {MARKED} SELECT tracklet_id, frame_no,
  row_number() OVER (PARTITION BY tracklet_id ORDER BY v_score DESC, overlap_ratio, frame_no) AS rank
FROM marked WHERE NOT selected QUALIFY rank <= 4""")
def _(spark, sf):
    return sampling.preview_frames(marked(spark, sf)).select("tracklet_id", "frame_no", "rank")


@register("context_samples", f"""WITH {MARKED} SELECT tracklet_id, frame_no,
  row_number() OVER (PARTITION BY tracklet_id ORDER BY has_crop DESC, round(overlap_ratio / 1.7::DOUBLE, 3) DESC, v_score DESC, frame_no) AS rank
FROM marked WHERE NOT selected QUALIFY rank <= 8""")
def _(spark, sf):
    rows = marked(spark, sf).withColumn("overlap_ratio", F.col("overlap_ratio") / 1.7)
    return sampling.context_samples(rows).select("tracklet_id", "frame_no", "rank")


@register("representative_tracklet", f"""WITH {MARKED}, c AS (SELECT tracklet_id, entity_id, min(frame_no) AS frame_start,
  bool_or(selected AND has_crop) AS i, bool_or(NOT selected AND has_crop) AS o FROM marked GROUP BY ALL)
SELECT entity_id, tracklet_id FROM c QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY
  CASE WHEN i AND o THEN 0 WHEN frame_start % 13 = 0 THEN 1 WHEN i OR o THEN 2 ELSE 3 END, frame_start, tracklet_id) = 1""")
def _(spark, sf):
    return sampling.representative_tracklet(marked(spark, sf), d.tracklets(spark, sf))


@register("throttled_persistence", f"""WITH {d.ENTRIES} SELECT tracklet_id, frame_no,
  row_number() OVER (PARTITION BY tracklet_id ORDER BY frame_no) AS entry_no FROM entries
QUALIFY entry_no IN (2, 3, 5, 8, 12, 16, 22, 30, 40, 55, 75, 100)""")
def _(spark, sf):
    return sampling.throttled(d.tracklet_entries(spark, sf), ["tracklet_id"], ["frame_no"], span=None).select(
        "tracklet_id", "frame_no", "entry_no")


@register("evidence_frame_samples", f"""WITH {MARKED} SELECT tracklet_id, string_agg(frame_no::VARCHAR || CASE WHEN selected THEN '*' ELSE '' END,
  ',' ORDER BY frame_no) AS samples FROM marked GROUP BY 1""")
def _(spark, sf):
    text = F.transform("samples", lambda s: F.concat(s["frame_no"].cast("string"), F.when(s["selected"], "*").otherwise("")))
    return sampling.frame_samples(marked(spark, sf)).select("tracklet_id", F.array_join(text, ",").alias("samples"))


# greedy chains -------------------------------------------------------------------------------------


@register("minimum_interval_sampling", f"""WITH RECURSIVE {d.DET}, rows_ AS MATERIALIZED (SELECT DISTINCT device_id, frame_no FROM det),
nxt AS MATERIALIZED (SELECT r.device_id, r.frame_no, (SELECT min(q.frame_no) FROM rows_ q WHERE q.device_id = r.device_id
  AND q.frame_no >= r.frame_no + 7) AS follow FROM rows_ r),
chain AS (SELECT device_id, min(frame_no) AS frame_no FROM rows_ GROUP BY 1
  UNION ALL SELECT n.device_id, n.follow FROM chain c JOIN nxt n USING (device_id, frame_no) WHERE n.follow IS NOT NULL)
SELECT device_id, frame_no FROM chain""")
def _(spark, sf):
    frames = d.detections(spark, sf).select("device_id", "frame_no").distinct()
    return chains.sample_interval(frames, ["device_id"], "frame_no", 7)


SKIP = d.DET + """, fr AS (SELECT device_id, frame_no, count(*) FILTER (confidence >= 0.85) AS boxes,
    CAST((max(x2) + sum(y1)) AS BIGINT) % 29 AS change FROM det GROUP BY ALL),
rows_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY frame_no) AS position FROM fr),
nxt AS MATERIALIZED (SELECT r.device_id, r.position, least(r.position + 1 + CASE WHEN r.boxes > 0 THEN 5 ELSE 30 END,
    coalesce(min(q.position), 1000000000)) AS follow
  FROM rows_ r LEFT JOIN rows_ q ON q.device_id = r.device_id AND q.position > r.position AND q.position <= r.position + 31
    AND q.change >= 25.5 GROUP BY r.device_id, r.position, r.boxes)"""


@register("adaptive_frame_skip", f"""WITH RECURSIVE {SKIP},
chain AS (SELECT device_id, 1::BIGINT AS position FROM rows_ GROUP BY 1
  UNION ALL SELECT n.device_id, n.follow FROM chain c JOIN nxt n USING (device_id, position))
SELECT device_id, frame_no FROM chain JOIN rows_ USING (device_id, position)""")
def _(spark, sf):
    frames = d.detections(spark, sf).groupBy("device_id", "frame_no").agg(
        F.count_if(F.col("confidence") >= 0.85).alias("boxes"),
        ((F.max("x2") + F.sum("y1")).cast("long") % 29).cast("double").alias("change"))
    placed = ordered.with_position(frames, ["device_id"], ["frame_no"])
    return chains.processed_frames(placed, ["device_id"], "position").select("device_id", "frame_no")


CUTS = d.DET + """, rows_ AS MATERIALIZED (SELECT device_id, class_id, frame_no, row_number() OVER (PARTITION BY device_id, class_id
    ORDER BY frame_no) AS p FROM (SELECT DISTINCT device_id, class_id, frame_no FROM det)),
nxt AS MATERIALIZED (SELECT r.device_id, r.class_id, r.frame_no, min(q.frame_no) AS follow FROM rows_ r
  JOIN rows_ q ON q.device_id = r.device_id AND q.class_id = r.class_id AND q.p > r.p AND q.p <= r.p + 60
    AND (q.p = r.p + 60 OR q.p >= r.p + 6 AND q.frame_no > r.frame_no + 90) GROUP BY ALL)"""


@register("tracklet_cutting", f"""WITH RECURSIVE {CUTS},
chain AS (SELECT device_id, class_id, min(frame_no) AS frame_no FROM rows_ GROUP BY ALL
  UNION ALL SELECT n.device_id, n.class_id, n.follow FROM chain c JOIN nxt n USING (device_id, class_id, frame_no))
SELECT device_id, class_id, frame_no FROM chain""")
def _(spark, sf):
    rows = d.detections(spark, sf).select("device_id", "class_id", "frame_no").distinct()
    return chains.tracklet_starts(rows, ["device_id", "class_id"], span=2048)
