"""Tracks, recency and transitions between entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import numbering, temporal, tracks
from ..sources import derived as d
from .geometry import area_ratio_sql, centre_sql, dist_sql, iou_eps_sql, iou_sql, size_ratio_sql, size_sql
from .registry import register

# linking: device-local frames, box score grows with v_score -----------------------------------

BX = d.OBS + """, bx AS (SELECT frame_no AS box_id, device_id, frame_no // 4 AS frame_no, 0.3 + v_score * 0.7::DOUBLE AS score, x1, y1, x2, y2 FROM obs)"""
LINKS = BX + f""", cand AS (SELECT a.box_id AS tail, b.box_id AS head, b.frame_no - a.frame_no AS lag, 1 - {iou_eps_sql('a.', 'b.')} AS cost,
    1 - {iou_eps_sql('a.', 'b.')} * b.score AS fused, a.score AS ts, b.score AS hs
  FROM bx a JOIN bx b ON a.device_id = b.device_id AND b.frame_no - a.frame_no BETWEEN 1 AND 90
    AND least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1))"""


def _mutual_sql(name: str, src: str, cost: str) -> str:
    return f"""{name} AS (SELECT tail, head FROM (SELECT *, row_number() OVER (PARTITION BY tail ORDER BY lag, {cost}, head) AS p,
  row_number() OVER (PARTITION BY head ORDER BY lag, {cost}, tail) AS q FROM ({src})) WHERE p = 1 AND q = 1)"""


LINKS += ", " + _mutual_sql("l1", "SELECT * FROM cand WHERE hs >= 0.7 AND ts > 0.35 AND fused <= 0.3", "fused")
LINKS += ", free AS (SELECT * FROM cand WHERE lag = 1 AND tail NOT IN (SELECT tail FROM l1))"
LINKS += ", " + _mutual_sql("l2", "SELECT * FROM free WHERE hs < 0.7 AND hs > 0.35 AND ts > 0.35 AND cost <= 0.5", "cost")
LINKS += ", " + _mutual_sql("l3", """SELECT * FROM free WHERE tail NOT IN (SELECT tail FROM l2) AND head NOT IN (SELECT head FROM l1)
  AND hs >= 0.7 AND ts >= 0.7 AND fused <= 0.7""", "fused")
LINKS += ", links AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"


def boxes(spark, sf):
    return d.observations(spark, sf).select(
        F.col("frame_no").alias("box_id"), "device_id", F.floor(F.col("frame_no") / 4).alias("frame_no"),
        (F.lit(0.3) + F.col("v_score") * 0.7).alias("score"), "x1", "y1", "x2", "y2")


@register("track_links", f"WITH {LINKS} SELECT tail, head FROM links")
def _(spark, sf):
    return tracks.link(boxes(spark, sf))


@register("track_ids", f"""WITH RECURSIVE {LINKS}, ch AS (SELECT box_id, box_id AS root FROM bx WHERE box_id NOT IN (SELECT head FROM links)
  UNION ALL SELECT l.head, ch.root FROM ch JOIN links l ON l.tail = ch.box_id)
SELECT ch.box_id, root AS track_id FROM ch JOIN bx ON bx.box_id = root WHERE bx.score >= 0.82""")
def _(spark, sf):
    return tracks.tracks(boxes(spark, sf))


@register("restored_track_identity", f"""WITH {d.TRK}, p AS (SELECT *, {", ".join(f"lag({c}) OVER w AS p_{c[1:]}" for c in ('lx1', 'ly1', 'lx2', 'ly2'))},
  lag(frame_end) OVER w AS pe, lag(entity_id) OVER w AS pid FROM trk WINDOW w AS (PARTITION BY device_id, track_id ORDER BY frame_start, tracklet_id))
SELECT tracklet_id, pid AS entity_id FROM p WHERE frame_start - pe BETWEEN 0 AND 3000 AND {centre_sql('p_', 'f')} <= 1.25""")
def _(spark, sf):
    return tracks.restored_identity(d.tracklets(spark, sf), max_gap=3000)


def _shift_sql(a, b, e, s, r):
    return f"""({dist_sql(a, b)} / greatest({size_sql(a)}, {size_sql(b)}) >= {e} AND {size_ratio_sql(a, b)} >= {s}
  AND {area_ratio_sql(a, b)} >= {r})"""


@register("identity_shift_risk", f"""WITH {d.TRK}, an AS (SELECT device_id, track_id, entity_id, min(frame_start) AS af,
  {", ".join(f"arg_min(f{c}, frame_start) AS n{c}" for c in ('x1', 'y1', 'x2', 'y2'))} FROM trk GROUP BY ALL)
SELECT tracklet_id, CASE WHEN af < frame_start AND frame_end - af >= 24 AND {_shift_sql('n', 'l', 0.3, 1.01, 1.02)} THEN 'anchor_shift'
  ELSE 'endpoint_shift' END AS reason FROM trk JOIN an USING (device_id, track_id, entity_id) WHERE entry_count >= 8
  AND (af < frame_start AND frame_end - af >= 24 AND {_shift_sql('n', 'l', 0.3, 1.01, 1.02)} OR {_shift_sql('f', 'l', 0.4, 1.02, 1.03)})""")
def _(spark, sf):
    return tracks.identity_shift(d.tracklets(spark, sf), 8, 24, (0.3, 1.01, 1.02), (0.4, 1.02, 1.03))


# recency ------------------------------------------------------------------------------------------


def rec_sql(window: int) -> str:
    return d.OBS + f""", rec AS (SELECT q.frame_no AS row_id, q.entity_id, q.track_id, q.x1, q.y1, q.x2, q.y2, o.entity_id AS other_id, o.track_id AS other_track,
    {", ".join(f"o.{c} AS o_{c}" for c in ('x1', 'y1', 'x2', 'y2'))}
  FROM obs q JOIN obs o ON o.device_id = q.device_id AND q.frame_no - o.frame_no BETWEEN 1 AND {window} AND o.entity_id <> q.entity_id
  QUALIFY row_number() OVER (PARTITION BY q.frame_no, o.entity_id ORDER BY o.frame_no DESC) = 1)"""


def recent(spark, sf, window):
    rows = d.observations(spark, sf).withColumn("row_id", F.col("frame_no"))
    return temporal.recent_others(rows, window)


@register("recent_entity_hint", f"""WITH {rec_sql(75)}, s AS (SELECT row_id, other_id, {iou_sql('', 'o_')} - 0.1::DOUBLE * {centre_sql('', 'o_')} AS score FROM rec
  WHERE {iou_sql('', 'o_')} >= 0.2 OR {centre_sql('', 'o_')} <= 0.75)
SELECT row_id, other_id AS hint_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, other_id) = 1""")
def _(spark, sf):
    return temporal.entity_hint(recent(spark, sf, 75)).withColumn("score", F.round("score", 6))


@register("recently_elsewhere", f"""WITH {rec_sql(120)} SELECT row_id, other_id FROM rec WHERE {iou_sql('', 'o_')} < 0.1 AND {centre_sql('', 'o_')} > 0.9""")
def _(spark, sf):
    return temporal.recently_elsewhere(recent(spark, sf, 120))


@register("co_active_entities", f"WITH {rec_sql(18)} SELECT row_id, other_id FROM rec WHERE other_track <> track_id")
def _(spark, sf):
    return temporal.co_active(recent(spark, sf, 18))


@register("duplicate_track_suspects", f"WITH {rec_sql(18)} SELECT row_id, other_id FROM rec WHERE {iou_sql('', 'o_')} >= 0.5")
def _(spark, sf):
    return temporal.duplicate_suspects(recent(spark, sf, 18))


@register("covisibility_exclusion", f"""WITH {d.DET}, b AS (SELECT *, x1::BIGINT % 40 AS track_id FROM det)
SELECT p.device_id, p.track_id AS track_a, q.track_id AS track_b, count(*) AS shared_frames FROM b p JOIN b q
  ON p.device_id = q.device_id AND p.frame_no = q.frame_no AND p.track_id < q.track_id
WHERE {iou_sql('p.', 'q.')} <= 0.15 AND {centre_sql('p.', 'q.')} >= 0.55 GROUP BY ALL""")
def _(spark, sf):
    return temporal.never_together(d.detections(spark, sf).withColumn("track_id", F.col("x1").cast("long") % 40))


# pairs of entities over split tracklets ---------------------------------------------------------------

PAIR_LIST = d.SPLIT_TRK + """, ids AS (SELECT DISTINCT entity_id FROM trk),
pl AS (SELECT entity_id AS entity_a, entity_id + k AS entity_b FROM ids, (VALUES (1), (7), (100000)) v(k)
  WHERE entity_id + k IN (SELECT entity_id FROM ids))"""
MET_TAIL = """, met AS (SELECT pl.entity_a, pl.entity_b, a.frame_start <= b.frame_end AND b.frame_start <= a.frame_end AS over, a.frame_end < b.frame_start AS af,
    CASE WHEN a.frame_start <= b.frame_end AND b.frame_start <= a.frame_end THEN 0 WHEN a.frame_end < b.frame_start THEN b.frame_start - a.frame_end
      ELSE a.frame_start - b.frame_end END AS gap, a.tracklet_id AS ta, b.tracklet_id AS tb, """ + ", ".join(
    f"{s}.{e}{c} AS {s}{e}{c}" for s in "ab" for e in "fl" for c in ("x1", "y1", "x2", "y2")) + """
  FROM pl JOIN trk a ON a.entity_id = pl.entity_a JOIN trk b ON b.entity_id = pl.entity_b AND a.device_id = b.device_id)"""
MET = PAIR_LIST + MET_TAIL


def _ways(both_ways: bool) -> str:
    forth = ", ".join([f"al{c} AS p{c}" for c in ("x1", "y1", "x2", "y2")] + [f"bf{c} AS q{c}" for c in ("x1", "y1", "x2", "y2")])
    back = ", ".join([f"af{c} AS p{c}" for c in ("x1", "y1", "x2", "y2")] + [f"bl{c} AS q{c}" for c in ("x1", "y1", "x2", "y2")])
    again = "over OR " if both_ways else ""
    return f"""SELECT entity_a, entity_b, gap, ta, tb, 0 AS turn, {forth} FROM met WHERE over OR af
  UNION ALL SELECT entity_a, entity_b, gap, ta, tb, 1 AS turn, {back} FROM met WHERE {again}NOT over AND NOT af"""


NEAREST_TAIL = f""", tr AS (SELECT *, {centre_sql('p', 'q')} AS centre FROM ({_ways(False)})),
nt AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY entity_a, entity_b ORDER BY gap, centre, ta, tb) = 1)"""
NEAREST = MET + NEAREST_TAIL
CLOSEST_TAIL = f""", trc AS (SELECT *, {centre_sql('p', 'q')} AS centre FROM ({_ways(True)}) WHERE gap <= {{max_gap}}),
ct AS (SELECT * FROM trc QUALIFY row_number() OVER (PARTITION BY entity_a, entity_b ORDER BY centre, gap, ta, tb, turn) = 1)"""
CLOSEST = MET + CLOSEST_TAIL


def pair_list(spark, sf):
    ids = d.tracklets(spark, sf, split=True).select("entity_id").distinct()
    steps = ids.select(F.col("entity_id").alias("entity_a"), F.explode(F.array(F.lit(1), F.lit(7), F.lit(100000))).alias("k"))
    return steps.select("entity_a", (F.col("entity_a") + F.col("k")).alias("entity_b")).join(
        ids.withColumnRenamed("entity_id", "entity_b"), "entity_b", "left_semi")


def both(spark, sf):
    """Pairs and tracklets as stored tables: both are read several times."""
    return cut(pair_list(spark, sf)), cut(d.tracklets(spark, sf, split=True))


@register("entities_cooccur", f"WITH {MET} SELECT DISTINCT entity_a, entity_b FROM met WHERE over")
def _(spark, sf):
    return temporal.cooccurring(temporal.min_gaps(*both(spark, sf)))


@register("minimum_frame_gap", f"WITH {MET} SELECT entity_a, entity_b, min(gap) AS gap FROM met GROUP BY ALL")
def _(spark, sf):
    return temporal.min_gaps(*both(spark, sf))


TRANSITION = "entity_a, entity_b, gap, round(centre, 6) AS centre, px1 AS ax1, qy2 AS by2"


def transition_view(df):
    return df.select("entity_a", "entity_b", "gap", F.round("centre", 6).alias("centre"), F.col("box_a.x1").alias("ax1"),
                     F.col("box_b.y2").alias("by2"))


@register("nearest_transition", f"WITH {NEAREST} SELECT {TRANSITION} FROM nt")
def _(spark, sf):
    pairs, trk = both(spark, sf)
    return transition_view(temporal.nearest_transition(temporal.min_gaps(pairs, trk), trk))


@register("closest_transition", f"WITH {CLOSEST.format(max_gap=240)} SELECT {TRANSITION} FROM ct")
def _(spark, sf):
    return transition_view(temporal.closest_transition(*both(spark, sf), 240))


@register("pair_device_count", f"""WITH {PAIR_LIST} SELECT entity_a, entity_b, count(DISTINCT device_id) AS devices FROM pl JOIN trk
  ON trk.entity_id IN (entity_a, entity_b) GROUP BY ALL""")
def _(spark, sf):
    return temporal.device_counts(*both(spark, sf))


@register("close_for_reentry", f"""WITH {NEAREST}, lb AS (SELECT entity_id, lx1 AS x1, ly1 AS y1, lx2 AS x2, ly2 AS y2 FROM trk
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY frame_end DESC, tracklet_id DESC) = 1)
SELECT entity_a, entity_b, {centre_sql('a.', 'b.')} <= 2 OR coalesce(centre <= 2, false) AS close FROM pl JOIN lb a ON a.entity_id = entity_a
  JOIN lb b ON b.entity_id = entity_b LEFT JOIN nt USING (entity_a, entity_b)""")
def _(spark, sf):
    pairs, trk = both(spark, sf)
    near = temporal.nearest_transition(temporal.min_gaps(pairs, trk), trk)
    return temporal.close_for_reentry(pairs, trk, near)


@register("short_reentry", f"""WITH {d.TRK}, c AS (SELECT tracklet_id, device_id, frame_start, entry_count, fx1, fy1, fx2, fy2, entity_id + k AS other_id, 0.5 + k * 0.1::DOUBLE AS score
  FROM trk, range(0, 4) r(k)),
m AS (SELECT c.tracklet_id, other_id, c.frame_start - t.frame_end AS gap, c.fx1, c.fy1, c.fx2, c.fy2, t.lx1, t.ly1, t.lx2, t.ly2
  FROM c JOIN trk t ON t.entity_id = other_id AND t.device_id = c.device_id AND c.frame_start - t.frame_end BETWEEN 1 AND 120
  WHERE score >= 0.55 AND c.entry_count <= 8 QUALIFY row_number() OVER (PARTITION BY c.tracklet_id, other_id ORDER BY t.frame_end DESC) = 1)
SELECT tracklet_id, other_id, gap FROM m WHERE {centre_sql('f', 'l')} <= 2""")
def _(spark, sf):
    trk = d.tracklets(spark, sf)
    k = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    cand = trk.select("tracklet_id", "device_id", "frame_start", "entry_count", "first_box", "entity_id", k)
    cand = cand.withColumn("other_id", F.col("entity_id") + F.col("k")).withColumn("score", F.lit(0.5) + F.col("k") * 0.1)
    return temporal.short_reentry(cand.drop("entity_id", "k"), trk)


@register("entity_numbering", f"""WITH {d.TRK} SELECT tracklet_id, 1000 + row_number() OVER (ORDER BY started_at, tracklet_id) AS entity_no FROM trk""")
def _(spark, sf):
    rows = d.tracklets(spark, sf).select("tracklet_id", "started_at")
    return numbering.with_number(rows, ["started_at", "tracklet_id"], 1001, "entity_no").select("tracklet_id", "entity_no")
