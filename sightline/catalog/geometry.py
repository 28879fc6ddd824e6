"""Box geometry, scores and scalar helpers, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import labels as lb
from ..functions import vectors as v
from ..operators import ordered
from ..sources import derived as d
from .registry import register

OUTSIDE = "frame_w <= 0 OR frame_h <= 0 OR x2 <= x1 OR y2 <= y1"
M = "greatest(1, round_even(least(frame_w, frame_h) * (5.0::DOUBLE / 1080.0), 0))"
MX, MY = f"least({M}, greatest(0, frame_w // 2))", f"least({M}, greatest(0, frame_h // 2))"
L, R, T, O = f"x1 <= {MX}", f"x2 >= frame_w - {MX}", f"y1 <= {MY}", f"y2 >= frame_h - {MY}"
SIDES = f"(({L})::INT + ({R})::INT + ({T})::INT + ({O})::INT)"
CUTOFF = f"""CASE WHEN {OUTSIDE} THEN 0.05 WHEN {SIDES} = 0 THEN 1.0 WHEN {SIDES} = 1 THEN 0.6
  WHEN {SIDES} = 2 AND NOT (({L}) AND ({R}) OR ({T}) AND ({O})) THEN 0.3 WHEN {SIDES} <= 3 THEN 0.1 ELSE 0.05 END::DOUBLE"""
RATIO = f"CASE WHEN {OUTSIDE} THEN 0.0 ELSE (x2 - x1) * (y2 - y1) / (frame_w * frame_h)::DOUBLE END::DOUBLE"
AREA = f"""CASE WHEN {OUTSIDE} THEN 0.1 WHEN {RATIO} < 0.001 THEN 0.05 WHEN {RATIO} < 0.003 THEN 0.2
  WHEN {RATIO} < 0.0075 THEN 0.5 WHEN {RATIO} < 0.015 THEN 0.8 WHEN {RATIO} < 0.12 THEN 1.0 WHEN {RATIO} < 0.20 THEN 0.9
  WHEN {RATIO} < 0.30 THEN 0.75 WHEN {RATIO} < 0.45 THEN 0.55 ELSE 0.35 END::DOUBLE"""
HW = "(greatest(y2 - y1, 1.0) / greatest(x2 - x1, 1.0))"
ASPECT = f"""CASE WHEN {HW} BETWEEN 1.5 AND 4.0 THEN 1.0 WHEN {HW} BETWEEN 1.0 AND 6.0 THEN 0.7
  WHEN {HW} >= 0.5 AND {HW} < 1.0 THEN 0.4 ELSE 0.2 END::DOUBLE"""
CONF = "greatest(0.3::DOUBLE, least(1.0::DOUBLE, (confidence - 0.25) / 0.75 * 0.7 + 0.3))"
KEY = """concat_ws('_', floor((x1 + x2) / 2 / 64)::BIGINT::VARCHAR, floor((y1 + y2) / 2 / 64)::BIGINT::VARCHAR,
  floor(greatest(x2 - x1, 1.0) / frame_w * 20)::BIGINT::VARCHAR, floor(greatest(y2 - y1, 1.0) / frame_h * 20)::BIGINT::VARCHAR)"""

SINGLE = {
    "cutoff_score": (lambda B, FW, FH: {"value": g.cutoff_score(B, FW, FH)}, f"{CUTOFF} AS value"),
    "area_score": (lambda B, FW, FH: {"value": g.area_score(B, FW, FH)}, f"{AREA} AS value"),
    "aspect_score": (lambda B, FW, FH: {"value": g.aspect_score(B)}, f"{ASPECT} AS value"),
    "confidence_score": (lambda B, FW, FH: {"value": F.round(g.confidence_score(F.col("confidence")), 6)},
                         f"round({CONF}, 6) AS value"),
    "area_ratio": (lambda B, FW, FH: {"value": F.round(g.area_ratio(B, FW, FH), 8)}, f"round({RATIO}, 8) AS value"),
    "spatial_key": (lambda B, FW, FH: {"value": g.spatial_key(B, FW, FH)}, f"{KEY} AS value"),
    "box_xyxy_to_xywh": (lambda B, FW, FH: dict(zip(("cx", "cy", "w", "h"), g.xyxy_to_xywh(B))),
                         "(x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h"),
    "box_xywh_to_xyxy": (lambda B, FW, FH: dict(zip(("a", "b", "c", "e"), g.xywh_to_xyxy(*B))),
                         "x1 - x2 / 2 AS a, y1 - y2 / 2 AS b, x1 + x2 / 2 AS c, y1 + y2 / 2 AS e"),
    "box_xywh_to_ltwh": (lambda B, FW, FH: dict(zip(("l", "t", "w", "h"), g.xywh_to_ltwh(*B))),
                         "x1 - x2 / 2 AS l, y1 - y2 / 2 AS t, x2 AS w, y2 AS h"),
    "box_rescale": (lambda B, FW, FH: {n: F.round(c, 6) for n, c in zip(("a", "b", "c", "e"), g.rescale(B, FW, FH, 720))},
                    ", ".join(f"round({c} * (720.0::DOUBLE / 1920), 6) AS {n}"
                              for n, c in zip(("a", "b", "c", "e"), ("x1", "y1", "x2", "y2")))),
    "live_status": (lambda B, FW, FH: {"value": g.live_status(F.col("confidence"), F.col("x1") / 1500, F.col("class_id") > 0)},
                    """CASE WHEN NOT class_id > 0 THEN 'tentative' WHEN confidence < 0.45 OR x1 / 1500 >= 0.35
                       THEN 'recovering' ELSE 'confirmed' END AS value"""),
    "evidence_strength": (lambda B, FW, FH: {"value": g.evidence_strength(F.col("confidence"), F.col("x1") / 1500)},
                          """CASE WHEN confidence >= 0.8 AND x1 / 1500 >= 0.6 THEN 'high'
                             WHEN confidence >= 0.65 THEN 'moderate' ELSE 'weak' END AS value"""),
    "snapshot_score": (lambda B, FW, FH: {"value": g.snapshot_score(F.col("confidence"), F.col("x1") / 1543, F.col("y1") / 617,
                                                  F.col("x1") / 1013)},
                       """round(0.5::DOUBLE * confidence + 0.3::DOUBLE * (x1 / 1543) + 0.2::DOUBLE * (y1 / 617)
                          - 0.35::DOUBLE * greatest(0.0, least(1.0, x1 / 1013)), 4) AS value"""),
    "composite_quality": (lambda B, FW, FH: {"value": F.round(v.composite_quality(F.col("confidence"), F.col("x1") / 1500), 6)},
                          "round(confidence * (x1 / 1500), 6) AS value"),
    "ns_to_timestamp": (lambda B, FW, FH: {"at": F.date_format(g.timestamp_of_ns(F.col("created_at_ns")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                         "seconds": g.seconds_between(g.timestamp_of_ns(F.lit(0)),
                                                      g.timestamp_of_ns(F.col("created_at_ns")))},
                        """strftime(make_timestamp(created_at_ns // 1000), '%Y-%m-%dT%H:%M:%S.%f') AS at,
                           (created_at_ns // 1000) / 1e6 AS seconds"""),
}
for _name, (_cols, _sql) in SINGLE.items():
    @register(_name, f"WITH {d.DET} SELECT det_id, {_sql} FROM det")
    def _(spark, sf, cols=_cols):
        made = cols(g.box(), F.col("frame_w"), F.col("frame_h"))
        return d.detections(spark, sf).select("det_id", *[c.alias(n) for n, c in made.items()])


# two boxes: an observation and the one before it on the same track -----------------------

STEPS = d.OBS + """, steps AS (
  SELECT *, """ + ", ".join(f"lag({c}, {k}) OVER w AS p{k}_{c}" for k in (1, 2) for c in ("x1", "y1", "x2", "y2")) + """
  FROM obs WINDOW w AS (PARTITION BY device_id, track_id ORDER BY frame_no))"""


def steps(spark, sf, depth=1):
    return ordered.with_previous(d.observations(spark, sf), ["device_id", "track_id"], ["frame_no"],
                                 ["x1", "y1", "x2", "y2"], depth)


def inter_sql(a: str, b: str) -> str:
    return (f"(greatest(0.0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
            f" * greatest(0.0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))")


def area_sql(a: str) -> str:
    return f"(({a}x2 - {a}x1) * ({a}y2 - {a}y1))"


def iou_sql(a: str, b: str) -> str:
    return (f"(CASE WHEN {inter_sql(a, b)} <= 0 THEN 0.0 ELSE {inter_sql(a, b)} / "
            f"({area_sql(a)} + {area_sql(b)} - {inter_sql(a, b)}) END)::DOUBLE")


def iou_eps_sql(a: str, b: str) -> str:
    return f"({inter_sql(a, b)} / ({area_sql(b)} + {area_sql(a)} - {inter_sql(a, b)} + 1e-7))"


def size_sql(a: str) -> str:
    return f"greatest({a}x2 - {a}x1, {a}y2 - {a}y1, 1.0)"


def dist_sql(a: str, b: str) -> str:
    return (f"sqrt((({a}x1 + {a}x2) / 2 - ({b}x1 + {b}x2) / 2) ** 2"
            f" + (({a}y1 + {a}y2) / 2 - ({b}y1 + {b}y2) / 2) ** 2)")


def centre_sql(a: str, b: str) -> str:
    return f"({dist_sql(a, b)} / greatest({size_sql(a)}, {size_sql(b)}))"


def ratio_sql(p: str, q: str) -> str:
    return f"(greatest({p}, {q}) / greatest(least({p}, {q}), 1.0))"


def size_ratio_sql(a: str, b: str) -> str:
    return ratio_sql(size_sql(a), size_sql(b))


def area_ratio_sql(a: str, b: str) -> str:
    def solid(s):
        return f"(greatest({s}x2 - {s}x1, 1.0) * greatest({s}y2 - {s}y1, 1.0))"
    return ratio_sql(solid(a), solid(b))


def bottom_sql(a: str, b: str) -> str:
    return f"(abs({a}y2 - {b}y2) / greatest({a}y2 - {a}y1, {b}y2 - {b}y1, 1.0))"


def edge_sql(a: str, b: str) -> str:
    return "(" + " OR ".join(f"abs({a}{c} - {b}{c}) <= 2" for c in ("x1", "y1", "x2", "y2")) + ")"


PAIR = {
    "box_iou": (lambda B, P: {"value": F.round(g.iou(B, P), 6)}, f"round({iou_sql('', 'p1_')}, 6) AS value"),
    "box_iou_matrix_form": (lambda B, P: {"value": F.round(g.iou_eps(B, P), 6)}, f"round({iou_eps_sql('', 'p1_')}, 6) AS value"),
    "box_intersection_over_area": (lambda B, P: {"value": F.round(g.ioa(B, P), 6)},
                                   f"round({inter_sql('', 'p1_')} / ({area_sql('p1_')} + 1e-7), 6) AS value"),
    "centre_distance_ratio": (lambda B, P: {"value": F.round(g.centre_ratio(B, P), 6)},
                              f"round({centre_sql('', 'p1_')}, 6) AS value"),
    "pair_size_ratios": (lambda B, P: {"size": F.round(g.size_ratio(B, P), 8), "area": F.round(g.pair_area_ratio(B, P), 8),
                          "bottom": F.round(g.bottom_ratio(B, P), 8)},
                         f"""round({size_ratio_sql('', 'p1_')}, 8) AS size, round({area_ratio_sql('', 'p1_')}, 8) AS area,
                             round({bottom_sql('', 'p1_')}, 8) AS bottom"""),
    "share_frame_edge": (lambda B, P: {"value": g.share_edge(B, P)}, f"{edge_sql('', 'p1_')} AS value"),
    "fused_cost": (lambda B, P: {"value": F.round(g.fuse_score(g.iou_eps(B, P), F.col("v_score")), 6)},
                   f"round(1 - {iou_eps_sql('', 'p1_')} * v_score, 6) AS value"),
}
for _name, (_cols, _sql) in PAIR.items():
    @register(_name, f"WITH {STEPS} SELECT device_id, frame_no, {_sql} FROM steps WHERE p1_x1 IS NOT NULL")
    def _(spark, sf, cols=_cols):
        rows = steps(spark, sf).where("prev1 IS NOT NULL")
        return rows.select("device_id", "frame_no", *[c.alias(n) for n, c in cols(g.box(), g.box("prev1.")).items()])


def _cov(a: str, t: str) -> tuple[str, str, str]:
    w, h = f"(({a}x2 - {a}x1) ** 2 / 12.0::DOUBLE)", f"(({a}y2 - {a}y1) ** 2 / 12.0::DOUBLE)"
    return (f"({w} * cos({t}) ** 2 + {h} * sin({t}) ** 2)", f"({w} * sin({t}) ** 2 + {h} * cos({t}) ** 2)",
            f"(({w} - {h}) * cos({t}) * sin({t}))")


_T1, _T2 = "((frame_no % 31) * 0.1::DOUBLE)", "((frame_no % 17) * 0.1::DOUBLE)"
_A1, _B1, _C1 = _cov("", _T1)
_A2, _B2, _C2 = _cov("p1_", _T2)


@register("rotated_box_iou", f"""WITH {STEPS}, c AS (
  SELECT device_id, frame_no, (p1_x1 + p1_x2) / 2 - (x1 + x2) / 2 AS dx, (y1 + y2) / 2 - (p1_y1 + p1_y2) / 2 AS dy,
    {_A1} AS a1, {_B1} AS b1, {_C1} AS c1, {_A2} AS a2, {_B2} AS b2, {_C2} AS c2 FROM steps WHERE p1_x1 IS NOT NULL),
e AS (SELECT *, a1 + a2 AS a, b1 + b2 AS b, c1 + c2 AS c FROM c)
SELECT device_id, frame_no, round(1 - sqrt(1 - exp(-greatest(1e-7, least(100.0,
  (a * dy * dy + b * dx * dx) / (a * b - c * c + 1e-7) * 0.25 + c * dx * dy / (a * b - c * c + 1e-7) * 0.5
  + ln((a * b - c * c) / (4 * sqrt(greatest(a1 * b1 - c1 * c1, 0) * greatest(a2 * b2 - c2 * c2, 0)) + 1e-7) + 1e-7) * 0.5
  ))) + 1e-7), 6) AS value FROM e""")
def _(spark, sf):
    rows = steps(spark, sf).where("prev1 IS NOT NULL")
    t1, t2 = (F.col("frame_no") % 31) * 0.1, (F.col("frame_no") % 17) * 0.1
    value = g.rotated_iou(*g.xyxy_to_xywh(g.box()), t1, *g.xyxy_to_xywh(g.box("prev1.")), t2)
    return rows.select("device_id", "frame_no", F.round(value, 6).alias("value"))


@register("previous_box_features", f"""WITH {STEPS} SELECT device_id, frame_no, p1_x1, p1_y2, p2_x1, p2_y2 FROM steps""")
def _(spark, sf):
    return steps(spark, sf, 2).select(
        "device_id", "frame_no", F.col("prev1.x1").alias("p1_x1"), F.col("prev1.y2").alias("p1_y2"),
        F.col("prev2.x1").alias("p2_x1"), F.col("prev2.y2").alias("p2_y2"))


def _band(x: str, steps_: list[tuple[str, str]], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} {c} THEN {s}" for c, s in steps_) + f" ELSE {rest} END"


CONTINUITY = ("CASE WHEN p1_x1 IS NULL THEN 0.5 ELSE "
              + _band(iou_eps_sql("", "p1_"), [(">= 0.5", "1.0"), (">= 0.3", "0.7"), (">= 0.1", "0.4")], "0.2")
              + " END::DOUBLE")
_SPAN = "(greatest(x2 - x1, y2 - y1) + 1e-7)"
_CX, _CY = [{k: f"(({p}{c}1 + {p}{c}2) / 2)" for k, p in ((0, ""), (1, "p1_"), (2, "p2_"))} for c in ("x", "y")]
_JERK = (f"(sqrt((({_CX[0]} - {_CX[1]}) - ({_CX[1]} - {_CX[2]})) ** 2"
         f" + (({_CY[0]} - {_CY[1]}) - ({_CY[1]} - {_CY[2]})) ** 2) / {_SPAN})")
_MOVE = f"({dist_sql('', 'p1_')} / {_SPAN})"
SMOOTH = ("CASE WHEN p1_x1 IS NULL THEN 0.5::DOUBLE ELSE "
          + f"({_band(_MOVE, [('< 0.3', '1.0'), ('< 0.5', '0.6')], '0.3')})::DOUBLE * 0.6::DOUBLE + (CASE WHEN p2_x1 IS NULL THEN 1.0 ELSE "
          + _band(_JERK, [("< 0.2", "1.0"), ("< 0.4", "0.6")], "0.3") + " END)::DOUBLE * 0.4::DOUBLE END")


def track_scores(spark, sf):
    now, before = g.box(), g.box("prev1.")
    h1, h2 = F.col("prev1").isNotNull(), F.col("prev2").isNotNull()
    rows = steps(spark, sf, 2)
    rows = rows.withColumn("continuity", g.continuity_score(now, before, h1)).withColumn(
        "smoothness", g.smoothness(now, before, g.box("prev2."), h1, h2))
    return rows.withColumn("v_track", g.blended_visibility(F.col("v_score"), F.col("continuity"), F.col("smoothness")))


for _name, _col, _sql in (
    ("continuity_score", "continuity", CONTINUITY), ("smoothness_score", "smoothness", SMOOTH),
    ("blended_visibility", "v_track",
     f"greatest(v_score * 0.6::DOUBLE + ({CONTINUITY}) * 0.25::DOUBLE + ({SMOOTH}) * 0.15::DOUBLE, v_score * 0.85::DOUBLE)"),
):
    @register(_name, f"WITH {STEPS} SELECT device_id, frame_no, round({_sql}, 6) AS value FROM steps")
    def _(spark, sf, col=_col):
        return track_scores(spark, sf).select("device_id", "frame_no", F.round(col, 6).alias("value"))


# vectors and descriptors ---------------------------------------------------------------------

@register("vector_cosine", f"""WITH {d.GAL} SELECT a.point_id, round(list_cosine_similarity(a.vec, b.vec), 6) AS value
FROM gal a JOIN gal b ON a.entity_id = b.entity_id AND b.v = 0""")
def _(spark, sf):
    gal = d.gallery(spark, sf)
    anchor = gal.where("v = 0").select("entity_id", F.col("vec").alias("anchor"))
    return gal.join(anchor, "entity_id").select("point_id", F.round(v.cosine(F.col("vec"), F.col("anchor")), 6).alias("value"))


@register("vector_normalise", f"""WITH {d.GAL}, n AS (SELECT *, sqrt(list_dot_product(vec, vec)) AS n FROM gal)
SELECT point_id, round(vec[1] / n, 6) AS first, round(vec[64] / n, 6) AS last,
       round(list_sum(list_transform(vec, lambda x: x / n)), 6) AS total FROM n""")
def _(spark, sf):
    unit = v.l2_normalise(F.col("vec"))
    return d.gallery(spark, sf).select("point_id", unit.alias("u")).select(
        "point_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"),
        F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@register("descriptor_correlation", f"""WITH {d.GAL}, p AS (
  SELECT a.point_id, a.vec AS p, b.vec AS q FROM gal a JOIN gal b ON a.entity_id = b.entity_id AND b.v = 0),
u AS (SELECT point_id, unnest(p) AS x, unnest(q) AS y FROM p)
SELECT point_id, round(corr(x, y), 6) AS value FROM u GROUP BY point_id""")
def _(spark, sf):
    gal = d.gallery(spark, sf)
    anchor = gal.where("v = 0").select("entity_id", F.col("vec").alias("anchor"))
    return gal.join(anchor, "entity_id").select(
        "point_id", F.round(v.correlation(F.col("vec"), F.col("anchor")), 6).alias("value"))


# shapes of label sets -------------------------------------------------------------------------

FRAME_LABELS = d.VOTE + """, per AS (SELECT entity_id, frame_no, """ + ", ".join(
    f"max(label) FILTER (task = '{t}') AS {t}, max(confidence) FILTER (task = '{t}') AS {t}_confidence"
    for t in d.TASKS) + " FROM votes GROUP BY ALL)"


def frame_labels(spark, sf):
    return d.label_maps(d.votes(spark, sf), ["entity_id", "frame_no"])


@register("labels_flattened", f"""WITH {FRAME_LABELS} SELECT frame_no, """ + ", ".join(
    f"{t}, round({t}_confidence, 6) AS {t}_confidence" for t in d.TASKS) + " FROM per")
def _(spark, sf):
    flat = frame_labels(spark, sf).select("frame_no", *lb.flatten(F.col("labels"), d.TASKS))
    again = flat.select("frame_no", lb.unflatten(d.TASKS).alias("labels"))
    out = again.select("frame_no", *lb.flatten(F.col("labels"), d.TASKS))
    return out.select("frame_no", *d.TASKS, *[F.round(f"{t}_confidence", 6).alias(f"{t}_confidence") for t in d.TASKS])


@register("labels_only", f"WITH {FRAME_LABELS} SELECT frame_no, kind AS a, eyewear AS b FROM per")
def _(spark, sf):
    only = frame_labels(spark, sf).select("frame_no", lb.labels_only(F.col("labels")).alias("m"))
    return only.select("frame_no", F.col("m")["kind"].alias("a"), F.col("m")["eyewear"].alias("b"))


@register("labels_compact", f"""WITH {d.VOTE}, r AS (
  SELECT *, row_number() OVER (PARTITION BY frame_no ORDER BY round(confidence, 6) DESC, task) AS rk FROM votes
  WHERE label <> 'unknown' AND task NOT IN ('eyewear', 'kind'))
SELECT frame_no, string_agg(task || '=' || label, ',' ORDER BY rk) AS items FROM r WHERE rk <= 3 GROUP BY frame_no""")
def _(spark, sf):
    rounded = d.votes(spark, sf).withColumn("confidence", F.round("confidence", 6))
    maps = d.label_maps(rounded, ["frame_no"])
    items = F.transform(lb.compact(F.col("labels"), hidden=("eyewear", "kind"), limit=3),
                        lambda r: F.concat(r["task"], F.lit("="), r["label"]))
    return maps.select("frame_no", F.array_join(items, ",").alias("items")).where("items <> ''")


@register("composite_ids", f"""WITH {d.OBS}
SELECT frame_no, concat_ws(':', device_id, track_id::VARCHAR) AS track_key,
       concat_ws(':', device_id, track_id::VARCHAR, event_type, frame_no::VARCHAR, (frame_no + 5)::VARCHAR) AS candidate_id
FROM obs""")
def _(spark, sf):
    o = d.observations(spark, sf)
    return o.select("frame_no", F.concat_ws(":", "device_id", "track_id").alias("track_key"),
                    F.concat_ws(":", "device_id", "track_id", "event_type", "frame_no", F.col("frame_no") + 5)
                    .alias("candidate_id"))


@register("time_buckets", f"""WITH {d.OBS} SELECT frame_no, strftime(ts, '%Y-%m-%d') AS day,
  strftime(ts, '%Y-%m-%dT%H:00') AS hour, round(sqrt(v_score), 2) AS v2, round(overlap_ratio / 3, 4) AS o4 FROM obs""")
def _(spark, sf):
    return d.observations(spark, sf).select(
        "frame_no", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH:00").alias("hour"),
        F.round(F.sqrt("v_score"), 2).alias("v2"), F.round(F.col("overlap_ratio") / 3, 4).alias("o4"))


@register("bytes_to_base64", "SELECT event_id, base64(props::BLOB) AS value FROM events")
def _(spark, sf):
    return d.table(spark, sf, "events").select("event_id", F.base64(F.encode("props", "UTF-8")).alias("value"))
