"""Label votes, hysteresis and the label rules for pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..lineage import cut
from ..operators import hysteresis, votes
from ..plans import exclusions
from ..sources import derived as d
from .geometry import centre_sql, iou_sql
from .registry import register
from .reports import VOTED
from .temporal import rec_sql

STABLE, SCALE, HARD = lb.LABELS.stable, lb.LABELS.scale_stable, d.HARD

TALLY = """{name} AS (SELECT {keys}, task, label, round(s / n, 4) AS confidence FROM (
  SELECT {keys}, task, label, sum(confidence) AS s, count(*) AS n FROM {src} GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY {keys}, task ORDER BY round(s, 6) DESC, label) = 1)"""
TRACKLET_VOTES = d.ENTRIES + ", " + d.VOTE + """, tv AS (SELECT e.tracklet_id, e.entity_id, v.frame_no, task, label, confidence
  FROM entries e JOIN votes v USING (entity_id, device_id, frame_no)), """ + TALLY.format(name="tvoted", keys="tracklet_id", src="tv")


def tracklet_votes(spark, sf):
    e = d.tracklet_entries(spark, sf).select("tracklet_id", "entity_id", "device_id", "frame_no")
    v = d.votes(spark, sf).select("entity_id", "device_id", "frame_no", "task", "label", "confidence")
    return e.join(v, ["entity_id", "device_id", "frame_no"])


@register("tracklet_label_vote", f"WITH {TRACKLET_VOTES} SELECT * FROM tvoted")
def _(spark, sf):
    return votes.tracklet_vote(tracklet_votes(spark, sf))


@register("entity_label_vote", f"WITH {VOTED} SELECT entity_id, task, label, confidence FROM voted")
def _(spark, sf):
    return votes.entity_vote(d.votes(spark, sf))


HYST = d.VOTE + """, vn AS MATERIALIZED (SELECT entity_id, task, label, confidence AS conf, frame_no,
    row_number() OVER (PARTITION BY entity_id, task ORDER BY frame_no) AS rn FROM votes),
h AS (SELECT entity_id, task, 0::BIGINT AS rn, 'unknown' AS cur, 'unknown' AS last, 0 AS dis, 0.0::DOUBLE AS sure, 0::BIGINT AS support
    FROM vn WHERE rn = 1
  UNION ALL SELECT entity_id, task, rn, CASE WHEN (k = 0 AND conf >= 0.7) OR flips THEN label ELSE cur END,
    CASE WHEN k = 0 THEN last ELSE label END, CASE WHEN k = 1 OR flips THEN 0 WHEN k = 0 THEN dis ELSE d2 END,
    CASE WHEN k = 1 THEN 0.8::DOUBLE * sure + 0.2::DOUBLE * conf WHEN (k = 0 AND conf >= 0.7) OR flips THEN conf ELSE sure END,
    CASE WHEN k = 1 THEN support + 1 WHEN (k = 0 AND conf >= 0.7) OR flips THEN 1 ELSE support END
  FROM (SELECT *, k = 2 AND d2 >= 2 AND conf >= CASE WHEN task = 'kind' THEN 0.65 ELSE 0.85 END AS flips FROM (
    SELECT v.entity_id, v.task, v.rn, v.label, v.conf, h.cur, h.last, h.dis, h.sure, h.support,
      CASE WHEN h.cur = 'unknown' THEN 0 WHEN v.label = h.cur THEN 1 ELSE 2 END AS k,
      CASE WHEN v.label = h.last THEN least(h.dis + 1, 2) ELSE 1 END AS d2
    FROM h JOIN vn v ON v.entity_id = h.entity_id AND v.task = h.task AND v.rn = h.rn + 1)))"""
SNAP = HYST + """, snap AS (SELECT entity_id, task, cur AS label, round(sure, 4) AS confidence, support FROM h
  QUALIFY row_number() OVER (PARTITION BY entity_id, task ORDER BY rn DESC) = 1)"""


def resolved(spark, sf, **kw):
    return hysteresis.resolve(d.votes(spark, sf), ["entity_id"], ["frame_no"], HARD, **kw)


def snapshot(spark, sf):
    return hysteresis.latest(d.votes(spark, sf), ["entity_id"], ["frame_no"], HARD)


def hard_snapshot(spark, sf):
    """Tasks have a history each: the others' are left out before it is followed."""
    return hysteresis.latest(d.votes(spark, sf).where(F.col("task") == HARD), ["entity_id"], ["frame_no"], HARD)


_STEPS_SQL = f"""WITH RECURSIVE {HYST} SELECT h.entity_id, h.task, frame_no, cur AS current, dis AS dissent, round(sure, 6) AS confidence, support
FROM h JOIN vn USING (entity_id, task, rn)"""


@register("label_hysteresis", _STEPS_SQL)
def _(spark, sf):
    return resolved(spark, sf).select("entity_id", "task", "frame_no", "current", "dissent",
                                      F.round("confidence", 6).alias("confidence"), "support")


@register("label_snapshot", f"WITH RECURSIVE {SNAP} SELECT * FROM snap")
def _(spark, sf):
    return snapshot(spark, sf)


# pair rules over voted labels ------------------------------------------------------------------------

LAB = VOTED + """, lab AS (SELECT entity_id, """ + ", ".join(
    f"coalesce(max(label) FILTER (task = '{t}'), 'unknown') AS {t}, coalesce(max(confidence) FILTER (task = '{t}'), 0) AS {t}_c"
    for t in d.TASKS) + """ FROM voted GROUP BY entity_id),
pr AS (SELECT a.entity_id AS entity_a, b.entity_id AS entity_b, """ + ", ".join(
    f"a.{t} AS a_{t}, a.{t}_c AS a_{t}_c, b.{t} AS b_{t}, b.{t}_c AS b_{t}_c" for t in d.TASKS) + """
  FROM lab a JOIN range(1, 5) o(k) ON true JOIN lab b ON b.entity_id = a.entity_id + k)"""


def pair_labels(spark, sf):
    labels = d.label_maps(votes.entity_vote(d.votes(spark, sf)), ["entity_id"])
    a = labels.select(F.col("entity_id").alias("entity_a"), F.col("labels").alias("a"))
    a = a.withColumn("entity_b", F.explode(F.sequence(F.col("entity_a") + 1, F.col("entity_a") + 4)))
    return a.join(labels.select(F.col("entity_id").alias("entity_b"), F.col("labels").alias("b")), "entity_b")


def known_sql(t):
    return f"a_{t} <> 'unknown' AND b_{t} <> 'unknown'"


def differs_sql(t, f):
    return f"({known_sql(t)} AND a_{t} <> b_{t} AND a_{t}_c >= {f} AND b_{t}_c >= {f})"


def agrees_sql(t, f):
    return f"({known_sql(t)} AND a_{t} = b_{t} AND a_{t}_c >= {f} AND b_{t}_c >= {f})"


def count_sql(fn, tasks, f):
    return "(" + " + ".join(f"{fn(t, f)}::INT" for t in tasks) + ")"


STRONG = f"({differs_sql(HARD, 0.85)} OR {count_sql(differs_sql, STABLE, 0.85)} >= 2)"
OPPOSED = f"({known_sql(HARD)} AND a_{HARD} <> b_{HARD})"
BRIDGE = f"(NOT {STRONG} AND {agrees_sql(HARD, 0.7)} AND {count_sql(agrees_sql, STABLE, 0.7)} >= 2)"
HIGH = f"(NOT {STRONG} AND {count_sql(agrees_sql, STABLE, 0.65)} >= 2)"
SCALED = f"(NOT {STRONG} AND NOT {OPPOSED} AND {count_sql(agrees_sql, SCALE, 0.65)} >= 2)"
CLOTH = f"(NOT {STRONG} AND {count_sql(agrees_sql, STABLE, 0.7)} >= 3)"
STABLE_A = "(" + " OR ".join(f"(a_{t} <> 'unknown' AND a_{t}_c >= 0.7)" for t in (HARD, *STABLE)) + ")"
STABLE_B = STABLE_A.replace("a_", "b_")
SINGLE = f"({agrees_sql(HARD, 0.8)} OR NOT {OPPOSED} AND {{score}} >= 0.88)"

_A, _B = (lambda: F.col("a")), (lambda: F.col("b"))
RULES = {
    "hard_label_conflict": (lambda: lb.hard_conflict(_A(), _B(), HARD), differs_sql(HARD, 0.85)),
    "moderate_label_conflict": (lambda: lb.hard_conflict(_A(), _B(), HARD, lb.LABELS.moderate), differs_sql(HARD, 0.6)),
    "strong_label_conflict": (lambda: lb.strong_conflict(_A(), _B(), HARD), STRONG),
    "labels_support_bridge": (lambda: lb.supports_bridge(_A(), _B(), HARD), BRIDGE),
    "labels_support_high_confidence": (lambda: lb.supports_high_confidence(_A(), _B(), HARD), HIGH),
    "labels_support_scale_change": (lambda: lb.supports_scale(_A(), _B(), HARD), SCALED),
    "labels_support_three_of_four": (lambda: lb.supports_clothing(_A(), _B(), HARD), CLOTH),
    "stable_label_evidence": (lambda: lb.stable_evidence(_A(), HARD), STABLE_A),
    "singleton_label_rule": (lambda: lb.allows_singleton(_A(), _B(), HARD, (F.col("entity_a") % 30) / 30),
                             SINGLE.format(score="(entity_a % 30) / 30")),
}
for _name, (_rule, _sql) in RULES.items():
    @register(_name, f"WITH {LAB} SELECT entity_a, entity_b, {_sql} AS holds FROM pr")
    def _(spark, sf, rule=_rule):
        return pair_labels(spark, sf).select("entity_a", "entity_b", rule().alias("holds"))


COMMITTED = d.VOTE + """, sure AS (SELECT entity_id, label, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC) AS r FROM votes
  WHERE task = 'kind' AND label <> 'unknown' AND confidence >= 0.8),
com AS (SELECT entity_id, min(label) AS label FROM sure WHERE r <= 2 GROUP BY 1 HAVING count(*) = 2 AND count(DISTINCT label) = 1)"""


@register("committed_label_disagreement", f"""WITH {COMMITTED} SELECT a.entity_id AS entity_a, b.entity_id AS entity_b, a.label AS label_a, b.label AS label_b
FROM com a JOIN range(1, 5) o(k) ON true JOIN com b ON b.entity_id = a.entity_id + k WHERE a.label <> b.label""")
def _(spark, sf):
    rows = d.votes(spark, sf).where(F.col("task") == HARD)
    pairs = pair_labels(spark, sf).select("entity_a", "entity_b")
    out = votes.committed_disagreement(pairs, votes.committed(rows, ["entity_id"], ["ts"]))
    return out.select("entity_a", "entity_b", "label_a", "label_b")


# a tracklet's hard label against entities it might belong to --------------------------------------------

AGAINST = TRACKLET_VOTES + ", " + SNAP.replace(d.VOTE + ", ", "") + """, own AS (SELECT tracklet_id, any_value(entity_id) AS entity_id FROM tv GROUP BY 1),
ag AS (SELECT o.tracklet_id, o.entity_id AS current_id, s.entity_id, t.label AS t_label, t.confidence AS t_conf, s.label AS e_label,
    s.confidence AS e_conf, s.support AS e_support
  FROM own o JOIN tvoted t ON t.tracklet_id = o.tracklet_id AND t.task = 'kind' JOIN range(0, 4) r(k) ON true
  JOIN snap s ON s.entity_id = o.entity_id + k AND s.task = 'kind')"""


def against(spark, sf):
    """(tracklet, candidate entity) rows; the exclusion is a test on candidates, never a list of all misfits."""
    tv = tracklet_votes(spark, sf)
    own = tv.groupBy("tracklet_id").agg(F.first("entity_id").alias("current_id"))
    voted = votes.tracklet_vote(tv.where(F.col("task") == HARD)).select(
        "tracklet_id", F.col("label").alias("t_label"), F.col("confidence").alias("t_conf"))
    snap = hard_snapshot(spark, sf).select(
        "entity_id", F.col("label").alias("e_label"), F.col("confidence").alias("e_conf"), F.col("support").alias("e_support"))
    near = own.join(voted, "tracklet_id").withColumn(
        "entity_id", F.explode(F.sequence(F.col("current_id"), F.col("current_id") + 3)))
    return near.join(snap, "entity_id")


def _misfit_sql(floor):
    return f"""(t_label <> 'unknown' AND e_label <> 'unknown' AND t_label <> e_label AND t_conf >= {floor}
  AND (e_conf >= 0.8 OR e_support >= 2))"""


def _misfit(floor):
    return lb.incompatible(F.col("t_label"), F.col("t_conf"), F.col("e_label"), F.col("e_conf"), F.col("e_support"), floor)


# entities of the whole table that a tracklet's hard label rules out: classes of tracklets, members of a class, and given candidates
WHOLE = TRACKLET_VOTES + ", " + SNAP.replace(d.VOTE + ", ", "") + """, own AS (SELECT tracklet_id, any_value(entity_id) AS current_id FROM tv GROUP BY 1),
tl AS (SELECT tracklet_id, label FROM tvoted WHERE task = 'kind' AND label <> 'unknown' AND confidence >= 0.55),
el AS (SELECT entity_id, label FROM snap WHERE task = 'kind' AND label <> 'unknown' AND (confidence >= 0.8 OR support >= 2))"""


def hard_votes(spark, sf):
    """(tracklet_id, current_id), the tracklets' hard labels, and the entities'."""
    tv = tracklet_votes(spark, sf)
    own = tv.groupBy("tracklet_id").agg(F.first("entity_id").alias("current_id"))
    return own, votes.tracklet_vote(tv.where(F.col("task") == HARD)), hard_snapshot(spark, sf)


@register("label_misfit_classes", f"""WITH RECURSIVE {WHOLE} SELECT tl.tracklet_id, tl.label, count(el.entity_id) AS n_misfits FROM tl JOIN own USING (tracklet_id)
LEFT JOIN el ON el.label <> tl.label AND el.entity_id <> current_id GROUP BY ALL""")
def _(spark, sf):
    own, voted, snap = hard_votes(spark, sf)
    return exclusions.misfit_classes(voted, snap, own)


@register("label_misfit_members", f"""WITH RECURSIVE {WHOLE} SELECT DISTINCT tl.label, el.entity_id FROM tl JOIN el ON el.label <> tl.label""")
def _(spark, sf):
    _, voted, snap = hard_votes(spark, sf)
    return exclusions.misfit_members(voted, snap)


NEIGHBOURS = """, nb AS (SELECT DISTINCT a.tracklet_id, b.entity_id FROM trk a JOIN trk b ON a.device_id = b.device_id AND a.entity_id <> b.entity_id
  AND a.frame_start - 240 <= b.frame_end AND b.frame_start <= a.frame_end + 240)"""
FITTED = WHOLE.replace(d.ENTRIES, d.TRK) + NEIGHBOURS


@register("label_incompatible_entities", f"""WITH RECURSIVE {FITTED} SELECT tracklet_id, entity_id FROM nb JOIN tl USING (tracklet_id)
JOIN el USING (entity_id) WHERE tl.label <> el.label""")
def _(spark, sf):
    _, voted, snap = hard_votes(spark, sf)
    return exclusions.misfit_neighbours(d.tracklets(spark, sf), voted, snap)


@register("exclusions_found", f"""WITH RECURSIVE {FITTED}, {rec_sql(120).replace(d.OBS + ", ", "")}, {rec_sql(18).replace(d.OBS + ", ", "").replace("rec AS", "rec18 AS")},
st AS (SELECT tracklet_id, frame_start AS row_id, entity_id AS current_id FROM trk)
SELECT DISTINCT x.tracklet_id, x.entity_id, reason FROM (
  SELECT tracklet_id, nb.entity_id, 'forbidden' AS reason FROM nb JOIN tl USING (tracklet_id) JOIN el USING (entity_id) WHERE tl.label <> el.label
  UNION ALL SELECT tracklet_id, other_id, 'recent' FROM st JOIN rec USING (row_id) WHERE {iou_sql('', 'o_')} < 0.1 AND {centre_sql('', 'o_')} > 0.9
  UNION ALL SELECT tracklet_id, other_id, 'blocked' FROM st JOIN rec18 USING (row_id) WHERE other_track <> track_id
  UNION ALL SELECT tracklet_id, other_id, 'duplicate' FROM st JOIN rec18 USING (row_id) WHERE {iou_sql('', 'o_')} >= 0.5) x JOIN st USING (tracklet_id)
WHERE x.entity_id <> current_id""")
def _(spark, sf):
    _, voted, snap = hard_votes(spark, sf)
    t = cut(d.tracklets(spark, sf).select("tracklet_id", "entity_id", "device_id", "frame_start", "frame_end"))
    starts = t.select("tracklet_id", F.col("frame_start").alias("row_id"), F.col("entity_id").alias("current_id"))
    rows = d.observations(spark, sf).withColumn("row_id", F.col("frame_no"))
    return exclusions.found(starts, rows, exclusions.misfit_neighbours(t, voted, snap))


@register("label_conflict_with_current", f"""WITH RECURSIVE {AGAINST} SELECT tracklet_id, entity_id, {_misfit_sql(0.88)} AS strong,
  {_misfit_sql(0.55)} AS any_conflict FROM ag WHERE entity_id = current_id""")
def _(spark, sf):
    return against(spark, sf).where(F.col("entity_id") == F.col("current_id")).select(
        "tracklet_id", "entity_id", _misfit(lb.LABELS.tracklet_strong).alias("strong"),
        _misfit(lb.LABELS.tracklet_floor).alias("any_conflict"))


@register("ambiguous_label_mask", f"""WITH RECURSIVE {AGAINST}, m AS (SELECT *, e_label <> 'unknown' AND t_label <> 'unknown' AND e_label <> t_label
  AND t_conf >= 0.7 AND e_conf <= 0.8 AS hit FROM ag)
SELECT tracklet_id, entity_id, CASE WHEN hit THEN 'unknown' ELSE e_label END AS label, CASE WHEN hit THEN 0 ELSE e_conf END AS confidence FROM m""")
def _(spark, sf):
    masked = lb.mask_ambiguous(F.col("e_label"), F.col("e_conf"), F.col("t_label"), F.col("t_conf"))
    return against(spark, sf).select("tracklet_id", "entity_id", masked.alias("m")).select("tracklet_id", "entity_id", "m.*")
