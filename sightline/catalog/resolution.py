"""Matching tracklets to entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import aggregation, quality
from ..plans import resolve
from ..sources import derived as d
from .registry import register
from .similarity import ANN

# one tracklet per query view; quality columns spread over their ranges ---------------------------

TR = d.GAL + """, tr AS (SELECT point_id AS tracklet_id, CASE WHEN point_id % 11 = 0 THEN -point_id ELSE point_id END AS track_id,
    list_transform(range(1, len(vec) + 1), lambda i: vec[i] + (((i * 5 + entity_id) % 11) - 5) * (entity_id % 7) * 0.008::DOUBLE) AS vec,
    0.45 + (entity_id % 53) / 100.0::DOUBLE AS v_avg, 0.5 + (entity_id % 47) / 94.0::DOUBLE AS vector_consistency, 2 + entity_id % 9 AS entry_count,
    1 + entity_id % 5 AS quality_frames, (entity_id % 37) / 80.0::DOUBLE AS max_overlap, entity_id AS own
  FROM gal WHERE v = 3),
gp AS (SELECT * FROM gal WHERE v <> 3 AND entity_id % 4 <> 0),
ps AS (SELECT tracklet_id, entity_id, max(score) FILTER (r = 1) AS s1, max(score) FILTER (r = 2) AS s2 FROM (
  SELECT tracklet_id, gp.entity_id, """ + ANN + """(tr.vec, gp.vec) AS score, row_number() OVER (PARTITION BY tracklet_id, gp.entity_id ORDER BY """ + ANN + """(tr.vec, gp.vec) DESC) AS r
  FROM tr, gp WHERE """ + ANN + """(tr.vec, gp.vec) >= 0.57) GROUP BY ALL)"""


def tracklets(spark, sf):
    e = F.col("entity_id")
    wave = F.transform("vec", lambda x, i: x + (((i + 1) * 5 + e) % 11 - 5) * (e % 7) * 0.008)
    return d.gallery(spark, sf).where("v = 3").select(
        F.col("point_id").alias("tracklet_id"), F.when(F.col("point_id") % 11 == 0, -F.col("point_id")).otherwise(F.col("point_id")).alias("track_id"),
        wave.alias("vec"), (F.lit(0.45) + (e % 53) / 100).alias("v_avg"), (F.lit(0.5) + (e % 47) / 94).alias("vector_consistency"),
        (e % 9 + 2).alias("entry_count"), (e % 5 + 1).alias("quality_frames"), ((e % 37) / 80).alias("max_overlap"),
        F.when(e % 6 == 1, e).alias("current_id"), F.when(e % 5 == 2, e).alias("hint_id"), e.alias("own"),
        F.when(e % 8 == 3, 5).when(e % 8 == 5, 1).otherwise(0).alias("attempts"), (e % 16 == 3).alias("was_ambiguous"))


def known(spark, sf):
    return d.gallery(spark, sf).where("v <> 3 AND entity_id % 4 <> 0")


def _search_sql(t, k):
    return f"""(SELECT * FROM (SELECT tracklet_id, entity_id, CASE WHEN s2 >= {t} THEN 0.5::DOUBLE * s1 + 0.5::DOUBLE * s2 ELSE s1 END AS score FROM ps WHERE s1 >= {t})
  QUALIFY row_number() OVER (PARTITION BY tracklet_id ORDER BY score DESC, entity_id) <= {k})"""


SOFT = TR + f""", sf AS (SELECT tracklet_id, entity_id, score, lead(score) OVER w AS second, row_number() OVER w AS r FROM {_search_sql(0.73, 2)} q
  WHERE (tracklet_id + entity_id) % 3 <> 0 WINDOW w AS (PARTITION BY tracklet_id ORDER BY score DESC, entity_id))"""


def _leaders(spark, sf, threshold, k):
    t = tracklets(spark, sf)
    scored = resolve.point_scores(t, known(spark, sf)).join(t.select("tracklet_id", "current_id"), "tracklet_id")
    ok = (F.col("tracklet_id") + F.col("entity_id")) % 3 != 0
    return resolve.leaders(scored, F.lit(threshold), k, ok, "soft")


@register("soft_match", f"""WITH {SOFT} SELECT tracklet_id, entity_id, round(score, 6) AS score FROM sf
WHERE r = 1 AND (second IS NULL OR score - second >= 0.06)""")
def _(spark, sf):
    return _leaders(spark, sf, 0.73, 2).where(resolve.soft_hit("soft")).select(
        "tracklet_id", F.col("soft_id").alias("entity_id"), F.round("soft_score", 6).alias("score"))


@register("near_gallery_defer", f"""WITH {TR}, nr AS (SELECT tracklet_id, entity_id, score, row_number() OVER (PARTITION BY tracklet_id ORDER BY score DESC, entity_id) AS r
  FROM {_search_sql(0.6, 2)} q WHERE (tracklet_id + entity_id) % 3 <> 0) SELECT tracklet_id, entity_id AS suggested_id, round(score, 6) AS score FROM nr WHERE r = 1""")
def _(spark, sf):
    return _leaders(spark, sf, 0.6, 2).select("tracklet_id", F.col("soft_id").alias("suggested_id"), F.round("soft_score", 6).alias("score"))


@register("new_identity_gates", f"""WITH {TR} SELECT tracklet_id, CASE WHEN entry_count < 6 THEN 'gate_tracklet_len' WHEN quality_frames < 3 THEN 'gate_high_quality_frames'
  WHEN v_avg < 0.6 THEN 'gate_v_avg' WHEN vector_consistency < 0.65 THEN 'gate_consistency' END AS gate FROM tr""")
def _(spark, sf):
    return tracklets(spark, sf).select("tracklet_id", resolve.new_identity_gate().alias("gate"))


AUXQ = TR + f""", aq AS (SELECT * FROM tr WHERE track_id < 0 AND v_avg >= 0.7 AND vector_consistency >= 0.8 AND entry_count >= 5 AND max_overlap <= 0.35)"""


@register("aux_gallery_match", f"""WITH {AUXQ}, ax AS (SELECT aq.tracklet_id, g.entity_id, max({ANN}(aq.vec, g.vec)) AS score FROM aq, gal g WHERE g.v = 1 GROUP BY ALL
  HAVING max({ANN}(aq.vec, g.vec)) >= 0.66),
rk AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM ax WINDOW w AS (PARTITION BY tracklet_id ORDER BY score DESC, entity_id)),
fu AS (SELECT tracklet_id, rk.entity_id, rk.score, second, max({ANN}(aq.vec, gp.vec)) AS support FROM rk JOIN aq USING (tracklet_id) LEFT JOIN gp ON gp.entity_id = rk.entity_id
  WHERE r = 1 GROUP BY ALL)
SELECT tracklet_id, entity_id AS aux_id, round(score, 6) AS aux_score, round(support, 6) AS aux_full, coalesce(support >= 0.62, false)
  AND (second IS NULL OR score - second >= 0.03) AS accepted FROM fu""")
def _(spark, sf):
    aux = d.gallery(spark, sf).where("v = 1")
    t = tracklets(spark, sf).withColumn("current_id", F.lit(None).cast("long"))
    rows = resolve.with_scores(t, known(spark, sf), aux).where("aux_id IS NOT NULL")
    ok = F.coalesce(F.col("aux_full") >= 0.62, F.lit(False)) & F.coalesce(F.col("aux_score") - F.col("aux_second") >= 0.03, F.lit(True))
    return rows.select("tracklet_id", "aux_id", F.round("aux_score", 6).alias("aux_score"), F.round("aux_full", 6).alias("aux_full"), ok.alias("accepted"))


def exclusions(spark, sf):
    t = tracklets(spark, sf)
    return resolve.exclusion_set({
        "forbidden": t.where("own % 9 = 0").select("tracklet_id", F.col("own").alias("entity_id")),
        "recent": t.where("own % 13 = 0").select("tracklet_id", F.col("own").alias("entity_id")),
        "blocked": t.where("own % 10 = 1").select("tracklet_id", F.col("own").alias("entity_id")),
        "duplicate": t.where("own % 20 = 1").select("tracklet_id", F.col("own").alias("entity_id")),
    }, t)


@register("exclusion_set", f"""WITH {TR} SELECT tracklet_id, own AS entity_id, reason FROM (
  SELECT tracklet_id, own, 'forbidden' AS reason FROM tr WHERE own % 9 = 0 UNION SELECT tracklet_id, own, 'recent' FROM tr WHERE own % 13 = 0
  UNION SELECT tracklet_id, own, 'blocked' FROM tr WHERE own % 10 = 1 UNION SELECT tracklet_id, own, 'duplicate' FROM tr WHERE own % 20 = 1) WHERE own % 6 <> 1""")
def _(spark, sf):
    return exclusions(spark, sf)


def decided(spark, sf, allow_new=True):
    rows = resolve.with_scores(tracklets(spark, sf), known(spark, sf), d.gallery(spark, sf).where("v = 1"), exclusions(spark, sf))
    return resolve.cascade(cut(rows), allow_new)


def _leader_sql(name, threshold, k, ok):
    by = "PARTITION BY tracklet_id ORDER BY b DESC, entity_id"
    return f"""{name} AS (SELECT tracklet_id, max(entity_id) FILTER (q = 1) AS id, max(b) FILTER (q = 1) AS score, max(b) FILTER (q = 2) AS second,
  max(b) FILTER (NOT mine) AS other FROM (SELECT *, row_number() OVER ({by}) AS q FROM (SELECT *, row_number() OVER ({by}) AS r FROM (
    SELECT *, CASE WHEN s2 >= {threshold} THEN 0.5::DOUBLE * s1 + 0.5::DOUBLE * s2 ELSE s1 END AS b FROM sc WHERE s1 >= {threshold})) WHERE r <= {k} AND ({ok})) GROUP BY 1)"""


LOOSE = "NOT forbidden AND NOT recent AND NOT blocked AND NOT mine"


def _clear(name):
    return f"({name}.id IS NOT NULL AND coalesce({name}.score - {name}.second >= 0.06, true))"


def _end(method, source, entity=None, score=None, second=None, hint=None):
    source = source if "CASE" in source or "||" in source or source == "promoted" else f"'{source}'"
    return (f"{{'method': '{method}', 'source': {source}, 'entity_id': CAST({entity or 'NULL'} AS BIGINT), 'score': CAST({score or 'NULL'} AS DOUBLE), "
            f"'runner_up': CAST({second or 'NULL'} AS DOUBLE), 'suggested_id': CAST({hint or 'NULL'} AS BIGINT)}}")


def _hit(method, source, name):
    return _end(method, source, f"{name}.id", f"{name}.score", f"{name}.second")


def _cascade_sql(allow_new, columns):
    """The cascade as one CASE over scores that are searched for one by one."""
    defer = {"entity": None, "score": "nr.score", "second": "nr.second", "hint": "nr.id"}
    short = _end("tentative_pending", "provisional_short_tracklet")
    fresh = f"good AND NOT unclear AND {allow_new}"
    steps = [
        ("x.current_id IS NULL AND vector_consistency < 0.55", _end("consistency_rejected", "incoherent_tracklet")),
        ("mn.id IS NOT NULL AND kept AND NOT switch", _end("current_identity_maintained", "track_continuity", "x.current_id", "x.current_score", "mn.other")),
        ("mn.id IS NOT NULL AND NOT unclear", _hit("gallery_match", "gallery_search", "mn")),
        ("kept", _end("current_identity_maintained", "track_continuity", "x.current_id", "x.current_score")),
        ("hint_id IS DISTINCT FROM x.current_id AND hint_ok AND hint_score >= 0.62", _end("spatial_appearance_reuse", "spatial_hint", "hint_id", "hint_score")),
        ("ax.id IS NOT NULL AND ax.support >= 0.62 AND coalesce(ax.score - ax.second >= 0.03, true)", _hit("scale_aux_gallery_match", "upper_body_gallery", "ax")),
        (f"good AND NOT {allow_new} AND {_clear('cp')}", _hit("capped_soft_match", "identity_cap", "cp")),
        (f"{fresh} AND entry_count < 6", short),
        (f"{fresh} AND {_clear('so')}", _hit("soft_match_at_promotion", "promoted", "so")),
        (f"{fresh} AND nr.id IS NOT NULL", _end("near_gallery_deferred", "promoted", **defer)),
        (f"{fresh} AND gate IS NULL", _end("new_identity", "promoted")),
        (fresh, _end("new_identity_blocked", "promoted || '__' || gate")),
        ("tries < 5", _end("tentative_pending", "quality_gate")),
        (f"NOT {allow_new} AND {_clear('cp')}", _hit("capped_soft_match", "identity_cap_fallback", "cp")),
        (f"NOT {allow_new}", _end("new_identity_suppressed", "new_identity_disabled")),
        ("dim AND fr.id IS NOT NULL", _hit("ambiguous_resolved", "tentative_fallback", "fr")),
        ("dim AND entry_count < 6", short),
        ("dim AND gate IS NULL", _end("new_identity", "ambiguous_fallback")),
        ("dim", _end("new_identity_blocked", "'ambiguous_fallback__' || gate")),
        (_clear("so"), _hit("tentative_soft_match", "tentative_fallback", "so")),
        ("nr.id IS NOT NULL AND NOT (good AND entry_count >= 6 AND coalesce(op.score, 0) < 0.64)", _end("near_gallery_deferred", "tentative_near_gallery", **defer)),
        ("NOT good", _end("tentative_pending", "quality_gate_blocked_fallback")),
        ("entry_count < 6", short),
        ("gate IS NULL", _end("new_identity", "tentative_fallback")),
        ("true", _end("new_identity_blocked", "'tentative_fallback__' || gate")),
    ]
    chain = "\n  ".join(f"WHEN {condition} THEN {end}" for condition, end in steps)
    out = ", ".join(f"round(o.{c}, 6) AS {c}" if c in ("score", "runner_up") else f"o.{c} AS {c}" for c in columns)
    return f"""WITH {AUXQ}, t0 AS (SELECT *, CASE WHEN own % 6 = 1 THEN own END AS current_id, CASE WHEN own % 5 = 2 THEN own END AS hint_id,
  CASE own % 8 WHEN 3 THEN 6 WHEN 5 THEN 2 ELSE 1 END AS tries, own % 16 = 3 AS was_dim, v_avg < 0.65 OR track_id < 0 AS low FROM tr),
xs AS (SELECT tracklet_id, own AS entity_id, own % 9 = 0 AS forbidden, own % 13 = 0 AS recent, own % 10 = 1 AS blocked, own % 20 = 1 AS duplicate FROM tr WHERE own % 6 <> 1),
sc AS (SELECT ps.*, low, coalesce(entity_id = current_id, false) AS mine, coalesce(forbidden, false) AS forbidden, coalesce(recent, false) AS recent,
  coalesce(blocked, false) AS blocked, coalesce(duplicate, false) AS duplicate FROM ps JOIN t0 USING (tracklet_id) LEFT JOIN xs USING (tracklet_id, entity_id)),
{_leader_sql('mn', 'CASE WHEN low THEN 0.75 ELSE 0.73 END', 5, 'mine OR (NOT forbidden AND NOT recent AND (NOT blocked OR (duplicate AND b >= 0.9)))')},
{_leader_sql('so', 0.73, 2, LOOSE)}, {_leader_sql('nr', '0.60', 2, LOOSE)}, {_leader_sql('cp', 0.57, 2, LOOSE)}, {_leader_sql('fr', 0.73, 5, LOOSE)},
{_leader_sql('op', '0.60', 1, 'true')},
os AS (SELECT tracklet_id, greatest(max({ANN}(t0.vec, gp.vec)) FILTER (gp.entity_id = current_id), 0.0) AS current_score,
  greatest(max({ANN}(t0.vec, gp.vec)) FILTER (gp.entity_id = hint_id), 0.0) AS hint_score FROM t0 JOIN gp ON gp.entity_id IN (current_id, hint_id) GROUP BY 1),
a1 AS (SELECT aq.tracklet_id, g.entity_id, max({ANN}(aq.vec, g.vec)) AS score FROM aq JOIN gal g ON g.v = 1 WHERE aq.own % 6 <> 1 GROUP BY ALL HAVING max({ANN}(aq.vec, g.vec)) >= 0.66),
a3 AS (SELECT * FROM a1 QUALIFY row_number() OVER (PARTITION BY tracklet_id ORDER BY score DESC, entity_id) <= 3),
a2 AS (SELECT a3.*, row_number() OVER w AS r, lead(score) OVER w AS second FROM a3 LEFT JOIN xs USING (tracklet_id, entity_id)
  WHERE NOT coalesce(forbidden OR recent OR blocked, false) WINDOW w AS (PARTITION BY tracklet_id ORDER BY score DESC, entity_id)),
ax AS (SELECT a2.tracklet_id, a2.entity_id AS id, a2.score, second, greatest(max({ANN}(tr.vec, gp.vec)), 0.0) AS support FROM a2 JOIN tr USING (tracklet_id)
  JOIN gp ON gp.entity_id = a2.entity_id WHERE r = 1 GROUP BY ALL),
x AS (SELECT t0.*, current_score, hint_score, v_avg >= 0.6 AND vector_consistency >= 0.65 AS good, CASE WHEN tries > 1 THEN 'tentative_promoted' ELSE 'new_detection' END AS promoted,
  CASE WHEN entry_count < 6 THEN 'gate_tracklet_len' WHEN quality_frames < 3 THEN 'gate_high_quality_frames' WHEN v_avg < 0.6 THEN 'gate_v_avg'
    WHEN vector_consistency < 0.65 THEN 'gate_consistency' END AS gate,
  coalesce(current_score >= CASE WHEN low THEN 0.75 ELSE 0.5 END, false) AS kept,
  NOT EXISTS (SELECT 1 FROM xs WHERE xs.tracklet_id = t0.tracklet_id AND xs.entity_id = hint_id AND (forbidden OR recent)) AS hint_ok FROM t0 LEFT JOIN os USING (tracklet_id)),
y AS (SELECT x.*, coalesce((other >= 0.92 AND other - current_score >= 0.22) OR (current_score <= 0.7 AND other >= 0.78 AND other - current_score >= 0.18), false) AS switch,
  coalesce(mn.id IS DISTINCT FROM current_id AND mn.score < 0.92 AND mn.score - second < 0.06, false) AS unclear FROM x LEFT JOIN mn USING (tracklet_id)),
z AS (SELECT x.tracklet_id, CASE {chain} END AS o FROM (SELECT *, unclear OR was_dim AS dim FROM y) x LEFT JOIN mn USING (tracklet_id) LEFT JOIN so USING (tracklet_id)
  LEFT JOIN nr USING (tracklet_id) LEFT JOIN cp USING (tracklet_id) LEFT JOIN fr USING (tracklet_id) LEFT JOIN op USING (tracklet_id) LEFT JOIN ax USING (tracklet_id))
SELECT tracklet_id, {out} FROM z"""


@register("match_cascade", _cascade_sql("true", ("method", "source", "entity_id", "suggested_id", "score", "runner_up")))
def _(spark, sf):
    return decided(spark, sf).select("tracklet_id", "method", "source", "entity_id", "suggested_id", F.round("score", 6).alias("score"),
                                     F.round("runner_up", 6).alias("runner_up"))


@register("match_cascade_capped", _cascade_sql("false", ("method", "source", "entity_id", "score")))
def _(spark, sf):
    return decided(spark, sf, allow_new=False).select("tracklet_id", "method", "source", "entity_id", F.round("score", 6).alias("score"))


@register("tentative_best_attempt", f"""WITH {TR}, a AS (SELECT *, tracklet_id % 50 AS t FROM tr)
SELECT t AS track_id, first(tracklet_id ORDER BY v_avg * vector_consistency DESC, tracklet_id) AS tracklet_id, count(*) - 1 AS attempts, max(entry_count) AS entry_count,
  max(quality_frames) AS quality_frames FROM a GROUP BY t""")
def _(spark, sf):
    t = tracklets(spark, sf).drop("attempts").withColumn("track_id", F.col("tracklet_id") % 50)
    return resolve.best_attempts(t).select("track_id", "tracklet_id", "attempts", "entry_count", "quality_frames")


@register("cluster_attach_or_mint", f"""WITH {TR}, cl AS (SELECT *, v_avg + 0.2 AS v_max, vector_consistency AS overall FROM tr WHERE entry_count >= 2 AND v_avg + 0.2 >= 0.65),
h AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM {_search_sql(0.73, 2)} q WINDOW w AS (PARTITION BY tracklet_id ORDER BY score DESC, entity_id)),
nr AS (SELECT tracklet_id, max(score) AS near FROM {_search_sql(0.6, 1)} q GROUP BY 1),
m AS (SELECT cl.tracklet_id, h.entity_id, CASE WHEN h.entity_id IS NOT NULL AND (second IS NULL OR score - second >= 0.06) THEN 'untracked_cluster_evidence'
  WHEN h.entity_id IS NULL AND v_max >= 0.85 AND entry_count >= 6 AND overall >= 0.65 AND coalesce(near < 0.64, true) THEN 'new_identity' END AS method
  FROM cl LEFT JOIN h ON h.tracklet_id = cl.tracklet_id AND h.r = 1 LEFT JOIN nr ON nr.tracklet_id = cl.tracklet_id)
SELECT tracklet_id, method, CASE WHEN method = 'untracked_cluster_evidence' THEN entity_id END AS entity_id FROM m WHERE method IS NOT NULL""")
def _(spark, sf):
    clusters = tracklets(spark, sf).withColumn("v_max", F.col("v_avg") + 0.2).withColumn("overall", F.col("vector_consistency"))
    return resolve.attach_or_mint(clusters, known(spark, sf)).select("tracklet_id", "method", "entity_id")


@register("reserved_within_frame", f"""WITH {TR}, c AS (SELECT tracklet_id, own % 60 AS entity_id, v_avg AS score, row_number() OVER (PARTITION BY tracklet_id % 3, own % 60 ORDER BY v_avg DESC, tracklet_id) AS r FROM tr)
SELECT tracklet_id, CASE WHEN r = 1 THEN entity_id END AS entity_id FROM c""")
def _(spark, sf):
    t = tracklets(spark, sf).select("tracklet_id", (F.col("own") % 60).alias("entity_id"), F.col("v_avg").alias("score"),
                                    F.lit("gallery_match").alias("method"), F.lit("dev").alias("device_id"), (F.col("tracklet_id") % 3).alias("frame_end"))
    return resolve.one_per_frame(t).select("tracklet_id", "entity_id")


# the whole way from frames to entities -----------------------------------------------------------------


def processed(spark, sf):
    """Tracklets of the device streams with vector, quality, decision and entity."""
    from .similarity import frame_vectors

    entries = cut(d.tracklet_entries(spark, sf))
    summary = quality.consistent(quality.ready(quality.summary(entries)))
    vectors = aggregation.tracklet_vectors(frame_vectors(spark, sf)).select(
        "tracklet_id", "vec", F.col("consistency").alias("vector_consistency"))
    owner = entries.groupBy("tracklet_id").agg(
        F.first("track_id").alias("track_id"), F.first("device_id").alias("device_id"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    rows = summary.join(vectors, "tracklet_id").join(owner, "tracklet_id").withColumnRenamed("tracklet_id", "tracklet_key")
    rows = rows.withColumn("tracklet_id", F.col("frame_start")).select(
        "*", *[F.lit(None).cast("long").alias(c) for c in ("current_id", "hint_id")], F.lit(0).alias("attempts"), F.lit(False).alias("was_ambiguous"))
    known_points = d.gallery(spark, sf).where("entity_id % 3 <> 0")
    scored = cut(resolve.with_scores(cut(rows), known_points))
    return cut(resolve.cascade(scored)), known_points


@register("process_tracklets")
def _(spark, sf):
    out, points = processed(spark, sf)
    first_id = points.agg(F.max("entity_id")).first()[0] + 1
    new = resolve.mint(out, first_id)
    joined = resolve.linked_new(new)
    named = new.join(joined.select(F.col("source_id").alias("entity_id"), "target_id"), "entity_id", "left").withColumn(
        "entity_id", F.coalesce("target_id", "entity_id")).drop("target_id")
    rest = out.where("method <> 'new_identity'")
    return rest.unionByName(named).select("tracklet_key", "device_id", "frame_start", "method", "source", "entity_id",
                                          F.round("score", 6).alias("score"))


@register("provisional_matches", f"""WITH c AS ({_cascade_sql('true', ('method', 'suggested_id', 'score', 'runner_up'))}), {TR},
w AS (SELECT c.*, tr.* EXCLUDE (tracklet_id), c.score >= 0.55 AND entry_count <= 8 AND tracklet_id * 3 - (suggested_id * 12 - 40) BETWEEN 1 AND 120 AS back
  FROM c JOIN tr USING (tracklet_id) WHERE method = 'near_gallery_deferred' AND own % 6 <> 1)
SELECT tracklet_id, suggested_id AS entity_id, 'occlusion_provisional_match' AS method, back AS short_reentry, score FROM w
WHERE score >= CASE WHEN back THEN 0.55 ELSE 0.75 END AND coalesce(score - runner_up >= 0.03, true) AND max_overlap < 0.4
  AND (v_avg < 0.65 OR track_id < 0 OR max_overlap >= 0.35 OR back)""")
def _(spark, sf):
    rows = decided(spark, sf).withColumn("device_id", F.lit("dev0")).withColumn("frame_start", F.col("tracklet_id") * 3)
    rows = rows.withColumn("first_box", F.struct(*[F.lit(x).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), (10.0, 10.0, 60.0, 160.0))]))
    past = d.gallery(spark, sf).where("v = 0").select(
        "entity_id", F.lit("dev0").alias("device_id"), (F.col("point_id") * 3 - 40).alias("frame_end"),
        F.struct(*[F.lit(x).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), (30.0, 10.0, 80.0, 160.0))]).alias("last_box"))
    return resolve.provisional(rows, past).select("tracklet_id", "entity_id", "method", "short_reentry", F.round("score", 6).alias("score"))


@register("snapshot_candidates", f"""WITH {TR} SELECT own AS entity_id, tracklet_id AS seq, round(0.5::DOUBLE * v_avg + 0.3::DOUBLE * vector_consistency + 0.2::DOUBLE * vector_consistency
  - 0.35::DOUBLE * greatest(0.0, least(1.0, max_overlap)), 4) AS snapshot_score FROM tr WHERE own % 5 <> 0""")
def _(spark, sf):
    t = tracklets(spark, sf).withColumn("entity_id", F.col("own")).withColumn("overall", F.col("vector_consistency")).withColumn(
        "provisional", F.col("own") % 5 == 0)
    return resolve.snapshot_rows(t).select("entity_id", "seq", "snapshot_score")
