"""Queries that write, read back, count on the way, or call a model in batches; and the appearance split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models
from ..operators import splitting
from ..plans import tables
from ..sources import derived as d
from ..sources import frames
from ..streaming import tables as live
from .registry import register
from .streams import scratch


@register("append_tracklet_records", f"""WITH {d.TRK} SELECT device_id, state, count(*) AS tracklets, sum(entry_count)::BIGINT AS entries FROM trk GROUP BY ALL""")
def _(spark, sf):
    where = f"{scratch(spark)}/tracklets"
    t = d.tracklets(spark, sf).select("tracklet_id", "device_id", "state", "frame_start", "entry_count")
    for half in (0, 1):  # two batches reach the same table
        tables.append(t.where(F.col("frame_start") % 2 == half), where, ["device_id"])
    return spark.read.parquet(where).groupBy("device_id", "state").agg(F.count(F.lit(1)).alias("tracklets"), F.sum("entry_count").alias("entries"))


@register("labelled_folder", "SELECT event_type AS label, sum(strlen(event_id::VARCHAR) + 1)::BIGINT AS bytes FROM events GROUP BY 1")
def _(spark, sf):
    where = scratch(spark)
    d.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("value"), F.col("event_type").alias("kind")).write.partitionBy("kind").text(where)
    found = frames.labelled_folder(spark, where, (".txt",))
    return found.groupBy(F.regexp_replace("label", "^kind=", "").alias("label")).agg(F.sum(F.length("content")).alias("bytes"))


@register("report_sinks", """SELECT 'items' AS part, count(*) AS n, sum(event_id)::BIGINT AS total FROM events
UNION ALL SELECT 'thresholds', count(DISTINCT event_type), count(*) FROM events UNION ALL SELECT 'summary', 1, max(event_id) FROM events""")
def _(spark, sf):
    where = scratch(spark)
    e = d.table(spark, sf, "events").select("event_id", "event_type")
    frames.write_report(e, e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), e.agg(F.max("event_id").alias("last")), where)
    items = spark.read.schema("event_id long, event_type string").option("header", "true").csv(f"{where}/items")
    sweep = spark.read.schema("event_type string, n long").option("header", "true").csv(f"{where}/thresholds")
    summary = spark.read.schema("last long").json(f"{where}/summary")
    n = F.count(F.lit(1)).alias("n")
    parts = [(items, "items", F.sum("event_id")), (sweep, "thresholds", F.sum("n")), (summary, "summary", F.max("last"))]
    out = [df.agg(n, total.alias("total")).select(F.lit(name).alias("part"), "n", "total") for df, name, total in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("pipeline_counters", f"WITH {d.DET} SELECT count(*) AS rows, max(frame_no) AS last_frame, round(avg(confidence), 6) AS avg_confidence FROM det")
def _(spark, sf):
    passing, seen = live.counters(d.detections(spark, sf), "counted")
    passing.write.parquet(f"{scratch(spark)}/out")
    got = seen.get
    return spark.range(1).select(F.lit(got["rows"]).cast("long").alias("rows"), F.lit(got["last_frame"]).cast("long").alias("last_frame"),
                                 F.round(F.lit(got["avg_confidence"]).cast("double"), 6).alias("avg_confidence"))


def contents(spark, sf):
    """Texts stand in for images."""
    return d.table(spark, sf, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"))


@register("batch_vector_extraction", "SELECT doc_id, strlen(text)::DOUBLE AS size, (strlen(text) - strlen(replace(text, chr(10), '')))::DOUBLE AS breaks FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    out = models.extract_vectors(contents(spark, sf), lambda images: [[float(len(b)), float(b.count(b"\n"))] for b in images])
    return out.select("doc_id", F.col("vec")[0].alias("size"), F.col("vec")[1].alias("breaks"))


@register("batch_labelling", """SELECT CASE WHEN strlen(text) % 2 = 0 THEN 'even' ELSE 'odd' END AS label, count(*) AS n, round(avg((strlen(text) % 10) / 10.0), 6)::DOUBLE AS confidence
FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    def model(images):
        return [{"kind": {"label": "odd" if len(b) % 2 else "even", "confidence": len(b) % 10 / 10}} for b in images]

    one = F.col("labels")["kind"]
    return models.extract_labels(contents(spark, sf), model).groupBy(one["label"].alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(one["confidence"]), 6).alias("confidence"))


# one track holds rows of several entities, so its appearance changes
SPLIT = d.OBS + ", " + d.GAL + """, o AS MATERIALIZED (SELECT device_id, obs.track_id % 20 AS track_id, frame_no, gal.vec,
  row_number() OVER (PARTITION BY device_id, obs.track_id % 20 ORDER BY frame_no) AS p
  FROM obs JOIN gal ON point_id = obs.entity_id * 4 + frame_no % 4 WHERE v_score >= 0.6),
s AS (SELECT DISTINCT device_id, track_id, 0::BIGINT AS p, NULL::BIGINT AS frame_no, []::DOUBLE[][] AS shown, NULL::BIGINT AS checked, 0 AS n, false AS away FROM o
  UNION ALL SELECT device_id, track_id, p, frame_no, CASE WHEN few OR looks AND alike THEN list_append(shown, vec)[-16:] ELSE shown END,
    CASE WHEN looks THEN frame_no ELSE checked END, CASE WHEN looks AND NOT alike THEN n + 1 ELSE n END, looks AND NOT alike FROM (
    SELECT o.device_id, o.track_id, o.p, o.frame_no, o.vec, s.shown, s.checked, s.n, len(s.shown) < 2 AS few,
      len(s.shown) >= 2 AND (s.checked IS NULL OR o.frame_no - s.checked >= 6) AS looks,
      list_cosine_similarity(list_transform(range(1, len(o.vec) + 1), lambda i: coalesce(list_sum(list_transform(s.shown, lambda m: m[i])), 1.0)), o.vec) >= 0.55 AS alike
    FROM s JOIN o ON o.device_id = s.device_id AND o.track_id = s.track_id AND o.p = s.p + 1))"""


@register("appearance_split", f"""WITH RECURSIVE {SPLIT} SELECT device_id, frame_no, track_id, -(track_id * 1000000 + n)::BIGINT AS virtual_id FROM s WHERE away""")
def _(spark, sf):
    o = d.observations(spark, sf).withColumn("point_id", F.col("entity_id") * 4 + F.col("frame_no") % 4)
    rows = o.join(d.gallery(spark, sf).select("point_id", "vec"), "point_id").withColumn("track_id", F.col("track_id") % 20)
    return splitting.split_tracks(rows).where("virtual_track_id < 0").select("device_id", "frame_no", "track_id", F.col("virtual_track_id").alias("virtual_id"))
