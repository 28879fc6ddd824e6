"""Queries that run a stream over the test tables until it is drained."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import CLUSTERS, TRACKLETS
from ..lineage import ensure_checkpoint_dir
from ..operators import clusters, evidence, folds, live, tracks
from ..plans import resolve
from ..sources import derived as d
from ..sources import frames
from ..streaming import folds as stream_folds
from ..streaming import tables as stored
from ..streaming import tracklets as cutter
from .registry import register


def scratch(spark) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def drained(spark, rows, part, end, start, parts=3):
    """Feed ``rows`` to a stream in ``parts`` instalments, the last with the message ``end``, each run to the end on the same
    checkpoint: what ``start(stream, where, state)`` returns is awaited. Gives the folder ``where``."""
    where = scratch(spark)
    for i in range(parts):
        piece = rows.where(part == i)
        if i == parts - 1 and end is not None:
            piece = piece.unionByName(end)
        piece.write.mode("append").parquet(f"{where}/in")
        start(frames.frame_stream(spark, f"{where}/in", schema=rows.schema), f"{where}/out", f"{where}/state").awaitTermination()
    return where


def instalment(axis, event, late, last, parts=3):
    """Instalments by ``axis``, 0 to ``last``; every seventh ``event`` comes ``late`` behind its time."""
    seen = axis + F.when(F.col(event) % 7 == 0, late).otherwise(0)
    return F.least(F.floor(seen * parts / F.lit(last + 1)), F.lit(parts - 1))


FRAME_MS = 40
#: time of frame 0; a watermark starts at 0 and counts rows at that time as late
EPOCH_MS = 86_400_000


@register("stream_tracklets", """WITH RECURSIVE o AS (SELECT concat('dev', event_id % 4) AS device_id, user_id % 10 AS track_id, event_id AS frame_no FROM events),
rows_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY device_id, track_id ORDER BY frame_no) AS p FROM o),
nxt AS MATERIALIZED (SELECT r.device_id, r.track_id, r.frame_no, min(q.frame_no) AS follow FROM rows_ r LEFT JOIN (SELECT *, frame_no - lag(frame_no) OVER (PARTITION BY device_id, track_id ORDER BY frame_no) AS step FROM rows_) q
  ON q.device_id = r.device_id AND q.track_id = r.track_id AND q.p > r.p AND q.p <= r.p + 60
    AND (q.p = r.p + 60 OR q.step > 150 OR q.p >= r.p + 6 AND q.frame_no > r.frame_no + 90) GROUP BY ALL),
ch AS (SELECT device_id, track_id, min(frame_no) AS frame_no FROM o GROUP BY ALL
  UNION ALL SELECT n.device_id, n.track_id, n.follow FROM ch JOIN nxt n USING (device_id, track_id, frame_no) WHERE n.follow IS NOT NULL)
SELECT ch.device_id, ch.track_id, ch.frame_no AS frame_start, count(*) AS entry_count, max(o.frame_no) AS frame_end
FROM ch JOIN nxt n USING (device_id, track_id, frame_no) JOIN o ON o.device_id = ch.device_id AND o.track_id = ch.track_id AND o.frame_no >= ch.frame_no
  AND (n.follow IS NULL OR o.frame_no < n.follow)
GROUP BY ALL""")
def _(spark, sf):
    cutter.use_state_store(spark)
    e = d.table(spark, sf, "events")
    last = e.agg(F.max("event_id")).first()[0] or 0
    ms = F.lit(EPOCH_MS) + F.col("event_id") * FRAME_MS
    entries = e.select(
        F.concat(F.lit("dev"), F.col("event_id") % 4).alias("device_id"), (F.col("user_id") % 10).alias("track_id"), F.col("event_id").alias("frame_no"),
        (F.col("value") / 100).alias("v_score"), F.timestamp_millis(ms).alias("ts"), ms.alias("event_ms"))
    # an hour later a message of no track moves the watermark past all silences
    over = EPOCH_MS + last * FRAME_MS + 3_600_000
    end = spark.range(1).select(F.lit("end").alias("device_id"), F.lit(-1).cast("long").alias("track_id"), F.lit(-1).cast("long").alias("frame_no"),
                                F.lit(0.0).alias("v_score"), F.timestamp_millis(F.lit(over)).alias("ts"), F.lit(over).cast("long").alias("event_ms"))
    silence = (TRACKLETS.stale_frames + 1) * FRAME_MS
    where = drained(spark, entries, instalment(F.col("frame_no"), "frame_no", 30, last), end,
                    lambda s, out, state: frames.write_stream(cutter.cut_tracklets(s, silence), out, state))
    return spark.read.parquet(f"{where}/out").select("device_id", "track_id", "frame_start", "frame_end", "entry_count")


@register("stream_entity_upsert", """SELECT user_id AS entity_id, count(*) AS sighting_count, arg_max(concat('dev', event_id % 4), ts) AS last_seen_device FROM events GROUP BY 1""")
def _(spark, sf):
    e = d.table(spark, sf, "events").select(
        F.col("user_id").alias("entity_id"), F.concat(F.lit("dev"), F.col("event_id") % 4).alias("device_id"), F.col("event_id").alias("tracklet_id"),
        F.col("ts").cast("timestamp").alias("started_at"), F.col("ts").cast("timestamp").alias("ended_at"))
    held = f"{scratch(spark)}/entities"
    runs = []

    def start(stream, _, state):
        if len(runs) == 2:  # the first two batches are in the base, the third stays a delta
            stored.compact(spark, held, 1)
        runs.append(state)
        return stream.writeStream.foreachBatch(stored.entity_deltas(held)).option("checkpointLocation", state).trigger(availableNow=True).start()

    drained(spark, e, F.col("tracklet_id") * 5 % 3, None, start)
    return stored.current_entities(spark, held).select("entity_id", "sighting_count", "last_seen_device")


@register("stream_windowed_rates", """SELECT concat('dev', event_id % 4) AS device_id, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL""")
def _(spark, sf):
    e = d.table(spark, sf, "events").select("event_id", F.concat(F.lit("dev"), F.col("event_id") % 4).alias("device_id"), F.col("ts").cast("timestamp").alias("ts"))
    low, high = e.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    low, high = low or 0, high or 0
    # the last window stays open, so the closing message has one of its own
    end = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("device_id"), F.timestamp_seconds(F.lit(high + 3 * 86400)).alias("ts"))

    def start(stream, out, state):
        counts = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "device_id").count()
        return frames.write_stream(counts, out, state)

    where = drained(spark, e, instalment(F.unix_seconds("ts") - low, "event_id", 1800, high - low), end, start)
    return spark.read.parquet(f"{where}/out").select("device_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), F.col("count").alias("n"))


@register("stream_detection_sink", "SELECT concat('dev', l_orderkey % 4) AS key, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    raw = frames.frame_stream(spark, sf, schema=d.table(spark, sf, "lineitem").schema, glob="lineitem.parquet")
    one = raw.select(F.concat(F.lit("dev"), F.col("l_orderkey") % 4).alias("device_id"), F.floor(F.col("l_orderkey") / 4).alias("frame_number"),
                     F.col("l_quantity").alias("confidence"))
    where = scratch(spark)
    frames.write_stream(frames.keyed_messages(one), f"{where}/out", f"{where}/state").awaitTermination()
    return spark.read.parquet(f"{where}/out").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


CL = d.OBS + ", " + d.GAL + """, cb AS (SELECT frame_no AS box_id, device_id, frame_no // 4 AS frame_no, x1, y1, x2, y2, v_score, vec FROM obs
  LEFT JOIN gal ON point_id = obs.entity_id * 4 + (obs.frame_no // 4) % 8 WHERE v_score >= 0.35),
cp AS (SELECT a.box_id AS tail, b.box_id AS head, sqrt(((a.x1+a.x2)/2 - (b.x1+b.x2)/2)**2 + ((a.y1+a.y2)/2 - (b.y1+b.y2)/2)**2) / greatest(a.y2-a.y1, b.y2-b.y1, 1.0) AS c,
  b.frame_no - a.frame_no AS g, b.v_score < 0.55 OR coalesce(list_cosine_similarity(a.vec, b.vec) >= 0.62, true) AS alike
  FROM cb a JOIN cb b ON a.device_id = b.device_id AND b.frame_no - a.frame_no BETWEEN 1 AND 60),
cm AS (SELECT tail, head FROM (SELECT *, row_number() OVER (PARTITION BY tail ORDER BY c + g / 60, head) AS p, row_number() OVER (PARTITION BY head ORDER BY c + g / 60, tail) AS q
  FROM cp WHERE c <= 0.95 AND alike) WHERE p = 1 AND q = 1)"""


@register("untracked_clusters", f"""WITH RECURSIVE {CL}, ch AS (SELECT box_id, box_id AS root FROM cb WHERE box_id NOT IN (SELECT head FROM cm)
  UNION ALL SELECT m.head, ch.root FROM ch JOIN cm m ON m.tail = ch.box_id) SELECT root AS cluster_id, count(*) AS entries FROM ch GROUP BY 1""")
def _(spark, sf):
    # every other view is the next entity's, so that links of like and unlike vectors both occur
    frame = F.floor(F.col("frame_no") / 4)
    o = d.observations(spark, sf).where("v_score >= 0.35").withColumn("point_id", F.col("entity_id") * 4 + frame % 8)
    rows = o.join(d.gallery(spark, sf).select("point_id", "vec"), "point_id", "left").select(
        F.col("frame_no").alias("box_id"), "device_id", frame.alias("frame_no"), "x1", "y1", "x2", "y2", "v_score", "vec")
    return clusters.clustered(rows).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("entries"))


FR = d.OBS + ", " + d.GAL + """, cb AS (SELECT frame_no AS box_id, device_id, frame_no, x1, y1, x2, y2, v_score, vec, frame_no % 3 + 1 AS entry_count FROM obs
  JOIN gal ON point_id = obs.entity_id * 4 + obs.frame_no % 4),
cp AS (SELECT a.box_id AS tail, b.box_id AS head, sqrt(((a.x1+a.x2)/2 - (b.x1+b.x2)/2)**2 + ((a.y1+a.y2)/2 - (b.y1+b.y2)/2)**2) / greatest(a.y2-a.y1, b.y2-b.y1, 1.0) AS c,
  b.frame_no - a.frame_no AS g, b.v_score < 0.55 OR list_cosine_similarity(a.vec, b.vec) >= 0.62 AS alike
  FROM cb a JOIN cb b ON a.device_id = b.device_id AND b.frame_no - a.frame_no BETWEEN 1 AND 180),
cm AS (SELECT tail, head FROM (SELECT *, row_number() OVER (PARTITION BY tail ORDER BY c + g / 180, head) AS p, row_number() OVER (PARTITION BY head ORDER BY c + g / 180, tail) AS q
  FROM cp WHERE c <= 1.8 AND alike) WHERE p = 1 AND q = 1)"""


@register("fragment_recovery", f"""WITH RECURSIVE {FR}, ch AS (SELECT box_id, box_id AS root FROM cb WHERE box_id NOT IN (SELECT head FROM cm)
  UNION ALL SELECT m.head, ch.root FROM ch JOIN cm m ON m.tail = ch.box_id)
SELECT root AS cluster_id, count(*) AS fragments, sum(entry_count)::BIGINT AS entries FROM ch JOIN cb USING (box_id) GROUP BY 1 HAVING count(*) >= 2 AND sum(entry_count) >= 5""")
def _(spark, sf):
    o = d.observations(spark, sf).withColumn("point_id", F.col("entity_id") * 4 + F.col("frame_no") % 4)
    rows = o.join(d.gallery(spark, sf).select("point_id", "vec"), "point_id").select(
        F.col("frame_no").alias("box_id"), "device_id", "frame_no", "x1", "y1", "x2", "y2", "v_score", "vec", (F.col("frame_no") % 3 + 1).alias("entry_count"))
    return clusters.fragments(rows).select("cluster_id", "fragments", "entries")


def live_boxes(spark, sf):
    """Ten boxes a frame and device: twelve movers whose scores and ways vary, some of them twice in a frame."""
    e = d.table(spark, sf, "events")
    mover, frame = F.col("user_id") % 12, F.floor(F.col("event_id") / 40)
    x = (mover * 157) % 1500 + frame % 50 * (mover % 5 + 1) + F.col("event_id") % 3
    y = (mover * 83) % 700 + frame % 40 * (mover % 3)
    return e.select(
        F.concat(F.lit("dev"), F.col("event_id") % 4).alias("device_id"), frame.alias("frame_no"), F.col("event_id").alias("box_id"),
        (F.lit(0.35) + (F.col("event_id") * 7919) % 65 / 100).alias("score"), x.cast("double").alias("x1"), y.cast("double").alias("y1"),
        (x + 60).cast("double").alias("x2"), (y + 150).cast("double").alias("y2"))


LIVE = ("device_id", "event", "track_id", "box_id", "frame_no", "first_frame", "hits", "closed_by")


@register("live_tracks")
def _(spark, sf):
    return live.keep(live_boxes(spark, sf)).select(*LIVE)


def folded_stream(spark, rows, keeper, silence_frames, empty, late=2):
    """Rows of a fold, as a stream in three instalments with late rows; each device says that it ends."""
    cutter.use_state_store(spark)
    ms = (F.lit(EPOCH_MS) + F.col("frame_no") * FRAME_MS).cast("long")
    rows = rows.withColumn("event_ms", ms).withColumn("ts", F.timestamp_millis(ms))
    last = rows.agg(F.max("frame_no")).first()[0] or 0
    over = EPOCH_MS + last * FRAME_MS

    def message(device, at):
        held = {"device_id": F.lit(device), "frame_no": F.lit(folds.END_FRAME), "event_ms": F.lit(at), "ts": F.timestamp_millis(F.lit(at).cast("long")), "box_id": F.lit(-1)}
        return spark.range(1).select(*[held.get(f.name, F.lit(empty if f.dataType.typeName() in ("double", "long") else None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])

    # an hour later a message of no device moves the watermark past all of them
    end = message("none", over + 3_600_000)
    for k in range(4):
        end = end.unionByName(message(f"dev{k}", over + 1))
    where = drained(spark, rows, instalment(F.col("frame_no"), "box_id", late, last), end,
                    lambda s, out, state: frames.write_stream(stream_folds.fold(s, keeper, (silence_frames + 1) * FRAME_MS), out, state))
    return spark.read.parquet(f"{where}/out")


@register("stream_live_tracks")
def _(spark, sf):
    return folded_stream(spark, live_boxes(spark, sf), live.Keeper, tracks.BUFFER, 0).select(*LIVE)


def loose_boxes(spark, sf):
    """Boxes that no track took up, two or three a frame and device, with a vector for two thirds of them."""
    o = d.observations(spark, sf).where("v_score >= 0.35").withColumn("point_id", F.col("entity_id") * 4 + F.floor(F.col("frame_no") / 4) % 4)
    spot = F.col("entity_id") % 5 * 260 + F.col("frame_no") % 9 * 3
    return o.join(d.gallery(spark, sf).select("point_id", "vec"), "point_id", "left").select(
        "device_id", F.floor(F.col("frame_no") / 12).alias("frame_no"), F.col("frame_no").alias("box_id"), "v_score", (F.col("v_score") / 2 + 0.4).alias("confidence"),
        (F.col("overlap_ratio") / 4).alias("nearest_iou"), spot.cast("double").alias("x1"), (F.col("frame_no") % 7).cast("double").alias("y1"),
        (spot + 60).cast("double").alias("x2"), (F.col("frame_no") % 7 + 150).cast("double").alias("y2"), F.when(F.col("frame_no") % 3 > 0, F.col("vec")).alias("vec"))


CLUSTERED = ("device_id", "event", "cluster_id", "box_id", "frame_no", "first_frame", "entries", "v_avg", "v_max", "overall", "confidence_avg", "confidence_max", "iou_min", "iou_max", "tier")


@register("live_clusters")
def _(spark, sf):
    return folds.fold(loose_boxes(spark, sf), evidence.Clusters).select(*CLUSTERED)


@register("stream_live_clusters")
def _(spark, sf):
    return folded_stream(spark, loose_boxes(spark, sf), evidence.Clusters, CLUSTERS.flush_after, 0).select(*CLUSTERED)


@register("stream_clusters_resolved")
def _(spark, sf):
    """Clusters that the stream flushes: evidence for a known entity, a new one, or nothing."""
    events = folded_stream(spark, loose_boxes(spark, sf), evidence.Clusters, CLUSTERS.flush_after, 0)
    known = d.gallery(spark, sf).where("v <> 3 AND entity_id % 4 <> 0")
    return resolve.attach_or_mint(evidence.flushed_clusters(events), known).select("tracklet_id", "method", "entity_id")


def short_fragments(spark, sf):
    """Fragments of one to four boxes, of entities that come back at about the same place."""
    o = d.observations(spark, sf).withColumn("point_id", F.col("entity_id") * 4 + F.col("frame_no") % 4)
    spot = F.col("entity_id") % 7 * 180 + F.col("frame_no") % 5 * 4
    return o.join(d.gallery(spark, sf).select("point_id", "vec"), "point_id").select(
        "device_id", F.floor(F.col("frame_no") / 8).alias("frame_no"), F.col("frame_no").alias("box_id"), (F.col("frame_no") % 50).alias("track_id"),
        (F.floor(F.col("frame_no") / 8) + F.col("frame_no") % 3).alias("frame_end"), (F.col("frame_no") % 4 + 1).alias("entry_count"), (F.col("v_score") * 0.4 + 0.6).alias("v_avg"),
        spot.cast("double").alias("x1"), F.lit(0.0).alias("y1"), (spot + 60).cast("double").alias("x2"), F.lit(150.0).alias("y2"), "vec")


CHAINED = ("device_id", "event", "chain_id", "box_id", "frame_no", "first_frame", "fragments", "entries", "v_avg")


@register("short_fragments")
def _(spark, sf):
    return folds.fold(short_fragments(spark, sf), evidence.Fragments).select(*CHAINED)


@register("stream_short_fragments")
def _(spark, sf):
    return folded_stream(spark, short_fragments(spark, sf), evidence.Fragments, CLUSTERS.fragment_gap, 0).select(*CHAINED)


@register("fragments_resolved")
def _(spark, sf):
    """Promoted chains: new entities, or deferred beside the known one that they resemble."""
    promoted = folds.fold(short_fragments(spark, sf), evidence.Fragments).where("event = 'promoted'")
    known = d.gallery(spark, sf).where("v = 0 AND entity_id % 3 <> 0")
    return resolve.recovered(promoted, known).select("chain_id", "method", "suggested_id", F.round("score", 6).alias("score"))
