"""Engine tables derived from the generic test tables.

Each view is written once as SQL that Spark and an ANSI database both run, so
that both sides of a comparison start from the same rows. ``@`` marks the table
or fan-out spelling that differs between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TRACKLETS
from ..functions import labels as lb
from ..operators import ordered

HARD = "kind"
TASKS = (HARD, "carried", "headwear", "lower", "upper", "eyewear")
TRACKLET_GAP = 1500
SPLIT_OFFSET = 100000

DETECTIONS = """
SELECT concat('dev', CAST(l_orderkey % 4 AS STRING)) AS device_id,
       CAST(floor(l_orderkey / 4.0) AS BIGINT) AS frame_no,
       concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
                 CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS det_id,
       CAST((l_partkey * 37 + l_linenumber * 11) % 1500 AS DOUBLE) AS x1,
       CAST((l_suppkey * 53) % 600 AS DOUBLE) AS y1,
       CAST((l_partkey * 37 + l_linenumber * 11) % 1500 + 40 + l_quantity * 4 AS DOUBLE) AS x2,
       CAST((l_suppkey * 53) % 600 + 80 + l_quantity * 8 AS DOUBLE) AS y2,
       CAST(0.30 + l_discount * 6 AS DOUBLE) AS confidence,
       CAST(l_linenumber % 3 AS INT) AS class_id, 1920 AS frame_w, 1080 AS frame_h,
       (CAST(floor(l_orderkey / 4.0) AS BIGINT) * 33333333) AS created_at_ns
FROM lineitem"""

OBSERVATIONS = """
SELECT user_id AS entity_id, user_id AS track_id, concat('dev', CAST(event_id % 4 AS STRING)) AS device_id,
       event_id AS frame_no, CAST(ts AS TIMESTAMP) AS ts,
       CAST((user_id * 97) % 1500 + (event_id % 40) * 6 AS DOUBLE) AS x1,
       CAST((user_id * 31) % 500 AS DOUBLE) AS y1,
       CAST((user_id * 97) % 1500 + (event_id % 40) * 6 + 60 + event_id % 5 AS DOUBLE) AS x2,
       CAST((user_id * 31) % 500 + 150 + event_id % 7 AS DOUBLE) AS y2,
       CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS v_score,
       CAST((event_id * 104729) % 1000 AS DOUBLE) / 2000.0 AS overlap_ratio,
       event_type, 1920 AS frame_w, 1080 AS frame_h
FROM events"""

VOTES = """
SELECT user_id AS entity_id, concat('dev', CAST(event_id % 4 AS STRING)) AS device_id, event_id AS frame_no,
       CAST(ts AS TIMESTAMP) AS ts,
       CASE j WHEN 0 THEN 'kind' WHEN 1 THEN 'carried' WHEN 2 THEN 'headwear' WHEN 3 THEN 'lower'
              WHEN 4 THEN 'upper' ELSE 'eyewear' END AS task,
       CASE WHEN event_id % 11 = j THEN 'unknown'
            WHEN (user_id * (j + 3) + j + (CASE WHEN event_id % 7 = j THEN 1 ELSE 0 END)) % 2 = 0 THEN 'a'
            ELSE 'b' END AS label,
       0.62 + CAST((user_id * 13 + j * 5) % 30 AS DOUBLE) / 100.0
            + CAST((event_id * (j * 2 + 7919)) % 80 AS DOUBLE) / 1000.0
            + CAST((event_id * 31 + j) % 97 AS DOUBLE) / 1000003.0 AS confidence
FROM @votes"""

GALLERY = """
SELECT e.vec_id * 4 + v AS point_id, e.vec_id AS entity_id, v, v = 0 AS is_anchor, @vec AS vec
FROM @views"""

SPARK = {
    "@votes": "{events} LATERAL VIEW explode(sequence(0, 5)) t AS j",
    "@views": "{embeddings} e LATERAL VIEW explode(array(0L, 1L, 2L, 3L)) t AS v",
    "@vec": "transform(sequence(1, size(e.embedding)), i -> CAST(e.embedding[i-1] AS DOUBLE)"
            " + (((i*(v+3)+e.vec_id) % 7) - 3) * 0.02D)",
}
DUCK = {
    "@votes": "events, range(0, 6) t(j)",
    "@views": "embeddings e, range(0, 4) t(v)",
    "@vec": "list_transform(range(1, len(e.embedding)+1), lambda i: e.embedding[i]::double"
            " + (((i*(v+3)+e.vec_id) % 7) - 3) * 0.02::double)",
}


def duck(sql: str) -> str:
    for mark, text in DUCK.items():
        sql = sql.replace(mark, text)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    for mark, text in SPARK.items():
        sql = sql.replace(mark, text)
    sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **{name: table(spark, sf_dir, name)})


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, DETECTIONS, "lineitem")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, OBSERVATIONS, "events")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, VOTES, "events")


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, GALLERY, "embeddings")


def split_id(entity: str, odd: str) -> str:
    """Known duplicates: some rows of every third of the entities get a second id."""
    return f"CASE WHEN {entity} % 10 IN (0, 3, 7) AND {odd} THEN {entity} + {SPLIT_OFFSET} ELSE {entity} END"


def split_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gallery(spark, sf_dir).withColumn("entity_id", F.expr(split_id("entity_id", "v >= 2")))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select(
        F.col("frame_no").alias("tracklet_id"), "entity_id", "device_id", F.col("ts").alias("started_at"),
        (F.col("ts") + F.expr("INTERVAL 5 SECONDS")).alias("ended_at"),
        F.lit(5.0).alias("duration_seconds"), (F.col("frame_no") % 9 + 1).alias("entry_count"),
        F.col("v_score").alias("quality_score"), "event_type",
    )


def tracklet_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the tracklet they belong to: runs of one track on one
    device, cut at long gaps and after every ``max_entries`` rows."""
    cut = ordered.with_sessions(
        observations(spark, sf_dir), ["entity_id", "device_id"], ["frame_no"], TRACKLET_GAP, count="nth")
    part = F.floor((F.col("nth") - 1) / TRACKLETS.max_entries)
    return cut.withColumn("part", part).drop("nth").withColumn(
        "tracklet_id", F.concat_ws(":", "device_id", "track_id", "session", "part"))


def box_struct() -> F.Column:
    return F.struct("x1", "y1", "x2", "y2")


def tracklets(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    rows = tracklet_entries(spark, sf_dir).groupBy(
        "tracklet_id", "track_id", "entity_id", "device_id", "session"
    ).agg(
        F.min("frame_no").alias("frame_start"), F.max("frame_no").alias("frame_end"),
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
        F.count(F.lit(1)).alias("entry_count"),
        F.min_by(box_struct(), "frame_no").alias("first_box"), F.max_by(box_struct(), "frame_no").alias("last_box"),
        F.avg("v_score").alias("v_avg"), F.max("overlap_ratio").alias("max_overlap"),
    )
    rows = rows.withColumn("state", F.when(F.col("frame_start") % 13 == 0, "occlusion_attached").otherwise("matched"))
    if split:
        rows = rows.withColumn("entity_id", F.expr(split_id("entity_id", "session % 2 = 1")))
    return rows


# the same tables for the comparison database ----------------------------------------

DET = f"det AS ({duck(DETECTIONS)})"
OBS = f"obs AS ({duck(OBSERVATIONS)})"
VOTE = f"votes AS ({duck(VOTES)})"
GAL = f"gal AS ({duck(GALLERY)})"
SPLIT_GAL = GAL + f""", sgal AS (
  SELECT point_id, {split_id('entity_id', 'v >= 2')} AS entity_id, v, is_anchor, vec FROM gal)"""
SIGHT = OBS + """, sight AS (
  SELECT frame_no AS tracklet_id, entity_id, device_id, ts AS started_at, ts + INTERVAL 5 SECOND AS ended_at,
         5.0::DOUBLE AS duration_seconds, frame_no % 9 + 1 AS entry_count, v_score AS quality_score, event_type
  FROM obs)"""
ENTRIES = OBS + f""", flagged AS (
  SELECT *, CASE WHEN frame_no - lag(frame_no) OVER w <= {TRACKLET_GAP} THEN 0 ELSE 1 END AS starts
  FROM obs WINDOW w AS (PARTITION BY entity_id, device_id ORDER BY frame_no)),
entries AS (
  SELECT *, concat_ws(':', device_id, track_id::VARCHAR, session::VARCHAR, part::VARCHAR) AS tracklet_id FROM (
    SELECT *, (row_number() OVER (PARTITION BY entity_id, device_id, session ORDER BY frame_no) - 1)
      // {TRACKLETS.max_entries} AS part FROM (
    SELECT * EXCLUDE (starts), sum(starts) OVER (PARTITION BY entity_id, device_id ORDER BY frame_no) AS session
    FROM flagged)))"""
_TRACKLETS = """ AS (
  SELECT *, CASE WHEN frame_start % 13 = 0 THEN 'occlusion_attached' ELSE 'matched' END AS state FROM (
  SELECT tracklet_id, track_id, {id} AS entity_id, device_id, session::BIGINT AS session,
         min(frame_no) AS frame_start, max(frame_no) AS frame_end, min(ts) AS started_at, max(ts) AS ended_at,
         count(*) AS entry_count, avg(v_score) AS v_avg, max(overlap_ratio) AS max_overlap,
         arg_min(x1, frame_no) AS fx1, arg_min(y1, frame_no) AS fy1, arg_min(x2, frame_no) AS fx2,
         arg_min(y2, frame_no) AS fy2, arg_max(x1, frame_no) AS lx1, arg_max(y1, frame_no) AS ly1,
         arg_max(x2, frame_no) AS lx2, arg_max(y2, frame_no) AS ly2
  FROM entries GROUP BY tracklet_id, track_id, entries.entity_id, device_id, session))"""
TRK = ENTRIES + ", trk" + _TRACKLETS.replace("{id}", "entries.entity_id")
SPLIT_TRK = ENTRIES + ", trk" + _TRACKLETS.replace("{id}", split_id("entries.entity_id", "session % 2 = 1"))


def label_maps(voted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of (keys, task, label, confidence) to one label map per key; one entry per task."""
    return voted.groupBy(*keys).agg(lb.to_map(F.collect_list(F.struct("task", "label", "confidence"))).alias("labels"))
