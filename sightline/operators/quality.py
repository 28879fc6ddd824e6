"""Quality of tracklets: stability, motion, good-frame runs, readiness.

Rows are tracklet entries: tracklet_id, frame_no, box, v_score, overlap_ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLUSTERS, DESCRIPTORS, STATIC, TRACKLETS, Static, Tracklets
from ..functions import geometry as g
from . import ordered

KEY = "tracklet_id"
AXIS = "frame_no"
BOX = ["x1", "y1", "x2", "y2"]


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def consistency_from(size_delta: Column, move: Column, good_ratio: Column) -> dict[str, Column]:
    size = _clamp(F.lit(1.0) - F.coalesce(size_delta, F.lit(0.0)))
    position = _clamp(F.lit(1.0) - F.coalesce(move, F.lit(0.0)) / 0.5)
    return {
        "size_stability": F.round(size, 4), "position_stability": F.round(position, 4),
        "good_ratio": F.round(good_ratio, 4),
        "overall": F.round(size * 0.35 + position * 0.35 + good_ratio * 0.30, 4),
    }


def summary(entries: DataFrame, cfg: Tracklets = TRACKLETS) -> DataFrame:
    """Consistency and motion of every tracklet from one ordered pass."""
    rows = ordered.with_previous(entries, [KEY], [AXIS], BOX, span=None)
    now, before = g.box(), g.box("prev1.")
    has = F.col("prev1").isNotNull()

    def solid(b: g.Box) -> Column:
        return F.greatest(g.area(b), F.lit(1.0))

    w, h = F.greatest(g.width(now), F.lit(1.0)), F.greatest(g.height(now), F.lit(1.0))
    rows = rows.select(
        KEY, AXIS, *BOX, "v_score", "overlap_ratio", "frame_w", "frame_h", w.alias("_w"), h.alias("_h"),
        F.when(has, F.abs(solid(now) - solid(before)) / solid(before)).alias("_size"),
        F.when(has, g.distance(g.centre(now), g.centre(before)) / g.size(now)).alias("_move"),
        F.when(has, g.distance(g.centre(now), g.centre(before))).alias("_step"),
    )
    framed = (F.col("frame_w") > 0) & (F.col("frame_h") > 0)
    touching = framed & g.touches_edge(now, F.col("frame_w"), F.col("frame_h"))
    first, last = F.min_by(F.struct(*BOX), AXIS), F.max_by(F.struct(*BOX), AXIS)
    per = rows.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("entry_count"), F.min(AXIS).alias("frame_start"), F.max(AXIS).alias("frame_end"),
        F.avg("v_score").alias("v_avg"), F.max("v_score").alias("v_max"), F.max("overlap_ratio").alias("max_overlap"),
        F.count_if(F.col("v_score") >= cfg.quality_frame).alias("quality_frames"),
        F.avg("_size").alias("_size"), F.avg("_move").alias("_move"),
        (F.count_if(F.col("v_score") >= cfg.good_frame) / F.count(F.lit(1))).alias("_good"),
        F.avg("_w").alias("_mw"), F.avg("_h").alias("_mh"), F.median("_h").alias("_norm"),
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("_path"),
        F.coalesce(F.count_if(touching) / F.nullif(F.count_if(framed), F.lit(0)), F.lit(0.0)).alias("_edge"),
        first.alias("first_box"), last.alias("last_box"),
    )
    norm = F.greatest("_norm", F.lit(1.0))
    ends = g.distance(g.centre(g.box("first_box.")), g.centre(g.box("last_box.")))
    scores = consistency_from(F.col("_size"), F.col("_move"), F.col("_good"))
    return per.select(
        KEY, "entry_count", "frame_start", "frame_end", "v_avg", "v_max", "max_overlap", "quality_frames", "first_box",
        "last_box", *[c.alias(n) for n, c in scores.items()],
        F.round("_mw", 4).alias("mean_width"), F.round("_mh", 4).alias("mean_height"),
        F.round(F.col("_path") / norm, 4).alias("path_ratio"), F.round(ends / norm, 4).alias("endpoint_ratio"),
        F.round("_edge", 4).alias("boundary_ratio"),
    )


def ready(s: DataFrame, cfg: Tracklets = TRACKLETS) -> DataFrame:
    return s.where((F.col("entry_count") >= cfg.min_entries) & (F.col("quality_frames") >= cfg.min_quality_frames))


def consistent(s: DataFrame, cfg: Tracklets = TRACKLETS) -> DataFrame:
    return s.where(F.col("overall") >= cfg.min_consistency)


def coherent(s: DataFrame, floor: float = 0.55) -> DataFrame:
    """A tracklet without an entity needs vectors that agree with each other."""
    return s.where(F.col("current_entity_id").isNotNull() | (F.col("vector_consistency") >= floor))


def static_artifact(cfg: Static = STATIC) -> Column:
    """A small thing that does not move and does not touch the frame edge."""
    small = (F.col("mean_width") <= cfg.max_width) & (F.col("mean_height") <= cfg.max_height)
    still = (F.col("path_ratio") <= cfg.max_path) & (F.col("endpoint_ratio") <= cfg.max_endpoint)
    stable = (F.col("size_stability") >= cfg.min_size_stability) & (
        F.col("position_stability") >= cfg.min_position_stability)
    return (
        (F.col("entry_count") >= cfg.min_entries) & (F.col("boundary_ratio") < cfg.boundary_skip) & small
        & (still | stable)
    )


def longest_good_run(entries: DataFrame, floor: float = TRACKLETS.good_frame) -> DataFrame:
    """Longest run of consecutive good frames: bad frames so far number the runs."""
    good = F.col("v_score") >= floor
    runs = ordered.with_running(entries.select(KEY, AXIS, "v_score"), [KEY], [AXIS],
                                sums={"_bad": F.when(good, 0).otherwise(1)}, span=None)
    lengths = runs.groupBy(KEY, "_bad").agg(F.count_if(good).alias("_n"))
    return lengths.groupBy(KEY).agg(F.max("_n").alias("good_run"))


def pretrack_static(entries: DataFrame, keys: list[str], cfg: Static = STATIC) -> DataFrame:
    """Boxes whose last few predecessors on the track stayed small and in place."""
    n = cfg.pretrack_frames
    rows = ordered.with_previous(entries, keys, [AXIS], BOX, depth=n)
    history = F.array(*[F.col(f"prev{i}") for i in range(n, 0, -1)])
    anchor = g.centre(g.box(f"prev{n}."))

    def drift(b: Column) -> Column:
        return g.distance(((b["x1"] + b["x2"]) / 2.0, (b["y1"] + b["y2"]) / 2.0), anchor)

    held = (
        F.col(f"prev{n}").isNotNull()
        & ~g.touches_edge(g.box(), F.col("frame_w"), F.col("frame_h"))
        & ~F.exists(history, lambda b: (b["x2"] - b["x1"] > cfg.max_width) | (b["y2"] - b["y1"] > cfg.max_height))
        & ~F.exists(history, lambda b: drift(b) > cfg.pretrack_drift)
    )
    return rows.withColumn("is_static", F.coalesce(held, F.lit(False))).drop(*[f"prev{i}" for i in range(1, n + 1)])


def motion_extent(tracklets: DataFrame) -> DataFrame:
    """Spread of the centres and mean size over first and last boxes of an entity."""
    ends = tracklets.select("entity_id", KEY, F.explode(F.array("first_box", "last_box")).alias("b"))
    cx, cy = g.centre(g.box("b."))
    return ends.groupBy("entity_id").agg(
        (F.max(cx) - F.min(cx)).alias("spread_x"), (F.max(cy) - F.min(cy)).alias("spread_y"),
        F.avg(F.abs(F.col("b.x2") - F.col("b.x1"))).alias("mean_width"),
        F.avg(F.abs(F.col("b.y2") - F.col("b.y1"))).alias("mean_height"),
        (F.count(F.lit(1)) / 2).cast("long").alias("tracklet_count"), F.count("b").alias("point_count"),
    )


def static_entities(tracklets: DataFrame, cfg: Static = STATIC) -> DataFrame:
    m = motion_extent(tracklets)
    w, h = F.greatest("mean_width", F.lit(1.0)), F.greatest("mean_height", F.lit(1.0))
    small = (
        (F.col("tracklet_count") >= cfg.min_tracklets) & (w <= cfg.max_width) & (h <= cfg.max_height)
        & (F.col("spread_x") <= w * cfg.spread_ratio) & (F.col("spread_y") <= h * cfg.spread_ratio)
    )
    still = (
        (F.col("tracklet_count") >= cfg.zero_motion_tracklets)
        & (F.col("spread_x") <= cfg.zero_motion_x) & (F.col("spread_y") <= cfg.zero_motion_y)
    )
    return m.where(small | still).withColumn("branch", F.when(still, "zero_motion").otherwise("small_static"))


def clean_frames(entries: DataFrame) -> DataFrame:
    """Tracklets with enough clear frames for a descriptor, and how many."""
    clear = (F.col("v_score") >= DESCRIPTORS.min_visibility) & (F.col("overlap_ratio") <= DESCRIPTORS.max_overlap)
    return entries.where(clear).groupBy(KEY).agg(F.count(F.lit(1)).alias("clean_frames")).where(
        F.col("clean_frames") >= DESCRIPTORS.min_frames)


def admitted_candidates(s: DataFrame) -> DataFrame:
    """Evidence candidates: enough rows, one fairly clear, one per track (the earliest)."""
    fit = s.where((F.col("entry_count") >= CLUSTERS.candidate_entries) & (F.col("v_max") >= CLUSTERS.candidate_v))
    rest = [c for c in fit.columns if c != "track_key"]
    return fit.groupBy("track_key").agg(
        F.min_by(F.struct(*rest), F.struct("frame_start", KEY)).alias("_row")).select("track_key", "_row.*")


def canonical(tracklets: DataFrame) -> DataFrame:
    """Evidence allowed to anchor identities."""
    return tracklets.where((F.col("state") != "occlusion_attached") & ~F.coalesce("provisional", F.lit(False)))


def fresh(s: DataFrame, now_us: Column | None = None, max_lag_s: float = 30.0, ts: str = "ended_at") -> DataFrame:
    """Newest entry within ``max_lag_s`` of a clock; by default the newest row of all."""
    at = F.unix_micros(ts)
    clock = s.agg(F.max(at)).scalar() if now_us is None else now_us
    return s.where(clock - at <= int(max_lag_s * 1e6))


def promotion_tier() -> Column:
    """Which evidence tier lets an untracked cluster become a tracklet."""
    c = CLUSTERS
    slow = (F.col("entry_count") >= c.promote_entries) & (F.col("v_max") >= c.promote_v)
    fast = (F.col("entry_count") >= c.fast_entries) & (F.col("v_max") >= c.fast_v) & (F.col("overall") >= c.fast_overall)
    return F.when(slow, "slow").when(fast, "fast")


def identity_cap(rows: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """``rows`` with the number of known entities and whether no further one may be made."""
    n = known.agg(F.countDistinct("entity_id")).scalar()
    return rows.withColumn("known", n).withColumn("cap_reached", F.col("known") >= cap)
