"""Choosing frames: stride sampling, top-k frames, representative and preview frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLUSTERS, SAMPLING, TRACKLETS, Sampling, Tracklets
from ..functions import geometry as g
from ..lineage import cut
from . import ordered


def usable(scored: DataFrame, cfg: Sampling = SAMPLING) -> DataFrame:
    return scored.where(F.col("overlap_ratio") < cfg.drop_overlap)


def forced(cfg: Sampling = SAMPLING) -> Column:
    b = g.box()
    ratio = g.area_ratio(b, F.col("frame_w"), F.col("frame_h"))
    return g.force_send(F.col("confidence"), F.col("visibility_score"), F.col("overlap_ratio"),
                        F.col("subscores.cut_off"), ratio, cfg)


def forcible(cfg: Sampling = SAMPLING) -> Column:
    """What a forced box fulfils whatever covers it, as far as it is cheap to tell."""
    ratio = g.area_ratio(g.box(), F.col("frame_w"), F.col("frame_h"))
    return (F.col("confidence") >= cfg.force_confidence) & (ratio >= cfg.force_min_area)


def every_nth(frames: DataFrame, n: int, frame: str = "frame_no") -> DataFrame:
    return frames.where(F.col(frame) % n == 0)


def stride_sample(scored: DataFrame, cfg: Sampling = SAMPLING, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep each n-th sighting of a spatial key, n by visibility tag, plus forced rows.

    A key unseen for longer than ``stale_frames`` starts counting anew. Rows
    under the floor neither count nor refresh the key; forced rows do count. ``cols``: the columns that are wanted, if not all.
    """
    rows = usable(scored, cfg).withColumn("spatial_key", g.spatial_key(g.box(), F.col("frame_w"), F.col("frame_h")))
    rows = rows.withColumn("forced", forced(cfg)).where((F.col("visibility_score") >= cfg.floor) | F.col("forced"))
    if cols is not None:
        needed = {*cols, "device_id", "spatial_key", "frame_no", "det_id", "visibility_score", "visibility_tag", "forced"}
        rows = rows.select(*[c for c in rows.columns if c in needed])
    rows = cut(rows)  # read for the chunk summaries and for the rows; the overlap join runs once
    keys, order = ["device_id", "spatial_key"], ["frame_no", "det_id"]
    counted = rows.where(F.col("visibility_score") >= cfg.floor)
    placed = ordered.with_sessions(counted, keys, order, cfg.stale_frames, count="count_in_key")
    rate = F.lit(None).cast("int")
    for tag, n in cfg.rates.items():
        rate = F.when(F.col("visibility_tag") == tag, n).otherwise(rate)
    kept = placed.drop("session").where(F.col("forced") | (F.col("count_in_key") % rate == 0))
    if cfg.force_visibility >= cfg.floor:
        return kept
    under = rows.where((F.col("visibility_score") < cfg.floor) & F.col("forced"))
    return kept.unionByName(under.withColumn("count_in_key", F.lit(None).cast("long")))


# inside a tracklet: never more than ``max_entries`` rows ---------------------------------------


def selection_score(cfg: Tracklets = TRACKLETS) -> Column:
    return F.col("v_score") - F.col("overlap_ratio") * cfg.overlap_penalty


def spaced_top_k(entries: DataFrame, keys: Sequence[str] = ("tracklet_id",), frame: str = "frame_no",
                 cols: Sequence[str] = (), cfg: Tracklets = TRACKLETS) -> DataFrame:
    """Best frames first, skipping any within ``min_gap`` frames of a chosen one."""
    row = F.struct((-selection_score(cfg)).alias("s"), F.col(frame).alias("f"), *cols)
    ranked = entries.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))

    def take(acc: Column, r: Column) -> Column:
        close = F.exists(acc, lambda c: F.abs(c["f"] - r["f"]) < cfg.min_gap)
        return F.when((F.size(acc) < cfg.top_k) & ~close, F.concat(acc, F.array(r))).otherwise(acc)

    none = F.slice("_rows", 1, 0)
    return ranked.select(*keys, F.aggregate("_rows", none, take).alias("selected"))


def selected_frames(entries: DataFrame, cfg: Tracklets = TRACKLETS) -> DataFrame:
    """One row per selected frame with its rank."""
    top = spaced_top_k(entries, cfg=cfg)
    return top.select("tracklet_id", F.posexplode("selected").alias("rank", "s")).select(
        "tracklet_id", F.col("s.f").alias("frame_no"), (F.col("rank") + 1).alias("rank"))


def with_selected(entries: DataFrame, cfg: Tracklets = TRACKLETS) -> DataFrame:
    chosen = selected_frames(entries, cfg).select("tracklet_id", "frame_no", F.lit(True).alias("selected"))
    return entries.join(chosen, ["tracklet_id", "frame_no"], "left").withColumn(
        "selected", F.coalesce("selected", F.lit(False)))


def last_entries(entries: DataFrame, keys: Sequence[str], frame: str = "frame_no",
                 limit: int = TRACKLETS.max_entries) -> DataFrame:
    """Newest rows per key; the rank limit is applied before the shuffle as well."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(frame))
    return entries.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= limit).drop("_r")


def latest_frame(frames: DataFrame, key: str = "device_id", frame: str = "frame_no") -> DataFrame:
    rest = [c for c in frames.columns if c != key]
    return frames.groupBy(key).agg(F.max_by(F.struct(*rest), frame).alias("_row")).select(key, "_row.*")


def one_per_id(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*keys, "_row.*")


def representative_frame(entries: DataFrame, max_overlap: float = 0.35) -> DataFrame:
    """Clearest frame of a tracklet, a selected one if any is clean; none when all are crowded."""
    clean = entries.where(F.col("overlap_ratio") <= max_overlap)
    rank = F.struct(
        F.col("selected").cast("int").alias("a"), (F.col("v_score") - F.col("overlap_ratio") * 0.7).alias("b"),
        (-F.col("overlap_ratio")).alias("c"), F.col("frame_no").alias("d"))
    return clean.groupBy("tracklet_id").agg(F.max_by("frame_no", rank).alias("frame_no"))


def preview_frames(entries: DataFrame, limit: int = 4) -> DataFrame:
    """Best frames among those not selected."""
    best = Window.partitionBy("tracklet_id").orderBy(F.desc("v_score"), "overlap_ratio", "frame_no")
    ranked = entries.where(~F.col("selected")).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= limit)


def context_samples(entries: DataFrame, limit: int = 8) -> DataFrame:
    """Not-selected frames for review: with a crop first, then the most crowded, then the clearest."""
    order = Window.partitionBy("tracklet_id").orderBy(
        F.desc("has_crop"), F.desc(F.round("overlap_ratio", 3)), F.desc("v_score"), "frame_no")
    ranked = entries.where(~F.col("selected")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit)


def representative_tracklet(entries: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Per entity the tracklet that explains it best."""
    crops = entries.groupBy("tracklet_id").agg(
        F.bool_or(F.col("selected") & F.col("has_crop")).alias("_in"),
        F.bool_or(~F.col("selected") & F.col("has_crop")).alias("_out"))
    joined = tracklets.join(crops, "tracklet_id", "left")
    any_crop = F.coalesce("_in", F.lit(False)) | F.coalesce("_out", F.lit(False))
    tier = (
        F.when(F.coalesce("_in", F.lit(False)) & F.coalesce("_out", F.lit(False)), 0)
        .when(F.col("state") == "occlusion_attached", 1).when(any_crop, 2).otherwise(3))
    return joined.groupBy("entity_id").agg(
        F.min_by("tracklet_id", F.struct(tier.alias("t"), F.col("frame_start"), F.col("tracklet_id"))).alias("tracklet_id"))


def throttled(entries: DataFrame, keys: Sequence[str], order: Sequence[str],
              steps: Sequence[int] = CLUSTERS.persist_steps, span: int | None = ordered.SPAN) -> DataFrame:
    """Rows at which a growing cluster is written out."""
    return ordered.with_position(entries, keys, order, "entry_no", span).where(F.col("entry_no").isin(*steps))


def frame_samples(entries: DataFrame) -> DataFrame:
    """Evidence of a tracklet: one struct per frame with the selected flag."""
    sample = F.struct("frame_no", "v_score", "overlap_ratio", "selected")
    return entries.groupBy("tracklet_id").agg(F.array_sort(F.collect_list(sample)).alias("samples"))
