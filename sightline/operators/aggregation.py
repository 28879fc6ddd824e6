"""One vector per tracklet from the vectors of its selected frames.

Input groups hold the frames that selection left, a handful per tracklet, so a tracklet is one row with an array of frames
and all rules are expressions over that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DESCRIPTORS, TRACKLETS, Tracklets
from ..functions import vectors as v


def gathered(frames: DataFrame, key: str = "tracklet_id") -> DataFrame:
    """(key, rows): the frames of each key in order, with vectors and their directions."""
    row = F.struct("frame_no", F.col("v_score").alias("v"), F.col("overlap_ratio").alias("overlap"),
                   v.as_double(F.col("vec")).alias("vec"), v.l2_normalise(F.col("vec")).alias("unit"))
    return frames.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def agreeing(rows: Column, floor: float) -> Column:
    """The frames within ``floor`` of the frame that has most of them around it, then of the best quality, then the earliest."""
    around = F.transform(rows, lambda a, i: F.filter(rows, lambda b, j: (i == j) | (v.dot(a["unit"], b["unit"]) >= floor)))
    quality = lambda near: F.aggregate(near, F.lit(0.0), lambda total, r: total + r["v"])
    ranked = F.transform(around, lambda near, i: F.struct(
        F.round(F.size(near) * 10.0 + quality(near), 9).alias("support"), (-i).alias("early"), near.alias("near")))
    return F.array_max(ranked)["near"]


def direction(rows: Column, gamma: float) -> Column:
    """Unit vector along the sum of the vectors, each weighted by visibility less overlap."""
    zero = F.transform(F.get(rows, F.lit(0))["vec"], lambda x: F.lit(0.0))

    def plus(acc: Column, r: Column) -> Column:
        return v.let(r["v"] * (1.0 - gamma * r["overlap"]), lambda w: F.zip_with(acc, r["vec"], lambda a, x: a + w * x))

    return v.l2_normalise(F.aggregate(rows, zero, plus))


def tracklet_vectors(frames: DataFrame, key: str = "tracklet_id", consensus: float | None = TRACKLETS.consensus,
                     cfg: Tracklets = TRACKLETS) -> DataFrame:
    """(key, frames used, vec, consistency), from the agreeing frames unless ``consensus`` is None.

    Crowded frames count only if fewer than two clear ones exist; of three or more frames those unlike the mean are left out
    if two remain. Consistency is the length of the mean of all vectors, from 0 to 1.
    """
    groups = gathered(frames, key)
    if consensus is not None:
        groups = groups.select(key, agreeing(F.col("rows"), consensus).alias("rows"))
    clear = F.filter("rows", lambda r: r["overlap"] < cfg.max_overlap)
    groups = groups.withColumn("used", F.when(F.size(clear) >= 2, clear).otherwise(F.col("rows")))
    groups = groups.withColumn("first", direction(F.col("used"), cfg.gamma))
    alike = v.let(F.col("first"), lambda first: F.filter("used", lambda r: v.dot(r["vec"], first) >= cfg.outlier))
    groups = groups.withColumn("alike", alike)
    trimmed = (F.size("used") >= 3) & (F.size("alike") >= 2) & (F.size("alike") < F.size("used"))
    vec = F.when(trimmed, direction(F.col("alike"), cfg.gamma)).otherwise(F.col("first"))
    consistency = F.when(F.size("rows") < 2, 1.0).otherwise(F.least(F.lit(1.0), v.norm(v.mean_of(F.col("rows.vec")))))
    return groups.select(key, F.col("rows.frame_no").cast("array<long>").alias("frames"), vec.alias("vec"), consistency.alias("consistency"))


def descriptor(frames: DataFrame, keys: tuple[str, ...], vec: str = "vec", weight: str | None = None) -> DataFrame:
    """Element-wise mean per key, rescaled to [0, 1]. Elements are averaged as
    rows, so any number of frames per key is fine."""
    cells = frames.select(*keys, F.posexplode(vec).alias("pos", "x"))
    means = cells.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    whole = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_c"))
    return whole.select(*keys, v.min_max(F.transform("_c", lambda c: c["x"])).alias("descriptor"))


def clear_frames(frames: DataFrame) -> DataFrame:
    return frames.where((F.col("v_score") >= DESCRIPTORS.min_visibility)
                        & (F.col("overlap_ratio") <= DESCRIPTORS.max_overlap))


def descriptor_conflicts(a: DataFrame, b: DataFrame, on: list[str], floor: float = DESCRIPTORS.conflict_below) -> DataFrame:
    """Rows of two descriptor tables meeting on a shared device whose descriptors disagree."""
    met = a.withColumnRenamed("descriptor", "_a").join(b.withColumnRenamed("descriptor", "_b"), on)
    return met.withColumn("similarity", v.correlation(F.col("_a"), F.col("_b"))).where(
        F.col("similarity") < floor).drop("_a", "_b")
