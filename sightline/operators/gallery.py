"""Keeping a gallery small and diverse, and moving points on a merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MATCHING
from ..functions import vectors as v
from ..lineage import cut


def prune(points: DataFrame, keys: tuple[str, ...] = ("entity_id", "kind"), keep: int = MATCHING.gallery_size) -> DataFrame:
    """At most ``keep`` points per key, the most diverse ones: the newest, then the point whose nearest kept one is furthest.

    ``point_id`` numeric, ``added_at`` a timestamp; the oldest wins ties. A round is one partial aggregate, whatever the size
    of a group; between rounds only the kept points travel, ``keep`` per key at most. Groups that fit pass untouched.
    """
    keys_ = list(keys)
    crowded = points.groupBy(*keys_).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > keep).select(*keys_)
    pool = cut(points.join(crowded, keys_, "left_semi").select(*keys_, "added_at", F.struct("point_id", v.l2_normalise(F.col("vec")).alias("unit")).alias("_p")))
    kept = cut(pool.groupBy(*keys_).agg(F.array(F.max_by("_p", F.struct("added_at", "_p.point_id"))).alias("_kept")))
    for _ in range(keep - 1):
        nearest = F.array_max(F.transform("_kept", lambda k: v.dot(k["unit"], F.col("_p.unit"))))
        open_ = ~F.array_contains(F.col("_kept.point_id"), F.col("_p.point_id"))
        rank = F.struct(F.round(1.0 - nearest, 9).alias("far"), (-F.unix_micros("added_at")).alias("age"), (-F.col("_p.point_id")).alias("id"))
        found = pool.join(kept, keys_).groupBy(*keys_).agg(F.max_by("_p", F.when(open_, rank)).alias("_next"))
        kept = cut(kept.join(found, keys_, "left").select(
            *keys_, F.when(F.col("_next").isNull(), F.col("_kept")).otherwise(F.concat("_kept", F.array("_next"))).alias("_kept")))
    chosen = kept.select(*keys_, F.explode("_kept.point_id").alias("point_id"))
    fits = points.join(crowded, keys_, "left_anti")
    return fits.select(points.columns).unionByName(points.join(chosen, [*keys_, "point_id"], "left_semi").select(points.columns))


def move_points(points: DataFrame, merges: DataFrame) -> DataFrame:
    """Points of merged entities go to the survivor and stop being anchors."""
    m = merges.select(F.col("source_id").alias("entity_id"), F.col("target_id").alias("_to"))
    moved = F.col("_to").isNotNull()
    return points.join(m, "entity_id", "left").select(
        *[F.when(moved, F.col("_to")).otherwise(F.col("entity_id")).alias("entity_id") if c == "entity_id"
          else (F.col("is_anchor") & ~moved).alias("is_anchor") if c == "is_anchor" else F.col(c)
          for c in points.columns])
