"""Clusters of detections no track took up, and of short track fragments.

A cluster grows from its last row, so it is a chain of best links: nearby in
time and place and, where both rows carry a vector, alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLUSTERS as C
from ..functions import geometry as g
from ..functions import vectors as v
from ..lineage import cut
from . import tracks


def _row(p: str) -> g.Box:
    return g.box(p)


def links(rows: DataFrame, max_gap: int = C.max_gap, max_centre: float = C.max_centre, min_similarity: float = C.min_similarity,
          vector_floor: float = C.similarity_min_v) -> DataFrame:
    """(tail, head) best links. Rows: box_id, device_id, frame_no, box, v_score, vec (may be null)."""
    cols = ["box_id", "frame_no", "x1", "y1", "x2", "y2", "v_score", "vec"]
    bucket = F.floor(F.col("frame_no") / max_gap)
    a = rows.select("device_id", *[F.col(c).alias(f"a_{c}") for c in cols], F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    b = rows.select("device_id", *[F.col(c).alias(f"b_{c}") for c in cols], bucket.alias("_b"))
    gap = F.col("b_frame_no") - F.col("a_frame_no")
    p, q = _row("a_"), _row("b_")
    centre = g.distance(g.centre(p), g.centre(q)) / F.greatest(g.height(p), g.height(q), F.lit(1.0))
    met = a.join(b, ["device_id", "_b"]).where((gap >= 1) & (gap <= max_gap) & (centre <= max_centre))
    tested = (F.col("b_v_score") >= vector_floor) & F.col("a_vec").isNotNull() & F.col("b_vec").isNotNull()
    alike = F.when(tested, v.cosine(F.col("a_vec"), F.col("b_vec")) >= min_similarity).otherwise(True)
    found = met.where(alike).select(F.col("a_box_id").alias("tail"), F.col("b_box_id").alias("head"),
                                    (centre + gap / max_gap).alias("cost"))
    found = cut(found)

    def best(end: str, other: str) -> DataFrame:
        return found.groupBy(end).agg(F.min_by(other, F.struct("cost", other)).alias(other))

    return best("tail", "head").join(best("head", "tail"), ["tail", "head"])


def clustered(rows: DataFrame, **limits) -> DataFrame:
    """Rows with the cluster they belong to."""
    found = links(rows, **limits)
    roots = tracks.roots(rows, found)
    return rows.join(roots.select(F.col("id").alias("box_id"), F.col("root").alias("cluster_id")), "box_id")


def fragments(rows: DataFrame, min_fragments: int = C.fragment_min, min_entries: int = C.fragment_entries) -> DataFrame:
    """Short fragments that together make an entity: their weighted vectors and size."""
    joined = clustered(rows, max_gap=C.fragment_gap, max_centre=C.fragment_centre, min_similarity=C.fragment_similarity)
    weight: Column = F.col("entry_count")
    cells = joined.select("cluster_id", weight.alias("w"), F.posexplode("vec").alias("pos", "x"))
    mean = cells.groupBy("cluster_id", "pos").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    vec = mean.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_c")).select(
        "cluster_id", v.l2_normalise(F.transform("_c", lambda c: c["x"])).alias("vec"))
    sizes = joined.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("fragments"), F.sum("entry_count").alias("entries"))
    return sizes.where((F.col("fragments") >= min_fragments) & (F.col("entries") >= min_entries)).join(vec, "cluster_id")


def statistics(entries: DataFrame, key: str = "cluster_id", confidence: str = "confidence", iou: str = "nearest_iou") -> DataFrame:
    """Mean and top confidence and the span of overlap with the nearest track, per cluster."""
    return entries.groupBy(key).agg(
        F.count(F.lit(1)).alias("entries"), F.avg(confidence).alias("confidence_avg"), F.max(confidence).alias("confidence_max"),
        F.min(iou).alias("iou_min"), F.max(iou).alias("iou_max"))
