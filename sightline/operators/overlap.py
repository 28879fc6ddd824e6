"""Joins of boxes that meet inside one frame.

Every box is spread over the grid cells it covers and joined cell by cell, so
the work follows the number of boxes that really meet, not the square of the
boxes in a frame, and a crowded frame is shared by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..lineage import cut

CELL = 512
#: boxes in a cell from which on it is cut into cells of FINE pixels
CROWD, FINE = 48, 64
#: boxes in a frame up to which all of them meet, without cells
FEW = 24
FRAME = ("device_id", "frame_no")


def _span(low: str, high: str, cell: int) -> Column:
    first, last = F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)
    return F.explode(F.sequence(first, F.greatest(first, last)))


def in_cells(boxes: DataFrame, cell: int = CELL) -> DataFrame:
    return boxes.withColumn("_cx", _span("x1", "x2", cell)).withColumn("_cy", _span("y1", "y2", cell))


def meeting_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str] = FRAME, cell: int = CELL) -> DataFrame:
    """All pairs with a common area, once each: columns prefixed ``l_`` and ``r_``.

    A pair is produced only in the cell that holds the upper left corner of the
    common area, so no duplicate elimination is needed.
    """
    l = in_cells(left, cell).select([F.col(c).alias(f"l_{c}") for c in left.columns + ["_cx", "_cy"]])
    r = in_cells(right, cell).select([F.col(c).alias(f"r_{c}") for c in right.columns + ["_cx", "_cy"]])
    a, b = g.box("l_"), g.box("r_")
    same_cell = (F.col("l__cx") == F.col("r__cx")) & (F.col("l__cy") == F.col("r__cy"))
    for k in keys:
        same_cell = same_cell & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    left_edge, top_edge = F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1)
    meets = (F.least(a.x2, b.x2) > left_edge) & (F.least(a.y2, b.y2) > top_edge)
    owner = (F.floor(left_edge / cell) == F.col("l__cx")) & (F.floor(top_edge / cell) == F.col("l__cy"))
    return l.join(r, same_cell & meets & owner).drop("l__cx", "l__cy", "r__cx", "r__cy")


def union_area(rects: Column) -> Column:
    """Area covered by an array of rectangles: slabs between x edges, merged y runs in each."""
    edges = F.array_sort(F.array_distinct(F.concat(
        F.transform(rects, lambda r: r["x1"]), F.transform(rects, lambda r: r["x2"]))))
    slabs = F.arrays_zip(
        F.slice(edges, 1, F.size(edges) - 1).alias("lo"), F.slice(edges, 2, F.size(edges) - 1).alias("hi"))

    def covered(slab: Column) -> Column:
        runs = F.array_sort(F.transform(
            F.filter(rects, lambda r: (r["x1"] < slab["hi"]) & (r["x2"] > slab["lo"])),
            lambda r: F.struct(r["y1"].alias("y1"), r["y2"].alias("y2"))))
        start = F.struct(F.lit(0.0).alias("total"), F.lit(float("-inf")).alias("reach"))
        swept = F.aggregate(runs, start, lambda acc, run: F.struct(
            (acc["total"] + F.greatest(F.lit(0.0), run["y2"] - F.greatest(run["y1"], acc["reach"]))).alias("total"),
            F.greatest(acc["reach"], run["y2"]).alias("reach")))
        return swept["total"]

    p, q = (g.Box(*[F.get(rects, F.lit(i))[c] for c in ("x1", "y1", "x2", "y2")]) for i in (0, 1))
    many = F.aggregate(slabs, F.lit(0.0), lambda acc, s: acc + covered(s) * (s["hi"] - s["lo"]))
    # one or two rectangles are the common case and need no sweep
    return F.when(F.size(rects) == 1, g.area(p)).when(
        F.size(rects) == 2, g.area(p) + g.area(q) - g.intersection(p, q)).otherwise(many)


def covered_area(boxes: DataFrame, key: str = "det_id", keys: Sequence[str] = FRAME, cell: int = CELL, asked: Column | None = None) -> DataFrame:
    """Per box the area that other boxes of its frame cover. Boxes that do not fulfil ``asked`` cover others, but need not have a row.

    In a frame of few boxes all meet, so a box is a row once. In larger ones the union is taken cell by cell and summed, so one list never
    holds more rectangles than meet the box inside one cell. Cells are counted
    first: crowded ones are cut into small ones, whose boxes are counted on a grid. Boxes equal within a pixel count as the same box.
    """
    corners = ["x1", "y1", "x2", "y2"]
    placed = boxes.where("x1 IS NOT NULL AND y1 IS NOT NULL").select(
        key, *keys, *corners, F.coalesce(F.lit(True) if asked is None else asked, F.lit(False)).alias("_asked"))
    # a box without an end is in its first cell only
    frames = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.expr("x2 IS NULL OR y2 IS NULL")).alias("_endless"))
    large = cut(frames.where((F.col("_n") > FEW) | (F.col("_endless") > 0)).select(*keys))
    if large.isEmpty():
        return _parts(placed, key, list(keys)).groupBy(key).agg(F.sum("part").alias("covered"))
    few = _parts(placed.join(large, list(keys), "left_anti"), key, list(keys))
    on = [*keys, "_cx", "_cy"]

    spread = in_cells(placed.join(large, list(keys), "left_semi"), cell)
    full = cut(spread.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD).select(*on))
    any_full = not full.isEmpty()
    all_cells = spread
    if any_full:
        spread = all_cells.join(full, on, "left_anti")
    parts = few.unionByName(_parts(spread, key, on, cell))
    if not any_full:
        return parts.groupBy(key).agg(F.sum("part").alias("covered"))

    box = F.struct(F.col(key).alias("key"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    low, high = (lambda c: F.floor(F.greatest(F.col(f"_b.{c}1"), F.col(f"_c{c}") * cell) / FINE)), (lambda c: F.ceil(F.least(F.col(f"_b.{c}2"), (F.col(f"_c{c}") + 1) * cell) / FINE) - 1)
    fine = all_cells.join(full, on, "left_semi").select(*on, box.alias("_b"))
    for c in "xy":
        fine = fine.withColumn(f"_f{c}", F.explode(F.when(high(c) >= low(c), F.sequence(low(c), high(c)))))
    fine = fine.groupBy(*keys, "_fx", "_fy").agg(F.collect_list("_b").alias("_boxes")).where(F.size("_boxes") > 1).select("_fx", "_fy", "_boxes")
    kind = boxes.schema[key].dataType.simpleString()
    dense = fine.mapInArrow(_on_grid, f"key {kind}, part double").withColumnRenamed("key", key)
    return parts.unionByName(dense).groupBy(key).agg(F.sum("part").alias("covered"))


def _parts(rows: DataFrame, key: str, on: list[str], cell: int | None = None) -> DataFrame:
    """Per box the area that other boxes with the same ``on`` cover, of their cell if there is one."""
    corners = ("x1", "y1", "x2", "y2")
    l = rows.where("_asked").select(*on, key, *[F.col(c).cast("double").alias(f"a_{c}") for c in corners])
    r = rows.select(*on, *[F.col(c).cast("double").alias(f"b_{c}") for c in corners])
    a, b = g.box("a_"), g.box("b_")
    low, high = [F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1)], [F.least(a.x2, b.x2), F.least(a.y2, b.y2)]
    if cell is not None:
        low = [F.greatest(v, F.col(c) * cell) for v, c in zip(low, ("_cx", "_cy"))]
        high = [F.least(v, (F.col(c) + 1) * cell) for v, c in zip(high, ("_cx", "_cy"))]
    rect = F.struct(low[0].alias("x1"), low[1].alias("y1"), high[0].alias("x2"), high[1].alias("y2"))
    pieces = (
        l.join(r, on).where(~g.same_box(a, b)).withColumn("_rect", rect)
        .where("_rect.x2 > _rect.x1 AND _rect.y2 > _rect.y1")
        # the join already placed all rows of a cell or frame together, so this grouping moves nothing
        .groupBy(*on, key).agg(F.collect_set("_rect").alias("_rects"))
    )
    return pieces.select(key, union_area(F.col("_rects")).alias("part"))


def _on_grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered area of each box of a small cell. The edges of all boxes cut the cell into a grid, on which boxes are counted; what
    more boxes than the same ones cover of a box is summed."""
    for batch in batches:
        for at in range(batch.num_rows):
            held = batch.column("_boxes")[at].values
            x, y = batch.column("_fx")[at].as_py() * FINE, batch.column("_fy")[at].as_py() * FINE
            raw = np.stack([held.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")], axis=1)
            box = np.clip(raw, [x, y, x, y], [x + FINE, y + FINE, x + FINE, y + FINE])
            xs, ys = np.unique(box[:, 0::2]), np.unique(box[:, 1::2])
            i, j = np.searchsorted(xs, box[:, 0::2]), np.searchsorted(ys, box[:, 1::2])
            edge = np.zeros((len(xs) + 1, len(ys) + 1), np.int32)
            for a, b, sign in ((0, 0, 1), (0, 1, -1), (1, 0, -1), (1, 1, 1)):
                np.add.at(edge, (i[:, a], j[:, b]), sign)
            count = edge.cumsum(axis=0).cumsum(axis=1)
            area = np.outer(np.diff(xs), np.diff(ys))
            parts = np.zeros(len(box))
            for k in range(len(box)):
                (p, q), (r, s) = i[k], j[k]
                over = count[p:q, r:s].copy()
                for m in np.flatnonzero((np.abs(raw - raw[k]) < 1.0).all(axis=1)):
                    over[max(i[m, 0] - p, 0):max(i[m, 1] - p, 0), max(j[m, 0] - r, 0):max(j[m, 1] - r, 0)] -= 1
                parts[k] = area[p:q, r:s][over > 0].sum()
            some = parts > 0
            yield pa.RecordBatch.from_arrays([held.field("key").filter(pa.array(some)), pa.array(parts[some])], ["key", "part"])


def with_overlap(boxes: DataFrame, key: str = "det_id", keys: Sequence[str] = FRAME, asked: Column | None = None) -> DataFrame:
    """Add ``overlap_ratio``: the share of each box that others of its frame cover. With ``asked`` only boxes that fulfil it are given."""
    b = g.box()
    ratio = F.when(g.degenerate(b), 0.0).otherwise(F.least(F.coalesce("covered", F.lit(0.0)) / g.area(b), F.lit(1.0)))
    given = boxes if asked is None else boxes.where(asked)
    return given.join(covered_area(boxes, key, keys, asked=asked), key, "left").withColumn("overlap_ratio", ratio).drop("covered")


def with_scores(boxes: DataFrame, key: str = "det_id", keys: Sequence[str] = FRAME, asked: Column | None = None) -> DataFrame:
    """Add overlap, subscores, visibility score and tag of every detection, or of those that fulfil ``asked``."""
    b, w, h = g.box(), F.col("frame_w"), F.col("frame_h")
    # a lone box has no overlap, so its score is the same as with the frame count at hand
    scores = g.subscores(b, F.col("confidence"), w, h, F.col("overlap_ratio"), F.lit(2))
    return (
        with_overlap(boxes, key, keys, asked).withColumn("subscores", scores)
        .withColumn("visibility_score", g.visibility(F.col("subscores")))
        .withColumn("visibility_tag", g.visibility_tag(F.col("visibility_score")))
    )


# detections against track boxes ------------------------------------------------------------


def untouched(detections: DataFrame, tracks: DataFrame, key: str = "det_id", min_iou: float = 0.0,
              keys: Sequence[str] = FRAME) -> DataFrame:
    """Detections that no track box of the frame overlaps by ``min_iou`` or more."""
    pairs = meeting_pairs(detections.select(key, *keys, "x1", "y1", "x2", "y2"),
                          tracks.select(*keys, "x1", "y1", "x2", "y2"), keys)
    hit = pairs.where(g.iou_eps(g.box("l_"), g.box("r_")) >= min_iou).select(F.col(f"l_{key}").alias(key)).distinct()
    return detections.join(hit, key, "left_anti")


def nearest_detection(tracks: DataFrame, detections: DataFrame, track_key: str, det_key: str,
                      keys: Sequence[str] = FRAME) -> DataFrame:
    """Per track box the detection of its frame with the closest corners."""
    t = tracks.select(*keys, track_key, *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    q = detections.select(*keys, F.col(det_key).alias("_det"), *[F.col(c).alias(f"d_{c}") for c in ("x1", "y1", "x2", "y2")])
    far = g.corner_distance(g.box("t_"), g.box("d_"))
    return t.join(q, list(keys)).groupBy(*keys, track_key).agg(
        F.min_by("_det", F.struct(far.alias("f"), F.col("_det"))).alias("nearest"), F.min(far).alias("distance"))


def drop_covered_tracks(lost: DataFrame, active: DataFrame, key: str, max_cost: float = 0.15,
                        keys: Sequence[str] = FRAME) -> DataFrame:
    """Lost tracks that coincide with an active one are dropped."""
    pairs = meeting_pairs(lost.select(key, *keys, "x1", "y1", "x2", "y2"),
                          active.select(*keys, "x1", "y1", "x2", "y2"), keys)
    same = pairs.where(F.lit(1.0) - g.iou_eps(g.box("l_"), g.box("r_")) < max_cost)
    return lost.join(same.select(F.col(f"l_{key}").alias(key)).distinct(), key, "left_anti")


def joint_tracks(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union by id; the first list wins."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    rest = [c for c in first.columns if c != key]
    kept = both.groupBy(key).agg(F.min_by(F.struct(*rest), "_p").alias("_row"))
    return kept.select(key, "_row.*")


def without_tracks(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    return first.join(second.select(key), key, "left_anti")
