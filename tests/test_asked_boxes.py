"""Boxes that are not asked for cover others and are not given."""

from pyspark.sql import functions as F

from sightline.operators import overlap


def test_overlap_of_asked_boxes_counts_all(spark):
    rows = [(k, "d", k // 6, float(k % 6 * 30), 0.0, float(k % 6 * 30 + 50 + k), 90.0) for k in range(60)]
    boxes = spark.createDataFrame(rows, "det_id long, device_id string, frame_no long, x1 double, y1 double, x2 double, y2 double")
    every = {r.det_id: r.overlap_ratio for r in overlap.with_overlap(boxes).collect()}
    some = overlap.with_overlap(boxes, asked=F.col("det_id") % 3 == 1).collect()
    assert {r.det_id: r.overlap_ratio for r in some} == {k: v for k, v in every.items() if k % 3 == 1}
    assert any(r.overlap_ratio > 0 for r in some)
