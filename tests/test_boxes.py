"""Box scores on hand-made edge cases, and properties of the pair measures."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators import overlap

BOXES = "device_id string, frame_no long, det_id string, x1 double, y1 double, x2 double, y2 double"


def one(spark, expr, x1, y1, x2, y2, w=1920, h=1080):
    df = spark.createDataFrame([(float(x1), float(y1), float(x2), float(y2), w, h)],
                               "x1 double, y1 double, x2 double, y2 double, frame_w int, frame_h int")
    return df.select(expr.alias("v")).first().v


def test_cutoff_counts_edges(spark):
    score = g.cutoff_score(g.box(), F.col("frame_w"), F.col("frame_h"))
    assert one(spark, score, 100, 100, 200, 200) == 1.0
    assert one(spark, score, 3, 100, 200, 200) == 0.6
    assert one(spark, score, 3, 3, 200, 200) == 0.3
    assert one(spark, score, 3, 100, 1918, 200) == 0.1
    assert one(spark, score, 0, 0, 1920, 1080) == 0.05
    assert one(spark, score, 200, 100, 100, 200) == 0.05


def test_union_is_less_than_sum(spark):
    rows = [("d", 1, "a", 0.0, 0.0, 10.0, 10.0), ("d", 1, "b", 5.0, 0.0, 15.0, 10.0), ("d", 1, "c", 5.0, 5.0, 15.0, 15.0),
            ("d", 1, "a2", 0.5, 0.0, 10.0, 10.0), ("d", 2, "x", 0.0, 0.0, 10.0, 10.0), ("d", 3, "deg", 5.0, 5.0, 5.0, 9.0)]
    got = {r.det_id: r.overlap_ratio for r in overlap.with_overlap(spark.createDataFrame(rows, BOXES)).collect()}
    assert got["a"] == 0.5 and got["x"] == 0.0 and got["deg"] == 0.0
    assert abs(got["c"] - 0.5) < 1e-9


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 600), st.integers(0, 600), st.integers(2, 400), st.integers(2, 400)), min_size=2, max_size=7))
def test_overlap_equals_pixel_count(spark, raw):
    import numpy as np

    rows = [("d", 1, str(i), float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(raw)]
    got = {r.det_id: r.overlap_ratio for r in overlap.with_overlap(spark.createDataFrame(rows, BOXES)).collect()}
    for i, (x, y, w, h) in enumerate(raw):
        grid = np.zeros((h, w), dtype=bool)
        for j, (p, q, r, s) in enumerate(raw):
            if all(abs(a - b) < 1 for a, b in zip((x, y, x + w, y + h), (p, q, p + r, q + s))):
                continue
            grid[max(0, q - y):max(0, q + s - y), max(0, p - x):max(0, p + r - x)] = True
        assert abs(got[str(i)] - grid.mean()) < 1e-9


def test_iou_is_symmetric_and_bounded(spark):
    df = spark.range(200).select(*[((F.col("id") * k) % 97).cast("double").alias(n) for k, n in ((7, "ax1"), (11, "ay1"), (13, "bx1"), (17, "by1"))])
    df = df.select("*", (F.col("ax1") + 30).alias("ax2"), (F.col("ay1") + 40).alias("ay2"), (F.col("bx1") + 25).alias("bx2"), (F.col("by1") + 45).alias("by2"))
    a, b = g.box("a"), g.box("b")
    bad = df.where((F.abs(g.iou(a, b) - g.iou(b, a)) > 1e-12) | (g.iou(a, b) < 0) | (g.iou(a, b) > 1))
    assert bad.count() == 0


def test_a_crowded_frame_equals_pixel_count(spark):
    """20,000 boxes in one frame, some of them twice, and a second frame with few."""
    import numpy as np

    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 1860, 20_000), rng.integers(0, 950, 20_000)
    w, h = rng.integers(4, 60, 20_000), rng.integers(4, 130, 20_000)
    x[19_000:], y[19_000:], w[19_000:], h[19_000:] = x[:1000], y[:1000], w[:1000], h[:1000]
    image = np.zeros((1081, 1921), int)
    for a, b, c, d in zip(x, y, w, h):
        image[b:b + d, a:a + c] += 1
    rows = [("d", 1, str(i), float(a), float(b), float(a + c), float(b + d)) for i, (a, b, c, d) in enumerate(zip(x, y, w, h))]
    rows += [("d", 2, "p", 0.0, 0.0, 10.0, 10.0), ("d", 2, "q", 5.0, 0.0, 10.0, 10.0)]
    got = {r.det_id: r.overlap_ratio for r in overlap.with_overlap(spark.createDataFrame(rows, BOXES)).collect()}
    assert len(got) == 20_002 and got["p"] == 0.5 and got["q"] == 1.0
    for i in [*range(0, 1000, 40), *range(1000, 20_000, 500)]:
        same = int(((x == x[i]) & (y == y[i]) & (w == w[i]) & (h == h[i])).sum())
        part = image[y[i]:y[i] + h[i], x[i]:x[i] + w[i]] > same
        assert abs(got[str(i)] - part.mean()) < 1e-9


def test_boxes_of_a_small_frame_meet_without_cells(spark):
    """A box of a frame of few is a row once; larger frames and small ones side by side give what a count of pixels gives."""
    r = np.random.default_rng(4)
    rows = []
    for frame, n in ((1, 2), (2, 7), (3, overlap.FEW), (4, overlap.FEW + 1), (5, 70)):
        for k in range(n):
            x, y, w, h = (int(v) for v in r.integers([0, 0, 20, 20], [900, 700, 300, 300]))
            rows.append((f"{frame}-{k}", "d", frame, float(x), float(y), float(x + w), float(y + h)))
    rows.append(("no corner", "d", 2, None, 0.0, 900.0, 400.0))
    rows += [("endless", "d", 9, 100.0, 0.0, None, 400.0), ("met", "d", 9, 400.0, 0.0, 600.0, 100.0)]
    df = spark.createDataFrame(rows, "det_id string, device_id string, frame_no long, x1 double, y1 double, x2 double, y2 double")
    got = {r.det_id: r.covered for r in overlap.covered_area(df).collect()}
    assert got.pop("met") == (512 - 400) * 100.0 and got.pop("endless") == (512 - 400) * 100.0
    rows = rows[:-3]
    for key, _, frame, *box in rows:
        x1, y1, x2, y2 = map(int, box)
        seen = np.zeros((x2 - x1, y2 - y1), bool)
        for k, _, f, *other in rows:
            if f == frame and k != key:
                a, b, c, d = (int(v) for v in other)
                seen[max(a - x1, 0):max(c - x1, 0), max(b - y1, 0):max(d - y1, 0)] = True
        assert got.get(key, 0.0) == seen.sum(), key
    small = overlap.covered_area(df.where("frame_no <= 3"))
    assert "Generate" not in small._jdf.queryExecution().optimizedPlan().toString() and "no corner" not in got
