"""Hand-overs close in time and place, against all pairs of tracklets."""

import math
import random

import pytest

from sightline.operators import temporal

SHAPE = ("entity_id long, tracklet_id string, device_id string, frame_start long, frame_end long, "
         "first_box struct<x1 double, y1 double, x2 double, y2 double>, last_box struct<x1 double, y1 double, x2 double, y2 double>")


def rows(n, size, seed):
    rng = random.Random(seed)

    def box():
        x, y, s = rng.choice([rng.uniform(-300, 900), 64.0 * rng.randint(0, 9)]), rng.uniform(0, 700), rng.choice(size)
        return None if rng.random() < 0.05 else (x, y, x + s, y + s * rng.uniform(0.3, 1))

    out = []
    for k in range(n):
        start = rng.randint(-500, 4000)
        out.append((rng.randint(0, n // 4), f"t{k}", f"d{k % 2}", start, start + rng.choice([0, 5, 60, 1500]), box(), box()))
    return out


def brute(table, gap, reach):
    def near(p, q):
        size = max(1.0, *(b[i + 2] - b[i] for b in (p, q) for i in (0, 1)))
        return math.hypot((p[0] + p[2] - q[0] - q[2]) / 2, (p[1] + p[3] - q[1] - q[3]) / 2) / size <= reach

    return {(a[1], b[1]) for a in table for b in table
            if a[0] != b[0] and a[2] == b[2] and a[6] and b[5] and b[3] <= a[4] + gap and a[3] <= b[4] and near(a[6], b[5])}


@pytest.mark.parametrize("size,gap,reach", [((30, 60), 240, 1.3), ((1, 8, 64, 65, 900), 10, 1.3), ((0.5, 200), 0, 0.4)])
def test_handovers_equal_all_pairs_and_come_once(spark, size, gap, reach):
    table = rows(300, size, 7)
    got = [(r.a_tracklet_id, r.b_tracklet_id) for r in temporal.handovers(spark.createDataFrame(table, SHAPE), gap, reach).collect()]
    want = brute(table, gap, reach)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    entity = {t[1]: t[0] for t in table}
    pairs = temporal.nearby_pairs(spark.createDataFrame(table, SHAPE), gap, reach).collect()
    assert {(r.entity_a, r.entity_b) for r in pairs} == {tuple(sorted((entity[a], entity[b]))) for a, b in want}


def test_no_tracklets_no_handovers(spark):
    assert temporal.handovers(spark.createDataFrame([], SHAPE), 240, 1.3).count() == 0
